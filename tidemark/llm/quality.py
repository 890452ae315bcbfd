"""Quality classifier: ordinal cumulative-link regression on graded ratings with hashed-text weights.

P(grade >= k) = logistic(w.x - t_k) with one weight vector for all grades and ordered thresholds t_1 < t_2 < ... . x has
a 1 for each hashed token and word beginning that a text holds and for the band of each of a few shares (signs, capitals, repeats, length).
Buckets without a marked relation to the grade in the sample get no weight, so that long texts gather no noise. The
expected grade is the sum of the tail probabilities; a text is kept by the tail probability of the top grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import chunks_of, hash_tokens, mix

BUCKETS = 1 << 18
#: At most so many labelled rows are fitted on: those with the least hash of their id.
SAMPLE = 20_000
LEAST_DOCS, STEPS, RIDGE = 5, 400, 1e-3
KEEP_AT = 0.5
#: Words count by their first so many bytes too, for what inflection and compounds hide.
BEGINNINGS = (5, 6, 7)
GRADES = 3


def grade(quality, toxic):
    """Ratings as grades: 0 poor text, 1 fine text with toxic words, 2 fine text. A missing rating counts as fine."""
    return F.when(F.coalesce(quality, F.lit(1)) < 1, 0).when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature that a text has; a bucket can come more than once."""
    h, counts, word, upper, size, heads = hash_tokens(texts, BEGINNINGS)
    text = np.repeat(np.arange(len(texts)), counts)
    per = lambda x: np.bincount(text, x, len(texts))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1]) & word[1:]
    words = per(word)
    least = np.maximum(words, 1)
    shares = [per(~word) / least, per(word & (upper >= 2)) / least, per(again) / least, per(size * word) / least / 20, per(~word & (size >= 2)) / least]
    bands = [np.minimum(20, (s * 20).astype(np.int64)) for s in shares] + [np.log2(words + 1).astype(np.int64)]
    made = np.concatenate([mix(np.asarray(b + 1000 * (k + 1), np.uint64)) for k, b in enumerate(bands)])
    return np.concatenate([text, *(text[i] for i, _ in heads), np.tile(np.arange(len(texts)), len(bands))]), (np.concatenate([h, *(x for _, x in heads), made]) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each text."""
        dense = np.full(BUCKETS, -1, np.int32)
        dense[self.buckets] = np.arange(len(self.buckets))
        score = np.zeros(len(texts))
        for a, b in chunks_of(texts):
            text, bucket = features(texts[a:b])
            k = dense[bucket]
            key = np.unique(text[k >= 0] * len(dense) + k[k >= 0])
            score[a:b] = np.bincount(key // len(dense), self.weights[key % len(dense)], b - a)
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def fit_rows(grades: np.ndarray, lists: list[np.ndarray], levels: int = GRADES) -> Model:
    """The model from graded feature lists: screening by the buckets' relation to the grade, then Adam on the likelihood.

    A bucket passes where its relation is worth more than it costs by the Bayesian information criterion: z ** 2 >= log(rows)."""
    n = len(grades)
    y = grades.astype(float)
    rows = np.repeat(np.arange(n), [len(x) for x in lists])
    cols = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    shares = np.array([(y >= k).mean() if n else 0.5 for k in range(1, levels)]).clip(1e-3, 1 - 1e-3)
    thresholds = -np.log(shares / (1 - shares))
    thresholds = np.maximum.accumulate(thresholds + 1e-3 * np.arange(levels - 1))
    if n < 2 or not y.std():
        return Model(np.zeros(0, np.int64), np.zeros(0), thresholds)
    df, total = np.bincount(cols, minlength=BUCKETS), np.bincount(cols, y[rows], BUCKETS)
    spread = np.sqrt(np.maximum(df * (1 - df / n), 1e-9)) * y.std()
    chosen = np.flatnonzero((df >= LEAST_DOCS) & ((total - df * y.mean()) ** 2 >= np.log(n) * spread**2))
    index = np.full(BUCKETS, -1)
    index[chosen] = np.arange(len(chosen))
    held = index[cols] >= 0
    rows, cols = rows[held], index[cols[held]]
    w, cuts = np.zeros(len(chosen)), np.concatenate([thresholds[:1], np.log(np.diff(thresholds) + 1e-6)])
    m, v = np.zeros(len(w) + len(cuts)), np.zeros(len(w) + len(cuts))
    g = grades.astype(int)
    for step in range(1, STEPS + 1):
        t = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
        s = np.bincount(rows, w[cols], n)
        tails = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -40, 40))), np.zeros((n, 1))], axis=1)
        p = np.maximum(tails[np.arange(n), g] - tails[np.arange(n), g + 1], 1e-12)
        slope = tails * (1 - tails)
        up, down = slope[np.arange(n), g] / p, slope[np.arange(n), g + 1] / p  # of the lower and the upper threshold
        by_t = np.array([up[g == k].sum() - down[g == k - 1].sum() for k in range(1, levels)]) / n
        grads = np.concatenate([-np.bincount(cols, (up - down)[rows], len(w)) / n + RIDGE * w, [by_t.sum(), *(by_t[k:].sum() * np.exp(cuts[k]) for k in range(1, levels - 1))]])
        m, v = 0.9 * m + 0.1 * grads, 0.999 * v + 0.001 * grads**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, cuts = w - move[: len(w)], cuts - move[len(w) :]
    return Model(chosen, w, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from docs(doc_id, text) and labels(doc_id, quality, toxic), on at most `sample` labelled ids.

    Several ratings of an id count as the worst of them; labels without a document, and null ids, don't count. The
    fitting runs in one task on those rows' feature lists alone. No labelled rows: even odds for every text."""
    rated = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(grade(F.min("quality"), F.max("toxic")).cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("grade", "text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, last in chunks_of(texts):
                text, bucket = features(texts[first:last])
                key = np.unique(text * BUCKETS + bucket)
                ends = np.searchsorted(key, np.arange(last - first + 1) * BUCKETS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends), pa.array((key % BUCKETS).astype(np.int32)))], names=["grade", "buckets"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        m = fit_rows(pdf["grade"].to_numpy(), list(pdf["buckets"]))
        return pd.DataFrame([{"buckets": m.buckets.tolist(), "weights": m.weights.tolist(), "thresholds": m.thresholds.tolist()}])

    made = rows.mapInArrow(listed, "grade int, buckets array<int>").groupBy().applyInPandas(fitted, "buckets array<long>, weights array<double>, thresholds array<double>").first()
    if made is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.linspace(-1e-3, 1e-3, GRADES - 1))
    return Model(np.asarray(made.buckets, np.int64), np.asarray(made.weights, float), np.asarray(made.thresholds, float))


def _judged(docs: DataFrame, model: Model) -> DataFrame:
    """docs and __judged, a struct of the expected grade and the tail probability."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2**18 weights

    @F.pandas_udf("expected double, tail double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        tails = shared.value.tails([(t or "").encode() for t in texts])
        return pd.DataFrame({"expected": tails.sum(1), "tail": tails[:, -1]})

    return docs.withColumn("__judged", judge("text"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that `score` would keep, with the columns of docs as they are, whatever their names."""
    return _judged(docs, model).where(F.col("__judged.tail") >= KEEP_AT).select(*[F.col(f"`{c}`") for c in docs.columns])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with expected_grade, tail_probability (of the top grade) and keep, in place of columns of these names.

    Null text: as empty; repeated rows are judged alike; an empty table gives no rows. Every row is scored on its whole text."""
    others = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "keep")]
    both = _judged(docs, model)
    return both.select(*[F.col(f"`{c}`") for c in others], F.col("__judged.expected").alias("expected_grade"), F.col("__judged.tail").alias("tail_probability"), (F.col("__judged.tail") >= KEEP_AT).alias("keep"))
