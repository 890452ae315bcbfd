"""Benchmark decontamination by latent semantic retrieval, checked by longest common subsequence and answers.

Terms are those of the benchmark; their document frequencies are counted over all documents. A randomised SVD of TF-IDF
passages gives the latent space: subspace iteration, each step a distributed product A'(A Q), on all documents
and the benchmark's own items at equal weight (so that its directions are in the space). Then every passage of
every document is projected and compared with all items in blocks. Candidates over a cosine are checked in the
document: by the share of the item's words that follow one another there as in the item, and for looser matches also
by the item's answer.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import chunks_of, hash_tokens, materialise, row_key

#: Words of a block; a passage is two blocks in a row, so passages of 32 words start every 16.
BLOCK = 16
RANK, OVERSAMPLE, ITERATIONS, SEED = 64, 16, 2, 7
#: Terms in more than this share of the documents don't tell passages apart; a passage with fewer than LEAST others can't be found.
COMMON, LEAST = 0.05, 3
COSINE, SURE, LOOSE, ANSWER = 0.55, 0.8, 0.55, 0.75
TERM_ROWS = 256
#: An item of more words is found by passages of two blocks, as documents are; all are checked whole.
WHOLE = 64
#: Words of the items that are searched for at once: bounds what is collected and broadcast. A larger benchmark is searched in parts.
MOST_WORDS = 2_000_000


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        masks[x] |= 1 << i
    full, row = (1 << len(a)) - 1, 0
    for x in b:
        u = row | masks.get(x, 0)
        row = u & ~(u - ((row << 1) | 1)) & full
    return row.bit_count()


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits) of several texts, and their number a text."""
    h, counts, word, *_ = hash_tokens(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    return h[word], np.bincount(text[word], minlength=len(texts)).astype(np.int64)


@dataclass
class Index:
    """What the search needs: sizes follow the benchmark alone."""

    terms: np.ndarray  # sorted word hashes of the benchmark
    idf: np.ndarray
    axes: np.ndarray  # terms x rank, times the terms' idf once built
    items: np.ndarray  # the items' passages x rank, of length 1
    owner: np.ndarray  # the item of each passage
    ids: list
    words: list  # the items' word hashes
    answers: list  # word hashes of the answers, or of the rarest quarter of the item's words

    def position(self, words: np.ndarray) -> np.ndarray:
        """Place among the terms, -1 for other words."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)


def _blocks(index: Index, words: np.ndarray, counts: np.ndarray):
    """(block numbers, text of each block) of words laid out by text: blocks of BLOCK words that don't reach across texts."""
    per = -(-counts // BLOCK)
    first = np.cumsum(per) - per
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    block = first[text] + (np.arange(len(words)) - starts[text]) // BLOCK
    return block, np.repeat(np.arange(len(counts)), per), first


def _summed(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by ascending group."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(group):
        at = np.flatnonzero(np.diff(group, prepend=-1))
        out[group[at]] = np.add.reduceat(rows, at, axis=0)
    return out


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and the number of documents, over all rows."""
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    empty = Index(terms, np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0, np.int64), [], [], [])
    shared = docs.sparkSession.sparkContext.broadcast(empty)  # the benchmark's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n, df = shared.value, 0, np.zeros(len(terms), np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            n += len(texts)
            for first, last in chunks_of(texts):
                words, counts = _words(texts[first:last])
                at = index.position(words)
                held = at >= 0
                key = np.unique(np.repeat(np.arange(last - first), counts)[held] * np.int64(max(1, len(terms))) + at[held])
                df += np.bincount(key % max(1, len(terms)), minlength=len(terms))[: len(terms)]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(df[held], n))], names=["term", "n"])

    df, n = np.zeros(len(terms), np.int64), 0
    for term, x in rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").cast("long")).collect():
        if term < 0:
            n = x
        else:
            df[term] = x
    return df, n


def _telling(index: Index, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(block, term) of the telling words of texts cut into single blocks."""
    words, counts = _words(texts)
    block, *_ = _blocks(index, words, counts)
    at = index.position(words)
    telling = np.append(index.idf, 0)[at] > 0
    return block[telling], at[telling]


def _weighted(index: Index, block: np.ndarray, at: np.ndarray):
    """TF-IDF entries (passage, term, weight), each passage of length 1."""
    w = index.idf[at]
    norm = np.sqrt(np.bincount(block, w * w)) if len(block) else np.zeros(0)
    return block, at, (w / np.maximum(norm[block], 1e-9)).astype(np.float32)


def passages(docs: DataFrame, index: Index) -> DataFrame:
    """block, term: the telling words of all documents, as arrays of 32 bits for each chunk of texts, written once for all steps of the iteration."""
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # of the benchmark's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            texts = b.column(0).to_pylist()
            for first, last in chunks_of(texts):
                both = [[x.astype(np.int32).tobytes()] for x in _telling(index, texts[first:last])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in both], names=["block", "term"])

    return materialise(rows.mapInArrow(run, "block binary, term binary"), "passages")


def _product(entries, q: np.ndarray) -> np.ndarray:
    """A'(A q) for the passages' entries."""
    block, at, w = entries
    y = _summed(q[at] * w[:, None], block, int(block[-1]) + 1 if len(block) else 0)
    order = np.argsort(at, kind="stable")
    return _summed(y[block[order]] * w[order, None], at[order], len(q))


def axes(docs: DataFrame, index: Index, items: list[bytes], rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors, each divided by its singular value (terms x rank), of the TF-IDF passages of all documents, with the items."""
    n = len(index.terms)
    r = min(n, rank + OVERSAMPLE)
    if not n:
        return np.zeros((0, 0), np.float32)
    rows = passages(docs, index)
    own = _weighted(index, *_telling(index, items))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, r)))[0].astype(np.float32)
    spark = docs.sparkSession

    def step(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((index, q))  # terms x r numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, q = shared.value
            y, energy = np.zeros_like(q), 0.0
            for b in batches:
                for block, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    entries = _weighted(index, np.frombuffer(block, np.int32), np.frombuffer(at, np.int32))
                    y += _product(entries, q)
                    energy += float((entries[2] ** 2).sum())
            if energy:
                parts = [y[a : a + TERM_ROWS].tobytes() for a in range(0, n, TERM_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([energy] + [0.0] * (len(parts) - 1))], names=["part", "y", "energy"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x, np.float32) for x in pdf["y"]], axis=0)
            return pd.DataFrame([{"part": pdf["part"].iloc[0], "y": total.astype(np.float32).tobytes(), "energy": pdf["energy"].sum()}])

        kind = "part int, y binary, energy double"
        y, energy = np.zeros_like(q), 0.0
        for part, data, e in rows.mapInArrow(run, kind).groupBy("part").applyInPandas(add, kind).collect():  # terms x r numbers in all
            block = np.frombuffer(data, np.float32).reshape(-1, q.shape[1])
            y[part * TERM_ROWS : part * TERM_ROWS + len(block)] = block
            energy += e
        mine = float((own[2] ** 2).sum())
        return y + _product(own, q) * (energy / mine if energy and mine else 1.0)

    for _ in range(ITERATIONS):
        q = np.linalg.qr(step(q))[0].astype(np.float32)
    y = step(q)
    values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    scale = np.sqrt(np.maximum(values[::-1], 1e-6))  # the common directions would else outweigh those that tell items apart
    return np.ascontiguousarray(((q @ turn[:, ::-1]) / scale)[:, :rank]).astype(np.float32)


def build(docs: DataFrame, benchmark: DataFrame, answer: str | None = None, rank: int = RANK) -> Index:
    """The index of benchmark(item_id, text and, if named, an answer column). Items without words can't be found and are left out."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")).distinct().orderBy("item_id", "text").collect()
    texts = [r.text.encode() for r in rows]
    h, counts = _words(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    words = np.split(h, np.cumsum(counts)[:-1]) if texts else []
    terms = np.unique(h)
    df, n = document_frequencies(docs, terms)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1e-3)
    telling = df <= COMMON * n
    for w in words:  # an item of common words alone is told by all of them
        at = np.searchsorted(terms, w)
        if telling[at].sum() < LEAST:
            telling[at] = True
    idf[~telling] = 0
    index = Index(terms, idf, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0, np.int64), [], [], [])
    index.axes = axes(docs, index, texts, rank) * idf[:, None]
    passages, owner = [], []
    for r, w in zip(rows, words, strict=True):
        if not len(w):
            continue
        for first in range(0, len(w) - BLOCK, BLOCK) if len(w) > WHOLE else (0,):
            total = index.axes[index.position(w[first : first + 2 * BLOCK] if len(w) > WHOLE else w)].sum(0)
            passages.append(total / max(float(np.linalg.norm(total)), 1e-9))
            owner.append(len(index.ids))
        index.ids.append(r.item_id)
        index.words.append(w)
        distinct = np.unique(w)
        rare = distinct[np.argsort(-idf[index.position(distinct)], kind="stable")][: max(1, len(distinct) // 4)]
        own = _words([r.answer.encode()])[0] if r.answer else rare
        index.answers.append(own if len(own) else rare)
    index.items = np.asarray(passages, np.float32).reshape(len(passages), index.axes.shape[1])
    index.owner = np.asarray(owner, np.int64)
    return index


def candidates(index: Index, texts: list[bytes], cosine: float = COSINE):
    """(text, first word, last word, item, cosine) of all passages over the cosine, and the words with the texts' bounds."""
    words, counts = _words(texts)
    block, owner, _ = _blocks(index, words, counts)
    at = index.position(words)
    held = np.flatnonzero(np.append(index.idf, 0)[at] > 0)
    sums = np.zeros((len(owner), index.axes.shape[1]), np.float32)
    if len(held):
        sums = _summed(index.axes[at[held]], block[held], len(owner))
    paired, telling = sums.copy(), np.bincount(block[held], minlength=len(owner))
    if len(owner) > 1:
        same = np.append(owner[1:] == owner[:-1], False)
        paired[same] += sums[1:][same[:-1]]
        telling = telling + np.where(same, np.append(telling[1:], 0), 0)
    enough = np.flatnonzero(telling >= min([LEAST, *map(len, index.words)]))
    paired = paired[enough]
    paired /= np.maximum(np.sqrt(np.einsum("ij,ij->i", paired, paired)), 1e-9)[:, None]
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    found = []
    slab = max(64, (1 << 21) // max(1, len(index.items)))
    for a in range(0, len(enough), slab):
        near = paired[a : a + slab] @ index.items.T
        for p, item in zip(*np.nonzero(near >= cosine), strict=True):
            k = enough[a + p]
            first = starts[owner[k]] + number[k] * BLOCK
            found.append((int(owner[k]), int(first), int(min(first + 2 * BLOCK, ends[owner[k]])), int(index.owner[item]), float(near[p, item])))
    return found, words, starts, ends


def checked(index: Index, texts: list[bytes], cosine: float = COSINE) -> dict[tuple[int, int], tuple[float, float, bool]]:
    """(text, item) to (cosine, share of the item's words in sequence, answer there) of the pairs that stand the check."""
    found, words, starts, ends = candidates(index, texts, cosine)
    spans: dict[tuple[int, int], list] = {}
    for text, first, last, item, near in found:
        reach = len(index.words[item])
        first, last = max(starts[text], first - reach), min(ends[text], last + reach)
        known = spans.setdefault((text, item), [])
        if known and first <= known[-1][1] and last - known[-1][0] <= 4 * (reach + BLOCK):
            known[-1] = (known[-1][0], max(last, known[-1][1]), max(near, known[-1][2]))
        else:
            known.append((first, last, near))
    out = {}
    for (text, item), regions in spans.items():
        own = index.words[item]
        best = (0.0, 0.0, False)
        for first, last, near in regions:
            region = words[first:last]
            if np.isin(own, region).mean() < LOOSE:
                continue
            share = lcs(own.tolist(), region.tolist()) / len(own)
            answered = bool(np.isin(index.answers[item], region).mean() >= ANSWER)
            if share >= SURE or share >= LOOSE and answered:
                best = max(best, (share, near, answered))
        if best[0]:
            out[text, item] = (best[1], best[0], best[2])
    return out


def contaminated(docs: DataFrame, index: Index, cosine: float = COSINE) -> DataFrame:
    """rk_id, rk_text, item_id, cosine, in_sequence, answered: a row for each row of docs and item found in it.

    Null text: as empty. Repeated rows have a row each. No benchmark or no documents: no rows."""
    rows = docs.select(*row_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # of the benchmark's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            for first, last in chunks_of(texts) if index.ids else ():
                hits = checked(index, texts[first:last], cosine)
                if hits:
                    at = pa.array([first + t for t, _ in hits])
                    values = [[index.ids[i] for _, i in hits], *zip(*hits.values(), strict=True)]
                    arrays = [pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.float64(), pa.float64(), pa.bool_()], strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *arrays], names=["rk_id", "rk_text", "item_id", "cosine", "in_sequence", "answered"])

    return rows.mapInArrow(run, "rk_id long, rk_text long, item_id long, cosine double, in_sequence double, answered boolean")


def search(docs: DataFrame, benchmark: DataFrame, most_words: int = MOST_WORDS, **how) -> DataFrame:
    """rk_id, rk_text, item_id, cosine, in_sequence, answered of every item of the benchmark in every row of docs, as `contaminated` gives them.

    The benchmark is searched in parts of about `most_words` words, each with its own latent space, so that the memory of
    driver and executors is bounded whatever its size. Extra columns of either table, whatever their names, are not read."""
    words = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), " ")))).first()[0] or 0
    parts, hits = max(1, -(-words // most_words)), None
    for k in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else benchmark
        own = contaminated(docs, build(docs, part, **how))
        hits = own if hits is None else hits.unionAll(own)
    return hits


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs in which no item of the benchmark is found, with their columns. Repeated rows stay or go alike; null texts stay."""
    hits = search(docs, benchmark, **how).select(F.col("rk_id").alias("__hid"), F.col("rk_text").alias("__htext")).distinct()
    names = [(c, f"__{i}") for i, c in enumerate(docs.columns)]  # docs may have columns of any name
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names], *[k.alias(f"__{n}") for k, n in zip(row_key(), ("id", "text"), strict=True)])
    return rows.join(hits, F.expr("__id <=> __hid AND __text = __htext"), "left_anti").select(*[F.col(n).alias(c) for c, n in names])
