"""Phrase collocations by Apriori passes over the texts, level by level.

The first pass counts words. Each later one, for phrases of k words, emits a phrase only if both phrases of k - 1 words inside
it are frequent, and counts what was emitted; a frequent phrase can't have a rare part, so nothing is lost. What is broadcast
for the test is a table of bits over the frequent phrases' hashes, at most 2**BITS of them whatever the corpus: where it fills
up, more phrases are emitted than need be, and the counts decide. Counts are summed in each task before they are shuffled, and
a phrase goes as the hash of its first k - 1 words and that of its last word; its text is put together from the levels below.
Cuts are scored from the level tables, which hold frequent phrases alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import chunks_of, hash_words, materialise, mix

#: Most bits of a level's table (64 MB), bits for each phrase as long as there is room, and bits of a part that one task fills.
BITS, SPARSE, PART = 29, 32, 19
#: Phrases gathered in a task before they are counted and passed on: about 100 MB with what sorting needs, for each task at a time.
GATHERED = 1 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_ENDS = np.zeros(256, np.int64)  # what ends a piece
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = 1
_APART = _ENDS > 0  # what ends a word
_APART[list(b" \t")] = True


def _extended(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one more word at their end."""
    return mix(grams * _STEP + words)


class _Texts:
    """Words of some texts in one row, as hashes that tell languages apart, with what is needed to spell them."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        h, counts, self.buf, self.starts, self.ends = hash_words(texts, lower=True, white=_APART)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.words = mix(h + langs[self.doc])
        self.piece = np.cumsum(_ENDS[np.frombuffer(self.buf, np.uint8)])[self.starts]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the runs of k words; a run may reach over the end of its piece."""
        out = self.words[: max(0, len(self.words) - k + 1)]
        for j in range(1, k):
            out = _extended(out, self.words[j : j + len(out)])
        return out

    def whole(self, k: int) -> np.ndarray:
        """Whether the run of k words at a place lies within one piece."""
        n = max(0, len(self.words) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]


def _each(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        texts, langs = b.column(1).to_pylist(), b.column(2).to_numpy().view(_U)
        for first, last in chunks_of(texts):
            yield b.column(0).slice(first, last - first), _Texts(texts[first:last], langs[first:last])


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce("lang", F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64(lang).alias("of"))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, g (its hash), f of every word of docs(lang, text), and a row of each language, with neither word nor g, for all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, t in _each(batches):
            g, first, n = np.unique(t.words, return_index=True, return_counts=True)
            spelled = [t.buf[s:e].lower() for s, e in zip(t.starts[first].tolist(), t.ends[first].tolist(), strict=True)]
            names = langs.take(pa.array(t.doc[first]))
            yield pa.RecordBatch.from_arrays([names, pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "word", "g", "f"])
            whole = np.bincount(t.doc, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.nulls(len(langs), pa.int64()), pa.array(whole)], names=["lang", "word", "g", "f"])

    found = _texts(docs).mapInArrow(run, "lang string, word string, g long, f long")
    return found.groupBy("lang", "word", "g").agg(F.sum("f").alias("f"))


def bit_table(grams: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """A table of 2**m bits, m at most `bits`, with one set for each hash in the column g; and m. Its parts are filled by tasks of their own."""
    m = min(bits, max(PART, int(grams.count() * SPARSE).bit_length()))

    def fill(part: pa.Table) -> pa.Table:
        held = np.zeros(1 << PART, np.uint8)
        held[part["at"].to_numpy() & ((1 << PART) - 1)] = 1
        return pa.table({"part": part["part"].slice(0, 1), "bits": [np.packbits(held, bitorder="little").tobytes()]})

    at = F.shiftrightunsigned("g", 64 - m)
    parts = grams.select(at.alias("at"), F.shiftright(at, PART).cast("int").alias("part")).groupBy("part").applyInArrow(fill, "part int, bits binary")
    table = np.zeros(1 << m >> 3, np.uint8)
    for r in parts.toLocalIterator():
        table[r.part << (PART - 3) : (r.part + 1) << (PART - 3)] = np.frombuffer(r.bits, np.uint8)
    return table, m


def _held(table: np.ndarray, m: int, grams: np.ndarray) -> np.ndarray:
    at = grams >> _U(64 - m)
    return (table[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """p, w, f of the phrases of several texts, given as hashes of their first words and of their last."""
    p, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, first, n = np.unique(_extended(p, w), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(p[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(n)], names=["p", "w", "f"])


def count_phrases(docs: DataFrame, k: int, below: DataFrame) -> DataFrame:
    """p (hash of the first k - 1 words), w (of the last), f of the phrases of k words whose two parts of k - 1 words are among the hashes g of `below`."""
    held = docs.sparkSession.sparkContext.broadcast(bit_table(below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, m = held.value
        parts, gathered = [], 0
        for _, t in _each(batches):
            grams = t.grams(k - 1)
            frequent = _held(table, m, grams)
            at = np.flatnonzero(frequent[:-1] & frequent[1:] & t.whole(k))
            parts.append((grams[at], t.words[at + k - 1]))
            gathered += len(at)
            if gathered >= GATHERED:
                yield _counted(parts)
                parts, gathered = [], 0
        if gathered:
            yield _counted(parts)

    found = _texts(docs).mapInArrow(run, "p long, w long, f long")
    return found.groupBy("p", "w").agg(F.sum("f").alias("f"))


def _hashed(phrases: DataFrame) -> DataFrame:
    """The columns lang, phrase, words, f, and g in place of p and w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, w = (b.column(c).to_numpy().view(_U) for c in (4, 5))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(_extended(p, w).view(np.int64))], names=["lang", "phrase", "words", "f", "g"])

    return phrases.select("lang", "phrase", "words", "f", "p", "w").mapInArrow(run, "lang string, phrase string, words array<string>, f long, g long")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f of the phrases of 1 to `longest` words that occur `least` times or more; lang, n: all words)."""
    words = materialise(count_words(docs).where((F.col("f") >= least) | F.col("g").isNull()), "words")
    single = words.where("g IS NOT NULL")
    level = single.select("lang", F.col("word").alias("phrase"), F.array("word").alias("words"), "f", "g")
    levels = level
    for k in range(2, longest + 1):
        counted = count_phrases(docs, k, level).where(F.col("f") >= least)
        first = level.select(F.col("g").alias("p"), "lang", "phrase", "words")
        spelled = counted.join(first, "p").join(single.select(F.col("g").alias("w"), "word"), "w")
        longer = spelled.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.concat("words", F.array("word")).alias("words"), "f", "p", "w")
        level = materialise(_hashed(longer), f"phrases{k}")
        levels = levels.unionAll(level)
    return levels.select("lang", "phrase", "words", "f"), words.where("g IS NULL").select("lang", F.col("f").alias("n"))


def best_cuts(levels: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the phrases of two words and more: the cut of lowest score, of the shortest first part among equals.

    score: floor(1000 * a * n / (l * r)), in decimals of 38 digits, with a, l and r the counts of the phrase, the first part and the rest."""
    joined = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    size = F.size("words")
    cuts = levels.where(size > 1).select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, size - F.col("k")).alias("rest"))
    of = levels.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    both = cuts.join(of.select("lang", F.col("part").alias("first"), F.col("count").alias("l")), ["lang", "first"])
    both = both.join(of.select("lang", F.col("part").alias("rest"), F.col("count").alias("r")), ["lang", "rest"]).join(totals, "lang")
    big = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = both.withColumns({"top": (big("a", 17) * big("n", 17)) * F.lit(1000).cast("decimal(4,0)"), "below": big("l", 19) * big("r", 19)})
    scored = scored.withColumn("score", F.expr("top div below"))
    low = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "k")).alias("cut")
    return scored.groupBy("lang", "phrase", "words", "a").agg(low).select("lang", "phrase", "words", "a", "cut.*")


def uncovered(cut: DataFrame, percent: int = 100) -> DataFrame:
    """The phrases but those that lie inside a longer one with at least `percent` hundredths of their count."""
    parts = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))))"
    )
    inner = cut.where(F.size("words") > 2).select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return cut.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, k: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's k best phrases of docs(lang, text), by score, count and spelling.

    Texts have A-Z lower-cased and are cut at . , ; : ! ? and line ends; words stand between spaces and tabs. Phrases of 2 to
    `longest` words that occur `least` times are scored by their lowest cut and dropped inside longer ones, see best_cuts and
    uncovered. Null text: no words; null lang: und; repeated rows count each; an empty table, or nothing frequent: no rows; other
    columns are ignored. Words and phrases are told apart by 64 and 128 bits of hash."""
    levels, totals = frequent_phrases(docs, least, longest)
    cut = materialise(best_cuts(levels, totals), "cuts")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = uncovered(cut, percent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
