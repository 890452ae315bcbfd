"""Substring dedup by level-wise doubling: words covered by a window of `length` words that occurs elsewhere go.

The levels are windows of 9, 18 and 35 words: halves of the length until they are short. On a level below the last, the
window of least hash inside each full window is posted (a minimiser: equal full windows take equal ones, so a full window
can only repeat if this one does, and one position in a few is posted). What repeats alone goes on to twice the length, until
no candidates survive or the length is reached, where the full windows themselves are posted, by 88 bits of hash. What is
posted is shuffled once, by the window: the same files are counted and joined back, both as streams of rows, so that a
common window is never gathered. The texts are shuffled once, by row, for the levels and the result alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import chunks_of, hash_words, mix, window_hashes

LENGTH = 35


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the (leftmost) position of the least of `width` values from there."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        span += step
    return at


def levels(length: int) -> list[int]:
    """The windows' lengths: doubled from at least nine words up to the length."""
    out = [length]
    while out[0] >= 18:
        out.insert(0, -(-out[0] // 2))
    return out


def _windows(words: np.ndarray, counts: np.ndarray, length: int, short: int):
    """Starts of the full windows that lie in one text, the position of each one's window of a level, the texts' starts, and those windows' hashes."""
    grams = window_hashes(words, short)
    ends = np.cumsum(counts)
    starts = ends - counts
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), starts, grams
    at = _least(grams, length - short + 1) if short < length else np.arange(len(grams))
    room = np.repeat(ends, counts)[: len(at)] - np.arange(len(at))
    inside = np.flatnonzero(room >= length)
    return inside, at[inside], starts, grams


def _each(b: pa.RecordBatch, text: int):
    """(texts, their words' hashes, words a text, first row) by chunks of a batch."""
    texts = b.column(text).to_pylist()
    for first, last in chunks_of(texts):
        words, counts, *_ = hash_words(texts[first:last])
        yield words, counts, first


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row and row2 (hashes of id and text, 128 bits: equal rows have equal results) and the text's bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), F.xxhash64(F.lit(1), text, "doc_id").alias("row2"), text.cast("binary").alias("text"))


def windows(rows: DataFrame, level: int, length: int = LENGTH, before: tuple[int, DataFrame] | None = None) -> DataFrame:
    """row, h, x of a level's windows, for the full windows whose window of the level before repeats.

    x holds the place in its low 32 bits and, on the last level, 24 more bits of the window's hash over 8 more of the row's.
    before: the level before and its repeated windows (row, at); none for the first. Rows that share `row` alone, and windows
    that share h, only add candidates before the last level, which tells them apart."""
    old, last = before[0] if before else 0, level == length
    both = rows if before is None else rows.join(before[1].hint("shuffle_hash"), "row").select(*rows.columns, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.column(4).to_pylist() if old else None
            for words, counts, first in _each(b, 3):
                starts, at, docs_at, grams = _windows(words, counts, length, level)
                if old:
                    alive = np.zeros(len(words) + 1, bool)
                    for k, (s, n) in enumerate(zip(docs_at, counts, strict=True)):
                        own = np.asarray(kept[first + k], np.int64)
                        alive[s + own[own < n]] = True
                    at = at[alive[_windows(words, counts, length, old)[1]]]
                at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                if len(at):
                    row = np.searchsorted(docs_at, at, side="right") - 1
                    of = pa.array(row + first)
                    x = at - docs_at[row]
                    if last:
                        more = window_hashes(mix(words), level)[at] >> np.uint64(40) << np.uint64(40)
                        x = x | more.view(np.int64) | (b.column(2).take(of).to_numpy() & 255) << 32
                    yield pa.RecordBatch.from_arrays([b.column(1).take(of), pa.array(grams[at].view(np.int64)), pa.array(x)], names=["row", "h", "x"])

    return both.mapInArrow(run, "row long, h long, x long")


def _repeated(posted: DataFrame) -> DataFrame:
    """row and at (set of x without the hash's bits, so that copies of one row add nothing) of what is posted more than once.

    The condition names all columns, and h alone is the join's key, so that the rows counted and those joined are one shuffle's."""
    whole = posted.where("row IS NOT NULL AND h IS NOT NULL AND shiftrightunsigned(x, 40) IS NOT NULL")  # as the joins infer for one of the two alone
    dealt = whole.repartition("h").select("row", "h", "x", F.expr("shiftrightunsigned(x, 40)").alias("more"))
    several = (F.col("n") > 1) | (F.col("r") != F.col("r0")) | (F.col("y") != F.col("y0"))
    counted = dealt.groupBy("h", "more").agg(F.count("*").alias("n"), F.min("row").alias("r"), F.max("row").alias("r0"), F.min("x").alias("y"), F.max("x").alias("y0"))
    twice = counted.where(several).select(F.col("h").alias("hash"), F.col("more").alias("other"))
    return dealt.join(twice, F.expr("h = hash AND (more ^ other) = 0"), "left_semi").groupBy("row").agg(F.collect_set(F.expr(f"x & {(1 << 40) - 1}L")).alias("at"))


def repeated_windows(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """row and at (8 bits of row2, then 32 of the place): the starts of its repeated full windows, for each row that has any. Lengths and levels are parameters, so the plan has a step a level."""
    before = None
    for level in levels(length):
        before = level, _repeated(windows(rows, level, length, before))
    return before[1]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of docs(doc_id, text).

    Words stand between ASCII white space, unchanged. A word goes if any window of `length` consecutive words over it
    has its word sequence starting anywhere else too, in the same text or another; windows are judged on the input.
    A repeated row makes its windows repeat. Null text: no words; an empty table: no rows; other columns are ignored.
    Windows are told apart by 88 bits of hash, rows by 72."""
    rows = _rows(docs)
    both = rows.join(repeated_windows(rows, length).hint("shuffle_hash"), "row", "left").select("doc_id", "text", F.expr(f"transform(filter(at, x -> shiftright(x, 32) = (row2 & 255)), x -> x & {(1 << 32) - 1}L)").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(starts)
                    edge[at] += 1
                    edge[at + length] -= 1
                    stay = np.cumsum(edge[:-1]) == 0
                    words = list(compress(words, stay.tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
