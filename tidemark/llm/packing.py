"""Best-fit packing of token sequences into bins of a fixed capacity, planned on the histogram of lengths.

Large pieces (over a third of the capacity) stand at most two to a bin: the longest takes the longest that still fits
beside it. Smaller ones then go, longest first, into the bin with the tightest gap that holds them. Equal lengths are
interchangeable, so the plan is made for runs of pieces of one length, on the histogram (at most `capacity` rows,
whatever the corpus), and holds a few runs for each length: every run that a gap takes at least halves the gap. Pieces
find their place by their rank within their length, which is counted by salts so that a common length is no hot group.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import materialise

CAPACITY = 4096
#: Pieces of one length that share a salt, on average at most; the number of salts follows from the row count.
ROWS_A_SALT = 200_000
#: Words, and pieces of words, whose ids a Python worker keeps in each of two generations; the memory bound of the tokeniser's caches.
CACHE_WORDS = 200_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: runs (length, first rank, number, first sequence, offset, pieces a sequence), by the histogram.

    Piece number r of a run stands in sequence first + r // a, at offset + r % a * length."""
    left = {k: n for k, n in sorted(counts.items(), reverse=True) if n > 0}
    rank, runs, sequence = defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of sequences that have it
    sizes: list[int] = []  # the gaps, ascending

    def put(length: int, n: int, first: int, offset: int, each: int) -> None:
        runs.append((length, rank[length], n, first, offset, each))
        rank[length] += n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        k = large[-1]
        i = bisect_right(large, capacity - k) - 1
        if i == len(large) - 1 and left[k] == 1:
            i -= 1
        other = large[i] if i >= 0 else 0
        bins = left[k] if not other else left[k] // 2 if other == k else min(left[k], left[other])
        for length, offset in ((k, 0), (other, k)):
            if length:
                put(length, bins, sequence, offset, 1)
                left[length] -= bins
        leave(capacity - k - other, sequence, bins)
        sequence += bins
        for x in {k, other} - {0}:
            if not left[x]:
                large.remove(x)
    for k in (k for k in left if 3 * k <= capacity):
        n = left[k]
        while n and (i := bisect_left(sizes, k)) < len(sizes):
            gap = sizes[i]
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(i)
            fit = gap // k
            full = min(bins, n // fit)
            for many, each in ((full, fit), (1 if full < bins else 0, n - full * fit if full < bins else 0)):
                if many and each:
                    put(k, many * each, first, capacity - gap, each)
                    leave(gap - each * k, first, many)
                    n, first, bins = n - many * each, first + many, bins - many
            leave(gap, first, bins)
        for many, each in ((n // (capacity // k), capacity // k), (1, n % (capacity // k))):
            if many and each:
                put(k, many * each, sequence, 0, each)
                leave(capacity - each * k, sequence, many)
                sequence += many
    return runs


#: Letters with one code point each, whose composed form is themselves and whose lower case is one such letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u017eА-яЁё"
#: Parts of these signs are split here as the tokenizer splits them, so that its model alone is asked; all others go through the whole tokenizer.
PLAIN = re.compile(f"[{LETTERS}0-9!-/:;=-@[-`{{-~–—‘’“”„…«»¿¡]+")
#: The tokenizer's own split, for lower-cased parts of those signs.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
#: Bytes that stand for themselves in a byte-level vocabulary; the others are numbered on from 256.
SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_signs() -> dict[int, str]:
    """The sign of each byte in a byte-level vocabulary, by the byte's Latin-1 code point."""
    others = (b for b in range(256) if b not in set(SELF))
    return {b: chr(b) for b in SELF} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Kept(dict):
    """A bounded cache of two generations: when the new one is full it becomes the old one, and what is met again moves on."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 48:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _word_ids(path: str) -> _Kept:
    """Token ids, as little-endian 32-bit bytes, of what stands between ASCII spaces and line feeds.

    The tokenizer drops white space and no token reaches across it, so a text's ids are those of its parts in order.
    A part of plain signs is lower-cased and split here, and each piece, met once in many parts, goes to the model."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, signs = tokenizer.model, byte_signs()

    def of_piece(piece: str) -> bytes:
        data = piece if piece.isascii() else piece.encode().decode("latin-1").translate(signs)
        return np.asarray([t.id for t in model.tokenize(data)], "<u4").tobytes()

    pieces = _Kept(of_piece, CACHE_WORDS)

    def of_part(part: str) -> bytes:
        if PLAIN.fullmatch(part):
            return b"".join([pieces[x] for x in SPLIT.findall(part.lower())])
        return np.asarray(tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    return _Kept(of_part, CACHE_WORDS)


_words: dict[str, _Kept] = {}


def _ids(path: str, text: str) -> bytes:
    if path not in _words:
        _words[path] = _word_ids(path)
    w = _words[path]
    return b"".join([w[x] for x in text.replace("\n", " ").split(" ") if x])


def tokenised_pieces(docs: DataFrame, tokenizer_path, capacity: int = CAPACITY, end_id: int = 1, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, array<int>, if asked) of every document cut at `capacity` tokens.

    tokenizer_path: a function that gives the vocabulary file's path on the executor. Null text: as empty, which is
    the end id alone. Repeated rows give their pieces again."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path()
        for b in batches:
            out: list[list] = [[] for _ in range(5 + ids)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = _ids(path, text) + end
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    row = (doc, k, a // 4, len(part) // 4, zlib.crc32(part), *[np.frombuffer(part, "<i4")] * ids)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 5 + ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds[:n], strict=True)], names=names[:n])

    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset added: no sequence over `capacity`, each filled without gaps from 0.

    Any columns may stand beside the length, which must be 1 to `capacity`. pieces is read twice and must give the same
    rows both times (a written table). Equal rows are interchangeable and each gets its own place. Empty: no rows."""
    names = pieces.columns
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    spark = pieces.sparkSession
    histogram = dict(pieces.groupBy(F.col(length).alias("k")).count().collect())  # at most `capacity` rows
    runs = sorted(plan({int(k): n for k, n in histogram.items()}, capacity))
    salts = max(16, -(-sum(histogram.values()) // ROWS_A_SALT))
    table = np.asarray(runs or [(0,) * 6], np.int64).T
    shared = spark.sparkContext.broadcast((table[0] << 42) + table[1]), spark.sparkContext.broadcast(table)  # bounded by the capacity
    salted = pieces.withColumn("__salt", F.pmod(hashed, F.lit(salts)))
    counted = salted.groupBy(F.col(length).alias("__k"), "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("__k", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__k", "__salt").orderBy(F.col("__h"))
    ranked = salted.withColumn("__k", F.col(length)).withColumn("__h", hashed).withColumn("__row", F.row_number().over(within) - 1).join(base, ["__k", "__salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(k: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, (size, low, _, first, offset, each) = shared[0].value, shared[1].value
        k, rank = k.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(starts, (k << 42) + rank, side="right") - 1
        r = rank - low[i]
        return pd.DataFrame({"sequence_id": first[i] + r // each[i], "offset": offset[i] + r % each[i] * size[i]})

    placed = ranked.withColumn("__at", place("__k", F.col("__base") + F.col("__row")))
    return placed.select(*[F.col(f"`{c}`") for c in names], F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_documents(docs: DataFrame, tokenizer_path=word_bpe_path, capacity: int = CAPACITY) -> DataFrame:
    """All documents tokenised, cut and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    return pack(materialise(tokenised_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
