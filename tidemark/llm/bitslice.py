"""Ranked lexical search over a bit-sliced impact index.

The index is cut into blocks of documents. In each, a term has one bitmap for every bit of its impacts: bit j of slice b is
bit b of what the term adds to the score of the block's document j. A query adds its terms' slices with the carry rule of
binary addition, all documents of a block at once, and then goes down the sums' slices from the most significant one,
keeping those documents that can still be among the k best. Only these have their scores put together.

The texts are read once, for the counts of the terms asked for; collection statistics, index and search read those counts.
A block is one row, built and searched where its documents lie, so nothing but each block's k best is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import chunks_of, hash_words, materialise

#: Documents and postings of a block at most; a document of more postings has a block of its own.
BLOCK, POSTINGS = 1 << 14, 1 << 22
#: Bytes of queries that are searched in one pass over the texts; more are searched in several.
QUERY_BYTES = 1 << 25
#: Fixed values of the weights: ids and impacts are whole numbers.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 20, 50

#: Bytes that end a term: all of ASCII but letters and digits.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms_of(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct terms of each text, as hashes: runs of letters, digits and signs beyond ASCII, A-Z lower-cased."""
    h, counts, *_ = hash_words(texts, lower=True, white=_BETWEEN)
    return [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])] if len(texts) else []


def count_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (all terms, with repeats), terms (places in the sorted vocabulary of hashes) and tfs of every row. Null text: none."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            for first, last in chunks_of(texts):
                h, counts, *_ = hash_words(texts[first:last], lower=True, white=_BETWEEN)
                at = np.searchsorted(asked, h)
                at[at == len(asked)] = 0
                hit = asked[at] == h if len(asked) else np.zeros(len(h), bool)
                key, tf = np.unique(np.repeat(np.arange(last - first), counts)[hit] * max(1, len(asked)) + at[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(last - first + 1) * max(1, len(asked))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % max(1, len(asked)), tf)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(counts, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and each vocabulary term's weight: floor(1000 ln((2N + 2) / (2df + 1)))."""
    s = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    df = np.zeros(n_terms, np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r[0]] = r[1]
    return s.docs, s.length or 0, np.array([math.floor(1000 * math.log((2 * s.docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _slices(at: np.ndarray, values: np.ndarray, n: int) -> bytes:
    """The bitmaps, least significant first, of values at the places `at` of n, packed and compressed."""
    width = int(values.max()).bit_length()
    bits = np.zeros((width, -(-n // 64) * 64), np.uint8)
    bits[:, at] = (values >> np.arange(width)[:, None]) & 1
    return pa.compress(np.packbits(bits, axis=1, bitorder="little"), codec="zstd", asbytes=True)


def index(counted: DataFrame, stats: tuple[int, int, np.ndarray], block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """doc_ids, terms, widths, slices: a row a block, its documents by ascending id (null last), its terms with their bitmaps.

    A term adds w * ((SCALE * tf) div (1000 * tf + SATURATION * m)), m = 100 - 50 + (50 * n * N) div L, to a document's score."""
    held = counted.sparkSession.sparkContext.broadcast(stats)

    def built(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        n_docs, length, w = held.value
        t = pa.Table.from_batches(parts).combine_chunks().sort_by([("doc_id", "ascending")])
        n = t["n"].to_numpy()
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // max(1, length)
        terms, tf, sizes = (t[c].combine_chunks() for c in ("terms", "tfs", "tfs"))
        sizes = sizes.value_lengths().to_numpy()
        terms, tf = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(n)), sizes)
        value = w[terms] * ((SCALE * tf) // (1000 * tf + SATURATION * m[doc]))
        order = np.argsort(terms, kind="stable")
        order = order[value[order] > 0]
        edges = np.flatnonzero(np.diff(terms[order], prepend=-1))
        groups = np.split(order, edges[1:]) if len(edges) else []
        made = [(int(terms[g[0]]), int(value[g].max()).bit_length(), _slices(doc[g], value[g], len(n))) for g in groups]
        cols = [[t["doc_id"].to_pylist()], *[[[x[k] for x in made]] for k in range(3)]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_ids", "terms", "widths", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, held_postings = [], 0, 0
        for b in batches:
            ends = np.cumsum(b.column(2).value_lengths().to_numpy()) if b.num_rows else []
            first, before = 0, 0
            while first < b.num_rows:
                last = min(b.num_rows, first + block - rows, max(first + (not parts), int(np.searchsorted(ends, before + postings - held_postings, side="right"))))
                if last > first:
                    parts.append(b.slice(first, last - first))
                    rows, held_postings = rows + last - first, held_postings + int(ends[last - 1]) - before
                    first, before = last, int(ends[last - 1])
                if first < b.num_rows:
                    yield built(parts)
                    parts, rows, held_postings = [], 0, 0
        if parts:
            yield built(parts)

    return counted.mapInArrow(run, "doc_ids array<long>, terms array<int>, widths array<int>, slices array<binary>")


def add(sums: list[np.ndarray], slices: np.ndarray) -> None:
    """Adds the numbers that `slices` holds, least significant bit first, to those of `sums`, in place; sums grow by a slice where one carries out."""
    carry = np.zeros(slices.shape[1], np.uint64)
    for b in range(max(len(slices), len(sums))):
        if b >= len(slices) and not carry.any():
            return
        if b == len(sums):
            sums.append(np.zeros_like(carry))
        have, more = sums[b], slices[b] if b < len(slices) else np.uint64(0)
        half = have ^ more
        sums[b] = half ^ carry
        carry = (have & more) | (half & carry)
    if carry.any():
        sums.append(carry)


def best(sums: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k largest numbers above zero, equal ones by ascending place, unordered; from the top slice down."""
    open_ = reduce(np.bitwise_or, sums)
    sure = np.zeros_like(open_)
    count = lambda x: int(np.bitwise_count(x).sum())
    for s in reversed(sums):
        with_bit = sure | (open_ & s)
        n = count(with_bit)
        if n > k:
            open_ = open_ & s
        else:
            sure, open_ = with_bit, open_ & ~s
    places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    at = places(sure)
    at = np.concatenate([at, places(open_)[: k - len(at)]])  # what is still open is equal
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    return at, sum(((s[word] >> bit) & np.uint64(1)).astype(np.int64) << b for b, s in enumerate(sums))


def search(blocks: DataFrame, queries: list[np.ndarray], k: int) -> DataFrame:
    """query (place in the list), doc_id, score: each block's k best for each query, given as places in the vocabulary."""
    held = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, terms, widths = (b.column(c)[row].values for c in range(3))
                terms, widths, packed = terms.to_numpy(), widths.to_numpy(), b.column(3)[row].values
                words = -(-len(ids) // 64)
                found = []
                for q, asked in enumerate(held.value):
                    sums: list[np.ndarray] = []
                    at = np.searchsorted(terms, asked)
                    for i in at[(at < len(terms)) & (np.take(terms, at, mode="clip") == asked)] if len(terms) else ():
                        raw = pa.decompress(packed[int(i)].as_buffer(), int(widths[i]) * words * 8, codec="zstd")
                        add(sums, np.frombuffer(raw, np.uint64).reshape(-1, words))
                    if sums:
                        places, scores = best(sums, k)
                        found.append((np.full(len(places), q), places, scores))
                if found:
                    q, places, scores = map(np.concatenate, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids.take(pa.array(places)), pa.array(scores)], names=["query", "doc_id", "score"])

    return blocks.mapInArrow(run, "query int, doc_id long, score long")


def _ranked(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    queries = terms_of([(r.text or "").encode() for r in items])
    vocabulary = np.unique(np.concatenate(queries))
    counted = materialise(count_terms(docs, vocabulary), "counts")
    blocks = index(counted, weights(counted, len(vocabulary)))
    found = search(blocks, [np.searchsorted(vocabulary, q) for q in queries], k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "query int, item_id long")
    return top.join(names, "query").select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents(doc_id, text) of highest score above 0 for each row of items(item_id, text).

    Equal scores rank by ascending doc_id, null last. Null or empty texts have no terms, and an item without terms no rows;
    repeated documents each have their place, repeated items each their own ranks; empty tables give no rows; other columns are
    ignored. Terms are told apart by 64 bits of hash. Items are gathered on the driver and sent to the tasks in parts of about
    `query_bytes`, with a pass over the texts for each part; statistics are those of all documents."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // query_bytes) or 1
    own = items.select("item_id", "text").where("text IS NOT NULL")
    made = []
    for p in range(parts):
        part = own if parts == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        if rows := part.collect():
            made.append(_ranked(docs, rows, k))
    return reduce(DataFrame.unionAll, made) if made else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
