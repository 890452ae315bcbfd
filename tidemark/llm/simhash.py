"""SimHash near-dedup: a byte-position inverted index over 64-bit fingerprints with count filtering.

Two fingerprints that differ in at most three bits share at least five of their eight positional bytes, and so at
least three in one half. The index therefore posts each fingerprint under its eight byte triples (three of the four
positions of a half), which is the count filter's guarantee turned into a key: a posting list holds what agrees in 24
bits, where one byte alone would hold a 256th of the corpus. For what meets in a list the shared positional bytes are
tallied, pairs with five or more are kept and their differing bits counted. Each pair is taken from the first list
that both are in, so it is made once.

Lists over `longest` fingerprints aren't paired: their members are linked through the points of the cube around them.
If one fingerprint is within one bit of a point, all fingerprints within two bits of that point are within three of
it, and any two that differ in three bits or fewer have such a point between them. So each member is joined to the
point's smallest near member: the same components, with rows in proportion to the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialise
from tidemark.llm._graph import components

BITS, SHARED = 3, 5
#: Three of the four bytes of either half: of five shared positions, three lie in one of these.
TRIPLES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7)]
#: A list is paired up to this length; beyond, one row for each of the 2,146 points near a member is cheaper.
LONGEST = 2000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: A-Z lower-cased, words at ASCII white space, shingles with their repeats, XXH64.

    A bit is 1 if more than half of the shingles' hashes have it. Fewer words than a shingle: the whole sequence is
    one; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n, votes, digest = len(words) - k + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 16):
        part = words[a : a + (1 << 16) + k - 1]
        joined = part if k == 1 else map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))
        h = np.fromiter((digest(x, seed) for x in joined), "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), text_col: str = "text") -> DataFrame:
    """The columns of docs but the text, and `fps`: an array<long> with a fingerprint for each seed. Null text: as empty."""
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [[fingerprint(t, shingle, s) for s in seeds] for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.list_(pa.int64()))], names=[*keep, "fps"])

    schema = rows.select(*keep, F.array(F.lit(0).cast("long")).alias("fps")).schema
    return rows.mapInArrow(run, schema)


def byte_of(fp: str, p: int) -> str:
    return f"(shiftrightunsigned({fp}, {8 * p}) & 255)"


def shares(x: str, triple: tuple[int, ...]) -> str:
    """Whether the difference x (of two fingerprints) is zero in the bytes of a triple."""
    mask = sum(255 << (8 * p) for p in triple)
    return f"({x} & {mask - (1 << 64) if mask >> 63 else mask}L) = 0"


def postings(fps: DataFrame, fp: str = "fp", also: str = "0") -> DataFrame:
    """The index: the columns of fps and `key`, one row for each byte triple; `also` goes into the key (0 to 2**30)."""
    keys = ", ".join(
        f"((({also}) * 8L + {t}) * 16777216L + {byte_of(fp, a)} * 65536L + {byte_of(fp, b)} * 256L + {byte_of(fp, c)})" for t, (a, b, c) in enumerate(TRIPLES)
    )
    return fps.select("*", F.explode(F.expr(f"array({keys})")).alias("key"))


def pair_condition(a: str, b: str, key: str) -> str:
    """SQL: a and b share five positional bytes, differ in three bits at most, and `key` is their first common list."""
    x = f"({a} ^ {b})"
    tally = " + ".join(f"int({byte_of(x, p)} = 0)" for p in range(8))
    first = "CASE " + " ".join(f"WHEN {shares(x, t)} THEN {i}" for i, t in enumerate(TRIPLES)) + " END"
    return f"({tally}) >= {SHARED} AND bit_count({x}) <= {BITS} AND pmod(shiftright({key}, 24), 8) = ({first})"


def links(fps: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of fingerprints that differ in three bits or fewer.

    fps: distinct fingerprints in the column fp. Lists up to `longest` give every pair; longer ones link through
    the points between, with the same components."""
    index = postings(fps.select("fp"))
    long_lists = index.groupBy("key").count().where(F.col("count") > longest).select("key")
    short = index.join(long_lists, "key", "left_anti")
    pairs = short.alias("a").join(short.alias("b"), F.expr(f"a.key = b.key AND a.fp < b.fp AND {pair_condition('a.fp', 'b.fp', 'a.key')}"))
    dense = index.join(long_lists, "key", "left_semi").select("fp").distinct()
    one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    two = "flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    around = lambda masks: dense.select("fp", F.expr(f"explode(transform(concat(array(0L), {masks}), m -> fp ^ m)) AS point"))
    centre = around(one).groupBy("point").agg(F.min("fp").alias("v"))
    hubs = around(two).join(centre, "point").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).unionAll(hubs)


def simhash_components(docs: DataFrame, shingle: int = 3, seed: int = 42, longest: int = LONGEST) -> DataFrame:
    """doc_id, fp (long) and component_id (the smallest doc_id reachable by links of three bits or fewer) of every row.

    Null or blank texts have fingerprint zero and are linked like any other; repeated rows stay, each with the same
    result; a null doc_id keeps its row and counts for no minimum. Empty input: no rows. Other columns are ignored."""
    rows = materialise(fingerprints(docs.select("doc_id", "text"), shingle, (seed,)).select("doc_id", F.col("fps")[0].alias("fp")), "fp")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    stars = components(links(fps, longest))
    members = stars.select(F.col("node").alias("fp"), "root").unionAll(stars.select(F.col("root").alias("fp"), "root").distinct())
    low = members.join(fps, "fp").groupBy("root").agg(F.min("low").alias("reach"))
    of = fps.join(members.join(low, "root").select("fp", "reach"), "fp", "left").select("fp", F.coalesce("reach", "low").alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")
