"""Near-duplicate removal: texts connected by a Jaccard similarity of 0.8 or more of their five-word shingles.

First SimHash: each group of fingerprints linked by the byte-position index gives candidates, its members with its
first. What fingerprints miss comes from an inverted index of shingles with count filtering. If the distinct shingles of
all texts are put in one order, similar texts share at least l of the first n - ceil(0.8 n) + l of each, whatever was
edited, added or cut. A first index counts the shingles of least hash alone, with l a quarter of n, and tells which texts
can have a partner. A second one holds all shingles of those, rarest first. No pair is lost. What meets in a list is
compared exactly if the bounds allow the similarity: by the sizes, the places in the lists, the shingles that no other
text has, and what is known of both from a comparison with the same third text.

A long list isn't paired at once. First every text is compared with one other alone, of those that lead its lists the one
whose shingles are most common: copies of a text meet it there. Copies that aren't similar to it can be similar to one another
only if they share shingles that it hasn't, and are paired only where they meet in one of these. Then, in each turn, the first members of a list are
compared with all others of it and leave it; members that are connected by then need no more comparison, and a list whose
members are all connected is done. A turn takes sixteen times as many members as the last, so the turns grow with the
logarithm of the longest list and end when no pair is left: the groups are those of all similar pairs, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm._common import chunks_of, hash_words, materialise, window_hashes
from tidemark.llm._graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: Lists with up to this number of open pairs a member give all of them at once.
LONGEST = 16
#: Members of a longer list compared with the others: one in the first turn, then so many times as many as in the last.
GROWTH = 16
#: Counted shingles in a partition, on average.
SHARE = 2_000_000


def shingles(text: bytes, k: int = SHINGLE) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def shingle_hashes(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """64-bit hashes of each text's distinct shingles. A text without words has one, its own."""
    out = []
    for first, last in chunks_of(texts):
        words, counts, *_ = hash_words(texts[first:last], lower=True)
        for own in np.split(words, np.cumsum(counts)[:-1]):
            out.append(np.unique(window_hashes(own, min(k, len(own)))) if len(own) else np.zeros(1, np.uint64))
    return out


def least_shared(n, whole: bool):
    """l, for a text of n distinct shingles or an array of such: all that similar texts share, or a quarter."""
    return _shortest(n) if whole else np.maximum(1, n // 4)


def _shortest(n):
    """The fewest distinct shingles of a text that can be similar to one of n."""
    return np.ceil(SIMILARITY * n - 1e-9).astype(np.int64)


def counted(n, whole: bool):
    """e, the number of shingles of least hash that are counted."""
    return n - _shortest(n) + least_shared(n, whole)


def _sizes(rows: DataFrame, whole: bool) -> DataFrame:
    """(nid, n, e, m) of rows(nid, text): distinct shingles, those counted, and the least that similar texts share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([len(x) for x in shingle_hashes(b.column(1).to_pylist())], np.int64)
            columns = [n, counted(n, whole), least_shared(n if whole else _shortest(n), whole)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["nid", "n", "e", "m"])

    return rows.select("nid", F.col("text").cast("binary")).mapInArrow(run, "nid long, n long, e long, m long")


def _tokens(rows: DataFrame, whole: bool) -> DataFrame:
    """(token, nid) of rows(nid, text): the counted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                sets = shingle_hashes(part.column(1).to_pylist())  # each in order of the hash
                sets = [x[: int(counted(np.int64(len(x)), whole))] for x in sets]
                nids = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(nids)], names=["token", "nid"])

    return rows.select("nid", F.col("text").cast("binary")).mapInArrow(run, "token long, nid long")


def _shared(tokens: DataFrame, parts: int) -> DataFrame:
    """(token, nid, df) of the tokens that more than one text has; df counts the texts. A token of very many texts takes disk, not memory."""
    texts = F.count("*").over(Window.partitionBy("token"))
    return tokens.repartition(parts, "token").withColumn("df", texts).where("df > 1")


def shingle_postings(rows: DataFrame, whole: bool) -> DataFrame:
    """The index of rows(nid, text): (token, nid, n, e, own, rarity, pos), of all shingles or of those of least hash.

    pos is the token's place among the e counted, rarest first; own counts those that no other text has. rarity is the mean
    of 1 / (texts that have the shingle): the text that others were made from has the least of them."""
    sizes = materialise(_sizes(rows, whole), "sizes")
    total = sizes.agg(F.sum("e")).first()[0] or 0
    parts = total // SHARE + sizes.sparkSession.sparkContext.defaultParallelism
    of = _shared(_tokens(rows, whole), parts).groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    placed = of.join(sizes, "nid").withColumn("own", F.expr("e - size(shared)")).withColumn("rarity", F.expr("aggregate(shared, double(e - size(shared)), (a, x) -> a + 1D / x.df) / e"))
    first = placed.withColumn("take", F.expr("int(e - m + 1 - own)")).where("take > 0")
    posts = first.select("nid", "n", "e", "own", "rarity", F.expr("posexplode(slice(shared, 1, take)) AS (i, one)"))
    return materialise(posts.select("one.token", "nid", "n", "e", "own", "rarity", F.expr("own + i AS pos")), "posts")


def listed(posts: DataFrame) -> DataFrame:
    """The postings of tokens that more than one text posts."""
    return posts.join(posts.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token"), "token")


def may_be_similar(a: str, b: str, star: bool = False) -> str:
    """SQL: two postings of a token (in the index of all shingles) allow the similarity.

    What the texts can share is bounded by what others have of either, and by the token's places before and after it. With
    `star`, also by what they showed against the same text: each lacks `lacks` of its `of` shingles and has `more` that
    aren't in it but in others, so they share at most of - greatest(lacks) + least(more). `rest` of those aren't posted. Where
    they meet in a shingle of that text, no more than both their rests count: two texts that share another meet in it."""
    most = f"least({a}.n - {a}.own, {b}.n - {b}.own, least({a}.pos, {b}.pos) + least({a}.n - {a}.pos, {b}.n - {b}.pos))"
    need = f"9 * {{}} >= 4 * ({a}.n + {b}.n)"
    seen = f" AND ({a}.hub IS NULL OR {b}.hub IS NULL OR {a}.hub != {b}.hub OR " + need.format(f"({a}.of - greatest({a}.lacks, {b}.lacks) + least({a}.more, {b}.more, IF({a}.inside, {a}.rest + {b}.rest, {a}.more)))") + ")"
    return need.format(most) + seen * star


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, na, nb, both) of pairs(a, b) of text ids: the distinct shingles of either text(nid, text), and those shared."""
    first = texts.select(F.col("nid").alias("a"), F.col("text").alias("ta"))
    both = pairs.join(texts.select(F.col("nid").alias("b"), F.col("text").alias("tb")), "b").join(first, "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            found = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, own = a, shingles(ta)
                other = shingles(tb)
                found.append((len(own), len(other), len(own & other)))
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["a", "b", "na", "nb", "both"])

    return materialise(both.mapInArrow(run, "a long, b long, na long, nb long, both long"), "compared")


#: SQL: a compared pair is similar, in whole numbers.
SIMILAR = "both * 5 >= (na + nb - both) * 4"


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """pairs(a, b) to compare: each text with the first of its SimHash component, over shingles of five words."""
    linked = simhash.simhash_components(rows.select(F.col("nid").alias("doc_id"), "text"), SHINGLE)
    return linked.where("component_id != doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))


def _by_leader(lists: DataFrame) -> DataFrame:
    """pairs(a, b) to compare: each text with one other, of those that lead its lists the one of the least rarity.

    Also where the two can't be similar: what both of two texts lack of a third bounds what they share."""
    rank = F.struct("rarity", "nid", "n", "own", "pos")
    leaders = lists.groupBy("token").agg(F.min(rank).alias("l"))
    met = lists.alias("x").join(leaders.select("token", "l.*").alias("y"), "token").where("x.nid != y.nid")
    best = met.groupBy(F.col("x.nid").alias("b")).agg(F.min(F.struct("y.rarity", "y.nid")).alias("l"))
    return best.select(F.col("l.nid").alias("a"), "b")


def _against_hubs(posts: DataFrame, hubs: DataFrame, texts: DataFrame) -> DataFrame:
    """The postings with what their texts showed against the one that led them, null for the others: of, lacks, more, rest, and
    inside, whether the token is a shingle of that text. rest counts the shared shingles outside of it that the text doesn't post: two texts that
    share such a one both post it, and meet there, or it is in the rest of either."""
    led = posts.join(hubs, "nid", "left").withColumn("more", F.expr("added - own")).drop("added", "e")
    ahead = _tokens(texts.join(hubs.select(F.col("hub").alias("nid")).distinct(), "nid").select("nid", "text"), whole=True)
    marked = led.join(ahead.select("token", F.col("nid").alias("hub"), F.lit(True).alias("inside")), ["token", "hub"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return marked.withColumn("rest", F.col("more") - F.count_if(~F.col("inside")).over(Window.partitionBy("nid")))


def similar_groups(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(node, root) of the texts of rows(nid, text) that are connected by similar pairs, but the roots."""
    pairs = materialise(_by_fingerprint(rows), "pairs")
    some = listed(shingle_postings(rows, whole=False)).select("nid").distinct().unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct()
    texts = materialise(rows.join(some, "nid").select("nid", F.col("text").cast("binary").alias("text")), "texts")
    posts = shingle_postings(texts, whole=True)
    lists = materialise(listed(posts), "lists")
    compared = _compared(pairs, texts)
    led = materialise(_by_leader(lists), "pairs")
    checked = compared.unionAll(_compared(led.join(pairs, ["a", "b"], "left_anti"), texts))
    edges = checked.where(SIMILAR).select(F.col("a").alias("u"), F.col("b").alias("v"))
    stars, done, heads = components(edges), checked.select("a", "b"), 1
    hubs = checked.join(led, ["a", "b"], "left_semi").select(F.col("b").alias("nid"), F.col("a").alias("hub"), F.col("na").alias("of"), (F.col("na") - F.col("both")).alias("lacks"), (F.col("nb") - F.col("both")).alias("added"))
    left = materialise(listed(_against_hubs(posts, hubs, texts)), "lists")
    names = left.columns
    while True:
        rooted = left.join(stars.withColumnRenamed("node", "nid"), "nid", "left").select(*names, F.coalesce("root", "nid").alias("root"))
        by_root = rooted.groupBy("token", "root").agg(F.count("*").alias("c"))
        open_ = by_root.groupBy("token").agg(F.sum("c").alias("members"), F.sum(F.expr("c * c")).alias("within"), F.count("*").alias("roots")).where("roots > 1")
        taken = F.expr(f"CASE WHEN (members * members - within) / 2 <= {longest} * members THEN members ELSE {heads} END")
        place = F.row_number().over(Window.partitionBy("token").orderBy("rarity", "nid"))
        live = materialise(rooted.join(open_.select("token", taken.alias("heads")), "token").withColumn("place", place), "live")
        if live.isEmpty():
            return stars
        a, b = live.where("place <= heads").alias("a"), live.alias("b")
        met = a.join(b, F.expr(f"a.token = b.token AND a.place < b.place AND a.root != b.root AND {may_be_similar('a', 'b', star=True)}"))
        pairs = met.select(F.col("a.nid").alias("a"), F.col("b.nid").alias("b")).distinct().join(done, ["a", "b"], "left_anti").join(done.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        compared = _compared(materialise(pairs, "pairs"), texts)
        similar = compared.where(SIMILAR).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not similar.isEmpty():
            stars = components(similar.unionAll(stars.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        done = done.unionAll(compared.select("a", "b"))
        left = materialise(live.where("place > heads").select(*names), "lists")
        heads *= GROWTH


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs without exact and near copies, with their columns: of texts connected by similar pairs the row of the smallest doc_id stays.

    Two texts are similar at 0.8 or more of the distinct five-word shingles (A-Z lower-cased); equal texts are one, and
    the same row again goes. Texts shorter than five words have one shingle; null and blank texts are all alike. Ties of
    ids are broken by the text's hash, null ids come first."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.md5("text"))
    low = rows.groupBy("hash").agg(F.min(F.struct("doc_id")).alias("low")).select("hash", "low.doc_id", F.xxhash64("hash").alias("nid"))
    nodes = materialise(low, "nodes")
    once = rows.join(nodes.select("hash", "nid", F.col("doc_id").alias("low")), "hash").where("doc_id <=> low").dropDuplicates(["hash"]).select("nid", "text")
    stars = similar_groups(materialise(once, "once"))
    groups = stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
    members = nodes.join(groups.withColumnRenamed("node", "nid"), "nid")
    heads = members.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("head"))
    stay = nodes.join(members.join(heads, "root").where("hash != head.hash").select("hash"), "hash", "left_anti")
    kept = stay.select(F.col("hash").alias("__hash"), F.col("doc_id").alias("__low"))
    marked = docs.withColumn("__of", F.md5(F.coalesce("text", F.lit(""))))
    one = marked.join(kept, F.expr("__of = __hash AND doc_id <=> __low")).dropDuplicates(["__of"])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])
