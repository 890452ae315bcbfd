"""Secret scans with corpus-wide ownership frequency, in SQL functions alone.

Candidates are found by three base patterns. Their values' hashes are counted over the corpus by distinct owners and
repositories: a value that many owners or very many repositories have is an example that was copied around, one that few
have and that looks like a credential counts as live. Spans of both kinds are added to the base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import bound, materialise, row_key

# The base patterns, by kind in the order of listing, with the least length of what they must hold.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]+", 16),
}
#: Longer forms of the patterns: where one is absent, so is its kind.
NEEDED = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}
KINDS = ["assign", "access", "hex", "example", "live"]
#: A value that at least so many owners, or so many repositories whosever they are, have is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 100


def _found(kind: str) -> Column:
    """Matches of a base kind in the column `text`: array<struct<start, k, end, value_start, value>>, code points, end exclusive."""
    pattern, least = PATTERNS[kind]
    k = KINDS.index(kind)
    # A maximal run is found as well by its longest form; only an assignment that is too short uses up its text.
    regex = pattern if kind == "assign" else pattern[:-1] + "{%d,}" % (least - 4 * (kind == "access"))
    text, group = F.col("text"), 2 if kind == "assign" else 0
    empty = F.expr("CAST(array() AS array<struct<start:bigint,k:int,end:bigint,value_start:bigint,value:string>>)")
    seen = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"), F.split(text, regex, -1).alias("parts"), F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("values"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x)

    def placed(s: Column) -> Column:
        """The hits' places by sums over blocks of their lengths, so that a text of very many hits costs little more than its length."""
        sizes = F.transform(s["hits"], lambda h, i: (F.length(F.get(s["parts"], i)) + F.length(h)).cast("long"))
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s["hits"]).cast("double"))).cast("int"))
        blocks = F.sequence(F.lit(0), (F.size(s["hits"]) / block).cast("int"))
        return bound(F.struct(s["parts"].alias("parts"), s["hits"].alias("hits"), s["values"].alias("values"), sizes.alias("sizes"), block.alias("block"), blocks.alias("blocks")), summed)

    def summed(s: Column) -> Column:
        sums = F.transform(s["blocks"], lambda j: total(F.slice(s["sizes"], j * s["block"] + 1, s["block"])))
        return bound(sums, lambda b: bound(F.transform(s["blocks"], lambda j: total(F.slice(b, F.lit(1), j))), lambda before: F.transform(s["values"], lambda v, i: at(s, before, v, i))))

    def at(s: Column, before: Column, v: Column, i: Column) -> Column:
        block = (i / s["block"]).cast("int")
        end = F.get(before, block) + total(F.slice(s["sizes"], block * s["block"] + 1, i % s["block"] + 1))
        return F.struct((end - F.length(F.get(s["hits"], i))).alias("start"), F.lit(k).alias("k"), end.alias("end"), (end - F.length(v)).alias("value_start"), v.alias("value"))

    return F.when(text.rlike(NEEDED[kind]), F.filter(bound(seen, placed), lambda s: F.length(s["value"]) >= least)).otherwise(empty)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(names, s["k"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def live_looking(value: Column) -> Column:
    """Letters and digits mixed, eight different characters or more, and none of the words that mark placeholders."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("(?i)example|changeme|placeholder|dummy|xxxx")


def candidates(docs: DataFrame, owner: str = "source", repository: str | None = None) -> DataFrame:
    """Each row's key, owner, repository and base candidates (`found`). Null text: as empty; null owner: an owner of its own.

    Without a repository column a repository is a distinct text, so that whole copies of one count once."""
    text = docs.select("doc_id", *row_key(), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), (F.coalesce(F.col(repository).cast("string"), F.lit("")) if repository else row_key()[1].cast("string")).alias("repository"), F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", "rk_id", "rk_text", "owner", "repository", F.concat(*[_found(k) for k in PATTERNS]).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, owners, repositories of every candidate value, over all rows."""
    each = found.select("owner", "repository", F.explode("found.value").alias("value")).select("owner", "repository", F.sha2("value", 256).alias("value_hash"))
    owners = each.select("value_hash", "owner").distinct().groupBy("value_hash").agg(F.count("*").alias("owners"))
    return owners.join(each.select("value_hash", "repository").distinct().groupBy("value_hash").agg(F.count("*").alias("repositories")), "value_hash")


def scan(docs: DataFrame, owner: str = "source", repository: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, rk_id, rk_text, base and spans (both array<struct<start, k, end>>, k an index of KINDS) of every row of docs.

    base: the three base kinds, leftmost and non-overlapping for each kind. spans: base, and the value of each candidate
    as `example` (at least `example_owners` owners or `example_repositories` repositories have it) or `live` (fewer do and
    it looks like a credential). A value found by two kinds at one place is added
    once. Repeated rows have the same spans each; no candidates: no spans; an empty table: no rows. Other columns are ignored."""
    found = materialise(candidates(docs, owner, repository), "secrets")
    some = found.where(F.size("found") > 0)
    each = some.select("rk_id", "rk_text", F.explode("found").alias("c")).select("rk_id", "rk_text", "c", F.sha2("c.value", 256).alias("value_hash"))
    kind = F.when((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories), F.lit(KINDS.index("example"))).when(live_looking(F.col("c.value")), F.lit(KINDS.index("live")))
    judged = each.join(ownership(some), "value_hash").withColumn("kind", kind).where("kind IS NOT NULL")
    added = judged.groupBy("rk_id", "rk_text").agg(F.collect_set(F.struct(F.col("c.value_start").alias("start"), F.col("kind").alias("k"), F.col("c.end").alias("end"))).alias("added"))
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    none = F.expr("CAST(array() AS array<struct<start:bigint,k:int,end:bigint>>)")
    a, b = found.alias("a"), added.alias("b")
    both = a.join(b, F.expr("a.rk_id <=> b.rk_id AND a.rk_text = b.rk_text"), "left")
    return both.select("a.doc_id", "a.rk_id", "a.rk_text", base.alias("base"), F.concat(base, F.coalesce("added", none)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, mask: str = "[secret]", **how) -> DataFrame:
    """docs with every live span of the text replaced by `mask` and n_chars (if there) set anew; all other columns as they are."""
    live = scan(docs, **how).select("rk_id", "rk_text", F.array_sort(F.filter("spans", lambda s: s["k"] == KINDS.index("live"))).alias("live")).where(F.size("live") > 0).distinct()
    names = [(c, f"__{i}") for i, c in enumerate(docs.columns)]  # docs may have columns of any name
    text = dict(names)["text"]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names], *[k.alias(f"__{n}") for k, n in zip(row_key(), ("id", "hash"), strict=True)])
    both = rows.join(live, F.expr("__id <=> rk_id AND __hash = rk_text"), "left")
    start = F.expr("CAST(named_struct('at', 0L, 'cuts', array()) AS struct<at:bigint,cuts:array<struct<start:bigint,end:bigint>>>)")

    def step(acc: Column, s: Column) -> Column:  # spans that begin inside the last one lengthen nothing: what they hold beyond it is cut as well
        cut = F.struct(F.greatest(s["start"], acc["at"]).alias("start"), s["end"].alias("end"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], F.array_append(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"))

    cuts = F.aggregate("live", start, step, lambda acc: acc["cuts"])
    before = lambda c, i: F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
    take = lambda signs, a, b: F.array_join(F.slice(signs, (a + 1).cast("int"), F.greatest(F.lit(0), (b - a).cast("int"))), "")
    rest = lambda signs, c: take(signs, F.element_at(c, -1)["end"], F.size(signs))
    mark = lambda c, s, i: F.when((i > 0) & (s["start"] == before(c, i)), F.lit("")).otherwise(F.lit(mask))
    pieces = lambda signs, c: F.concat(F.array_join(F.transform(c, lambda s, i: F.concat(take(signs, before(c, i), s["start"]), mark(c, s, i))), ""), rest(signs, c))
    done = bound(F.split(text, ""), lambda signs: bound(cuts, lambda c: pieces(signs, c)))
    hit = F.col("live").isNotNull()
    out = both.withColumn(text, F.when(hit, done).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n = dict(names)["n_chars"]
        out = out.withColumn(n, F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*[F.col(n).alias(c) for c, n in names])
