"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bitslice, chat, collocations, decontam, gif, packing, pii, quality, scoring, secrets, simhash, substrings, urls


#: The key of op7's query. It is public, so that the query's result is the same everywhere; a real run takes a secret of its own.
QUERY_KEY = b"surrogates of the query"
#: Schemas of the tools that op6's query knows.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "method": {"enum": ["GET", "HEAD"]}}, "required": ["url"]},
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "expected_grade", "tail_probability", "keep")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    hits = decontam.search(docs, _read(spark, sf_dir, "benchmark"))
    return hits.select(F.col("rk_id").alias("doc_id"), "item_id", "cosine", "in_sequence", "answered")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(_read(spark, sf_dir, "conversations"), TOOLS)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, sf_dir, "documents"), QUERY_KEY).select("doc_id", "text", "n_pii")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents")))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gif.media(_read(spark, sf_dir, "documents"), with_bytes=False)
    feature = F.concat_ws(";", F.col("n_frames").cast("string"), F.col("delay_cs").cast("string"), F.array_join("histogram", ","))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    ops = (op1_packing, op2_quality, op3_urls, op4_substrings, op5_decontamination, op6_chat, op7_surrogates, op8_secrets, op9_gif, op10_simhash, op11_search, op12_collocations, op13_scoring)
    return {f.__name__: f for f in ops}


OP4_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
each AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM each),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, list(DISTINCT i) AS s FROM windows SEMI JOIN twice USING (h) GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(s, lambda i: range(i, i + 35)))) AS g FROM starts),
kept AS (SELECT doc_id, len(w) AS n, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(g, k)) END AS k FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

OP6_SQL = """
SELECT conv_id, turn, role, turn AS after_turn, 0::INTEGER AS level, 0::BIGINT AS n_calls, 0::BIGINT AS n_answered, 0::BIGINT AS n_valid,
       'plain' AS status, '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
FROM conversations
"""

OP11_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sized AS (SELECT doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
stats AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sized),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
each AS (SELECT doc_id, unnest(w) AS t FROM words),
tf AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM each WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), stats),
impact AS (SELECT tf.doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))) AS x FROM tf JOIN weight USING (t) JOIN sized USING (doc_id), stats),
scored AS (SELECT item_id, doc_id, sum(x)::BIGINT AS score FROM asked JOIN impact USING (t) GROUP BY item_id, doc_id HAVING sum(x) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*)::BIGINT AS f FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS k FROM f WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.w, a, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f), c.k) AS place
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored WHERE place = 1),
sized AS (SELECT lang, w, a, unnest(range(2, len(w))) AS j FROM best WHERE len(w) > 2),
placed AS (SELECT lang, w, a, j, unnest(range(1, len(w) - j + 2)) AS i FROM sized),
inner_ AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer FROM placed GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that DuckDB can express; op6's holds for tables without tool calls, as the synthetic one is."""
    return {"op4_substrings": OP4_SQL, "op6_chat": OP6_SQL, "op11_search": OP11_SQL, "op12_collocations": OP12_SQL}
