"""Bit-sliced search, phrase mining and language-model scores against plain computations, on odd rows and ties."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import bitslice, collocations, queries, scoring

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (None, "the cat"), (3, "The CAT, the é1! cat\x1cdog"), (4, "the cat"), (4, "the cat"), (5, "the " * 30_000 + "end"), (6, " \t\n ..!?"), (7, "a.b;the:cat")]


def frame(spark, rows, more="lang"):
    return spark.createDataFrame([(i, t, None if i == 7 else "en", "x") for i, t in rows], f"doc_id long, text string, {more} string, rank string")


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOW))


# --- search


def ranked(docs, items, k):
    terms = lambda t: words_of(t, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in own if c)
    length = sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for place, (item, text) in enumerate(items):
        found = []
        for i, c in own:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    m = 100 - 50 + (50 * n * n_docs) // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((place, item, rank, i, -s))
    return out


def test_slices_add_as_numbers_do_and_the_best_come_from_the_top():
    rng = np.random.default_rng(1)
    for n, k in ((1, 3), (64, 5), (100, 7), (700, 50)):
        total, sums = np.zeros(n, np.int64), []
        for _ in range(9):
            v = rng.integers(0, 2 ** rng.integers(1, 40), n) * (rng.random(n) < 0.5)
            if not v.any():
                continue
            bits = np.zeros((int(v.max()).bit_length(), -(-n // 64) * 64), np.uint8)
            bits[:, :n] = (v >> np.arange(len(bits))[:, None]) & 1
            bitslice.add(sums, np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
            total += v
        total_now = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(np.int64) << b) for b, s in enumerate(sums))
        assert (total_now == total).all()
        at, values = bitslice.best(sums, k)
        want = sorted((-x, i) for i, x in enumerate(total) if x)[:k]
        assert sorted((-int(x), int(i)) for i, x in zip(at, values)) == want


@pytest.mark.parametrize(("block", "query_bytes"), [(bitslice.BLOCK, bitslice.QUERY_BYTES), (3, 20)])
def test_search_ranks_odd_rows_and_ties_as_plain_scores_do(spark, monkeypatch, block, query_bytes):
    monkeypatch.setattr(bitslice.index, "__defaults__", (block, 5 if block == 3 else bitslice.POSTINGS))
    r = random.Random(4)
    docs = ODD + [(i, " ".join(r.choice(["the", "cat", "dog", "é1", "end", "zebra", f"w{i % 9}"]) for _ in range(r.randint(1, 12)))) for i in range(10, 90)]
    items = [(1, "the CAT the"), (2, None), (3, "...?"), (1, "zebra w3"), (4, "é1-dog"), (5, "nowhere")]
    got = bitslice.top_documents(frame(spark, docs).repartition(3), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string"), 7, query_bytes).collect()
    want = ranked(docs, items, 7)
    key = lambda x: (x[0], x[1], x[2] is None, x[2] or 0, x[3])
    assert sorted(((x.item_id, x.rank, x.doc_id, x.score) for x in got), key=key) == sorted((x[1:] for x in want), key=key)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bitslice.top_documents(none, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert bitslice.top_documents(frame(spark, ODD), spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- collocations


def mined(docs, least, longest, percent, k):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in kept.items():
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items())
            if not inside:
                score, _, x, y = min(((1000 * a * n[lang]) // (counts[p[:c]] * counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), x, y))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("crowded", [False, True])
def test_phrases_as_plain_counting_finds_them(spark, monkeypatch, crowded):
    if crowded:  # a table so small that nearly every bit is set: more is counted, and the same found
        monkeypatch.setattr(collocations, "SPARSE", 0)
        monkeypatch.setattr(collocations, "PART", 4)
        monkeypatch.setattr(collocations, "GATHERED", 50)
    r = random.Random(7)
    vocabulary = ["New", "york", "city", "été", "in", "the", "of", "a,", "x.", "b"]
    rows = [(r.choice(["en", "fr", None]), " ".join(r.choices(vocabulary, [9, 9, 7, 3, 5, 5, 4, 2, 1, 1])[0] if r.random() < 0.5 else "new york city hall" for _ in range(r.randint(0, 30)))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("und", "in the\tin the\nin the"), ("en", "one  two \x0bone two")] + [("de", "gleich gleich gleich")] * 5
    docs = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, g int").repartition(4)
    for least, longest, percent, k in ((3, 5, 100, 2000), (2, 3, 60, 4)):
        got = sorted(tuple(x) for x in collocations.collocations(docs, least, longest, percent, k).collect())
        assert got == mined(rows, least, longest, percent, k)
    assert collocations.collocations(docs.where("lang = 'none'"), 2).count() == 0


def test_cuts_of_equal_score_take_the_shortest_first_part_and_counts_may_pass_64_bits(spark):
    level = [("x", "a", ["a"], 10**9), ("x", "b", ["b"], 10**9), ("x", "a b", ["a", "b"], 10**9), ("x", "b a", ["b", "a"], 10**9), ("x", "a b a", ["a", "b", "a"], 10**9 - 1)]
    levels, totals = spark.createDataFrame(level, "lang string, phrase string, words array<string>, f long"), spark.createDataFrame([("x", 10**15)], "lang string, n long")
    got = {r.phrase: r for r in collocations.best_cuts(levels, totals).collect()}
    assert got["a b"].score == 1000 * 10**9 * 10**15 // 10**18 and got["a b a"].l == 10**9 and got["a b a"].score == 1000 * (10**9 - 1) * 10**15 // 10**18
    assert {r.phrase for r in collocations.uncovered(collocations.best_cuts(levels, totals)).collect()} == {"a b", "b a", "a b a"}


# --- scores


def modelled(docs, strengths):
    """(held_out, n_tokens, n_known, N, base, score) of each row, by counting everything."""
    order = len(strengths) + 1
    counts, texts = [collections.Counter() for _ in range(order + 1)], []
    for i, t in docs:
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        w = ["<s>", *words_of(t), "</s>"]
        texts.append((held, w))
        for o in range(1, order + 1) if not held else ():
            for j in range(o - 1, len(w)):
                counts[o][tuple(w[j - o + 1 : j + 1])] += 1
    words = {k: c for k, c in counts[1].items() if k != ("<s>",)}
    n, v = sum(words.values()), len(words)

    def p(history, w):
        if not history:
            return (counts[1][(w,)] + 1) / (n + v + 1)
        k = strengths[len(history) - 1]
        return (counts[len(history) + 1][(*history, w)] + k * p(history[1:], w)) / (counts[len(history)][history] + k)

    out = []
    for held, w in texts:
        base = sum(math.log10(p((), x)) for x in w[1:])
        out.append((held, len(w) - 1, sum((x,) in words for x in w[1:]), n, base, sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w)))))
    return out, p, words


@pytest.mark.parametrize("strengths", [(), (5.0,), (1000.0, 20.0), (9.0, 3.0, 1.0)])
def test_scores_are_those_of_the_whole_model(spark, monkeypatch, strengths):
    monkeypatch.setattr(scoring, "SEGMENT", 13)
    r = random.Random(2)
    docs = ODD + [(i, " ".join(r.choice(["the", "cat", "Dog", "sat", "on", f"rare{r.randint(0, 40)}"]) for _ in range(r.randint(0, 60)))) for i in range(10, 120)]
    want, _, _ = modelled(docs, strengths)
    order = lambda x: (x[:3], round(x[4], 6), round(x[5], 6))
    want = sorted(want, key=order)
    for block_bytes in (scoring.BLOCK_BYTES, 500):
        got = sorted((tuple(x)[1:] for x in scoring.score(frame(spark, docs).repartition(5), strengths, block_bytes).collect()), key=order)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = scoring.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert alone.held_out and alone.train_tokens == 0 and alone.n_known == 0 and alone.score == alone.base_score == 0.0  # one kind of unknown token, and nothing else


def test_the_models_probabilities_sum_to_one():
    docs = [(i, " ".join(random.Random(i).choices("abcd", k=8))) for i in range(30)]
    _, p, words = modelled(docs, (3.0, 2.0))
    for history in ((), ("a",), ("a", "b"), ("zz", "a"), ("zz", "yy")):
        assert sum(p(history, w) for (w,) in words) + p(history, "unseen") == pytest.approx(1)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 2**56, n).astype(np.uint64))
        assert (scoring.unpack_sorted(scoring.pack_sorted(x)) == x).all() and (scoring.unpack(scoring.pack(x)) == x).all()


def test_queries_on_their_tables(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql = queries.oracle_sql()
    for name in ("op11_search", "op12_collocations"):
        got = queries.queries()[name](spark, DATA)
        want = con.sql(sql[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    scored = queries.queries()["op13_scoring"](spark, DATA).collect()
    held = [x for x in scored if x.held_out]
    assert len(scored) == 200 and sum(x.score for x in held) > sum(x.base_score for x in held)


# --- what was weak


def test_copies_of_one_row_cost_and_lose_the_same(spark):
    from tidemark.llm import substrings

    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").crossJoin(spark.range(500)).drop("id").unionAll(spark.createDataFrame([(2, "alone " * 34)], "doc_id long, text string"))
    got = substrings.remove_repeats(rows).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 300, 300, 500), (2, 34, 0, 1)]


def test_first_names_keep_their_gender_at_all_draws_and_own_columns_of_added_names_are_replaced(spark):
    from tidemark.llm import pii

    letters = "abcdefghijklmnopqrst"
    names = [(g, f"{a.upper()}{b}{c}o") for g in "mf" for a in letters[:4] for b in letters[:5] for c in letters[:3]]
    rows = [(i, f"{'Mr.' if g == 'm' else 'Mrs.'} {n} Smith came", 7, 8) for i, (g, n) in enumerate(names)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, n_pii long, `a.b` long"), b"k").collect()}
    assert {r.n_pii for r in got.values()} == {1} and {r["a.b"] for r in got.values()} == {8}
    first = {g: [got[i].text.split()[1].lower() for i, (h, _) in enumerate(names) if h == g] for g in "mf"}
    assert len(set(first["m"])) == len(set(first["f"])) == 60 and not set(first["m"]) & set(first["f"])
    for g in "mf":
        ends = tuple(pii.ENDINGS[g, "latin"]) + tuple(x.lower() for x in pii.FIRST[g, "latin"])
        assert all(x.endswith(ends) for x in first[g])
    assert not any(a.endswith(b) for a in pii.ENDINGS["m", "latin"] for b in pii.ENDINGS["f", "latin"])


def test_the_quality_stage_carries_columns_of_any_name(spark):
    import corpus_pipeline
    from tidemark.llm import quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    from pyspark.sql import functions as F

    odd = docs.withColumns({"keep": F.lit("own"), "expected_grade": F.lit(1), "a.b": F.lit(2)})
    scored = quality.score(odd, model)
    assert scored.columns.count("keep") == 1 and dict(scored.dtypes)["keep"] == "boolean"
    stage = corpus_pipeline.keep_quality(spark, odd, DATA)
    assert stage.columns == odd.columns and {r.keep for r in stage.collect()} <= {"own"} and stage.count() == scored.where("keep").count()
    assert quality.kept(odd.limit(0), model).count() == 0


def test_gathered_phrases_are_counted_in_little_memory():
    import tracemalloc

    half = collocations.GATHERED // 2
    part = np.arange(half, dtype=np.uint64) // np.uint64(2), np.full(half, 7, np.uint64)
    tracemalloc.start()
    counts = collocations._counted([part, part]).column("f").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(counts) == {4} and len(counts) == half // 2 and peak < 128 << 20
