import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import chat, decontam, gif, neardup, packing, pii, quality, queries, secrets, simhash, substrings, urls

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (3, "a b"), (None, "x y z"), (4, " ".join(f"w{i}" for i in range(60))), (5, " ".join(f"w{i}" for i in range(60))), (6, "long " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_plan_packs_all_without_gaps():
    for seed in range(60):
        r = random.Random(seed)
        cap = r.choice([10, 30, 4096])
        counts = collections.Counter(r.randint(1, cap if r.random() < 0.5 else max(1, cap // 3)) for _ in range(200))
        bins, seen = collections.defaultdict(list), collections.Counter()
        for k, low, n, first, offset, each in packing.plan(counts, cap):
            assert seen[k] == low
            seen[k] += n
            for j in range(n):
                bins[first + j // each].append((offset + j % each * k, k))
        assert seen == counts
        for b in bins.values():
            at = 0
            for offset, k in sorted(b):
                assert offset == at
                at += k
            assert at <= cap


def test_packing_of_odd_rows(spark, odd):
    from tokenizers import Tokenizer

    rows = packing.packed_documents(odd).collect()
    tokenizer = Tokenizer.from_file(packing.word_bpe_path())
    want = sorted((str(d), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in ODD)
    got = collections.defaultdict(int)
    for r in rows:
        got[str(r.doc_id)] += r.length
        if r.doc_id == 3:
            ids = tokenizer.encode("a b", add_special_tokens=False).ids + [1]
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
    assert sum(got.values()) == sum(n for _, n in want)
    assert packing.packed_documents(odd.limit(0)).count() == 0


def test_tokens_by_parts_equal_the_whole(spark):
    from tokenizers import Tokenizer

    path = packing.word_bpe_path()
    tokenizer, r = Tokenizer.from_file(path), random.Random(3)
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ["É́ x\t y's\x1cz\r\n '' <|endoftext|>a", "  ", "ÀBİ ǅ ﬁ"]
    signs = [chr(c) for c in [*range(1, 0x180), *range(0x300, 0x310), *range(0x3A0, 0x460), 0x1E9E, 0x212A, 0x130, 0x2026, 0x2014, 0x1F600, 0x4E00, 0x661, 0xB2]]
    texts += ["".join(r.choice(signs if i % 2 else "a's'tre'll dÀİıſßŸÿĲ«–1.²<|") for _ in range(r.randint(1, 12))) for i in range(4000)]
    for t in texts:
        assert packing._ids(path, t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_small_cache_gives_the_same():
    made = []
    kept = packing._Kept(lambda x: made.append(x) or x.upper(), 2)
    assert [kept[x] for x in "abcabdacb"] == list("ABCABDACB") and len(kept) <= 2 and len(made) < 9


def best_fit(lengths, capacity):
    """Sequences that the same rule needs, piece by piece: large pieces by pairs, small ones into the tightest gap."""
    large, small = sorted(k for k in lengths if 3 * k > capacity), sorted((k for k in lengths if 3 * k <= capacity), reverse=True)
    gaps = []
    while large:
        k = large.pop()
        fits = [x for x in large if x <= capacity - k]
        if fits:
            large.remove(fits[-1])
        gaps.append(capacity - k - (fits[-1] if fits else 0))
    for k in small:
        best = min((g for g in gaps if g >= k), default=None)
        if best is None:
            gaps.append(capacity - k)
        else:
            gaps[gaps.index(best)] -= k
    return len(gaps)


def test_plan_needs_no_more_sequences_than_piece_by_piece():
    for seed in range(80):
        r = random.Random(seed)
        cap = r.choice([12, 30, 100, 4096])
        lengths = [r.randint(1, cap if r.random() < 0.5 else max(1, cap // 3)) for _ in range(150)]
        used = {first + j // each for _, _, n, first, _, each in packing.plan(collections.Counter(lengths), cap) for j in range(n)}
        assert len(used) == best_fit(lengths, cap)


def test_quality(spark, documents, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(documents, labels)
    assert (np.diff(model.thresholds) > 0).all()
    assert quality.score(odd, model).count() == len(ODD)
    none = quality.fit(documents, labels.limit(0))
    assert quality.score(documents, none).count() == documents.count()


def test_urls(spark):
    rows = [(1, "https://M.Example.NET/en/1?x"), (2, "http://a.net"), (3, None), (4, "no scheme"), (5, "ftp://x.example.com/de/"), (6, "http://free-bets.example.org/en/1"), (7, "http://museum.example.org/fr/2#a")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, features string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2].rule, got[2].path) == (None, "")
    assert got[3].host == got[4].host == "" and got[5].verdict == "block" and got[5].rule == "example.com/de/"
    assert (got[6].rule, got[6].verdict) == (None, "block") and (got[7].rule, got[7].verdict) == ("org/fr/", "allow")


def test_substrings_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    columns = ["doc_id", "kept_sha256", "n_removed", "n_words"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP4_SQL})").fetchall()
    got = queries.op4_substrings(spark, DATA).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_substrings_of_odd_rows(odd):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(odd).collect())
    assert got == collections.Counter([(1, 0, 0), (2, 0, 0), (2, 0, 0), (3, 2, 0), (None, 3, 0), (4, 60, 60), (5, 60, 60), (6, 30_000, 30_000)])


def test_decontamination(spark, documents):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    words = item.text.split()
    words[3] = "changed"
    planted = documents.select("doc_id", "text").limit(30).unionAll(spark.createDataFrame([(900, "Before this. " * 20 + item.text + " and after." * 20), (901, " ".join(words)), (902, None)], "doc_id long, text string"))
    hits = {(r.rk_id, r.item_id) for r in decontam.contaminated(planted, decontam.build(planted, bench)).collect()}
    assert {(900, item.item_id), (901, item.item_id)} <= hits
    assert decontam.clean(planted, bench.limit(0)).count() == planted.count()


def test_lcs():
    r = random.Random(1)
    for _ in range(50):
        a, b = [r.randint(0, 4) for _ in range(r.randint(0, 12))], [r.randint(0, 4) for _ in range(r.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(a, b) == t[-1][-1]


def call(i, a, name="add"):
    return '{"tool_calls":[{"id":"%s","name":"%s","arguments":%s}]}' % (i, name, a)


CHAT = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    rows = [(1, 0, "tool", '{"tool_call_id":"x","content":1}'), (1, 1, "assistant", call("x", '{"b":1,"a":2}')), (1, 2, "assistant", call("y", '{"a":"$ref:x"}')), (1, 3, "tool", '{"tool_call_id":"q"}'), (2, 0, None, None)]
    schema = {"add": {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}}
    got = {(r.conv_id, r.turn): r for r in chat.linked(spark.createDataFrame(rows, CHAT), schema).collect()}
    assert got[1, 0].after_turn == 1 and got[1, 0].status == "result" and got[1, 1].n_valid == 1 and got[1, 2].n_valid == 0
    assert got[1, 2].level == 3 and got[1, 3].status == "orphan" and got[2, 0].json == '{"content":null,"role":null}'
    assert '"arguments":{"a":2,"b":1}' in got[1, 1].json


def test_chat_order_against_brute_force(spark):
    """Random calls that name others: each stands after all that it names and their answers, a result after its call, cycles apart."""
    r, rows, facts = random.Random(8), [], {}
    for c in range(30):
        n = r.randint(2, 9)
        ids = [f"c{i}" for i in range(n)]
        refs = {i: r.sample(ids, r.randint(0, 2)) if r.random() < 0.6 else [] for i in ids}
        events = [("assistant", call(i, '{"a":%s}' % ("[" + ",".join(f'"$ref:{x}"' for x in refs[i]) + "]"))) for i in ids] + [("tool", '{"tool_call_id":"%s"}' % i) for i in ids if r.random() < 0.7] + [("user", "hi")]
        r.shuffle(events)
        rows += [(c, t, *e) for t, e in enumerate(events)]
        facts[c] = refs
    out = collections.defaultdict(list)
    for x in chat.linked(spark.createDataFrame(rows, CHAT)).collect():
        out[x.conv_id].append(x)
    assert sum(map(len, out.values())) == len(rows)
    for c, refs in facts.items():
        fine, before = set(), -1
        while len(fine) != before:
            before = len(fine)
            fine |= {i for i, x in refs.items() if set(x) <= fine}
        order, answers = {}, {}
        for k, x in enumerate(sorted(out[c], key=lambda x: (x.after_turn, x.level, x.turn))):
            data = chat.json.loads(x.json)
            for one in data.get("tool_calls", []):
                order[one["id"]] = k
                assert (x.status == "cycle") == (one["id"] not in fine)
            if "tool_call_id" in data:
                answers[data["tool_call_id"]] = k
        for i in fine:
            assert all(order[x] < order[i] and answers.get(x, -1) < order[i] for x in refs[i]) and answers.get(i, 99) > order[i]


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "assistant", call("\\ud800", "{}")), (1, 1, "assistant", call("z", '{"a":1%s}' % ("0" * 400))), (1, 2, "assistant", call("z", '{"a":NaN}')), (1, 3, "assistant", "[" * 100_000), (1, 4, "assistant", '{"tool_calls":' + "[" * 50_000)]
    rows += [(None, 0, "user", "x" * 1_000_000), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, None, "tool", '{"tool_call_id":"z"}')]
    schema = {"add": {"type": "object", "properties": {"a": {"type": "integer"}}}}
    df = spark.createDataFrame([(*x, "level") for x in rows], CHAT + ", level string")
    got = chat.linked(df, schema).collect()
    assert len(got) == len(rows) and sum(r.n_valid for r in got) == 1 and sum(r.status == "plain" for r in got) == 7
    assert chat.linked(df.limit(0)).count() == 0


KEY = b"test"


def test_pii(spark):
    text = "Mail Ann.Lee@site.org, ann.lee@site.org or call +1 (337) 555-7349 / 337-555-7349; card 4111 1111 1111 1111, host 10.2.3.4; Herr Hans Meier met Frau Eva Meier and Mr Meier."
    rows = spark.createDataFrame([(1, text, "x"), (2, "nothing here", "x"), (3, None, "x"), (4, text, "x")], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows, KEY).collect()}
    new = got[1].text
    assert got[1].n_pii == 9 and got[2].text == "nothing here" and got[3].text is None and got[4].text == new and got[1].kind == "x"
    assert not any(x in new for x in ("Lee", "lee@", "337", "4111", "10.2.3.4", "Hans", "Eva", "Meier"))
    a, b = re.findall(r"\S+@\S+org", new)
    assert a.lower() == b and re.search(r"\+1 \(\d{3}\) 555-\d{4} / \d{3}-555-\d{4}|\+1 \(555\) \d{3}-\d{4} / 555-\d{3}-\d{4}", new)
    card = re.search(r"card ((?:\d{4} ){3}\d{4}),", new).group(1).replace(" ", "")
    assert sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(card)) % 10 == 0
    names = re.search(r"Herr (\S+) (\S+) met Frau (\S+) (\S+) and Mr (\S+)\.", new).groups()
    assert names[1] == names[3] == names[4] and names[0] != names[2] and names[0] in pii.FIRST["m", "latin"]
    assert pii.pseudonymise(rows, b"other").where("doc_id = 1").first().text != new and pii.pseudonymise(rows.limit(0), KEY).count() == 0


def test_pii_against_regular_expressions(spark, documents):
    """Every document by Python's patterns: the same hits, the text between them untouched, one surrogate for an entity and one entity for a surrogate."""
    import regex

    pattern = regex.compile(pii.ANY)
    got = {r.doc_id: r for r in pii.pseudonymise(documents, KEY).collect()}
    new, old = {}, {}
    for r in documents.collect():
        hits = [(m.start(), m.group()) for m in pattern.finditer(r.text)]
        assert got[r.doc_id].n_pii == len(hits)
        made = re.fullmatch("(.+?)".join(map(re.escape, pattern.split(r.text))), got[r.doc_id].text, re.S)
        for (_, hit), x in zip(hits, made.groups(), strict=True):
            key = hit.lower() if "@" in hit or "." in hit else re.sub("[^0-9]", "", hit)[-10:]
            value = x.lower() if "@" in hit or "." in hit else re.sub("[^0-9]", "", x)[-10:]
            if key and key[0].isalnum() and not hit[0].isupper():
                assert new.setdefault(key, value) == value and old.setdefault(value, key) == key


def test_pii_ends_where_the_entities_fill_their_form(spark):
    rows = [(i, f"{i % 10}@{i // 10}.co and 10.0.0.{i}") for i in range(100)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    mails = {r.text.split()[0] for r in got}
    assert len(mails) == 100 and not mails & {t.split()[0] for _, t in rows}


def test_pii_of_long_hosts(spark):
    rows = [(1, "x@" + "a." * 30_000 + "com"), (2, "a.b-" * 20_000), (3, "1" * 50_000), (4, "mr " * 20_000)]
    assert [r.n_pii for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).orderBy("doc_id").collect()] == [1, 0, 0, 0]


def test_secrets_against_regular_expressions(documents):
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(documents)).collect()}
    for r in documents.collect():
        spans = []
        for k, (kind, (pattern, least)) in enumerate(secrets.PATTERNS.items()):
            spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, r.text, re.A) if len(m.group(2 if kind == "assign" else 0)) >= least]
        base = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_secret_ownership(spark):
    token = "token=abcdefgh12345678"
    rows = [(i, f"é😀 {token}", f"o{i}") for i in range(3)] + [(9, "password: Zq8r7w6e5t4y3u", "o1"), (10, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(docs)).collect()}
    assert got[0] == "assign:3:25,example:9:25" and got[9] == "assign:0:24,live:10:24" and got[10] == ""
    masked = {r.doc_id: r.text for r in secrets.masked(docs).collect()}
    assert masked[9] == "password: [secret]" and masked[0] == rows[0][1]


def test_secrets_of_very_many_hits(spark):
    r = random.Random(2)
    text = "😀 " + " ".join("%016x" % r.getrandbits(64) for _ in range(20_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, "😀token=Zq8r7w6e5t4y3u-a1b2c3d4e5f60718 end", "s"), (2, "😀token=Zq8r7w6e5t4y3u-a1b2c3d4e5f60718 end", "s")], "doc_id long, text string, source string")
    got = {x.doc_id: x for x in secrets.digest(secrets.scan(docs)).collect()}
    assert got[1].n_hex == 20_000 and got[1].spans.startswith("hex:2:18") and got[2].spans.count("live") >= 1
    clean = {x.doc_id: x.text for x in secrets.masked(docs).collect()}
    assert clean[2] == "😀token=[secret] end" and clean[1].count("[secret]") + sum(len(w) == 16 for w in clean[1].split()) == 20_000
    assert secrets.masked(docs.limit(0)).count() == 0 and secrets.scan(docs.limit(0)).count() == 0


def test_secret_spans_against_brute_force(spark):
    r = random.Random(6)
    values = ["%s%d" % ("".join(r.choice("abcdefGHIJK") for _ in range(14)), i) for i in range(8)] + ["%032x" % r.getrandbits(128) for _ in range(4)]
    rows = [(i, " ".join(r.choice(["token=%s", "x %s", "secret: '%s'", "é %s!"]) % r.choice(values) for _ in range(r.randint(0, 4))), f"o{r.randint(0, 9) if i % 3 else 1}", "clash") for i in range(120)]
    rows += [(1, None, None, "clash")] + rows[:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, live string")
    found, owners, texts = [], collections.defaultdict(set), collections.defaultdict(set)
    for _, text, source, _ in rows:
        hits = []
        for k, (kind, (pattern, least)) in enumerate(secrets.PATTERNS.items()):
            for m in re.finditer(pattern, text or "", re.A):
                g = 2 if kind == "assign" else 0
                if len(m.group(g)) >= least:
                    hits.append((m.start(), k, m.end(), m.start(g), m.group(g)))
                    owners[m.group(g)].add(source or "")
                    texts[m.group(g)].add(text)
        found.append(hits)
    want = collections.Counter()
    for (doc, *_), hits in zip(rows, found, strict=True):
        spans = [(a, k, b) for a, k, b, _, _ in hits]
        added = set()
        for _, _, b, v, value in hits:
            looks = len(set(value)) >= 8 and re.search("[0-9]", value) and re.search("[A-Za-z]", value)
            kind = "example" if len(owners[value]) >= 3 or len(texts[value]) >= 20 else "live" if looks else None
            if kind:
                added.add((v, secrets.KINDS.index(kind), b))
        want[doc, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted([*spans, *added]))] += 1
    got = collections.Counter((x.doc_id, x.spans) for x in secrets.digest(secrets.scan(docs, example_repositories=20)).collect())
    assert got == want


def plain_lzw(data, least):
    """A code stream read code by code with a table of strings."""
    clear = 1 << least
    table, out, width, bits, held, last = {}, b"", least + 1, 0, 0, b""
    for byte in data:
        held, bits = held | byte << bits, bits + 8
        while bits >= width:
            code, held, bits = held & (1 << width) - 1, held >> width, bits - width
            if code == clear:
                table, width, last = {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}, least + 1, b""
                continue
            if code == clear + 1:
                return out
            entry = table[code] if code in table else last + last[:1]
            if last and len(table) < 4096:
                table[len(table)] = last + entry[:1]
            width = min(12, max(width, len(table).bit_length()))
            out, last = out + entry, entry
    return out


def test_lzw_against_a_plain_decoder():
    r = np.random.default_rng(4)
    for pixels, values in ((1, 2), (576, 2), (576, 256), (3799, 9), (3801, 200), (9000, 3)):
        rows = r.integers(0, values, (7, pixels)).astype(np.uint8)
        streams = gif.lzw_encode_many(rows)
        assert [plain_lzw(s, 8) for s in streams] == [x.tobytes() for x in rows]
        assert (gif.lzw_many(streams, 8, pixels) == rows).all()
        if values < 10 and pixels > 500:
            assert max(map(len, streams)) < pixels  # compressed
    with pytest.raises(ValueError):
        gif.lzw_many([bytes([0x00, 0xFF, 0xFF])], 8, 9)


def test_gif():
    for n in (0, 1, 576, 5000):
        data, _ = gif.payload("x" * n)
        frames = np.frombuffer(data, np.uint8).reshape(-1, 24, 24)
        shown, delays = gif.decode(gif.encode(frames))
        assert shown[..., 0].tobytes() == data and (shown == gif.PALETTE[frames]).all() and len(delays) == len(frames)
    every = np.random.default_rng(3).integers(0, 256, (4, 24, 24)).astype(np.uint8)  # no value is free, so no transparency
    assert (gif.decode(gif.encode(every))[0][..., 0] == every).all()
    # a compressed stream, a transparent second frame that restores what was before
    red = b"GIF89a\x02\x00\x01\x00\x80\x00\x00\xff\x00\x00\x00\x00\xff"
    frame = lambda control, data: b"\x21\xf9\x04" + control + b"\x00" + b"\x2c\x00\x00\x00\x00\x02\x00\x01\x00\x00\x02" + data + b"\x00"
    codes = lambda *c: bytes([2]) + sum(x << (3 * i) for i, x in enumerate(c)).to_bytes(2, "little")
    file = red + frame(b"\x00\x05\x00\x00", codes(4, 0, 0, 5)) + frame(b"\x0d\x07\x00\x00", codes(4, 0, 1, 5)) + frame(b"\x01\x01\x00\x01", codes(4, 0, 1, 5)) + b"\x3b"
    shown, delays = gif.decode(file)
    assert delays == [5, 7, 1] and shown[1, 0].tolist() == [[255, 0, 0], [0, 0, 255]] and shown[2, 0].tolist() == [[255, 0, 0], [255, 0, 0]]


def test_media_against_the_texts(spark, documents, odd):
    rows = [(r.doc_id, r.text or "") for r in documents.collect()] + [(d, t or "") for d, t in ODD]
    both = documents.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    want = collections.Counter()
    for d, t in rows:
        data, n = gif.payload(t)
        assert len(data) % 576 == 0 and data[:n] == t.encode() and set(data[n:]) <= {255} and len(data) - n <= 576
        colours = gif.PALETTE[np.frombuffer(data, np.uint8)]
        bins = tuple(int((colours[:, c] // 32 == k).sum()) for c in range(3) for k in range(8))
        want[d, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(data) // 576, bins] += 1
    made = gif.media(both)
    got = made.collect()
    assert want == collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.n_frames, tuple(r.histogram)) for r in got)
    assert all(len(r.media) == r.media_bytes and hashlib.sha256(r.media).hexdigest() == r.media_sha256 for r in got)
    some = [r for r in got if r.n_frames < 4][:20]
    films = gif.frames(spark.createDataFrame([(i, r.media, 1) for i, r in enumerate(some)], "doc_id long, media binary, frame int")).collect()
    assert len(films) == sum(r.n_frames for r in some) and all(f.start_cs == 10 * f.frame and sum(f.histogram) == 3 * 576 for f in films)
    assert gif.media(odd.limit(0)).count() == 0


def test_gifs_that_cannot_be_read(spark):
    huge = b"GIF89a\xff\xff\xff\xff\x00\x00\x00\x3b"
    rows = [(1, huge), (2, b"PNG"), (3, None), (4, b"GIF89a\x01\x00"), (5, gif.encode(np.zeros((2, 3, 3), np.uint8))[:-9])]
    got = collections.Counter((r.doc_id, r.error is None) for r in gif.frames(spark.createDataFrame(rows, "doc_id long, media binary")).collect())
    assert got[1, False] == got[2, False] == got[4, False] == 1 and not got[3, True] and got[5, False] == 1


def test_simhash_against_brute_force(documents):
    got = simhash.simhash_components(documents).collect()
    fps = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in documents.collect()}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(r.fp == fps[r.doc_id] and r.component_id == find(r.doc_id) for r in got) and len(got) == len(fps)
    assert sorted(map(tuple, simhash.simhash_components(documents, longest=2).collect())) == sorted(map(tuple, got))


def test_simhash_of_odd_rows(odd):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_near_duplicates(spark, odd):
    r = random.Random(5)
    base = [[f"v{r.randint(0, 5000)}" for _ in range(300)] for _ in range(12)]
    rows = []
    for i, words in enumerate(base):
        rows.append((i * 10, " ".join(words)))
        for k in (1, 2):
            edited = list(words)
            for p in r.sample(range(300), 2):
                edited[p] = f"e{i}{k}{p}"
            rows.append((i * 10 + k, " ".join(edited)))
    kept = {x.doc_id for x in neardup.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i * 10 for i in range(12)}
    left = neardup.distinct_documents(odd)
    assert left.columns == odd.columns and sorted(str(x.doc_id) for x in left.collect()) == ["1", "3", "4", "6", "None"]
