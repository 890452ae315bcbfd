"""Near-duplicate removal against brute force over all pairs."""

import random

import pytest

from tidemark.llm import neardup


def expected(rows):
    """The smallest id of each connected group of similar texts."""
    sets = [neardup.shingles(t.encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if neardup.similarity(sets[i], sets[j]) >= neardup.SIMILARITY:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return set(low.values())


def kept(spark, rows):
    return {x.doc_id for x in neardup.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def words(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def edited(r, base, n, tag):
    out = list(base)
    for p in r.sample(range(len(base)), n):
        out[p] = f"e{tag}x{p}"
    return out


def test_added_cut_and_edited_copies(spark):
    r = random.Random(4)
    rows, tag = [], 0
    for _ in range(60):
        base = words(r, r.choice([40, 120, 300, 900]))
        n = len(base)
        copies = [*(base + words(r, int(n * f)) for f in (0.05, 0.1, 0.15, 0.2)), *(words(r, int(n * f)) + base for f in (0.1, 0.2))]
        copies += [base[: n - int(n * f)] for f in (0.05, 0.1, 0.15, 0.2)] + [edited(r, base, max(1, n // k), f"{n}a{k}") for k in (40, 60)]
        for c in (base, r.choice(copies)):  # pairs, so that no third text stands in for a lost link
            rows.append((tag, " ".join(c)))
            tag += 1
    want = expected(rows)
    assert len(want) < len(rows) - 40
    assert kept(spark, rows) == want


def test_copies_linked_through_a_text_of_a_larger_id(spark):
    r = random.Random(5)
    base = words(r, 300)
    # the base has neither the smallest id nor the largest; six edits leave the copies at 0.82 to it and at 0.69 to each other
    rows = [(i, " ".join(base if i == 37 else edited(r, base, 6, i))) for i in range(80)]
    assert expected(rows) == {0}
    assert kept(spark, rows) == {0}


def test_chains_and_long_lists(spark):
    r = random.Random(6)
    rows = []
    for g in range(4):
        now = words(r, 200)
        for i in range(30):  # each like the last, but not like the first
            rows.append((g * 100 + (i * 7) % 30, " ".join(now)))
            now = edited(r, now, 2, f"{g}y{i}")
    line = words(r, 40)
    rows += [(1000 + i, " ".join(line + words(r, 5 + i % 9))) for i in range(60)]
    want = expected(rows)
    spread = spark.createDataFrame(rows, "nid long, text string")
    for longest in (0, 1, neardup.LONGEST):  # from one head a turn in every list, to all pairs at once
        stars = neardup.similar_groups(spread, longest)
        roots = {x.node: x.root for x in stars.collect()}
        assert {d for d, _ in rows if d not in roots} == want
