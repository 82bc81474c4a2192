"""Jaccard join against all pairs of small tables."""

import random

import pytest

from weftgraph.llm import near_join
from weftgraph.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def plain(rows, width, num, den):
    """``doc_id, n_shingles, component_id`` by comparing all pairs."""
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    where = {}
    for i, s in enumerate(sets):
        for t in s:
            where.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for t in s for j in where[t] if j < i}:
            both = len(s & sets[j])
            if den * both >= num * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lowest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[find(i)] = min(lowest.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), lowest.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [f"n{rng.randint(0, 9999)}"] if x < 2 * share / 3 else [w, "ins"] if x < share else [w]
    return out


def table(seed, n=500):
    rng = random.Random(seed)
    passage, rows = [f"p{i}" for i in range(60)], []
    family = [f"f{i}" for i in range(150)]
    for i in range(n):
        kind = i % 4
        if kind == 0:  # a large family of near copies, a third of them the same text
            words = family if rng.random() < 0.33 else edited(rng, family, rng.choice([0.005, 0.02, 0.05, 0.1]))
        elif kind == 1:  # a passage that many share
            words = [f"u{i}-{k}" for k in range(rng.randint(1, 80))] + passage
        elif kind == 2 and rows:  # a near copy of an earlier one
            words = edited(rng, rng.choice(rows)[1].split(), 0.02)
        else:
            words = [rng.choice("abcdef") for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width,num,den,group", [(3, 90, 100, 64), (5, 80, 100, 4), (1, 50, 100, 2)])
def test_components(spark, monkeypatch, width, num, den, group):
    monkeypatch.setattr(near_join, "GROUP", group)
    monkeypatch.setattr(near_join, "QUERIES", 8)
    rows = table(width)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_join.jaccard_groups(df, width, num, den).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, width, num, den)


def test_frequent_tokens_change_nothing(spark, monkeypatch):
    rows = table(8, 300)
    want = plain(rows, 3, 90, 100)
    for least, most in ((2, 1 << 18), (2, 3), (10_000, 10)):
        monkeypatch.setattr(near_join, "FREQUENT_FROM", least)
        monkeypatch.setattr(near_join, "FREQUENT", most)
        got = near_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
        assert sorted((tuple(r) for r in got), key=str) == want


ODD = [(1, "A b c d"), (2, "a B c\td"), (3, "a b"), (4, "A  b\n"), (5, None), (6, ""), (7, " \x0b\x0c "), (8, "a b c"),
       (9, "É x y"), (10, "é x y"), (None, "a b c d"), (None, "only here it is"), (11, "long " * 100_000), (11, "long " * 100_000),
       (12, "one two three four"), (12, "five six seven eight"), (12, "five six seven eight")]
SCHEMA = "doc_id long, text string, _key int, digest string, component_id int"


def test_edge_cases(spark):
    df = spark.createDataFrame([(*r, 0, "", 0) for r in ODD], SCHEMA)
    got = near_join.jaccard_groups(df, 3, 90, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(ODD, 3, 90, 100)
    assert near_join.jaccard_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_stays(spark):
    df = spark.createDataFrame([(*r, 0, "", 0) for r in ODD], SCHEMA)
    kept = near_join.one_per_group(df, 3, 90, 100)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = sorted([(1, "A b c d"), (3, "a b"), (5, None), (6, ""), (7, " \x0b\x0c "), (8, "a b c"), (9, "É x y"), (10, "é x y"),
                   (None, "only here it is"), (11, "long " * 100_000), (12, "one two three four"), (12, "five six seven eight")], key=str)
    assert got == want
    assert near_join.one_per_group(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = REGISTRY["op10_token_group_jaccard"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 3, 90, 100)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (205, 200), (200, 205)]
    got = {r["v"]: r["low"] for r in near_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200, 205: 200}
