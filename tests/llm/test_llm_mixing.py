"""Source mixing: targets against a plain rule, fits against full enumeration."""

import collections
import itertools
import random

import pytest

from weftgraph.llm import mixing

SCHEMA = "doc_id long, source string, text string, size long, copies int"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Sizes by source (None last) to targets: share by weight, stop, share the excess anew."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            target.update({s: w[s] * level for s in open_})
            break
        target.update({s: most * sizes[s] for s in over})
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def docs(seed, n=300):
    rng = random.Random(seed)
    names = [None, "a", "B", "é", "z", "hot"]
    out = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else rng.choice(names)
        words = rng.choice([0, 1, 2, 3, 5, 8, 40]) if s != "z" else rng.randint(0, 2)
        text = None if rng.random() < 0.05 else " \t\n\x0b".join(["wörd x"] * words)
        out.append((i, s, text, -1, -1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_sizes_and_limits(spark, seed):
    rows = docs(seed)
    got = mixing.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    size = {i: len((t or "").replace("\x0b", " ").split(" ")) if t else 0 for i, _, t, *_ in rows}
    size = {i: len([w for w in (t or "").translate(str.maketrans("\t\n\x0b", "   ")).split(" ") if w]) for i, _, t, *_ in rows}
    source = {i: s for i, s, *_ in rows}
    by = collections.Counter()
    for i, n in size.items():
        by[source[i]] += n
    target, taken = plain_targets(dict(by)), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    # every source here has enough one-word documents to be filled to the word
    assert all(target[s] - 1 < taken[s] <= target[s] + 1e-6 for s in target if s != "z")
    again = mixing.mix_report(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_rows_keep_columns_and_repeat(spark):
    rows = docs(3) + [(7, "a", "one two", -1, -1)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    report, out = mixing.mix_report(df).collect(), mixing.mixed(df)
    assert out.columns == df.columns
    want = collections.Counter()
    for r in report:
        if r["size"]:
            want[r["doc_id"]] += r["taken"] // r["size"]
    got = collections.Counter(r["doc_id"] for r in out.collect() if r["text"] and r["text"].strip())
    assert got == +want


def test_hot_length_is_ranked_by_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    rows = [(i, "a" if i % 10 else "b", "one two three", 0, 0) for i in range(2000)]
    got = mixing.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in ("a", "b"):
        mine = [r for r in got if (r["doc_id"] % 10 > 0) == (s == "a")]
        assert mine[0]["target"] - 3 < sum(r["taken"] for r in mine) <= mine[0]["target"]


def test_repeated_rows_are_taken_to_the_target(spark):
    rows = [(7, "a", "one two three four five six seven eight nine ten", 0, 0)] * 1000 + [(8, "b", "x y z", 0, 0)] * 333
    rows += [(i, None, "u v", 0, 0) for i in range(100, 120)] + [(9, None, "u v", 0, 0)] * 9
    size = {s: sum(len(t.split()) for _, x, t, *_ in rows if x == s) for s in ("a", "b", None)}
    target, taken = plain_targets(size), collections.Counter()
    got = mixing.mix_report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        s = {7: "a", 8: "b"}.get(r["doc_id"])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    longest = {"a": 10, "b": 3, None: 2}
    assert all(target[s] - longest[s] < taken[s] <= target[s] + 1e-6 for s in target)
    again = mixing.mix_report(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = collections.Counter(r["doc_id"] for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out[7] * 10 == taken["a"] and out[8] * 3 == taken["b"]


def test_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "w " * 300_000, 5, 6, 7, 8), (2, "a", "w", 5, 6, 7, 8)],
                               "doc_id long, source string, text string, _src int, _key int, _BASE int, Target int")
    out = mixing.mix(df)
    assert out.columns[:7] == df.columns and {tuple(r)[3:8] for r in out.collect()} == {(5, 6, 7, 8, 300_000), (5, 6, 7, 8, 1)}


def test_no_words_and_empty_table(spark):
    got = mixing.mix_report(spark.createDataFrame([(1, "a", None, 0, 0), (2, None, " ", 0, 0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fit_counts_against_enumeration():
    rng = random.Random(5)
    for _ in range(200):
        lengths = sorted(rng.sample(range(0, 12), rng.randint(1, 4)))
        counts = [rng.randint(1, 3) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, total + 1)
        take = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        words = sum(a * b for a, b in zip(lengths, take))
        assert words <= budget
        if sum(1 for n in lengths if n == 1):
            best = max(s for s in (sum(a * b for a, b in zip(lengths, x)) for x in itertools.product(
                *[range(c + 1) for c in counts])) if s <= budget)
            assert best - words <= max(lengths)


def test_fit_counts_fills_large_budgets_to_the_word():
    rng = random.Random(6)
    lengths = sorted(rng.sample(range(1, 20_000), 900))
    counts = [rng.randint(1, 400) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    for part in (0.01, 0.37, 0.5, 0.93):
        budget = int(part * total)
        take = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(a * b for a, b in zip(lengths, take)) == budget


def test_rows_of_a_small_plan_are_not_shuffled(spark, monkeypatch):
    df = spark.createDataFrame(docs(5), SCHEMA).drop("size", "copies")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def top_join(table):
        plan = table._jdf.queryExecution().executedPlan().toString()
        return next(line for line in plan.splitlines() if "Join" in line)

    try:
        small = mixing.mix(df)
        assert "BroadcastHashJoin" in top_join(small)
        one = sorted(map(repr, small.collect()))
        monkeypatch.setattr(mixing, "PLAN_BYTES", 0)
        large = mixing.mix(df)
        assert "SortMergeJoin" in top_join(large)
        assert sorted(map(repr, large.collect())) == one and len(one) == df.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
