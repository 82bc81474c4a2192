"""Sharding: capacity against dynamic programming, laws of the result."""

import collections
import random
import zlib

from weftgraph.llm import sharding

SCHEMA = "doc_id long, text string, shard int, size string"


def ends_of(sizes, cells):
    at, ends = 0, []
    for s in sizes:
        at += s
        ends.append(at)

    def summary(ranges, width):
        runs = {}
        for e in ends:
            if ranges is None or any(a <= e <= b for a, b in ranges):
                runs.setdefault((e - 1) // width, []).append(e)
        return [(r[0], r[-1], len(r)) for r in runs.values()]

    return sharding.Ends(summary, at, cells), ends


def least_capacity(sizes, shards):
    """By the definition: split at every place, one shard at a time."""
    best = {0: 0}
    for _ in range(shards):
        new = {}
        for i, m in best.items():
            at = 0
            new[i] = min(new.get(i, m), m)
            for j in range(i, len(sizes)):
                at += sizes[j]
                new[j + 1] = min(new.get(j + 1, 1 << 60), max(m, at))
        best = new
    return best[len(sizes)]


def test_capacity_is_the_least_at_every_resolution():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([1, 3, 17, rng.randint(1, 120)]) for _ in range(rng.randint(1, 40))]
        shards = rng.randint(1, 6)
        for cells in (2, 7, 1 << 16):
            ends, all_ends = ends_of(sizes, cells)
            capacity, cuts = sharding.minimax_cuts(ends, shards)
            assert capacity == least_capacity(sizes, shards)
            edges = [0, *cuts, all_ends[-1]]
            assert all(c in all_ends or c == 0 for c in cuts)
            assert all(0 <= b - a <= capacity for a, b in zip(edges, edges[1:]))


def laws(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows if i is not None)
    assert len(got) == len(rows)
    slots, place = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        place[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in place.values())
    return collections.Counter({s: sum(r["size"] for r in got if r["shard"] == s) for s in slots})


def test_laws_with_a_hot_text(spark):
    rng = random.Random(2)
    rows = [(i, "same text" * 4 if i % 3 == 0 else "w" * rng.randint(0, 400), 0, "") for i in range(900)]
    rows += [(1000, None, 0, ""), (1001, "", 0, ""), (None, "ü" * 300, 0, ""), (5, "ü" * 300, 0, ""), (5, "ü" * 300, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    loads = laws(rows, sharding.shard(df, shards=8, cells=16).collect(), 8)
    # the hot text (15,600 of 18,700 bytes of an even share) cannot be cut, the rest is even
    mean = sum(loads.values()) / 8
    assert max(loads.values()) < 1.1 * mean and sorted(loads.values())[1] > 0.95 * mean
    wide = sharding.shard(df, shards=8).collect()
    assert sorted(map(str, wide)) == sorted(map(str, sharding.shard(df.repartition(5), shards=8).collect()))


def test_few_groups_and_empty_table(spark):
    rows = [(1, "a", 0, ""), (2, "b", 0, ""), (3, "a", 0, "")]
    laws(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect(), 40)
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []
