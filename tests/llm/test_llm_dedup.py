"""Exact deduplication against a plain grouping."""

import collections
import hashlib

import pandas as pd

from weftgraph.llm import exact_dedup
from weftgraph.llm.common import LOWER, UPPER

SCHEMA = "doc_id long, text string, digest string, keep_id long"


def plain(rows):
    norm = [(i, (t or "").translate(str.maketrans(UPPER, LOWER))) for i, t, *_ in rows]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in exact_dedup.exact_dedup(df, **kw).collect()), key=str)


def test_equal_texts_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "A b", "x", 9), (2, "a B", "x", 9), (3, None, None, 1), (4, "", "y", 1), (5, "É", "", 0), (6, "é", "", 0),
            (7, "solo", "z", 0), (7, "solo", "z", 0), (None, "a b", "", 0), (None, "lost", "", 0), (8, "x" * 200_000, "", 0)]
    assert run(spark, rows) == plain(rows)


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i % 50}" if i % 3 == 1 else f"own {i}", "", 0) for i in range(3000)]
    assert run(spark, rows, counters=4) == plain(rows)
    heavy = exact_dedup.heavy_candidates(spark.createDataFrame(
        [(b"h" if i % 3 == 0 else str(i).encode(),) for i in range(3000)], "digest binary"), 4)
    found = [bytes(r[0]) for r in heavy.collect()]
    assert b"h" in found and len(found) <= 5


def test_empty_table(spark):
    assert run(spark, []) == []


def test_misra_gries_bound():
    values = ["a"] * 50 + ["b"] * 30 + [f"x{i}" for i in range(60)]
    batches = [pd.Series(values[i::7]) for i in range(7)]
    held = exact_dedup.misra_gries(iter(batches), 4)
    counts = collections.Counter(values)
    assert len(held) <= 4
    assert all(held[v] <= counts[v] for v in held)
    assert all(held.get(v, 0) >= n - len(values) / 5 for v, n in counts.items())
