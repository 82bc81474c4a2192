"""One poisoned document among many: a failure row, and the rest complete."""

import random

import pytest

from weftgraph.operators import maxflow as M
from weftgraph.operators import similarity as S
from weftgraph.operators.guard import split_failures

NODE = "doc_id long, component string, node_id long, attrib_type string, vec array<double>"


def test_poisoned_vectors(spark):
    rng = random.Random(2)
    rows = [(d, "source" if i % 2 else "summary", i, "concept", [rng.random() for _ in range(3)]) for d in range(12) for i in range(8)]
    clean = spark.createDataFrame(rows, NODE)
    want = {tuple(r)[:4]: r.sim for r in S.cosine_pairs(clean, 0.1).where("doc_id <> 5").collect()}
    rows = [(d, c, i, t, v[:2] if (d, i) == (5, 3) else v) for d, c, i, t, v in rows]
    found = S.cosine_pairs(spark.createDataFrame(rows, NODE), 0.1, block_rows=3, keep_failures=True).cache()
    good, failures = split_failures(found, "similarity", ["src_node"])
    assert {tuple(r)[:4]: r.sim for r in good.collect()} == pytest.approx(want)
    bad, = failures.collect()
    assert (bad.doc_id, bad.stage) == (5, "similarity") and "ValueError" in bad.message
    found.unpersist()


def test_poisoned_capacities(spark):
    net = [(str(d), "S", "v", 2.0, "terminal", None, "s") for d in range(6)]
    net += [(str(d), "v", "T", float("nan") if d == 4 else 1.0 + d, "role", "source", "e") for d in range(6)]
    df = spark.createDataFrame(net, "doc_id string, from_key string, to_key string, capacity double, edge_type string, component string, edge_id string")
    found = M.guarded_max_flow(df).cache()
    good, failures = split_failures(found, "flow", ["edge_id"])
    assert {r.doc_id: r.value for r in M.max_flow_value(good).collect()} == {str(d): min(2.0, 1.0 + d) for d in range(6) if d != 4}
    assert [tuple(r)[:2] for r in failures.collect()] == [("4", "flow")]
    found.unpersist()
