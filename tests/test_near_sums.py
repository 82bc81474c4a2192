"""Rings of small trees in one task, and pairs of small groups without blocks."""

import numpy as np
import pytest

from weftgraph.lineage import lineage_dir
from weftgraph.operators import similarity as S
from weftgraph.settings import AlignSettings

NODE = "doc_id long, component string, node_id long, vec array<double>"
EDGE = "doc_id long, component string, parent_id long, child_id long"


def written(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(lineage_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()


def trees(odd):
    rng = np.random.default_rng(7)
    nodes, edges = [], []
    for d, c, n in ((1, "source", 12), (1, "summary", 7), (2, "source", 2), (3, "source", 9), (4, "source", 1)):
        nodes += [(d, c, i, rng.normal(size=3).tolist()) for i in range(n)]
        edges += [(d, c, int(rng.integers(0, i)), i) for i in range(1, n)]
    nodes.remove(nodes[5])  # the end of an edge that has no row
    nodes += [(1, "summary", 3, [1.0, 2.0, 3.0]), (None, "source", 1, [1.0, 1.0, 1.0]), (2, "source", None, [1.0, 1.0, 1.0])]
    edges += [(None, "source", 0, 1), (3, "source", None, 77), (3, "source", 8, None)]
    if odd:  # a null, one number too few, a missing vector
        nodes += [(5, "source", 0, [None, 1.0, 2.0]), (5, "source", 1, [1.0, 1.0, 1.0]), (6, "source", 0, [1.0]), (6, "source", 1, [1.0, 2.0, 3.0]),
                  (7, "source", 0, None), (7, "source", 1, [4.0, 2.0, 3.0])]
        edges += [(d, "source", 0, 1) for d in (5, 6, 7)]
    return nodes, edges


@pytest.mark.parametrize("mode,zero,odd", [("all", 0.0, False), ("all", 0.0, True), ("descendant", 0.5, False), ("ancestor", 0.0, True)])
def test_task_sums_are_those_of_the_joins(spark, monkeypatch, mode, zero, odd):
    nodes, edges = trees(odd)
    nodes, edges = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    settings = AlignSettings(neighbor_direction=mode, neighbor_weights=(zero, 1.0, 0.5, 0.25))

    def run():
        out = S.neighborhood_vector(nodes, edges, 3, settings).collect()
        return sorted((str(r.doc_id), r.component, str(r.node_id), str(r.vec), [None if x is None else round(x, 9) + 0.0 for x in r.nvec]) for r in out)

    before = written(spark)
    one = run()
    joined = {n for n in written(spark) - before if n.startswith("ring-message")}
    assert odd or not joined
    monkeypatch.setattr(S, "RING_ROWS", 0)
    assert run() == one and len(one) == nodes.count()
    if not odd:  # weights count: the only neighbour of document 2's root
        vec = {r.node_id: r.vec for r in nodes.where("doc_id = 2 and node_id is not null").collect()}
        near = {r[2]: r[4] for r in one if r[0] == "2"}
        if mode == "all":
            assert near["0"] == [round(x, 9) + 0.0 for x in vec[1]] and near["1"] == [round(x, 9) + 0.0 for x in vec[0]]


def test_groups_of_one_block_are_not_cut(spark):
    rows = [(1, "source", 1, "concept", [1.0, 0.0]), (1, "summary", 2, "concept", [1.0, 0.1]), (1, "summary", 3, "sentence", [1.0, 0.0]),
            (2, "source", 4, "concept", [1.0, 0.0]), (None, "source", 1, "concept", [1.0, 0.0]), (None, "summary", 1, "concept", [1.0, 0.0]),
            (3, "source", 5, "control", [1.0, 0.0]), (3, "summary", 6, "control", [1.0, 0.0]), (4, "source", 1, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, component string, node_id long, attrib_type string, vec array<double>")
    found = S.cosine_pairs(df, 0.3)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    assert [tuple(r)[:4] for r in found.collect()] == [(1, "concept", 1, 2)]


def test_nodes_and_edges_may_come_from_one_table(spark):
    one = spark.createDataFrame([(1, "source", i, max(i - 1, 0), [float(i)]) for i in range(3)], "doc_id long, component string, node_id long, up long, vec array<double>")
    edges = one.where("node_id > 0").withColumnRenamed("node_id", "child_id").withColumnRenamed("up", "parent_id")
    out = S.neighborhood_vector(one.select("doc_id", "component", "node_id", "vec"), edges, 1, AlignSettings(neighbor_weights=(0.0, 1.0)))
    assert sorted((r.node_id, r.nvec) for r in out.collect()) == [(0, [1.0]), (1, [1.0]), (2, [1.0])]
