"""First-visit counts in grouped functions and by joins, and tables that queries write once."""

import random

from weftgraph.operators import flow as W
from weftgraph.operators import trees as TR
from weftgraph.plans import queries as Q
from weftgraph.plans import views as D

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.select("doc_id", "component", "edge_id", "n_desc").collect()))


def test_walk_in_a_task_counts_as_the_joins_do(spark):
    """Shared vertices, circles, several roots, repeated and null ids, lone roots."""
    rng, edges, tops = random.Random(5), [], []
    for d in range(60):
        n, comp = rng.randint(1, 8), rng.choice(["source", "summary"])
        for i in range(rng.randint(0, 12)):
            a, b = rng.randrange(n), rng.randrange(n)
            edges.append((d, comp, i if d % 5 else rng.randrange(9), f"n{min(a, b) if d % 3 else a}", f"n{b if d % 3 == 0 else max(a, b)}"))
        tops += [(d, comp, f"n{r}") for r in range(rng.choice([1, 1, 2, 0]))]
    edges += [(None, "source", 1, "a", "b"), (900, "source", None, "a", "b"), (900, "source", 2, "b", "c"), (901, None, 1, "a", "b")]
    tops += [(None, "source", "a"), (900, "source", "a"), (901, None, "a"), (902, "source", "lone")]
    e = spark.createDataFrame(edges, "doc_id long, component string, edge_id long, parent_id string, child_id string")
    t = spark.createDataFrame(tops, "doc_id long, component string, node_id string")
    want = _rows(W.spread_first_visit_counts(e, t))
    assert len(want) == len(edges) + len(tops)
    assert _rows(W.first_visit_counts(e, t)) == want
    assert _rows(W.first_visit_counts(e, t, group_edges=6)) == want


def test_a_long_chain_is_walked_without_its_paths(spark):
    n = 3000
    e = spark.range(n).selectExpr("1L doc_id", "'source' component", "id edge_id", "id parent_id", "id + 1 child_id")
    t = spark.createDataFrame([(1, "source", 0)], "doc_id long, component string, node_id long")
    got = {r["edge_id"]: r["n_desc"] for r in W.first_visit_counts(e, t).collect()}
    assert got == {None: n + 1, **{str(i): n - i for i in range(n)}}


def test_networks_and_purchase_pairs_read_the_lines_once(spark):
    """What a query uses several times is a written table, not the joins that made it."""
    tables = [Q._dag_network(spark, SF), *D.dag_summary(spark, SF), *D.dag_graph(spark, SF), D.purchase_pairs(spark, SF)[0]]
    assert not [f for t in tables for f in t.inputFiles() if "lineitem" in f]


def test_flow_of_a_forest_needs_no_shares(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a forest has no shared vertex")

    e = spark.createDataFrame([(1, "source", "a", "r", "x", "role"), (1, "source", "b", "x", "y", "role")],
                              "doc_id long, component string, edge_id string, parent_id string, child_id string, edge_type string")
    inflow = spark.createDataFrame([(1, "source", "y", 2.0), (1, "source", "x", 1.0)], "doc_id long, component string, node_id string, capacity double")
    top = spark.createDataFrame([(1, "source", "r")], "doc_id long, component string, node_id string")
    monkeypatch.setattr(W, "parent_shares", none)
    got = {r["child_id"]: r["flow"] for r in W.saturated_flow(e, inflow, top).collect()}
    assert got == {"x": 3.0, "y": 2.0, "r": 3.0}
    assert TR.climb(e).other.isEmpty()
