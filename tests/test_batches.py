import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import flow as W
from weftgraph.operators import graph as G
from weftgraph.operators import maxflow as M
from weftgraph.operators import scoring as E
from weftgraph.operators import similarity as S
from weftgraph.operators import trees as TR
from weftgraph.operators.batches import in_batches
from weftgraph.settings import AlignSettings


def test_batches_hold_whole_groups(spark):
    rows = [(k if k else None, i) for k in range(60) for i in range(1 + k * 7 % 23)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(3)

    def solve(table, starts):
        ends = [*starts[1:], table.num_rows]
        return pa.table({"k": table.column("k").take(pa.array(starts)), "n": pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                         "many": pa.array([len(starts) > 1] * len(starts))})

    got = in_batches(df, ["k"], solve, "k long, n long, many boolean", batch_rows=40).collect()
    want = {}
    for k, _ in rows:
        want[k] = want.get(k, 0) + 1
    assert len(got) == len(want) and {r.k: r.n for r in got} == want
    assert all(r.many for r in in_batches(df.coalesce(1), ["k"], solve, "k long, n long, many boolean").collect())


def _networks(seed, docs):
    rng, rows = random.Random(seed), []
    for d in range(docs):
        names = [f"v{i}" for i in range(rng.randint(2, 8))]
        for i, a in enumerate(["S", *names]):
            for b in [*names[i:], "T"]:
                if rng.random() < 0.5:
                    rows.append((f"d{d}", a, b, rng.choice([0.0, 0.2, 1.0, 2.5, 1e10]), "role", "source", f"{a}-{b}"))
    return rows


def test_small_documents_are_solved_many_at_a_time(spark):
    schema = "doc_id string, from_key string, to_key string, capacity double, edge_type string, component string, edge_id string"
    net = spark.createDataFrame(_networks(5, 40), schema)
    solved = M.max_flow(net)
    # one call per document took most of the time of a table of many small ones
    plan = solved._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    key = lambda r: (r.doc_id, r.edge_id)
    together, spread = ({key(r): r for r in t.collect()} for t in (solved, M.spread_max_flow(net)))
    assert together.keys() == spread.keys() and len(together) == net.count()
    for k, r in together.items():
        assert r.flow == pytest.approx(spread[k].flow, abs=1e-6), k
        assert (r.in_cut, r.source_side) == (spread[k].in_cut, spread[k].source_side)
    proofs = M.cut_certificate(solved).where(F.col("cut") < 1e9).collect()
    assert proofs and all(r.certified for r in proofs)


def _pairs(seed, n):
    rng, rows = random.Random(seed), []
    for p in range(n):
        for side in "ab":
            ids = list(range(rng.randint(1, 5)))
            rows += [(p, side, "instance", ":instance", x, None, rng.choice("xyz")) for x in ids]
            rows += [(p, side, "relation", rng.choice([":r", ":s"]), x, rng.choice(ids), "") for x in ids[1:]]
    return rows


def test_pairs_are_searched_many_at_a_time(spark):
    triples = spark.createDataFrame(_pairs(3, 25), "pair_id long, side string, kind string, role string, x long, y long, label string")
    found = E.best_matching(triples)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    unary, joint = E.matching_gains(triples)
    one, two = {}, {}
    for r in unary.collect():
        one.setdefault(r.pair_id, {})[r.x, r.u] = r.gain
    for r in joint.collect():
        two.setdefault(r.pair_id, {})[r.x, r.u, r.y, r.v] = r.gain
    want = {}
    for p in one.keys() | two.keys():
        a, b = dict(sorted(one.get(p, {}).items())), dict(sorted(two.get(p, {}).items()))
        want[p] = E.matching_bounds(a, b, *E._climb(a, b, 4, 7), 40)
    got = {r.pair_id: (r.matched, r.upper, {m.x: m.u for m in r.mapping}) for r in found.collect()}
    assert got == {p: (low, high, {x: u for x, u in m.items() if u is not None}) for p, (low, high, m) in want.items()}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_ngrams_are_not_shuffled(spark):
    rng, rows = random.Random(2), []
    text = lambda: [rng.choice("abc") for _ in range(rng.randint(0, 9))]
    for p in [*range(30), 3, 4, 4, None, None]:
        rows.append((p, text() if rng.random() < 0.9 else None, text()))
    rows.append((77, [], []))
    df = spark.createDataFrame(rows, "pair_id long, a array<string>, b array<string>").repartition(3)
    found = E.ngram_matches(df, range(1, 5))
    assert "Generate" not in _plan(found)
    want = {}
    for p, a, b in rows:
        for side, words in enumerate((a or [], b or [])):
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    c = want.setdefault((p, n), ({}, {}))[side]
                    c[tuple(words[i:i + n])] = c.get(tuple(words[i:i + n]), 0) + 1
    want = {k: (sum(min(c, b.get(g, 0)) for g, c in a.items()), sum(a.values()), sum(b.values())) for k, (a, b) in want.items()}
    assert {(r.pair_id, r.n): (r.match, r.total_a, r.total_b) for r in found.collect()} == want


def test_ngrams_in_slices(spark, monkeypatch):
    rows = [(p, list("abcabc")[p % 4:], list("bcab")) for p in range(20)]
    df = spark.createDataFrame(rows, "pair_id long, a array<string>, b array<string>").toPandas()
    table = pa.table({"pair_id": pa.array(df.pair_id), "a": pa.array(df.a.tolist()), "b": pa.array(df.b.tolist())})
    starts = np.arange(20)
    whole = E._count_grams([1, 2, 3], table, starts).to_pylist()
    monkeypatch.setattr(E, "GRAM_TOKENS", 7)
    parts = E._count_grams([1, 2, 3], table, starts).to_pylist()
    order = lambda r: (r["pair_id"], r["n"])
    assert sorted(parts, key=order) == sorted(whole, key=order) and len(whole) == 60


def _graphs(spark):
    rng, nodes, edges = random.Random(4), [], []
    for p in range(20):
        for side in "ab":
            ids = [i % 6 for i in range(rng.randint(1, 7))]  # one id may come twice
            nodes += [(p if p else None, side if p != 1 else None, i, rng.choice(["x", "y", None])) for i in ids]
            edges += [(p if p else None, side, rng.choice(ids), rng.choice([*ids, 99, None]), rng.choice(["r", "s", None])) for _ in ids]
    edges.append((50, "a", 1, 2, "r"))  # a pair without nodes
    return (spark.createDataFrame(nodes, "pair_id long, side string, node_id long, label string").repartition(3),
            spark.createDataFrame(edges, "pair_id long, side string, parent_id long, child_id long, role string").repartition(3))


@pytest.mark.parametrize("directed", [True, False])
def test_pairs_of_graphs_are_shuffled_once(spark, directed):
    nodes, edges = _graphs(spark)
    found = E._dots(nodes, edges, 2, directed)
    assert _plan(found).split("== Optimized")[1].count("RepartitionByExpression") == 1
    rows = lambda t: sorted(map(tuple, t.collect()), key=lambda r: (r[0] is not None, r))
    assert rows(found) == rows(E._spread_dots(nodes, edges, 2, directed))
    some = {r.pair_id: r.wlk for r in E.wlk(nodes, edges, directed=directed).collect()}
    assert some == pytest.approx({r.pair_id: r.wlk for r in E.wlk(nodes, edges, directed=directed, pair_rows=9).collect()})


def test_components_of_small_graphs_take_no_rounds(spark):
    rng = random.Random(6)
    rows = [(d if d else None, "c", rng.choice([*range(9), None]), rng.randint(0, 12)) for d in range(30) for _ in range(rng.randint(1, 9))]
    rows += [(99, "c", i, i + 1) for i in range(40)]
    edges = spark.createDataFrame(rows, "doc_id long, component string, parent_id long, child_id long").repartition(3)
    got = {(r.doc_id, r.node_id): r.component_root for r in G.weak_components(edges).collect()}
    near = {}
    for d, _, a, b in rows:
        if d is not None and a is not None:
            near.setdefault((d, a), set()).add((d, b))
            near.setdefault((d, b), set()).add((d, a))
    want = {}
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
        want[v] = min(seen)[1]
    assert got == want
    assert got == {(r.doc_id, r.node_id): r.component_root for r in G.weak_components(edges, graph_edges=5).collect()}


def test_first_visits_are_counted_many_graphs_at_a_time(spark):
    edges = spark.createDataFrame([(d, "c", f"e{i}", f"v{i}", f"v{i + 1 + d % 2}") for d in range(9) for i in range(3)],
                                  "doc_id long, component string, edge_id string, parent_id string, child_id string")
    tops = spark.createDataFrame([(d, "c", "v0") for d in range(9)], "doc_id long, component string, node_id string")
    found = W.first_visit_counts(edges, tops)
    assert "FlatMapGroupsInPandas" not in _plan(found) and found.count() == 36
    rows = lambda t: sorted((r.doc_id, r.edge_id or "", r.n_desc) for r in t.collect())
    assert rows(found) == rows(W.first_visit_counts(edges, tops, group_edges=0))


@pytest.mark.parametrize("direction", ["all", "descendant", "ancestor"])
def test_rings_of_small_graphs_are_found_together(spark, monkeypatch, direction):
    rng, nodes, edges = random.Random(8), [], []
    for d in range(12):
        n = rng.randint(1, 9)
        nodes += [(d, "c", f"n{i}", [rng.random(), float(i)]) for i in range(n)]
        links = {(rng.randrange(i), i) for i in range(1, n)} | {(rng.randrange(i), i) for i in range(1, n) if d % 2}
        edges += [(d, "c", f"n{a}", f"n{b}") for a, b in sorted(links)]
    nodes = spark.createDataFrame(nodes, "doc_id long, component string, node_id string, vec array<double>").repartition(3)
    edges = spark.createDataFrame(edges, "doc_id long, component string, parent_id string, child_id string").repartition(3)
    settings = AlignSettings(neighbor_direction=direction, neighbor_weights=(0.0, 1.0, 0.5, 0.25))
    rows = lambda t: {(r.doc_id, r.node_id): [round(x, 9) for x in r.nvec] for r in t.collect()}
    found = S.neighborhood_vector(nodes, edges, 2, settings)
    plan = _plan(found)
    assert "MapInArrow" in plan and found.count() == nodes.count()
    together = rows(found)
    monkeypatch.setattr(S, "DENSE_ROWS", 0)
    assert together == rows(S.neighborhood_vector(nodes, edges, 2, settings))


def test_flow_value_reads_only_what_it_names(spark):
    schema = "doc_id string, from_key string, to_key string, capacity double, edge_type string, component string, edge_id string"
    net = spark.createDataFrame(_networks(9, 12), schema)
    few = M.max_flow(net, columns=("doc_id", "to_key", "flow"))
    assert few.columns == ["doc_id", "to_key", "flow"]
    values = lambda t: {r.doc_id: r.value for r in M.max_flow_value(t).collect()}
    assert values(few) == pytest.approx(values(M.max_flow(net)))
    assert values(M.max_flow(net, group_edges=4, columns=("doc_id", "to_key", "flow"))) == pytest.approx(values(few), abs=1e-6)


def test_paths_are_summed_together(spark):
    parents = spark.createDataFrame([("g", "c", i, (i - 1) // 2) for i in range(1, 9)], "doc_id string, component string, node_id long, up long")
    values = spark.createDataFrame([("g", "c", i, i, 1) for i in range(9)], "doc_id string, component string, node_id long, a long, b long")
    got = {r.node_id: (r.a, r.b) for r in TR.path_sums(parents, values, "a", "b").collect()}
    assert got[7] == (7 + 3 + 1, 4) and got[0] == (0, 1) and got[6] == (6 + 2, 3) and len(got) == 9
