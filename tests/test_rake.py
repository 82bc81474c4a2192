"""Leaves taken off layer by layer: same results as plain walks, over tables that shrink."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import flow as W
from weftgraph.operators import graph as G
from weftgraph.operators import trees as T

EDGE = "doc_id long, component string, edge_id long, parent_id long, child_id long, edge_type string"


def frame(spark, links):
    return spark.createDataFrame([(d, "source", i, p, c, "role") for i, (d, p, c) in enumerate(links)], EDGE)


def bushy(n_docs=2, fan=7):
    """Three levels, ``fan`` children each, and a tail of twenty vertices below one leaf."""
    links = []
    for d in range(n_docs):
        n, level = 1, [0]
        for _ in range(3):
            nxt = []
            for v in level:
                for _ in range(fan):
                    links.append((d, v, n))
                    nxt.append(n)
                    n += 1
            level = nxt
        at = level[0]
        for _ in range(20):
            links.append((d, at, n))
            at, n = n, n + 1
    return links


@pytest.fixture
def written(monkeypatch):
    """Rows of all tables that are written, and their plans."""
    rows, plans = [], []
    plain = G.materialize

    def counted(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = plain(df, *args, **kwargs)
        rows.append(out.count())
        return out

    for module in (G, T, W):
        monkeypatch.setattr(module, "materialize", counted)
    return rows, plans


def labels_of(links):
    near = collections.defaultdict(set)
    for d, p, c in links:
        near[d, p].add((d, c))
        near[d, c].add((d, p))
    out = {}
    for v in sorted(near):
        todo = [v] if v not in out else []
        while todo:
            u = todo.pop()
            if u not in out:
                out[u] = v[1]
                todo.extend(near[u])
    return out


def components(spark, links):
    rows = G.weak_components(frame(spark, links)).collect()
    got = {(r.doc_id, r.node_id): r.component_root for r in rows}
    assert len(got) == len(rows)
    return got


def test_components_write_every_edge_few_times(spark, written):
    links = bushy()
    assert components(spark, links) == labels_of(links)
    assert sum(written[0]) < 5 * len(links)


def test_components_of_any_graph(spark):
    rng = random.Random(3)
    names = list(range(60))
    rng.shuffle(names)  # parents are not always smaller
    trees = [(d, names[rng.randint(0, c - 1)], names[c]) for d in range(3) for c in range(1, 60) if rng.random() < 0.9]
    circles = [(4, 1, 2), (4, 2, 3), (4, 3, 1), (4, 3, 9), (4, 9, 8), (5, 7, 7), (6, 5, 4), (6, 5, 4)]
    several = [(7, 1, 3), (7, 2, 3), (7, 3, 0)]
    for links in (trees, trees + circles, trees + circles + several, several):
        assert components(spark, links) == labels_of(links)


def pairs_of(links):
    below = collections.defaultdict(list)
    for d, p, c in set(links):
        below[d, p].append(c)
    out = {}
    for d, a in below:
        seen, step, hops = {}, [a], 0
        while step:
            hops += 1
            step = [c for v in step for c in below.get((d, v), ()) if c not in seen]
            seen.update(dict.fromkeys(step, hops))
            step = list(dict.fromkeys(step))
        out.update({(d, a, c): h for c, h in seen.items()})
    return out


def closure(spark, links):
    rows = G.descendants(frame(spark, links)).collect()
    got = {(r.doc_id, r.ancestor, r.node_id): r.hops for r in rows}
    assert len(got) == len(rows)
    return got


def test_descendants_of_trees_compare_nothing(spark, written):
    links = bushy(1, 3)
    assert closure(spark, links) == pairs_of(links)
    assert not any("LeftAnti" in p for p in written[1])


def test_descendants_on_circles_with_tails(spark):
    links = bushy(1, 2) + [(3, 1, 2), (3, 2, 3), (3, 3, 1), (3, 3, 9), (3, 9, 8), (3, 8, 7), (4, 5, 5), (4, 5, 6), (5, 1, 2), (5, 1, 2)]
    assert closure(spark, links) == pairs_of(links)


def test_flow_counts_and_marks_of_trees(spark, written):
    links = bushy()
    e = frame(spark, links)
    up = {(d, c): p for d, p, c in links}
    inflow = [(d, c, float(c % 5 + 1)) for d, _, c in links if c % 3] + [(0, 0, 2.0), (9, 1, 4.0), (9, 2, 5.0)]
    mass, below = collections.Counter(), collections.defaultdict(set)
    for d, v, x in inflow:
        while v is not None:
            mass[d, v] += x
            v = up.get((d, v))
    for d, v in {(d, v) for d, p, c in links for v in (p, c)}:
        at = v
        while at is not None:
            below[d, at].add(v)
            at = up.get((d, at))
    tops = spark.createDataFrame([(0, "source", 0), (1, "source", 0), (9, "source", 1), (9, "source", 3)],
                                 "doc_id long, component string, node_id long")
    fed = spark.createDataFrame([(d, "source", v, x) for d, v, x in inflow],
                                "doc_id long, component string, node_id long, capacity double")
    flows = W.saturated_flow(e, fed, tops)
    got = {(r.doc_id, r.child_id, r.parent_id, r.edge_id, r.edge_type): r.flow for r in flows.collect()}
    want = {(d, c, p, i, "role"): mass[d, c] for i, (d, p, c) in enumerate(links)}
    want |= {(d, v, None, None, "terminal"): mass[d, v] for d, v in ((0, 0), (1, 0), (9, 1), (9, 3))}
    assert got == want and flows.count() == len(want)
    rows = W.descendant_counts(e, tops).collect()
    assert {(r.doc_id, r.node_id): r.n_desc for r in rows} == {**{k: len(v) for k, v in below.items()}, (9, 1): 1, (9, 3): 1}
    assert len(rows) == len(below) + 2
    assert sum(written[0]) < 12 * len(links)  # flow and counts of chains and bushes together
    marks = [(0, 1), (0, 9), (1, len(up) // 2)]
    hit = T.at_or_below(T.climb(e), spark.createDataFrame([(d, "source", v) for d, v in marks], tops.schema))
    assert sorted((r.doc_id, r.node_id) for r in hit.collect()) == sorted({(d, v) for d, m in marks for v in below[d, m]})
