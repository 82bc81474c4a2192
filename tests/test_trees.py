"""Trees by doubling: against plain walks, on long chains and on circles."""

import collections
import random

from pyspark.sql import functions as F

from weftgraph.operators import flow as W
from weftgraph.operators import graph as G
from weftgraph.operators import similarity as S
from weftgraph.operators import trees as T

EDGE = "doc_id long, component string, edge_id long, parent_id long, child_id long, edge_type string"


def edges(spark, links):
    return spark.createDataFrame([(d, "source", i, p, c, "role") for i, (d, p, c) in enumerate(links)], EDGE)


def random_trees(rng, n_docs, n):
    return [(d, rng.randint(0, c - 1), c) for d in range(n_docs) for c in range(1, n)]


def nodes_of(links):
    return sorted({(d, v) for d, p, c in links for v in (p, c)})


def frame(spark, rows, columns="doc_id long, node_id long"):
    return spark.createDataFrame(rows, columns).withColumn("component", F.lit("source"))


def test_index_sums_and_marks(spark):
    rng = random.Random(5)
    links = random_trees(rng, 6, 40)
    e = edges(spark, links)
    parents, extra = T.forest(e)
    assert extra.isEmpty() and parents.count() == len(links)
    below = collections.defaultdict(set)
    up = {(d, c): p for d, p, c in links}
    for d, v in nodes_of(links):
        at = v
        while at is not None:
            below[d, at].add(v)
            at = up.get((d, at))
    n = frame(spark, nodes_of(links))
    index = {(r.doc_id, r.node_id): r for r in T.tree_index(n, parents).collect()}
    for d, v in below:
        r = index[d, v]
        assert {u for x, u in below if x == d and r["first"] <= index[x, u]["first"] <= r["last"]} == below[d, v]
        assert r["last"] - r["first"] + 1 == len(below[d, v])
    for d in range(6):
        assert sorted(r["first"] for (x, _), r in index.items() if x == d) == list(range(40))
    values = frame(spark, [(d, v, float(v)) for d, v in nodes_of(links)], "doc_id long, node_id long, x double")
    got = {(r.doc_id, r.node_id): r.x for r in T.subtree_sums(parents, values, ["x"]).collect()}
    assert got == {k: float(sum(v)) for k, v in below.items()}
    marks = [(1, 3), (1, 7), (4, 0), (5, 39)]
    got = {(r.doc_id, r.node_id) for r in T.at_or_below(parents, frame(spark, marks)).collect()}
    assert got == {(d, u) for d, v in marks for u in below[d, v]}


def test_chain_of_a_hundred_thousand(spark):
    n = 100_000
    chain = spark.range(1, n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("source").alias("component"),
                                     F.col("id").alias("edge_id"), (F.col("id") - 1).alias("parent_id"),
                                     F.col("id").alias("child_id"), F.lit("role").alias("edge_type"))
    top = frame(spark, [(1, 0)])
    counts = W.descendant_counts(chain, top)
    assert counts.where(F.col("n_desc") != n - F.col("node_id")).count() == 0 and counts.count() == n
    flows = chain.withColumn("flow", F.when(F.col("child_id") == 60_000, 0.01).otherwise(1.0))
    hit = W.prune_targets(flows, None, 0.1, chain)
    assert hit.agg(F.min("node_id"), F.max("node_id"), F.count("*")).first() == (60_000, n - 1, n - 60_000)


def test_circles_and_several_parents(spark):
    links = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4), (2, 5, 6), (2, 6, 5), (2, 6, 7), (3, 1, 3), (3, 2, 3), (3, 3, 4),
             (4, 1, 1), (4, 1, 2)]
    parents, extra = T.forest(edges(spark, links))
    tree = {(r.doc_id, r.up, r.node_id) for r in parents.collect()}
    rest = {(r.doc_id, r.parent_id, r.child_id) for r in extra.collect()}
    assert tree | rest == set(links) and not tree & rest
    for d, _, v in tree:  # every way up ends
        seen = set()
        while (v := next((p for x, p, c in tree if (x, c) == (d, v)), None)) is not None:
            assert v not in seen
            seen.add(v)
    assert {x for x in rest if x[0] == 3} == {(3, 2, 3)} and len([x for x in rest if x[0] == 2]) == 1


def test_counts_agree_with_the_closure(spark):
    rng = random.Random(7)
    links = random_trees(rng, 3, 20) + [(9, rng.randint(0, c - 1), c) for c in range(1, 15)] + [(9, 2, 14), (9, 1, 9)]
    e = edges(spark, sorted(set(links)))
    tops = frame(spark, [(d, 0) for d in (0, 1, 2, 9)] + [(11, 5)])
    want = sorted(map(tuple, W.descendant_counts(e, tops, G.descendants(e)).collect()))
    assert sorted(map(tuple, W.descendant_counts(e, tops).collect())) == want
    flows = e.withColumn("flow", (F.col("child_id") % 5).cast("double"))
    got = {(r.doc_id, r.node_id) for r in W.prune_targets(flows, None, 1.0, e).collect()}
    assert got == {(r.doc_id, r.node_id) for r in W.prune_targets(flows, G.descendants(e), 1.0).collect()}


def plain_rings(links, k):
    """Vertices at exactly 1..k hops, by walking from every vertex."""
    near = collections.defaultdict(set)
    for d, p, c in links:
        near[d, p].add(c)
        near[d, c].add(p)
    out = {}
    for d, v in near:
        seen, ring = {v}, {v}
        for hop in range(1, k + 1):
            ring = {u for x in ring for u in near[d, x]} - seen
            seen |= ring
            out[d, v, hop] = ring
    return out


def test_rings_of_graphs_with_several_parents(spark):
    rng = random.Random(11)
    links = set(random_trees(rng, 2, 30))
    for d, extra in ((0, 6), (1, 25)):
        links |= {(d, *sorted(rng.sample(range(30), 2))) for _ in range(extra)}
    links |= {(2, 0, 1), (2, 1, 2), (2, 2, 0), (2, 2, 3), (2, 0, 4), (3, 0, 1), (3, 2, 1), (3, 3, 3), (3, 1, 3)}
    e = edges(spark, sorted(links))
    own = frame(spark, [(d, v, [float(v), 1.0]) for d, v in nodes_of(links)], "doc_id long, node_id long, vec array<double>")
    got = {(r.doc_id, r.node_id, r.hops): (round(r.vec[0], 6), r.n) for r in S.neighbor_sums(own, e, 2, 3).collect()}
    want = {k: (float(sum(ring)), len(ring)) for k, ring in plain_rings([x for x in links if x[1] != x[2]], 3).items() if ring}
    assert got == want
    rings = plain_rings([x for x in links if x[1] != x[2]], 3)
    vectors = {(r.doc_id, r.node_id): r.nvec for r in S.neighborhood_vector(own, e, 2).collect()}
    for (d, v), vec in vectors.items():
        plain = sum(w * sum(rings[d, v, h]) / len(rings[d, v, h]) for h, w in ((1, 1.0), (2, 0.1), (3, 0.1)) if rings.get((d, v, h)))
        assert abs(vec[0] - plain) < 1e-6


def test_one_reentrancy_among_many_sentences_lists_few_pairs(spark):
    n, links = 3000, []
    for s in range(1, n + 1):  # the root, sentences, and three concepts in each
        links += [(1, 0, s), (1, s, n + 3 * s), (1, n + 3 * s, n + 3 * s + 1), (1, n + 3 * s, n + 3 * s + 2)]
    links.append((1, n + 3 * 7 + 1, n + 3 * 7 + 2))  # one concept has a second parent
    e = edges(spark, links)
    tree, extra = T.forest(e)
    moved = S.ring_corrections(e.select("doc_id", "component", "parent_id", "child_id"), tree, extra, 3)
    assert extra.count() == 1 and 0 < moved.count() < len(links)
    links += [(1, 0, n + 3 * 9 + 2)]  # and one hangs from the root itself, next to all sentences
    e = edges(spark, links)
    tree, extra = T.forest(e)
    assert S.ring_corrections(e.select("doc_id", "component", "parent_id", "child_id"), tree, extra, 3).count() < 5 * len(links)
