"""Small graphs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.operators import coref as C
from weftgraph.operators import flow as W
from weftgraph.operators import maxflow as M
from weftgraph.operators import results as R
from weftgraph.operators.graph import descendants, roots
from weftgraph.operators.similarity import node_similarity
from weftgraph.plans.align import align, align_one
from weftgraph.settings import AlignSettings

NODES = "doc_id string, component string, node_id long, attrib_type string, descr string, is_root boolean"
EDGES = "doc_id string, component string, edge_id long, parent_id long, child_id long, edge_type string"
ALIGN = "doc_id string, src_node long, smy_node long, sim double, capacity double"


def graph(spark, doc, source, summary, links, extra_nodes=()):
    """Tables of one document; components are ``[(id, type)]`` and ``[(parent, child, type)]``."""
    nodes, edges = [], []
    for name, (vs, es) in (("source", source), ("summary", summary)):
        nodes += [(doc, name, i, t, f"{name[:2]}{i}", i == 0) for i, t in vs]
        edges += [(doc, name, n, p, c, t) for n, (p, c, t) in enumerate(es)]
    rows = [(doc, s, m, float(c), float(c)) for s, m, c in links]
    return (spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES),
            spark.createDataFrame(rows, ALIGN))


T1_SOURCE = ([(0, "doc"), (1, "sentence"), (2, "concept"), (3, "concept"), (4, "attribute")],
             [(0, 1, "sentence"), (1, 2, "sentence"), (2, 3, "role"), (2, 4, "role")])
T1_SUMMARY = ([(0, "doc"), (1, "sentence"), (2, "concept"), (3, "concept")],
              [(0, 1, "sentence"), (1, 2, "sentence"), (2, 3, "role")])
T1_LINKS = [(1, 1, 0.8), (2, 2, 0.6), (3, 3, 0.5), (3, 2, 0.35)]


def flows_of(table, component):
    return {(r.child_id, r.parent_id): r.flow for r in table.where(F.col("component") == component).collect()}


def test_tree_document(spark):
    out = align(*graph(spark, "t1", T1_SOURCE, T1_SUMMARY, T1_LINKS))
    source, summary = flows_of(out.edge_flows, "source"), flows_of(out.edge_flows, "summary")
    assert source == pytest.approx({(3, 2): 0.85, (4, 2): 0.0, (2, 1): 1.45 / 3, (1, 0): 0.5625, (0, None): 0.45})
    assert summary == pytest.approx({(3, 2): 0.5, (2, 1): 0.725, (1, 0): 0.75, (0, None): 0.5625})
    agg = out.stats().first()
    assert agg.aligned_portion_hmean == pytest.approx(0.857143, abs=1e-6)
    assert agg.aligned_portion == pytest.approx(6 / 7)
    assert agg.mean_flow == pytest.approx(0.50625)
    assert source[(0, None)] * 5 == pytest.approx(summary[(0, None)] * 4)
    frame = {r.component: r for r in out.stats_frame().collect()}
    assert (frame["source"].aligned, frame["source"].alignable) == (3, 4)
    assert (frame["summary"].aligned, frame["summary"].alignable) == (3, 3)


def test_exact_flow_matches_closed_form_on_the_tree(spark):
    nodes, edges, links = graph(spark, "t1", T1_SOURCE, T1_SUMMARY, T1_LINKS)
    links = links.withColumn("rel_id", F.lit(None).cast("long"))
    flows = M.max_flow(W.build_network(nodes, edges, links, "source"))
    assert M.max_flow_value(flows).first()["value"] == pytest.approx(2.25)
    exact = flows_of(M.component_edge_flows(flows, edges), "source")
    inflow = W.orient(links, "source").select("doc_id", "component", F.col("to_id").alias("node_id"), "capacity")
    closed = W.saturated_flow(edges.where("component = 'source'"), inflow, roots(nodes).where("component = 'source'"))
    closed = flows_of(closed, "source")
    assert closed.pop((0, None)) == pytest.approx(2.25)
    assert exact == pytest.approx(closed)


R1_SOURCE = ([(0, "doc"), (1, "sentence"), (2, "concept"), (3, "concept"), (4, "concept")],
             [(0, 1, "sentence"), (1, 2, "sentence"), (2, 3, "role"), (2, 4, "role"), (4, 3, "role")])
R1_SUMMARY = ([(0, "doc"), (1, "concept")], [(0, 1, "sentence")])


def test_reentrant_document(spark):
    out = align(*graph(spark, "r1", R1_SOURCE, R1_SUMMARY, [(3, 1, 0.8)]))
    source = flows_of(out.edge_flows, "source")
    assert source == pytest.approx({(3, 2): 0.4, (3, 4): 0.4, (4, 2): 0.2, (2, 1): 0.8 / 3, (1, 0): 0.2, (0, None): 0.16})
    per = {r.component: r for r in out.component_stats().collect()}
    assert (per["source"].reentrancies, per["summary"].reentrancies) == (1, 0)
    flagged = out.flows().where("reentrancy").select("s_id").distinct().collect()
    assert [r.s_id for r in flagged] == [3]


def test_repair_of_the_reentrant_document(spark):
    nodes, edges, links = graph(spark, "r1", R1_SOURCE, R1_SUMMARY, [(3, 1, 0.8)])
    links = links.withColumn("rel_id", F.lit(None).cast("long"))
    reported, seen = M.repair_reentrancies(nodes, edges, links, "source", only_report=True)
    assert seen.count() == 1 and seen.first()["has_zero_flow"]
    flows, report = M.repair_reentrancies(nodes, edges, links, "source")
    got = flows_of(M.component_edge_flows(flows, edges), "source")
    assert got == pytest.approx({(3, 2): 0.4, (3, 4): 0.4, (4, 2): 0.4, (2, 1): 0.8, (1, 0): 0.8})
    assert M.max_flow_value(flows).first()["value"] == pytest.approx(0.8)


def test_cycle_document_ends_with_finite_flow(spark):
    vs, es = T1_SOURCE
    nodes, edges, links = graph(spark, "c1", (vs, es + [(3, 2, "role")]), T1_SUMMARY, T1_LINKS)
    out = align(nodes, edges, links)
    source = flows_of(out.edge_flows, "source")
    # the edge that closes the cycle carries nothing, the total is the tree's
    assert source[(2, 3)] == 0.0
    assert source[(0, None)] * 5 == pytest.approx(2.25)
    pairs = {(r.ancestor, r.node_id) for r in descendants(edges.where("component = 'source'")).collect()}
    assert {(2, 3), (3, 2), (2, 2), (3, 3), (0, 4)} <= pairs


def test_unfed_cycle_gets_no_flow(spark):
    """Nodes whose descendants all lie on a cycle cannot send anything."""
    source = ([(0, "doc"), (1, "concept"), (2, "concept"), (3, "concept")],
              [(0, 1, "role"), (1, 2, "role"), (2, 1, "role"), (0, 3, "role")])
    summary = ([(0, "doc"), (1, "concept")], [(0, 1, "sentence")])
    nodes, edges, links = graph(spark, "u1", source, summary, [(1, 1, 0.7), (3, 1, 0.5)])
    out = align(nodes, edges, links)
    assert flows_of(out.edge_flows, "summary")[(0, None)] * 2 == pytest.approx(0.5)
    exact = M.max_flow(W.build_network(nodes, edges, links.withColumn("rel_id", F.lit(None).cast("long")), "summary"))
    assert M.max_flow_value(exact).first()["value"] == pytest.approx(0.5)


def test_prune_document(spark):
    vs, es = T1_SOURCE
    source = (vs + [(5, "concept"), (6, "concept")], es + [(2, 5, "role"), (5, 6, "role")])
    out = align(*graph(spark, "p1", source, T1_SUMMARY, T1_LINKS + [(6, 3, 0.15)]))
    kept = {(r.src_node, r.smy_node): r.capacity for r in out.align_edges.collect()}
    assert kept == pytest.approx({(1, 1): 0.8, (2, 2): 0.6, (3, 3): 0.5, (3, 2): 0.35})


def test_documents_do_not_influence_each_other(spark):
    vs, es = T1_SOURCE
    one = graph(spark, "t1", T1_SOURCE, T1_SUMMARY, T1_LINKS)
    two = graph(spark, "p1", (vs + [(5, "concept"), (6, "concept")], es + [(2, 5, "role"), (5, 6, "role")]),
                T1_SUMMARY, T1_LINKS + [(6, 3, 0.15)])
    three = graph(spark, "none", T1_SOURCE, T1_SUMMARY, [])
    both = [a.unionByName(b).unionByName(c) for a, b, c in zip(one, two, three)]
    out = align(*both)
    alone = flows_of(align(*two).edge_flows, "source")
    assert flows_of(out.edge_flows.where("doc_id = 'p1'"), "source") == pytest.approx(alone)
    assert set(flows_of(out.edge_flows.where("doc_id = 'none'"), "source").values()) == {0.0}
    stats = {r.doc_id: r for r in out.stats().collect()}
    assert stats["t1"].mean_flow == pytest.approx(0.50625)
    assert (stats["none"].tot_aligned, stats["none"].aligned_portion_hmean) == (0, 0.0)
    single = align_one(*both, "t1")
    assert single.stats().first().mean_flow == pytest.approx(0.50625)
    with pytest.raises(ValueError):
        align_one(*both, "missing")


def test_scalars(spark):
    row = spark.range(1).select(
        V.sigmoid_skew(F.lit(1.0)).alias("a"), V.sigmoid_skew(F.lit(0.0)).alias("b"),
        V.sentence_skew(F.lit(0.6)).alias("c"),
        node_similarity(F.lit(0.9), F.lit(1.0)).alias("d"),
        V.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("e"),
        V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(1.0))).alias("f"),
        V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)), exponent=2.0).alias("g")).first()
    assert row.a == pytest.approx(0.122459, abs=1e-6)
    assert row.b == pytest.approx(-0.122459, abs=1e-6)
    assert row.c == pytest.approx(0.8)
    assert row.d == pytest.approx(0.932459, abs=1e-6)
    assert row.d * row.c == pytest.approx(0.745967, abs=1e-6)
    assert (row.e, row.f) == (0.0, 0.0)
    assert row.g == pytest.approx(0.36)


def test_harmonic_mean_of_portions(spark):
    def hm(values, mode):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        return df.agg(R.harmonic_mean(F.col("v"), mode).alias("h")).first().h

    assert hm([0, 1], "reference") == pytest.approx(2.0)
    assert hm([0, 1], "strict") == 0.0
    assert hm([0, 0], "reference") == hm([0, 0], "strict") == 0.0
    assert hm([0.75, 1.0], "strict") == pytest.approx(0.857143, abs=1e-6)
    assert hm([], "strict") != hm([], "strict")
    # published document statistics
    assert hm([10 / 13, 8 / 8], "strict") == pytest.approx(0.8695652173913044)
    assert hm([30 / 51, 17 / 21], "strict") == pytest.approx(0.6813627254509017)


def test_coreference(spark):
    nodes = spark.createDataFrame(
        [("k1", "source", 1, "concept", 0, "x"), ("k1", "source", 2, "concept", 1, "y"), ("k1", "summary", 9, "concept", 0, "z")],
        "doc_id string, component string, node_id long, attrib_type string, sent_ix long, variable string")
    links = spark.createDataFrame([("k1", 1, 9, 0.7, 0.7)], ALIGN)
    schema = "doc_id string, rel_id long, component string, sent_ix long, variable string"
    inner = spark.createDataFrame([("k1", 1, "source", 0, "x"), ("k1", 1, "source", 1, "y")], schema)
    out = {(r.src_node, r.smy_node, r.rel_id, r.is_bipartite): r.capacity for r in C.add_coref(links, inner, nodes).collect()}
    assert out == {(1, 9, None, None): 0.7, (2, 9, 1, False): 0.7}
    spanning = spark.createDataFrame([("k1", 2, "source", 0, "x"), ("k1", 2, "summary", 0, "z")], schema)
    out = {(r.src_node, r.smy_node, r.rel_id, r.is_bipartite): r.capacity for r in C.add_coref(links, spanning, nodes).collect()}
    assert out == {(1, 9, 2, True): 1.0}
    assert C.bipartite_relations(inner.unionByName(spanning)).collect()[0].rel_id == 2


def test_identical_sides_align_fully(spark):
    links = [(i, i, 1.0) for i in (1, 2, 3)]
    out = align(*graph(spark, "dup", T1_SUMMARY, T1_SUMMARY, links))
    assert out.stats().first().aligned_portion == 1.0


def test_settings_are_checked():
    with pytest.raises(ValueError):
        AlignSettings(sentence_dampen=1.5)
    with pytest.raises(ValueError):
        AlignSettings(neighbor_direction="sideways")
    with pytest.raises(ValueError):
        AlignSettings(similarity_dampen_exp={"verse": 1.0})
    with pytest.raises(ValueError):
        AlignSettings().with_values(colour=1)
    assert AlignSettings().with_values(max_loops=2).max_loops == 2


def test_discount_and_gaps(spark):
    nodes, edges, links = graph(spark, "t1", T1_SOURCE, T1_SUMMARY, T1_LINKS)
    flows = edges.withColumn("flow", F.when(F.col("child_id") == 3, 2.0).otherwise(0.5)).withColumn("capacity", F.lit(2.0))
    pointed = W.orient(links.withColumn("flow", F.col("capacity")), "source")
    out = W.discount_flow(flows, pointed, 1.0).where("to_id = 3").agg(F.sum("capacity").alias("s")).first()
    assert out.s == pytest.approx(1.0)
    assert W.flow_gaps(flows).where("component = 'source'").count() == 3


def test_reduced_graph(spark):
    out = align(*graph(spark, "t1", T1_SOURCE, T1_SUMMARY, T1_LINKS))
    nodes, edges, links = R.reduce_graph(out.nodes, out.edge_flows, out.align_edges)
    left = {(r.component, r.node_id) for r in nodes.collect()}
    assert ("source", 4) not in left and ("source", 3) in left
    assert edges.where("edge_type = 'terminal'").isEmpty() and links.count() == 4
    everything = R.reduce_graph(out.nodes, out.edge_flows, out.align_edges, prune=False)
    assert everything[0].count() == 9
