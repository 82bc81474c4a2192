"""Laws on random graphs, and operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.operators import flow as W
from weftgraph.operators import graph as G
from weftgraph.operators import maxflow as M
from weftgraph.operators import similarity as S
from weftgraph.settings import AlignSettings
from weftgraph.skew import join_salted, join_split, with_totals
from weftgraph.sources import corpus as K
from weftgraph.sources import graph_text as T
from weftgraph.sources import sinks
from weftgraph.streaming.incremental import align_arrivals, align_incremental

EDGES = "doc_id string, component string, edge_id long, parent_id long, child_id long, edge_type string"


def random_dags(seed, docs, extra):
    """Rooted graphs: a random tree plus some forward edges, two components per document."""
    rng, edges, links = random.Random(seed), [], []
    for d in range(docs):
        size = {}
        for comp in ("source", "summary"):
            n = size[comp] = rng.randint(3, 9)
            es = [(rng.randrange(i), i) for i in range(1, n)]
            es += [tuple(sorted(rng.sample(range(n), 2))) for _ in range(extra)]
            edges += [(f"d{d}", comp, k, p, c, "role") for k, (p, c) in enumerate(sorted(set(es)))]
        pairs = {(rng.randrange(size["source"]), rng.randrange(size["summary"])) for _ in range(6)}
        links += [(f"d{d}", s, m, None, round(rng.random(), 3)) for s, m in sorted(pairs)]
    return edges, links


def tables(spark, edges, links):
    e = spark.createDataFrame(edges, EDGES)
    ends = sorted({(d, c, v) for d, c, _, p, q, _ in edges for v in (p, q)})
    n = spark.createDataFrame([(d, c, v, v == 0, "concept") for d, c, v in ends],
                              "doc_id string, component string, node_id long, is_root boolean, attrib_type string")
    a = spark.createDataFrame(links, "doc_id string, src_node long, smy_node long, rel_id long, capacity double")
    return n, e, a


@pytest.fixture(scope="module")
def dags(spark):
    edges, links = random_dags(11, 12, 3)
    return edges, links, tables(spark, edges, links)


def test_exact_flow_is_saturated_and_conserved(spark, dags):
    edges, links, (n, e, a) = dags
    flows = M.max_flow(W.build_network(n, e, a, "source")).collect()
    total = {}
    for d, _, _, _, c in links:
        total[d] = total.get(d, 0.0) + c
    arrived, cut, balance = {}, {}, {}
    for r in flows:
        assert -1e-9 <= r.flow <= r.capacity + 1e-9
        if r.to_key == "T":
            arrived[r.doc_id] = arrived.get(r.doc_id, 0.0) + r.flow
        if r.in_cut:
            cut[r.doc_id] = cut.get(r.doc_id, 0.0) + r.capacity
        for key, sign in ((r.from_key, -1), (r.to_key, 1)):
            balance[(r.doc_id, key)] = balance.get((r.doc_id, key), 0.0) + sign * r.flow
    assert arrived == pytest.approx(total) and cut == pytest.approx(total)
    assert max(abs(v) for (_, k), v in balance.items() if k not in ("S", "T")) < 1e-9


def test_closed_form_carries_the_same_total(spark, dags):
    edges, links, (n, e, a) = dags
    inflow = W.orient(a, "source").select("doc_id", "component", F.col("to_id").alias("node_id"), "capacity")
    flows = W.saturated_flow(e.where("component = 'source'"), inflow, G.roots(n).where("component = 'source'"))
    got = {r.doc_id: r.flow for r in flows.where("edge_type = 'terminal'").collect()}
    want = {}
    for d, _, _, _, c in links:
        want[d] = want.get(d, 0.0) + c
    assert got == pytest.approx(want)


def test_flow_of_a_document_does_not_depend_on_the_others(spark):
    rows = [("x", "S", "a", 3.0), ("x", "S", "b", 1e10), ("x", "a", "b", 1.0), ("x", "a", "T", 1.0),
            ("x", "b", "T", 1.5), ("x", "b", "T", 0.25), ("y", "S", "a", 0.5), ("y", "a", "T", 2.0),
            ("z", "S", "a", 2.0), ("z", "a", "b", 1e10), ("z", "a", "c", 1e10), ("z", "b", "d", 0.25),
            ("z", "c", "e", 1e10), ("z", "e", "d", 1e10), ("z", "d", "T", 1e10)]
    net = spark.createDataFrame([(d, u, v, c, "e", "source", str(i)) for i, (d, u, v, c) in enumerate(rows)],
                                "doc_id string, from_key string, to_key string, capacity double, edge_type string, "
                                "component string, edge_id string")
    flows = lambda t: {(r.doc_id, r.edge_id): r.flow for r in t.collect()}
    solved = M.max_flow(net)
    together = flows(solved)
    assert {r.doc_id: r.value for r in M.max_flow_value(solved).collect()} == pytest.approx({"x": 2.75, "y": 0.5, "z": 2.0})
    # the same rounds as joins, one document by itself
    alone = flows(M.max_flow(net.where("doc_id = 'z'").repartition(3), group_edges=0))
    assert alone == pytest.approx({k: v for k, v in together.items() if k[0] == "z"})
    limited = {(r.doc_id, r.edge_id) for r in solved.where("in_cut").collect()}
    assert limited == {(r.doc_id, r.edge_id) for r in M.max_flow(net, group_edges=0).where("in_cut").collect()}


def reach(edges, doc, comp, start):
    out, todo = set(), [start]
    while todo:
        v = todo.pop()
        for d, c, _, p, q, _ in edges:
            if (d, c, p) == (doc, comp, v) and q not in out:
                out.add(q)
                todo.append(q)
    return out


def test_closure_rings_and_components(spark, dags):
    edges, _, (n, e, _) = dags
    got = {}
    for r in G.descendants(e).collect():
        got.setdefault((r.doc_id, r.component, r.ancestor), set()).add(r.node_id)
    for d, c, v in {(d, c, p) for d, c, _, p, _, _ in edges}:
        assert got[(d, c, v)] == reach(edges, d, c, v)
    one = e.withColumn("component", F.lit("all")).withColumn("doc_id", F.lit("g")).where("edge_id % 2 = 0")
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for r in one.collect():
        a, b = find(r.parent_id), find(r.child_id)
        parent[max(a, b)] = min(a, b)
    assert {r.node_id: r.component_root for r in G.weak_components(one).collect()} == {v: find(v) for v in list(parent)}


def test_ring_sums_equal_listed_rings_on_trees(spark):
    edges, _ = random_dags(4, 5, 0)
    n, e, _ = tables(spark, edges, [("d0", 0, 0, None, 1.0)])
    vec = F.array(*[(F.col("node_id") * k + 1).cast("double") for k in (1, 2, 3)])
    own = n.select("doc_id", "component", "node_id", vec.alias("vec"))
    for mode in ("all", "descendant", "ancestor"):
        summed = G.ring_sums(own, e, 3, 3, mode)
        listed = (G.k_hop(e, 3, mode).where("hops > 0").join(own, ["doc_id", "component", "node_id"])
                  .groupBy("doc_id", "component", F.col("center").alias("node_id"), "hops")
                  .agg(V.vector_sum("vec", 3).alias("vec"), F.count(F.lit(1)).alias("n")))
        key = lambda t: {(r.doc_id, r.component, r.node_id, r.hops): (r.n, [round(x, 6) for x in r.vec]) for r in t.collect()}
        assert key(summed) == key(listed)


def test_depth_first_counts(spark, dags):
    edges, _, (n, e, _) = dags
    def walk(doc, comp):
        kids = {}
        for d, c, k, p, q, _ in edges:
            if (d, c) == (doc, comp):
                kids.setdefault(p, []).append((k, q))
        seen, sizes = set(), {}
        def go(v):
            if v in seen:
                return {v}
            seen.add(v)
            below = {v}
            for k, q in sorted(kids.get(v, [])):
                sub = go(q)
                sizes[str(k)] = len(sub)
                below |= sub
            return below
        sizes[None] = len(go(0))
        return sizes
    got = {}
    for r in W.first_visit_counts(e, G.roots(n)).collect():
        got.setdefault((r.doc_id, r.component), {})[r.edge_id] = r.n_desc
    for (d, c), sizes in got.items():
        assert sizes == walk(d, c)


def test_blocks_do_not_change_pairs(spark):
    rng = random.Random(8)
    rows = [("a" if i < 60 else "b", "source" if i % 2 else "summary", i, "concept", [rng.gauss(0, 1) for _ in range(6)])
            for i in range(90)]
    n = spark.createDataFrame(rows, "doc_id string, component string, node_id long, attrib_type string, vec array<double>")
    key = lambda t: {(r.doc_id, r.src_node, r.smy_node): round(r.sim, 9) for r in t.collect()}
    small, large = key(S.cosine_pairs(n, 0.3, block_rows=4)), key(S.cosine_pairs(n, 0.3, block_rows=1000))
    assert small == large and small
    full = n.withColumn("nvec", F.col("vec")).withColumn("svec", F.lit(None).cast("array<double>"))
    sim = key(S.pair_similarity(full, AlignSettings(block_rows=7)))
    for (d, s, m), c in large.items():
        want = min(max(c ** 2 + 1 / (1 + 2.718281828459045 ** (0.5 - c ** 2)) - 0.5, 0), 1)
        assert sim.get((d, s, m), 0.0) == pytest.approx(want if want > 0.3 else 0.0, abs=1e-8)


def test_concept_vectors_use_what_is_there(spark):
    n = spark.createDataFrame(
        [("d", "source", 1, "concept", "f-01", [1.0, 0.0], True, None), ("d", "source", 2, "concept", None, [0.0, 0.0], False, [0.0, 2.0]),
         ("d", "source", 3, "attribute", None, [5.0, 5.0], True, None)],
        "doc_id string, component string, node_id long, attrib_type string, roleset_id string, vec array<double>, "
        "has_token_vec boolean, label_vec array<double>")
    frames = spark.createDataFrame([("f-01", [0.0, 1.0])], "roleset_id string, embedding array<float>")
    roles = spark.createDataFrame([("d", "source", 1, [10.0, 10.0])], "doc_id string, component string, node_id long, roles_vec array<double>")
    got = {r.node_id: r.vec for r in S.concept_vector(n, 2, frames, roles).collect()}
    assert got[1] == pytest.approx([2.4, 2.4]) and got[2] == pytest.approx([0.0, 0.8]) and got[3] == [5.0, 5.0]
    mean = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0]],), ([],)], "v array<array<double>>").select(V.mean_of_array(F.col("v")).alias("m"))
    assert [r.m for r in mean.collect()] == [[2.0, 4.0], None]


def test_dense_ids_and_salted_joins(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("g"),
                                  (F.col("id") * 7919 % 3001).alias("v"))
    got = {}
    for r in G.dense_ids(df, ["g"], ["v"], "n").collect():
        got.setdefault(r.g, []).append((r.v, r.n))
    assert all([n for _, n in sorted(rows)] == list(range(len(rows))) for rows in got.values())
    totals = with_totals(df, ["g"], [F.count(F.lit(1)).alias("n")], ["v"])
    assert totals.count() == 3000 and totals.where("g = 'hot'").select("n").distinct().first().n == 2000
    names = spark.createDataFrame([("hot", 1)], "g string, x int")
    assert join_salted(df, names, ["g"], ["v"], "left").where("x is null").count() == 1000
    assert join_salted(df, names, ["g"], ["v"], "left_anti").count() == 1000
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, df.join(names, ["g"], how).collect()))
        assert sorted(map(str, join_split(df, names, ["g"], ["v"], how, hot_rows=100).collect())) == plain
    # working columns give way to columns of the tables
    clash = df.select("*", *[F.col("v").alias(c) for c in ("_SALT", "_parts", "_split", "_part", "_row", "_n", "_first", "_start")])
    assert join_salted(clash, names, ["g"], ["v"], "left", salt=4).where("_SALT <> v").count() == 0
    assert join_split(clash, names, ["g"], ["v"], "left", hot_rows=100).columns == [*clash.columns, "x"]
    assert with_totals(clash, ["g"], [F.count(F.lit(1)).alias("n")], ["v"], 100).columns == [*clash.columns, "n"]
    assert G.dense_ids(clash, ["g"], ["v"], "n").where("_row <> v or _part <> v").count() == 0


def test_adjacency_has_one_form_for_all_vertices(spark):
    e = spark.createDataFrame([("d", "s", i, i % 3 and 1, i, "role") for i in range(1, 5001)], EDGES)
    rows = G.adjacency(e).collect()
    for v in (0, 1):
        mine = sorted((r.position, r.neighbor_id) for r in rows if r.node_id == v)
        assert mine == list(enumerate(i for i in range(1, 5001) if (i % 3 and 1) == v))


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    one = K.corpus_fingerprint(df).first()
    assert one == K.corpus_fingerprint(df.orderBy(F.desc("doc_id")).repartition(5)).first()
    assert one.fingerprint != K.corpus_fingerprint(df.where("doc_id > 0")).first().fingerprint


def test_pair_corpus_and_failures(spark, tmp_path):
    path = tmp_path / "docs.json"
    path.write_text('[{"id": "a", "comment": "c", "body": "One. Two.", "summary": "One."},\n {"id": "b", "body": "Alone."}]')
    docs = K.read_corpora(spark, {"tiny": str(path)})
    assert {(r.corpus, r.doc_id, r.summary) for r in docs.collect()} == {("tiny", "a", "One."), ("tiny", "b", None)}
    texts = K.pair_texts(docs)
    assert texts.count() == 3
    typed = texts.select("doc_id", F.when(F.col("component") == "source", "body").otherwise("summary").alias("snt_type"),
                         F.col("part_ix").alias("sent_ix"), "text")
    kept, failed = K.split_components(K.map_sentence_type(typed, K.AD_HOC_TYPES))
    assert [(r.doc_id, r.message) for r in failed.collect()] == [("b", "document has no summary")]
    assert {r.doc_id for r in kept.collect()} == {"a"}
    some, unknown = K.filter_keys(docs, "a, zz")
    assert [r.doc_id for r in some.collect()] == ["a"] and [r.doc_id for r in unknown.collect()] == ["zz"]
    empty = K.empty_documents(spark.createDataFrame([("a", " "), ("b", "x")], "doc_id string, text string"))
    assert [r.doc_id for r in empty.collect()] == ["a"]
    assert K.drop_failed(docs, failed, ["comment"]).count() == 1
    assert K.corpus_summary(docs.select("doc_id", F.col("body").alias("text")), 1).first().doc_id == "a"


def test_sinks_and_graph_writer(spark, tmp_path):
    stats = spark.createDataFrame([("a", "source", 1.0, [1, 2])], "doc_id string, component string, root_flow double, xs array<int>")
    sinks.write_results(stats, str(tmp_path / "r"), "csv", failures=stats.select("doc_id"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r" / "results")).first()
    assert (back.id, back.xs) == ("a", "[1,2]")
    for fmt in ("csv", "json", "txt"):
        sinks.write_corpus(stats, str(tmp_path / fmt), fmt)
    assert spark.read.schema(stats.schema).json(str(tmp_path / "json")).first() == stats.first()
    with pytest.raises(ValueError):
        sinks.write_corpus(stats, str(tmp_path / "x"), "xml")
    rows = spark.createDataFrame([("s.1", {"snt-type": "body"}, "a b", "(a / b :r (c / d))")],
                                 "sent_id string, metadata map<string,string>, text string, graph string")
    target = str(tmp_path / "blocks")
    T.write_graph_corpus(rows, target)
    T.write_graph_corpus(rows.unionByName(rows), target)  # exists: left as it is
    got = T.read_graph_corpus(spark, target).collect()
    assert [(r.sent_id, r.metadata["snt-type"], len(r.triples)) for r in got] == [("s.1", "body", 3)]


def test_incremental_store(spark, tmp_path):
    seen = []
    def compute(docs):
        seen.append(sorted(r.doc_id for r in docs.collect()))
        return docs.select("doc_id", F.length("text").alias("n"))
    docs = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "doc_id string, text string")
    schema = docs.select("doc_id", F.length("text").alias("n")).schema
    store = str(tmp_path / "store")
    align_incremental(docs.where("doc_id = 'a'"), store, compute, schema)
    out = align_incremental(docs, store, compute, schema)
    assert seen == [["a"], ["b"]] and {(r.doc_id, r.n) for r in out.collect()} == {("a", 2), ("b", 3)}
    align_incremental(docs, store, compute, schema)
    assert len(seen) == 2
    incoming = str(tmp_path / "in")
    docs.unionByName(spark.createDataFrame([("c", "z")], docs.schema)).write.json(incoming)
    stream = spark.readStream.schema(docs.schema).json(incoming)
    align_arrivals(stream, store, compute, schema, str(tmp_path / "cp")).awaitTermination(120)
    assert seen[-1] == ["c"] and spark.read.schema(schema).parquet(store).count() == 3
