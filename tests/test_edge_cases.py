"""Documents that are malformed, nested, cut off or too large for an id."""

import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from test_fixtures import flows_of, graph
from weftgraph.functions import roles
from weftgraph.lineage import discard, materialize
from weftgraph.operators import build as B
from weftgraph.operators import flow as W
from weftgraph.operators import graph as G
from weftgraph.operators import results as R
from weftgraph.operators import scoring as E
from weftgraph.plans.align import StepSets, align, maxflow, prepare
from weftgraph.settings import AlignSettings
from weftgraph.sources import corpus as K
from weftgraph.sources import graph_text as T

BLOCK = "# ::id a.{i}{nl}# ::snt One.{nl}(c / one{nl}   :ARG0 (d / two)){nl}"


@pytest.mark.parametrize("gap", ["\n", "\r\n", " \t\r\n"])
def test_blocks_end_at_blank_lines_of_any_kind(spark, tmp_path, gap):
    nl = "\r\n" if "\r" in gap else "\n"
    (tmp_path / "c.txt").write_bytes(gap.join(BLOCK.format(i=i, nl=nl) for i in range(3)).encode())
    rows = T.read_graph_corpus(spark, str(tmp_path / "c.txt")).collect()
    assert sorted(r.sent_id for r in rows) == ["a.0", "a.1", "a.2"]
    assert all(r.failure is None and len(r.triples) == 3 for r in rows)


def test_malformed_json_is_a_failure(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"id": "1", "body": "b", "summary": "s"}\n{"id": "2", "bo\n[3]\n{"id": "4", "body": "x"}\n')
    docs, failures = K.read_pairs(spark, str(tmp_path / "d.json"))
    assert sorted(r.doc_id for r in docs.collect()) == ["1", "4"]
    bad = failures.collect()
    assert len(bad) == 2 and all(r.stage == "read" and r.message.startswith("malformed") for r in bad)


def test_corpus_transforms(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "body": "b", "summary": "s"}\n')
    paths = {"one": str(tmp_path / "a.json"), "two": str(tmp_path / "a.json")}
    out = K.read_corpora(spark, paths, False, {"two": lambda d: d.withColumn("body", F.upper("body"))})
    assert {(r.corpus, r.body) for r in out.collect()} == {("one", "b"), ("two", "B")}
    with pytest.raises(ValueError):
        K.read_corpora(spark, paths, False, {"three": lambda d: d})


def test_new_corpus_drops_stale_results(spark, tmp_path):
    docs = spark.createDataFrame([("a.1", {}, "One.", "(c / one)")],
                                 "sent_id string, metadata map<string,string>, text string, graph string")
    old = tmp_path / "old"
    spark.range(1).write.parquet(str(old))
    assert T.write_graph_corpus(docs, str(tmp_path / "new"), (str(old),)) and not old.exists()
    spark.range(1).write.parquet(str(old))
    assert not T.write_graph_corpus(docs, str(tmp_path / "new"), (str(old),)) and old.exists()


def test_bad_role_labels_are_failures(spark):
    e = spark.createDataFrame([("d", ":ARG0", "role"), ("d", "ARG1", "role"), ("e", None, "role"), ("f", ":a-of", "role"),
                               ("g", None, "doc")], "doc_id string, role string, edge_type string")
    parsed = {r.role: r.p for r in e.select("role", roles.parse_role(F.col("role")).alias("p")).collect()}
    assert parsed["ARG1"].role_prefix is None and parsed[":ARG0"].role_prefix == "ARG"
    assert {(r.doc_id, r.stage) for r in roles.role_failures(e).collect()} == {("d", "role"), ("e", "role")}


def test_relations_by_text_and_by_pattern(spark):
    e = spark.createDataFrame([(i, "d", r) for i, r in enumerate([":ARG0", ":ARG1", ":mod", ":x", None])],
                              "edge_id int, doc_id string, role string")
    rel = spark.createDataFrame([(3, "mod", "^:mod$", [1.0]), (1, "arg", "^:ARG[0-9]$", [1.0]), (2, "zero", "^:ARG0$", [1.0]),
                                 (4, "any", "^:", [1.0])], "ord int, label string, pattern string, vec array<double>")
    for block in (4096, 1):
        got = {r.role: r.relation for r in roles.lookup_relation(e, rel, block).collect()}
        assert got == {":ARG0": "arg", ":ARG1": "arg", ":mod": "mod", ":x": "any", None: None}


def test_terminals_that_are_missing_are_failures(spark):
    f = spark.createDataFrame([("d", "source", "terminal", 1.0), ("d", "summary", "role", 1.0), ("e", "source", "terminal", 2.0)],
                              "doc_id string, component string, edge_type string, flow double")
    assert {(r.doc_id, r.component): r.root_flow for r in R.root_flow(f).collect()} == {
        ("d", "source"): 1.0, ("d", "summary"): None, ("e", "source"): 2.0}
    assert [r.doc_id for r in R.terminal_failures(f).collect()] == ["d"]


def test_ids_that_would_collide_are_an_error(spark):
    at = spark.createDataFrame([(0, 1 << 20)], "part_ix long, pos long")
    with pytest.raises(SparkRuntimeException):
        at.select(B.sentence_number(F.col("part_ix"), F.col("pos"))).collect()
    with pytest.raises(SparkRuntimeException):
        at.select(B.inner_id(F.col("part_ix"), F.lit((1 << 24) - 2))).collect()
    last = at.select(B.inner_id(F.lit(0), F.lit((1 << 24) - 3)).alias("a"), B.sentence_base(F.lit(1)).alias("b")).first()
    assert last.a + 1 < last.b


def test_one_of_two_opposite_edges_stays(spark):
    e = spark.createDataFrame([("d", "source", i, u, v, "role") for i, (u, v) in enumerate([(0, 1), (0, 2), (1, 2), (2, 1)])],
                              "doc_id string, component string, edge_id long, parent_id long, child_id long, edge_type string")
    assert {(r.parent_id, r.child_id) for r in W.acyclic(e).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_components_of_a_path_and_a_hub(spark):
    es = [(0, i, i + 1) for i in range(40)] + [(1, 500, i) for i in range(100, 160)] + [(2, 7, 7)]
    e = spark.createDataFrame([(d, "source", i, u, v, "role") for i, (d, u, v) in enumerate(es)],
                              "doc_id long, component string, edge_id long, parent_id long, child_id long, edge_type string")
    got = {(r.doc_id, r.node_id): r.component_root for r in G.weak_components(e).collect()}
    assert got == {**{(0, i): 0 for i in range(41)}, **{(1, i): 100 for i in [*range(100, 160), 500]}, (2, 7): 7}


NESTED = ([(0, "doc"), (2, "concept"), (3, "concept"), (4, "concept"), (5, "concept")],
          [(0, 2, "role"), (2, 4, "role"), (2, 3, "role"), (4, 3, "role"), (2, 5, "role"), (3, 5, "role")])


def test_alignment_of_nested_reentrancies_is_the_repaired_flow(spark):
    """A repaired vertex below another one can send less than before its repair."""
    summary = ([(0, "doc"), (1, "concept"), (2, "concept")], [(0, 1, "sentence"), (0, 2, "sentence")])
    nodes, edges, links = graph(spark, "n1", NESTED, summary, [(5, 1, 0.9), (3, 2, 0.5)])
    tree = graph(spark, "t1", ([(0, "doc"), (1, "concept")], [(0, 1, "role")]), summary, [(1, 1, 0.7)])
    nodes, edges, links = (x.unionByName(y) for x, y in zip((nodes, edges, links), tree))
    net = prepare(nodes, edges)
    assert [r.doc_id for r in net.nested[0].select("doc_id").distinct().collect()] == ["n1"]
    flows = maxflow(net, links.withColumn("rel_id", F.lit(None).cast("long")), "source")
    assert {r.doc_id: r.raw for r in flows.where("edge_type = 'terminal'").collect()} == pytest.approx({"n1": 0.95, "t1": 0.7})


def test_documents_stopped_by_the_loop_limit_are_marked(spark):
    vs, es = NESTED
    plain = (vs, [e for e in es if e != (4, 3, "role")])
    nodes, edges, links = graph(spark, "m1", plain, ([(0, "doc"), (1, "concept")], [(0, 1, "sentence")]), [(5, 1, 0.9)])
    assert [(r.loops, r.converged) for r in align(nodes, edges, links).loops.collect()] == [(2, True)]
    short = align(nodes, edges, links, AlignSettings(max_loops=1))
    assert [(r.loops, r.converged) for r in short.loops.collect()] == [(1, False)]


def test_steps_are_switched_by_name():
    steps = StepSets().switched(prune=False)
    assert [x.enabled for x in steps.loop] == [True, False] and steps.construct == StepSets().construct
    with pytest.raises(ValueError):
        StepSets().switched(unknown=True)


def test_missing_scores_are_nan_in_every_numeric_column(spark):
    pairs = spark.createDataFrame([("p",), ("q",)], "pair_id string")
    some = lambda p: p.where("pair_id = 'p'").select("pair_id", F.lit(1).alias("whole"), F.lit(0.5).alias("part"))
    got = {r.pair_id: r for r in E.score_batch(pairs, {"some": some}).collect()}
    assert got["p"].whole == 1.0 and math.isnan(got["q"].whole) and math.isnan(got["q"].part)


def test_discarded_tables_are_gone(spark, tmp_path):
    df = materialize(spark.range(3), "gone")
    path = df._weft_path
    discard(df, None, spark.range(1))
    from pathlib import Path
    assert not Path(path).exists()
