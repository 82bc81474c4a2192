"""Queries over the driver tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import roles as roles_fn
from weftgraph.functions import text as X
from weftgraph.functions import vectors as V
from weftgraph.lineage import lineage_dir, materialize
from weftgraph.operators import build as B
from weftgraph.operators import coref as C
from weftgraph.operators import flow as W
from weftgraph.operators import graph as G
from weftgraph.operators import maxflow as M
from weftgraph.operators import results as R
from weftgraph.operators import scoring as E
from weftgraph.operators import similarity as S
from weftgraph.operators import trees as TR
from weftgraph.operators.guard import split_failures
from weftgraph.plans import views as D
from weftgraph.plans.align import Alignment, StepSets, align
from weftgraph.plans.align import align_one as align_one_document
from weftgraph.plans.score import score_pairs as score_pairs_of
from weftgraph.settings import AlignSettings
from weftgraph.sources import corpus as K
from weftgraph.sources import graph_text as T
from weftgraph.sources import sinks
from weftgraph.streaming.incremental import ContentStore, missing_documents

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
KEY = G.KEY


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _r(c: str, digits: int = 6):
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


# --- similarity on the vector documents --------------------------------------

@query
def bipartite_pairs(spark, sf):
    return S.pair_counts(D.emb_nodes(spark, sf)).select("doc_id", "attrib_type", "n_source", "n_summary", "n_pairs")


def _pairs(spark, sf) -> DataFrame:
    return S.cosine_pairs(D.emb_nodes(spark, sf), D.EMB_THRESHOLD)


@query
def pair_cosine(spark, sf):
    return _pairs(spark, sf).select("doc_id", "attrib_type", "src_node", "smy_node", _r("sim"))


@query
def kernel_failures(spark, sf):
    """Pairs per vector document where the vectors of the last document's largest label were cut:
    that document fails with a message, the others are complete."""
    nodes = D.emb_nodes(spark, sf)
    last = nodes.groupBy("doc_id").agg(F.max("attrib_type").alias("_label")).orderBy(F.desc("doc_id")).limit(1)
    bad = nodes.join(F.broadcast(last.withColumnRenamed("doc_id", "_doc")), (F.col("doc_id") == F.col("_doc")) & (F.col("attrib_type") == F.col("_label")), "left")
    cut = bad.withColumn("vec", F.when(F.col("_doc").isNotNull(), F.slice("vec", 1, F.col("node_id").cast("int") % 7 + 1)).otherwise(F.col("vec")))
    found = materialize(S.cosine_pairs(cut.select(*nodes.columns), D.EMB_THRESHOLD, keep_failures=True), "guarded-pairs")
    good, failures = split_failures(found, "similarity", ["src_node"])
    return good.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.lit(False).alias("failed")).unionByName(
        failures.select("doc_id", F.lit(0).cast("long").alias("n_pairs"), F.col("message").isNotNull().alias("failed")))


@query
def sigmoid_skew(spark, sf):
    return _pairs(spark, sf).select("doc_id", "src_node", "smy_node", F.round(
        V.sigmoid_skew(F.col("sim")), 6).alias("skew"))


@query
def node_similarity(spark, sf):
    """Concept similarity with the attribute-dampened cosine as neighbourhood."""
    sim = S.node_similarity(F.col("sim"), F.pow("sim", F.lit(0.8)), "concept")
    return _pairs(spark, sf).select("doc_id", "src_node", "smy_node", F.round(sim, 6).alias("sim"))


@query
def mean_vector(spark, sf):
    m = S.mean_vectors(D.emb_nodes(spark, sf), ["doc_id", "component", "attrib_type"], D.EMB_DIM)
    return m.select("doc_id", "component", "attrib_type", F.posexplode("vec").alias("dim", "value")).select(
        "doc_id", "component", "attrib_type", F.col("dim").cast("long").alias("dim"), _r("value"))


def _sentence_nodes(spark, sf) -> DataFrame:
    """Labels as sentences whose vector is the mean of their vectors."""
    m = S.mean_vectors(D.emb_nodes(spark, sf), ["doc_id", "component", "attrib_type"], D.EMB_DIM)
    return m.select("doc_id", "component", F.col("attrib_type").cast("long").alias("node_id"),
                    F.lit("sentence").alias("attrib_type"), "vec")


@query
def sentence_skew(spark, sf):
    return S.sentence_similarity(_sentence_nodes(spark, sf)).select(
        "doc_id", F.col("src_node").alias("src_sent"), F.col("smy_node").alias("smy_sent"), _r("sim"), _r("skew"))


@query
def dampened_similarity(spark, sf):
    pairs = _pairs(spark, sf).withColumn("src_sent", F.col("attrib_type").cast("long")).withColumn(
        "smy_sent", F.col("attrib_type").cast("long"))
    sents = S.sentence_similarity(_sentence_nodes(spark, sf))
    return S.dampen(pairs, sents).select("doc_id", "src_node", "smy_node", _r("sim"))


@query
def alignment_capacities(spark, sf):
    s = AlignSettings(similarity_threshold=0.1)
    return S.alignment_capacities(_pairs(spark, sf), s).select("doc_id", "src_node", "smy_node", _r("capacity"))


@query
def top_alignments(spark, sf):
    return S.top_alignments(_pairs(spark, sf), 2).select(
        "doc_id", "src_node", "smy_node", F.col("rank").cast("long").alias("rank"), _r("sim"))


@query
def best_partner(spark, sf):
    return S.top_alignments(_pairs(spark, sf), 1, by="smy_node").select("doc_id", "smy_node", "src_node", _r("sim"))


@query
def orient_alignments(spark, sf):
    return W.share_alignments(_pairs(spark, sf).withColumn("capacity", F.col("sim"))).groupBy(
        "doc_id", "component", "to_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("capacity"), 6).alias("inflow"))


@query
def neighborhood_vector(spark, sf):
    """Neighbourhood vectors of the vector trees; inner nodes have zero vectors."""
    nodes, edges = D.emb_tree(spark, sf)
    own = D.emb_nodes(spark, sf).select(*KEY, "node_id", "vec")
    full = nodes.join(own, [*KEY, "node_id"], "left").withColumn(
        "vec", F.coalesce("vec", V.zeros(D.EMB_DIM)))
    out = S.neighborhood_vector(full, edges, D.EMB_DIM)
    return out.select(*KEY, "node_id", F.posexplode("nvec").alias("dim", "value")).groupBy(
        *KEY, "node_id").agg(F.round(F.sum((F.col("dim") + 1) * F.col("value")), 5).alias("weighted"),
                             F.round(F.sum(F.col("value") * F.col("value")), 5).alias("squared"))


@query
def neighborhood_vector_dag(spark, sf):
    """Neighbourhood vectors of the purchases, where parts have several orders."""
    number = F.regexp_extract("node_id", "[0-9]+", 0).cast("long")
    nodes, edges = D.dag_graph(spark, sf)
    nodes = materialize(nodes, "dag-nodes").withColumn("vec", F.array(
        (number % 7).cast("double"), (number % 11).cast("double"), F.lit(1.0)))
    out = S.neighborhood_vector(nodes, edges, 3)
    return out.select("doc_id", "node_id", *[F.round(F.get("nvec", F.lit(i)), 9).alias(f"v{i}") for i in range(3)])


@query
def roles_vector(spark, sf):
    """Roles vectors of the label nodes: child vectors plus the frame's role vectors.

    Frames are the labels, their two roles the label's first two mean vectors.
    """
    nodes, edges = D.emb_tree(spark, sf)
    own = D.emb_nodes(spark, sf).select(*KEY, "node_id", "vec")
    full = nodes.join(own, [*KEY, "node_id"], "left").withColumn("vec", F.coalesce("vec", V.zeros(D.EMB_DIM)))
    full = full.withColumn("roleset_id", F.when(
        F.col("attrib_type") == "sentence", F.concat(F.lit("label-0"), (-F.col("node_id") - 2).cast("string"))))
    emb = D.table(spark, sf, "embeddings")
    mean = emb.groupBy("label").agg(V.vector_mean(V.as_double(F.col("embedding")), D.EMB_DIM).alias("vec"))
    role = F.struct(F.lit(0).alias("ix"), F.col("vec").alias("role_emb"), F.col("vec").alias("func_emb"))
    rolesets = mean.select(F.concat(F.lit("label-0"), F.col("label").cast("string")).alias("roleset_id"),
                           F.array(role, role).alias("roles"))
    typed = edges.withColumn("role_index", F.when(F.col("edge_id") % 4 < 3, (F.col("edge_id") % 4).cast("int")))
    typed = typed.withColumn("edge_vec", F.when(F.col("edge_id") % 5 > 0, V.ones(D.EMB_DIM)))
    out = S.roles_vector(full, typed, rolesets, D.EMB_DIM)
    return out.select(*KEY, "node_id", F.posexplode("roles_vec").alias("dim", "value")).groupBy(
        *KEY, "node_id").agg(F.round(F.sum((F.col("dim") + 1) * F.col("value")), 5).alias("weighted"))


# --- coreference ----------------------------------------------------------------

def _coref(spark, sf):
    coref = D.emb_coref(spark, sf)
    nodes = coref.select("doc_id", "component", "sent_ix", "variable", "node_id",
                         F.lit("concept").alias("attrib_type"))
    align_edges = _pairs(spark, sf).where("sim > 0.1").select(
        "doc_id", "src_node", "smy_node", F.lit(None).cast("long").alias("rel_id"),
        F.lit(None).cast("boolean").alias("is_bipartite"), F.col("sim").alias("capacity"))
    return coref.drop("node_id"), nodes, align_edges


@query
def coref_edges(spark, sf):
    coref, nodes, align_edges = _coref(spark, sf)
    return C.intra_coref(C.resolve_refs(coref, nodes), align_edges).select(
        "doc_id", "src_node", "smy_node", "rel_id", _r("capacity"))


@query
def bipartite_relations(spark, sf):
    return C.bipartite_relations(_coref(spark, sf)[0])


@query
def component_relations(spark, sf):
    return C.component_relations(_coref(spark, sf)[0])


@query
def coref_upsert(spark, sf):
    coref, nodes, align_edges = _coref(spark, sf)
    out = C.bipartite_coref(C.resolve_refs(coref, nodes), coref, align_edges)
    return out.select("doc_id", "src_node", "smy_node", "rel_id", "is_bipartite", _r("capacity"))


@query
def coref_total(spark, sf):
    coref, nodes, align_edges = _coref(spark, sf)
    return C.count_added(align_edges, C.add_coref(align_edges, coref, nodes))


# --- graph operators on the sales trees ------------------------------------------

@query
def reverse_edges(spark, sf):
    return G.reverse(D.hier_edges(spark, sf)).select("doc_id", "edge_id", "from_id", "to_id", "edge_type")


@query
def graph_union(spark, sf):
    both = G.disjoint_union(D.hier_edges(spark, sf), D.dag_edges(spark, sf).withColumn("component", F.lit("summary")))
    return both.groupBy("component", "edge_type").agg(F.count(F.lit(1)).alias("n"))


@query
def components(spark, sf):
    """Component label of every vertex of the tree, all regions in one graph."""
    e = D.hier_edges(spark, sf).withColumn("doc_id", F.lit(0).cast("long"))
    return G.weak_components(e).select("node_id", "component_root")


@query
def component_of_root(spark, sf):
    nodes, edges = D.dag_graph(spark, sf)
    nodes = materialize(nodes, "dag-nodes")
    n, e = G.component_of(nodes, edges, G.roots(nodes))
    n = materialize(n, "dag-component")
    e = G.induced_subgraph(edges, n)
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes")).join(
        e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges")), "doc_id")


@query
def induced_subgraph(spark, sf):
    big = D.hier_nodes(spark, sf).where("attrib_type <> 'attribute'")
    return G.induced_subgraph(D.hier_edges(spark, sf), big).select("doc_id", "edge_id", "parent_id", "child_id")


@query
def leaves(spark, sf):
    return G.leaves(D.hier_nodes(spark, sf), D.hier_edges(spark, sf)).select("doc_id", "node_id", "attrib_type")


@query
def graph_roots(spark, sf):
    return G.roots(D.hier_nodes(spark, sf), D.hier_edges(spark, sf)).select("doc_id", "node_id", "is_root")


@query
def degrees(spark, sf):
    return G.degrees(D.dag_edges(spark, sf)).select("doc_id", "node_id", "in_degree", "out_degree")


@query
def k_hop(spark, sf):
    return G.k_hop(materialize(D.hier_edges(spark, sf), "hier-edges"), 3).groupBy("doc_id", "center", F.col("hops").cast("long").alias("hops")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query
def descendants(spark, sf):
    return G.descendants(D.hier_edges(spark, sf)).groupBy("doc_id", "ancestor").agg(
        F.count(F.lit(1)).alias("n"), F.max("hops").cast("long").alias("depth"))


@query
def adjacency(spark, sf):
    return G.adjacency(D.dag_edges(spark, sf)).select(
        "doc_id", "node_id", F.col("position").cast("long").alias("position"), "neighbor_id")


@query
def incident_edges(spark, sf):
    multi = G.degrees(D.dag_edges(spark, sf)).where("in_degree > 1")
    return G.incident(D.dag_edges(spark, sf), multi, "out", ["role"]).select("doc_id", "edge_id", "node_id")


@query
def delete_edges(spark, sf):
    e = D.hier_edges(spark, sf)
    drop = e.where("weight < 10")
    kept, nodes = G.delete_edges(e, D.hier_nodes(spark, sf), drop, include_nodes=True)
    return nodes.groupBy("doc_id", "attrib_type").agg(F.count(F.lit(1)).alias("n_nodes"))


@query
def select_edges(spark, sf):
    return G.select_edges(D.hier_edges(spark, sf), (F.col("edge_type") == "role") & (F.col("weight") > 40)).select(
        "doc_id", "edge_id", "weight")


@query
def containing_component(spark, sf):
    return G.containing_component(D.emb_tree(spark, sf)[0], D.emb_nodes(spark, sf).select("doc_id", "node_id"))


@query
def set_capacities(spark, sf):
    e = G.set_capacities(D.hier_edges(spark, sf), W.MAX_CAPACITY)
    up = D.hier_edges(spark, sf).where("weight is not null").withColumn("capacity", F.col("weight"))
    return G.update_capacities(e, up).select("doc_id", "edge_id", "capacity")


@query
def assign_ids(spark, sf):
    return G.assign_ids(D.hier_nodes(spark, sf)).select("doc_id", "node_id", "attrib_id")


# --- text graphs ------------------------------------------------------------------

@query
def text_graph_counts(spark, sf):
    nodes, edges = B.text_graph(D.doc_texts(spark, sf))
    n = R.node_counts(nodes)
    e = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, KEY, "left").fillna(0, ["n_edges"]).drop("component")


@query
def token_spans(spark, sf):
    """JSON spans of every token node of the conversations."""
    texts = D.conv_texts(spark, sf)
    sents = B.text_sentences(texts)
    arrays = B.token_arrays(B.text_tokens(sents))
    nodes, _ = B.text_graph(texts)
    words = B.resolve_tokens(nodes.where("attrib_type in ('concept', 'attribute')"), arrays)
    return words.select("doc_id", "component", "node_id", "spans")


@query
def sentence_text(spark, sf):
    nodes, _ = D.text_graph_conv(spark, sf)
    return nodes.where("attrib_type = 'sentence'").select("doc_id", "component", "node_id", "descr")


@query
def sentence_index(spark, sf):
    nodes, _ = D.text_graph_conv(spark, sf)
    return G.sentence_index(nodes).select(
        "doc_id", "component", "sent_ix", "sentence_node", F.size("concepts").cast("long").alias("n_concepts"),
        F.size("attributes").cast("long").alias("n_attributes"))


def _conv_sections(spark, sf) -> DataFrame:
    """Turns as parsed sentences; a user turn is a section of its own, its first a header."""
    c = D.conv_texts(spark, sf).withColumnRenamed("part_ix", "sent_ix")
    leaf = F.transform(X.tokenize(F.col("text")), lambda t, i: F.struct(
        F.lit("s").alias("source"), F.lit(":tok").alias("role"), t.alias("target"),
        F.array(i).alias("token_ix"), F.lit(None).cast("array<int>").alias("role_token_ix")))
    top = F.array(F.struct(F.lit("s").alias("source"), F.lit(":instance").alias("role"), F.lit("say-01").alias("target"),
                           F.lit(None).cast("array<int>").alias("token_ix"),
                           F.lit(None).cast("array<int>").alias("role_token_ix")))
    return (c.withColumn("sent_ix", F.col("sent_ix").cast("long")).withColumn("top", F.lit("s"))
            .withColumn("triples", F.concat(top, leaf))
            .withColumn("section_ix", F.floor(F.col("sent_ix") / 2).cast("long"))
            .withColumn("is_header", F.col("sent_ix") == 0))


@query
def built_graph_counts(spark, sf):
    """Nodes and edges per type of the conversations with section levels."""
    nodes, edges = B.build_graph(_conv_sections(spark, sf), intermediate=True)
    return R.node_counts(nodes).join(R.edge_counts(edges), KEY)


@query
def collapsed_sections(spark, sf):
    """The same without section and header levels."""
    nodes, edges = B.build_graph(_conv_sections(spark, sf), intermediate=True,
                                 decorators=[G.collapse_sections])
    return R.node_counts(nodes).join(R.edge_counts(edges), KEY)


@query
def doc_chain(spark, sf):
    nodes, edges = B.build_graph(_conv_sections(spark, sf), intermediate=True)
    chain = G.chain_from_root(nodes, edges)
    return G.doc_alignments(chain, W.MAX_CAPACITY).select(
        "doc_id", F.col("position").cast("long").alias("position"), "src_node", "smy_node", "capacity")


@query
def path_sentences(spark, sf):
    nodes, _ = B.build_graph(_conv_sections(spark, sf), intermediate=True)
    return G.sentences_under_path(nodes, "source.section_0").select("doc_id", "n_sentences")


@query
def graph_corpus_roundtrip(spark, sf):
    """Conversations written as graph text, read back, parsed and counted."""
    path = f"{lineage_dir(spark)}/blocks-{uuid.uuid4().hex}"
    s = _conv_sections(spark, sf)
    word = lambda t: F.concat(F.lit(" :tok "), F.lit('"'), t, F.lit('"'))
    graph = F.concat(F.lit("(s / say-01"), F.array_join(F.transform(X.tokenize(F.col("text")), word), ""), F.lit(")"))
    rows = s.select(
        F.concat_ws(".", F.concat(F.lit("pmid_"), F.col("doc_id"), F.lit("_0")), F.col("sent_ix")).alias("sent_id"),
        F.create_map(F.lit("snt-type"), F.col("component")).alias("metadata"),
        F.regexp_replace("text", r"\s+", " ").alias("text"), graph.alias("graph"))
    T.write_graph_corpus(rows, path)
    parsed = T.read_graph_corpus(spark, path)
    key = X.doc_key(F.col("sent_id"), X.DOC_KEY_PATTERNS["bio"])
    return (parsed.withColumn("k", key).select("k.doc_id", F.col("metadata")["snt-type"].alias("snt_type"),
                                               F.size("triples").alias("n"), "failure")
            .groupBy("doc_id", "snt_type").agg(
                F.sum("n").cast("long").alias("n_triples"), F.count(F.lit(1)).alias("n_sentences"),
                F.count("failure").alias("n_failures")))


@query
def parse_role(spark, sf):
    """Parsed role labels made of event types and days."""
    e = D.table(spark, sf, "events")
    label = F.concat(F.lit(":"), F.when(F.col("event_id") % 5 == 0, F.lit("prep-out-of")).otherwise(
        F.concat(F.regexp_replace("event_type", "[^A-Za-z-]", "-"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 7).cast("string"))
                 .otherwise(F.lit("")), F.when(F.col("event_id") % 2 == 0, "-of").otherwise(""))))
    r = roles_fn.parse_role(label)
    return e.select("event_id", label.alias("label"), r.alias("r")).select(
        "event_id", "label", "r.role_prefix", F.col("r.role_index").cast("long").alias("role_index"), "r.role_inverted")


@query
def relation_match(spark, sf):
    """First matching relation of order priorities, patterns in dictionary order."""
    o = D.table(spark, sf, "orders")
    edges = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("edge_id"),
                     F.concat(F.lit(":"), "o_orderpriority").alias("role"))
    relations = o.select("o_orderpriority").distinct().select(
        (F.substring("o_orderpriority", 1, 1).cast("int")).alias("ord"), F.col("o_orderpriority").alias("label"),
        F.concat(F.lit("^:[1-"), F.substring("o_orderpriority", 1, 1), F.lit("]-")).alias("pattern"))
    relations = relations.where("ord > 1")
    return roles_fn.lookup_relation(edges, relations).select("edge_id", "role", "relation")


@query
def roleset_match(spark, sf):
    """Frames of the part types: valid names with a known frame."""
    p = D.table(spark, sf, "part")
    nodes = p.select(F.lit(0).cast("long").alias("doc_id"), F.lit("source").alias("component"),
                     F.col("p_partkey").alias("node_id"), F.lit("concept").alias("attrib_type"),
                     F.concat(F.lower(F.regexp_replace("p_type", "[ ]+", "-")), F.when(F.col("p_size") % 2 == 0, F.lit("-01"))
                              .otherwise(F.lit(""))).alias("instance"))
    rolesets = p.where("p_size > 25").select(F.concat(F.lower(F.regexp_replace("p_type", "[ ]+", "-")), F.lit("-01"))
                                             .alias("roleset_id")).distinct()
    return roles_fn.lookup_roleset(nodes, rolesets).select("node_id", "instance", "roleset_id")


# --- flow --------------------------------------------------------------------------

def _hier(spark, sf) -> tuple[DataFrame, DataFrame, TR.Climb]:
    """Edges of the sales trees, written once, the flow of their lines, and the ways up."""
    edges = materialize(D.hier_edges(spark, sf), "hier-edges")
    ways = TR.climb(edges, W.FLOW_EDGE)
    inflow = edges.where("weight is not null").select(
        *KEY, F.col("child_id").alias("node_id"), F.col("weight").alias("capacity"))
    return edges, W.saturated_flow(edges, inflow, D.hier_roots(spark, sf), ways), ways


def _hier_flows(spark, sf) -> DataFrame:
    return _hier(spark, sf)[1]


@query
def saturated_flow(spark, sf):
    return _hier_flows(spark, sf).select("doc_id", "child_id", "edge_type", _r("flow"))


def _hier_fpn(spark, sf, mode: str = "fpn") -> tuple[DataFrame, TR.Climb]:
    """Flow per node, and the ways up that its counts are made with."""
    edges, flows, ways = _hier(spark, sf)
    return W.flow_per_node(flows, W.descendant_counts(edges, D.hier_roots(spark, sf), ways=ways), mode), ways


@query
def flow_per_node(spark, sf):
    return _hier_fpn(spark, sf)[0].select("doc_id", "child_id", "edge_type", _r("flow"))


@query
def flow_normalized(spark, sf):
    return _hier_fpn(spark, sf, "norm")[0].select("doc_id", "child_id", _r("flow", 9))


@query
def flow_display(spark, sf):
    return _hier_fpn(spark, sf, "vis")[0].select("doc_id", "child_id", _r("flow", 9), _r("vis_flow"))


@query
def set_flow(spark, sf):
    return W.set_flow(_hier_flows(spark, sf), edge_types=["terminal", "doc"], value=1.0).select(
        "doc_id", "child_id", "edge_type", _r("flow"))


def _hier_align(spark, sf) -> DataFrame:
    """Quantities as alignment rows into the lines' orders."""
    return D.hier_edges(spark, sf).where("weight is not null").select(
        "doc_id", "component", F.col("child_id").alias("from_id"), F.col("parent_id").alias("to_id"),
        F.col("weight").alias("capacity"), F.col("weight").alias("flow"))


@query
def discount_flow(spark, sf):
    a = _hier_align(spark, sf)
    return W.discount_flow(_hier_flows(spark, sf), a, 100.0).select("doc_id", "from_id", "to_id", _r("capacity"))


@query
def clamp_capacity(spark, sf):
    return W.clamp_capacity(_hier_align(spark, sf), 5.0).select("doc_id", "from_id", "to_id", "capacity", "flow")


@query
def remove_alignments(spark, sf):
    return W.remove_alignments(W.clamp_capacity(_hier_align(spark, sf), 5.0)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("capacity"), 6).alias("capacity"))


@query
def flow_gaps(spark, sf):
    flows = _hier_flows(spark, sf).where("edge_type = 'role'")
    return W.flow_gaps(flows.withColumn("capacity", F.lit(50.0)), 0.0, lambda gap, v: gap < v).select(
        "doc_id", "child_id", _r("flow"))


@query
def flow_updates(spark, sf):
    """Role edges whose flow changes when small lines lose their capacity."""
    edges, first, ways = _hier(spark, sf)
    less = edges.where("weight > 5").select(
        *KEY, F.col("child_id").alias("node_id"), F.col("weight").alias("capacity"))
    second = W.saturated_flow(edges, less, D.hier_roots(spark, sf), ways)
    return W.count_flow_updates(first, second).select("doc_id", "updates")


@query
def prune_subtrees(spark, sf):
    """Everything at or below a weak order, customer or line."""
    fpn, ways = _hier_fpn(spark, sf)
    return W.prune_targets(fpn, None, 15.0, ways=ways).select("doc_id", "node_id")


@query
def tree_intervals(spark, sf):
    """Places of the sales trees' vertices in depth-first order: a subtree is an interval."""
    edges = materialize(D.hier_edges(spark, sf), "hier-edges")
    parents = edges.select(*KEY, F.col("child_id").alias("node_id"), F.col("parent_id").alias("up"))
    index = TR.tree_index(D.hier_nodes(spark, sf, edges), parents)
    return index.select("doc_id", "node_id", F.col("depth").cast("long").alias("depth"), "first", "last")


@query
def terminals(spark, sf):
    n2, e2, _ = D.dag_summary(spark, sf)
    n1, e1 = D.dag_graph(spark, sf)
    nodes, edges = n1.unionByName(n2), e1.unionByName(e2)
    return W.add_terminals(nodes, edges, "source").select("doc_id", "from_key", "to_key", "capacity")


@query
def reentrancies(spark, sf):
    inflow = D.dag_summary(spark, sf)[2].groupBy("doc_id", F.col("src_node").alias("node_id")).agg(
        F.sum("capacity").alias("capacity")).withColumn("component", F.lit("source"))
    nodes, edges = D.dag_graph(spark, sf)
    flows = W.saturated_flow(edges, inflow, G.roots(nodes))
    return W.reentrancies(flows).select("doc_id", "node_id", "n_parents", _r("total_flow"), "has_zero_flow")


@query
def first_visit_counts(spark, sf):
    """Flow shares of the purchases, descendants counted as a depth-first walk does."""
    nodes, edges = D.dag_graph(spark, sf)
    c = W.first_visit_counts(edges, G.roots(nodes))
    return c.groupBy("doc_id").agg(F.sum("n_desc").alias("sum_desc"), F.max("n_desc").alias("max_desc"))


def _dag_network(spark, sf) -> DataFrame:
    n2, e2, align_edges = D.dag_summary(spark, sf)
    n1, e1 = D.dag_graph(spark, sf)
    nodes, edges = n1.unionByName(n2), e1.unionByName(e2)
    return W.build_network(nodes, edges, align_edges, "source")


@query
def max_flow_value(spark, sf):
    return M.max_flow_value(M.max_flow(_dag_network(spark, sf), columns=("doc_id", "to_key", "flow"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), _r("value"))


@query
def max_flow_edges(spark, sf):
    """Maximum flow of every order-part edge of the purchases."""
    flows = M.max_flow(_dag_network(spark, sf)).where("component = 'source' and edge_type = 'role'")
    return flows.select(F.col("doc_id").cast("long").alias("doc_id"), "edge_id", _r("flow"))


@query
def min_cut(spark, sf):
    """Maximum flow of the purchases where an order passes at most 0.2 to each part, proved by its
    cut for every customer."""
    net = _dag_network(spark, sf)
    tight = (F.col("edge_type") == "role") & (F.col("component") == "source")
    flows = materialize(M.max_flow(net.withColumn("capacity", F.when(tight, 0.2).otherwise(F.col("capacity")))), "min-cut")
    return M.cut_certificate(flows).select(F.col("doc_id").cast("long").alias("doc_id"), _r("value"), _r("cut"), "certified")


@query
def repaired_edge_flows(spark, sf):
    """The same after the repair, with the edges into the sink."""
    n2, e2, align_edges = D.dag_summary(spark, sf)
    n1, e1 = D.dag_graph(spark, sf)
    nodes, edges = n1.unionByName(n2), e1.unionByName(e2)
    flows, _ = M.repair_reentrancies(nodes, edges, align_edges, "source")
    kept = flows.where((F.col("component") == "source") | (F.col("to_key") == W.SINK_TERMINAL))
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.regexp_replace("from_key", "^source:", "").alias("from_id"),
                       F.regexp_replace("to_key", "^source:", "").alias("to_id"), _r("flow"))


@query
def summary_terminals(spark, sf):
    """A network with another terminal builder: every leaf of the summary is drained."""
    def forward(nodes, edges, component):
        return W.add_terminals(nodes, edges, None)

    n2, e2, align_edges = D.dag_summary(spark, sf)
    n1, e1 = D.dag_graph(spark, sf)
    net = W.build_network(n1.unionByName(n2), e1.unionByName(e2), align_edges, "source", terminals=forward)
    return net.where("edge_type = 'terminal'").select("doc_id", "from_key", "to_key")


@query
def network_edges(spark, sf):
    return _dag_network(spark, sf).groupBy("edge_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query
def repaired_reentrancies(spark, sf):
    """Even-split repair: the maximum flow of the purchases stays what it was."""
    n2, e2, align_edges = D.dag_summary(spark, sf)
    n1, e1 = D.dag_graph(spark, sf)
    nodes, edges = n1.unionByName(n2), e1.unionByName(e2)
    flows, report = M.repair_reentrancies(nodes, edges, align_edges, "source")
    value = M.max_flow_value(flows).select(F.col("doc_id").cast("long").alias("doc_id"), _r("value"))
    n = report.where("component = 'source'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_reentrancies"))
    return value.join(n, "doc_id", "left").fillna(0, ["n_reentrancies"])


# --- results on the vector trees --------------------------------------------------

EMB_SETTINGS = AlignSettings(similarity_threshold=D.EMB_THRESHOLD)


def _emb_alignment(spark, sf, steps: StepSets = StepSets()) -> Alignment:
    nodes, edges = D.emb_tree(spark, sf)
    pairs = materialize(_pairs(spark, sf).select("doc_id", "src_node", "smy_node", "sim",
                                                 F.col("sim").alias("capacity")), "emb-pairs")
    return align(materialize(nodes, "emb-nodes"), materialize(edges, "emb-edges"), pairs, EMB_SETTINGS, steps=steps)


@query
def aligned_edges(spark, sf):
    return _emb_alignment(spark, sf).align_edges.select("doc_id", "src_node", "smy_node", _r("capacity"))


@query
def align_with_coref(spark, sf):
    """The program on alignments that coreference has lent and put in."""
    coref, named, _ = _coref(spark, sf)
    nodes, edges = D.emb_tree(spark, sf)
    pairs = _pairs(spark, sf).select("doc_id", "src_node", "smy_node", "sim", F.col("sim").alias("capacity"))
    links = materialize(C.add_coref(pairs, coref, named), "coref-pairs")
    out = align(materialize(nodes, "emb-nodes"), materialize(edges, "emb-edges"), links, EMB_SETTINGS)
    return out.align_edges.select("doc_id", "src_node", "smy_node", "rel_id", _r("capacity"))


@query
def aligned_without_pruning(spark, sf):
    """The program with one of its steps switched off."""
    out = _emb_alignment(spark, sf, StepSets().switched(prune=False))
    return out.align_edges.select("doc_id", "src_node", "smy_node", _r("capacity"))


@query
def aligned_flows(spark, sf):
    return _emb_alignment(spark, sf).edge_flows.select("doc_id", "component", "child_id", "edge_type", _r("flow"))


@query
def alignment_flows(spark, sf):
    return _emb_alignment(spark, sf).flows().select(
        "doc_id", "name", "s_descr", "t_descr", "s_id", "t_id", "s_attr", "t_attr", "edge_type",
        _r("flow"), "reentrancy", _r("align_flow"), "align_count")


@query
def root_flow(spark, sf):
    return R.root_flow(_emb_alignment(spark, sf).edge_flows).select("doc_id", "component", _r("root_flow"))


@query
def connected_stats(spark, sf):
    a = _emb_alignment(spark, sf)
    return R.connected_stats(a.nodes, a.align_edges).select(
        "doc_id", "component", "alignable", "aligned", _r("aligned_portion"))


@query
def aggregate_stats(spark, sf):
    out = _emb_alignment(spark, sf).stats()
    return out.select("doc_id", _r("aligned_portion_hmean"), _r("mean_flow"), "tot_alignable", "tot_aligned",
                      _r("aligned_portion"), "reentrancies", "bipartite_relations")


@query
def stats_frame(spark, sf):
    out = _emb_alignment(spark, sf).stats_frame()
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[_r(c) if c in doubles else F.col(c) for c in out.columns if c != "text"])


@query
def alignment_score(spark, sf):
    out = _emb_alignment(spark, sf).scores()
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[_r(c) if c in doubles else F.col(c) for c in out.columns])


@query
def reduce_graph(spark, sf):
    a = _emb_alignment(spark, sf)
    nodes, edges, links = R.reduce_graph(a.nodes, a.edge_flows, a.align_edges)
    n = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_edges")), KEY, "left").fillna(0, ["n_edges"])


@query
def node_counts(spark, sf):
    return R.node_counts(D.hier_nodes(spark, sf)).drop("component")


@query
def edge_counts(spark, sf):
    return R.edge_counts(D.hier_edges(spark, sf)).drop("component")


@query
def graph_sizes(spark, sf):
    return R.graph_sizes(D.hier_nodes(spark, sf), D.hier_edges(spark, sf)).drop("component")


@query
def reentrancy_stats(spark, sf):
    flows = D.dag_edges(spark, sf).withColumn("flow", F.lit(1.0))
    per = R.reentrancy_stats(flows)
    return R.combine_reentrancies(per).select("doc_id", "total", "zero_flow", _r("total_flow"))


@query
def result_status(spark, sf):
    docs = D.conv_sentences(spark, sf)
    _, failures = K.split_components(K.map_sentence_type(docs))
    return R.result_status(docs, failures).select("doc_id", "status", F.col("failure.message").alias("message"))


@query
def align_one(spark, sf):
    """The first document of the vectors aligned by itself."""
    nodes, edges = D.emb_tree(spark, sf)
    pairs = _pairs(spark, sf).select("doc_id", "src_node", "smy_node", "sim", F.col("sim").alias("capacity"))
    first = nodes.agg(F.min("doc_id")).first()[0]
    out = align_one_document(nodes, edges, pairs, first, EMB_SETTINGS)
    return out.align_edges.select("doc_id", "src_node", "smy_node", _r("capacity"))


@query
def corpus_report(spark, sf):
    """Flows of all vector documents as a report: rows and flow per edge type."""
    flows = R.corpus_report(_emb_alignment(spark, sf).flows())
    return flows.groupBy("doc_id", "name", "edge_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("flow"), 5).alias("flow"))


@query
def align_loops(spark, sf):
    """Whether every vector document settled by itself."""
    return _emb_alignment(spark, sf).loops.select("doc_id", "converged")


# --- parsed graphs of the orders -------------------------------------------------------

def _order_graphs(spark, sf) -> DataFrame:
    """Every order as a sentence graph: its priority with a relation to each of its lines."""
    def triple(source, role, target):
        none = F.lit(None).cast("array<int>")
        return F.struct(source.alias("source"), role.alias("role"), target.alias("target"),
                        none.alias("token_ix"), none.alias("role_token_ix"))

    line = F.concat(F.lit("l"), F.col("l_linenumber").cast("string"))
    pair = F.struct("l_linenumber", F.array(
        triple(line, F.lit(":instance"), F.col("l_returnflag")),
        triple(F.lit("o"), F.concat(F.lit(":line"), F.col("l_linenumber").cast("string")), line)).alias("t"))
    lines = D.order_lines(spark, sf).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(pair)).alias("pairs"))
    head = F.array(triple(F.lit("o"), F.lit(":instance"), F.col("o_orderpriority")))
    return D.table(spark, sf, "orders").join(lines, "o_orderkey").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("source").alias("component"), F.lit(0).cast("long").alias("sent_ix"),
        F.col("o_orderpriority").alias("text"), F.lit("o").alias("top"),
        F.concat(head, F.flatten(F.transform("pairs", lambda p: p["t"]))).alias("triples"))


@query
def variable_relations(spark, sf):
    """Role edges between two variables of the orders' graphs."""
    _, edges = B.build_graph(_order_graphs(spark, sf))
    return edges.where("edge_type = 'role'").select("doc_id", "parent_id", "child_id", "role", "role_prefix", "role_index")


@query
def role_label_failures(spark, sf):
    """Orders' graphs whose labels lost their colon on lines above three."""
    _, edges = B.build_graph(_order_graphs(spark, sf))
    cut = edges.withColumn("role", F.when(F.col("role") > ":line3", F.substring("role", 2, 99)).otherwise(F.col("role")))
    return roles_fn.role_failures(cut)


# --- corpora ------------------------------------------------------------------------

@query
def written_corpus(spark, sf):
    """Documents written as JSON, CSV and text, and read back."""
    docs = D.table(spark, sf, "documents").select("doc_id", "lang", F.split("text", "\n").alias("lines"))
    base, out = f"{lineage_dir(spark)}/written-{uuid.uuid4().hex}", None
    for fmt in sinks.FORMATS:
        sinks.write_corpus(docs, f"{base}/{fmt}", fmt)
        if fmt == "csv":
            back = spark.read.csv(f"{base}/{fmt}", header=True, escape='"', multiLine=True)
            lines = F.from_json("lines", "array<string>")
        else:
            back, lines = spark.read.schema("doc_id long, lang string, lines array<string>").json(f"{base}/{fmt}"), F.col("lines")
        part = back.select(F.lit(fmt).alias("format"), "lang", F.size(lines).alias("k"), F.aggregate(
            F.transform(lines, lambda x: F.length(x)), F.lit(0), lambda a, b: a + b).alias("c"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("format", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("n_lines"), F.sum("c").alias("n_chars"))


@query
def written_results(spark, sf):
    """Statistics of the vector documents written as results and read back by document."""
    a = _emb_alignment(spark, sf)
    path = f"{lineage_dir(spark)}/results-{uuid.uuid4().hex}"
    sinks.write_results(a.stats(), path, "json", flows=a.flows())
    flows = spark.read.json(f"{path}/alignments").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_flows"))
    return (spark.read.json(f"{path}/by_document").select("doc_id", "tot_aligned", "tot_alignable")
            .join(flows, "doc_id"))


@query
def committed_results(spark, sf):
    """Statistics and flows of the vector documents committed together, twice, and read back."""
    a = _emb_alignment(spark, sf)
    path = f"{lineage_dir(spark)}/committed-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.commit_results(a.stats(), path, flows=a.flows())
    run = sinks.committed_path(spark, path)
    flows = spark.read.json(f"{run}/alignments").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_flows"))
    return spark.read.json(f"{run}/by_document").select("doc_id", "tot_aligned", "tot_alignable").join(flows, "doc_id")


@query
def corpus_keys(spark, sf):
    return K.corpus_keys(D.conv_sentences(spark, sf))


@query
def doc_keys(spark, sf):
    c = D.table(spark, sf, "conversations")
    sid = F.concat(F.lit("PROXY_AFP_ENG_"), F.col("conv_id"), F.lit("_1."), F.col("turn"))
    k = X.doc_key(sid, X.DOC_KEY_PATTERNS["proxy-report"])
    return c.select(sid.alias("sent_id"), k.alias("k")).select(
        "sent_id", "k.doc_id", F.col("k.sent_no").cast("long").alias("sent_no"))


@query
def sentence_types(spark, sf):
    return K.map_sentence_type(D.conv_sentences(spark, sf)).select("doc_id", "sent_ix", "sent_type")


@query
def split_components(spark, sf):
    kept, failures = K.split_components(K.map_sentence_type(D.conv_sentences(spark, sf)))
    return kept.groupBy("doc_id", F.col("component").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        failures.select("doc_id", F.col("message").alias("what"), F.lit(0).cast("long").alias("n")))


@query
def drop_summary_sentences(spark, sf):
    return K.drop_summary_sentences(D.doc_sentences(spark, sf)).groupBy("doc_id", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query
def merge_annotations(spark, sf):
    """Two versions of the turns: one typed, one tokenised with ``@-@`` marks."""
    c = D.conv_sentences(spark, sf)
    sid = F.concat_ws(".", F.col("doc_id"), F.col("sent_ix"))
    words = lambda col: F.transform(F.split(col, " "), lambda w: F.struct(
        F.lit("s").alias("source"), F.lit(":tok").alias("role"), w.alias("target"),
        F.array().cast("array<int>").alias("token_ix"), F.array().cast("array<int>").alias("role_token_ix")))
    amrs = c.where("snt_type <> 'topic'").select(
        sid.alias("sent_id"), F.create_map(F.lit("snt"), F.col("text"), F.lit("snt-type"), F.col("snt_type"))
        .alias("metadata"), words(F.col("text")).alias("triples"))
    tok = F.regexp_replace("text", r"[aeiou]", "@-@")
    aligns = c.select(sid.alias("sent_id"), F.create_map(F.lit("tok"), tok).alias("metadata"),
                      F.col("text").alias("text"), words(F.regexp_replace("text", r"  +", " ")).alias("triples"))
    good, failures = T.merge_annotations(amrs, aligns)
    return good.select("sent_id", F.col("metadata")["snt-type"].alias("what"), F.length("text").cast("long").alias("n"),
                       F.length(F.col("metadata")["snt-org"]).cast("long").alias("n_org")).unionByName(
        failures.select(F.col("doc_id").alias("sent_id"), F.col("message").alias("what"),
                        F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_org")))


@query
def filter_keys(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("source").alias("doc_id"), "n_chars")
    kept, unknown = K.filter_keys(docs, "src1, src3\tsrc5,nowhere")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.lit("found").alias("status")).unionByName(
        unknown.select("doc_id", F.lit(0).cast("long").alias("n"), F.lit("unknown").alias("status")))


@query
def corpus_summary(spark, sf):
    return K.corpus_summary(D.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "len")


@query
def corpus_fingerprint(spark, sf):
    return K.corpus_fingerprint(D.table(spark, sf, "documents"))


@query
def incremental_ids(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "lang")
    return missing_documents(docs, D.table(spark, sf, "labels").select("doc_id"))


@query
def content_upsert(spark, sf):
    """A store of document lengths brought from an older version of the documents to the present one.

    In the older version, documents of good quality had another text and English ones without a label
    were not there yet; toxic ones have left since.
    """
    docs = D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id", "left")
    good, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    new = F.col("quality").isNull() & F.coalesce(F.col("lang") == "en", F.lit(False))
    older = docs.where(~new).select("doc_id", F.when(good, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("text"))
    present = docs.where(~toxic).select("doc_id", "text")

    def measure(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"))

    store = ContentStore(spark, f"{lineage_dir(spark)}/store-{uuid.uuid4().hex}", measure(present).schema)
    for corpus in (older, present, present):
        store.upsert(corpus, measure)
    return store.read().select("doc_id", "n_chars", "version")


@query
def missing_vectors(spark, sf):
    """Conversations with a word that has no vector of its own."""
    _, _, vectors = D.conv_graph(spark, sf)
    tokens = B.text_tokens(B.text_sentences(D.conv_texts(spark, sf))).select(*KEY, "sent_ix", "ix", "norm")
    known = vectors.join(tokens.where("norm rlike '^[a-z]'").select(*KEY, "sent_ix", "ix"), [*KEY, "sent_ix", "ix"], "left_semi")
    out, failures = K.attach_embeddings(tokens, known)
    return failures.select("doc_id", "message").join(
        out.groupBy("doc_id").agg(F.count_if(F.col("vec").isNull()).alias("n_missing")), "doc_id")


@query
def several_corpora(spark, sf):
    """Documents of each language as a corpus of its own, written and read back."""
    base = f"{lineage_dir(spark)}/corpora-{uuid.uuid4().hex}"
    d = D.table(spark, sf, "documents")
    parts = F.split("text", "\n", 2)
    rows = d.select(F.col("lang"), F.col("doc_id").cast("string").alias("id"), F.get(parts, F.lit(1)).alias("body"),
                    F.get(parts, F.lit(0)).alias("summary"))
    langs = [r["lang"] for r in d.select("lang").distinct().where("lang is not null").collect()]
    rows.write.partitionBy("lang").json(base)
    docs = K.read_corpora(spark, {x: f"{base}/lang={x}" for x in langs}, multi_line=False)
    return docs.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n"), F.count("body").alias("n_body"),
        F.sum(F.length("summary")).alias("summary_chars"))


# --- scores ---------------------------------------------------------------------------

@query
def rouge_n(spark, sf):
    out = E.rouge_n(E.text_pairs(D.conv_pairs(spark, sf)))
    return out.select("pair_id", *[_r(c) for c in out.columns if c != "pair_id"])


@query
def rouge_l(spark, sf):
    out = E.rouge_l(E.text_pairs(D.conv_pairs(spark, sf)))
    return out.select("pair_id", *[_r(c) for c in out.columns if c != "pair_id"])


@query
def bleu(spark, sf):
    return E.bleu(E.text_pairs(D.conv_pairs(spark, sf))).select("pair_id", _r("bleu"))


@query
def score_batch(spark, sf):
    """Several score methods by name over the conversations' pairs."""
    pairs = E.text_pairs(D.conv_pairs(spark, sf))
    out = E.score_batch(pairs, {"rouge": lambda p: E.rouge_n(p, range(1, 3)), "bleu": E.bleu})
    return out.select("pair_id", *[_r(c) for c in out.columns if c != "pair_id"])


@query
def wlk(spark, sf):
    nodes, edges, _ = D.purchase_pairs(spark, sf)
    return E.wlk(nodes, edges).select("pair_id", _r("wlk"))


@query
def smatch(spark, sf):
    nodes, edges, tops = D.purchase_pairs(spark, sf)
    out = E.smatch(materialize(E.pair_triples(nodes, edges, tops), "match-triples"))
    return out.select("pair_id", _r("smatch_precision"), _r("smatch_recall"), _r("smatch_f_score"), _r("smatch_upper"))


@query
def smatch_check(spark, sf):
    """Whether the mappings of the purchases' graphs match as many triples as they claim, and
    no more than their upper bound."""
    nodes, edges, tops = D.purchase_pairs(spark, sf)
    triples = materialize(E.pair_triples(nodes, edges, tops), "match-triples")
    found = materialize(E.best_matching(triples), "matchings")
    counted = E.matched_triples(triples, found).withColumnRenamed("matched", "_counted")
    both = triples.groupBy("pair_id").agg(F.countDistinct("side").alias("_s")).where("_s = 2").select("pair_id")
    return both.join(found, "pair_id", "left").join(counted, "pair_id", "left").select(
        "pair_id", ((F.col("matched") == F.col("_counted")) & (F.col("matched") <= F.col("upper"))).alias("right"))


@query
def smatch_triples(spark, sf):
    nodes, edges, tops = D.purchase_pairs(spark, sf)
    return E.pair_triples(nodes, edges, tops).groupBy("pair_id", "side", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def compare_scores(spark, sf):
    """Cells in which the scores of a pair and of its exchanged sides differ."""
    p = E.text_pairs(D.conv_pairs(spark, sf))
    swapped = p.select("pair_id", F.col("b").alias("a"), F.col("a").alias("b"))
    one, two = (E.rouge_n(t, range(1, 3)) for t in (p, swapped))
    return E.compare_scores(one, two, digits=2).select("pair_id", "score", _r("left_value"), _r("right_value"))


# --- the whole program on texts ------------------------------------------------------

def conversation_vectors(spark, sf, settings: AlignSettings) -> tuple[DataFrame, DataFrame]:
    """Nodes of the conversations with all their vectors, and the edges."""
    nodes, edges, vectors = D.conv_graph(spark, sf)
    vectors = materialize(vectors, "token-vectors")
    sentences = S.mean_vectors(vectors, [*KEY, "sent_ix"], D.EMB_DIM)
    words = spark.createDataFrame([], "text string, vec array<double>")
    own = S.node_vectors(materialize(nodes, "nodes"), vectors, words, sentences, D.EMB_DIM)
    own = materialize(S.concept_vector(own, D.EMB_DIM, settings=settings), "node-vectors")
    edges = materialize(edges, "edges")
    # read by every step that follows, so written once
    return materialize(S.neighborhood_vector(own, edges, D.EMB_DIM, settings), "neighborhoods"), edges


def conversation_alignment(spark, sf, settings: AlignSettings = AlignSettings()) -> Alignment:
    """Conversations: graph, vectors, similarity, alignment, statistics."""
    full, edges = conversation_vectors(spark, sf, settings)
    links = S.alignment_capacities(S.pair_similarity(full, settings), settings).select(
        "doc_id", "src_node", "smy_node", "sim", "capacity")
    nodes = full.select(*B.NODE_COLUMNS)
    return align(nodes, edges, materialize(links, "pairs"), settings)


@query
def score_pairs(spark, sf):
    """User and assistant side of every conversation as two versions of one document:
    aligned, and scored by the alignment and by shared words."""
    sides = D.conv_texts(spark, sf).groupBy(F.col("doc_id").alias("pair_id")).agg(*[
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
            F.col("component") == c, F.struct("part_ix", "text")))), lambda t: t["text"]), " ").alias(name)
        for c, name in (("source", "text_a"), ("summary", "text_b"))])
    pairs = sides.where("text_a <> '' and text_b <> ''")
    out = score_pairs_of(conversation_alignment(spark, sf), pairs, {"rouge": lambda p: E.rouge_n(p, range(1, 3))})
    return out.select("pair_id", *[_r(c) for c in out.columns if c != "pair_id"])


@query
def conversation_pairs(spark, sf):
    """Aligned pairs of the conversations by document and type."""
    settings = AlignSettings()
    full, _ = conversation_vectors(spark, sf, settings)
    return S.pair_similarity(full, settings).groupBy("doc_id", "attrib_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("sim"), 5).alias("total"), F.round(F.max("sim"), 6).alias("best"))


@query
def align_conversations(spark, sf):
    out = conversation_alignment(spark, sf).stats_frame()
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[_r(c) if c in doubles else F.col(c) for c in out.columns if c != "text"])
