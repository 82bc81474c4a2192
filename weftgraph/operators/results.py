"""Result tables: flows, counts, statistics and reduced graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.coref import bipartite_relations, component_relations
from weftgraph.operators.flow import reentrancies, share_alignments
from weftgraph.operators.graph import KEY, delete_edges
from weftgraph.schemas import ALIGNABLE_TYPES, EDGE_TYPES, NODE_TYPES
from weftgraph.settings import AlignSettings
from weftgraph.skew import join_salted, with_totals

FLOW_COLUMNS = ["s_descr", "t_descr", "s_toks", "t_toks", "s_id", "t_id", "s_attr", "t_attr",
                "edge_type", "rel_id", "is_bipartite", "flow", "reentrancy", "align_flow", "align_count"]

COLUMN_NOTES = {
    "s_descr": "display text of the node the edge leaves in the flow direction",
    "t_descr": "display text of the node the edge enters",
    "s_toks": "tokens of the leaving node as JSON of text and character span",
    "t_toks": "tokens of the entered node as JSON of text and character span",
    "s_attr": "type of the leaving node: doc, sentence, concept or attribute",
    "t_attr": "type of the entered node",
    "s_id": "id of the leaving node",
    "t_id": "id of the entered node; null for the sink",
    "edge_type": "role for component edges, align for edges between the components",
    "rel_id": "coreference relation of the edge, null for none",
    "is_bipartite": "whether that relation spans the components, null for none",
    "flow": "flow of the edge per descendant",
    "reentrancy": "whether the leaving node has several parents",
    "align_flow": "sum of the alignment flow into the entered node",
    "align_count": "number of alignment edges into the entered node",
}


def describe_columns(df: DataFrame) -> DataFrame:
    """The column dictionary attached as column comments."""
    for name, note in COLUMN_NOTES.items():
        if name in df.columns:
            df = df.withMetadata(name, {"comment": note})
    return df


def component_flows(edge_flows: DataFrame, align_edges: DataFrame) -> DataFrame:
    """Edges into each component as source node, target node and edge.

    Role and sentence edges run child to parent; alignment edges come from the
    other component; the root's terminal edge has a null target.
    """
    inner = edge_flows.where("edge_type in ('role', 'sentence', 'terminal')").select(
        *KEY, F.col("child_id").alias("s_id"), F.col("component").alias("_s_comp"),
        F.col("parent_id").alias("t_id"), F.lit("role").alias("edge_type"),
        (F.col("edge_type") == "terminal").alias("is_terminal"),
        F.lit(None).cast("long").alias("rel_id"), F.lit(None).cast("boolean").alias("is_bipartite"), "flow")
    across = share_alignments(_with_relations(align_edges)).select(
        *KEY, F.col("from_id").alias("s_id"),
        F.when(F.col("component") == "source", "summary").otherwise("source").alias("_s_comp"),
        F.col("to_id").alias("t_id"), F.lit("align").alias("edge_type"), F.lit(False).alias("is_terminal"),
        "rel_id", "is_bipartite", F.col("capacity").alias("flow"))
    return inner.unionByName(across)


def _with_relations(align_edges: DataFrame) -> DataFrame:
    for name, kind in (("rel_id", "long"), ("is_bipartite", "boolean")):
        if name not in align_edges.columns:
            align_edges = align_edges.withColumn(name, F.lit(None).cast(kind))
    return align_edges.withColumn("rel_id", F.col("rel_id").cast("long"))


def root_flow(edge_flows: DataFrame) -> DataFrame:
    """Flow of the one edge into the sink; null for a component with several or none,
    which is a failure of its document (``terminal_failures``)."""
    is_end = F.col("edge_type") == "terminal"
    return edge_flows.groupBy(*KEY).agg(
        F.count_if(is_end).alias("_n"), F.sum(F.when(is_end, F.col("flow"))).alias("_f")).select(
        *KEY, F.when(F.col("_n") == 1, F.col("_f")).alias("root_flow"))


def terminal_failures(edge_flows: DataFrame) -> DataFrame:
    """Failure rows of documents with a component that has not exactly one edge into the sink."""
    bad = root_flow(edge_flows).where("root_flow is null")
    return bad.groupBy("doc_id").agg(F.min("component").alias("_c")).select(
        "doc_id", F.lit("flow").alias("stage"), F.concat(F.lit("not one terminal edge: "), F.col("_c")).alias("message"))


def alignment_flows(nodes: DataFrame, edge_flows: DataFrame, align_edges: DataFrame) -> DataFrame:
    """The result table of all flows, with alignment totals of every target."""
    flows = component_flows(edge_flows, align_edges)
    is_align = F.col("edge_type") == "align"
    totals = [F.sum(F.when(is_align, F.col("flow")).otherwise(0.0)).alias("align_flow"),
              F.count_if(is_align).alias("align_count")]
    flows = flows.withColumn("_t", F.coalesce(F.col("t_id").cast("string"), F.lit("T")))
    flows = with_totals(flows, [*KEY, "_t"], totals, ["s_id"]).drop("_t")
    has_spans = "spans" in nodes.columns
    info = nodes.select(*KEY, "node_id", "descr", "attrib_type",
                        (F.col("spans") if has_spans else F.lit(None).cast("string")).alias("spans"))
    s = info.select("doc_id", F.col("component").alias("_s_comp"), F.col("node_id").alias("s_id"),
                    F.col("descr").alias("s_descr"), F.col("attrib_type").alias("s_attr"),
                    F.col("spans").alias("s_toks"))
    t = info.select(*KEY, F.col("node_id").alias("t_id"), F.col("descr").alias("_t_descr"),
                    F.col("attrib_type").alias("_t_attr"), F.col("spans").alias("t_toks"))
    multi = reentrancies(edge_flows).select(
        "doc_id", F.col("component").alias("_s_comp"), F.col("node_id").alias("s_id"),
        F.lit(True).alias("_multi"))
    out = join_salted(flows, s, ["doc_id", "_s_comp", "s_id"], ["t_id"], "left")
    out = join_salted(out, t, [*KEY, "t_id"], ["s_id"], "left")
    out = join_salted(out, multi, ["doc_id", "_s_comp", "s_id"], ["t_id"], "left")
    out = (out.withColumn("t_descr", F.when(F.col("is_terminal"), F.lit("T")).otherwise(F.col("_t_descr")))
           .withColumn("t_attr", F.when(F.col("is_terminal"), F.lit("control")).otherwise(F.col("_t_attr")))
           .withColumn("reentrancy", F.coalesce("_multi", F.lit(False))))
    return describe_columns(out.select("doc_id", F.col("component").alias("name"), *FLOW_COLUMNS))


def _counts(table: DataFrame, column: str, types: tuple[str, ...], suffix: str) -> DataFrame:
    return table.groupBy(*KEY).agg(*[
        F.count_if(F.col(column) == t).alias(f"{suffix}_{t}_count") for t in types])


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per type, zero where a type is absent."""
    return _counts(nodes, "attrib_type", NODE_TYPES, "node")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges per type, zero where a type is absent."""
    return _counts(edges, "edge_type", EDGE_TYPES, "edge")


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes plus edges per component."""
    n = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, KEY, "left").fillna(0, ["n_edges"]).withColumn(
        "size", F.col("n_nodes") + F.col("n_edges"))


def alignable_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*KEY).agg(
        F.count_if(F.col("attrib_type").isin(*ALIGNABLE_TYPES)).alias("alignable"))


def connected_stats(nodes: DataFrame, align_edges: DataFrame) -> DataFrame:
    """Aligned and alignable nodes of each component and their quotient."""
    hit = (share_alignments(align_edges).select(*KEY, F.col("to_id").alias("node_id")).distinct()
           .groupBy(*KEY).agg(F.count(F.lit(1)).alias("aligned")))
    out = alignable_nodes(nodes).join(hit, KEY, "left").fillna(0, ["aligned"])
    return out.withColumn("aligned_portion", F.when(
        F.col("alignable") > 0, F.col("aligned") / F.col("alignable")))


def reentrancy_stats(edge_flows: DataFrame) -> DataFrame:
    """Number of reentrancies, those with a starved edge, and their flow."""
    return reentrancies(edge_flows).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("has_zero_flow").alias("zero_flow"),
        F.sum("total_flow").alias("total_flow"))


def combine_reentrancies(stats: DataFrame) -> DataFrame:
    """Reentrancy statistics over both components."""
    return stats.groupBy("doc_id").agg(
        F.sum("total").alias("total"), F.sum("zero_flow").alias("zero_flow"),
        F.sum("total_flow").alias("total_flow"))


def component_stats(nodes: DataFrame, edges: DataFrame, edge_flows: DataFrame,
                    align_edges: DataFrame, coref: DataFrame | None = None) -> DataFrame:
    """One row per document and component."""
    out = (connected_stats(nodes, align_edges)
           .join(root_flow(edge_flows), KEY, "left")
           .join(node_counts(nodes), KEY, "left")
           .join(edge_counts(edges), KEY, "left")
           .join(reentrancy_stats(edge_flows).select(*KEY, F.col("total").alias("reentrancies")), KEY, "left"))
    if coref is not None:
        out = out.join(component_relations(coref), KEY, "left")
    else:
        out = out.withColumn("relations", F.lit(0).cast("long"))
    zero = ["reentrancies", "relations", *[f"edge_{t}_count" for t in EDGE_TYPES]]
    return out.fillna(0, zero)


def harmonic_mean(values: Column, mode: str = "strict") -> Column:
    """Aggregate: harmonic mean of portions; a null portion is not counted.

    ``strict`` is 0 as soon as one value is 0.  ``reference`` lets a zero add nothing to
    the sum of reciprocals but still counts it.  All zero gives 0, none gives NaN.
    """
    n = F.count(values)
    rec = F.sum(F.when(values == 0, F.lit(0.0)).otherwise(F.lit(1.0) / values))
    hm = F.when(n == 0, F.lit(float("nan"))).when(rec == 0, F.lit(0.0)).otherwise(n / rec)
    if mode == "reference":
        return hm
    return F.when(F.count_if(values == 0) > 0, F.lit(0.0)).otherwise(hm)


def aggregate_stats(stats: DataFrame, coref: DataFrame | None = None,
                    settings: AlignSettings = AlignSettings()) -> DataFrame:
    """One row per document over its components."""
    out = stats.groupBy("doc_id").agg(
        harmonic_mean(F.col("aligned_portion"), settings.hmean).alias("aligned_portion_hmean"),
        F.avg("root_flow").alias("mean_flow"),
        F.sum("alignable").alias("tot_alignable"), F.sum("aligned").alias("tot_aligned"),
        F.sum("reentrancies").alias("reentrancies"))
    out = out.withColumn("aligned_portion", F.col("tot_aligned") / F.nullif("tot_alignable", F.lit(0)))
    if coref is None:
        return out.withColumn("bipartite_relations", F.lit(0).cast("long"))
    n = bipartite_relations(coref).groupBy("doc_id").agg(F.count(F.lit(1)).alias("bipartite_relations"))
    return out.join(n, "doc_id", "left").fillna(0, ["bipartite_relations"])


AGG_COLUMNS = ["aligned_portion_hmean", "mean_flow", "tot_alignable", "tot_aligned",
               "aligned_portion", "reentrancies"]


def stats_frame(stats: DataFrame, agg: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per component with the document's statistics repeated as ``agg_*``."""
    renamed = agg.select("doc_id", *[F.col(c).alias(f"agg_{c}") for c in AGG_COLUMNS])
    out = stats.join(renamed, "doc_id")
    if texts is not None:
        out = out.join(texts.select(*KEY, "text"), KEY, "left")
    else:
        out = out.withColumn("text", F.lit(None).cast("string"))
    return out.select("doc_id", "component", "text", *[f"agg_{c}" for c in AGG_COLUMNS], "root_flow",
                      "alignable", "aligned", "aligned_portion", "reentrancies")


def result_status(docs: DataFrame, failures: DataFrame) -> DataFrame:
    """Status of every document; a failed one carries its error record."""
    first = failures.groupBy("doc_id").agg(
        F.min(F.struct("stage", "message")).alias("failure"))
    return docs.select("doc_id").distinct().join(first, "doc_id", "left").withColumn(
        "status", F.when(F.col("failure").isNull(), "success").otherwise("failure"))


def corpus_report(flows: DataFrame) -> DataFrame:
    """Flows of all documents with the document id first."""
    rest = [c for c in flows.columns if c != "doc_id"]
    return flows.select("doc_id", *rest)


def reduce_graph(nodes: DataFrame, edge_flows: DataFrame, align_edges: DataFrame,
                 component: str = "source", prune: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph in forward direction without terminals: nodes, edges and alignments.

    With ``prune`` edges without flow go, except document edges of the named
    component, and then the nodes that lost all their edges.
    """
    inner = edge_flows.where("edge_type <> 'terminal'")
    if not prune:
        return nodes, inner, align_edges
    keep_doc = (F.col("component") == component) & (F.col("edge_type") == "doc")
    drop = inner.where((F.col("flow") == 0) & ~keep_doc)
    kept, left = delete_edges(inner, nodes, drop, include_nodes=True)
    live = align_edges.where(F.col("capacity") > 0)
    held = share_alignments(live).select(*KEY, F.col("to_id").alias("node_id")).distinct()
    # a node that still has an alignment keeps its place
    back = nodes.join(held, [*KEY, "node_id"], "left_semi").join(
        left.select(*KEY, "node_id"), [*KEY, "node_id"], "left_anti")
    return left.unionByName(back.select(*left.columns)), kept, live


def score_row(stats: DataFrame, agg: DataFrame) -> DataFrame:
    """Flat score row per document: aggregate values and both components' columns."""
    per = ["aligned_portion", "root_flow", "reentrancies", "relations",
           *[f"node_{t}_count" for t in NODE_TYPES], *[f"edge_{t}_count" for t in EDGE_TYPES]]
    cols = [F.max(F.when(F.col("component") == c, F.col(p))).alias(f"{c}_{p}")
            for c in ("source", "summary") for p in per]
    wide = stats.groupBy("doc_id").agg(*cols)
    head = agg.select("doc_id", F.col("mean_flow").alias("agg_mean_flow"),
                      F.col("aligned_portion").alias("agg_aligned_portion"), "bipartite_relations")
    return head.join(wide, "doc_id")
