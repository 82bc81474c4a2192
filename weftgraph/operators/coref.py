"""Alignment edges from coreference relations.

``coref`` rows are ``(doc_id, rel_id, component, sent_ix, variable)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.flow import TO_NODE
from weftgraph.skew import join_salted

ALIGN_COLUMNS = ["doc_id", "src_node", "smy_node", "rel_id", "is_bipartite", "capacity"]


def resolve_refs(coref: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with the concept node they stand for; unknown ones are left out."""
    concepts = nodes.where("attrib_type = 'concept'").select(
        "doc_id", "component", "sent_ix", "variable", "node_id")
    return coref.join(concepts, ["doc_id", "component", "sent_ix", "variable"])


def ref_alignments(refs: DataFrame, align_edges: DataFrame, component: str) -> DataFrame:
    """References of a component with each alignment edge into their node."""
    to_col = TO_NODE[component]
    other = TO_NODE["summary" if component == "source" else "source"]
    edges = align_edges.select("doc_id", F.col(to_col).alias("node_id"),
                               F.col(other).alias("other_id"), "capacity")
    return refs.where(F.col("component") == component).join(edges, ["doc_id", "node_id"])


def intra_coref(refs: DataFrame, align_edges: DataFrame, component: str = "source") -> DataFrame:
    """Edges lent between the references of one relation inside a component.

    Every alignment of a reference is lent, with its capacity, to every other
    reference.  Lenders and borrowers are joined on the relation; a relation
    with very many references is split over tasks on the lenders' side.
    """
    lenders = ref_alignments(refs, align_edges, component).select(
        "doc_id", "rel_id", F.col("node_id").alias("lender"), F.col("sent_ix").alias("lender_sent"),
        F.col("variable").alias("lender_var"), "other_id", "capacity")
    borrowers = refs.where(F.col("component") == component).select(
        "doc_id", "rel_id", F.col("node_id").alias("borrower"), F.col("sent_ix").alias("b_sent"),
        F.col("variable").alias("b_var"))
    lent = join_salted(lenders, borrowers, ["doc_id", "rel_id"], ["lender", "other_id"]).where(
        (F.col("lender_sent") != F.col("b_sent")) | (F.col("lender_var") != F.col("b_var")))
    to_col = TO_NODE[component]
    other = TO_NODE["summary" if component == "source" else "source"]
    return lent.select("doc_id", F.col("borrower").alias(to_col), F.col("other_id").alias(other),
                       "rel_id", F.lit(False).alias("is_bipartite"), "capacity").select(*ALIGN_COLUMNS)


def bipartite_relations(coref: DataFrame) -> DataFrame:
    """Relations whose references lie in both components."""
    return (coref.groupBy("doc_id", "rel_id")
            .agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
            .where("_lo <> _hi").select("doc_id", "rel_id"))


def component_relations(coref: DataFrame) -> DataFrame:
    """Number of relations that lie within one component, per component."""
    inner = (coref.groupBy("doc_id", "rel_id")
             .agg(F.min("component").alias("component"), F.max("component").alias("_hi"))
             .where("component = _hi"))
    return inner.groupBy("doc_id", "component").agg(F.count(F.lit(1)).alias("relations"))


def bipartite_coref(refs: DataFrame, coref: DataFrame, align_edges: DataFrame) -> DataFrame:
    """Alignment edges after the spanning relations have been put in.

    Each source-summary reference pair of a spanning relation gets an edge of
    capacity 1.  It replaces one existing edge of the node pair, the plain one
    before lent ones; the pair's further parallel edges stay.
    """
    spanning = bipartite_relations(coref)
    side = {c: join_salted(refs.where(F.col("component") == c), spanning, ["doc_id", "rel_id"],
                           ["node_id"], "left_semi") for c in ("source", "summary")}
    src = side["source"].select("doc_id", "rel_id", F.col("node_id").alias("src_node"))
    smy = side["summary"].select("doc_id", "rel_id", F.col("node_id").alias("smy_node"))
    new = (join_salted(src, smy, ["doc_id", "rel_id"], ["src_node"])
           .groupBy("doc_id", "src_node", "smy_node").agg(F.max("rel_id").alias("_new_rel")))
    first = align_edges.groupBy("doc_id", "src_node", "smy_node").agg(
        F.min(F.coalesce("rel_id", F.lit(-1))).alias("_first"))
    hit = new.join(first, ["doc_id", "src_node", "smy_node"], "left")
    replaced = hit.where("_first is not null").select(
        "doc_id", "src_node", "smy_node", F.col("_first").alias("_rel"), F.lit(True).alias("_gone"))
    kept = (align_edges.withColumn("_rel", F.coalesce("rel_id", F.lit(-1)))
            .join(replaced, ["doc_id", "src_node", "smy_node", "_rel"], "left")
            .where("_gone is null").drop("_rel", "_gone"))
    added = hit.select("doc_id", "src_node", "smy_node", F.col("_new_rel").alias("rel_id"),
                       F.lit(True).alias("is_bipartite"), F.lit(1.0).alias("capacity"))
    return kept.unionByName(added, allowMissingColumns=True)


def add_coref(align_edges: DataFrame, coref: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lent edges, then spanning relations.

    At this point alignments point at the source component, so only source
    references have alignments to lend.
    """
    base = align_edges
    for name, kind in (("rel_id", "long"), ("is_bipartite", "boolean")):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    refs = resolve_refs(coref, nodes)
    lent = intra_coref(refs, base, "source").withColumn("rel_id", F.col("rel_id").cast("long"))
    return bipartite_coref(refs, coref, base.unionByName(lent, allowMissingColumns=True))


def count_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document, coreference edges in ``after``."""
    return after.where("rel_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("added"))
