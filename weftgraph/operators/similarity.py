"""Vectors of nodes and the similarity of source-summary node pairs.

The number of same-type pairs of a document is the product of its two sides.
Pairs are therefore never listed: nodes are cut into blocks of bounded size, the
pairs of *blocks* are the units of work, each unit is one matrix product in one
task, and only pairs above the threshold leave it.  Blocks gather vectors that point
alike, so the angle between two blocks bounds the cosines of their pairs, and units that the
bound excludes are not made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import vectors as V
from weftgraph.lineage import materialize
from weftgraph.operators.batches import column, in_batches
from weftgraph.operators.graph import KEY, k_hop, ring_sums
from weftgraph.operators.guard import FAILURE, guarded_pair
from weftgraph.operators.trees import forest, reentrant_graphs
from weftgraph.settings import AlignSettings
from weftgraph.skew import join_salted, with_totals

GROUP = ["doc_id", "attrib_type"]


# --- pairs -----------------------------------------------------------------

def pair_counts(nodes: DataFrame) -> DataFrame:
    """Number of same-type source-summary pairs per document and type."""
    one = F.lit(1)
    counted = (nodes.where("attrib_type <> 'control'").groupBy(*GROUP).agg(
        F.count(F.when(F.col("component") == "source", one)).alias("n_source"),
        F.count(F.when(F.col("component") == "summary", one)).alias("n_summary")))
    return counted.withColumn("n_pairs", F.col("n_source") * F.col("n_summary"))


def block_nodes(nodes: DataFrame, block_rows: int) -> DataFrame:
    """Nodes with a block number; blocks hold about ``block_rows`` nodes."""
    n = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_blocks")
    return (with_totals(nodes, [*KEY, "attrib_type"], [n], ["node_id"])
            .withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("_blocks"))).drop("_blocks"))


#: Pivots of one document and node type at most; more nodes make more blocks per pivot.
PIVOTS = 256
#: Angles are rounded; a bound gives way by this much (radians).
SLACK = 1e-6


def pivot_blocks(nodes: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with a ``block`` of vectors that point alike, and the pivots they are gathered around.

    Groups of one document and type that fill several blocks draw about as many pivots by a hash of the
    node; each node goes to the pivot with the nearest direction, a pivot with many nodes has several
    blocks.  ``pivot`` is null in small groups and -1 for zero vectors; ``angle`` is that to the pivot.
    ``nodes`` has ``vec`` and any payload.
    """
    sizes = materialize(nodes.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows), "pivot-groups")
    none = [F.lit(None).cast("int").alias("pivot"), F.lit(None).cast("double").alias("angle")]
    no_pivots = nodes.select(*GROUP, F.lit(0).alias("pivot"), "vec").limit(0)
    if sizes.isEmpty():
        return block_nodes(nodes, block_rows).select("*", *none), no_pivots
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(101), "component", "node_id"), 1)
    asked = F.least(F.lit(float(PIVOTS)), F.ceil(F.col("_n") / block_rows)) / F.col("_n")
    length = V.norm(F.col("vec"))
    some = join_salted(nodes, sizes, GROUP, ["node_id"]).withColumn("_h", drawn).where(length > 0).select(
        *GROUP, "vec", "component", "node_id", "_h", (F.col("_h") / F.lit(2.0 ** 63) < asked).alias("_in"))
    # the first by hash is one in any case
    least = some.groupBy(*GROUP).agg(F.min("_h").alias("_h"))
    picked = some.where("_in").unionByName(some.join(least, [*GROUP, "_h"], "left_semi")).dropDuplicates([*GROUP, "component", "node_id"])
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy("_h", "component", "node_id")) - 1
    pivots = materialize(picked.withColumn("pivot", rank).select(*GROUP, "pivot", "vec"), "pivots")
    large = block_nodes(join_salted(nodes, sizes.select(*GROUP), GROUP, ["node_id"], "left_semi"), block_rows)
    units = large.select(*KEY, "attrib_type", "block").distinct()
    asked_of = units.join(pivots.withColumnRenamed("vec", "_pvec"), GROUP)
    asked_of = asked_of.toDF(*asked_of.columns)
    keys, columns = [*KEY, "attrib_type", "block"], list(nodes.columns)

    def nearest(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        rows = rows[columns].copy()
        rows["pivot"], rows["angle"] = -1, 0.0
        if len(centres) and len(rows):
            unit = _unit_rows(rows["vec"])
            cos = unit @ _unit_rows(centres["_pvec"]).T
            best = cos.argmax(axis=1)
            there = unit.any(axis=1)
            rows["pivot"] = np.where(there, centres["pivot"].to_numpy()[best], -1)
            rows["angle"] = np.where(there, np.arccos(np.clip(cos[np.arange(len(rows)), best], -1.0, 1.0)), 0.0)
        return rows

    schema = T.StructType([*nodes.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = large.groupBy(*keys).cogroup(asked_of.groupBy(*keys)).applyInPandas(nearest, schema)
    placed = materialize(placed, "pivot-nodes")
    n = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_blocks")
    placed = with_totals(placed, [*KEY, "attrib_type", "pivot"], [n], ["node_id"])
    sub = F.pmod(F.xxhash64("node_id"), F.col("_blocks"))
    placed = placed.withColumn("block", (F.col("pivot") + 1).cast("long") * F.lit(1 << 32) + sub).drop("_blocks")
    small = block_nodes(join_salted(nodes, sizes.select(*GROUP), GROUP, ["node_id"], "left_anti"), block_rows)
    return placed.select(*columns, "block", "pivot", "angle").unionByName(small.select(*columns, "block", *none)), pivots


def bipartite_blocks(blocked: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """Pairs of source and summary blocks of the same document and node type.

    With pivots, ``most``: the largest cosine that vectors of the two blocks can have.  It is that
    of the angle between the pivots less how far the blocks' vectors are from them.
    """
    blocked = blocked.where("attrib_type <> 'control'")
    if pivots is None:
        b = blocked.select(*KEY, "attrib_type", "block").distinct()
    else:
        b = blocked.groupBy(*KEY, "attrib_type", "block").agg(F.max("pivot").alias("pivot"), F.max("angle").alias("angle"))
    src = b.where("component = 'source'").drop("component").withColumnsRenamed(
        {"block": "src_block", "pivot": "_p", "angle": "_a"})
    smy = b.where("component = 'summary'").drop("component").withColumnsRenamed(
        {"block": "smy_block", "pivot": "_q", "angle": "_b"})
    units = src.join(smy, GROUP)
    if pivots is None:
        return units
    left = pivots.select(*GROUP, F.col("pivot").alias("_p"), F.col("vec").alias("_pv"))
    right = pivots.select(*GROUP, F.col("pivot").alias("_q"), F.col("vec").alias("_qv"))
    dot = V.dot(F.col("_pv"), F.col("_qv")) / (V.norm(F.col("_pv")) * V.norm(F.col("_qv")))
    apart = left.join(right, GROUP).select(*GROUP, "_p", "_q", F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))).alias("_apart"))
    nearest = F.greatest(F.col("_apart") - F.col("_a") - F.col("_b") - F.lit(SLACK), F.lit(0.0))
    most = F.when(F.least("_p", "_q") < 0, F.lit(0.0)).otherwise(F.greatest(F.coalesce(F.cos(nearest), F.lit(1.0)), F.lit(0.0)))
    return units.join(apart, [*GROUP, "_p", "_q"], "left").select(*GROUP, "src_block", "smy_block", most.alias("most"))


def blocked_pairs(nodes: DataFrame, payload: list[str], kernel: Callable, schema: str,
                  block_rows: int, bound: Column | None = None, threshold: float = 0.0,
                  keep_failures: bool = False) -> DataFrame:
    """Run ``kernel(source_block, summary_block) -> pairs`` on every block pair that can have a pair.

    With ``keep_failures`` a block pair whose kernel raises is a row with its document and a
    ``failure`` (``guard.split_failures``) instead of the end of the job.  Blocks are then made by
    hash alone, since pivots read the vectors.

    ``bound`` is the largest similarity of a pair of blocks as an expression of ``most``, the
    largest cosine of their vectors, and ``attrib_type``; where it does not pass the threshold the two
    blocks are never brought together.
    """
    chosen = nodes.select(*KEY, "node_id", "attrib_type", *payload)
    if bound is None or keep_failures:
        blocked = block_nodes(chosen, block_rows)
        units = bipartite_blocks(blocked)
    else:
        typed = chosen.where("doc_id is not null and attrib_type <> 'control'")
        sizes = typed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
        sizes = materialize(sizes.select(*GROUP), "large-groups")

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            return kernel(rows[rows["component"] == "source"], rows[rows["component"] == "summary"])

        # a group that fits one block is one unit: it is brought together as it is
        if sizes.isEmpty():
            return typed.groupBy(*GROUP).applyInPandas(whole, schema)
        fits = join_salted(typed, sizes, GROUP, ["node_id"], "left_anti").groupBy(*GROUP).applyInPandas(whole, schema)
        chosen = materialize(join_salted(typed, sizes, GROUP, ["node_id"], "left_semi"), "large-nodes")
        blocked, pivots = pivot_blocks(chosen, block_rows)
        units = bipartite_blocks(blocked, pivots).where(bound > F.lit(threshold)).drop("most")
        blocked = blocked.drop("pivot", "angle")
    keys = [*GROUP, "src_block", "smy_block"]
    left = (blocked.where("component = 'source'").withColumnRenamed("block", "src_block")
            .join(units, [*GROUP, "src_block"]))
    right = (blocked.where("component = 'summary'").withColumnRenamed("block", "smy_block")
             .join(units, [*GROUP, "smy_block"]))
    right = right.toDF(*right.columns)  # own column identities, both sides share a scan
    if keep_failures:
        names = ["doc_id", "attrib_type", "src_node", "smy_node", "sim"]
        kernel, schema = guarded_pair(kernel, GROUP, names), f"{schema}, {FAILURE} string"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(kernel, schema)
    return found if bound is None or keep_failures else fits.unionByName(found)


def _unit_rows(col: pd.Series) -> np.ndarray:
    m = np.stack(col.to_numpy()).astype(np.float64)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _cosines(a: pd.Series, b: pd.Series) -> np.ndarray:
    return np.maximum(_unit_rows(a) @ _unit_rows(b).T, 0.0)


def _emit(src: pd.DataFrame, smy: pd.DataFrame, sim: np.ndarray, threshold: float) -> pd.DataFrame:
    i, j = np.nonzero(sim > threshold)
    return pd.DataFrame({
        "doc_id": src["doc_id"].iloc[0], "attrib_type": src["attrib_type"].iloc[0],
        "src_node": src["node_id"].to_numpy()[i], "smy_node": smy["node_id"].to_numpy()[j],
        "sim": sim[i, j]})


def _pair_schema(nodes: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    return (f"doc_id {kind['doc_id']}, attrib_type {kind['attrib_type']}, "
            f"src_node {kind['node_id']}, smy_node {kind['node_id']}, sim double")


def _empty_pairs() -> pd.DataFrame:
    # an empty column of numbers is no Arrow column of strings
    return pd.DataFrame({c: [] for c in ("doc_id", "attrib_type", "src_node", "smy_node", "sim")}, dtype=object)


def cosine_pairs(nodes: DataFrame, threshold: float, exponent: float = 1.0,
                 block_rows: int = 1024, keep_failures: bool = False) -> DataFrame:
    """Same-type pairs whose clamped cosine (to the exponent) passes the threshold."""
    def kernel(src: pd.DataFrame, smy: pd.DataFrame) -> pd.DataFrame:
        if src.empty or smy.empty:
            return _empty_pairs()
        return _emit(src, smy, _cosines(src["vec"], smy["vec"]) ** exponent, threshold)

    # a pair that passes a threshold of 0 or more has a positive cosine
    bound = F.pow("most", F.lit(exponent)) if threshold >= 0 and exponent > 0 else None
    return blocked_pairs(nodes, ["vec"], kernel, _pair_schema(nodes), block_rows, bound, threshold, keep_failures)


def pair_similarity(nodes: DataFrame, settings: AlignSettings = AlignSettings(),
                    keep_failures: bool = False) -> DataFrame:
    """Similarity of every same-type pair above the threshold.

    ``nodes`` carries ``vec`` (own vector), ``nvec`` (neighbourhood vector), ``svec``
    (vector of its sentence, null for none).  Concepts and attributes: powered
    node cosine plus the skewed neighbourhood cosine, clamped to [0, 1] and
    dampened by the skewed cosine of the two sentences.  Sentences: the cosine.
    Document nodes have zero vectors, so their pairs are 0 and pass no threshold.
    """
    s = settings
    power = {k: s.exponent(k) for k in ("concept", "attribute", "sentence", "neighborhood")}

    def kernel(src: pd.DataFrame, smy: pd.DataFrame) -> pd.DataFrame:
        if src.empty or smy.empty:
            return _empty_pairs()
        kind = src["attrib_type"].iloc[0]
        sim = _cosines(src["vec"], smy["vec"])
        if kind == "sentence":
            sim = sim ** power["sentence"]
        elif kind in ("concept", "attribute"):
            near = _cosines(src["nvec"], smy["nvec"]) ** power["neighborhood"]
            skew = 1.0 / (1.0 + np.exp((s.skew_x - near) * s.skew_compress)) + s.skew_y
            sim = np.clip(sim ** power[kind] + skew, 0.0, 1.0)
            sent = _cosines(src["svec"], smy["svec"]) ** power["sentence"]
            known = src["has_sent"].to_numpy()[:, None] & smy["has_sent"].to_numpy()[None, :]
            damp = sent * s.sentence_dampen + (1.0 - s.sentence_dampen)
            sim = np.where(known, sim * damp, sim)
        return _emit(src, smy, sim, s.similarity_threshold)

    ready = nodes.where("attrib_type in ('sentence', 'concept', 'attribute')").select(
        *KEY, "node_id", "attrib_type", "vec",
        F.coalesce("nvec", "vec").alias("nvec"), F.coalesce("svec", "vec").alias("svec"),
        F.col("svec").isNotNull().alias("has_sent"))
    # at best the neighbourhoods point alike and the sentences do not dampen
    near = 1.0 / (1.0 + np.exp((s.skew_x - 1.0) * s.skew_compress)) + s.skew_y
    far = 1.0 / (1.0 + np.exp(s.skew_x * s.skew_compress)) + s.skew_y
    kind, at = F.col("attrib_type"), lambda k: F.pow("most", F.lit(power[k]))
    bound = F.when(kind == "sentence", at("sentence")).otherwise(
        F.when(kind == "concept", at("concept")).otherwise(at("attribute")) + F.lit(float(max(near, far))))
    usable = s.similarity_threshold >= 0 and 0 <= s.sentence_dampen <= 1 and min(power.values()) > 0
    return blocked_pairs(ready, ["vec", "nvec", "svec", "has_sent"], kernel, _pair_schema(nodes), s.block_rows,
                         bound if usable else None, s.similarity_threshold, keep_failures)


def with_tokens(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the display text of both nodes."""
    d = nodes.select("doc_id", "component", "node_id", "descr")
    src = d.where("component = 'source'").select(
        "doc_id", F.col("node_id").alias("src_node"), F.col("descr").alias("src_tok"))
    smy = d.where("component = 'summary'").select(
        "doc_id", F.col("node_id").alias("smy_node"), F.col("descr").alias("smy_tok"))
    return pairs.join(src, ["doc_id", "src_node"], "left").join(smy, ["doc_id", "smy_node"], "left")


# --- column forms ----------------------------------------------------------

def node_similarity(node_cos: Column, neighbor_cos: Column, kind: str = "concept",
                    settings: AlignSettings = AlignSettings()) -> Column:
    """Clamped sum of the powered node cosine and the skewed neighbourhood cosine."""
    node = F.pow(F.greatest(node_cos, F.lit(0.0)), F.lit(settings.exponent(kind)))
    near = F.pow(F.greatest(neighbor_cos, F.lit(0.0)), F.lit(settings.exponent("neighborhood")))
    return V.clamp_unit(node + V.sigmoid_skew(near, settings))


def sentence_similarity(nodes: DataFrame, settings: AlignSettings = AlignSettings(),
                        threshold: float = 0.0) -> DataFrame:
    """Sentence pairs with cosine and skew; unlisted pairs have cosine <= threshold.

    A pair that is not listed has similarity 0, that is skew ``1 - slope``.
    """
    sents = nodes.where("attrib_type = 'sentence'")
    pairs = cosine_pairs(sents, threshold, settings.exponent("sentence"), settings.block_rows)
    return pairs.withColumn("skew", V.sentence_skew(F.col("sim"), settings))


def dampen(pairs: DataFrame, sentence_pairs: DataFrame,
           settings: AlignSettings = AlignSettings()) -> DataFrame:
    """Concept and attribute similarity times the skew of the two sentences.

    ``pairs`` names the sentences in ``src_sent`` and ``smy_sent`` (null: no
    sentence, not dampened).
    """
    skew = sentence_pairs.select("doc_id", F.col("src_node").alias("src_sent"),
                                 F.col("smy_node").alias("smy_sent"), "skew")
    floor = F.when(F.col("src_sent").isNull() | F.col("smy_sent").isNull(), F.lit(1.0)) \
        .otherwise(F.lit(1.0 - settings.sentence_dampen))
    return (pairs.join(skew, ["doc_id", "src_sent", "smy_sent"], "left")
            .withColumn("sim", F.col("sim") * F.coalesce("skew", floor)).drop("skew"))


# --- node vectors ----------------------------------------------------------

def mean_vectors(vectors: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Component-wise mean per key."""
    return vectors.groupBy(*keys).agg(V.vector_mean("vec", dim).alias("vec"))


def token_means(nodes: DataFrame, token_vectors: DataFrame, dim: int) -> DataFrame:
    """Mean vector of each node's aligned tokens."""
    used = nodes.select(*KEY, "node_id", "sent_ix", F.explode("token_ix").alias("ix"))
    joined = used.join(token_vectors.select(*KEY, "sent_ix", "ix", "vec"), [*KEY, "sent_ix", "ix"])
    return mean_vectors(joined, [*KEY, "node_id"], dim)


def node_vectors(nodes: DataFrame, token_vectors: DataFrame, text_vectors: DataFrame,
                 sentence_vectors: DataFrame, dim: int) -> DataFrame:
    """Own vector of each node by its fallback chain.

    Concept: token mean, then the vector of its lemma (label without frame number);
    attribute: token mean, then constant text; sentence: sentence vector; document
    and control: zeros.  ``text_vectors`` is ``(text, vec)``.  ``label_vec`` keeps
    the lemma's vector for ``concept_vector`` and ``svec`` the sentence's.
    """
    tokens = token_means(nodes, token_vectors, dim).withColumnRenamed("vec", "_tok")
    sents = sentence_vectors.select(*KEY, "sent_ix", F.col("vec").alias("_sent"))
    out = nodes.join(tokens, [*KEY, "node_id"], "left")
    out = join_salted(out, sents, [*KEY, "sent_ix"], ["node_id"], "left")
    kind = F.col("attrib_type")
    lemma = F.regexp_replace("instance", r"-[0-9]+$", "")
    out = out.withColumn("_text", F.when(kind == "concept", lemma).when(kind == "attribute", F.col("constant")))
    texts = text_vectors.select(F.col("text").alias("_text"), F.col("vec").alias("_txt"))
    out = join_salted(out, texts, ["_text"], ["doc_id", "node_id"], "left")
    vec = (F.when(kind.isin("concept", "attribute"), F.coalesce("_tok", "_txt", V.zeros(dim)))
           .when(kind == "sentence", F.coalesce("_sent", V.zeros(dim))).otherwise(V.zeros(dim)))
    return (out.withColumn("vec", vec)
            .withColumn("has_token_vec", F.col("_tok").isNotNull())
            .withColumn("label_vec", F.when(kind == "concept", F.col("_txt")))
            .withColumn("svec", F.when(kind.isin("concept", "attribute"), F.col("_sent")))
            .drop("_tok", "_txt", "_sent", "_text"))


def edge_vectors(edges: DataFrame, relations: DataFrame, text_vectors: DataFrame, dim: int) -> DataFrame:
    """Role edge: relation vector, then the prefix text's; any other edge: ones.

    ``edges`` has ``relation`` (from ``lookup_relation``) and ``role_prefix``.
    """
    rel = relations.select(F.col("label").alias("relation"), F.col("embedding").alias("_rel"))
    txt = text_vectors.select(F.col("text").alias("role_prefix"), F.col("vec").alias("_txt"))
    out = join_salted(edges, rel, ["relation"], ["doc_id", "edge_id"], "left")
    out = join_salted(out, txt, ["role_prefix"], ["doc_id", "edge_id"], "left")
    vec = F.when(F.col("edge_type") == "role", F.coalesce("_rel", "_txt", V.zeros(dim))) \
        .otherwise(V.ones(dim))
    return out.withColumn("edge_vec", vec).drop("_rel", "_txt")


def roles_vector(nodes: DataFrame, edges: DataFrame, rolesets: DataFrame, dim: int,
                 settings: AlignSettings = AlignSettings()) -> DataFrame:
    """Per concept with a frame: sum over its child role edges.

    Each edge gives the weighted child vector plus the weighted role vector: the
    frame's role and function vectors when the index is among the frame's roles,
    else the edge's own vector; without either only the child counts.
    """
    child = nodes.select(*KEY, F.col("node_id").alias("child_id"), F.col("vec").alias("_cv"))
    head = nodes.where("roleset_id is not null").select(
        *KEY, F.col("node_id").alias("parent_id"), "roleset_id")
    role = edges.where("edge_type = 'role'").select(
        *KEY, "edge_id", "parent_id", "child_id", "role_index", "edge_vec")
    joined = role.join(head, [*KEY, "parent_id"]).join(child, [*KEY, "child_id"])
    joined = join_salted(joined, rolesets.select("roleset_id", "roles"), ["roleset_id"],
                         ["doc_id", "edge_id"], "left")
    frame = F.get("roles", F.col("role_index"))
    known = F.col("role_index").isNotNull() & (F.col("role_index") < F.size("roles"))
    framed = F.when(frame["func_emb"].isNotNull(),
                    V.add(V.as_double(frame["role_emb"]), V.as_double(frame["func_emb"])))
    role_vec = F.when(F.coalesce(known, F.lit(False)), framed).otherwise(F.col("edge_vec"))
    weighted = V.add_present(V.scale(F.col("_cv"), settings.role_neighbor_weight),
                             V.scale(F.col("_rv"), settings.role_weight))
    joined = joined.withColumn("_rv", role_vec).withColumn("vec", weighted)
    return joined.groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(
        V.vector_sum("vec", dim).alias("roles_vec"))


def concept_vector(nodes: DataFrame, dim: int, rolesets: DataFrame | None = None,
                   roles: DataFrame | None = None, settings: AlignSettings = AlignSettings()) -> DataFrame:
    """Concept vectors as the weighted sum of token, frame and roles vectors.

    Only present parts count; the frame part of a concept without a known frame is
    its lemma's vector.  Other node types keep their vector.
    """
    s = settings
    none = F.lit(None).cast("array<double>")
    out = nodes
    if rolesets is not None:
        emb = rolesets.select("roleset_id", V.as_double(F.col("embedding")).alias("_frame"))
        out = join_salted(out, emb, ["roleset_id"], ["doc_id", "node_id"], "left")
    else:
        out = out.withColumn("_frame", none)
    if roles is not None:
        out = out.join(roles.select(*KEY, "node_id", F.col("roles_vec").alias("_roles")),
                       [*KEY, "node_id"], "left")
    else:
        out = out.withColumn("_roles", none)
    total = V.add_present(V.scale(F.when(F.col("has_token_vec"), F.col("vec")), s.concept_token_weight),
                          V.scale(F.coalesce("_frame", "label_vec"), s.concept_roleset_weight),
                          V.scale(F.col("_roles"), s.concept_roles_weight))
    return out.withColumn("vec", F.when(F.col("attrib_type") == "concept", F.coalesce(total, V.zeros(dim)))
                          .otherwise(F.col("vec"))).drop("_frame", "_roles")


def ring_corrections(edges: DataFrame, tree: DataFrame, extra: DataFrame, k: int) -> DataFrame:
    """``node_id, other, hops, sign``: what rings of the graph have more (1) or less (-1) than
    the rings of its spanning forest.

    A pair is nearer in the graph than in the forest only over a link that the forest lacks,
    so the vertices within ``k - 1`` hops of such a link's ends are paired across it and nothing else is
    listed.  ``tree`` has ``node_id, up``, ``extra`` the other links.
    """
    both = extra.select(*KEY, F.col("parent_id").alias("a"), F.col("child_id").alias("b")).where("a <> b")
    both = materialize(both.unionByName(both.select(*KEY, F.col("b").alias("a"), F.col("a").alias("b"))), "ring-links")
    balls = materialize(k_hop(edges, k - 1, "all", both.select(*KEY, F.col("a").alias("node_id"))), "ring-balls")
    near = balls.select(*KEY, F.col("center").alias("a"), "node_id", F.col("hops").alias("_i"))
    far = balls.select(*KEY, F.col("center").alias("b"), F.col("node_id").alias("other"), F.col("hops").alias("_j"))
    pairs = (both.join(near, [*KEY, "a"]).join(far, [*KEY, "b"]).where((F.col("_i") + F.col("_j") < k) & (F.col("node_id") != F.col("other")))
             .groupBy(*KEY, "node_id", "other").agg(F.min(F.col("_i") + F.col("_j") + 1).alias("hops")))
    pairs = materialize(pairs, "ring-pairs")
    # distances in the forest by common ancestors, of the pairs' vertices only
    level = materialize(pairs.select(*KEY, "node_id").distinct().select(*KEY, "node_id", F.col("node_id").alias("at"),
                                                                        F.lit(0).alias("_i")), "ring-ancestors")
    above = level
    up = tree.select(*KEY, F.col("node_id").alias("at"), "up")
    for i in range(1, k + 1):
        level = materialize(level.join(up, [*KEY, "at"]).select(*KEY, "node_id", F.col("up").alias("at"), F.lit(i).alias("_i")),
                            "ring-ancestors")
        above = above.unionByName(level)
    other = above.select(*KEY, F.col("node_id").alias("other"), "at", F.col("_i").alias("_j"))
    apart = (pairs.join(above, [*KEY, "node_id"]).join(other, [*KEY, "other", "at"]).where(F.col("_i") + F.col("_j") <= k)
             .groupBy(*KEY, "node_id", "other").agg(F.min(F.col("_i") + F.col("_j")).alias("_tree")))
    moved = materialize(pairs.join(apart, [*KEY, "node_id", "other"], "left").where("_tree is null or hops < _tree"), "ring-moved")
    columns = [*KEY, "node_id", "other"]
    return moved.select(*columns, "hops", F.lit(1).alias("sign")).unionByName(
        moved.where("_tree is not null").select(*columns, F.col("_tree").alias("hops"), F.lit(-1).alias("sign")))


def neighbor_sums(own: DataFrame, edges: DataFrame, dim: int, k: int) -> DataFrame:
    """``node_id, hops, vec, n``: vector sum and size of every ring 1..k of graphs with several
    parents: sums along a spanning forest, which list nothing, and what the other links change."""
    edges = edges.select(*KEY, "parent_id", "child_id").distinct()
    tree, extra = forest(edges)
    along = tree.select(*KEY, F.col("up").alias("parent_id"), F.col("node_id").alias("child_id"))
    sums = ring_sums(own, along, k, dim, "all").select(*KEY, "node_id", "hops", "vec", "n")
    vec = own.select(*KEY, F.col("node_id").alias("other"), "vec")
    moved = ring_corrections(edges, tree, extra, k).join(vec, [*KEY, "other"]).select(
        *KEY, "node_id", "hops", V.scale(F.col("vec"), F.col("sign").cast("double")).alias("vec"), F.col("sign").cast("long").alias("n"))
    return (sums.unionByName(moved).groupBy(*KEY, "node_id", "hops")
            .agg(V.vector_sum("vec", dim).alias("vec"), F.sum("n").alias("n")).where("n > 0"))


#: Rows (nodes and edges) of a tree whose rings are summed in one task.
RING_ROWS = 40_000


def near_sums(own: DataFrame, edges: DataFrame, weights: Sequence[float], dim: int, mode: str) -> DataFrame:
    """``node_id, vec``: the weighted sum of the means of rings 1, 2, ... of every vertex of trees that fit
    a task; the same messages as in ``ring_sums``, one tree at a time.

    Vectors have ``dim`` numbers, none null or NaN.
    """
    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    weights = [float(w) for w in weights]

    def near(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or links.empty:
            return pd.DataFrame({c: [] for c in (*KEY, "node_id", "vec")}, dtype=object)
        ids, names = pd.factorize(pd.concat([rows["node_id"], links["parent_id"], links["child_id"]], ignore_index=True))
        own_at, up, down = np.split(ids, [len(rows), len(rows) + len(links)])
        if mode == "all":
            start, end = np.concatenate([down, up]), np.concatenate([up, down])
        else:
            start, end = (down, up) if mode == "descendant" else (up, down)
        link = np.arange(len(start))
        sent = pd.DataFrame({"at": start, "link": link}).merge(pd.DataFrame({"at": own_at, "row": np.arange(len(rows))}), on="at")
        vec = np.stack(rows["vec"].to_numpy()).astype(np.float64)[sent["row"].to_numpy()]
        over, n = sent["link"].to_numpy(), np.ones(len(sent), dtype=np.int64)
        total, heard = np.zeros((len(names), dim)), np.zeros(len(names), dtype=bool)
        for hop in range(1, len(weights)):
            ring, size = np.zeros((len(names), dim)), np.zeros(len(names), dtype=np.int64)
            np.add.at(ring, end[over], vec)
            np.add.at(size, end[over], n)
            met = size > 0
            heard |= met
            total[met] += ring[met] / size[met, None] * weights[hop]
            fresh = met[start]
            if mode == "all":
                # less what came from there; a link over which nothing came back passes all on
                back = (over + len(links)) % len(start)
                fresh[back] = False
                rest = link[fresh]
                vec = np.concatenate([ring[start[back]] - vec, ring[start[rest]]])
                n = np.concatenate([size[start[back]] - n, size[start[rest]]])
                over = np.concatenate([back, rest])
                vec, n, over = vec[n > 0], n[n > 0], over[n > 0]
            else:
                over = link[fresh]
                vec, n = ring[start[over]], size[start[over]]
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in KEY}, "node_id": names[heard], "vec": list(total[heard])})

    known = " and ".join(f"{c} is not null" for c in KEY)
    rows = own.where(f"{known} and node_id is not null").select(*KEY, "node_id", "vec")
    links = edges.where(f"{known} and parent_id is not null and child_id is not null").select(*KEY, "parent_id", "child_id")
    links = links.toDF(*links.columns)  # own column identities, both may come from one table
    return rows.groupBy(*KEY).cogroup(links.groupBy(*KEY)).applyInPandas(
        near, ", ".join(f"{c} {kind[c]}" for c in (*KEY, "node_id")) + ", vec array<double>")


#: Rows (nodes and edges) of a graph whose rings are found as a matrix of its vertices, many graphs per call.
DENSE_ROWS = 2_000


def dense_graphs(own: DataFrame, edges: DataFrame, dim: int, rows: int) -> DataFrame:
    """Graphs (``KEY``) of at most ``rows`` nodes and edges with whole ids and whole vectors.  Those in which no vertex has
    several parents are among them only if no edge and no node comes twice, which ``near_sums`` counts in its own way."""
    odd = F.col("vec").isNull() | (F.size("vec") != dim) | F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = own.select(*KEY, "node_id", F.lit(None).cast(dict(edges.dtypes)["parent_id"]).alias("up"), one.alias("_n"), none.alias("_e"),
                      F.coalesce(odd, F.lit(True)).alias("_odd")).unionByName(
        edges.select(*KEY, F.col("child_id").alias("node_id"), F.col("parent_id").alias("up"), none.alias("_n"), one.alias("_e"),
                     F.col("parent_id").isNull().alias("_odd")))
    per = both.groupBy(*KEY, "node_id").agg(
        F.coalesce(F.min("up") != F.max("up"), F.lit(False)).alias("_many"), F.sum("_n").alias("_n"), F.sum("_e").alias("_e"),
        (F.max("_odd") | F.col("node_id").isNull()).alias("_odd"))
    per = per.groupBy(*KEY).agg(F.max("_many").alias("_many"), F.sum(F.col("_n") + F.col("_e")).alias("_rows"), F.sum("_e").alias("_e"),
                                (F.max(F.col("_n") > 1) | F.max(F.col("_e") > 1)).alias("_twice"), F.max("_odd").alias("_odd"))
    known = " and ".join(f"{c} is not null" for c in KEY)
    return per.where((F.col("_rows") <= rows) & (F.col("_many") | ~F.col("_twice")) & ~F.col("_odd") & (F.col("_e") > 0)).where(known).select(*KEY)


def _dense_rings(weights: list[float], dim: int, mode: str, table: pa.Table, starts: np.ndarray) -> pa.Table:
    """The weighted sum of the means of the rings of every vertex that hears something."""
    n = table.num_rows
    graph = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    vecs, ids, parents = (column(table, c) for c in ("vec", "node_id", "parent_id"))
    is_node = parents.is_null().to_numpy(zero_copy_only=False)
    coded = pa.concat_arrays([ids, parents]).dictionary_encode()
    name = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(2, n)
    nodes, links = np.flatnonzero(is_node), np.flatnonzero(~is_node)
    wide = len(coded.dictionary)
    vertices, at = np.unique(np.concatenate([graph[nodes] * wide + name[0, nodes], graph[links] * wide + name[0, links],
                                             graph[links] * wide + name[1, links]]), return_inverse=True)
    own, down, up = np.split(at, [len(nodes), len(nodes) + len(links)])
    total, count = np.zeros((len(vertices), dim)), np.zeros(len(vertices))
    if len(nodes):
        np.add.at(total, own, vecs.take(pa.array(nodes)).flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), dim))
        np.add.at(count, own, 1.0)
    out, heard = np.zeros((len(vertices), dim)), np.zeros(len(vertices), dtype=bool)
    graphs = np.arange(len(starts) + 1)
    first, link = np.searchsorted(vertices // wide, graphs), np.searchsorted(graph[links], graphs)
    for g in range(len(starts)):
        low, high = first[g], first[g + 1]
        a, b = up[link[g]:link[g + 1]] - low, down[link[g]:link[g + 1]] - low
        if not len(a):
            continue
        hears = np.concatenate([*([a] if mode != "ancestor" else []), *([b] if mode != "descendant" else [])])
        said = np.concatenate([*([b] if mode != "ancestor" else []), *([a] if mode != "descendant" else [])])
        order = np.argsort(hears, kind="stable")
        hears, said = hears[order], said[order]
        begin = np.flatnonzero(np.append(True, hears[1:] != hears[:-1]))
        ring = np.eye(high - low, dtype=bool)
        seen, sums, sizes = ring.copy(), total[low:high], count[low:high]
        for hop in range(1, len(weights)):
            new = np.zeros_like(ring)
            new[hears[begin]] = np.logical_or.reduceat(ring[said], begin, axis=0)
            ring = new & ~seen
            seen |= ring
            size = ring @ sizes
            met = size > 0
            heard[low:high] |= met
            out[low:high][met] += (ring.astype(float) @ sums)[met] / size[met, None] * weights[hop]
    there = np.flatnonzero(heard)
    keys = pa.array(starts[vertices[there] // wide])
    return pa.table({**{c: table.column(c).take(keys) for c in KEY}, "node_id": coded.dictionary.take(pa.array(vertices[there] % wide)),
                     "vec": pa.ListArray.from_arrays(pa.array(np.arange(0, dim * len(there) + 1, dim, dtype=np.int32)[:len(there) + 1]),
                                                     pa.array(out[there].ravel()))})


def dense_sums(own: DataFrame, edges: DataFrame, weights: Sequence[float], dim: int, mode: str) -> DataFrame:
    """``node_id, vec`` as ``near_sums`` gives them, of graphs in which vertices may have several parents; shortest distances
    count.  The rows of a graph are shuffled once."""
    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    node = kind["node_id"]
    rows = own.select(*KEY, "node_id", F.lit(None).cast(node).alias("parent_id"), "vec").unionByName(
        edges.select(*KEY, F.col("child_id").cast(node).alias("node_id"), F.col("parent_id").cast(node).alias("parent_id"),
                     F.lit(None).cast("array<double>").alias("vec")))
    schema = ", ".join(f"{c} {kind[c]}" for c in (*KEY, "node_id")) + ", vec array<double>"
    return in_batches(rows, KEY, partial(_dense_rings, [float(w) for w in weights], dim, mode), schema)


def ring_trees(own: DataFrame, edges: DataFrame, dim: int, rows: int) -> DataFrame:
    """``KEY, fits``: whether a graph has at most ``rows`` nodes and edges and only whole vectors."""
    odd = F.col("vec").isNull() | (F.size("vec") != dim) | F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    both = own.select(*KEY, F.coalesce(odd, F.lit(True)).alias("_odd")).unionByName(edges.select(*KEY, F.lit(False).alias("_odd")))
    return both.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.max("_odd").alias("_odd")).select(
        *KEY, ((F.col("_n") <= rows) & ~F.col("_odd")).alias("fits"))


def neighborhood_vector(nodes: DataFrame, edges: DataFrame, dim: int,
                        settings: AlignSettings = AlignSettings()) -> DataFrame:
    """Weighted sum over rings of the mean vector of each ring.

    Trees (every document without a vertex with two parents) use message sums that
    cost one row per edge and ring: inside a task where a tree has at most ``RING_ROWS`` rows and whole
    vectors, else by joins.  Other documents use them along a spanning forest and
    list pairs across their surplus links only; with a direction, they list their rings.  Graphs of at most
    ``DENSE_ROWS`` rows and whole vectors are done many per call (``dense_graphs``).
    """
    weights = settings.neighbor_weights
    k = len(weights) - 1
    own = nodes.select(*KEY, "node_id", "vec")
    zero_ring = own.select(*KEY, "node_id", F.lit(0).alias("hops"), F.col("vec").alias("_mean"))
    parts, near = [zero_ring] if weights[0] else [], None
    if k:
        rest_nodes, dense_part = own, None
        dense = materialize(dense_graphs(own, edges, dim, DENSE_ROWS), "dense-graphs")
        if not dense.isEmpty():
            dense_part = dense_sums(*(join_salted(t, dense, KEY, [c], "left_semi") for t, c in ((own, "node_id"), (edges, "child_id"))),
                                    weights, dim, settings.neighbor_direction)
            rest_nodes, edges = (join_salted(t, dense, KEY, [c], "left_anti") for t, c in ((own, "node_id"), (edges, "child_id")))
            edges = materialize(edges, "other-edges")
        multi = materialize(reentrant_graphs(edges), "reentrant-docs")
        all_trees = multi.isEmpty()
        tree_edges = edges if all_trees else join_salted(edges, multi, KEY, ["child_id"], "left_anti")
        tree_nodes = rest_nodes if all_trees else join_salted(rest_nodes, multi, KEY, ["node_id"], "left_anti")
        trees = materialize(ring_trees(tree_nodes, tree_edges, dim, RING_ROWS), "ring-trees", ("fits",))
        all_fit = trees.where("not fits").isEmpty()
        if all_fit:
            near = near_sums(tree_nodes, tree_edges, weights, dim, settings.neighbor_direction)
        else:
            fits, large = (trees.where(hit).select(*KEY) for hit in ("fits", "not fits"))
            near = near_sums(join_salted(tree_nodes, fits, KEY, ["node_id"], "left_semi"),
                             join_salted(tree_edges, fits, KEY, ["child_id"], "left_semi"), weights, dim, settings.neighbor_direction)
            tree_edges = join_salted(tree_edges, large, KEY, ["child_id"], "left_semi")
        if dense_part is not None:
            near = near.unionByName(dense_part)
        sums = []
        if not all_fit:
            sums.append(ring_sums(own, tree_edges, k, dim, settings.neighbor_direction).select(*KEY, "node_id", "hops", "vec", "n"))
        if not all_trees:
            other = materialize(join_salted(edges, multi, KEY, ["child_id"], "left_semi"), "reentrant-edges")
            if settings.neighbor_direction == "all":
                sums.append(neighbor_sums(own, other, dim, k))
            else:
                rings = k_hop(other, k, settings.neighbor_direction).where("hops > 0")
                sums.append(
                    rings.join(own, [*KEY, "node_id"]).groupBy(*KEY, F.col("center").alias("node_id"), "hops")
                    .agg(V.vector_sum("vec", dim).alias("vec"), F.count(F.lit(1)).alias("n")).select(*KEY, "node_id", "hops", "vec", "n"))
        parts.extend(s.select(*KEY, "node_id", "hops", F.transform("vec", lambda x: x / F.col("n")).alias("_mean")) for s in sums)
    table = F.create_map(*[x for i, w in enumerate(weights) for x in (F.lit(i), F.lit(float(w)))])
    weighted = [p.select(*KEY, "node_id", F.transform("_mean", lambda x: x * table[F.col("hops")]).alias("vec")) for p in parts]
    if not weighted and near is not None:
        # one row per vertex: nothing to add up
        summed = near.withColumnRenamed("vec", "nvec")
    else:
        weighted = reduce(DataFrame.unionByName, weighted if near is None else [near, *weighted])
        summed = weighted.groupBy(*KEY, "node_id").agg(V.vector_sum("vec", dim).alias("nvec"))
    return nodes.join(summed, [*KEY, "node_id"], "left").withColumn(
        "nvec", F.coalesce("nvec", V.zeros(dim)))


# --- alignments ------------------------------------------------------------

def alignment_capacities(pairs: DataFrame, settings: AlignSettings = AlignSettings()) -> DataFrame:
    """Alignment edges: pairs above the threshold with their capacity."""
    return (pairs.where(F.col("sim") > F.lit(settings.similarity_threshold))
            .withColumn("capacity", F.col("sim") * F.lit(settings.alignment_capacity)))


def top_alignments(pairs: DataFrame, k: int = 1, by: str = "src_node") -> DataFrame:
    """The k best partners of each node, ties by the partner's id.

    Spark keeps k rows per node before the shuffle, so a node with very many
    partners costs its task no more than others.
    """
    other = "smy_node" if by == "src_node" else "src_node"
    w = Window.partitionBy("doc_id", by).orderBy(F.desc("sim"), F.asc(other))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
