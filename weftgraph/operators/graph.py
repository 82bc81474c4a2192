"""Relational graph operators over node and edge tables.

Edges are stored parent to child.  ``KEY`` columns say which graph a row belongs
to; a vertex is ``(doc_id, component, node_id)``.  All joins use the vertex as
the key, never the document alone, so a very large document is spread out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.vectors import vector_sum
from weftgraph.lineage import discard, materialize
from weftgraph.operators.batches import column, in_batches
from weftgraph.skew import free_names, join_salted, with_totals

KEY = ["doc_id", "component"]


def dense_ids(df: DataFrame, group: Sequence[str], order: Sequence[str],
              name: str = "dense_id") -> DataFrame:
    """Dense deterministic ids 0, 1, 2, ... per group in the given total order.

    A range sort splits a large group over many partitions; each partition's
    start is the number of rows of the group before it.  No task needs to see a
    whole group.
    """
    keys = [*group, *order]
    part, row, count, first, start = free_names((df,), "_part", "_row", "_n", "_first", "_start")
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn(part, F.spark_partition_id())
              .withColumn(row, F.monotonically_increasing_id()))
    ranged = materialize(ranged, "dense-ids")
    parts = ranged.groupBy(*group, part).agg(
        F.count(F.lit(1)).alias(count), F.min(row).alias(first))
    before = (Window.partitionBy(*group).orderBy(part)
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.withColumn(start, F.coalesce(F.sum(count).over(before), F.lit(0))).drop(count)
    return (ranged.join(starts, [*group, part])
            .withColumn(name, F.col(start) + F.col(row) - F.col(first))
            .drop(part, row, first, start))


def assign_ids(nodes: DataFrame, order: Sequence[str] = ("component", "node_id")) -> DataFrame:
    """Node ids that restart at 0 in every document."""
    return dense_ids(nodes, ["doc_id"], order, "attrib_id")


def reverse(edges: DataFrame) -> DataFrame:
    """Edges child to parent, payload kept."""
    rest = [c for c in edges.columns if c not in ("parent_id", "child_id")]
    return edges.select(
        *rest, F.col("child_id").alias("from_id"), F.col("parent_id").alias("to_id"))


def disjoint_union(*tables: DataFrame) -> DataFrame:
    """Several components in one table; composite keys keep them apart."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the node set."""
    keep = nodes.select(*KEY, "node_id")
    return (edges
            .join(keep.withColumnRenamed("node_id", "parent_id"), [*KEY, "parent_id"], "left_semi")
            .join(keep.withColumnRenamed("node_id", "child_id"), [*KEY, "child_id"], "left_semi")
            .select(*edges.columns))


def roots(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Flagged roots, or vertices without a parent when edges are given."""
    if edges is None:
        return nodes.where("is_root")
    has_parent = edges.select(*KEY, F.col("child_id").alias("node_id"))
    return nodes.join(has_parent, [*KEY, "node_id"], "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without a child."""
    has_child = edges.select(*KEY, F.col("parent_id").alias("node_id"))
    return nodes.join(has_child, [*KEY, "node_id"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of each vertex that has an edge."""
    ends = edges.select(*KEY, F.explode(F.array(
        F.struct(F.col("parent_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("child_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select(*KEY, "e.*")
    return ends.groupBy(*KEY, "node_id").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbours of every vertex in order: ``node_id, position, neighbor_id``.

    A row per neighbour whatever their number, so no task holds a hub's list.
    """
    links = edges.select(*KEY, F.col("parent_id").alias("node_id"), F.col("child_id").alias("neighbor_id"))
    return dense_ids(links, [*KEY, "node_id"], ["neighbor_id"], "position")


def incident(edges: DataFrame, vertices: DataFrame, mode: str = "in",
             edge_types: Sequence[str] | None = None) -> DataFrame:
    """Edges into (``in``), out of (``out``) or at (``all``) the given vertices.

    Directions are those of the reversed graph: an edge runs child to parent.
    """
    if mode not in ("in", "out", "all"):
        raise ValueError("mode must be in, out or all")
    typed = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    v = vertices.select(*KEY, "node_id").distinct()
    parts = []
    if mode in ("in", "all"):
        parts.append(typed.withColumn("node_id", F.col("parent_id")).join(v, [*KEY, "node_id"], "left_semi"))
    if mode in ("out", "all"):
        parts.append(typed.withColumn("node_id", F.col("child_id")).join(v, [*KEY, "node_id"], "left_semi"))
    return disjoint_union(*parts)


def delete_edges(edges: DataFrame, nodes: DataFrame, drop: DataFrame,
                 include_nodes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Remove edges by ``edge_id``; optionally the end vertices left without any.

    Only ends of removed edges are candidates: a vertex that never had an edge
    stays.
    """
    keys = drop.select(*KEY, "edge_id").distinct()
    kept = edges.join(keys, [*KEY, "edge_id"], "left_anti")
    if not include_nodes:
        return kept, nodes
    gone = edges.join(keys, [*KEY, "edge_id"], "left_semi")
    orphans = _ends(gone).join(_ends(kept), [*KEY, "node_id"], "left_anti")
    return kept, nodes.join(orphans, [*KEY, "node_id"], "left_anti")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(
        *KEY, F.explode(F.array("parent_id", "child_id")).alias("node_id")).distinct()


def select_nodes(nodes: DataFrame, predicate: Column) -> DataFrame:
    return nodes.where(predicate)


def select_edges(edges: DataFrame, predicate: Column) -> DataFrame:
    return edges.where(predicate)


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose vertex key is in a table of ids."""
    return nodes.join(ids.select(*KEY, "node_id"), [*KEY, "node_id"], "left_semi")


def containing_component(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Component that owns each ``(doc_id, node_id)`` of a table."""
    return ids.join(nodes.select("doc_id", "node_id", "component"), ["doc_id", "node_id"], "left")


def component(table: DataFrame, name: str) -> DataFrame:
    """Rows of one component; a name that occurs nowhere is an error."""
    out = table.where(F.col("component") == name)
    if out.isEmpty():
        raise ValueError(f"missing component: {name!r}")
    return out


def add_edges(edges: DataFrame, new: DataFrame, capacity: float) -> DataFrame:
    """Append edges; those without a capacity get the given one."""
    if "capacity" in new.columns:
        filled = new.withColumn("capacity", F.coalesce("capacity", F.lit(float(capacity))))
    else:
        filled = new.withColumn("capacity", F.lit(float(capacity)))
    return edges.unionByName(filled, allowMissingColumns=True)


def set_capacities(edges: DataFrame, capacity: float, where: Column | None = None) -> DataFrame:
    value = F.lit(float(capacity))
    if where is not None:
        value = F.when(where, value).otherwise(F.col("capacity"))
    return edges.withColumn("capacity", value)


def update_capacities(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Capacities by edge key, others unchanged."""
    new = updates.select(*KEY, "edge_id", F.col("capacity").alias("_new"))
    return (edges.join(new, [*KEY, "edge_id"], "left")
            .withColumn("capacity", F.coalesce("_new", "capacity")).drop("_new")
            .select(*edges.columns))


def descendants(edges: DataFrame, include_self: bool = False,
                name: str = "descendants") -> DataFrame:
    """Reachability closure ``(ancestor, node_id, hops)``, cycles included.

    Semi-naive: each round extends only the pairs found in the round before and
    drops those already known, so it ends on cyclic graphs.  ``hops`` is the
    shortest distance.  Every round is a written table.  Where every vertex has one parent, a pair
    can only be found again after a circle has closed, so until then nothing is compared.
    """
    links = materialize(edges.select(*KEY, "parent_id", "child_id").distinct(), name)
    single = links.groupBy(*KEY, "child_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    step = links.select(*KEY, F.col("parent_id").alias("ancestor"),
                        F.col("child_id").alias("node_id"), F.lit(1).alias("hops"))
    found, hops = step, 1
    hop_edges = links.select(*KEY, F.col("parent_id").alias("node_id"), "child_id")
    while not step.isEmpty():
        hops += 1
        single = single and step.where("ancestor = node_id").isEmpty()
        nxt = step.join(hop_edges, [*KEY, "node_id"]).select(*KEY, "ancestor", F.col("child_id").alias("node_id"))
        if not single:
            nxt = nxt.distinct().join(found, [*KEY, "ancestor", "node_id"], "left_anti")
        step = materialize(nxt.withColumn("hops", F.lit(hops)), name)
        found = found.unionByName(step)
    if include_self:
        ends = _ends(edges)
        own = ends.select(*KEY, F.col("node_id").alias("ancestor"), "node_id", F.lit(0).alias("hops"))
        found = found.where("ancestor <> node_id").unionByName(own)
    return found


def k_hop(edges: DataFrame, k: int, mode: str = "descendant", centers: DataFrame | None = None) -> DataFrame:
    """Rings: vertices at exactly 0..k hops of every vertex, or of the ``centers``.

    ``descendant`` and ``ancestor`` rings grow with depth.  ``all`` lists rings of
    an undirected neighbourhood, which grow with the square of a hub; sums over rings come
    from ``similarity.neighbor_sums``, which lists them around surplus links only.
    """
    down = edges.select(*KEY, F.col("parent_id").alias("node_id"), F.col("child_id").alias("next_id"))
    up = edges.select(*KEY, F.col("child_id").alias("node_id"), F.col("parent_id").alias("next_id"))
    links = {"descendant": down, "ancestor": up, "all": down.unionByName(up)}[mode].distinct()
    links = materialize(links, "k-hop")
    ring = (_ends(edges) if centers is None else centers.distinct()).select(
        *KEY, F.col("node_id").alias("center"), "node_id", F.lit(0).alias("hops"))
    found = ring
    for hop in range(1, k + 1):
        ring = (ring.join(links, [*KEY, "node_id"])
                .select(*KEY, "center", F.col("next_id").alias("node_id")).distinct()
                .join(found, [*KEY, "center", "node_id"], "left_anti")
                .withColumn("hops", F.lit(hop)))
        ring = materialize(ring, "k-hop")
        found = found.unionByName(ring)
    return found


def ring_sums(nodes: DataFrame, edges: DataFrame, k: int, dim: int,
              mode: str = "all") -> DataFrame:
    """Vector sum and size of every ring 1..k of every vertex of a *tree*.

    What a vertex hears over an edge at distance d is what the neighbour heard at
    d-1 over its other edges: the neighbour's ring d-1 less what came from
    the vertex itself.  Each round therefore handles one row per edge and
    direction, whatever the ring sizes are.  ``nodes`` has a ``vec`` column.
    """
    down = edges.select(*KEY, F.col("child_id").alias("from_id"), F.col("parent_id").alias("to_id"))
    up = edges.select(*KEY, F.col("parent_id").alias("from_id"), F.col("child_id").alias("to_id"))
    links = {"descendant": down, "ancestor": up, "all": down.unionByName(up)}[mode]
    links = materialize(links, "ring-links")
    sender = nodes.select(*KEY, F.col("node_id").alias("from_id"), "vec")
    message = materialize(
        links.join(sender, [*KEY, "from_id"]).withColumn("n", F.lit(1).cast("long")), "ring-message")
    rings = None
    for hop in range(1, k + 1):
        ring = (message.groupBy(*KEY, F.col("to_id").alias("node_id"))
                .agg(vector_sum("vec", dim).alias("vec"), F.sum("n").alias("n"))
                .withColumn("hops", F.lit(hop)))
        ring = materialize(ring, "ring")
        rings = ring if rings is None else rings.unionByName(ring)
        if hop == k:
            discard(message, links)
            break
        heard = ring.select(*KEY, F.col("node_id").alias("from_id"),
                            F.col("vec").alias("_rv"), F.col("n").alias("_rn"))
        own = message.select(*KEY, F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"),
                             F.col("vec").alias("_mv"), F.col("n").alias("_mn"))
        nxt = links.join(heard, [*KEY, "from_id"])
        if mode == "all":
            nxt = nxt.join(own, [*KEY, "from_id", "to_id"], "left")
            vec = F.when(F.col("_mv").isNull(), F.col("_rv")).otherwise(
                F.zip_with("_rv", "_mv", lambda a, b: a - b))
            n = F.col("_rn") - F.coalesce("_mn", F.lit(0))
        else:
            vec, n = F.col("_rv"), F.col("_rn")
        before, message = message, materialize(
            nxt.select(*KEY, "from_id", "to_id", vec.alias("vec"), n.alias("n"))
            .where("n > 0"), "ring-message")
        discard(before)
    return rings


def hang(links: DataFrame) -> DataFrame:
    """The rows of ``links`` (``node_id, up`` and any payload) and one per vertex without one.

    ``n``: rows of the vertex, 0 for one that is only a parent; ``inner``: it is a parent.  A row with a
    null key leads nowhere (``up`` null).
    """
    node = [*KEY, "node_id"]
    ups = links.select(*KEY, F.col("up").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    both = links.withColumn("_row", F.lit(1)).join(ups, node, "full")
    known = reduce(and_, [F.col(c).isNotNull() for c in node])
    return (both.withColumn("n", F.count("_row").over(Window.partitionBy(*node))).drop("_row")
            .withColumn("inner", F.coalesce("inner", F.lit(False))).withColumn("up", F.when(known, F.col("up"))))


def rake(hung: DataFrame, written: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """Vertices taken off from below: those that are nobody's parent, then those that are nobody's parent any
    more, and so on while a round halves what is left.

    ``hung`` has at most one row per vertex (``hang``; ``written``: it is a written table).  Returns the
    layers, lowest first, and what is left.  All rounds together write about as much as two of the first.
    """
    if not written:
        hung = materialize(hung, "rake", ("inner",))
    layers, left = [], hung.count()
    columns = [c for c in hung.columns if c not in ("inner",)]
    while left:
        core = hung.where("inner").select(*columns)
        n = core.count()
        if 2 * n > left:
            break
        layers.append(hung.where("not inner").select(*columns))
        if not n:
            return layers, core
        ups = core.where("up is not null").select(*KEY, F.col("up").alias("node_id")).distinct().withColumn("inner", F.lit(True))
        hung = materialize(core.join(ups, [*KEY, "node_id"], "left").withColumn(
            "inner", F.coalesce("inner", F.lit(False))), "rake", ("inner",))
        left = n
    return layers, hung.select(*columns)


#: Edges of a graph whose components are labelled in one task.
COMPONENT_EDGES = 200_000


def _labelled(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Components of many graphs at once: every round takes the smallest label of the neighbours and then that
    label's own."""
    graph = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    coded = pa.concat_arrays([column(table, "parent_id"), column(table, "child_id")]).dictionary_encode()
    names = coded.dictionary
    order = pc.array_sort_indices(names).to_numpy()
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    # vertices are numbered by graph and id, so the smallest number is the smallest id
    vertices, ends = np.unique(np.concatenate([graph, graph]) * len(names) + place[coded.indices.to_numpy()], return_inverse=True)
    u, v = np.split(ends, 2)
    label = np.arange(len(vertices))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    first = pa.array(starts[vertices // len(names)])
    of = lambda x: names.take(pa.array(order[vertices[x] % len(names)]))
    return pa.table({**{k: table.column(k).take(first) for k in KEY}, "node_id": of(np.arange(len(vertices))), "component_root": of(label)})


def weak_components(edges: DataFrame, graph_edges: int = COMPONENT_EDGES) -> DataFrame:
    """Smallest vertex id of each vertex's weakly connected component.

    Graphs of up to ``graph_edges`` edges are shuffled once and labelled where their edges meet, larger
    ones by joins.
    """
    links = edges.where(reduce(and_, [F.col(c).isNotNull() for c in (*KEY, "parent_id", "child_id")])).select(*KEY, "parent_id", "child_id")
    if getattr(edges, "_weft_path", None) is None:
        links = materialize(links, "component-links")
    sizes = links.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.where(F.col("_n") > graph_edges).select(*KEY), "large-graphs")
    if large.isEmpty():
        small = links
    else:
        small, spread = (join_salted(links, large, KEY, ["child_id"], how) for how in ("left_anti", "left_semi"))
    kinds = {**dict(links.dtypes), "node_id": dict(links.dtypes)["child_id"]}
    kinds["component_root"] = kinds["node_id"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*KEY, "node_id", "component_root"))
    found = materialize(in_batches(small, KEY, _labelled, schema), "components")
    return found if large.isEmpty() else found.unionByName(spread_components(spread))


def spread_components(edges: DataFrame) -> DataFrame:
    """The same by joins, for graphs of any size.

    Leaves (``rake``) hand their smallest id to their parent and take its component in the end; only what is
    left, with the parents as vertices, goes through rounds over all its edges.
    """
    node = [*KEY, "node_id"]
    links = edges.where(reduce(and_, [F.col(c).isNotNull() for c in (*KEY, "parent_id", "child_id")])).select(
        *KEY, F.col("child_id").alias("node_id"), F.col("parent_id").alias("up"))
    hung = materialize(hang(links), "hung", ("inner",))
    if not hung.where("n > 1").isEmpty():
        return _spread_labels(edges)
    layers, core = rake(hung)
    low = None  # smallest id below
    for layer in layers:
        here = layer.select(*node, "up", F.col("node_id").alias("low"))
        if low is not None:
            here = here.join(low.withColumnRenamed("low", "_low"), node, "left").withColumn("low", F.least("low", "_low")).drop("_low")
        given = here.where("up is not null").groupBy(*KEY, F.col("up").alias("node_id")).agg(F.min("low").alias("low"))
        if low is not None:
            given = low.unionByName(given).groupBy(*node).agg(F.min("low").alias("low"))
        low = materialize(given, "components")
    own = None
    if not core.isEmpty():
        inside = core.where("up is not null").select(*KEY, F.col("node_id").alias("child_id"), F.col("up").alias("parent_id"))
        labels = _spread_labels(inside)
        alone = core.select(*node).join(labels, node, "left_anti").withColumn("component_root", F.col("node_id"))
        labels = labels.unionByName(alone)
        if low is not None:
            labels = labels.join(low, node, "left")
            least = labels.groupBy(*KEY, "component_root").agg(F.min("low").alias("_least"))
            labels = labels.drop("low").join(least, [*KEY, "component_root"]).select(
                *node, F.least("component_root", "_least").alias("component_root"))
        own = materialize(labels, "components")
    found = own
    for layer in reversed(layers):
        top = layer.where("up is null").select(*node, F.col("node_id").alias("component_root"))
        if low is not None:
            top = top.join(low, node, "left").select(*node, F.least("component_root", "low").alias("component_root"))
        if found is None:
            found = materialize(top, "components")
            continue
        above = found.select(*KEY, F.col("node_id").alias("up"), "component_root")
        taken = layer.where("up is not null").select(*node, "up").join(above, [*KEY, "up"]).select(*node, "component_root")
        found = found.unionByName(materialize(taken.unionByName(top), "components"))
    return edges.select(*KEY, F.col("child_id").alias("node_id"), F.col("child_id").alias("component_root")).limit(0) \
        if found is None else found


def _spread_labels(edges: DataFrame) -> DataFrame:
    """``weak_components`` of graphs without leaves.

    Every round a vertex takes the smallest label among itself and its neighbours and then
    that label's own label, so paths shorten by more than half.  The rounds end when no
    label has changed, which is counted, not inferred.
    """
    ends = edges.select(*KEY, F.explode(F.array(
        F.struct(F.col("parent_id").alias("u"), F.col("child_id").alias("v")),
        F.struct(F.col("child_id").alias("u"), F.col("parent_id").alias("v")))).alias("e"))
    links = materialize(ends.select(*KEY, "e.u", "e.v").distinct(), "components")
    # the first labels are group minima, so hubs are summed up before the shuffle
    labels = materialize(links.groupBy(*KEY, "u").agg(F.min("v").alias("m")).select(
        *KEY, "u", F.least("u", "m").alias("low")), "components")
    while True:
        offered = (join_salted(links, labels, [*KEY, "u"], ["v"])
                   .groupBy(*KEY, F.col("v").alias("u")).agg(F.min("low").alias("offer")))
        new = labels.join(offered, [*KEY, "u"]).select(
            *KEY, "u", F.col("low").alias("old"), F.least("low", "offer").alias("low"))
        jump = labels.select(*KEY, F.col("u").alias("low"), F.col("low").alias("lower"))
        moved = join_salted(new, jump, [*KEY, "low"], ["u"], "left")
        new = materialize(moved.select(*KEY, "u", "old", F.least("low", "lower").alias("low")), "components")
        changed = not new.where("low < old").isEmpty()
        discard(labels)
        labels = new.drop("old")
        labels._weft_path = new._weft_path
        if not changed:
            break
    discard(links)
    return labels.select(*KEY, F.col("u").alias("node_id"), F.col("low").alias("component_root"))


def component_of(nodes: DataFrame, edges: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices weakly reachable from the given roots, and the edges among them."""
    labels = weak_components(edges)
    alone = nodes.select(*KEY, "node_id").join(labels, [*KEY, "node_id"], "left_anti")
    labels = labels.unionByName(alone.withColumn("component_root", F.col("node_id")))
    wanted = (labels.join(root.select(*KEY, "node_id"), [*KEY, "node_id"], "left_semi")
              .select(*KEY, "component_root").distinct())
    members = join_salted(labels, wanted, [*KEY, "component_root"], ["node_id"], "left_semi")
    kept = nodes.join(members, [*KEY, "node_id"], "left_semi")
    return kept, induced_subgraph(edges, kept)


def chain_from_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chain of doc nodes from the root while each has exactly one doc child."""
    docs = nodes.where("attrib_type = 'doc'")
    doc_edges = edges.where("edge_type = 'doc'").select(*KEY, "parent_id", "child_id")
    single = (doc_edges.groupBy(*KEY, "parent_id")
              .agg(F.count(F.lit(1)).alias("n"), F.first("child_id").alias("child_id"))
              .where("n = 1").drop("n"))
    step = docs.where("is_root").select(*KEY, "node_id", F.lit(0).alias("position"))
    step = materialize(step, "doc-chain")
    chain, position = step, 0
    while not step.isEmpty():
        position += 1
        nxt = (step.join(single, (step.doc_id == single.doc_id) & (step.component == single.component)
                         & (step.node_id == single.parent_id))
               .select(step.doc_id, step.component, single.child_id.alias("node_id"),
                       F.lit(position).alias("position"))
               .join(chain, [*KEY, "node_id"], "left_anti"))
        step = materialize(nxt, "doc-chain")
        chain = chain.unionByName(step)
    return chain


def doc_alignments(chain: DataFrame, capacity: float) -> DataFrame:
    """Doc-level alignment edges: the two chains joined by position."""
    side = {c: chain.where(F.col("component") == c) for c in ("source", "summary")}
    src = side["source"].select("doc_id", "position", F.col("node_id").alias("src_node"))
    smy = side["summary"].select("doc_id", "position", F.col("node_id").alias("smy_node"))
    return src.join(smy, ["doc_id", "position"]).withColumn("capacity", F.lit(float(capacity)))


def collapse_sections(nodes: DataFrame, edges: DataFrame,
                      names: Sequence[str] = ("section", "header")) -> tuple[DataFrame, DataFrame]:
    """Remove named doc levels; their children hang off the nearest kept doc node.

    Header sentences move up to the document root together with body sentences.
    """
    dropped = materialize(nodes.where((F.col("attrib_type") == "doc") & F.element_at(
        F.split("path", r"\."), -1).rlike("^(" + "|".join(names) + ")(_[0-9]+)?$") & ~F.col("is_root")
    ).select(*KEY, "node_id"), "collapsed-nodes")
    # ids of doc nodes are close together, so most rows are told by their id alone and join nothing
    low, high = dropped.agg(F.min("node_id"), F.max("node_id")).first()
    if low is None:
        return nodes, edges

    def near(column: str) -> Column:
        return F.coalesce(F.col(column).between(low, high), F.lit(False))

    up = edges.where(near("child_id")).select(*KEY, F.col("child_id").alias("node_id"), F.col("parent_id").alias("up_id"))
    gone = materialize(dropped.join(up, [*KEY, "node_id"]), "collapse")
    # follow the removed levels upwards until a kept node is met
    target = gone
    while True:
        again = gone.select(*KEY, F.col("node_id").alias("up_id"), F.col("up_id").alias("_next"))
        moved = target.join(again, [*KEY, "up_id"], "left")
        if moved.where("_next is not null").isEmpty():
            break
        target = materialize(moved.select(
            *KEY, "node_id", F.coalesce("_next", "up_id").alias("up_id")), "collapse")
    new_parent = target.select(*KEY, F.col("node_id").alias("parent_id"), "up_id")
    touched = near("child_id") | near("parent_id")
    kept_edges = (edges.where(touched)
                  .join(dropped.withColumnRenamed("node_id", "child_id"), [*KEY, "child_id"], "left_anti")
                  .join(new_parent, [*KEY, "parent_id"], "left")
                  .withColumn("parent_id", F.coalesce("up_id", "parent_id"))
                  .select(*edges.columns)).unionByName(edges.where(~touched))
    kept_nodes = nodes.where(near("node_id")).join(dropped, [*KEY, "node_id"], "left_anti").select(*nodes.columns)
    return kept_nodes.unionByName(nodes.where(~near("node_id"))), kept_edges


def node_by_path(nodes: DataFrame, path: str) -> DataFrame:
    """Doc node at a dotted path such as ``source.section.body-sub``."""
    return nodes.where((F.col("attrib_type") == "doc") & (F.col("path") == path))


def children_of_path(nodes: DataFrame, path: str) -> DataFrame:
    """Doc children of a path with their position."""
    depth = path.count(".") + 2
    below = nodes.where((F.col("attrib_type") == "doc") & F.col("path").startswith(path + ".")
                        & (F.size(F.split("path", r"\.")) == depth))
    return dense_ids(below, KEY, ["node_id"], "child_ix")


def sentences_under_path(nodes: DataFrame, path: str) -> DataFrame:
    """Number of sentences at or below a doc path."""
    under = (F.col("path") == path) | F.col("path").startswith(path + ".")
    return (nodes.where((F.col("attrib_type") == "sentence") & under)
            .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_sentences")))


def sentence_index(nodes: DataFrame) -> DataFrame:
    """Per sentence its node, concepts and attributes.

    The lists are as long as one sentence, which one input row already held.
    """
    def of(kind: str, payload: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("attrib_type") == kind, payload)))

    item = F.struct("node_id", "variable")
    return nodes.where("sent_ix is not null").groupBy(*KEY, "sent_ix").agg(
        F.max(F.when(F.col("attrib_type") == "sentence", F.col("node_id"))).alias("sentence_node"),
        of("concept", item).alias("concepts"),
        of("attribute", F.struct("node_id", "constant")).alias("attributes"))
