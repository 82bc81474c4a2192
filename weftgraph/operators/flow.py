"""Flow networks, the closed form of their maximum flow, and flow editing.

Within a component every edge has (practically) unlimited capacity, the leaves of
one component are fed and only the root of the other drains.  The alignment
edges are then the minimum cut and all are saturated, so a maximum flow is a
subtree sum.  A vertex with several parents shares its flow evenly, which is the
state that the reentrancy repair reaches where no such vertex is below another
one; documents that have such a pair need the exact flow (``operators.maxflow``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import discard, materialize
from weftgraph.operators.batches import in_batches
from weftgraph.operators.graph import KEY, descendants, leaves, roots
from weftgraph.operators.trees import Climb, at_or_below, climb, raked_sums, subtree_sizes
from weftgraph.settings import MAX_CAPACITY
from weftgraph.skew import join_salted, with_totals

TO_NODE = {"source": "src_node", "summary": "smy_node"}
SOURCE_TERMINAL = "S"
SINK_TERMINAL = "T"


def orient(align_edges: DataFrame, component: str) -> DataFrame:
    """Alignment edges pointing at the given component."""
    to_col = TO_NODE[component]
    from_col = TO_NODE["summary" if component == "source" else "source"]
    return (align_edges.withColumn("from_id", F.col(from_col)).withColumn("to_id", F.col(to_col))
            .withColumn("component", F.lit(component)))


def share_alignments(align_edges: DataFrame) -> DataFrame:
    """Both networks' view of the one alignment table, so edits are common."""
    return orient(align_edges, "source").unionByName(orient(align_edges, "summary"))


def add_terminals(nodes: DataFrame, edges: DataFrame, component: str | None = "source",
                  capacity: float = MAX_CAPACITY) -> DataFrame:
    """Terminal edges ``(doc_id, from_key, to_key, capacity)``.

    For a target component: S to every leaf of the other component and the target's
    root to T.  ``component=None`` gives the forward form: S to the source
    root, every summary leaf to T.
    """
    if component is None:
        start = roots(nodes).where("component = 'source'")
        end = leaves(nodes, edges).where("component = 'summary'")
    else:
        start = leaves(nodes, edges).where(F.col("component") != component)
        end = roots(nodes).where(F.col("component") == component)
    cap = F.lit(float(capacity)).alias("capacity")
    feed = start.select("doc_id", F.lit(SOURCE_TERMINAL).alias("from_key"), vertex_key().alias("to_key"), cap)
    drain = end.select("doc_id", vertex_key().alias("from_key"), F.lit(SINK_TERMINAL).alias("to_key"), cap)
    return feed.unionByName(drain).withColumn("edge_type", F.lit("terminal"))


def vertex_key(component: Column | str = "component", node_id: Column | str = "node_id") -> Column:
    c = F.col(component) if isinstance(component, str) else component
    n = F.col(node_id) if isinstance(node_id, str) else node_id
    return F.concat_ws(":", c, n.cast("string"))


def build_network(nodes: DataFrame, edges: DataFrame, align_edges: DataFrame,
                  component: str = "source", extra: DataFrame | None = None,
                  terminals=add_terminals) -> DataFrame:
    """Flow network towards a component: reversed edges, alignments, terminals.

    ``extra`` holds repaired capacities ``(doc_id, component, edge_id, capacity)``;
    ``terminals`` may be replaced by another terminal builder.
    """
    inside = edges.withColumn("_cap", F.lit(MAX_CAPACITY))
    if extra is not None:
        new = extra.select(*KEY, "edge_id", F.col("capacity").alias("_fixed"))
        inside = inside.join(new, [*KEY, "edge_id"], "left").withColumn(
            "_cap", F.coalesce("_fixed", "_cap"))
    inside = inside.select(
        "doc_id", vertex_key("component", "child_id").alias("from_key"),
        vertex_key("component", "parent_id").alias("to_key"),
        F.col("_cap").alias("capacity"), "edge_type", "component",
        F.col("edge_id").cast("string").alias("edge_id"))
    other = "summary" if component == "source" else "source"
    across = orient(align_edges, component).select(
        "doc_id", vertex_key(F.lit(other), "from_id").alias("from_key"),
        vertex_key(F.lit(component), "to_id").alias("to_key"), "capacity",
        F.lit("align").alias("edge_type"),
        F.concat_ws("-", "src_node", "smy_node", F.coalesce(F.col("rel_id").cast("string"), F.lit("")))
        .alias("edge_id"))
    return (inside.unionByName(across, allowMissingColumns=True)
            .unionByName(terminals(nodes, edges, component), allowMissingColumns=True))


def acyclic(edges: DataFrame) -> DataFrame:
    """Edges without those that close a cycle.

    Only graphs that have a vertex with several parents can have a cycle below the
    root, so only those are searched.  Inside a strongly connected part an
    edge is kept when it leads to a vertex that is later by depth and then id, so
    of two opposite edges one stays.
    """
    multi = (edges.groupBy(*KEY, "child_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(*KEY).distinct())
    suspect = materialize(join_salted(edges, multi, KEY, ["child_id"], "left_semi"), "acyclic")
    if suspect.isEmpty():
        return edges
    closure = descendants(suspect, name="acyclic")
    back = (suspect.select(*KEY, "edge_id", "parent_id", "child_id")
            .join(closure.select(*KEY, F.col("ancestor").alias("child_id"), F.col("node_id").alias("parent_id")),
                  [*KEY, "child_id", "parent_id"], "left_semi"))
    if back.isEmpty():
        return edges
    start = suspect.select(*KEY, F.col("parent_id").alias("ancestor")).distinct().join(
        closure.select(*KEY, F.col("node_id").alias("ancestor")), [*KEY, "ancestor"], "left_anti")
    depth = (closure.join(start, [*KEY, "ancestor"], "left_semi")
             .groupBy(*KEY, "node_id").agg(F.min("hops").alias("depth")))
    parent = depth.select(*KEY, F.col("node_id").alias("parent_id"), F.col("depth").alias("dp"))
    child = depth.select(*KEY, F.col("node_id").alias("child_id"), F.col("depth").alias("dc"))
    closing = (back.join(parent, [*KEY, "parent_id"], "left").join(child, [*KEY, "child_id"], "left")
               .where(F.struct(F.coalesce("dp", F.lit(0)), "parent_id") >= F.struct(F.coalesce("dc", F.lit(0)), "child_id"))
               .select(*KEY, "edge_id"))
    return edges.join(materialize(closing, "acyclic"), [*KEY, "edge_id"], "left_anti")


def parent_shares(edges: DataFrame) -> DataFrame:
    """Edges with the even share of the child's flow that each carries."""
    return with_totals(edges, [*KEY, "child_id"], [F.count(F.lit(1)).alias("_n")], ["edge_id"]) \
        .withColumn("share", F.lit(1.0) / F.col("_n")).drop("_n")


def saturated_flow(edges: DataFrame, inflow: DataFrame, nodes_roots: DataFrame, ways: Climb | None = None) -> DataFrame:
    """Maximum flow of every edge: alignment capacity summed up the subtrees.

    ``inflow`` is ``(doc_id, component, node_id, capacity)``.  In forests (``ways``, where they are
    known with their edges: ``climb(edges, FLOW_EDGE)``) every vertex gives all it has to its one parent, layer by
    layer.  In other graphs flow climbs one level per round and is added up at every vertex, so each round
    is smaller than the one before.  The root's terminal edge is one more row with a null ``parent_id``.
    """
    top = nodes_roots.select(*KEY, "node_id")
    first = inflow.groupBy(*KEY, "node_id").agg(F.sum("capacity").alias("mass"))
    if ways is None or not ways.whole or not ways.other.isEmpty():
        all_edges = materialize(edges.select(*KEY, "edge_id", "parent_id", "child_id", "edge_type"), "flow-edges")
        if ways is None and all_edges.groupBy(*KEY, "child_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            ways = climb(all_edges, FLOW_EDGE)
        if ways is None or not ways.whole or not ways.other.isEmpty():
            flows, arrived = _level_flow(all_edges, first)
            return flows.unionByName(_drained(arrived, top), allowMissingColumns=True)
    parts, rest = raked_sums(ways, first, ["mass"])
    if not parts:
        return _drained(first, top).select(*KEY, F.lit(None).cast(dict(edges.dtypes)["edge_id"]).alias("edge_id"), F.lit(None).cast(
            dict(edges.dtypes)["parent_id"]).alias("parent_id"), "child_id", "edge_type", "flow")
    both = reduce(DataFrame.unionByName, [p.select(*KEY, "node_id", "up", *FLOW_EDGE, "n", "mass") for p in parts])
    flows = both.where("n > 0").select(*KEY, "edge_id", F.col("up").alias("parent_id"), F.col("node_id").alias("child_id"),
                                       "edge_type", F.coalesce("mass", F.lit(0.0)).alias("flow"))
    arrived = both.select(*KEY, "node_id", "mass").unionByName(rest)
    return flows.unionByName(_drained(arrived, top), allowMissingColumns=True)


#: What ``saturated_flow`` asks ``climb`` to keep of every edge.
FLOW_EDGE = ("edge_id", "edge_type")


def _drained(arrived: DataFrame, top: DataFrame) -> DataFrame:
    """Terminal edges of the roots with all that arrived there."""
    drained = (arrived.join(top, [*KEY, "node_id"], "left_semi")
               .groupBy(*KEY, "node_id").agg(F.sum("mass").alias("flow")))
    return top.join(drained, [*KEY, "node_id"], "left").select(
        *KEY, F.col("node_id").alias("child_id"), F.lit("terminal").alias("edge_type"),
        F.coalesce("flow", F.lit(0.0)).alias("flow"))


def _level_flow(all_edges: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flow of every edge and what arrived at every vertex, level by level."""
    flow_edges = materialize(parent_shares(acyclic(all_edges)).select(
        *KEY, "edge_id", F.col("child_id").alias("node_id"), "parent_id", "share"), "flow-shares")
    mass = materialize(first, "flow-mass")
    arrived, carried = mass, None
    while True:
        step = materialize(
            mass.join(flow_edges, [*KEY, "node_id"])
            .select(*KEY, "edge_id", "parent_id", (F.col("mass") * F.col("share")).alias("flow")),
            "flow-step")
        if step.isEmpty():
            break
        carried = step if carried is None else carried.unionByName(step)
        mass = step.groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.sum("flow").alias("mass"))
        arrived = arrived.unionByName(mass)
    if carried is None:
        return all_edges.withColumn("flow", F.lit(0.0)), arrived
    summed = carried.groupBy(*KEY, "edge_id").agg(F.sum("flow").alias("flow"))
    return (all_edges.join(summed, [*KEY, "edge_id"], "left")
            .withColumn("flow", F.coalesce("flow", F.lit(0.0)))), arrived


def feedable(nodes: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Vertices that a leaf below them (or they themselves) can feed.

    On graphs without cycles that is every vertex; a vertex whose descendants all
    lie on cycles gets no flow.
    """
    leaf = leaves(nodes, edges).select(*KEY, "node_id")
    fed = closure.join(leaf, [*KEY, "node_id"], "left_semi").select(
        *KEY, F.col("ancestor").alias("node_id"))
    return fed.unionByName(leaf).distinct()


def count_flow_updates(previous: DataFrame, current: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per document, role edges whose flow changed or that are new."""
    keys = [*KEY, "edge_id"]
    prev = previous.where("edge_type = 'role'").select(*keys, F.col("flow").alias("_old"))
    cur = current.where("edge_type = 'role'").select(*keys, F.col("flow").alias("_new"))
    changed = F.col("_new").isNotNull() & (
        F.col("_old").isNull() | (F.abs(F.col("_new") - F.col("_old")) > tolerance))
    return (cur.join(prev, keys, "full_outer")
            .groupBy("doc_id").agg(F.count_if(changed).alias("updates")))


def descendant_counts(edges: DataFrame, nodes_roots: DataFrame, closure: DataFrame | None = None,
                      ways: Climb | None = None) -> DataFrame:
    """Number of distinct descendants of each vertex, itself included.

    Without a closure, trees are counted layer by layer and by doubling (over ``ways`` where they are known),
    in rows that do not grow with the depth; only graphs in which a vertex has several parents list theirs.
    """
    if closure is None:
        ways = ways or climb(edges)
        sizes = subtree_sizes(ways)
        # a vertex with a null key is one vertex and has nothing below it
        known = reduce(and_, [F.col(c).isNotNull() for c in (*KEY, "node_id")])
        tops = nodes_roots.select(*KEY, "node_id").distinct()
        if ways.other.isEmpty():
            mine = tops
        else:
            mine = join_salted(tops, ways.other, KEY, ["node_id"], "left_anti")
            sizes = join_salted(sizes, ways.other, KEY, ["node_id"], "left_anti")
        alone = mine.where(known).join(sizes.join(tops, [*KEY, "node_id"], "left_semi"), [*KEY, "node_id"], "left_anti")
        odd = sizes.where(~known).select(*KEY, "node_id").unionByName(mine.where(~known)).distinct()
        one = F.lit(1).cast("long").alias("n_desc")
        counted = sizes.where(known).unionByName(alone.unionByName(odd).select(*KEY, "node_id", one))
        if ways.other.isEmpty():
            return counted
        other = materialize(join_salted(edges, ways.other, KEY, ["child_id"], "left_semi"), "reentrant-edges")
        mine = join_salted(nodes_roots.select(*KEY, "node_id"), ways.other, KEY, ["node_id"], "left_semi")
        return counted.unionByName(descendant_counts(other, mine, descendants(other)))
    ends = edges.select(*KEY, F.explode(F.array("parent_id", "child_id")).alias("node_id")) \
        .unionByName(nodes_roots.select(*KEY, "node_id")).distinct()
    below = (closure.where("ancestor <> node_id")
             .groupBy(*KEY, F.col("ancestor").alias("node_id"))
             .agg(F.count(F.lit(1)).alias("_below")))
    return ends.join(below, [*KEY, "node_id"], "left").select(
        *KEY, "node_id", (F.coalesce("_below", F.lit(0)) + 1).alias("n_desc"))


def _first_walk(eids: list, parents: list, children: list, tops: list) -> tuple[list, list]:
    """Descendants per edge and per root of one graph, counted as ``spread_first_visit_counts`` does.

    The walk goes on over the smallest edge id, from all roots at once.
    """
    step = [e.rjust(20, "0")[:20] for e in eids]
    out: dict = {}
    for i, p in enumerate(parents):
        out.setdefault(p, []).append(i)
    via: dict = {r: None for r in tops}
    stack = sorted((i for r in via for i in out.get(r, ())), key=step.__getitem__, reverse=True)
    order = []
    while stack:
        i = stack.pop()
        c = children[i]
        if c not in via:
            via[c] = i
            order.append(c)
            stack.extend(sorted(out.get(c, ()), key=step.__getitem__, reverse=True))
    tree = [(i := via.get(c)) is not None and eids[i] == e for e, c in zip(eids, children)]
    if len(set(eids)) < len(eids):  # several edges of one id may all be tree edges
        return _first_walk_of_any(tree, parents, children, tops)
    up = {c: parents[via[c]] for c in order}
    size = {v: 1 for v in (*order, *up.values())}
    for c in reversed(order):
        size[up[c]] += size[c]
    # places in the walk: a subtree is an interval
    first, free, total = {}, {}, 0
    for v in tops:
        if v in size and v not in first:
            first[v], free[v] = total, total + 1
            total += size[v]
    for c in order:
        first[c], free[c] = free[up[c]], free[up[c]] + 1
        free[up[c]] += size[c]
    more, met = dict.fromkeys(size, 0), {}
    for i in sorted((i for i, t in enumerate(tree) if not t and parents[i] in size), key=lambda i: str(children[i])):
        a, t = parents[i], children[i]
        at = first.get(t, -1)
        while a is not None and met.get(a) != (t,) and not first[a] <= at < first[a] + size[a]:
            met[a] = (t,)
            more[a] += 1
            a = up.get(a)
    return ([size[c] + more[c] if t else 1 for t, c in zip(tree, children)],
            [size[r] + more[r] if r in size else 1 for r in tops])


def _first_walk_of_any(tree: list, parents: list, children: list, tops: list) -> tuple[list, list]:
    below, again = {}, {}
    for t, p, c in zip(tree, parents, children):
        (below if t else again).setdefault(p, set()).add(c)
    ends = set(below).union(*below.values())

    def count(v) -> int:
        if v not in ends:
            return 1
        seen, todo = {v}, [v]
        while todo:
            new = below.get(todo.pop(), set()) - seen
            seen |= new
            todo.extend(new)
        return len(seen.union(*(again.get(x, ()) for x in seen)))

    sizes = {v: count(v) for v in ends}
    return [sizes[c] if t else 1 for t, c in zip(tree, children)], [sizes.get(r, 1) for r in tops]


def first_visit_counts(edges: DataFrame, nodes_roots: DataFrame, group_edges: int = 20_000) -> DataFrame:
    """Descendants per edge as a depth-first walk in edge order counts them; a root's own row has no
    edge id.

    Graphs of up to ``group_edges`` rows are walked one after the other in a function over many of them;
    larger ones, and any with a null key or id, by joins.  Both give the same counts.
    """
    rows = edges.select(*KEY, F.col("edge_id").cast("string").alias("edge_id"), "parent_id", "child_id",
                        F.lit(False).alias("_top")).unionByName(
        nodes_roots.select(*KEY, F.lit(None).cast("string").alias("edge_id"), F.col("node_id").alias("parent_id"),
                           F.col("node_id").alias("child_id"), F.lit(True).alias("_top")))
    rows = materialize(rows, "first-visit")
    odd = F.col("parent_id").isNull() | F.col("child_id").isNull() | (F.col("edge_id").isNull() & ~F.col("_top"))
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.max(odd).alias("_odd"))
    other = materialize(sizes.where((F.col("_n") > group_edges) | F.col("_odd") | F.col("doc_id").isNull()
                                    | F.col("component").isNull()).select(*KEY), "large-graphs")
    kinds = dict(rows.dtypes)

    def walk(table: pa.Table, starts: np.ndarray) -> pa.Table:
        eids, parents, children, tops = (table.column(c).to_pylist() for c in ("edge_id", "parent_id", "child_id", "_top"))
        n_desc = np.zeros(table.num_rows, dtype=np.int64)
        for start, end in zip(starts, [*starts[1:], table.num_rows]):
            links = [i for i in range(start, end) if not tops[i]]
            own = [i for i in range(start, end) if tops[i]]
            counts, sizes = _first_walk([eids[i] for i in links], [parents[i] for i in links], [children[i] for i in links],
                                        [parents[i] for i in own])
            n_desc[links], n_desc[own] = counts, sizes
        return table.select([*KEY, "edge_id"]).append_column("n_desc", pa.array(n_desc))

    schema = f"doc_id {kinds['doc_id']}, component {kinds['component']}, edge_id string, n_desc long"
    if other.isEmpty():
        return in_batches(rows, KEY, walk, schema)
    hit = reduce(and_, [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in KEY])
    keys = F.broadcast(other.withColumnsRenamed({k: f"_{k}" for k in KEY})) if other.count() < 10_000 else \
        other.withColumnsRenamed({k: f"_{k}" for k in KEY})
    small, large = rows.join(keys, hit, "left_anti"), rows.join(keys, hit, "left_semi")
    spread = spread_first_visit_counts(large.where("not _top").drop("_top"),
                                       large.where("_top").select(*KEY, F.col("parent_id").alias("node_id")))
    return in_batches(small, KEY, walk, schema).unionByName(spread)


def spread_first_visit_counts(edges: DataFrame, nodes_roots: DataFrame) -> DataFrame:
    """The same by joins, for graphs of any size.

    A vertex met a second time counts as one.  It is first met over its smallest
    path of edge ids, so the walk's tree is found by taking path minima.
    """
    edges = materialize(edges.select(*KEY, "edge_id", "parent_id", "child_id"), "first-visit")
    path = materialize(nodes_roots.select(*KEY, "node_id", F.lit("").alias("path"),
                                          F.lit(None).cast("string").alias("via")), "first-visit")
    links = edges.select(*KEY, F.col("parent_id").alias("node_id"), "child_id",
                         F.col("edge_id").cast("string").alias("eid"),
                         F.lpad(F.col("edge_id").cast("string"), 20, "0").alias("step"))
    best, frontier = path, path
    while not frontier.isEmpty():
        offers = frontier.join(links, [*KEY, "node_id"]).select(
            *KEY, F.col("child_id").alias("node_id"),
            F.concat_ws("/", "path", "step").alias("path"), F.col("eid").alias("via"))
        offers = offers.groupBy(*KEY, "node_id").agg(
            F.min_by(F.struct("path", "via"), "path").alias("o")).select(*KEY, "node_id", "o.*")
        known = best.select(*KEY, "node_id", F.col("path").alias("_known"))
        frontier = materialize(offers.join(known, [*KEY, "node_id"], "left")
                               .where("_known is null or path < _known").drop("_known"), "first-visit")
        merged = best.join(frontier.select(*KEY, "node_id"), [*KEY, "node_id"], "left_anti")
        old, best = best, materialize(merged.unionByName(frontier), "first-visit")
        if old is not path:
            discard(old)
    tree_ids = best.where("via is not null").select(*KEY, F.col("node_id").alias("child_id"), "via")
    tagged = edges.withColumn("via", F.col("edge_id").cast("string")).join(
        tree_ids.withColumn("is_tree", F.lit(True)), [*KEY, "child_id", "via"], "left")
    tree = tagged.where("is_tree")
    closure = descendants(tree, include_self=True, name="first-visit")
    extra = tagged.where("is_tree is null").select(*KEY, F.col("parent_id").alias("node_id"), "child_id")
    met_again = closure.join(extra, [*KEY, "node_id"]).select(*KEY, "ancestor", F.col("child_id").alias("node_id"))
    sizes = (closure.select(*KEY, "ancestor", "node_id").unionByName(met_again).distinct()
             .groupBy(*KEY, "ancestor").agg(F.count(F.lit(1)).alias("size")))
    per_edge = (tagged.join(sizes.withColumnRenamed("ancestor", "child_id"), [*KEY, "child_id"], "left")
                .select(*KEY, "edge_id", F.when(F.col("is_tree"), F.coalesce("size", F.lit(1)))
                        .otherwise(F.lit(1)).alias("n_desc")))
    root_size = (nodes_roots.select(*KEY, "node_id")
                 .join(sizes.withColumnRenamed("ancestor", "node_id"), [*KEY, "node_id"], "left")
                 .select(*KEY, F.lit(None).cast("string").alias("edge_id"),
                         F.coalesce("size", F.lit(1)).alias("n_desc")))
    return per_edge.withColumn("edge_id", F.col("edge_id").cast("string")).unionByName(root_size)


def flow_per_node(flows: DataFrame, counts: DataFrame, mode: str = "fpn") -> DataFrame:
    """Flow divided by the descendants of the edge's child.

    ``counts`` is per vertex (``descendant_counts``) or per edge
    (``first_visit_counts``).  ``fpn`` leaves it so; ``norm`` divides by the total
    of the component; ``vis`` does the same and keeps the value in ``vis_flow``.
    """
    if mode not in ("fpn", "norm", "vis"):
        raise ValueError("mode must be fpn, norm or vis")
    if "node_id" in counts.columns:
        per = flows.join(counts.withColumnRenamed("node_id", "child_id"), [*KEY, "child_id"])
    else:
        c = counts.withColumnRenamed("edge_id", "_eid")
        f = flows.withColumn("_eid", F.coalesce(F.col("edge_id").cast("string"), F.lit("")))
        c = c.withColumn("_eid", F.coalesce("_eid", F.lit("")))
        per = f.join(c, [*KEY, "_eid"]).drop("_eid")
    per = per.withColumn("flow", F.col("flow") / F.col("n_desc"))
    if mode == "fpn":
        return per
    total = with_totals(per, KEY, [F.sum("flow").alias("_total")], ["child_id"])
    out = total.withColumn("_norm", F.col("flow") / F.nullif("_total", F.lit(0.0)))
    out = out.withColumn("_norm", F.coalesce("_norm", F.lit(0.0)))
    if mode == "vis":
        out = out.withColumn("vis_flow", F.col("flow"))
    return out.withColumn("flow", F.col("_norm")).drop("_norm", "_total")


def set_flow(edges: DataFrame, components: Sequence[str] = (), edge_types: Sequence[str] = (),
             value: float = 0.0) -> DataFrame:
    """Static flow on the edges of components or of edge types."""
    hit = F.lit(False)
    if components:
        hit = hit | F.col("component").isin(*components)
    if edge_types:
        hit = hit | F.col("edge_type").isin(*edge_types)
    return edges.withColumn("flow", F.when(hit, F.lit(float(value))).otherwise(F.col("flow")))


def discount_flow(edge_flows: DataFrame, align_in: DataFrame, total: float) -> DataFrame:
    """Scale the alignment capacities into the child of every overfull role edge.

    Alignment rows are ``(doc_id, component, to_id, capacity, flow, ...)``; where a
    role edge carries more than ``total``, the capacities into its child become
    proportional to their flows with sum ``total``.
    """
    over = (edge_flows.where((F.col("edge_type") == "role") & (F.col("flow") > total))
            .select(*KEY, F.col("child_id").alias("to_id")).distinct())
    sums = (align_in.join(over, [*KEY, "to_id"], "left_semi")
            .groupBy(*KEY, "to_id").agg(F.sum("flow").alias("_sum")).where("_sum > 0"))
    return (join_salted(align_in, sums, [*KEY, "to_id"], ["from_id"], "left")
            .withColumn("capacity", F.when(F.col("_sum").isNotNull(),
                                           F.col("flow") * F.lit(float(total)) / F.col("_sum"))
                        .otherwise(F.col("capacity"))).drop("_sum"))


def reentrancies(edge_flows: DataFrame) -> DataFrame:
    """Vertices with more than one parent role edge, with a flow summary.

    The number of parents, the flow total and the zero test are plain aggregates;
    ``reentrancy_edges`` lists the edges as rows.
    """
    role = edge_flows.where("edge_type = 'role'")
    return (role.groupBy(*KEY, F.col("child_id").alias("node_id"))
            .agg(F.count(F.lit(1)).alias("n_parents"), F.sum("flow").alias("total_flow"),
                 F.max(F.col("flow") == 0).alias("has_zero_flow"))
            .where("n_parents > 1"))


def reentrancy_edges(edge_flows: DataFrame) -> DataFrame:
    """Parent role edges of every reentrant vertex with their flow."""
    found = reentrancies(edge_flows).select(*KEY, F.col("node_id").alias("child_id"))
    role = edge_flows.where("edge_type = 'role'")
    return join_salted(role, found, [*KEY, "child_id"], ["edge_id"], "left_semi")


def repair_capacities(edge_flows: DataFrame) -> DataFrame:
    """Capacities that split a reentrant vertex's flow evenly where one parent
    edge is starved; vertices without flow are left alone."""
    found = (reentrancies(edge_flows).where("has_zero_flow and total_flow > 0")
             .select(*KEY, F.col("node_id").alias("child_id"),
                     (F.col("total_flow") / F.col("n_parents")).alias("capacity")))
    role = edge_flows.where("edge_type = 'role'").select(*KEY, "edge_id", "child_id")
    return join_salted(role, found, [*KEY, "child_id"], ["edge_id"]).select(*KEY, "edge_id", "capacity")


def clamp_capacity(align_edges: DataFrame, min_capacity: float, value: float = 0.0) -> DataFrame:
    """Alignment edges at or below the minimum get the value as capacity and flow."""
    low = F.col("capacity") <= F.lit(float(min_capacity))
    out = align_edges
    for c in ("flow", "flow_source", "flow_summary"):
        if c in align_edges.columns:
            out = out.withColumn(c, F.when(low, F.lit(float(value))).otherwise(F.col(c)))
    return out.withColumn("capacity", F.when(low, F.lit(float(value))).otherwise(F.col("capacity")))


def low_flow_children(edge_flows: DataFrame, min_flow: float) -> DataFrame:
    """Children of weak role and sentence edges whose whole outflow is weak."""
    inner = edge_flows.where("edge_type <> 'terminal'")
    summed = inner.groupBy(*KEY, "child_id").agg(
        F.sum("flow").alias("_out"),
        F.max(F.col("edge_type").isin("role", "sentence") & (F.col("flow") <= min_flow)).alias("_weak"))
    return summed.where((F.col("_out") < min_flow) & F.col("_weak")).select(
        *KEY, F.col("child_id").alias("ancestor"))


def prune_targets(edge_flows: DataFrame, closure: DataFrame | None, min_flow: float,
                  edges: DataFrame | None = None, ways: Climb | None = None) -> DataFrame:
    """Vertices at or below a weak edge.

    With a closure by a join with it; without one from ``edges`` (and ``ways`` where they are known):
    trees by doubling, other graphs by the closure of their edges.
    """
    weak = low_flow_children(edge_flows, min_flow)
    if closure is None:
        ways = ways or climb(edges)
        weak = weak.withColumnRenamed("ancestor", "node_id")
        if ways.other.isEmpty():
            return at_or_below(ways, weak)
        hit = at_or_below(ways, join_salted(weak, ways.other, KEY, ["node_id"], "left_anti"))
        other = materialize(join_salted(edges, ways.other, KEY, ["child_id"], "left_semi"), "reentrant-edges")
        mine = join_salted(edge_flows, ways.other, KEY, ["child_id"], "left_semi")
        return hit.unionByName(prune_targets(mine, descendants(other), min_flow))
    below = join_salted(closure.where("ancestor <> node_id"), weak, [*KEY, "ancestor"],
                        ["node_id"], "left_semi").select(*KEY, "node_id")
    return below.unionByName(weak.withColumnRenamed("ancestor", "node_id")).distinct()


def prune_low_flow_subtrees(align_edges: DataFrame, edge_flows: DataFrame, closure: DataFrame,
                            component: str, min_flow: float, value: float = 0.0) -> DataFrame:
    """Zero the capacity of alignment edges into the subtrees under weak edges."""
    flows = edge_flows.where(F.col("component") == component)
    hit = (prune_targets(flows, closure.where(F.col("component") == component), min_flow)
           .select("doc_id", F.col("node_id").alias(TO_NODE[component]), F.lit(True).alias("_hit")))
    return (join_salted(align_edges, hit, ["doc_id", TO_NODE[component]],
                        [TO_NODE["summary" if component == "source" else "source"]], "left")
            .withColumn("capacity", F.when(F.col("_hit"), F.lit(float(value))).otherwise(F.col("capacity")))
            .drop("_hit").select(*align_edges.columns))


def remove_alignments(align_edges: DataFrame, min_capacity: float = 0.0) -> DataFrame:
    return align_edges.where(F.col("capacity") > F.lit(float(min_capacity)))


def flow_gaps(edges: DataFrame, diff: float = 0.0, compare=None) -> DataFrame:
    """Edges whose unused capacity compares to a value (default: differs)."""
    compare = compare or (lambda gap, value: gap != value)
    return edges.where(compare(F.col("capacity") - F.col("flow"), F.lit(float(diff))))
