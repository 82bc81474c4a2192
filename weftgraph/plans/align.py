"""The alignment program over all documents at once.

Where no vertex with several parents is below another one, the repaired maximum flow has a
closed form (see ``operators.flow``): a repaired vertex gives all that it gave before, so
its even split starves nobody.  One round of the loop is then a join of the alignment
table with a fixed table of "who is below whom" and an aggregation, for all documents
together.  In the other documents a repair can hold flow back, so they take the exact
maximum flow with its repair in every round.  Documents that have settled leave the loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.operators import flow as W
from weftgraph.operators import maxflow as M
from weftgraph.operators import results as R
from weftgraph.operators.coref import add_coref
from weftgraph.operators.graph import KEY, descendants, roots
from weftgraph.settings import AlignSettings
from weftgraph.skew import join_salted

DIRECTIONS = ("source", "summary")


@dataclass
class Alignment:
    """Tables of a finished alignment."""

    nodes: DataFrame
    edges: DataFrame
    align_edges: DataFrame
    edge_flows: DataFrame
    coref: DataFrame | None
    settings: AlignSettings
    #: ``doc_id, loops, converged``: loops a document took, and whether it settled by itself
    #: or was stopped by ``max_loops``
    loops: DataFrame | None = None

    def flows(self) -> DataFrame:
        return R.alignment_flows(self.nodes, self.edge_flows, self.align_edges)

    def component_stats(self) -> DataFrame:
        return R.component_stats(self.nodes, self.edges, self.edge_flows, self.align_edges, self.coref)

    def stats(self) -> DataFrame:
        return R.aggregate_stats(self.component_stats(), self.coref, self.settings)

    def stats_frame(self, texts: DataFrame | None = None) -> DataFrame:
        per = self.component_stats()
        return R.stats_frame(per, R.aggregate_stats(per, self.coref, self.settings), texts)

    def scores(self) -> DataFrame:
        per = self.component_stats()
        return R.score_row(per, R.aggregate_stats(per, self.coref, self.settings))


@dataclass
class Network:
    """What stays fixed during the loop."""

    mass_paths: DataFrame   # share of a node's inflow that passes an ancestor
    edges: DataFrame        # component edges and root terminals, share and descendants
    closure: DataFrame      # who is below whom
    unfed: DataFrame | None  # nodes no leaf can feed (only on cycles)
    # nodes and edges of the documents in which a vertex with several parents is below another
    nested: tuple[DataFrame, DataFrame] | None = None


def mass_paths(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Share of each node's inflow that passes through each node above it.

    One for every ancestor in a tree; products of even shares, added up over
    paths, in the documents that have vertices with several parents.
    """
    multi = (edges.groupBy(*KEY, "child_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(*KEY).distinct())
    multi = materialize(multi, "reentrant-docs")
    ones = closure.select(*KEY, "ancestor", "node_id", F.lit(1.0).alias("weight"))
    if multi.isEmpty():
        return ones
    trees = join_salted(ones, multi, KEY, ["node_id"], "left_anti")
    other = join_salted(edges, multi, KEY, ["child_id"], "left_semi")
    up = W.parent_shares(W.acyclic(other)).select(
        *KEY, F.col("child_id").alias("ancestor"), F.col("parent_id").alias("_up"), "share")
    up = materialize(up, "mass-shares")
    step = (other.select(*KEY, F.explode(F.array("parent_id", "child_id")).alias("node_id")).distinct()
            .select(*KEY, F.col("node_id").alias("ancestor"), "node_id", F.lit(1.0).alias("weight")))
    step = materialize(step, "mass-paths")
    found = step
    while True:
        step = materialize(
            step.join(up, [*KEY, "ancestor"])
            .groupBy(*KEY, F.col("_up").alias("ancestor"), "node_id")
            .agg(F.sum(F.col("weight") * F.col("share")).alias("weight")), "mass-paths")
        if step.isEmpty():
            break
        found = found.unionByName(step)
    summed = found.groupBy(*KEY, "ancestor", "node_id").agg(F.sum("weight").alias("weight"))
    return trees.unionByName(summed)


def nested_documents(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Documents in which a vertex with several parent role edges is below another one."""
    multi = materialize(
        edges.where("edge_type = 'role'").groupBy(*KEY, F.col("child_id").alias("node_id"))
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY, "node_id"), "reentrant-vertices")
    below = closure.where("ancestor <> node_id").join(multi, [*KEY, "node_id"], "left_semi")
    above = multi.withColumnRenamed("node_id", "ancestor")
    return below.join(above, [*KEY, "ancestor"], "left_semi").select("doc_id").distinct()


def prepare(nodes: DataFrame, edges: DataFrame) -> Network:
    closure = materialize(descendants(edges, include_self=True), "closure")
    shares = W.parent_shares(W.acyclic(edges)).select(*KEY, "edge_id", "share")
    top = roots(nodes)
    counts = W.descendant_counts(edges, top, closure)
    inner = (edges.select(*KEY, "edge_id", "parent_id", "child_id", "edge_type")
             .join(shares, [*KEY, "edge_id"], "left").fillna(0.0, ["share"]))
    ends = top.select(*KEY, F.col("node_id").alias("child_id"), F.lit("terminal").alias("edge_type"),
                      F.lit(1.0).alias("share"))
    both = inner.unionByName(ends, allowMissingColumns=True)
    both = both.join(counts.withColumnRenamed("node_id", "child_id"), [*KEY, "child_id"])
    # a lone root has no edge, so it is put into both tables by hand
    lone = top.select(*KEY, F.col("node_id").alias("ancestor"), "node_id").join(
        closure.select(*KEY, "ancestor"), [*KEY, "ancestor"], "left_anti").withColumn("hops", F.lit(0))
    closure = closure.unionByName(lone.select(*closure.columns))
    # edges dropped by ``acyclic`` are the mark of a cycle; only then can a node be unfed
    dropped = edges.select(*KEY, "edge_id").join(shares, [*KEY, "edge_id"], "left_anti")
    unfed = None
    if not dropped.isEmpty():
        fed = W.feedable(nodes, edges, closure)
        unfed = materialize(nodes.select(*KEY, "node_id").join(fed, [*KEY, "node_id"], "left_anti"), "unfed")
    by = ("component",)  # every flow step reads one component
    docs = materialize(nested_documents(edges, closure), "nested")
    nested = None if docs.isEmpty() else tuple(
        materialize(join_salted(t, docs, ["doc_id"], [key], "left_semi"), "nested")
        for t, key in ((nodes, "node_id"), (edges, "child_id")))
    return Network(materialize(mass_paths(edges, closure), "mass-paths", by),
                   materialize(both, "flow-edges", by), closure, unfed, nested)


def repaired_flow(net: Network, state: DataFrame, component: str) -> DataFrame:
    """Exact maximum flow of the nested documents with one repair of starved vertices, in the
    shape of ``maxflow``."""
    nodes, edges = net.nested
    docs = nodes.select("doc_id").distinct()
    mine = join_salted(state, docs, ["doc_id"], ["src_node", "smy_node"], "left_semi")
    flows, _ = M.repair_reentrancies(nodes, edges, mine.where("capacity > 0"), component)
    inner = flows.where(F.col("component") == component).select(
        F.col("doc_id").alias("_doc"), F.col("edge_id").alias("_eid"), F.col("flow").alias("_flow"))
    ends = flows.where(F.col("to_key") == W.SINK_TERMINAL).select(
        F.col("doc_id").alias("_doc"), F.lit("T").alias("_eid"), F.col("flow").alias("_flow"))
    found = inner.unionByName(ends).groupBy("_doc", "_eid").agg(F.sum("_flow").alias("_flow"))
    asked = join_salted(net.edges.where(F.col("component") == component), docs, ["doc_id"], ["child_id"], "left_semi")
    eid = F.when(F.col("edge_type") == "terminal", "T").otherwise(F.col("edge_id").cast("string"))
    out = asked.withColumn("_doc", F.col("doc_id").cast("string")).withColumn("_eid", eid)
    return (out.join(found, ["_doc", "_eid"], "left").withColumn("raw", F.coalesce("_flow", F.lit(0.0)))
            .withColumn("flow", F.col("raw") / F.col("n_desc")).drop("_doc", "_eid", "_flow"))


def maxflow(net: Network, state: DataFrame, component: str) -> DataFrame:
    """Raw maximum flow of every edge of a component after its repair, terminal included."""
    if net.nested is None:
        return closed_flow(net, state, component)
    nested = net.nested[0].select("doc_id").distinct()
    plain = join_salted(closed_flow(net, state, component), nested, ["doc_id"], ["child_id"], "left_anti")
    return plain.unionByName(repaired_flow(net, state, component).select(*plain.columns))


def closed_flow(net: Network, state: DataFrame, component: str) -> DataFrame:
    """Flow of documents without nested reentrancies: shares of the inflow, summed up."""
    pointed = W.orient(state, component)
    if net.unfed is not None:
        other = "summary" if component == "source" else "source"
        starved = net.unfed.where(F.col("component") == other).select(
            "doc_id", F.col("node_id").alias("from_id"))
        pointed = join_salted(pointed, starved, ["doc_id", "from_id"], ["to_id"], "left_anti")
    inflow = (pointed.where("capacity > 0").groupBy("doc_id", F.col("to_id").alias("node_id"))
              .agg(F.sum("capacity").alias("_in")))
    paths = net.mass_paths.where(F.col("component") == component)
    mass = (paths.join(inflow, ["doc_id", "node_id"])
            .groupBy(*KEY, F.col("ancestor").alias("child_id"))
            .agg(F.sum(F.col("weight") * F.col("_in")).alias("_mass")))
    edges = net.edges.where(F.col("component") == component)
    return (edges.join(mass, [*KEY, "child_id"], "left")
            .withColumn("raw", F.col("share") * F.coalesce("_mass", F.lit(0.0)))
            .withColumn("flow", F.col("raw") / F.col("n_desc")).drop("_mass"))


def _still(nested, done: DataFrame):
    """Nested documents that have not settled."""
    if nested is None:
        return None
    nodes, edges = (materialize(join_salted(t, done, ["doc_id"], [key], "left_anti"), "nested")
                    for t, key in zip(nested, ("node_id", "child_id")))
    return None if nodes.isEmpty() else (nodes, edges)


Step = Callable[[DataFrame, DataFrame, Network, str, AlignSettings], DataFrame]


def clamp_step(state: DataFrame, flows: DataFrame, net: Network, component: str,
               settings: AlignSettings) -> DataFrame:
    return W.clamp_capacity(state, settings.align_min_capacity, settings.capacity_min)


def prune_step(state: DataFrame, flows: DataFrame, net: Network, component: str,
               settings: AlignSettings) -> DataFrame:
    return W.prune_low_flow_subtrees(state, flows, net.closure, component,
                                     settings.role_min_flow, settings.capacity_min)


def remove_step(state: DataFrame, flows: DataFrame | None, net: Network, component: str | None,
                settings: AlignSettings) -> DataFrame:
    return W.remove_alignments(state, settings.capacity_min)


@dataclass(frozen=True)
class NamedStep:
    """A step of the program: ``enabled`` runs it, ``updates`` keeps a document in the loop
    while the step changes capacities of its alignments."""

    name: str
    run: Step
    enabled: bool = True
    updates: bool = False


@dataclass(frozen=True)
class StepSets:
    """The program as three sets: once after the first flow of each direction, after every
    flow of the loop, and at the end."""

    construct: tuple[NamedStep, ...] = (NamedStep("clamp", clamp_step),)
    loop: tuple[NamedStep, ...] = (NamedStep("clamp", clamp_step), NamedStep("prune", prune_step))
    finish: tuple[NamedStep, ...] = (NamedStep("remove", remove_step),)

    def switched(self, **enabled: bool) -> "StepSets":
        """The same sets with the named steps switched on or off."""
        names = {x.name for part in (self.construct, self.loop, self.finish) for x in part}
        if set(enabled) - names:
            raise ValueError(f"unknown steps: {sorted(set(enabled) - names)}")
        return StepSets(*[tuple(replace(x, enabled=enabled.get(x.name, x.enabled)) for x in part)
                          for part in (self.construct, self.loop, self.finish)])


ALIGNED_PAIR = ["doc_id", "src_node", "smy_node", "rel_id"]


def _changed_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents of which an alignment has another capacity than before."""
    old = before.select(*[F.col(c).alias(f"_{c}") for c in ALIGNED_PAIR], F.col("capacity").alias("_old"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ALIGNED_PAIR])
    return after.join(old, same).where("not (capacity <=> _old)").select("doc_id").distinct()


def _raw(flows: DataFrame) -> DataFrame:
    return flows.select(*KEY, "edge_id", "edge_type", F.col("raw").alias("flow"))


def align(nodes: DataFrame, edges: DataFrame, align_edges: DataFrame,
          settings: AlignSettings = AlignSettings(), coref: DataFrame | None = None,
          steps: StepSets = StepSets()) -> Alignment:
    """Align all documents.

    ``align_edges`` has ``doc_id, src_node, smy_node, sim, capacity``.  Each loop
    computes the flow towards either component, clamps weak alignments and prunes
    the alignments under weak edges, until no role edge of a document changed its
    flow in two loops in a row or the loop limit is reached; ``loops`` of the result says
    which.
    """
    net = prepare(nodes, edges)
    state = align_edges if coref is None else add_coref(align_edges, coref, nodes)
    state = materialize(R._with_relations(state).select(
        "doc_id", "src_node", "smy_node", "rel_id", "is_bipartite", "sim", "capacity"), "align-state")
    # documents without any alignment have no flow and take no part in the loop
    busy = state.select("doc_id").distinct()
    live = Network(join_salted(net.mass_paths, busy, ["doc_id"], ["node_id"], "left_semi"),
                   join_salted(net.edges, busy, ["doc_id"], ["child_id"], "left_semi"),
                   net.closure, net.unfed, net.nested)
    previous = {}
    for component in DIRECTIONS:
        flows = materialize(maxflow(live, state, component), "flows")
        previous[component] = flows
        for step in steps.construct:
            if step.enabled:
                state = step.run(state, flows, live, component, settings)
    state = materialize(state.withColumn("quiet", F.lit(0)), "align-state")
    settled, final_flows, taken = [], [], []
    fixed, n_fixed = (live.mass_paths, live.edges), None  # the tables of the loop as written last

    def note(rows: DataFrame, loops: int, converged: bool) -> None:
        taken.append(rows.select("doc_id").distinct().select(
            "doc_id", F.lit(loops).alias("loops"), F.lit(converged).alias("converged")))

    for loop_no in range(1, settings.max_loops + 1):
        flows_now, updates = {}, None
        work = state
        for component in DIRECTIONS:
            flows = materialize(maxflow(live, work, component), "flows")
            flows_now[component] = flows
            changed = W.count_flow_updates(_raw(previous[component]), _raw(flows))
            updates = changed if updates is None else updates.unionByName(changed)
            for step in steps.loop:
                if step.enabled:
                    before, work = work, step.run(work, flows, live, component, settings)
                    if step.updates:
                        updates = updates.unionByName(_changed_documents(before, work).withColumn(
                            "updates", F.lit(1).cast("long")))
        # a document without role edges or alignments has no row here and is quiet
        loud = updates.groupBy("doc_id").agg(F.sum("updates").alias("n")).where("n > 0").select("doc_id")
        loud = loud.withColumn("_loud", F.lit(True))
        work = (join_salted(work, loud, ["doc_id"], ["src_node", "smy_node"], "left")
                .withColumn("quiet", F.when(F.col("_loud"), F.lit(0)).otherwise(F.col("quiet") + 1))
                .drop("_loud"))
        work = materialize(work, "align-state")
        settled.append(work.where("quiet >= 2"))
        note(settled[-1], loop_no, True)
        state = work.where("quiet < 2")
        moving, resting = work.agg(F.count_if(F.col("quiet") < 2), F.count_if(F.col("quiet") >= 2)).first()
        if not moving:
            final_flows.extend(flows_now.values())
            break
        if resting:
            # settled documents keep this loop's flows and leave; the others go on
            done = materialize(settled[-1].select("doc_id").distinct(), "settled")
            for component, flows in flows_now.items():
                final_flows.append(join_salted(flows, done, ["doc_id"], ["child_id"], "left_semi"))
                flows_now[component] = join_salted(flows, done, ["doc_id"], ["child_id"], "left_anti")
            # one small table of live documents instead of a filter per loop; the fixed tables are
            # written anew when half of their documents have left
            alive = materialize(state.select("doc_id").distinct(), "alive")
            n_alive = alive.count()
            n_fixed = n_fixed or n_alive + done.count()
            kept = [join_salted(t, alive, ["doc_id"], [key], "left_semi") for t, key in zip(fixed, ("node_id", "child_id"))]
            if 2 * n_alive <= n_fixed:
                kept = [materialize(t, "live", ("component",)) for t in kept]
                fixed, n_fixed = tuple(kept), n_alive
            live = Network(*kept, live.closure, live.unfed, _still(live.nested, done))
        previous = flows_now
    else:
        settled.append(state)
        note(state, settings.max_loops, False)
        final_flows.extend(previous.values())
    aligned = settled[0]
    for part in settled[1:]:
        aligned = aligned.unionByName(part)
    aligned = aligned.drop("quiet")
    for step in steps.finish:
        if step.enabled:
            aligned = step.run(aligned, None, net, None, settings)
    flows = final_flows[0]
    for part in final_flows[1:]:
        flows = flows.unionByName(part)
    seen = flows.select("doc_id").distinct()
    rest = join_salted(net.edges, seen, ["doc_id"], ["child_id"], "left_anti")
    rest = rest.withColumn("raw", F.lit(0.0)).withColumn("flow", F.lit(0.0))
    flows = materialize(flows.unionByName(rest.select(*flows.columns)), "edge-flows")
    loops = taken[0]
    for part in taken[1:]:
        loops = loops.unionByName(part)
    idle = nodes.select("doc_id").distinct().join(busy, "doc_id", "left_anti").select(
        "doc_id", F.lit(0).alias("loops"), F.lit(True).alias("converged"))
    return Alignment(nodes, edges, materialize(aligned, "aligned"), flows, coref, settings,
                     materialize(loops.unionByName(idle), "loops"))


def align_one(nodes: DataFrame, edges: DataFrame, align_edges: DataFrame, doc_id,
              settings: AlignSettings = AlignSettings(), failures: DataFrame | None = None,
              coref: DataFrame | None = None) -> Alignment:
    """Align one document outside any store; its failure is raised to the caller."""
    def one(t: DataFrame | None) -> DataFrame | None:
        return None if t is None else t.where(F.col("doc_id") == F.lit(doc_id))

    if failures is not None:
        bad = one(failures).first()
        if bad is not None:
            raise ValueError(f"{doc_id}: {bad['message']}")
    if one(nodes).isEmpty():
        raise ValueError(f"no document with this id: {doc_id}")
    return align(one(nodes), one(edges), one(align_edges), settings, one(coref))
