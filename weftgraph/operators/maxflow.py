"""Exact maximum flow per document for networks with any capacities.

One rule for documents of every size: excess moves towards the sink over shortest residual
ways, shared over the open edges by what they still take.  Large documents are solved in
rounds of joins over all of them together, so none has to fit into a task; small ones go
through the same rounds in arrays of many documents (``operators.batches``).  What a
document gets depends neither on its size nor on which others are solved with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import discard, materialize
from weftgraph.operators.batches import column, expand, in_batches
from weftgraph.operators.flow import (
    SINK_TERMINAL, SOURCE_TERMINAL, build_network, reentrancies, repair_capacities)
from weftgraph.operators.guard import FAILURE, guarded
from weftgraph.settings import MAX_CAPACITY
from weftgraph.skew import join_salted, with_totals

TOLERANCE = 1e-9

_COLUMNS = ["doc_id", "from_key", "to_key", "capacity", "edge_type", "component", "edge_id"]


def _distances(rest: DataFrame, start: DataFrame, towards: bool) -> DataFrame:
    """Shortest residual distance to (``towards``) or from the start nodes."""
    near, far = ("v", "u") if towards else ("u", "v")
    links = rest.where(F.col("r") > TOLERANCE).select(
        "doc_id", F.col(near).alias("node"), F.col(far).alias("next"))
    step = materialize(start.select("doc_id", "node", F.lit(0).alias("dist")), "distances")
    found, dist = step, 0
    while not step.isEmpty():
        dist += 1
        nxt = (step.join(links, ["doc_id", "node"]).select("doc_id", F.col("next").alias("node")).distinct()
               .join(found, ["doc_id", "node"], "left_anti").withColumn("dist", F.lit(dist)))
        step = materialize(nxt, "distances")
        found = found.unionByName(step)
    return found


def _drain(rest: DataFrame, excess: DataFrame, target: str, closed: str) -> tuple[DataFrame, DataFrame]:
    """Push all excess that can reach the target there, nearest way first.

    Distances are fixed during a phase; every pulse moves the excess of all nodes one
    step nearer, shared over the open edges by what they still take.  A phase ends
    when nothing moves; excess then stuck has a longer way in the next phase.
    """
    def moving(t: DataFrame) -> DataFrame:
        return t.where((F.col("e") > TOLERANCE) & ~F.col("node").isin(target, closed))

    while True:
        # only documents that still have excess under way are searched
        docs = materialize(moving(excess).select("doc_id").distinct(), "drain")
        if docs.isEmpty():
            return rest, excess
        ends = docs.select("doc_id", F.lit(target).alias("node"))
        inner = rest.where((F.col("u") != closed) & (F.col("v") != closed) & (F.col("r") > TOLERANCE))
        dist = _distances(join_salted(inner, docs, ["doc_id"], ["u", "v"], "left_semi"), ends, True)
        du = dist.select("doc_id", F.col("node").alias("u"), F.col("dist").alias("_du"))
        dv = dist.select("doc_id", F.col("node").alias("v"), F.col("dist").alias("_dv"))
        moved = False
        while True:
            active = moving(excess).select("doc_id", F.col("node").alias("u"), "e")
            open_arcs = (rest.where(F.col("r") > TOLERANCE).join(active, ["doc_id", "u"])
                         .join(du, ["doc_id", "u"]).join(dv, ["doc_id", "v"])
                         .where(F.col("_du") == F.col("_dv") + 1).select("doc_id", "u", "v", "r", "e"))
            room = with_totals(open_arcs, ["doc_id", "u"], [F.sum("r").alias("_room")], ["v"])
            push = materialize(room.select(
                "doc_id", "u", "v", (F.col("r") * F.least(F.lit(1.0), F.col("e") / F.col("_room"))).alias("d")),
                "push")
            if push.isEmpty():
                break
            moved = True
            back = push.select("doc_id", F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("d")).alias("d"))
            change = push.unionByName(back).groupBy("doc_id", "u", "v").agg(F.sum("d").alias("d"))
            old = (rest, excess)
            rest = materialize(
                rest.join(change, ["doc_id", "u", "v"], "left")
                .select("doc_id", "u", "v", "cap", F.greatest(
                    F.col("r") - F.coalesce("d", F.lit(0.0)), F.lit(0.0)).alias("r")), "residual")
            net = push.select("doc_id", F.explode(F.array(
                F.struct(F.col("u").alias("node"), (-F.col("d")).alias("e")),
                F.struct(F.col("v").alias("node"), F.col("d").alias("e")))).alias("x")).select("doc_id", "x.*")
            excess = materialize(excess.unionByName(net).groupBy("doc_id", "node").agg(
                F.sum("e").alias("e")), "excess")
            discard(*old, push)
        if not moved:
            return rest, excess


SCHEMA = ("doc_id string, from_key string, to_key string, capacity double, edge_type string, "
          "component string, edge_id string, flow double, in_cut boolean, source_side boolean")


class _Networks:
    """The rounds of ``_drain`` for many small documents at once, each by itself.

    ``starts`` are the first edges of the documents.  Vertices are numbered by document and name, arcs
    by their ends; a round looks only at the arcs of the vertices that have something to push.
    """

    def __init__(self, from_key: pa.Array, to_key: pa.Array, capacity: np.ndarray, starts: np.ndarray):
        n = len(capacity)
        docs = len(starts)
        doc = np.repeat(np.arange(docs), np.diff(np.append(starts, n)))
        coded = pa.concat_arrays([from_key, to_key]).dictionary_encode()
        names = coded.dictionary
        place = np.empty(len(names) + 1, dtype=np.int64)
        place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        place[-1] = len(names)
        wide = len(names) + 1
        name = place[coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
        vertices, ends = np.unique(np.concatenate([doc, doc]) * wide + name, return_inverse=True)
        self.doc, name, size = vertices // wide, vertices % wide, len(vertices)
        self.at = {t: name == (place[i] if (i := names.index(t).as_py()) >= 0 else wide)
                   for t in (SOURCE_TERMINAL, SINK_TERMINAL)}
        self.docs, self.tail, self.head = docs, ends[:n], ends[n:]
        limited = capacity < MAX_CAPACITY
        bound = 2 * np.bincount(doc[limited], capacity[limited], docs) + 1
        some = np.bincount(doc[limited], minlength=docs) > 0
        self.own = np.where(limited | ~some[doc], capacity, bound[doc])
        arcs, row = np.unique(np.concatenate([self.tail * size + self.head, self.head * size + self.tail]), return_inverse=True)
        self.row = row[:n]
        self.cap = np.bincount(self.row, self.own, len(arcs))
        self.u, self.v = arcs // size, arcs % size
        self.back = np.searchsorted(arcs, self.v * size + self.u)
        self.first = np.searchsorted(self.u, np.arange(size + 1))
        fed = self.at[SOURCE_TERMINAL][self.u]
        self.rest = np.where(fed, 0.0, self.cap + np.where(self.at[SOURCE_TERMINAL][self.v], self.cap[self.back], 0.0))
        self.excess = np.zeros(size)
        self.excess[self.v[fed]] = self.cap[fed]

    def out(self, vertices: np.ndarray) -> np.ndarray:
        first = self.first[vertices]
        return expand(first, self.first[vertices + 1] - first)

    def levels(self, start: np.ndarray, towards: bool, closed: np.ndarray | None = None) -> np.ndarray:
        """Shortest residual distances to or from the start vertices, -1 where there is no way."""
        dist = np.full(len(self.doc), -1)
        dist[start], step, k = 0, start, 0
        while len(step):
            arcs = self.out(step)
            ahead = self.v[arcs]
            ok = (self.rest[self.back[arcs] if towards else arcs] > TOLERANCE) & (dist[ahead] < 0)
            if closed is not None:
                ok &= ~closed[ahead]
            step, k = np.unique(ahead[ok]), k + 1
            dist[step] = k
        return dist

    def drain(self, target: str, closed: str) -> None:
        end, shut = self.at[target], self.at[closed]
        going = np.ones(self.docs, dtype=bool)
        while True:
            hot = np.flatnonzero(~(self.excess <= TOLERANCE) & ~end & ~shut & going[self.doc])
            going = np.zeros(self.docs, dtype=bool)
            going[self.doc[hot]] = True
            dist = self.levels(np.flatnonzero(end & going[self.doc]), True, shut)
            moved, hot = np.zeros(self.docs, dtype=bool), hot[dist[hot] > 0]
            while len(hot):
                arcs = self.out(hot)
                arcs = arcs[(self.rest[arcs] > TOLERANCE) & (dist[self.v[arcs]] == dist[self.u[arcs]] - 1)]
                if not len(arcs):
                    break
                u, v, r = self.u[arcs], self.v[arcs], self.rest[arcs]
                begin = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                part = self.excess[u[begin]] / np.add.reduceat(r, begin)
                d = r * np.repeat(np.where(part < 1.0, part, 1.0), np.diff(np.append(begin, len(u))))
                self.excess[u[begin]] -= np.add.reduceat(d, begin)
                np.add.at(self.excess, v, d)
                for change, by in ((arcs, r - d), (self.back[arcs], self.rest[self.back[arcs]] + d)):
                    self.rest[change] = np.where(by < 0.0, 0.0, by)
                moved[self.doc[u[begin]]] = True
                hot = np.unique(np.concatenate([u[begin], v]))
                hot = hot[(dist[hot] > 0) & ~(self.excess[hot] <= TOLERANCE)]
            if not moved.any():
                return
            going = moved

    def solved(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``flow, in_cut, source_side`` of every edge."""
        self.drain(SINK_TERMINAL, SOURCE_TERMINAL)
        self.drain(SOURCE_TERMINAL, SINK_TERMINAL)
        side = self.levels(np.flatnonzero(self.at[SOURCE_TERMINAL]), False) >= 0
        all_, sent = self.cap[self.row], self.cap[self.row] - self.rest[self.row]
        with np.errstate(divide="ignore", invalid="ignore"):
            flow = np.where(all_ > 0, np.where(sent < 0.0, 0.0, sent) * self.own / all_, 0.0)
        return flow, side[self.tail] & ~side[self.head], side[self.tail]


def _solve_batch(keep: list[str], table: pa.Table, starts: np.ndarray) -> pa.Table:
    capacity = column(table, "capacity").cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    found = _Networks(column(table, "from_key"), column(table, "to_key"), capacity, starts).solved()
    for name, values in zip(("flow", "in_cut", "source_side"), found):
        table = table.append_column(name, pa.array(values))
    return table.select(keep)


def _solve_one(group: pd.DataFrame) -> pd.DataFrame:
    ends = (pa.array(group[c], pa.string()) for c in ("from_key", "to_key"))
    found = _Networks(*ends, group["capacity"].to_numpy(dtype=float), np.zeros(1, dtype=np.int64)).solved()
    return group.assign(**dict(zip(("flow", "in_cut", "source_side"), found)))


def guarded_max_flow(network: DataFrame) -> DataFrame:
    """``max_flow`` of documents of any number of edges that fit a task, with a ``failure`` column: a
    document with a capacity that is null, negative or not a number is one row that says so
    (``guard.split_failures``)."""
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        if not (group["capacity"] >= 0).all():
            raise ValueError("a capacity is no number or negative")
        return _solve_one(group)

    typed = network.select(F.col("doc_id").cast("string").alias("doc_id"), *_COLUMNS[1:])
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return typed.groupBy("doc_id").applyInPandas(guarded(solve, ["doc_id"], names), f"{SCHEMA}, {FAILURE} string")


def _small_flow(network: DataFrame, keep: list[str]) -> DataFrame:
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    read = [c for c in _COLUMNS if c in keep or c in _COLUMNS[:4]]
    rows = network.select(*[F.col(c).cast(kinds[c]).alias(c) for c in read])
    return in_batches(rows, ["doc_id"], partial(_solve_batch, keep), ", ".join(f"{c} {kinds[c]}" for c in keep))


def max_flow(network: DataFrame, group_edges: int = 20_000, columns: Sequence[str] | None = None) -> DataFrame:
    """Flow of every edge, the minimum cut and the source side, per document.

    Documents of up to ``group_edges`` edges take the rounds in a function over many of them at once,
    larger ones as joins; both follow one rule and give the same flows.  ``columns``: what the caller reads, if
    not all; the edges' other names are then not shuffled.
    """
    keep = [c.split()[0] for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns]
    typed = network.select(F.col("doc_id").cast("string").alias("doc_id"), *_COLUMNS[1:])
    large = materialize(typed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
                        .where(F.col("_n") > group_edges).select("doc_id"), "large-networks")
    if large.isEmpty():
        return _small_flow(typed, keep)
    spread = ["from_key", "to_key"]
    small = join_salted(typed, large, ["doc_id"], spread, "left_anti")
    return _small_flow(small, keep).unionByName(
        spread_max_flow(join_salted(typed, large, ["doc_id"], spread, "left_semi")).select(*keep))


def spread_max_flow(network: DataFrame) -> DataFrame:
    """The rounds as joins, for documents of any size.

    An unlimited capacity counts as more than twice the sum of the limited ones, so it is
    never the one that binds.  What the edges at S carry is first assumed to be all they may, then pushed towards
    T, and what cannot arrive is pushed back to S.
    """
    network = network.select(F.col("doc_id").cast("string").alias("doc_id"), *_COLUMNS[1:])
    finite = F.sum(F.when(F.col("capacity") < MAX_CAPACITY, F.col("capacity"))).alias("_bound")
    net = with_totals(network, ["doc_id"], [finite], ["from_key", "to_key"])
    net = materialize(net.withColumn("_cap", F.when(
        F.col("capacity") >= MAX_CAPACITY, F.coalesce(2 * F.col("_bound") + 1, "capacity")).otherwise(F.col("capacity"))),
        "network")
    arcs = net.groupBy("doc_id", F.col("from_key").alias("u"), F.col("to_key").alias("v")).agg(
        F.sum("_cap").alias("cap"))
    both = arcs.unionByName(arcs.select("doc_id", F.col("v").alias("u"), F.col("u").alias("v"),
                                        F.lit(0.0).alias("cap")))
    arcs = materialize(both.groupBy("doc_id", "u", "v").agg(F.sum("cap").alias("cap")), "arcs")
    fed = arcs.where(F.col("u") == SOURCE_TERMINAL)
    given = fed.select("doc_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("cap").alias("_g"))
    rest = arcs.join(given, ["doc_id", "u", "v"], "left").select(
        "doc_id", "u", "v", "cap", F.when(F.col("u") == SOURCE_TERMINAL, F.lit(0.0)).otherwise(
            F.col("cap") + F.coalesce("_g", F.lit(0.0))).alias("r"))
    rest = materialize(rest, "residual")
    excess = materialize(fed.select("doc_id", F.col("v").alias("node"), F.col("cap").alias("e")), "excess")
    rest, excess = _drain(rest, excess, SINK_TERMINAL, SOURCE_TERMINAL)
    rest, excess = _drain(rest, excess, SOURCE_TERMINAL, SINK_TERMINAL)
    start = rest.select("doc_id", F.lit(SOURCE_TERMINAL).alias("node")).distinct()
    side = _distances(rest, start, False).select("doc_id", "node", F.lit(True).alias("_in"))
    flow = rest.select("doc_id", F.col("u").alias("from_key"), F.col("v").alias("to_key"),
                       F.greatest(F.col("cap") - F.col("r"), F.lit(0.0)).alias("_f"), F.col("cap").alias("_all"))
    spread = ["edge_id", "edge_type"]
    out = net.join(flow, ["doc_id", "from_key", "to_key"])
    out = join_salted(out, side.select("doc_id", F.col("node").alias("from_key"), F.col("_in").alias("_a")),
                      ["doc_id", "from_key"], spread, "left")
    out = join_salted(out, side.select("doc_id", F.col("node").alias("to_key"), F.col("_in").alias("_b")),
                      ["doc_id", "to_key"], spread, "left")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    # parallel edges share the flow of their node pair by capacity
    share = F.when(F.col("_all") > 0, F.col("_f") * F.col("_cap") / F.col("_all")).otherwise(F.lit(0.0))
    return out.select(*_COLUMNS, share.alias("flow"), (a & ~b).alias("in_cut"), a.alias("source_side"))


def max_flow_value(flows: DataFrame) -> DataFrame:
    """Value of the maximum flow: what arrives at the sink."""
    return (flows.where(F.col("to_key") == SINK_TERMINAL)
            .groupBy("doc_id").agg(F.sum("flow").alias("value")))


def cut_certificate(flows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``doc_id, value, cut, n_cut, certified``: a proof per document that a flow is a maximum.

    The flow's value has to equal the capacity of the cut, the source terminal has to lie on one
    side and the sink on the other, and exactly the edges that lead from the source's side to
    the sink's have to be cut.  No flow is larger than any such cut, so what is certified is a maximum
    whichever way it was found.
    """
    # a vertex that nothing leaves is on the source's side if an uncut edge leads there from it
    entered = F.col("source_side") & ~F.col("in_cut") & (F.col("to_key") != SINK_TERMINAL)
    side = flows.select("doc_id", F.col("from_key").alias("to_key"), F.col("source_side").alias("_out"), F.lit(None).cast("boolean").alias("_in"))
    side = side.unionByName(flows.select("doc_id", "to_key", F.lit(None).cast("boolean").alias("_out"), entered.alias("_in")))
    side = side.groupBy("doc_id", "to_key").agg(F.coalesce(F.max("_out"), F.max("_in"), F.lit(False)).alias("_to"))
    both = flows.join(side, ["doc_id", "to_key"])
    crosses = F.col("source_side") & ~F.col("_to")
    wrong = (F.col("in_cut") != crosses) | ((F.col("from_key") == SOURCE_TERMINAL) & ~F.col("source_side")) | (
        (F.col("to_key") == SINK_TERMINAL) & F.col("_to"))
    per = both.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(F.col("to_key") == SINK_TERMINAL, F.col("flow"))), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum(F.when(F.col("in_cut"), F.col("capacity"))), F.lit(0.0)).alias("cut"),
        F.count_if("in_cut").alias("n_cut"), F.max(wrong).alias("_wrong"))
    near = F.abs(F.col("value") - F.col("cut")) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs("cut"))
    return per.select("doc_id", "value", "cut", "n_cut", (near & ~F.col("_wrong")).alias("certified"))


def component_edge_flows(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Flows of component edges in the shape of ``saturated_flow``'s result."""
    inner = flows.where("component is not null").select("doc_id", "component", "edge_id", "flow")
    keyed = edges.withColumn("_eid", F.col("edge_id").cast("string")).withColumn(
        "_doc", F.col("doc_id").cast("string"))
    right = inner.select(F.col("doc_id").alias("_doc"), "component", F.col("edge_id").alias("_eid"),
                         F.col("flow").alias("_flow"))
    return (keyed.drop("flow").join(right, ["_doc", "component", "_eid"])
            .withColumn("flow", F.col("_flow")).drop("_doc", "_eid", "_flow"))


def repair_reentrancies(nodes: DataFrame, edges: DataFrame, align_edges: DataFrame,
                        component: str = "source", only_report: bool = False) -> tuple[DataFrame, DataFrame]:
    """Maximum flow, then one even-split repair of starved reentrant vertices.

    Returns the flows (solved again where something was repaired) and the
    reentrancies seen before the repair.
    """
    first = materialize(max_flow(build_network(nodes, edges, align_edges, component)), "max-flow")
    inner = component_edge_flows(first, edges)
    report = reentrancies(inner)
    if only_report:
        return first, report
    fixed = materialize(repair_capacities(inner), "repair")
    if fixed.isEmpty():
        return first, report
    touched = fixed.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    network = build_network(nodes, edges, align_edges, component, extra=fixed)
    network = network.withColumn("doc_id", F.col("doc_id").cast("string"))
    again = max_flow(join_salted(network, touched, ["doc_id"], ["from_key", "to_key"], "left_semi"))
    kept = join_salted(first, touched, ["doc_id"], ["from_key", "to_key"], "left_anti")
    return kept.unionByName(again), report
