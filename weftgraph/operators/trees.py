"""Trees without a table of nodes times depth.

``graph.rake`` takes leaves off as long as that halves what is left, so bushy trees take few rounds over
shrinking tables; the rest goes by doubling.
Every vertex knows its ancestor 2^k steps above after k rounds of doubling, so sums over
subtrees, places in depth-first order and "is anything above marked" take as many rounds
as the depth has binary digits, each over at most one row per vertex.  A chain of a hundred
thousand vertices takes seventeen rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import discard, materialize
from weftgraph.operators.graph import KEY, dense_ids, hang, rake

NODE = [*KEY, "node_id"]


@dataclass(frozen=True)
class Climb:
    """The ways up of all forests, written once and read by every sum and mark: graphs that are none
    (``other``: ``KEY``), the ``layers`` of the others' vertices that ``rake`` took off from below, and
    of what is left (``core``) every vertex's ancestor 1, 2, 4, ... steps above."""

    other: DataFrame
    steps: tuple[DataFrame, ...]
    layers: tuple[DataFrame, ...] = ()
    core: DataFrame | None = None
    #: every edge is one row of the layers and the core, so they have its other columns too
    whole: bool = False


def climb(edges: DataFrame, payload: Sequence[str] = ()) -> Climb:
    """A graph is no forest if a vertex has several parents or a way up goes round in a circle.

    ``payload``: edge columns that the vertices keep of the edge above them (``whole``).
    """
    links = edges.select(*KEY, F.col("child_id").alias("node_id"), F.col("parent_id").alias("up"), *payload)
    hung = materialize(hang(links), "hung", ("inner",))
    whole = hung.where("n > 1").isEmpty()
    if not whole:
        hung = materialize(hang(links.select(*NODE, "up").distinct()), "hung", ("inner",))
    multi = materialize(hung.where("n > 1 or node_id = up").select(*KEY).distinct(), "reentrant-graphs")
    all_forests = multi.isEmpty()
    layers, core = rake(hung if all_forests else hung.join(multi, KEY, "left_anti"), all_forests)
    steps = []
    if not core.isEmpty():
        steps = list(steps_up(core.where("up is not null"), keep=True))
        last = steps.pop()
        if not last.isEmpty():
            circles = materialize(last.select(*KEY).distinct(), "circles")
            steps, layers = ([materialize(s.join(circles, KEY, "left_anti"), "steps") for s in t] for t in (steps, layers))
            core = materialize(core.join(circles, KEY, "left_anti"), "steps")
            multi = materialize(multi.unionByName(circles), "reentrant-graphs")
    return Climb(multi, tuple(steps), tuple(layers), core, whole)


def raked_sums(ways: Climb, values: DataFrame | None, columns: Sequence[str], own: int | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """The tables of ``ways`` with every column summed over the vertex and all below it, and the
    rows of ``values`` (one per vertex at most) that are of no vertex.

    ``own`` instead of values is what each vertex counts by itself.  A layer is read once, since what
    it gives is known when the layers below it are.
    """
    def add(vertices: DataFrame, come: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        if come is None:
            return vertices.withColumns({c: F.lit(own).cast("long") for c in columns}), None
        met = materialize(vertices.withColumn("_here", F.lit(True)).join(come, NODE, "full")
                          .withColumn("_here", F.col("_here").isNotNull()), "raked", ("_here",))
        if own is not None:
            met = met.withColumns({c: F.coalesce(F.col(c), F.lit(0)) + F.lit(own) for c in columns})
            return met.where("_here").select(*vertices.columns, *columns), met.where("not _here").select(
                *NODE, *[(F.col(c) - F.lit(own)).alias(c) for c in columns])
        return tuple(met.where(hit).select(*kept, *columns) for hit, kept in (("_here", vertices.columns), ("not _here", NODE)))

    out, come = [], values
    for layer in ways.layers:
        here, rest = add(layer, come)
        given = here.where("up is not null").groupBy(*KEY, F.col("up").alias("node_id")).agg(*[F.sum(c).alias(c) for c in columns])
        if rest is not None:
            given = rest.unionByName(given).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in columns])
        out.append(here)
        come = materialize(given, "raked")
    if ways.core is not None and not ways.core.isEmpty():
        here, come = add(ways.core, come)
        filled = here.select(*NODE, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])
        sums = subtree_sums(Climb(ways.other, ways.steps), filled, columns)
        out.append(ways.core.join(sums, NODE, "left"))
    return out, come


def subtree_sizes(ways: Climb) -> DataFrame:
    """``n_desc``: vertices at or below every vertex of the forests, itself included."""
    parts, _ = raked_sums(ways, None, ["n_desc"], 1)
    if not parts:
        return ways.core.select(*NODE, F.lit(1).cast("long").alias("n_desc"))
    return reduce(DataFrame.unionByName, [p.select(*NODE, F.coalesce("n_desc", F.lit(1)).cast("long").alias("n_desc")) for p in parts])


def reentrant_graphs(edges: DataFrame) -> DataFrame:
    """Graphs (``KEY``) that are no forests."""
    return climb(edges).other


def steps_up(parents: DataFrame, keep: bool = False, written: bool = False) -> Iterator[DataFrame]:
    """``node_id, up``: the ancestor 1, 2, 4, ... steps above, as long as there is one.

    ``parents`` has one row per vertex with a parent (``written``: it is a written table already).
    On a circle there always is an ancestor; the rounds end when the steps are longer than the largest graph has
    vertices.  ``keep`` leaves all tables in place and also gives the last one: empty, or what is
    on a circle or below one.
    """
    step = parents.select(*NODE, "up")
    if not written:
        step = materialize(step, "steps")
    most = step.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= most and not step.isEmpty():
        yield step
        above = step.select(*KEY, F.col("node_id").alias("up"), F.col("up").alias("_up"))
        old, step = step, materialize(step.join(above, [*KEY, "up"]).select(*NODE, F.col("_up").alias("up")), "steps")
        if not keep:
            discard(old)
        reach *= 2
    if keep:
        yield step


def _steps(parents: "DataFrame | Climb") -> "Iterator[DataFrame]":
    return iter(parents.steps) if isinstance(parents, Climb) else steps_up(parents)


def forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node_id, up``: one parent per vertex, without circles, and the links left over
    (``parent_id, child_id``).

    The smallest parent is taken; where that leads round in a circle, the circle's smallest
    vertex loses it.
    """
    links = materialize(edges.select(*KEY, "parent_id", "child_id").distinct(), "links")
    chosen = links.where("parent_id <> child_id").groupBy(*KEY, F.col("child_id").alias("node_id")).agg(
        F.min("parent_id").alias("up"))
    # the smallest vertex met on the way up
    seen = materialize(chosen.select(*NODE, "up", F.least("node_id", "up").alias("low")), "forest")
    parents, step = seen.select(*NODE, "up"), seen.select(*NODE, "up")
    most = seen.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= most and not step.isEmpty():
        above = seen.select(*KEY, F.col("node_id").alias("up"), F.col("low").alias("_low"))
        met = step.join(above, [*KEY, "up"]).select(*NODE, F.col("_low"))
        seen = materialize(seen.join(met, NODE, "left").select(
            *NODE, "up", F.least("low", F.coalesce("_low", "low")).alias("low")), "forest")
        further = step.select(*KEY, F.col("node_id").alias("up"), F.col("up").alias("_up"))
        step = materialize(step.join(further, [*KEY, "up"]).select(*NODE, F.col("_up").alias("up")), "steps")
        reach *= 2
    # an ancestor more steps above than there are vertices is on a circle
    circle = step.select(*KEY, F.col("up").alias("node_id")).distinct()
    cut = seen.where("low = node_id").select(*NODE).join(circle, NODE, "left_semi")
    parents = materialize(parents.join(cut, NODE, "left_anti"), "forest")
    extra = links.join(parents.select(*KEY, F.col("up").alias("parent_id"), F.col("node_id").alias("child_id")),
                       [*KEY, "parent_id", "child_id"], "left_anti")
    return parents, extra


def subtree_sums(parents: DataFrame | Climb, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``values`` (one row per vertex) with every column summed over the vertex and all below it."""
    total = materialize(values.select(*NODE, *columns), "subtree")
    for step in _steps(parents):
        below = step.join(total, NODE).groupBy(*KEY, F.col("up").alias("node_id")).agg(
            *[F.sum(c).alias(f"_{c}") for c in columns])
        old, total = total, materialize(total.join(below, NODE, "left").select(
            *NODE, *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns]), "subtree")
        discard(old)
    return total


def path_sums(parents: DataFrame | Climb, values: DataFrame, *columns: str) -> DataFrame:
    """``values`` with the columns summed over the vertex and all above it."""
    total = materialize(values.select(*NODE, *columns), "path")
    for step in _steps(parents):
        above = total.select(*KEY, F.col("node_id").alias("up"), *[F.col(c).alias(f"_{c}") for c in columns])
        more = step.join(above, [*KEY, "up"]).select(*NODE, *[f"_{c}" for c in columns])
        old, total = total, materialize(total.join(more, NODE, "left").select(
            *NODE, *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns]), "path")
        discard(old)
    return total


def at_or_below(parents: DataFrame | Climb, marked: DataFrame) -> DataFrame:
    """Marked vertices and all below one of them."""
    hit = materialize(marked.select(*NODE).distinct(), "below")
    for step in _steps(parents):
        more = step.join(hit.withColumnRenamed("node_id", "up"), [*KEY, "up"], "left_semi").select(*NODE)
        old, hit = hit, materialize(hit.unionByName(more).distinct(), "below")
        discard(old)
    layers = parents.layers if isinstance(parents, Climb) else ()
    if not layers:
        return hit
    # from the top down, each layer once; vertices of the lowest one have nothing below them
    above = reduce(DataFrame.unionByName, [t.select(*NODE) for t in (*layers[1:], parents.core)])
    found = [materialize(hit.join(above, NODE, "left_semi"), "below")]
    for layer in reversed(layers):
        up = reduce(DataFrame.unionByName, found).withColumnRenamed("node_id", "up")
        found.append(materialize(layer.join(up, [*KEY, "up"], "left_semi").select(*NODE), "below"))
    return reduce(DataFrame.unionByName, found[1:], hit).distinct()


def tree_index(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``node_id, up, depth, first, last``: places in depth-first order, children by id.

    A vertex's subtree are the vertices whose ``first`` lies between its own ``first`` and
    ``last``; it has ``last - first + 1`` of them.  Roots of one graph follow each other by id.
    """
    all_ = nodes.select(*NODE).distinct().withColumn("size", F.lit(1).cast("long"))
    ways = Climb(parents.select(*KEY).limit(0), tuple(steps_up(parents, keep=True))[:-1])
    sizes = subtree_sums(ways, all_, ["size"])
    placed = materialize(sizes.join(parents.select(*NODE, "up"), NODE, "left"), "tree-index")
    group = [*KEY, "up"]
    # what the siblings before a vertex take, as running sums that no task holds whole
    order = dense_ids(placed.select(*NODE, F.coalesce(F.col("up").cast("string"), F.lit("")).alias("up"), "size",
                                     F.col("up").isNull().alias("_top")),
                      group, ["node_id"], "_n")
    before = _before(order, group)
    offset = before.select(*NODE, (F.col("_before") + F.when(F.col("up") == "", 0).otherwise(1)).alias("first"),
                           F.when(F.col("_top"), 0).otherwise(1).cast("long").alias("depth"))
    if placed.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        both = path_sums(ways, offset, "first", "depth")
    else:  # every row of a vertex meets every other
        both = path_sums(ways, offset, "first").join(path_sums(ways, offset, "depth"), NODE)
    return placed.join(both, NODE).select(*NODE, "up", "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def _before(ordered: DataFrame, group: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """``_before``: the sizes of the rows before each row of its group, by ``_n``.  Sums of
    blocks of rows are added up first, so a window holds one block or one row per block."""
    from pyspark.sql import Window

    rows = materialize(ordered.withColumn("_b", F.floor(F.col("_n") / block)), "siblings")
    upto = Window.unboundedPreceding, -1
    blocks = rows.groupBy(*group, "_b").agg(F.sum("size").alias("_s")).select(*group, "_b", F.coalesce(F.sum("_s").over(
        Window.partitionBy(*group).orderBy("_b").rowsBetween(*upto)), F.lit(0)).alias("_start"))
    inside = F.sum("size").over(Window.partitionBy(*group, "_b").orderBy("_n").rowsBetween(*upto))
    return rows.withColumn("_in", F.coalesce(inside, F.lit(0))).join(blocks, [*group, "_b"]).withColumn(
        "_before", F.col("_in") + F.col("_start"))
