"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word target.  What one full pass over a source does not cover is
fitted as a bounded knapsack: the documents are counted by exact length, a proportional
share of each length is taken, and dynamic programming over the lengths that are left
fills the rest of the budget.  Which documents of a length are taken follows a seeded
hash.  Only numbers of documents by source and length enter the fit, so its size depends
on the number of different lengths, not on the number of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.llm.common import free_name, unit_hash, words_of
from weftgraph.operators.graph import dense_ids
from weftgraph.skew import join_split

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 20_240_607
#: Words of budget that the table of reachable sums covers; more is filled greedily first.
WINDOW = 1 << 16
#: Bytes of a plan that is sent to the executors; a larger one is joined by a shuffle of the rows.
PLAN_BYTES = 1 << 23
#: Bytes of a line of the plan besides the source's name.
PLAN_ROW = 128
#: Documents of one source and length that are ranked together.
RANKED = 512


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``source, source_size, target``: shares of ``share`` times all sizes by weight.

    Weights repeat over the sources in code point order, null last.  A target above
    ``most`` times its source's size stops there and the excess is shared anew by weight
    until no target is above.  Every round is one aggregation of the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_ids(per.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", choice.alias("_w"),
                                       (F.lit(float(most)) * F.col("source_size")).alias("_cap")), "mix-sources")
    budget = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        kept, open_weight = ranked.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        new = (budget - float(kept or 0.0)) / open_weight if open_weight else level
        if not open_weight or new <= level:
            break
        level = new
    return ranked.select("source", "source_size",
                         F.least("_cap", F.lit(level) * F.col("_w")).alias("target"))


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int,
               window: int = WINDOW) -> list[int]:
    """How many documents of each length to take so that their words come as near to
    ``budget`` from below as the bounded knapsack allows.

    A proportional share of each length is taken first, then the longest that fit, until
    less than ``window`` words are open; those are filled exactly where a sum of the
    remaining lengths reaches them (a bit per reachable sum, counts split into powers of
    two).  Lengths of 0 take nothing.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    take = [c * budget // total if n > 0 else 0 for n, c in zip(lengths, counts)]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: -lengths[i])
    for i in order:
        if left < window:
            break
        more = min(counts[i] - take[i], (left - window) // lengths[i] + 1, left // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    items: list[tuple[int, int]] = []
    for i in order:
        free, piece = min(counts[i] - take[i], left // lengths[i]), 1
        while free > 0:
            piece = min(piece, free)
            items.append((i, piece))
            free -= piece
            piece *= 2
    full, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i, piece in items:
        if reach >> left & 1:
            break
        steps.append((i, piece, reach))
        reach |= (reach << piece * lengths[i]) & full
    best = reach.bit_length() - 1
    for i, piece, before in reversed(steps):
        if not before >> best & 1:
            take[i] += piece
            best -= piece * lengths[i]
    return take


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    lengths, counts = group["size"].tolist(), group["_n"].tolist()
    target, size = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
    base = int(target // size) if size else 0
    return group.assign(_base=base, _k=fit_counts(lengths, counts, int(target - base * size)))


def mix_plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
             most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """Targets, and per source and length how documents are taken.

    ``sizes`` has ``source, size, _key``.  The plan has ``source, size, _base, _last, _some``:
    each document is taken ``_base`` times and once more if its key is below ``_last``, and of
    the rows whose key is ``_last`` the first ``_some`` are; null: all of them.
    """
    goal = targets(sizes, weights, share, most)
    goal = materialize(goal, "mix-targets")
    lengths = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n"))
    # a null source is a source: it is compared as one
    same = [F.col("l.source").eqNullSafe(F.col("g.source"))]
    fitted = (lengths.alias("l").join(goal.alias("g"), same).select("l.*", "g.source_size", "g.target")
              .groupBy("source").applyInPandas(
                  _fit, "source string, size long, _n long, source_size long, target double, _base int, _k long"))
    fitted = materialize(fitted.withColumn("_src", _source_key(F.col("source"))), "mix-lengths")
    part = fitted.where("_k > 0 and _k < _n").select(
        "_src", "size", "_k", F.ceil(F.col("_n") / RANKED).cast("long").alias("_nb"))
    # rows equal in every column have one key: they are counted, not ranked
    keys = sizes.groupBy(_source_key(F.col("source")).alias("_src"), "size", "_key").agg(F.count(F.lit(1)).alias("_c"))
    rows = materialize(join_split(keys, part, ["_src", "size"], ["_key"]).withColumn("_bucket", F.least(
        F.floor(F.col("_key") / F.lit(2.0 ** 63) * F.col("_nb")), F.col("_nb") - 1)), "mix-keys")
    upto = Window.partitionBy("_src", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (rows.groupBy("_src", "size", "_bucket").agg(F.sum("_c").alias("_c"), F.max("_k").alias("_k"))
            .withColumn("_cum", F.sum("_c").over(upto)).where("_cum >= _k and _cum - _c < _k")
            .select("_src", "size", "_bucket", (F.col("_k") - F.col("_cum") + F.col("_c")).alias("_in")))
    inside = rows.join(edge, ["_src", "size", "_bucket"])
    so_far = Window.partitionBy("_src", "size").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    last = (inside.withColumn("_cum", F.sum("_c").over(so_far)).where("_cum >= _in and _cum - _c < _in")
            .select("_src", "size", F.col("_key").alias("_last"),
                    F.when(F.col("_cum") > F.col("_in"), F.col("_in") - F.col("_cum") + F.col("_c")).alias("_some")))
    plan = fitted.join(last, ["_src", "size"], "left").select(
        "_src", "size", "_base", F.when(F.col("_k") == 0, F.lit(-1)).when(
            F.col("_k") >= F.col("_n"), F.lit(2 ** 63 - 1)).otherwise(F.col("_last")).alias("_last"), "_some")
    return goal, materialize(plan, "mix-plan")


def _source_key(c: Column) -> Column:
    """A source as a key that joins null with null and with nothing else."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))


def _measured(docs: DataFrame, size: str, key: str, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.withColumn(size, words_of(F.col(text_col))).withColumn(
        key, unit_hash(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)))


def _with_copies(rows: DataFrame, slim: DataFrame, names: Sequence[str], source_col: str, weights: Sequence[float],
                 share: float, most: float) -> DataFrame:
    """``rows`` with their source's size and target and the times that each is taken.

    ``names`` are those of the size and the key in ``rows`` and of the new columns.
    """
    size, key, goal_size, goal, copies = names
    src, base, last, some, place = free_name(rows, "_src", "_base", "_last", "_some", "_place")
    sources, plan = mix_plan(slim, weights, share, most)
    by_length = plan.join(sources.select(_source_key(F.col("source")).alias("_src"), "source_size", "target"), "_src")
    by_length = by_length.select(*[F.col(a).alias(b) for a, b in zip(
        ("_src", "size", "_base", "_last", "_some", "source_size", "target"), (src, size, base, last, some, goal_size, goal))])
    rows = rows.withColumn(src, _source_key(F.col(source_col).cast("string")))
    n, letters = plan.agg(F.count(F.lit(1)), F.sum(F.octet_length("_src"))).first()
    if PLAN_ROW * n + (letters or 0) <= PLAN_BYTES:
        # the rows stay where they are, with their texts
        out = rows.join(F.broadcast(by_length), [src, size])
    else:
        out = join_split(rows, by_length, [src, size], [key])
    # of equal rows at the cut as many are taken as the budget has room for
    cut = (F.col(key) == F.col(last)) & F.col(some).isNotNull()
    whole = out.where(~cut).withColumn(copies, F.col(base) + (F.col(key) <= F.col(last)).cast("int"))
    if plan.where("_some is not null").isEmpty():
        return whole.drop(src, base, last, some)
    split = out.where(cut).withColumn(place, F.monotonically_increasing_id())
    split = dense_ids(split, [src, size, key], [place], copies)
    split = split.withColumn(copies, F.col(base) + (F.col(copies) < F.col(some)).cast("int")).drop(place)
    return whole.unionByName(split).drop(src, base, last, some)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` and, last, ``size`` (words), ``source_size``, ``target`` and ``copies``
    (0 to 2) under names that no column has.

    A null text has size 0, a null source is a source of its own after all others, a null
    id is a value like others.  Repeated rows are documents of their own: where the budget has
    room for some of them, some are taken.  With no words at all every target is 0 and no
    document is taken; an empty table gives an empty result.  ``most`` is a whole number.
    """
    size, key, goal_size, goal, copies = free_name(docs, "size", "_key", "source_size", "target", "copies")
    rows = _measured(docs, size, key, seed, id_col, text_col, source_col)
    slim = materialize(rows.select(F.col(source_col).cast("string").alias("source"), F.col(size).alias("size"),
                                   F.col(key).alias("_key")), "mix-sizes")
    out = _with_copies(rows, slim, (size, key, goal_size, goal, copies), source_col, weights, share, most)
    return out.select(*docs.columns, size, goal_size, goal, copies)


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document; odd rows as in ``mix``.

    The texts are read once, for their sizes and keys.
    """
    rows = _measured(docs.select("doc_id", "source", "text"), "size", "_key", SEED, "doc_id", "text", "source")
    slim = materialize(rows.select("doc_id", F.col("source").cast("string").alias("source"), "size", "_key"), "mix-sizes")
    out = _with_copies(slim, slim.drop("doc_id"), ("size", "_key", "source_size", "target", "copies"), "source", WEIGHTS, SHARE, MOST)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, columns as given; odd rows as
    in ``mix``."""
    out = mix(docs)
    copies = out.columns[-1]
    names = docs.columns
    return (out.where(F.col(copies) > 0)
            .select(*names, F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(copies)).select(*names))
