"""Joins of per-group tables that keep hot groups spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = 16
#: Rows of one key that a task takes; a key with more is split.
HOT_ROWS = 1 << 20


def free_names(tables: Sequence[DataFrame], *names: str) -> list[str]:
    """Working column names that no column of the tables has in any letter case."""
    taken, out = {c.lower() for t in tables for c in t.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_salted(big: DataFrame, small: DataFrame, keys: Sequence[str],
                spread: Sequence[str | Column], how: str = "inner",
                salt: int | None = None) -> DataFrame:
    """Join a per-key table to the many rows of each key.

    Without ``salt`` this is a plain join: cold keys are not copied, and a partition that
    a hot key makes large is split by adaptive execution, which may do so for every ``how``
    here.  With ``salt``, for keys known to be hot, the many-rows side is split by a hash of
    ``spread`` and the per-key side is repeated once per split.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    if salt is None:
        return big.join(small, list(keys), how)
    spread_cols = [F.col(c) if isinstance(c, str) else c for c in spread]
    name, = free_names((big, small), "_salt")
    left = big.withColumn(name, F.pmod(F.xxhash64(*spread_cols), F.lit(salt)))
    right = small.withColumn(
        name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    return left.join(right, [*keys, name], how).drop(name)


def with_totals(big: DataFrame, keys: Sequence[str], totals: Sequence[Column],
                spread: Sequence[str | Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Group totals added to every row of the group.

    Same result as a window over the whole group, but the totals are pre-aggregated before
    the shuffle and no task holds a whole group: the rows of each key are counted with the
    totals, and a key with more than ``hot_rows`` is split into that many parts.  Only hot
    keys are copied; their list is broadcast and has at most ``rows / hot_rows`` entries.
    """
    names = list(keys)
    salt, parts, split = free_names((big,), "_salt", "_parts", "_split")
    per = big.groupBy(*names).agg(*totals, F.ceil(F.count(F.lit(1)) / F.lit(hot_rows)).alias(parts))
    hot = per.where(F.col(parts) > 1).select(*names, F.col(parts).alias(split))
    spread_cols = [F.col(c) if isinstance(c, str) else c for c in spread]
    left = big.join(F.broadcast(hot), names, "left").withColumn(
        salt, F.coalesce(F.pmod(F.xxhash64(*spread_cols), F.col(split)), F.lit(0)).cast("long")).drop(split)
    right = per.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))).drop(parts)
    return left.join(right, [*names, salt]).drop(salt)


def join_split(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str | Column],
               how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``join_salted`` with as many splits as a key's rows ask for.

    The rows of each key of ``big`` are counted; a key with more than ``hot_rows`` is split into
    that many parts, its rows in ``small`` are copied once per part and nothing else is.  The list
    of hot keys is broadcast and has at most ``rows / hot_rows`` entries.
    """
    names = list(keys)
    salt, parts = free_names((big, small), "_salt", "_parts")
    per = big.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / F.lit(hot_rows)).cast("long").alias(parts))
    hot = F.broadcast(per.where(F.col(parts) > 1))
    spread_cols = [F.col(c) if isinstance(c, str) else c for c in spread]
    left = big.join(hot, names, "left").withColumn(
        salt, F.coalesce(F.pmod(F.xxhash64(*spread_cols), F.col(parts)), F.lit(0)).cast("long")).drop(parts)
    right = small.join(hot, names, "left").withColumn(
        salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return left.join(right, [*names, salt], how).drop(salt)
