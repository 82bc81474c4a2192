"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; a null text becomes the empty one."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def text_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def words_of(c: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """63 evenly spread bits of a row's columns, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Working column names that no column of the input has in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are written.

    Spark removes a shuffle's files when the driver collects the plan that made them as
    garbage, which may be long after the step; here it is asked to look now.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
