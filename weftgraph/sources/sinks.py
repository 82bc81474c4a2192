"""Writing annotated documents and alignment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("txt", "csv", "json")


def _check(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")


def _nested(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("array", "map", "struct")]


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that flat formats can hold them."""
    for c in _nested(df):
        df = df.withColumn(c, F.to_json(c))
    return df


def write_corpus(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Annotated documents as text, CSV or JSON."""
    _check(fmt)
    if fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "csv":
        flat_columns(df).write.mode(mode).csv(path, header=True, escape='"')
    else:
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_results(stats: DataFrame, path: str, fmt: str = "csv", docs: DataFrame | None = None,
                  flows: DataFrame | None = None, failures: DataFrame | None = None,
                  mode: str = "error") -> None:
    """Results by document and one combined table of all successful documents.

    ``csv`` writes the statistics rows; other formats also the documents and their flows.
    Files are grouped by a hash of the document and carry its id, because one
    directory per document does not scale to millions of them.  Failures become a
    table of their own.
    """
    _check(fmt)
    buckets = stats.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    if fmt == "csv":
        flat_columns(buckets).write.mode(mode).partitionBy("bucket").csv(f"{path}/by_document", header=True, escape='"')
    else:
        buckets.write.mode(mode).partitionBy("bucket").json(f"{path}/by_document")
        if docs is not None:
            docs.write.mode(mode).json(f"{path}/documents")
        if flows is not None:
            flows.write.mode(mode).json(f"{path}/alignments")
    first = ["doc_id", *[c for c in stats.columns if c != "doc_id"]]
    combined = stats.select(*first).withColumnRenamed("doc_id", "id")
    flat_columns(combined).write.mode(mode).csv(f"{path}/results", header=True, escape='"')
    if failures is not None:
        failures.write.mode(mode).json(f"{path}/failures")


# --- several outputs, one commit -------------------------------------------------

def _fs(spark: SparkSession, name: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, where = _fs(spark, folder)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []


def commit_results(stats: DataFrame, path: str, fmt: str = "json", docs: DataFrame | None = None,
                   flows: DataFrame | None = None, failures: DataFrame | None = None) -> int:
    """``write_results`` of all outputs as one: readers see all of a run or nothing of it.

    The outputs go to a folder of their own; the run counts from the moment its manifest exists,
    which is created last and never overwritten.  A run that fails midway leaves a folder that no
    reader looks at and the next commit deletes; a rerun replaces the run before as a whole.
    Returns the run's number.
    """
    spark = stats.sparkSession
    number = max([0, *_numbers(spark, f"{path}/manifests"), *_numbers(spark, f"{path}/runs")]) + 1
    write_results(stats, f"{path}/runs/{number}", fmt, docs, flows, failures)
    fs, manifest = _fs(spark, f"{path}/manifests/{number}")
    fs.create(manifest, False).close()
    for old in _numbers(spark, f"{path}/runs"):
        if old < number - 1:  # the run before stays for readers that have begun
            _fs(spark, f"{path}/runs/{old}")[0].delete(_fs(spark, f"{path}/runs/{old}")[1], True)
    return number


def committed_path(spark: SparkSession, path: str) -> str:
    """Folder of the last run that was committed."""
    numbers = _numbers(spark, f"{path}/manifests")
    if not numbers:
        raise FileNotFoundError(f"no results were committed to {path}")
    return f"{path}/runs/{numbers[-1]}"
