"""Cutting lineage with written tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def lineage_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The folder named by ``spark.checkpoint.dir``; where that is unset, a folder of the
    warehouse, which all executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    return f"{base.rstrip('/')}/weftgraph-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table once and read it back, so later steps and lost executors
    start from the files and not from the beginning.  ``by`` are columns that later
    steps filter on; their values become folders."""
    spark = df.sparkSession
    path = f"{lineage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._weft_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``materialize`` gave and no later step reads."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
