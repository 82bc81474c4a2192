"""Incremental alignment: only documents that the store does not hold are computed.

``align_incremental`` asks by document id.  ``ContentStore`` asks by id and content: a document
whose content has changed is computed again, and one that has left the corpus leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftgraph.lineage import materialize


def missing_documents(docs: DataFrame, store: DataFrame) -> DataFrame:
    """Documents without a stored result."""
    return docs.join(store.select("doc_id").distinct(), "doc_id", "left_anti")


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stored results; an empty table where nothing was stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def align_incremental(docs: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame],
                      schema: StructType, refresh: bool = False) -> DataFrame:
    """Results of all documents; ``compute`` runs on the missing ones only.

    ``refresh`` computes the whole corpus again.  Returns the stored results of the
    given documents.
    """
    spark = docs.sparkSession
    if refresh:
        compute(docs).write.mode("overwrite").parquet(path)
    else:
        todo = missing_documents(docs, read_store(spark, path, schema))
        if not todo.isEmpty():
            compute(todo).write.mode("append").parquet(path)
    stored = read_store(spark, path, schema)
    return stored.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def align_arrivals(docs: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame],
                   schema: StructType, checkpoint: str) -> StreamingQuery:
    """Same for a folder that documents keep arriving in: each run takes what is new.

    ``docs`` is a streaming DataFrame.  A batch that is run again after a failure
    finds its documents in the store and adds nothing twice.
    """
    def batch(rows: DataFrame, _: int) -> None:
        align_incremental(rows, path, compute, schema)

    return (docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class ContentStore:
    """Results by document id and content digest, in versions.

    A version holds the results of the documents that were new or changed, and one key row per such
    document and per document that left.  It counts from the moment its commit file exists, which
    is created last, so a run that fails midway leaves nothing that is read; its files are
    ignored, and the next run takes the next number.  Running the same corpus again computes and adds
    nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self, folder: str) -> list[int]:
        fs, where = self._fs(folder)
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Numbers of the committed versions."""
        return self._numbers("commits")

    def _union(self, kind: str, schema: StructType) -> DataFrame:
        out = self.spark.createDataFrame([], schema).withColumn("version", F.lit(0))
        for v in self.versions():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{v}").withColumn("version", F.lit(v)))
        return out

    def keys(self) -> DataFrame:
        """``doc_id, digest, version`` of the documents that are there now."""
        kind = self.schema["doc_id"].dataType
        schema = StructType().add("doc_id", kind).add("digest", "string")
        last = self._union("keys", schema).groupBy("doc_id").agg(F.max_by(F.struct("digest", "version"), "version").alias("k"))
        return last.select("doc_id", "k.*").where("digest is not null")

    def read(self) -> DataFrame:
        """Results of the documents that are there now, with the version that they are of."""
        now = self.keys().select("doc_id", "version")
        return self._union("results", self.schema).join(now, ["doc_id", "version"], "left_semi")

    def upsert(self, docs: DataFrame, compute: Callable[[DataFrame], DataFrame], content: Column | None = None,
               whole: bool = True) -> int | None:
        """Bring the store to the given documents; the number of the new version, if there is one.

        ``docs`` has one row per ``doc_id``; ``content`` is what a result depends on, by default all other
        columns.  With ``whole`` the documents are the corpus and others leave; without, they are
        added to it.
        """
        if content is None:
            content = F.to_json(F.struct(*sorted(c for c in docs.columns if c != "doc_id")), {"ignoreNullFields": "false"})
        fresh = docs.withColumn("_digest", F.sha2(F.coalesce(content, F.lit("")), 256))
        old = self.keys().select("doc_id", F.col("digest").alias("_old"))
        changed = materialize(fresh.join(old, "doc_id", "left").where("_old is null or _old <> _digest").drop("_old"), "changed")
        keys = changed.select("doc_id", F.col("_digest").alias("digest"))
        if whole:
            gone = old.join(docs.select("doc_id"), "doc_id", "left_anti")
            keys = keys.unionByName(gone.select("doc_id", F.lit(None).cast("string").alias("digest")))
        keys = materialize(keys, "keys")
        if keys.isEmpty():
            return None
        # a number that a failed run has taken is not used again
        number = max([0, *self._numbers("commits"), *self._numbers("keys"), *self._numbers("results")]) + 1
        results = compute(changed.drop("_digest")).select(*self.schema.names)
        results.write.parquet(f"{self.path}/results/{number}")
        keys.write.parquet(f"{self.path}/keys/{number}")
        fs, where = self._fs(f"commits/{number}")
        fs.create(where, False).close()
        return number


def upsert_arrivals(docs: DataFrame, store: ContentStore, compute: Callable[[DataFrame], DataFrame],
                    checkpoint: str) -> StreamingQuery:
    """Documents that keep arriving: each run adds what is new or changed.  A batch that is run
    again finds its digests in the store and adds nothing."""
    def batch(rows: DataFrame, _: int) -> None:
        store.upsert(rows, compute, whole=False)

    return (docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
