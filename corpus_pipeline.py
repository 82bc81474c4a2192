"""From all documents to shards of training data: five stages, each over all that the one
before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.lineage import materialize
from weftgraph.llm import decontamination, language, mixing, near_join, sharding
from weftgraph.llm.common import table


#: Bytes of an Arrow batch: all stages share the Python workers of an executor, whose batches
#: of whole texts add up.
BATCH_BYTES = "8m"


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go: null, empty and letterless texts among
    them.  Profiles and threshold are learned from all labelled training documents.  Repeated rows
    stay or go together."""
    _bounded(spark)
    profiles = language.fit_profiles(docs, fit_docs=None)
    return language.keep_identified(docs, profiles, language.least_score(docs, profiles))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five words the one with the smallest
    id stays (null ids last); of repeated rows one; texts without words all stay."""
    _bounded(spark)
    return near_join.one_per_group(docs, width=5, num=80, den=100)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none."""
    _bounded(spark)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's word target takes it, 0 to 2 times; a null source
    is a source, documents without words are taken never or whole like others of their size."""
    return mixing.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document that the mix has, once per time it is taken.

    As in all stages, other columns may have any names and an empty table gives an empty result.
    """
    return sharding.shard(docs)


STAGES = [("language", identify_language), ("near copies", join_near_copies), ("benchmark", remove_benchmark),
          ("mix", mix), ("shards", cut_shards)]

#: Trained profiles, exact joins over shingles and a fitted mix have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
