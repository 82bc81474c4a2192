"""Document corpora: reading, splitting, selecting and checking documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import text as X
from weftgraph.lineage import materialize
from weftgraph.schemas import DOCS

# Sentence types and their codes (a summary, b body, o other).
AD_HOC_TYPES = {"summary": "a", "body": "b"}
PROXY_TYPES = {"summary": "a", "body": "b", "body subordinate": "b",
               "date": "o", "country": "o", "topic": "o"}


def read_pairs(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents of a JSON corpus (``doc_id, comment, body, summary``) and failures.

    JSON lines are read in splits.  A JSON array (``multi_line``) is one record to its
    reader, so one file is one task; large corpora should be lines.  A row that is no
    document (cut off, of another type) is a failure that quotes its text.
    """
    schema = T.StructType([*DOCS.fields, T.StructField("_bad", T.StringType())])
    rows = materialize(spark.read.schema(schema).option("multiLine", multi_line)
                       .option("columnNameOfCorruptRecord", "_bad").json(path), "pairs")
    failures = rows.where("_bad is not null").select(
        F.coalesce("id", F.lit("?")).alias("doc_id"), F.lit("read").alias("stage"),
        F.concat(F.lit("malformed document: "), F.substring("_bad", 1, 200)).alias("message"))
    return rows.where("_bad is null").drop("_bad").withColumnRenamed("id", "doc_id"), failures


def read_pairs_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The documents of ``read_pairs``."""
    return read_pairs(spark, path, multi_line)[0]


Transform = Callable[[DataFrame], DataFrame]


def read_corpora(spark: SparkSession, paths: Mapping[str, str], multi_line: bool = True,
                 transforms: Mapping[str, Transform] | None = None) -> DataFrame:
    """Several corpora in one table, kept apart by ``corpus``.

    ``transforms`` names a function of the documents for corpora that need one (other
    spellings, merged fields); it runs before the corpora are put together.
    """
    unknown = set(transforms or {}) - set(paths)
    if unknown:
        raise ValueError(f"transforms of unknown corpora: {sorted(unknown)}")
    out = None
    for name, path in paths.items():
        part = read_pairs_json(spark, path, multi_line)
        if transforms and name in transforms:
            part = transforms[name](part)
        part = part.withColumn("corpus", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no corpus given")
    return out


def pair_texts(docs: DataFrame) -> DataFrame:
    """Body and summary of pair documents as text rows of the two components."""
    part = F.explode(F.array(
        F.struct(F.lit("source").alias("component"), F.col("body").alias("text")),
        F.struct(F.lit("summary").alias("component"), F.col("summary").alias("text")))).alias("p")
    return docs.select("doc_id", part).select("doc_id", "p.*").withColumn("part_ix", F.lit(0)) \
        .where(F.col("text").isNotNull())


def map_sentence_type(df: DataFrame, mapping: Mapping[str, str] = PROXY_TYPES,
                      column: str = "snt_type") -> DataFrame:
    """Short code of the raw sentence type; null for an unknown type."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn("sent_type", table[F.col(column)])


def split_components(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences by component, and the documents that lack one.

    ``a`` sentences form the summary and ``b`` sentences the source; others are left
    out.  Sentence numbers are kept.
    """
    typed = sentences.withColumn("component", F.when(F.col("sent_type") == "a", F.lit("summary"))
                                 .when(F.col("sent_type") == "b", F.lit("source")))
    sides = typed.groupBy("doc_id").agg(
        F.count_if(F.col("component") == "summary").alias("n_summary"),
        F.count_if(F.col("component") == "source").alias("n_source"))
    failures = sides.where("n_summary = 0 or n_source = 0").select(
        "doc_id", F.lit("split").alias("stage"),
        F.when(F.col("n_summary") == 0, F.lit("document has no summary"))
        .otherwise(F.lit("document has no source")).alias("message"))
    from weftgraph.skew import join_salted
    kept = join_salted(typed.where("component is not null"), failures.select("doc_id"), ["doc_id"],
                       ["sent_ix"], "left_anti")
    return kept, failures


def drop_summary_sentences(sentences: DataFrame) -> DataFrame:
    """Body sentences whose text is also a summary sentence are removed."""
    summary = sentences.where("component = 'summary'").select("doc_id", "text").distinct()
    body = sentences.where("component = 'source'").join(summary, ["doc_id", "text"], "left_anti")
    return body.unionByName(sentences.where("component = 'summary'").select(*body.columns))


def corpus_keys(df: DataFrame) -> DataFrame:
    return df.select("doc_id").distinct()


def filter_keys(df: DataFrame, keys: str | None) -> tuple[DataFrame, DataFrame]:
    """Documents named in a comma or space separated list, and the unknown names."""
    spark = df.sparkSession
    if keys is None:
        return df, spark.createDataFrame([], "doc_id string, stage string, message string")
    wanted = (spark.range(1).select(F.explode(F.regexp_extract_all(
        F.lit(keys), F.lit(r"[^,\s]+"), F.lit(0))).alias("_key")).distinct())
    key = F.col("doc_id").cast("string")
    kept = df.withColumn("_key", key).join(wanted, "_key", "left_semi").drop("_key")
    known = df.select(key.alias("_key")).join(wanted, "_key", "left_semi").distinct()
    unknown = wanted.join(known, "_key", "left_anti").select(
        F.col("_key").alias("doc_id"), F.lit("filter").alias("stage"),
        F.lit("no document with this id").alias("message"))
    return kept, unknown


def corpus_summary(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Token count and text per document; the limit comes before the sort."""
    rows = docs if limit is None else docs.orderBy("doc_id").limit(limit)
    return rows.select("doc_id", F.size(X.tokenize(F.col("text"))).cast("long").alias("len"), "text") \
        .orderBy("len", "doc_id")


def capture_failures(df: DataFrame, message, stage: str) -> DataFrame:
    """Failure rows for documents with a failed row; ``message`` is null where fine."""
    return (df.withColumn("_message", message).where("_message is not null")
            .groupBy("doc_id").agg(F.min("_message").alias("message"))
            .select("doc_id", F.lit(stage).alias("stage"), "message"))


def drop_failed(df: DataFrame, failures: DataFrame, spread: list[str]) -> DataFrame:
    """Rows of documents that did not fail."""
    from weftgraph.skew import join_salted
    return join_salted(df, failures.select("doc_id").distinct(), ["doc_id"], spread, "left_anti")


def empty_documents(docs: DataFrame) -> DataFrame:
    """Failure rows for documents without any text."""
    blank = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("empty document"))
    return capture_failures(docs, blank, "read")


def corpus_fingerprint(df: DataFrame) -> DataFrame:
    """Hash of a corpus' content that does not depend on row order.

    Row hashes are added up in five 48-bit lanes with the row count, so partial sums
    are exchanged and never a list of hashes.
    """
    cols = sorted(df.columns)
    row = df.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
             for i in range(5)]
    total = row.agg(F.count(F.lit(1)).alias("n"), *lanes)
    joined = F.concat_ws("-", "n", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(5)])
    return total.select(F.sha2(joined, 256).alias("fingerprint"), F.col("n").alias("n_docs"))


def attach_embeddings(tokens: DataFrame, vectors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Token rows with their vectors, and failures for sentences that miss one.

    Without a vectors table (no provider) tokens keep a null vector and nothing
    fails.
    """
    keys = ["doc_id", "component", "sent_ix", "ix"]
    if vectors is None:
        out = tokens.withColumn("vec", F.lit(None).cast("array<double>"))
        return out, capture_failures(out, F.lit(None).cast("string"), "embed")
    out = tokens.join(vectors.select(*keys, "vec"), keys, "left")
    miss = F.when(F.col("vec").isNull(), F.lit("token without a vector"))
    return out, capture_failures(out, miss, "embed")
