"""Block-text graph corpora: reading, writing and merging."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.schemas import PARSED_BLOCK

# The text format of graph blocks.
META_PATTERN = r"::([^\s:]+)[ \t]*(.*?)(?=[ \t]+::|$)"
_LEXEME = re.compile(r'"(?:[^"\\]|\\.)*"(?:~[^\s()]+)?|[()]|/(?=\s)|[^\s()]+')
_ALIGNED = re.compile(r"^(.*?)~(?:[A-Za-z]\.?)?(\d+(?:,\d+)*)$", re.DOTALL)


def _cut_alignment(text: str) -> tuple[str, list[int] | None]:
    m = _ALIGNED.match(text)
    return (m[1], [int(i) for i in m[2].split(",")]) if m else (text, None)


def parse_graph(text: str) -> tuple[str, list[dict]]:
    """Top variable and triples of one parenthesised graph, in text order."""
    triples: list[dict] = []
    stack: list[str] = []
    role, role_ix, top = None, None, None
    lexemes = _LEXEME.findall(text)
    i = 0

    def add(source: str, name: str, target: str, token_ix, role_token_ix=None) -> None:
        triples.append({"source": source, "role": name, "target": target,
                        "token_ix": token_ix, "role_token_ix": role_token_ix})

    while i < len(lexemes):
        lex = lexemes[i]
        if lex == "(":
            if i + 3 >= len(lexemes) or lexemes[i + 2] != "/":
                raise ValueError("a node needs a variable and a concept")
            variable = lexemes[i + 1]
            concept, token_ix = _cut_alignment(lexemes[i + 3])
            if stack:
                if role is None:
                    raise ValueError(f"node {variable} has no role")
                add(stack[-1], role, variable, None, role_ix)
            elif top is not None:
                raise ValueError("more than one graph in a block")
            else:
                top = variable
            add(variable, ":instance", concept, token_ix)
            stack.append(variable)
            role, i = None, i + 4
            continue
        if not stack:
            raise ValueError("text outside of the graph")
        if role is not None and (lex == ")" or lex.startswith(":")):
            raise ValueError(f"role without a target: {role}")
        if lex == ")":
            stack.pop()
        elif lex.startswith(":"):
            role, role_ix = _cut_alignment(lex)
        elif role is not None:
            target, token_ix = _cut_alignment(lex)
            add(stack[-1], role, target, token_ix, role_ix)
            role = None
        else:
            raise ValueError(f"unexpected text: {lex}")
        i += 1
    if stack or top is None:
        raise ValueError("unbalanced parentheses")
    return top, triples


#: Characters of graph text that are parsed before their rows leave the task.
PARSE_CHARS = 1 << 18


def _slices(batch: pd.DataFrame, sizes: pd.Series, limit: int) -> Iterator[pd.DataFrame]:
    """Consecutive rows of about ``limit`` characters, one row at least."""
    part = (sizes.cumsum() - sizes) // limit
    for _, rows in batch.groupby(part.to_numpy(), sort=False):
        yield rows


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # triples are many times as large as their text, so a batch is parsed in slices
        for rows in _slices(batch, batch["graph"].str.len(), PARSE_CHARS):
            tops, triples, failures = [], [], []
            for graph in rows["graph"]:
                try:
                    top, found = parse_graph(graph)
                    failure = None
                except ValueError as e:
                    top, found, failure = None, None, str(e)
                tops.append(top)
                triples.append(found)
                failures.append(failure)
            yield rows.drop(columns="graph").assign(top=tops, triples=triples, failure=failures)


HEAD, WHOLE, TAIL, THROUGH = range(4)


def _cut_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each byte range of a file: those that lie inside it, and the pieces before its
    first and after its last blank line, whose other parts are in other ranges."""
    here, lines, seen, out = None, [], False, []

    def close(kind):
        if kind != WHOLE or lines:
            out.append((*here, kind, "\n".join(lines)))
        lines.clear()

    for batch in batches:
        for file, start, value in batch[["file", "start", "value"]].itertuples(index=False):
            if (file, start) != here:
                if here is not None:
                    close(TAIL if seen else THROUGH)
                here, seen = (file, start), False
            if value.strip(" \t\r"):
                lines.append(value)
            else:
                close(WHOLE if seen else HEAD)
                seen = True
        yield pd.DataFrame(out, columns=["file", "start", "kind", "text"])
        out.clear()
    if here is not None:
        close(TAIL if seen else THROUGH)
        yield pd.DataFrame(out, columns=["file", "start", "kind", "text"])


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``value``: blocks of lines between lines that are empty or hold only blanks.

    Files are read in byte ranges, whatever their line ends are.  Blocks inside a range never
    leave their task; only what its ends cut off, two pieces per range at most, is put together
    by file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    pieces = lines.mapInPandas(_cut_blocks, "file string, start long, kind int, text string")
    pieces = materialize(pieces, "block-pieces", ("kind",)).withColumn("kind", F.col("kind").cast("int"))
    # a block that is cut begins with a tail and ends with the next head
    upto = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    cut = pieces.where(F.col("kind") != WHOLE).withColumn("_n", F.sum((F.col("kind") == TAIL).cast("int")).over(upto))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))), lambda p: p["text"])
    joined = cut.groupBy("file", "_n").agg(F.array_join(F.filter(parts, lambda t: t != ""), "\n").alias("value"))
    return pieces.where(F.col("kind") == WHOLE).select(F.col("text").alias("value")).unionByName(
        joined.where("value <> ''").select("value"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a corpus as ``metadata`` map and ``graph`` text (``text_blocks``).  A block
    without a graph (a header comment) is left out.
    """
    lines = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    parts = text_blocks(spark, path).select(
        F.array_join(F.filter(lines, lambda s: s.startswith("#")), "\n").alias("head"),
        F.trim(F.array_join(F.filter(lines, lambda s: ~s.startswith("#")), "\n")).alias("graph"))
    return split_metadata(parts.where(F.col("graph") != ""))


def split_metadata(parts: DataFrame) -> DataFrame:
    """``# ::key value ::key value`` lines into a map; the sentence text may hold anything."""
    lines = F.transform(F.split("head", "\n"), lambda s: F.regexp_replace(s, r"^#[ \t]*", ""))
    whole = F.filter(lines, lambda s: s.rlike(r"^::(snt|tok)(-\w+)?[ \t]") & ~s.rlike(r"^::snt-type"))
    keyed = F.filter(lines, lambda s: s.rlike(r"^::") & ~s.rlike(r"^::(snt|tok)(-\w+)?[ \t]")
                     | s.rlike(r"^::snt-type"))
    text_entries = F.transform(whole, lambda s: F.struct(
        F.regexp_extract(s, r"^::(\S+)", 1).alias("key"),
        F.trim(F.regexp_extract(s, r"^::\S+[ \t]+(.*)$", 1)).alias("value")))
    joined = F.flatten(F.transform(keyed, lambda s: F.transform(
        F.regexp_extract_all(s, F.lit(META_PATTERN), F.lit(0)), lambda p: F.struct(
            F.regexp_extract(p, r"^::(\S+)", 1).alias("key"),
            F.trim(F.regexp_replace(p, r"^::\S+", "")).alias("value")))))
    # the last value of a repeated key counts
    entries = F.concat(text_entries, joined)
    unique = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return parts.select(F.map_from_entries(unique).alias("metadata"), "graph")


def read_graph_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of a block-text corpus with their triples.

    A block that cannot be parsed keeps its row and says why in ``failure``.
    """
    blocks = read_blocks(spark, path).select(
        F.col("metadata")["id"].alias("sent_id"), "metadata",
        F.col("metadata")["snt"].alias("text"), "graph")
    return blocks.mapInPandas(_parse_batches, PARSED_BLOCK)


def block_text(docs: DataFrame) -> DataFrame:
    """Block text of ``(sent_id, metadata, text, graph)`` rows."""
    extra = F.map_filter("metadata", lambda k, v: ~k.isin("id", "snt"))
    pairs = F.transform(F.array_sort(F.map_entries(extra)),
                        lambda e: F.concat(F.lit("# ::"), e["key"], F.lit(" "), e["value"]))
    lines = F.concat(
        F.array(F.concat(F.lit("# ::id "), F.col("sent_id")), F.concat(F.lit("# ::snt "), F.col("text"))),
        pairs, F.array("graph"))
    return docs.select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def write_graph_corpus(docs: DataFrame, path: str, stale: tuple[str, ...] = ()) -> bool:
    """Write the block-text corpus once; an existing target is left as it is.

    Where it is written anew, results that were computed from an older version
    (``stale``: their paths) are dropped.  Tells whether it was written.
    """
    spark = docs.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(name: str):
        where = jvm.org.apache.hadoop.fs.Path(name)
        return where.getFileSystem(conf), where

    fs, target = at(path)
    if fs.exists(target):
        return False
    for name in stale:
        old_fs, old = at(name)
        old_fs.delete(old, True)
    block_text(docs).write.mode("ignore").text(path)
    return True


def merge_annotations(amrs: DataFrame, aligns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aligned sentences with the type and original text of the other version.

    Both have ``sent_id, metadata, triples``.  The aligned version's tokenised text
    becomes the sentence text.  Rows without a partner or with another number of
    triples are returned as failures.
    """
    left = amrs.select("sent_id", F.col("metadata").alias("_m"), F.size("triples").alias("_n"))
    joined = aligns.join(left, "sent_id", "left")
    bad = F.when(F.col("_m").isNull(), F.lit("no sentence with this id")).when(
        F.size("triples") != F.col("_n"), F.lit("different number of triples"))
    text = F.replace(F.col("metadata")["tok"], F.lit("@-@"), F.lit("-"))
    replaced = F.map_from_entries(F.array(
        F.struct(F.lit("snt-type").alias("key"), F.col("_m")["snt-type"].alias("value")),
        F.struct(F.lit("snt-org").alias("key"), F.col("_m")["snt"].alias("value")),
        F.struct(F.lit("snt").alias("key"), text.alias("value"))))
    rest = F.map_filter("metadata", lambda k, v: ~k.isin("snt-type", "snt-org", "snt"))
    checked = joined.withColumn("_bad", bad)
    good = (checked.where("_bad is null").withColumn("text", text)
            .withColumn("metadata", F.map_concat(rest, replaced)).select(*aligns.columns))
    failures = checked.where("_bad is not null").select(
        F.col("sent_id").alias("doc_id"), F.lit("merge").alias("stage"), F.col("_bad").alias("message"))
    return good, failures
