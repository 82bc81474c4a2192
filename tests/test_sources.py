"""Block text in byte ranges, and results by content in versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import graph_text as T
from weftgraph.sources import sinks
from weftgraph.streaming.incremental import ContentStore, upsert_arrivals


def plain_blocks(text):
    blocks = [[]]
    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        if line.strip():
            blocks[-1].append(line)
        else:
            blocks.append([])
    return ["\n".join(b) for b in blocks if b]


@pytest.mark.parametrize("size", [16, 61, 1 << 20])
def test_blocks_over_the_ends_of_byte_ranges(spark, tmp_path, size):
    rng, texts = random.Random(size), []
    for i, end in enumerate(("\n", "\r\n", "\n")):
        lines = []
        for _ in range(120):
            lines += [f"line é {rng.randint(0, 999)}"] * rng.randint(1, 3) + rng.choice([[""], ["", ""], [" \t"], ["", " ", ""], []])
        lead, close = rng.choice(["", end, end * 3]), rng.choice(["", end, end * 2])
        texts.append(lead + end.join(lines) + close)
        (tmp_path / f"{i}.txt").write_bytes(texts[-1].encode())
    (tmp_path / "3.txt").write_bytes(("a long block without any blank line\n" * 40).encode())
    (tmp_path / "4.txt").write_bytes(b"\n\n \n")
    texts += ["a long block without any blank line\n" * 40]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        if size < 1000:
            assert spark.read.text(str(tmp_path / "1.txt")).rdd.getNumPartitions() > 20
        got = sorted(r["value"].replace("\r", "") for r in T.text_blocks(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == sorted(b for t in texts for b in plain_blocks(t))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_changed_new_and_removed_documents(spark, tmp_path):
    seen = []

    def compute(rows):
        seen.append(sorted(r.doc_id for r in rows.collect()))
        return rows.select("doc_id", F.explode(F.split("text", "")).alias("c"))

    schema = docs(spark, []).select("doc_id", F.col("text").alias("c")).schema
    store = ContentStore(spark, str(tmp_path / "store"), schema)
    assert store.read().count() == 0
    first = [("a", "xy"), ("b", "z"), ("c", None), ("d", "same")]
    assert store.upsert(docs(spark, first), compute) == 1 and store.upsert(docs(spark, first), compute) is None
    second = [("a", "xy"), ("b", "zz"), ("d", "same"), ("e", "new")]
    assert store.upsert(docs(spark, second), compute) == 2
    assert seen == [["a", "b", "c", "d"], ["b", "e"]]
    got = {}
    for r in store.read().collect():
        got.setdefault((r.doc_id, r.version), []).append(r.c)
    assert {k: "".join(sorted(v)) for k, v in got.items()} == {("a", 1): "xy", ("b", 2): "zz", ("d", 1): "aems", ("e", 2): "enw"}

    def fails(rows):
        return rows.select("doc_id", F.raise_error(F.lit("midway")).cast("string").alias("c"))

    third = [("a", "other"), ("e", "new")]
    with pytest.raises(Exception, match="midway"):
        store.upsert(docs(spark, third), fails)
    assert store.versions() == [1, 2] and store.keys().count() == 4  # nothing of the failed run is read
    assert store.upsert(docs(spark, third), compute) > 2 and {r.doc_id for r in store.read().collect()} == {"a", "e"}


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    def compute(rows):
        return rows.select("doc_id", F.length("text").alias("n"))

    store = ContentStore(spark, str(tmp_path / "store"), compute(docs(spark, [])).schema)
    incoming = str(tmp_path / "in")
    docs(spark, [("a", "x"), ("b", "yy")]).write.json(incoming)
    stream = spark.readStream.schema("doc_id string, text string").json(incoming)
    upsert_arrivals(stream, store, compute, str(tmp_path / "cp1")).awaitTermination(120)
    upsert_arrivals(stream, store, compute, str(tmp_path / "cp2")).awaitTermination(120)  # all files once more
    assert store.versions() == [1] and {(r.doc_id, r.n) for r in store.read().collect()} == {("a", 1), ("b", 2)}
    docs(spark, [("b", "changed")]).write.mode("append").json(incoming)
    upsert_arrivals(stream, store, compute, str(tmp_path / "cp1")).awaitTermination(120)
    assert {(r.doc_id, r.n) for r in store.read().collect()} == {("a", 1), ("b", 7)}


def test_outputs_are_committed_together(spark, tmp_path):
    path = str(tmp_path / "out")
    stats = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    flows = spark.createDataFrame([("a", 0.5)], "doc_id string, flow double")
    with pytest.raises(FileNotFoundError):
        sinks.committed_path(spark, path)
    broken = flows.withColumn("flow", F.raise_error(F.lit("midway")).cast("double"))
    with pytest.raises(Exception, match="midway"):
        sinks.commit_results(stats, path, flows=broken)
    with pytest.raises(FileNotFoundError):  # the statistics were written, and nobody sees them
        sinks.committed_path(spark, path)
    first = sinks.commit_results(stats, path, flows=flows)
    with pytest.raises(Exception, match="midway"):
        sinks.commit_results(stats.limit(1), path, flows=broken)
    run = sinks.committed_path(spark, path)
    assert run.endswith(f"/{first}") and spark.read.json(f"{run}/by_document").count() == 2
    second = sinks.commit_results(stats.limit(1), path, flows=flows)
    third = sinks.commit_results(stats, path, flows=flows)
    run = sinks.committed_path(spark, path)
    assert first < second < third and spark.read.json(f"{run}/by_document").count() == 2
    assert sorted(int(p.name) for p in (tmp_path / "out" / "runs").iterdir()) == [second, third]
