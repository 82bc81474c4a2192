"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of all digests, one per task, are added up.  A digest whose
summed counter reaches ``rows / (counters + 1)`` is a candidate; the counters sum to at
most the number of rows, so there are never more than ``counters + 1`` candidates, and
every digest with twice that many rows is one of them.  Candidates are counted exactly,
and those with several rows are the winners: their bounded table is broadcast and their
rows are finished on the map side.  The other digests have a bounded share of the rows
and meet in an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.llm.common import lower_ascii

COUNTERS = 1024


def misra_gries(batches: Iterator[pd.Series], counters: int) -> dict:
    """Misra-Gries counters of all values.  A value with more than n / (counters + 1)
    of the n values is kept, and no counter exceeds the value's true number."""
    held: dict = {}
    for values in batches:
        for value, n in values.value_counts(sort=False).items():
            held[value] = held.get(value, 0) + int(n)
        if len(held) > counters:
            # as many single steps at once as leave `counters` values
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: v - cut for k, v in held.items() if v > cut}
    return held


def heavy_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Column ``digest``: at most ``counters + 1`` digests, with all of at least
    ``2 * rows / (counters + 1)`` rows among them."""
    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = misra_gries((b["digest"] for b in batches), counters)
        yield pd.DataFrame({"digest": pd.Series(list(held), dtype=object),
                            "held": pd.Series(list(held.values()), dtype="int64")})

    parts = digests.select("digest").mapInPandas(summaries, "digest binary, held bigint")
    least = -(-digests.count() // (counters + 1))
    return (parts.groupBy("digest").agg(F.sum("held").alias("held"))
            .where((F.col("held") >= F.lit(max(1, least)))).select("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text is empty.  The row
    with the largest id stays.  A null id is smaller than any other and is kept only where
    no row of the group has an id; of rows that repeat an id each is marked like the
    other, so ``kept`` holds for all of them.  An empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    hashed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.encode(lower_ascii(F.col(text_col)), "UTF-8"), 256)).alias("digest"))
    rows = materialize(hashed, "dedup-digests")
    heavy = F.broadcast(materialize(heavy_candidates(rows, counters), "dedup-candidates"))
    verdict = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # the join is on the map side and the aggregation starts there: a few rows are shuffled
    winners = materialize(rows.join(heavy, "digest").groupBy("digest").agg(*verdict)
                          .where("group_size > 1"), "dedup-winners")
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*verdict), "digest")
    out = hot.unionByName(cold)
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
