"""Sharding by minimax contiguous partition.

Equal texts form atomic groups, ordered by digest.  The smallest shard capacity for which
a greedy walk over the ordered group sizes needs no more than the given number of shards
is found by binary search, and the order is cut for that capacity.  A group as large as
an even share of what is left gets a shard of its own before that, since no cut can even
it out.

The walk asks only for group ends near a position.  The driver holds ``CELLS`` runs of
ends (lowest, highest, number), never the ends of all groups: runs that a walk cannot
decide are replaced by finer ones until capacity and cuts are exact.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.llm.common import text_bytes
from weftgraph.operators.graph import dense_ids
from weftgraph.skew import SALT, join_salted

SHARDS = 40
ROW_BYTES = 16
#: Bound on the runs of group ends that one refinement brings to the driver.
CELLS = 1 << 16
#: Ranges of positions that one refinement asks for.
RANGES = 100


class Ends:
    """Ends of the ordered groups as runs, refined on demand.

    ``summary(ranges, width)`` gives ``(lowest, highest, number)`` of the ends per cell of
    ``width`` inside the closed ranges, or everywhere where ``ranges`` is None.
    """

    def __init__(self, summary, total: int, cells: int = CELLS):
        self.summary, self.total, self.cells, self.open = summary, total, cells, set()
        self._set(summary(None, max(1, -(-total // cells))))

    def _set(self, runs) -> None:
        self.runs = sorted(runs)
        self.low = [r[0] for r in self.runs]

    def before(self, x: float, far: bool = False) -> float:
        """The last end at or before x, 0 if none; in an undecided run its lowest end,
        or with ``far`` the position x itself."""
        i = bisect.bisect_right(self.low, x) - 1
        if i < 0:
            return 0
        low, high, _ = self.runs[i]
        if high <= x:
            return high
        if low < high:
            self.open.add(i)
        return x if far else low

    def after(self, x: float) -> float:
        """The first end at or after x (0 for x up to 0); an undecided run's highest."""
        if x <= 0:
            return 0
        i = bisect.bisect_left(self.low, x)
        if i and self.runs[i - 1][1] >= x:
            if self.runs[i - 1][0] < self.runs[i - 1][1]:
                self.open.add(i - 1)
            return self.runs[i - 1][1]
        return self.low[i] if i < len(self.low) else self.total

    def refine(self) -> bool:
        """Replace the runs met undecided; false if there was none."""
        todo = [i for i in sorted(self.open) if self.runs[i][2] > 1 and self.runs[i][0] < self.runs[i][1]]
        self.open = set()
        if not todo:
            return False
        # a range for each; beyond RANGES of them those with the narrowest gaps are joined
        gap = lambda i: self.runs[todo[i]][0] - self.runs[todo[i - 1]][1]
        edges = [0, *sorted(sorted(range(1, len(todo)), key=gap, reverse=True)[:RANGES - 1]), len(todo)]
        spans = [(todo[i], todo[j - 1]) for i, j in zip(edges, edges[1:])]
        ranges = [(self.runs[i][0], self.runs[j][1]) for i, j in spans]
        gone = {k for i, j in spans for k in range(i, j + 1)}
        # more cells than runs that they replace, so that every refinement gets on
        width = max(1, -(-sum(b - a for a, b in ranges) // max(self.cells, 4 * len(gone))))
        self._set([r for i, r in enumerate(self.runs) if i not in gone] + list(self.summary(ranges, width)))
        return True


def _fits(ends: Ends, capacity: int, shards: int, far: bool) -> bool:
    at = 0.0
    for _ in range(shards):
        at = ends.before(at + capacity, far)
        if at >= ends.total:
            return True
    return False


def _least(ends: Ends, shards: int, far: bool) -> int:
    """Smallest capacity that the walk finds feasible."""
    low, high = max(0, -(-ends.total // shards) - 1), ends.total
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if _fits(ends, mid, shards, far) else (mid, high)
    return high


def minimax_cuts(ends: Ends, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and ``shards - 1`` cuts with no shard above it, each cut as
    near to an even share of the rest as the capacity allows."""
    if ends.total <= 0:
        return 0, [0] * (shards - 1)
    while True:
        # a walk that stops too early finds a capacity that suffices, one that goes too far a
        # capacity that is needed; at the latter the two walks part at an undecided run
        high, low = _least(ends, shards, False), _least(ends, shards, True)
        ends.open = set()
        for capacity in (low, high):
            _fits(ends, capacity, shards, False)
            _fits(ends, capacity, shards, True)
        if low < high and ends.refine():
            continue
        ends.open = set()
        back = [ends.total] * (shards + 1)
        for k in range(shards - 1, 0, -1):
            back[k] = ends.after(back[k + 1] - high)
        cuts, at = [], 0
        for k in range(1, shards):
            aim = at + (ends.total - at) / (shards - k + 1)
            under, over = ends.before(aim), ends.after(aim)
            near = under if aim - under <= over - aim else over
            at = int(min(max(near, back[k], at), ends.before(at + high)))
            cuts.append(at)
        if not ends.refine():
            return high, cuts


def shard_groups(groups: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """``digest, shard`` for groups with ``digest`` and ``bytes`` (positive)."""
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    # at most as many rows as there are shards
    largest = groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()
    own, left = [], int(total)
    for g in largest:
        if len(own) == shards - 1 or g["bytes"] * (shards - len(own)) < left:
            break
        own.append(bytes(g["digest"]))
        left -= g["bytes"]
    alone = F.lit(None).cast("int")
    for i, d in enumerate(own):
        alone = F.when(F.col("digest") == F.lit(d), F.lit(i)).otherwise(alone)
    marked = groups.withColumn("_own", alone)
    rest = marked.where("_own is null").select("digest", "bytes")
    ranged = materialize(rest.repartitionByRange("digest").sortWithinPartitions("digest")
                         .withColumn("_part", F.spark_partition_id()), "shard-order")
    # rows of the second window: one per partition
    parts = ranged.groupBy("_part").agg(F.sum("bytes").alias("_bytes"))
    starts = parts.select("_part", (F.sum("_bytes").over(Window.orderBy("_part")) - F.col("_bytes")).alias("_start"))
    run = Window.partitionBy("_part").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(
        ranged.withColumn("_end", F.sum("bytes").over(run)).join(starts, "_part")
        .select("digest", (F.col("_end") + F.col("_start")).alias("end")), "shard-ends")

    def summary(ranges, width):
        inside = placed
        if ranges is not None:
            some = F.lit(False)
            for a, b in ranges:
                some = some | F.col("end").between(int(a), int(b))
            inside = placed.where(some)
        cells_of = inside.groupBy(F.floor((F.col("end") - 1) / F.lit(int(width))).alias("_cell"))
        found = cells_of.agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        return [(r["a"], r["b"], r["n"]) for r in found]

    _, cuts = minimax_cuts(Ends(summary, left, cells), shards - len(own))
    shard = sum([(F.col("end") > F.lit(c)).cast("int") for c in cuts], F.lit(len(own)))
    return (marked.where("_own is not null").select("digest", F.col("_own").cast("int").alias("shard"))
            .unionByName(placed.select("digest", shard.cast("int").alias("shard"))))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          cells: int = CELLS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Size is the text's UTF-8 bytes plus 16; the law is ``bytes``: shard sizes are as near
    to each other as groups of equal texts allow.  A null text counts as the empty one,
    a null id is the first in its group, repeated rows get a slot each, other columns are
    not read.  Fewer groups than shards leave shards empty; an empty table gives an empty
    result.  ``slot`` counts from 0 in each shard by digest and id; ``grown_shard`` is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (text_bytes(F.col(text_col)) + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest")),
        "shard-rows")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    where = shard_groups(groups, shards, cells)
    placed = join_salted(rows, where, ["digest"], ["doc_id"], salt=SALT)
    placed = dense_ids(placed, ["shard"], ["digest", "doc_id"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
