"""Hard negatives by segment summaries.

A row's components become whole numbers and its score with an anchor is their inner product.
For every segment of a vector its mean and deviation are stored, at several levels: the whole
vector, its halves, their halves.  Over a segment of n components the product of two vectors
is n times the product of the means, plus or minus at most n times the product of the
deviations.  The sum over a level's segments bounds the score from both sides.  Pairs that
the bounds leave open go to the next level; after the finest one the segments are opened one by
one, each giving its exact part while the others keep their bound.  Only pairs that are open to
the end have been scored exactly.

Rows are packed into blocks where they lie.  The anchors, a stated part of the rows, are
packed too, and every block of rows is held against every block of anchors; per anchor a
block hands on its best few rows, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.skew import SALT, join_salted

#: Rows and anchors of a block, and rows compared at a time.
ROWS, ANCHORS, TILE = 4096, 512, 1024
#: Segments of the levels.
LEVELS = (1, 2, 4, 8)
SCALE, LARGEST = 256.0, 1e150
POSITIVES, NEGATIVES = 5, 3
#: Pairs are followed one by one when fewer than one in so many is open.
SPARSE = 6
BLOCK = "dim int, n int, ids binary, none binary, labels binary, vecs binary, means binary, devs binary"
FOUND = "ab long, idx int, of int, score long, id long, none boolean"
FAR = np.iinfo(np.int64).max


def _edges(dim: int, segments: int) -> np.ndarray:
    return np.unique(np.arange(segments + 1) * dim // segments)


def summaries(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all levels' segments, each times the root of the segment's
    length, so that products need no further factor."""
    means, devs = [], []
    for segments in LEVELS:
        edges = _edges(vecs.shape[1], segments)
        for a, b in zip(edges[:-1], edges[1:]):
            part = vecs[:, a:b]
            mean = part.mean(1)
            means.append(mean * np.sqrt(b - a))
            devs.append(np.sqrt(np.square(part - mean[:, None]).sum(1)))
    shape = (len(vecs), len(means))
    return (np.stack(means, 1), np.stack(devs, 1)) if means else (np.zeros(shape), np.zeros(shape))


@dataclass
class Block:
    """Rows with their vectors and summaries."""

    ids: np.ndarray
    none: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    means: np.ndarray
    devs: np.ndarray

    @classmethod
    def of(cls, ids, none, labels, vecs) -> "Block":
        return cls(ids, none, labels, vecs, *summaries(vecs))

    def pack(self) -> tuple:
        arrays = (self.ids, self.none, self.labels, self.vecs, self.means, self.devs)
        return (self.vecs.shape[1], len(self.ids), *[np.ascontiguousarray(a).tobytes() for a in arrays])

    @classmethod
    def unpack(cls, dim, n, ids, none, labels, vecs, means, devs) -> "Block":
        whole, yes = (lambda b: np.frombuffer(b, np.int64)), np.frombuffer(none, bool)
        real = lambda b, width: np.frombuffer(b, np.float64).reshape(n, width)
        width = len(means) // (8 * n)
        return cls(whole(ids), yes, whole(labels), real(vecs, dim), real(means, width), real(devs, width))

    def rows(self, a: int, b: int) -> "Block":
        return Block(*[x[a:b] for x in (self.ids, self.none, self.labels, self.vecs, self.means, self.devs)])


def exact_scores(a: np.ndarray, r: np.ndarray, ai: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size; beyond 64 bits the nearest that fits."""
    out = np.empty(len(ai), np.int64)
    for k, (i, j) in enumerate(zip(ai.tolist(), ri.tolist())):
        score = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), r[j].tolist()))
        out[k] = min(max(score, -FAR - 1), FAR)
    return out


def open_pairs(a: Block, r: Block, mask: np.ndarray, wanted: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the mask that no bound excludes, with their exact scores.

    ``wanted(low, high, ai)`` tells which pairs of bounds matter; ``ai`` are the pairs'
    anchors, or a slice where the bounds are a whole matrix.
    """
    dim = a.vecs.shape[1]
    norm = lambda b: np.sqrt(np.square(b.vecs).sum(1)).max(initial=0.0)
    slack = 1e-9 * norm(a) * norm(r) + 1e-6
    at, ai, ri, exact = 0, None, None, None
    steps = []
    for segments in LEVELS:
        width = len(_edges(dim, segments)) - 1
        steps.append((0, at, at + width))
        at += width
    edges = _edges(dim, LEVELS[-1]) if dim else np.zeros(1, np.int64)
    first = at - (len(edges) - 1)
    steps += [(int(e), first + k + 1, at) for k, e in enumerate(edges[1:])]
    done = 0
    for stop, low, high in steps:
        # whole matrices while many pairs are open, pairs one by one after that
        if ai is None and SPARSE * np.count_nonzero(mask) < mask.size:
            ai, ri = np.nonzero(mask)
            exact = exact[ai, ri] if exact is not None else np.zeros(len(ai))
        if ai is None:
            if exact is None:
                exact = np.zeros(mask.shape)
            if stop > done:
                exact = exact + a.vecs[:, done:stop] @ r.vecs[:, done:stop].T
            middle = exact + a.means[:, low:high] @ r.means[:, low:high].T
            around = a.devs[:, low:high] @ r.devs[:, low:high].T + slack
            mask = mask & wanted(middle - around, middle + around, slice(None))
        else:
            if stop > done:
                exact = exact + np.einsum("ij,ij->i", a.vecs[ai, done:stop], r.vecs[ri, done:stop])
            middle = exact + np.einsum("ij,ij->i", a.means[ai, low:high], r.means[ri, low:high])
            around = np.einsum("ij,ij->i", a.devs[ai, low:high], r.devs[ri, low:high]) + slack
            open_ = wanted(middle - around, middle + around, ai)
            ai, ri, exact = ai[open_], ri[open_], exact[open_]
        done = stop
    if ai is None:
        ai, ri = np.nonzero(mask)
        exact = exact[ai, ri]
    most = lambda b: np.abs(b.vecs).max(initial=0.0)
    if most(a) * most(r) * max(dim, 1) < 2.0 ** 52:
        return ai, ri, np.rint(exact).astype(np.int64)
    return ai, ri, exact_scores(a.vecs, r.vecs, ai, ri)


class Best:
    """The first k rows of each owner: higher score first, then smaller id, null ids last."""

    def __init__(self, owners: int, k: int):
        self.k, self.least = k, np.full(owners, -np.inf)
        self.owner, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.none = np.empty(0, bool)

    def add(self, owner, score, id_, none) -> None:
        owner, score, id_, none = (np.concatenate(p) for p in (
            (self.owner, owner), (self.score, score), (self.id, id_), (self.none, none)))
        # the complement turns the order of scores round without leaving 64 bits
        order = np.lexsort((id_, none, ~score, owner))
        owner = owner[order]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        order, owner = order[place < self.k], owner[place < self.k]
        self.owner, self.score, self.id, self.none = owner, score[order], id_[order], none[order]
        full = place[place < self.k] == self.k - 1
        self.least[owner[full]] = self.score[full]


def positives(a: Block, r: Block, k: int = POSITIVES) -> Best:
    """The first k other rows of each anchor's label."""
    best = Best(len(a.ids), k)
    for at in range(0, len(r.ids), TILE):
        tile = r.rows(at, at + TILE)
        mask = (a.labels[:, None] == tile.labels[None, :]) & ((a.ids[:, None] != tile.ids[None, :]) | tile.none[None, :])

        def wanted(low, high, ai):
            least = best.least[ai]
            return high >= (least[:, None] if high.ndim == 2 else least)

        ai, ri, score = open_pairs(a, tile, mask, wanted)
        best.add(ai, score, tile.ids[ri], tile.none[ri])
    return best


def negatives(a: Block, scores: np.ndarray, there: np.ndarray, r: Block, k: int = NEGATIVES) -> Best:
    """The first k rows of other labels for each anchor and positive: 50 to 95 hundredths of the
    positive's score.  ``scores[i, j]`` is that of anchor i and its j-th positive where ``there``."""
    width = scores.shape[1]
    least = -(-scores // 2)
    most = scores // 100 * 95 + scores % 100 * 95 // 100
    there = there & (least <= most)
    best = Best(len(a.ids) * width, k)
    for at in range(0, len(r.ids), TILE):
        tile = r.rows(at, at + TILE)
        mask = (a.labels[:, None] != tile.labels[None, :]) & there.any(1)[:, None]

        def wanted(low, high, ai):
            hit = np.zeros(high.shape, bool)
            floor = np.maximum(least, best.least.reshape(-1, width))
            for j in range(width):
                under, over, on = (x[ai, j] for x in (floor, most, there))
                if high.ndim == 2:
                    under, over, on = under[:, None], over[:, None], on[:, None]
                hit |= on & (high >= under) & (low <= over)
            return hit

        ai, ri, score = open_pairs(a, tile, mask, wanted)
        for j in range(width):
            fits = there[ai, j] & (score >= least[ai, j]) & (score <= most[ai, j])
            best.add(ai[fits] * width + j, score[fits], tile.ids[ri[fits]], tile.none[ri[fits]])
    return best


def vectors(embeddings: DataFrame, shift: int = 7, labels: int = 10) -> DataFrame:
    """``vec_id, label, vec``: rows that take part, components as whole numbers in doubles."""
    vec = F.transform(F.col("embedding"), lambda x: x.cast("double") * F.lit(SCALE))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > F.lit(LARGEST)))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % shift == 0, (label + 1) % labels).otherwise(label)
    return (embeddings.where("label is not null and embedding is not null")
            .select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), vec.alias("vec"))
            .where(~bad))


def _packed(most: int):
    """Blocks of at most ``most`` rows from the rows of a partition, by vector length."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for dim, same in batch.groupby(batch["vec"].map(len).astype(int)):
                for at in range(0, len(same), most):
                    part = same.iloc[at:at + most]
                    vecs = np.floor(np.stack(part["vec"].to_list())).astype(np.float64).reshape(len(part), int(dim))
                    none = part["vec_id"].isna().to_numpy(bool)
                    ids = part["vec_id"].fillna(0).to_numpy(np.int64)
                    out.append(Block.of(ids, none, part["label"].to_numpy(np.int64), vecs).pack())
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")])

    return pack


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    packed = rows.select("vec_id", "label", "vec").mapInPandas(_packed(most), BLOCK)
    return materialize(packed.withColumn("block", F.monotonically_increasing_id()), name)


NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _held(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of rows beside every block of anchors of its dimension.

    Numbers of blocks are paired first; the anchors, the smaller side, are what is copied.
    """
    named = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"], F.col("block").alias("ab"))
    pairs = join_salted(blocks.select("block", "dim"), named.select("ab", F.col("a_dim").alias("dim")), ["dim"], ["block"],
                        salt=SALT).select("block", "ab")
    return pairs.join(named, "ab").join(blocks, "block")


def _compare(best_of: Callable):
    """Owners' best rows of each pair of blocks; one pair is in memory at a time."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a = Block.unpack(*[row[f"a_{c}"] for c in NAMES])
                r = Block.unpack(*[row[c] for c in NAMES])
                best, width = best_of(a, r, row)
                yield pd.DataFrame({"ab": row["ab"], "idx": best.owner // width, "of": best.owner % width,
                                    "score": best.score, "id": best.id, "none": best.none})

    return compare


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ab", "idx", "of").orderBy(F.desc("score"), "none", "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(embeddings: DataFrame, every: int = 50, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``.  Rows with a null label, a
    null vector or a null or non-finite component (or one above 1e150) take no part.  Rows with
    the anchor's own id are not other rows; otherwise repeated rows all count, and each repeated
    anchor has its rows.  A row without id is no anchor and comes last among equal scores.
    Vectors of different lengths are not compared; empty ones score 0.  An anchor without
    positives, or a positive without negatives, has no rows; nor has an empty table.
    """
    part = vectors(embeddings)
    blocks = _blocks(part, rows, "mine-rows")
    chosen = part.where(F.col("vec_id") % every == 0)
    n = blocks.select(F.sum("n")).first()[0] or 0
    a = _blocks(chosen.repartition(max(1, -(-n // (every * anchors)))), anchors, "mine-anchors")

    def best_positives(x: Block, r: Block, row: dict):
        return positives(x, r, n_positives), 1

    found = _held(a, blocks).mapInPandas(_compare(best_positives), FOUND)
    first = materialize(_first(found, n_positives), "mine-positives")
    # at most anchors times n_positives entries in a block's list
    lists = first.groupBy("ab").agg(F.collect_list(F.struct("idx", "place", "score")).alias("_list"))
    asked = a.join(lists.withColumnRenamed("ab", "block"), "block").select(
        "*", F.transform("_list", lambda x: x["idx"]).alias("p_idx"), F.transform("_list", lambda x: x["place"]).alias("p_place"),
        F.transform("_list", lambda x: x["score"]).alias("p_score")).drop("_list")
    asked = materialize(asked, "mine-asked")

    def best_negatives(x: Block, r: Block, row: dict):
        scores = np.zeros((len(x.ids), n_positives), np.int64)
        there = np.zeros(scores.shape, bool)
        at = np.asarray(row["a_p_idx"], np.int64), np.asarray(row["a_p_place"], np.int64) - 1
        scores[at], there[at] = np.asarray(row["a_p_score"], np.int64), True
        return negatives(x, scores, there, r, n_negatives), n_positives

    below = _first(_held(asked, blocks).mapInPandas(_compare(best_negatives), FOUND), n_negatives)
    ids = a.select(F.col("block").alias("ab"), F.posexplode(_ids("ids")).alias("idx", "anchor_id"))
    named = first.join(ids, ["ab", "idx"]).select(
        "ab", "idx", (F.col("place") - 1).alias("of"), "anchor_id",
        F.when(~F.col("none"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))
    return below.join(named, ["ab", "idx", "of"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"),
        F.when(~F.col("none"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _ids(packed: str):
    @F.pandas_udf("array<bigint>")
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, np.int64))

    return ids(F.col(packed))


ORACLE = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))::bigint) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
pos as (
  select * from (select anchor_id, other as positive_id, score as positive_score,
                        row_number() over (partition by anchor_id order by score desc, other) as n from pairs where same) where n <= 5),
neg as (
  select p.anchor_id, p.positive_id, p.positive_score, q.other as negative_id, q.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by q.score desc, q.other) as rank
  from pos p join pairs q on q.anchor_id = p.anchor_id and not q.same
   and 50 * p.positive_score <= 100 * q.score and 100 * q.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from neg where rank <= 3
"""
