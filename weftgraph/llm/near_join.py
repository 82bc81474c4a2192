"""N-gram Jaccard join by a token-group matrix.

A document's set are its distinct word shingles.  Documents with equal sets form a class.
Classes are put in the order of their two most frequent tokens and two min-hashes, which
brings similar ones together, and the order is cut into groups of ``GROUP`` classes.  The matrix holds each group's token
union.  For a query class it bounds the overlap with any member of a group: tokens that
the union lacks cannot be shared.  Groups whose bound stays below the threshold are
skipped, the others are opened and their members compared exactly.

Only the tokens that can decide the bound are stored.  A set of n tokens shares at least
``need(n)`` with every partner.  In any order that is the same for all sets, the k-th of
their common tokens has at most ``n - need(n)`` others and k - 1 common ones before it, so
partners share k tokens among the first ``n - need(n) + k`` of each.  A group is opened for
a query if its union holds that many of the query's first tokens.  The order puts frequent
tokens last; which tokens count as frequent affects the work, not the result.

A token is the 64-bit hash of a shingle, a class the 128-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.lineage import discard, materialize
from weftgraph.llm.common import free_name, release
from weftgraph.skew import join_split

#: Classes of a group, and tokens of their sets; the last set may go over.
GROUP, GROUP_TOKENS = 256, 1 << 20
#: Tokens that a task holds before it hands on what it has.
SLICE = 1 << 19
#: Query classes that one task compares with an opened group.
QUERIES = 512
#: Tokens of at least so many documents go last, at most ``FREQUENT`` of them (a broadcast
#: of 16 bytes each); others keep their place.
FREQUENT_FROM, FREQUENT = 24, 1 << 18
#: A set that may miss k of its tokens has to show ``1 + k // SPARE`` common ones.
SPARE = 5
WORDS_HELD = 1 << 17


class WordHashes(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(width: int) -> np.ndarray:
    """An odd factor for each place in a shingle."""
    return _mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def tokens_of(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct tokens of a text in UTF-8: its ``width``-word shingles after lower-casing
    A-Z, or all its words as one shingle if there are fewer; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(width, len(words))
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    x = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k, factor in enumerate(_multipliers(n)):
        x += h[k:len(words) - n + 1 + k] * factor
    return np.unique(_mixed(x))


@dataclass(frozen=True)
class Link:
    """``links``: den * intersection >= num * union, over shingles of ``width`` words."""

    width: int
    num: int
    den: int

    def need(self, n: int) -> int:
        """Tokens that a set of n tokens shares with every set it links to."""
        return -(-self.num * n // self.den)

    def common(self, n: int) -> int:
        """How many common tokens are asked for at n tokens; more for larger sets."""
        return 1 + (n - self.need(n)) // SPARE

    def deciding(self, n: int) -> int:
        return n - self.need(n) + self.common(n)

    def least_common(self, n: Column) -> Column:
        """Deciding tokens that a set of n tokens and any partner of it have in common: what
        is asked for at the smallest size that a partner can have."""
        low = F.floor((n * self.num + self.den - 1) / self.den)
        return 1 + F.floor((low - F.floor((low * self.num + self.den - 1) / self.den)) / SPARE)


def _frequent(texts: DataFrame, link: Link) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens (sorted) and in how many texts they are among the deciding ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0

        def counted():
            codes, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(times.astype(np.int64))], ["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                x = tokens_of(text.as_py(), link.width, hashes)
                if len(x):
                    held.append(x[:link.deciding(len(x)) * 5 // 4].copy())
                    n += len(held[-1])
                if n >= SLICE:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    found = (texts.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas())
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["n"].to_numpy(np.int64)[order]


def _sets(texts: DataFrame, link: Link, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row the size and digest of its set, what it is ordered by and its deciding tokens,
    of which the last ``tail`` are frequent ones."""
    known, often = frequent

    def describe(text: bytes | None, hashes: WordHashes) -> tuple:
        x = tokens_of(text, link.width, hashes)
        if not len(x):
            return 0, b"", 0, 0, 0, 0, 0, x.view(np.int64)
        rank = np.zeros(len(x), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            rank = np.where(known[at] == x, often[at], 0)
        order, signed, top = None, x.view(np.int64), [0, 0]
        if rank.any():
            order = np.lexsort((x, rank))
            top = [int(signed[i]) if rank[i] else 0 for i in (order[-1], order[-2 if len(x) > 1 else -1])]
        first = signed[:link.deciding(len(x))].copy() if order is None else signed[order[:link.deciding(len(x))]]
        low = int((x * np.uint64(0x9E3779B97F4A7C15)).min().view(np.int64))
        tail = len(first) if order is None else int(np.count_nonzero(rank[order[:len(first)]]))
        return len(x), xxhash.xxh3_128_digest(x.tobytes()), *top, int(signed[0]), low, tail if rank.any() else 0, first

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, start, n = [], 0, 0

            def part(stop):
                *plain, tokens = zip(*rows)
                ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                kinds = (pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[start:stop] for c in (0, 1)], *[pa.array(p, k) for p, k in zip(plain, kinds)],
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens)))],
                    ["doc_id", "key", "n", "digest", "o1", "o2", "o3", "o4", "tail", "tokens"])

            for i, text in enumerate(batch.column(2)):
                rows.append(describe(text.as_py(), hashes))
                n += len(rows[-1][-1])
                if n >= SLICE:
                    yield part(i + 1)
                    rows, start, n = [], i + 1, 0
            if rows:
                yield part(batch.num_rows)

    return texts.select("doc_id", "key", "text").mapInArrow(
        sets, "doc_id bigint, key bigint, n int, digest binary, o1 bigint, o2 bigint, o3 bigint, o4 bigint, "
        "tail int, tokens array<bigint>")


class _Unit:
    """Members of an opened group and, one by one, the query classes that they are compared with."""

    def __init__(self, link: Link):
        self.link, self.root, self.ids, self.sets, self.index = link, {}, [], [], None

    def _find(self, c: int) -> int:
        while self.root[c] != c:
            self.root[c] = c = self.root[self.root[c]]
        return c

    def member(self, cid: int, tokens: np.ndarray) -> None:
        self.root.setdefault(cid, cid)
        self.ids.append(cid)
        self.sets.append(tokens)

    def query(self, cid: int, mine: np.ndarray) -> None:
        self.root.setdefault(cid, cid)
        if not self.ids:
            return
        if self.index is None:
            sizes = np.array([len(x) for x in self.sets])
            tokens, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.ids)), sizes)
            order = np.argsort(tokens, kind="stable")
            self.index, self.sets = (tokens[order], owner[order], sizes), []
        tokens, owner, sizes = self.index
        low, high = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        n = high - low
        at = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(self.ids))
        for i in np.flatnonzero(self.link.den * both >= self.link.num * (sizes + len(mine) - both)):
            a, b = self._find(cid), self._find(self.ids[i])
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        """A star to the smallest class of each set of classes that the links connect."""
        return [(c, self._find(c)) for c in self.root if self._find(c) != c]


def _compare(link: Link):
    """Exact comparison of opened groups' members with query classes, from rows sorted by
    unit with the members first; tokens of one unit's members are in memory, no texts."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unit, here, last, found = WordHashes(), None, None, None, []

        def out():
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            gid, part, cid = (batch.column(c).to_numpy() for c in (0, 1, 3))
            query = batch.column(2).to_numpy(zero_copy_only=False)
            for i, text in enumerate(batch.column(4)):
                if (gid[i], part[i]) != here:
                    found += unit.links() if unit else []
                    unit, here, last = _Unit(link), (gid[i], part[i]), None
                if (cid[i], query[i]) == last:  # a row that the input repeats
                    continue
                last = cid[i], query[i]
                (unit.query if query[i] else unit.member)(int(cid[i]), tokens_of(text.as_py(), link.width, hashes))
            yield out()
            found = []
        found += unit.links() if unit else []
        yield out()

    return compare


def components(edges: DataFrame) -> DataFrame:
    """``v, low``: for every vertex of the edges ``a, b`` the smallest one it is connected to.

    Every round takes the smallest label of the neighbours and then the label's own label;
    it ends when no label has changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "near-edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select(
        "v", F.least("v", "low").alias("low")), "near-labels")
    while True:
        offered = (both.join(labels.select(F.col("v").alias("a"), "low"), "a")
                   .select(F.col("b").alias("v"), "low", F.lit(None).cast("bigint").alias("old")))
        new = (offered.unionByName(labels.withColumn("old", F.col("low")))
               .groupBy("v").agg(F.min("low").alias("low"), F.max("old").alias("old")))
        jump = labels.select(F.col("v").alias("low"), F.col("low").alias("lower"))
        new = materialize(new.join(jump, "low", "left").select(
            "v", F.least("low", F.coalesce("lower", "low")).alias("low"), "old"), "near-labels")
        labels = new.select("v", "low")
        if new.where("low < old").isEmpty():
            return labels


def _classes(rows: DataFrame) -> DataFrame:
    """``cid, gid`` and one row (``doc_id, key``) of every class of equal sets.

    Ids follow the order of the classes inside a partition, so a group's ids are in a row and
    never span partitions.
    """
    order = ["o1", "o2", "o3", "o4", "digest"]
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")
    classes = rows.where("n > 0").groupBy(*order).agg(one, F.max("n").alias("n"))
    classes = classes.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, full, seen = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            # a class fills its share of a group by number or by tokens
            weight = np.maximum(batch.column(3).to_numpy().astype(np.int64), -(-GROUP_TOKENS // GROUP))
            before = full + np.cumsum(weight) - weight
            cid = start + seen + np.arange(batch.num_rows)
            full, seen = full + int(weight.sum()), seen + batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (0, 1, 2)], pa.array(cid), pa.array(start + before // GROUP_TOKENS)],
                ["digest", "doc_id", "key", "cid", "gid"])

    return materialize(classes.select("digest", "f.doc_id", "f.key", "n").mapInArrow(
        number, "digest binary, doc_id bigint, key bigint, cid bigint, gid bigint"), "near-classes")


def _shared(rows: DataFrame, classes: DataFrame, link: Link) -> DataFrame:
    """``token, cid, gid, n``: deciding tokens that several classes have, of the classes
    that have as many of them as any partner would ask for."""
    same = [rows["digest"] == classes["digest"], rows["key"] == classes["key"],
            rows["doc_id"].eqNullSafe(classes["doc_id"])]
    entries = rows.join(classes, reduce(and_, same)).select(
        "cid", "gid", "n", (F.size("tokens") - F.col("tail")).alias("_rare"), F.posexplode("tokens").alias("_at", "token"))
    # frequent tokens need no count and never meet in a task; of the others every one has few rows.
    # Rows repeated in the input only raise counts, and a count that is too high opens a group more
    columns = ["token", "cid", "gid", "n"]
    often = F.count(F.lit(1)).over(Window.partitionBy("token"))
    rare = entries.where("_at < _rare").select(*columns).repartition("token").withColumn("_c", often).where("_c > 1")
    several = materialize(rare.select(*columns).unionByName(entries.where("_at >= _rare").select(*columns)), "near-several")
    enough = (several.groupBy("cid").agg(F.count(F.lit(1)).alias("_c"), F.max("n").alias("_n"))
              .where(F.col("_c") >= link.least_common(F.col("_n"))).select("cid"))
    out = materialize(several.join(enough, "cid", "left_semi"), "near-shared")
    discard(several)
    return out


def _opened(shared: DataFrame, link: Link) -> DataFrame:
    """``query, gid``: the groups that are opened for each class."""
    matrix = shared.groupBy("token", "gid").agg(
        F.count(F.lit(1)).alias("_c"), F.min("n").alias("_least"), F.max("n").alias("_most"))
    ask = shared.select("token", F.col("cid").alias("query"), F.col("gid").alias("own"), "n")
    # of two groups the earlier is opened for queries of the later; sizes must fit as well
    # a frequent token's queries are many, its groups are few: the queries are what is split
    return materialize(
        join_split(ask, matrix, ["token"], ["query"])
        .where((F.col("gid") < F.col("own")) | ((F.col("gid") == F.col("own")) & (F.col("_c") > 1)))
        .where((F.col("_most") * link.den >= F.col("n") * link.num) & (F.col("n") * link.den >= F.col("_least") * link.num))
        .groupBy("query", "gid").agg(F.count(F.lit(1)).alias("_c"), F.max("n").alias("_n"))
        .where(F.col("_c") >= link.least_common(F.col("_n"))).select("query", "gid"), "near-opened")


def _links(keyed: DataFrame, classes: DataFrame, shared: DataFrame, opened: DataFrame, link: Link) -> DataFrame:
    """``a, b``: links between classes, enough to connect what is connected."""
    units = materialize(opened.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")),
                        "near-units")
    asked = opened.join(units, "gid").select(
        F.col("query").alias("cid"), "gid", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"),
        F.lit(True).alias("query"))
    present = shared.select("cid", "gid").distinct().join(units, "gid").select(
        "cid", "gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"))
    rep = classes.select("cid", F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    wanted = asked.unionByName(present).join(rep, "cid")
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    unit = keyed.join(wanted, same).select("gid", "part", "query", "cid", "text")
    unit = unit.repartition("gid", "part").sortWithinPartitions("gid", "part", "query", "cid")
    return materialize(unit.mapInArrow(_compare(link), "a bigint, b bigint"), "near-links")


def _rows(docs: DataFrame, link: Link, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Slim rows ``doc_id, key, n, digest`` and ``digest, component`` of all classes."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("key"), F.encode("text", "UTF-8").alias("text"))
    frequent = _frequent(keyed, link)
    release(spark)
    sets = materialize(_sets(keyed, link, frequent), "near-sets")
    rows = materialize(sets.select("doc_id", "key", "n", "digest"), "near-rows")
    classes = _classes(sets)
    shared = _shared(sets, classes, link)
    discard(sets)
    release(spark)
    links = _links(keyed, classes, shared, _opened(shared, link), link)
    release(spark)
    joined = components(links)
    named = classes.select("cid", "digest").join(joined.withColumnRenamed("v", "cid"), "cid", "left").select(
        "digest", F.coalesce("low", "cid").alias("component"))
    return rows, materialize(named, "near-components")


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Documents link when ``den * intersection >= num * union`` of their shingle sets;
    ``component_id`` is the smallest id that links lead to, its own included.  A document
    without words or text has an empty set, links with nothing and is its own component.
    A null id is never the smallest where a document of the component has one; repeated
    rows are each returned, other columns are not read, an empty table gives an empty result.
    """
    rows, named = _rows(docs, Link(width, num, den), id_col, text_col)
    lowest = rows.groupBy("digest").agg(F.min("doc_id").alias("_low")).join(named, "digest")
    first = lowest.groupBy("component").agg(F.min("_low").alias("component_id"))
    ids = join_split(lowest.select("digest", "component"), first, ["component"], ["digest"]).select("digest", "component_id")
    out = join_split(rows, ids, ["digest"], ["doc_id", "key"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, columns as given.  Documents
    without words all stay; of rows that repeat id and text one stays."""
    rows, named = _rows(docs, Link(width, num, den), id_col, text_col)
    own = rows.groupBy("digest", "doc_id", "key").agg(F.count(F.lit(1)).alias("_rows"), F.max("n").alias("_n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "_rows")).alias("f")
    best = (own.where("_n > 0").groupBy("digest").agg(first).join(named, "digest").groupBy("component")
            .agg(F.min("f").alias("f")).select("f.doc_id", "f.key", "f._rows"))
    wordless = own.where("_n = 0").select("doc_id", "key", F.lit(1).alias("_rows"))
    stay = materialize(best.unionByName(wordless), "near-stay")
    key, kid, kkey = free_name(docs, "_key", "_kid", "_kkey")
    text = F.col(text_col).cast("string")
    pick = stay.select(F.col("doc_id").alias(kid), F.col("key").alias(kkey), "_rows")
    kept = docs.withColumn(key, F.xxhash64(text)).join(
        pick, (F.col(key) == F.col(kkey)) & F.col(id_col).cast("long").eqNullSafe(F.col(kid)))
    once = kept.where(F.col("_rows") == 1).select(*docs.columns)
    if stay.where("_rows > 1").isEmpty():
        return once
    return once.unionByName(kept.where(F.col("_rows") > 1).dropDuplicates([kid, kkey]).select(*docs.columns))
