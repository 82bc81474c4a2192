"""Prefix trie of conversations from vertical bitmaps.

Conversations are numbered by id and cut into shards of ``SHARD``, their turns into bands
of ``BAND`` positions; a unit is one band of one shard.  In a unit every (position, turn)
has a bitset of the conversations that say it there.  A walk from the unit's first nodes
intersects a node's bitset with the postings of the next position: each non-empty result is
a child, its popcount the number of members, its lowest bit the smallest member, and the
members whose last turn this is make the end list of the node in this shard.

Units know nothing of each other.  A node's key is the sum of the hashes of its (position,
turn) pairs, so equal prefixes of different shards have one key, and the key at which a
band begins is a running sum over the bands before it.  Keys merge the nodes of all shards.

Sums over subtrees need no walk over depths: every merged node is owned by the shard of its
smallest member, so a subtree's sum is the sum, over shards, of what the shard's part of it
owns.  Inside a unit that is a range of the walk's order; what lies in later bands is a
running sum per conversation, added at the nodes where the band ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.operators.graph import dense_ids

#: Conversations of a bitmap, and positions of a unit; a unit has at most their product of turns.
SHARD, BAND = 2048, 128
#: The rebuilt conversations share up to this many first turns.
HEAD = 8
MASK = (1 << 64) - 1
NODE = ["depth", "k1", "k2"]
LOCAL = ("shard long, band long, pre int, first boolean, depth long, k1 long, k2 long, p1 long, p2 long, low long, "
         "n long, n_ends long, ends string, bytes long, over array<bigint>")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def positioned(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, bytes``: the turns in order, positions from 1.

    ``a`` and ``b`` are hashes of role and text, ``bytes`` the text's UTF-8 bytes; a null
    role or text counts as the empty one.  Turns are ordered by ``turn`` (null first), turns
    that are equal in it by their hashes; repeated rows are turns of their own.  A row
    without ``conv_id`` belongs to no conversation.  Texts are read once and go no further.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(17), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    placed = dense_ids(slim, ["conv_id"], ["turn", "a", "b"], "pos")
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "a", "b", "bytes")


def lengths(turns: DataFrame) -> DataFrame:
    """``conv_id, n`` of every conversation with a turn."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another one's: ``conv_id, n`` and their turns.

    With h = crc32(decimal id) % 9, conversation c begins with the first h turns of
    conversation c - c % 5 (fewer if it has fewer, none if it is absent) and goes on with its
    own turns after its first h.  A conversation that is left without turns stays, with n 0.
    """
    size = lengths(turns)
    convs = size.select("conv_id", F.col("n").alias("_own"), (F.col("conv_id") - F.col("conv_id") % 5).alias("_base"),
                        (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).alias("_h"))
    base = size.select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"))
    convs = convs.join(base, "_base", "left").withColumn("_k", F.least("_h", F.coalesce("_n", F.lit(0))))
    convs = materialize(convs.withColumn("n", F.col("_k") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))), "trie-convs")
    heads = turns.where(F.col("pos") <= HEAD).withColumnRenamed("conv_id", "_base")
    lent = convs.join(heads, "_base").where("pos <= _h").select("conv_id", "pos", "a", "b", "bytes")
    own = turns.join(convs.select("conv_id", "_h", "_k"), "conv_id").where("pos > _h").select(
        "conv_id", (F.col("pos") - F.col("_h") + F.col("_k")).alias("pos"), "a", "b", "bytes")
    return convs.select("conv_id", "n"), lent.unionByName(own)


def _running(df: DataFrame, group: str, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums over the rows of the group before each row; a group may span partitions."""
    keys = [F.col(group), *[F.col(c) if c[0] != "-" else F.col(c[1:]).desc() for c in order]]
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn("_part", F.spark_partition_id()), "trie-running")
    parts = rows.groupBy(group, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(group, "_part", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(group, "_part").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums])
    return rows.join(starts, [group, "_part"]).select(
        group, *[c.lstrip("-") for c in order], *[(F.col(f"_in_{c}") + F.col(f"_{c}")).alias(c) for c in sums])


def _mixed(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def _units(convs: DataFrame, turns: DataFrame, shard: int, band: int) -> DataFrame:
    """The rows of all units: a turn each, and per conversation a row at position 0."""
    numbered = materialize(dense_ids(convs, [], ["conv_id"], "_cid").select(
        "conv_id", "n", F.floor(F.col("_cid") / shard).alias("shard"), (F.col("_cid") % shard).cast("int").alias("bit")),
        "trie-shards")
    at = turns.withColumn("band", F.floor((F.col("pos") - 1) / band)).withColumn(
        "x", _mixed("pos", "a", "b")).withColumn("y", _mixed("b", "a", "pos")).drop("a", "b")
    at = materialize(at, "trie-turns")
    # halves of 32 bits, whose sums stay whole numbers of 64
    low, high = (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftrightunsigned(c, 32))
    halves = [low("x"), high("x"), low("y"), high("y")]
    names = ["s0", "s1", "s2", "s3"]
    longer = numbered.where(F.col("n") > band).select("conv_id")
    per = at.join(longer, "conv_id", "left_semi").groupBy("conv_id", "band").agg(
        *[F.sum(h).alias(s) for h, s in zip(halves, names)])
    starts = _running(per, "conv_id", ["band"], names).where("band > 0")
    rows = at.join(starts, ["conv_id", "band"], "left").join(numbered, "conv_id").select(
        "shard", "band", "bit", "conv_id", "n", "pos", "x", "y", "bytes",
        *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in names])
    zero = F.lit(0).cast("long")
    roots = numbered.select("shard", zero.alias("band"), "bit", "conv_id", "n", zero.alias("pos"),
                            *[zero.alias(c) for c in ("x", "y", "bytes", *names)])
    return rows.unionByName(roots)


def _bitset(bits: np.ndarray, width: int) -> int:
    if len(bits) == 1:
        return 1 << int(bits[0])
    mask = np.zeros(width, np.uint8)
    mask[bits] = 1
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _walk(shard: int, band: int):
    """The walk of one unit: its nodes in depth-first order."""
    def walk(unit: pd.DataFrame) -> pd.DataFrame:
        which, where = int(unit["shard"].iloc[0]), int(unit["band"].iloc[0])
        begin, stop = where * band, (where + 1) * band
        unit = unit.sort_values(["pos", "x", "y"], kind="stable")
        conv = dict(zip(unit["bit"], unit["conv_id"]))
        ends: dict[int, int] = {}
        for bit, n in zip(*[c.to_numpy() for c in (unit.drop_duplicates("bit")["bit"], unit.drop_duplicates("bit")["n"])]):
            ends[int(n)] = ends.get(int(n), 0) | 1 << int(bit)
        # postings: a bitset for each turn at each position, and where a conversation finds its own
        turns = unit[unit["pos"] > 0]
        pos, x, y = (turns[c].to_numpy(np.int64) for c in ("pos", "x", "y"))
        bit, size = turns["bit"].to_numpy(np.int64), turns["bytes"].to_numpy(np.int64)
        new = np.ones(len(turns), bool)
        new[1:] = (np.diff(pos) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        postings = [_bitset(b, shard) for b in np.split(bit, at[1:])] if len(at) else []
        says = dict(zip((pos * shard + bit).tolist(), group.tolist()))
        gx, gy, gsize = x[at].view(np.uint64).tolist(), y[at].view(np.uint64).tolist(), size[at].tolist()
        # first nodes: the root, or the nodes at which the band before ended
        if where == 0:
            first = {(0, 0): _bitset(unit.loc[unit["pos"] == 0, "bit"].to_numpy(np.int64), shard)}
        else:
            first = {}
            for b, *s in unit.drop_duplicates("bit")[["bit", "s0", "s1", "s2", "s3"]].itertuples(index=False):
                key = tuple((int(lo) + (int(hi) << 32)) & MASK for lo, hi in (s[:2], s[2:]))
                first[key] = first.get(key, 0) | 1 << int(b)
        out = []
        stack = [(begin, *key, 0, 0, members, 0) for key, members in
                 sorted(first.items(), key=lambda f: f[1] & -f[1], reverse=True)]
        while stack:
            depth, k1, k2, p1, p2, members, size_here = stack.pop()
            ended = members & ends.get(depth, 0)
            left = members & ~ended
            known = where > 0 and depth == begin
            over = [conv[b] for b in _bits(left)] if depth == stop and left else None
            out.append((which, where, len(out), known, depth, _signed(k1), _signed(k2), _signed(p1), _signed(p2),
                        conv[(members & -members).bit_length() - 1], members.bit_count(), ended.bit_count(),
                        ",".join(str(conv[b]) for b in _bits(ended)) if ended else None, size_here, over))
            if depth == stop:
                continue
            children = []
            while left:
                g = says[(depth + 1) * shard + (left & -left).bit_length() - 1]
                child = members & postings[g]
                left &= ~child
                children.append((depth + 1, (k1 + gx[g]) & MASK, (k2 + gy[g]) & MASK, k1, k2, child, gsize[g]))
            stack.extend(reversed(children))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LOCAL.split(", ")])

    return walk


def _subtrees(unit: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of a unit, and the smallest member of each node's parent."""
    unit = unit.sort_values("pre")
    depth = unit["depth"].to_numpy()
    stop, parent, path = np.full(len(unit), len(unit)), np.full(len(unit), -1), []
    for i, d in enumerate(depth.tolist()):
        while path and depth[path[-1]] >= d:
            stop[path.pop()] = i
        if path:
            parent[i] = path[-1]
        path.append(i)
    out = unit[NODE].copy()
    for c in ("saved", "leaves"):
        total = np.append(0, np.cumsum(unit[c].to_numpy(np.int64)))
        out[c] = total[stop] - total[:-1]
    above = pd.array(unit["conv_id"].to_numpy(np.int64)[parent], dtype="Int64")
    above[parent < 0] = pd.NA
    out["parent_conv_id"] = above
    return out[~unit["first"].to_numpy(bool)]


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of end lists whose parts come in order; holds one key's state at a time."""
    key, state, found = None, None, []
    for batch in batches:
        for *here, part in batch[[*NODE, "ends"]].itertuples(index=False):
            if here != key:
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = here, hashlib.sha256()
            else:
                state.update(b",")
            state.update(part.encode())
        yield pd.DataFrame(found, columns=[*NODE, "ends_sha256"])
        found = []
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*NODE, "ends_sha256"])


def prefix_trie(convs: DataFrame, turns: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """One row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``convs`` has ``conv_id, n`` (turns, may be 0), ``turns`` has ``conv_id, pos, a, b, bytes``
    with positions 1 to n.  The node of depth 0 is the root with all conversations; there is
    none where there are no conversations.  A leaf has no children; ``saved_tokens`` adds
    (members - 1) times the bytes of the last text over the subtree; ``ends_sha256`` is of the
    sorted ids, joined by commas, of the members that end at the node.
    """
    units = _units(convs, turns, shard, band)
    local = materialize(units.groupBy("shard", "band").applyInPandas(_walk(shard, band), LOCAL), "trie-local")
    nodes = materialize(
        local.where("not first").groupBy(*NODE).agg(
            F.min("low").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("n_ends").alias("_ends"),
            F.max("bytes").alias("_bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2")), "trie-nodes")
    # the shard with the smallest member owns what the node adds to subtree sums
    worth = nodes.select(*NODE, "conv_id", ((F.col("n_convs") - 1) * F.col("_bytes")).alias("saved"),
                         (F.col("_ends") == F.col("n_convs")).cast("long").alias("leaves"))
    own = ~F.col("first") & (F.col("low") == F.col("conv_id"))
    owned = materialize(
        local.select("shard", "band", "pre", "first", *NODE, "low").join(worth, NODE).select(
            "shard", "band", "pre", "first", *NODE, "low", "conv_id",
            *[F.when(own, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("saved", "leaves")]), "trie-owned")
    over = local.where("over is not null").select("shard", "band", "pre", F.explode("over").alias("low"))
    bands = owned.where("band > 0").groupBy("low", "band").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    zero = F.lit(0).cast("long")
    # band 0 asks too, so it is a row of each conversation's running sum, from the last band to the first
    asked = bands.unionByName(over.select("low", "band", zero.alias("saved"), zero.alias("leaves"))).groupBy(
        "low", "band").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    later = _running(asked, "low", ["-band"], ["saved", "leaves"])
    tails = over.join(later, ["low", "band"]).groupBy("shard", "band", "pre").agg(
        F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
    whole = owned.join(tails, ["shard", "band", "pre"], "left").select(
        "shard", "band", "pre", "first", *NODE, "conv_id", (F.col("saved") + F.coalesce("_s", zero)).alias("saved"),
        (F.col("leaves") + F.coalesce("_l", zero)).alias("leaves"))
    sums = whole.groupBy("shard", "band").applyInPandas(
        _subtrees, "depth long, k1 long, k2 long, saved long, leaves long, parent_conv_id long").groupBy(*NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.max("parent_conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    lists = (local.where("ends is not null").select(*NODE, "shard", "ends").repartition(*NODE)
             .sortWithinPartitions(*NODE, "shard").mapInPandas(_ends, "depth long, k1 long, k2 long, ends_sha256 string"))
    return nodes.join(sums, NODE).join(below, NODE, "left").join(lists, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """The trie of the conversations as they are; null, equal and repeated rows as in
    ``positioned``, other columns are not read, an empty table gives an empty result."""
    turns = positioned(conversations)
    return prefix_trie(lengths(turns), turns, shard, band)


def rebuilt_trie(conversations: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """The trie of the rebuilt conversations (``rebuilt``); odd input as in ``positioned``."""
    return prefix_trie(*rebuilt(materialize(positioned(conversations), "trie-positioned")), shard, band)


ORACLE = """
with recursive steps(i, v, k) as (
  select i, i, 0 from range(256) t(i)
  union all select i, case when v & 1 = 1 then xor(3988292384::bigint, v >> 1) else v >> 1 end, k + 1 from steps where k < 8),
crc_table as (select list(v order by i) as l from steps where k = 8),
placed as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(coalesce(role, '') || '|' || coalesce(text, ''))) as pos,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as h, strlen(coalesce(text, '')) as bytes
  from conversations where conv_id is not null),
convs as (
  select conv_id, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(
           range(0, length(conv_id::varchar)), lambda i: ascii(substr(conv_id::varchar, i + 1, 1))::bigint)),
           lambda x, y: xor(x >> 8, l[(xor(x, y) & 255) + 1]))) % 9 as h
  from (select distinct conv_id from placed), crc_table),
own as (
  select c.conv_id, 0 as src, p.pos, p.h, p.bytes from convs c join placed p on p.conv_id = c.conv_id - c.conv_id % 5 and p.pos <= c.h
  union all select c.conv_id, 1, p.pos, p.h, p.bytes from convs c join placed p on p.conv_id = c.conv_id and p.pos > c.h),
turns as (select conv_id, bytes, h, row_number() over (partition by conv_id order by src, pos) as depth from own),
paths as (
  select conv_id, depth, bytes, string_agg(h, '') over (partition by conv_id order by depth) as path from turns
  union all select conv_id, 0, 0, '' from convs),
last as (select conv_id, max(depth) as n from paths group by conv_id),
nodes as (
  select p.path, any_value(p.depth) as depth, any_value(p.bytes) as bytes, min(p.conv_id) as conv_id, count(*) as n_convs,
         count(*) filter (where l.n = p.depth) as n_ends,
         string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (where l.n = p.depth) as ends
  from paths p join last l using (conv_id) group by p.path),
sums as (
  select v.path, sum((u.n_convs - 1) * u.bytes) as saved, count(*) filter (where u.n_ends = u.n_convs) as n_leaves
  from nodes u join paths v on v.conv_id = u.conv_id and v.depth <= u.depth group by v.path),
kids as (select left(path, length(path) - 32) as path, count(*) as n from nodes where depth > 0 group by 1)
select n.conv_id::bigint as conv_id, n.depth::bigint as depth, p.conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs,
       coalesce(k.n, 0)::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens,
       sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join sums s using (path) left join kids k using (path)
left join nodes p on n.depth > 0 and p.path = left(n.path, length(n.path) - 32)
"""
