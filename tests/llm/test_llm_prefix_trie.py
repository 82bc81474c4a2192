"""Prefix trie: nodes against a plain walk over all prefixes, in one unit and in many."""

import collections
import hashlib
import random
import zlib

import pytest

from weftgraph.llm import prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string, pos string, A string, shard int"


def rebuilt(rows):
    """Conversations by id, each with the first turns of another."""
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def nodes(convs):
    """Every prefix with its contract's columns, by comparing all prefixes with all."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, mine in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in mine if len(convs[c]) == len(p)))
        out.append((min(mine), len(p), min(members[p[:-1]]) if p else None, len(mine), kids[p], sum(not kids[q] for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed, n=60, most=14):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for turn in range(rng.randint(1, most)):
            text = rng.choice([None, "", "é", "a b", "common", f"own {c}" if turn > 4 else "common"])
            out.append((c, turn, rng.choice(["user", "user", None, "assistant"]), text, "x", "y", 1))
    long = [(n + 4, t, "user", f"same {t}", "x", "y", 1) for t in range(70)]
    return out + long + [(n + 5, t, r, s, *more) for _, t, r, s, *more in long[:55]] + [
        (None, 1, "user", "nobody", "x", "y", 1), (n + 9, None, "user", "no turn", "x", "y", 1), (-3, 0, "user", "minus", "x", "y", 1)]


@pytest.mark.parametrize(("seed", "shard", "band"), [(1, 2048, 128), (2, 8, 4), (3, 16, 1)])
def test_rebuilt_trie_against_all_prefixes(spark, seed, shard, band):
    data = rows(seed)
    got = T.rebuilt_trie(spark.createDataFrame(data, SCHEMA).repartition(5), shard, band).collect()
    assert sorted(map(tuple, got), key=str) == nodes(rebuilt(data))


def test_hot_conversations_and_repeated_rows(spark):
    data = [(c, t, "user", f"t{t}", "", "", 0) for c in range(40) for t in range(6)]
    data += [(3, 2, "user", "t2", "", "", 0)] * 2 + [(100, t, "user", "again", "", "", 0) for t in range(120)]
    got = T.rebuilt_trie(spark.createDataFrame(data, SCHEMA), 8, 16).collect()
    assert sorted(map(tuple, got), key=str) == nodes(rebuilt(data))
    plain = collections.defaultdict(list)
    for c, turn, role, text, *_ in sorted(data):
        plain[c].append((role, text))
    got = T.conversation_trie(spark.createDataFrame(data, SCHEMA), 8, 16).collect()
    assert sorted(map(tuple, got), key=str) == nodes(plain)


def test_long_text_and_empty_table(spark):
    long = "é" * 300_000
    got = T.conversation_trie(spark.createDataFrame([(1, 1, "user", long, "", "", 0), (2, 1, "user", long, "", "", 0)], SCHEMA)).collect()
    assert sorted((r["depth"], r["n_convs"], r["saved_tokens"]) for r in got) == [(0, 2, 600_000), (1, 2, 600_000)]
    assert T.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
