"""Chat formatting: round trips, paths against a plain walk, odd trees, no Python on the path."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat_format as C

TURNS = "conv_id long, turn int, role string, text string, msg string, PLACE int"
TREES = "conv_id long, msg_id long, parent_id long, role string, text string, score double, up int"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "<", "[", "\\", "<\\", "[\\\\", "|", "s>", "/INST]",
          "é", "\n", " ", "😀", "a", "$1", "\\\\"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def texts(seed, n):
    rng = random.Random(seed)
    return [None, "", *["".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(n)]]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 3000)) if t is not None]
    df = spark.createDataFrame(rows, "i int, t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", C.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(p in r["e"] for p in PIECES[:7] + ["<|"])


def test_report_against_plain_reading(spark):
    rng, said = random.Random(2), texts(3, 500)
    rows = [(c, rng.choice([None, t, t]) if c % 7 == 0 and t == 0 else t, rng.choice(["user", "assistant", None, "[/INST]", "x</s>"]),
             rng.choice(said), "m", 1) for c in range(60) for t in range(rng.randint(1, 11))]
    rows += [(None, t, "assistant", f"n{t}", "", 0) for t in range(3)] + [(500, 1, "assistant", "twice", "", 0)] * 3
    rows += [(501, t, "assistant", str(t), "", 0) for t in range(70)]
    got = {r["conv_id"]: r for r in C.format_report(C.with_probe(spark, spark.createDataFrame(rows, TURNS).repartition(4))).collect()}
    want = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        want[c].append((turn is not None, turn or 0, role or "", text or ""))
    want[-1] = [(True, 0, "user", "</s>[INST] ok [/INST]"), (True, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = sorted(turns)
        r, loss = got[c], "".join(t for _, _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha("".join(f"{a}\n{t}\n" for *_, a, t in turns))
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == sha(loss)
        assert r["formatted_chars"] >= sum(len(a) + len(t) + 20 for *_, a, t in turns)


def plain_paths(rows, keep):
    """Leaves of each conversation by mean score along the way to the root."""
    by = collections.defaultdict(dict)
    for c, m, p, role, text, score, _ in rows:
        if m is not None:
            by[c][m] = (p, role or "", text or "", score or 0.0)
    out = {}
    for c, msgs in by.items():
        parents = {p for p, *_ in msgs.values()}
        found = []
        for leaf in set(msgs) - parents:
            path, at = [], leaf
            while at in msgs and at not in path:
                path.append(at)
                at = msgs[at][0]
            if at not in path:
                found.append((-sum(msgs[m][3] for m in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:keep], 1):
            out[c, leaf] = rank, [msgs[m][1:3] for m in path]
    return out


@pytest.mark.parametrize("keep", [1, 3])
def test_trees_against_plain_walk(spark, keep):
    rng, said = random.Random(4), texts(5, 200)
    rows = []
    for c in [None, *range(40)]:
        for m in range(rng.randint(1, 30)):
            parent = rng.choice([None, m - 1, m - 1, rng.randint(0, m)]) if m else None
            rows.append((c, m, None if parent == m else parent, rng.choice(["user", "assistant"]), rng.choice(said),
                         rng.choice([None, 1.0, 2.0, 4.0]), 0))
    rows += [(900, 1, 2, "user", "a", 1.0, 0), (900, 2, 1, "user", "b", 1.0, 0), (900, 3, 2, "user", "hangs", 1.0, 0),
             (900, 5, 77, "user", "orphan", 1.0, 0), (900, None, 5, "user", "nameless", 1.0, 0)]
    rows += [(901, m, m - 1 if m else None, "assistant", f"{m}", 1.0, 0) for m in range(40)]
    got = C.format_trees(spark.createDataFrame(rows, TREES), keep)
    want = plain_paths(rows, keep)
    back = {(r["conv_id"], r["leaf"]): (r["rank"], [(t["role"], t["text"]) for t in r["turns"]])
            for r in C.read_back(got, "conv_id", "leaf", "rank").collect()}
    assert back == want and (900, 5) in back and not any(k[0] == 900 and k[1] != 5 for k in back)


def test_repeated_messages_long_texts_and_empty_tables(spark):
    long = "<s>é" * 200_000
    rows = [(1, 1, None, "assistant", long, None, 0)] * 2 + [(1, 2, 1, "user", "b", 1.0, 0), (1, 2, 1, "user", "a", 1.0, 0)]
    r, = C.read_back(C.format_trees(spark.createDataFrame(rows, TREES)), "conv_id").collect()
    assert [tuple(t) for t in r["turns"]] == [("assistant", long), ("user", "a")] and r["trained"] == long
    assert C.format_trees(spark.createDataFrame([], TREES)).collect() == []
    assert C.format_report(spark.createDataFrame([], TURNS)).collect() == []


def test_plan_has_no_python(spark):
    df = C.format_report(spark.createDataFrame([(1, 1, "user", "a", "", 0)], TURNS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
