r"""Chat formatting of reply trees.

Messages name the message they answer.  Iterative self-joins double the step that every
message looks up its tree by: after k rounds it knows its ancestor 2^k steps above, and the
score and length of the branch so far.  Leaves are ranked by the mean score of their branch,
the steps are then followed down from the chosen leaves alone, which lists each chosen path once,
and a path becomes one conversation.

A turn is ``<s>[INST]role[/INST]text</s>``.  In roles and texts every control string gets a
backslash after its first character, and one more where it already has some, so no control
string is left inside and taking one backslash away restores the text.  The loss mask gives for
each turn how many code points come before the trained text and how many it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.operators.graph import dense_ids

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What follows the first character of a control string; ``<|...|>`` covers other templates' marks.
REST = r"(?=/?s>|/?INST\]|</?SYS>>|\|)"
TRAINED = "assistant"
KEY = ["_c", "_none"]


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + REST, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + REST, "$1$2")


def _keyed(df: DataFrame, conv: str = "conv_id") -> list[Column]:
    """A conversation as two columns that join null with null."""
    c = F.col(conv).cast("long")
    return [F.coalesce(c, F.lit(0)).alias("_c"), c.isNull().alias("_none")]


def branches(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves with their branch's ``length`` and ``total`` score, and the steps of every round.

    ``links`` has ``_c, _none, msg, parent, score``, one row per message.  A message whose
    parent is null or absent is a root.  What hangs from a circle of replies has no root and is
    no branch.
    """
    names = links.select(*KEY, F.col("msg").alias("parent"), F.lit(True).alias("_there"))
    base = links.join(names, [*KEY, "parent"], "left").select(
        *KEY, "msg", F.when(F.col("_there"), F.col("parent")).alias("up"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("length"))
    base = materialize(base, "chat-links")
    most = base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    now, steps, reach = base, [], 1
    while reach <= most:
        open_ = now.where("up is not null")
        step = materialize(open_.select(*KEY, "msg", "up"), "chat-steps")
        if step.isEmpty():
            break
        steps.append(step)
        above = now.select(*KEY, F.col("msg").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_t"),
                           F.col("length").alias("_l"))
        further = open_.join(above, [*KEY, "up"]).select(
            *KEY, "msg", F.col("_up").alias("up"), (F.col("total") + F.col("_t")).alias("total"),
            (F.col("length") + F.col("_l")).alias("length"))
        now = materialize(now.where("up is null").unionByName(further), "chat-branches")
        reach *= 2
    answered = base.where("up is not null").select(*KEY, F.col("up").alias("msg"))
    # what still has somebody above after so many steps goes round in a circle
    leaves = now.where("up is null").join(answered, [*KEY, "msg"], "left_anti")
    return leaves.select(*KEY, F.col("msg").alias("leaf"), "total", "length"), steps


def chosen_paths(links: DataFrame, keep: int = 1) -> DataFrame:
    """``_c, _none, leaf, rank, score, msg, place`` of the first ``keep`` branches of each
    conversation: higher mean score first, then the smaller leaf.  Places count from 0 at the root."""
    leaves, steps = branches(links)
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "leaf")
    best = leaves.withColumn("score", F.col("total") / F.col("length")).withColumn("rank", F.row_number().over(order))
    paths = best.where(F.col("rank") <= keep).select(
        *KEY, "leaf", "rank", "score", F.col("leaf").alias("msg"), (F.col("length") - 1).alias("place"))
    for k, step in enumerate(steps):
        above = paths.join(step, [*KEY, "msg"]).select(
            *KEY, "leaf", "rank", "score", F.col("up").alias("msg"), (F.col("place") - 2 ** k).alias("place"))
        paths = paths.unionByName(above)
        paths = materialize(paths, "chat-paths")
    return paths


def formatted(turns: DataFrame, by: Sequence[str]) -> DataFrame:
    """One conversation per group: ``formatted``, and ``loss`` with ``skip, take`` per turn.

    ``turns`` has the columns ``by``, ``place, role, text``; a null role or text counts as the
    empty one.  A conversation is one value, so it has to fit a cell.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head, body = F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE)), escape(text)
    rows = turns.select(*by, "place", F.concat(head, body, F.lit(CLOSE)).alias("said"),
                        F.char_length(head).alias("skip"),
                        F.when(role == TRAINED, F.char_length(body)).otherwise(F.lit(0)).alias("take"))
    one = F.sort_array(F.collect_list(F.struct("place", "said", "skip", "take")))
    return rows.groupBy(*by).agg(one.alias("_t")).select(
        *by, F.array_join(F.transform("_t", lambda t: t["said"]), "").alias("formatted"),
        F.transform("_t", lambda t: F.struct(t["skip"].alias("skip"), t["take"].alias("take"))).alias("loss"))


def read_back(done: DataFrame, *keep: str) -> DataFrame:
    """``turns`` (role, text) and ``trained`` (all text under the mask), from the output alone."""
    said = F.split("formatted", CLOSE, -1)
    at = lambda t: F.locate(MIDDLE, t)
    start = len(OPEN) + 1
    turns = F.transform("_said", lambda t: F.struct(
        unescape(t.substr(F.lit(start), at(t) - start)).alias("role"),
        unescape(t.substr(at(t) + len(MIDDLE), F.char_length(t))).alias("text")))
    trained = F.array_join(F.zip_with("_said", "loss", lambda t, m: unescape(t.substr(m["skip"] + 1, m["take"]))), "")
    return done.withColumn("_said", F.slice(said, F.lit(1), F.size(said) - 1)).select(
        *keep, "formatted", turns.alias("turns"), trained.alias("trained"))


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """``conv_id, leaf, rank, score, formatted, loss``: the best ``keep`` branches of every conversation.

    ``messages`` has ``conv_id, msg_id, parent_id, role, text, score``.  Messages without conversation id
    are a conversation of their own; a message without id is left out, as nothing can answer it or
    name it; of rows that share an id the first by parent, role, text and score stays; a null
    score is 0.  Other columns are not read; an empty table gives an empty result.
    """
    named = messages.where("msg_id is not null").select(
        *_keyed(messages), F.col("msg_id").alias("msg"), F.col("parent_id").alias("parent"), "role", "text", "score")
    first = F.min(F.struct("parent", "role", "text", "score"))
    named = materialize(named.groupBy(*KEY, "msg").agg(first.alias("_f")).select(*KEY, "msg", "_f.*"), "chat-messages")
    paths = chosen_paths(named.select(*KEY, "msg", "parent", "score"), keep)
    turns = named.select(*KEY, "msg", "role", "text").join(paths, [*KEY, "msg"])
    out = formatted(turns, [*KEY, "leaf", "rank", "score"])
    return out.select(F.when(~F.col("_none"), F.col("_c")).alias("conv_id"), "leaf", "rank", "score", "formatted", "loss")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: conversations whose turns answer one another in order.

    Every distinct turn is a message that answers the one before it by ``turn`` (null first; equal
    turns by a hash of role and text), so a conversation is a tree of one branch.  Rows that repeat
    turn, role and text stand next to each other, once per row.  Rows without ``conv_id`` are one
    conversation; other columns are not read; an empty table gives an empty result.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    same = ["_a", "_b"]
    rows = conversations.select(*_keyed(conversations), F.col("turn").alias("_turn"), role.alias("role"), text.alias("text"),
                                F.xxhash64(role, text).alias("_a"), F.xxhash64(F.lit(17), text, role).alias("_b"))
    slim = rows.select(*KEY, "_turn", *same).distinct()
    named = materialize(dense_ids(slim, KEY, ["_turn", *same], "msg"), "chat-turns")
    paths = chosen_paths(named.select(*KEY, "msg", F.when(F.col("msg") > 0, F.col("msg") - 1).alias("parent"),
                                      F.lit(0.0).alias("score")))
    placed = named.join(paths.select(*KEY, "msg", "place"), [*KEY, "msg"]).select(
        *[F.col(c).alias(f"p{c}") for c in (*KEY, "_turn", *same)], "place")
    match = F.col("_turn").eqNullSafe(F.col("p_turn"))
    for c in (*KEY, *same):
        match = match & (F.col(c) == F.col(f"p{c}"))
    turns = rows.join(placed, match).select(*KEY, "place", "role", "text")
    return formatted(turns, KEY).select(F.when(~F.col("_none"), F.col("_c")).alias("conv_id"), "formatted", "loss")


def format_report(conversations: DataFrame) -> DataFrame:
    """Digests of turns and trained text, read back from the formatted conversations."""
    done = read_back(format_turns(conversations), "conv_id")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one of id -1, a user and an assistant who say control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(TRAINED)).alias("role"), said.alias("text"))
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.col("role"), F.col("text"))
    return given.unionByName(probe)


ORACLE = r"""
with rows as (
  select conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|)', '\1\\\2\3', 'g') as r,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|)', '\1\\\2\3', 'g') as t from rows)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(r) + length(t) + length('<s>[INST][/INST]</s>'))::bigint as formatted_chars
from escaped group by conv_id
"""
