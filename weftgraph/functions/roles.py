"""Role labels, the relation dictionary and frame look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.skew import join_salted

ROLE_PATTERN = r"^:([A-Za-z-]+?)(\d+)?(-of)?$"
ROLESET_PATTERN = r"-[0-9]+$"
# Role names whose final "-of" is part of the name.
NAMES_ENDING_IN_OF = ("prep-on-behalf-of", "prep-out-of")


def parse_role(label: Column) -> Column:
    """Struct of prefix, index and inverted flag of a role label.

    A label without a leading colon (or none) has null parts and is a failure of its
    document (``role_failures``); one that does not fit the pattern keeps its text
    (without the colon) as the prefix.
    """
    checked = F.when(label.startswith(":"), label)
    bare = F.regexp_replace(checked, "^:", "")
    whole = bare.isin(*NAMES_ENDING_IN_OF) | ~checked.rlike(ROLE_PATTERN)
    prefix = F.when(whole, bare).otherwise(F.regexp_extract(checked, ROLE_PATTERN, 1))
    digits = F.when(whole, F.lit("")).otherwise(F.regexp_extract(checked, ROLE_PATTERN, 2))
    inverted = F.when(whole, F.lit(False)).otherwise(
        F.regexp_extract(checked, ROLE_PATTERN, 3) != "")
    return F.struct(
        prefix.alias("role_prefix"),
        F.when(digits != "", digits).cast("int").alias("role_index"),
        inverted.alias("role_inverted"))


def role_failures(edges: DataFrame) -> DataFrame:
    """Failure rows of documents with a role edge whose label has no leading colon."""
    bad = edges.where("edge_type = 'role' and (role is null or not startswith(role, ':'))")
    return bad.groupBy("doc_id").agg(F.min(F.coalesce("role", F.lit("null"))).alias("_r")).select(
        "doc_id", F.lit("role").alias("stage"),
        F.concat(F.lit("role must start with a colon: "), F.col("_r")).alias("message"))


PLAIN_PATTERN = r"^\^[A-Za-z0-9:_-]+\$$"


def lookup_relation(edges: DataFrame, relations: DataFrame, block: int = 4096) -> DataFrame:
    """First relation in dictionary order whose pattern matches the edge's role.

    Only the *distinct* labels are matched.  Patterns that are one fixed text
    (``^:text$``) meet their label in an equality join.  The others are tested as regular
    expressions, ``block`` of them at a time, each block broadcast: its size is
    bounded by the number of rows and by patterns being short.
    """
    labels = edges.select("role").where(F.col("role").isNotNull()).distinct()
    named = relations.select("ord", "label", "pattern")
    plain = named.where(F.col("pattern").rlike(PLAIN_PATTERN)).withColumn(
        "role", F.expr("substring(pattern, 2, length(pattern) - 2)"))
    hits = labels.join(plain, "role").select("role", "ord", "label")
    other = named.where(~F.col("pattern").rlike(PLAIN_PATTERN))
    parts = -(-other.count() // block)
    for i in range(parts):
        some = other.where(F.pmod(F.xxhash64("pattern", "ord"), F.lit(parts)) == i)
        hits = hits.unionByName(labels.join(F.broadcast(some), F.expr("role rlike pattern"))
                                .select("role", "ord", "label"))
    matched = hits.groupBy("role").agg(F.min_by("label", "ord").alias("relation"), F.min("ord").alias("relation_ord"))
    return join_salted(edges, matched, ["role"], ["doc_id", "edge_id"], "left")


def is_roleset(instance: Column) -> Column:
    return instance.rlike(ROLESET_PATTERN)


def lookup_roleset(nodes: DataFrame, rolesets: DataFrame) -> DataFrame:
    """Frame of each concept instance with a frame number; null when unknown."""
    keyed = nodes.withColumn(
        "roleset_id", F.when((F.col("attrib_type") == "concept") & is_roleset(F.col("instance")),
                             F.col("instance")))
    named = rolesets.withColumn("roleset_found", F.lit(True))
    joined = join_salted(keyed, named, ["roleset_id"], ["doc_id", "component", "node_id"], "left")
    return joined.withColumn(
        "roleset_id", F.when(F.col("roleset_found"), F.col("roleset_id"))).drop("roleset_found")
