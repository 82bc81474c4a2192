"""Text expressions: sentences, tokens, keys and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
NUMBER_PATTERN = r"^[0-9]+$"
# Sentence id patterns of the named corpora.
DOC_KEY_PATTERNS = {
    "bio": r"pmid_(\d+_\d+)\.(\d+)",
    "little-prince": r"^lpp_([0-9]+)\.(\d+)",
    "proxy-report": r"^PROXY[A-Z_]+_([0-9_]+)\.(\d+)",
}


def split_sentences(text: Column) -> Column:
    """Array of the sentences of a text: lines, cut after ``.``, ``!`` and ``?``."""
    cut = F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n")
    trimmed = F.transform(F.split(cut, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r]+", " ")))
    return F.filter(trimmed, lambda s: s != "")


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def doc_key(sent_id: Column, pattern: str) -> Column:
    """Document id and sentence number in a sentence id; null when it has another form."""
    key = F.regexp_extract(sent_id, pattern, 1)
    number = F.regexp_extract(sent_id, pattern, 2)
    return F.struct(F.when(key != "", key).alias("doc_id"),
                    F.when(number != "", number).cast("int").alias("sent_no"))


def shorten(text: Column, width: int = 20, placeholder: str = " [...]") -> Column:
    """Text cut at a word boundary so that it fits the width, marked as cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    room = width - len(placeholder)
    words = F.regexp_extract(F.concat(flat, F.lit(" ")), r"^(.{1," + str(room) + r"})(?=\s)", 1)
    cut = F.when(words == "", F.lit(placeholder.strip())).otherwise(
        F.concat(F.rtrim(words), F.lit(placeholder)))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)


def describe_node(attrib_type: Column, variable: Column, instance: Column, constant: Column,
                  text: Column, name: Column, level: Column) -> Column:
    """Display text of a node by its type."""
    return (F.when(attrib_type == "concept", F.concat_ws("/", variable, instance))
            .when(attrib_type == "attribute", constant)
            .when(attrib_type == "sentence", shorten(text))
            .when(attrib_type == "doc", F.concat(name, F.lit(" ("), level, F.lit(")")))
            .otherwise(name))


def describe_edge(edge_type: Column, role: Column, relation: Column, sent_ix: Column) -> Column:
    """Display text of an edge: role label, or relation with sentence index."""
    return (F.when(edge_type == "role", role)
            .when(edge_type == "sentence", F.concat(relation, F.lit("["), sent_ix.cast("string"), F.lit("]")))
            .otherwise(F.coalesce(relation, F.lit(""))))


def token_spans(tokens: Column) -> Column:
    """JSON ``[["text",[begin,end]],...]`` of token structs; null when there are none."""
    one = F.transform(tokens, lambda t: F.concat(
        F.lit("["), F.regexp_extract(F.to_json(F.array(t["norm"])), r"^\[(.*)\]$", 1), F.lit(",["),
        t["begin"].cast("string"), F.lit(","), t["end"].cast("string"), F.lit("]]")))
    return F.when(F.size(tokens) > 0, F.concat(F.lit("["), F.array_join(one, ","), F.lit("]")))


def constant_value(constant: Column) -> Column:
    """Evaluated constant: quotes removed, number as double, and a type tag."""
    quoted = constant.rlike(r'^".*"$')
    whole = constant.rlike(r"^[+-]?[0-9]+$")
    real = constant.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.struct(
        F.when(quoted, F.regexp_extract(constant, r'^"(.*)"$', 1)).otherwise(constant).alias("text"),
        F.when(real, constant.cast("double")).alias("number"),
        F.when(constant.isNull(), "null").when(quoted, "string").when(whole, "integer")
        .when(real, "float").otherwise("symbol").alias("kind"))
