"""Node and edge tables from parsed sentence graphs or from plain text.

Ids are computed from the sentence number and the position inside it, so they are
the same on every run and need no numbering over a whole document:
``(sent_ix + 1) * 2^24 + position``; document nodes have small ids, the root 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.functions.roles import is_roleset, parse_role
from weftgraph.lineage import materialize
from weftgraph.operators.graph import KEY
from weftgraph.skew import join_salted

SENT = [*KEY, "sent_ix"]
NODE_COLUMNS = [*KEY, "node_id", "attrib_type", "sent_ix", "variable", "instance", "constant",
                "role", "path", "descr", "token_ix", "is_root", "roleset_id"]
EDGE_COLUMNS = [*KEY, "edge_id", "parent_id", "child_id", "edge_type", "role", "relation",
                "role_prefix", "role_index", "role_inverted", "token_ix"]
SENTENCE_SHIFT = 24
PART_SHIFT = 20


def _below(value: Column, bits: int, what: str) -> Column:
    """The value, or an error where it would run into the next id."""
    return F.when((value < F.lit(1 << bits)) | value.isNull(), value).otherwise(
        F.raise_error(F.concat(F.lit(f"more than 2^{bits} {what}: "), value.cast("string"))).cast("long"))


def sentence_base(sent_ix: Column) -> Column:
    return F.shiftleft(_below(sent_ix.cast("long") + 1, 63 - SENTENCE_SHIFT, "sentences in a document"), SENTENCE_SHIFT)


def inner_id(sent_ix: Column, position: Column) -> Column:
    """Id of the node at a position of a sentence; the id after it is still the sentence's."""
    return sentence_base(sent_ix) + _below(position.cast("long") + 2, SENTENCE_SHIFT, "nodes in a sentence") - 1


def sentence_number(part_ix: Column, position: Column) -> Column:
    """Number of a sentence over the parts of its document."""
    part = _below(part_ix.cast("long"), 63 - SENTENCE_SHIFT - PART_SHIFT - 1, "parts in a document")
    return F.shiftleft(part, PART_SHIFT) + _below(position.cast("long"), PART_SHIFT, "sentences in a part")


#: Names of a sentence that are looked up in its own row; a sentence with more is joined by name.
ROW_NAMES = 256


def explode_triples(sentences: DataFrame, *more: str) -> DataFrame:
    """One row per triple of the sentences' graphs, with its position."""
    return sentences.select(*SENT, *more, F.posexplode("triples").alias("pos", "t")).select(
        *SENT, *more, "pos", F.col("t.source").alias("variable"), F.col("t.role").alias("role"),
        F.col("t.target").alias("target"), F.col("t.token_ix").alias("token_ix"),
        F.col("t.role_token_ix").alias("role_token_ix"))


def _row_names() -> Column:
    """Variables of the row's instance triples with their nodes; none where a part of the key is null."""
    placed = F.transform("triples", lambda t, i: F.struct(
        t["source"].alias("variable"), t["role"].alias("role"), i.alias("pos")))
    names = F.transform(F.filter(placed, lambda t: t["role"] == ":instance"), lambda t: F.struct(
        t["variable"].alias("variable"), inner_id(F.col("sent_ix"), t["pos"]).alias("node_id")))
    known = F.col("doc_id").isNotNull() & F.col("component").isNotNull() & F.col("sent_ix").isNotNull()
    return F.when(known, names).otherwise(F.filter(names, lambda n: F.lit(False)))


def _named(names: str, variable: str) -> Column:
    """Nodes of the names that are equal to a column."""
    return F.transform(F.filter(names, lambda n: n["variable"] == F.col(variable)), lambda n: n["node_id"])


def link_names(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples with ``heads`` and ``tails``, the nodes that a triple's variable and its target name in the
    sentence, and sentences with ``tops``, those that ``top`` names.

    Names are looked up in the sentence's own row, so triples are not shuffled.  Sentences of which
    several rows have the key, or that have more than ``ROW_NAMES`` names, are joined by key and name.
    """
    odd = materialize(sentences.groupBy(*SENT).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.filter(
        "triples", lambda t: t["role"] == ":instance"))).alias("w")).where(f"n > 1 or w > {ROW_NAMES}").select(*SENT), "odd-sentences")
    all_plain = odd.isEmpty()
    plain = sentences if all_plain else join_salted(sentences, odd, SENT, ["text"], "left_anti")
    named = plain.withColumn("_names", _row_names())
    triples = (explode_triples(named, "_names").withColumn("heads", _named("_names", "variable"))
               .withColumn("tails", _named("_names", "target")).drop("_names"))
    tops = named.withColumn("tops", _named("_names", "top")).drop("_names")
    if all_plain:
        return triples, tops
    rows = join_salted(sentences, odd, SENT, ["text"], "left_semi")
    other = explode_triples(rows)
    names = _variables(other).groupBy(*SENT, "variable").agg(F.collect_list("node_id").alias("_ids"))

    def linked(table: DataFrame, column: str, out: str) -> DataFrame:
        ids = names.withColumnsRenamed({"variable": column, "_ids": out})
        return table.join(ids, [*SENT, column], "left").withColumn(out, F.coalesce(out, F.array().cast("array<bigint>")))

    joined = linked(linked(other, "variable", "heads"), "target", "tails")
    return triples.unionByName(joined), tops.unionByName(linked(rows, "top", "tops"))


def _node_id() -> Column:
    return inner_id(F.col("sent_ix"), F.col("pos"))


def concept_nodes(triples: DataFrame) -> DataFrame:
    """One concept per instance triple."""
    inst = triples.where("role = ':instance'")
    return inst.select(
        *SENT, _node_id().alias("node_id"), F.lit("concept").alias("attrib_type"), "variable",
        F.col("target").alias("instance"), "token_ix",
        F.concat_ws("/", "variable", "target").alias("descr"), F.lit(False).alias("is_root"),
        F.when(is_roleset(F.col("target")), F.col("target")).alias("roleset_id"))


def _variables(triples: DataFrame) -> DataFrame:
    return triples.where("role = ':instance'").select(*SENT, "variable", _node_id().alias("node_id"))


def role_edges(triples: DataFrame) -> DataFrame:
    """One edge per triple between two variables of the sentence."""
    rel = triples.where("role <> ':instance'").withColumn("parent_id", F.explode("heads"))
    return _role_columns(rel.withColumn("child_id", F.explode("tails")))


def _role_columns(joined: DataFrame) -> DataFrame:
    parsed = joined.withColumn("_r", parse_role(F.col("role")))
    return parsed.select(
        *KEY, (sentence_base(F.col("sent_ix")) + F.col("pos") + 2).alias("edge_id"),
        "parent_id", "child_id", F.lit("role").alias("edge_type"), "role",
        F.col("_r.role_prefix").alias("role_prefix"), F.col("_r.role_index").alias("role_index"),
        F.col("_r.role_inverted").alias("role_inverted"), F.col("role_token_ix").alias("token_ix"))


def attribute_nodes(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Constants: a node and a role edge per triple whose target is no variable."""
    const = triples.where(F.col("role") != ":instance").where(F.size("tails") == 0)
    nodes = const.select(
        *SENT, _node_id().alias("node_id"), F.lit("attribute").alias("attrib_type"), "variable",
        X.constant_value(F.col("target"))["text"].alias("constant"), "role", "token_ix",
        X.constant_value(F.col("target"))["text"].alias("descr"), F.lit(False).alias("is_root"))
    edges = _role_columns(const.withColumn("child_id", _node_id()).withColumn("parent_id", F.explode("heads")))
    return nodes, edges


def sentence_nodes(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentence node with an edge from its document node and one to each of the graph's ``tops``."""
    base = sentences.withColumn("node_id", sentence_base(F.col("sent_ix")))
    nodes = base.select(
        *SENT, "node_id", F.lit("sentence").alias("attrib_type"), X.shorten(F.col("text")).alias("descr"),
        "path", F.lit(False).alias("is_root"))
    above = base.select(*KEY, F.col("node_id").alias("edge_id"), F.col("doc_node").alias("parent_id"),
                        F.col("node_id").alias("child_id"), F.lit("sentence").alias("edge_type"),
                        F.lit("sent").alias("relation"))
    below = base.withColumn("child_id", F.explode("tops")).select(
        *KEY, (F.col("node_id") + 1).alias("edge_id"), F.col("node_id").alias("parent_id"), "child_id",
        F.lit("sentence").alias("edge_type"), F.lit("sent-root").alias("relation"))
    return nodes, above.unionByName(below)


def place_sentences(sentences: DataFrame, intermediate: bool = True) -> DataFrame:
    """Sentences with their document node and its path.

    With intermediate levels a source sentence hangs off ``header`` or ``body-sub``
    of its section; otherwise, and always in the summary, off the root.
    """
    is_header = F.coalesce(F.col("is_header"), F.lit(False)) if "is_header" in sentences.columns \
        else F.lit(False)
    section = F.coalesce(F.col("section_ix"), F.lit(0)) if "section_ix" in sentences.columns else F.lit(0)
    deep = (F.col("component") == "source") & F.lit(intermediate)
    level = F.when(is_header, F.lit("header")).otherwise(F.lit("body-sub"))
    first = section * 3 + 1
    return (sentences
            .withColumn("path", F.when(deep, F.concat_ws(
                ".", "component", F.concat(F.lit("section_"), section.cast("string")), level))
                .otherwise(F.col("component")))
            .withColumn("doc_node", F.when(deep, first + F.when(is_header, 1).otherwise(2))
                        .otherwise(F.lit(0)).cast("long")))


def document_nodes(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Root and section, header and body nodes with their edges.

    Every section has both a header and a body node, also when one holds nothing.
    """
    used = placed.select(*KEY, "path", "doc_node").distinct()
    base = F.floor((F.col("doc_node") - 1) / 3) * 3 + 1
    section_path = F.regexp_replace("path", r"\.(header|body-sub)$", "")
    level = F.array(
        F.struct(section_path.alias("path"), base.alias("node_id"), F.lit(0).cast("long").alias("parent_id")),
        F.struct(F.concat(section_path, F.lit(".header")).alias("path"), (base + 1).alias("node_id"), base.alias("parent_id")),
        F.struct(F.concat(section_path, F.lit(".body-sub")).alias("path"), (base + 2).alias("node_id"), base.alias("parent_id")))
    inner = (used.where("doc_node > 0").select(*KEY, F.explode(level).alias("n"))
             .select(*KEY, "n.*").distinct())
    root = placed.select(*KEY).distinct().select(
        *KEY, F.col("component").alias("path"), F.lit(0).cast("long").alias("node_id"),
        F.lit(None).cast("long").alias("parent_id"))
    both = root.unionByName(inner)
    name = F.regexp_replace(F.element_at(F.split("path", r"\."), -1), r"_[0-9]+$", "")
    nodes = both.select(
        *KEY, "node_id", F.lit("doc").alias("attrib_type"), "path",
        F.concat(name, F.lit(" ("), F.when(F.col("node_id") == 0, F.lit("root")).otherwise(name), F.lit(")"))
        .alias("descr"), (F.col("node_id") == 0).alias("is_root"))
    edges = both.where("parent_id is not null").select(
        *KEY, F.col("node_id").alias("edge_id"), "parent_id", F.col("node_id").alias("child_id"),
        F.lit("doc").alias("edge_type"))
    return nodes, edges


def _conform(parts: list[DataFrame], columns: list[str], types: dict[str, str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*[
        F.col(c) if c in out.columns else F.lit(None).cast(types.get(c, "string")).alias(c)
        for c in columns])


_TYPES = {"sent_ix": "long", "token_ix": "array<int>", "is_root": "boolean", "role_index": "int",
          "role_inverted": "boolean"}


def build_graph(sentences: DataFrame, intermediate: bool = False,
                decorators: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of both components from parsed sentences.

    ``sentences`` has ``doc_id, component, sent_ix, text, top, triples``.  Decorators
    are functions ``(nodes, edges) -> (nodes, edges)`` and run in order.
    """
    triples, topped = link_names(sentences)
    concepts, roles = concept_nodes(triples), role_edges(triples)
    attributes, attribute_edges = attribute_nodes(triples)
    sent_nodes, sent_edges = sentence_nodes(place_sentences(topped, intermediate))
    doc_nodes, doc_edges = document_nodes(place_sentences(sentences, intermediate))
    nodes = _conform([doc_nodes, sent_nodes, concepts, attributes], NODE_COLUMNS, _TYPES)
    edges = _conform([doc_edges, sent_edges, roles, attribute_edges], EDGE_COLUMNS, _TYPES)
    for decorate in decorators or []:
        nodes, edges = decorate(nodes, edges)
    return nodes, edges


# --- plain text ------------------------------------------------------------

def text_sentences(texts: DataFrame) -> DataFrame:
    """Sentences of ``(doc_id, component, part_ix, text)`` rows, numbered over parts."""
    return texts.select(*KEY, "part_ix", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "text")) \
        .select(*KEY, sentence_number(F.col("part_ix"), F.col("pos")).alias("sent_ix"), "text")


def _before(lengths: Column, blocks: Column, width: Column, i: Column) -> Column:
    """Sum of the first i entries, by the sums of blocks of ``width`` entries."""
    def add(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda x, y: x + y)

    full = F.floor(i / width).cast("int")
    return add(F.slice(blocks, 1, F.least(full, F.size(blocks)))) + add(F.slice(lengths, full * width + 1, i % width))


def text_tokens(sentences: DataFrame) -> DataFrame:
    """Token rows with character spans in the single-spaced sentence.

    The spans are running sums inside the sentence's own array (by blocks of the square
    root of its size, for sentences of any length), so nothing is shuffled.
    """
    lengths, blocks = F.col("_len"), F.col("_block")
    width = F.ceil(F.sqrt(F.size(lengths).cast("double") + 1)).cast("int")
    count = F.floor(F.size(lengths) / width).cast("int")
    rows = (sentences.select(*SENT, X.tokenize(F.col("text")).alias("_toks"))
            .withColumn("_len", F.transform("_toks", lambda t: F.length(t) + 1))
            .withColumn("_block", F.transform(F.sequence(F.lit(0), count), lambda b: F.aggregate(
                F.slice(lengths, b * width + 1, width), F.lit(0), lambda x, y: x + y)))
            .withColumn("_begin", F.transform("_toks", lambda _, i: _before(lengths, blocks, width, i))))
    return (rows.select(*SENT, F.posexplode(F.arrays_zip("_toks", "_begin")).alias("ix", "t"))
            .select(*SENT, "ix", F.col("t._toks").alias("norm"), F.col("t._begin").alias("begin"))
            .withColumn("end", F.col("begin") + F.length("norm")))


def text_graph(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of plain text: document, sentences and token nodes.

    Words are concepts and numbers attributes; the tables are those of
    ``build_graph``, so every later operator runs on plain text as well.
    """
    # cut and tokenised once; nodes and edges are read from the written sentences
    sentences = materialize(text_sentences(texts).withColumn("_toks", X.tokenize(F.col("text"))), "text-sentences")
    tokens = sentences.select(*SENT, F.posexplode("_toks").alias("ix", "norm"))
    is_number = F.col("norm").rlike(X.NUMBER_PATTERN)
    token_id = inner_id(F.col("sent_ix"), F.col("ix"))
    token_nodes = tokens.select(
        *SENT, token_id.alias("node_id"),
        F.when(is_number, F.lit("attribute")).otherwise(F.lit("concept")).alias("attrib_type"),
        F.concat(F.lit("t"), F.col("ix").cast("string")).alias("variable"),
        F.when(~is_number, F.col("norm")).alias("instance"),
        F.when(is_number, F.col("norm")).alias("constant"),
        F.when(is_number, F.col("norm")).otherwise(
            F.concat(F.lit("t"), F.col("ix").cast("string"), F.lit("/"), F.col("norm"))).alias("descr"),
        F.array("ix").alias("token_ix"), F.lit(False).alias("is_root"))
    token_edges = tokens.select(
        *KEY, (token_id + 1).alias("edge_id"), sentence_base(F.col("sent_ix")).alias("parent_id"),
        token_id.alias("child_id"), F.lit("role").alias("edge_type"), F.lit(":tok").alias("role"),
        F.lit("tok").alias("role_prefix"), F.lit(False).alias("role_inverted"))
    placed = sentences.withColumn("path", F.col("component")).withColumn("doc_node", F.lit(0).cast("long"))
    sent_nodes = placed.select(
        *SENT, sentence_base(F.col("sent_ix")).alias("node_id"), F.lit("sentence").alias("attrib_type"),
        X.shorten(F.col("text")).alias("descr"), "path", F.lit(False).alias("is_root"))
    sent_edges = sent_nodes.select(
        *KEY, F.col("node_id").alias("edge_id"), F.lit(0).cast("long").alias("parent_id"),
        F.col("node_id").alias("child_id"), F.lit("sentence").alias("edge_type"), F.lit("sent").alias("relation"))
    doc_nodes, _ = document_nodes(placed)
    nodes = _conform([doc_nodes, sent_nodes, token_nodes], NODE_COLUMNS, _TYPES)
    edges = _conform([sent_edges, token_edges], EDGE_COLUMNS, _TYPES)
    return nodes, edges


def resolve_tokens(nodes: DataFrame, sentences: DataFrame) -> DataFrame:
    """Nodes with their aligned token structs and the JSON of their spans.

    ``sentences`` has ``tokens array<struct<ix,norm,begin,end>>``; the join key is
    the sentence, whose tokens one input row already held.
    """
    toks = sentences.select(*SENT, F.col("tokens").alias("_tokens"))
    out = join_salted(nodes, toks, SENT, ["node_id"], "left")
    picked = F.transform("token_ix", lambda i: F.get("_tokens", i))
    return (out.withColumn("tokens", F.filter(picked, lambda t: t.isNotNull()))
            .withColumn("spans", X.token_spans(F.col("tokens"))).drop("_tokens"))


def token_arrays(tokens: DataFrame) -> DataFrame:
    """Sentence rows with their sorted token structs, from token rows."""
    return tokens.groupBy(*SENT).agg(F.sort_array(F.collect_list(
        F.struct("ix", "norm", "begin", "end"))).alias("tokens"))
