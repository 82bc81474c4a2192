"""The driver tables seen as documents, graphs, vectors and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.functions import vectors as V
from weftgraph.lineage import materialize
from weftgraph.operators.build import text_graph, text_tokens, text_sentences
from weftgraph.operators.graph import KEY
from weftgraph.skew import join_salted

EMB_DIM = 64
EMB_THRESHOLD = 0.05
DOC_VECTORS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- embeddings: documents of a hundred vectors each -------------------------

def emb_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as nodes: even ids source, odd ids summary, the label as node type."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / DOC_VECTORS).cast("long").alias("doc_id"),
        F.when(F.col("vec_id") % 2 == 0, "source").otherwise("summary").alias("component"),
        F.col("vec_id").alias("node_id"), F.col("label").cast("string").alias("attrib_type"),
        V.as_double(F.col("embedding")).alias("vec"))


def emb_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tree over the vectors: root, one sentence node per label, vectors as concepts.

    Root id -1, sentence ids -(label + 2), vector ids as they are.
    """
    leaf = emb_nodes(spark, sf_dir).withColumn("sentence", -(F.col("attrib_type").cast("long") + 2))
    sents = leaf.select(*KEY, F.col("sentence").alias("node_id")).distinct()
    tops = leaf.select(*KEY).distinct().withColumn("node_id", F.lit(-1).cast("long"))
    nodes = (tops.withColumn("attrib_type", F.lit("doc")).withColumn("is_root", F.lit(True))
             .unionByName(sents.withColumn("attrib_type", F.lit("sentence")).withColumn("is_root", F.lit(False)))
             .unionByName(leaf.select(*KEY, "node_id", F.lit("concept").alias("attrib_type"),
                                      F.lit(False).alias("is_root"))))
    nodes = nodes.withColumn("descr", F.concat(F.col("attrib_type"), F.lit(" "), F.col("node_id").cast("string")))
    edges = (sents.select(*KEY, F.col("node_id").alias("edge_id"), F.lit(-1).cast("long").alias("parent_id"),
                          F.col("node_id").alias("child_id"), F.lit("sentence").alias("edge_type"))
             .unionByName(leaf.select(*KEY, F.col("node_id").alias("edge_id"), F.col("sentence").alias("parent_id"),
                                      F.col("node_id").alias("child_id"), F.lit("role").alias("edge_type"))))
    return nodes, edges


def emb_coref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations among vectors: same document, label and remainder of the id by 7."""
    n = emb_nodes(spark, sf_dir)
    return n.select("doc_id", (F.col("attrib_type").cast("long") * 7 + F.col("node_id") % 7).alias("rel_id"),
                    "component", F.col("attrib_type").cast("long").alias("sent_ix"),
                    F.concat(F.lit("v"), F.col("node_id").cast("string")).alias("variable"),
                    "node_id")


# --- sales hierarchy: one tree per region ------------------------------------

def _level(df: DataFrame, doc, parent, child, kind: str, weight=None) -> DataFrame:
    return df.select(
        doc.cast("long").alias("doc_id"), F.lit("source").alias("component"), child.alias("edge_id"),
        parent.alias("parent_id"), child.alias("child_id"), F.lit(kind).alias("edge_type"),
        (F.lit(None).cast("double") if weight is None else weight).alias("weight"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by order and line number; equal numbers of an order are one line."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))


def _id(prefix: str, *cols: str):
    return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))


def hier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer, order and line item as one tree per region."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(
        customer.select("c_custkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = order_lines(spark, sf_dir).join(
        orders.select("o_orderkey", "n_regionkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    region = F.col("n_regionkey")
    return (_level(nation, region, _id("r", "n_regionkey"), _id("n", "n_nationkey"), "doc")
            .unionByName(_level(customer, region, _id("n", "c_nationkey"), _id("c", "c_custkey"), "sentence"))
            .unionByName(_level(orders, region, _id("c", "o_custkey"), _id("o", "o_orderkey"), "role"))
            .unionByName(_level(lines, region, _id("o", "l_orderkey"), _id("l", "l_orderkey", "l_linenumber"),
                                "role", F.col("l_quantity"))))


def hier_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("source").alias("component"),
                    _id("r", "r_regionkey").alias("node_id"))


def hier_nodes(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """Roots and every child, with the node type of its level, from the edges where these are written already."""
    kind = {"doc": "doc", "sentence": "sentence", "o": "concept", "l": "attribute"}
    e = hier_edges(spark, sf_dir) if edges is None else edges
    typed = (F.when(F.col("edge_type") == "role",
                    F.when(F.substring("child_id", 1, 1) == "o", kind["o"]).otherwise(kind["l"]))
             .otherwise(F.col("edge_type")))
    inner = e.select(*KEY, F.col("child_id").alias("node_id"), typed.alias("attrib_type"),
                     F.lit(False).alias("is_root"))
    return hier_roots(spark, sf_dir).withColumn("attrib_type", F.lit("doc")).withColumn(
        "is_root", F.lit(True)).unionByName(inner)


def hier_inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line quantities as the alignment capacity that arrives at the leaves."""
    return hier_edges(spark, sf_dir).where("weight is not null").select(
        *KEY, F.col("child_id").alias("node_id"), F.col("weight").alias("capacity"))


# --- purchases: one graph per customer, parts shared by orders ------------------

def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to order to part; a part bought in two orders has two parents."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"),
                                              F.col("l_orderkey") == F.col("o_orderkey"))
    # numbers are shuffled, not the ids made of them
    li = li.select("o_custkey", "l_orderkey", "l_partkey").distinct()
    top = o.select(F.col("o_custkey").alias("doc_id"), _id("o", "o_orderkey").alias("edge_id"),
                   _id("c", "o_custkey").alias("parent_id"), _id("o", "o_orderkey").alias("child_id"),
                   F.lit("sentence").alias("edge_type"))
    parts = li.select(F.col("o_custkey").alias("doc_id"), _id("e", "l_orderkey", "l_partkey").alias("edge_id"),
                      _id("o", "l_orderkey").alias("parent_id"), _id("p", "l_partkey").alias("child_id"),
                      F.lit("role").alias("edge_type"))
    return top.unionByName(parts).withColumn("component", F.lit("source"))


def dag_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the purchases; the edges are written once."""
    e = materialize(dag_edges(spark, sf_dir), "dag-edges")
    return dag_nodes(spark, sf_dir, e), e


def dag_nodes(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """The purchases' nodes, from their edges where these are written already."""
    e = dag_edges(spark, sf_dir) if edges is None else edges
    tops = e.where("edge_type = 'sentence'").select(
        *KEY, F.col("parent_id").alias("node_id"), F.lit("doc").alias("attrib_type"),
        F.lit(True).alias("is_root")).distinct()
    inner = e.select(*KEY, F.col("child_id").alias("node_id"),
                     F.when(F.col("edge_type") == "sentence", "sentence").otherwise("concept").alias("attrib_type"),
                     F.lit(False).alias("is_root")).distinct()
    return tops.unionByName(inner)


def dag_summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary side of the purchases: one node per brand, aligned to its parts.

    Capacity of an alignment: average discount plus a tenth of the customer's lines
    of that part.  The aligned parts are summed once and written.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    doc = F.col("o_custkey").alias("doc_id")
    brand = F.concat(F.lit("b"), F.col("p_brand"))
    align = (li.groupBy("o_custkey", "l_partkey", "p_brand")
             .agg((F.sum("l_discount") / F.count(F.lit(1)) + F.lit(0.1) * F.count(F.lit(1))).alias("capacity"))
             .select(doc, _id("p", "l_partkey").alias("src_node"), brand.alias("smy_node"), "capacity"))
    align = materialize(align, "dag-align")
    leaf = align.select("doc_id", F.lit("summary").alias("component"), F.col("smy_node").alias("node_id")).distinct()
    tops = leaf.select("doc_id", "component").distinct().withColumn("node_id", F.lit("m"))
    nodes = (tops.withColumn("attrib_type", F.lit("doc")).withColumn("is_root", F.lit(True))
             .unionByName(leaf.withColumn("attrib_type", F.lit("concept")).withColumn("is_root", F.lit(False))))
    edges = leaf.select("doc_id", "component", F.col("node_id").alias("edge_id"), F.lit("m").alias("parent_id"),
                        F.col("node_id").alias("child_id"), F.lit("sentence").alias("edge_type"))
    return nodes, edges, align.withColumn("rel_id", F.lit(None).cast("long"))


# --- texts ---------------------------------------------------------------------

# user turns are the source, assistant turns the summary, others neither
ROLE_TYPES = {"user": "body", "assistant": "summary", "system": "topic"}


def conv_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as typed sentences of their conversation."""
    c = table(spark, sf_dir, "conversations")
    raw = F.create_map(*[F.lit(x) for kv in ROLE_TYPES.items() for x in kv])
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_ix"),
                    raw[F.col("role")].alias("snt_type"), "text")


def conv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.where("role in ('user', 'assistant')").select(
        F.col("conv_id").alias("doc_id"),
        F.when(F.col("role") == "user", "source").otherwise("summary").alias("component"),
        F.col("turn").alias("part_ix"), "text")


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows at once, or with an empty answer."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("text_a"))
    answer = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("text_b"))
    return user.join(answer, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "text_a", F.coalesce("text_b", F.lit("")).alias("text_b"))


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit("source").alias("component"), F.lit(0).alias("part_ix"), "text")


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document: the first line is its summary, the others its source."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("sent_ix", "text")).where(F.trim("text") != "")
    return lines.withColumn("component", F.when(F.col("sent_ix") == 0, "summary").otherwise("source"))


def vector_of_text(words: DataFrame, embeddings: DataFrame, column: str = "norm") -> DataFrame:
    """Distinct words with a row of the embeddings table, chosen by the word's hash.

    Stands in for a text encoder: equal words get equal vectors.
    """
    n = embeddings.count()
    distinct = words.select(F.col(column).alias("text")).where("text is not null").distinct()
    vec = embeddings.select(F.col("vec_id").alias("_slot"), V.as_double(F.col("embedding")).alias("vec"))
    slots = distinct.withColumn("_slot", F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") % F.lit(n))
    return slots.join(vec, "_slot").drop("_slot")


def conv_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversation graph with its token vectors: nodes, edges, token vectors."""
    texts = conv_texts(spark, sf_dir)
    nodes, edges = text_graph(texts)
    tokens = text_tokens(text_sentences(texts)).select(*KEY, "sent_ix", "ix", F.col("norm").alias("text"))
    words = vector_of_text(tokens, table(spark, sf_dir, "embeddings"), "text")
    vectors = join_salted(tokens, words, ["text"], ["doc_id", "sent_ix", "ix"])
    return nodes, edges, vectors.select(*KEY, "sent_ix", "ix", "vec")


# --- purchase graph pairs ----------------------------------------------------

LINE_IDS = 4096


def purchase_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per customer two labelled graphs: finished orders and all others, with their lines.

    Node labels are the order priority and the line's return flag and quantity
    class; the role of a line is its number.  Returns nodes, edges and tops.  The lines
    are summed and joined to their orders once and written.
    """
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("pair_id"), "o_orderkey", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("side"))
    li = order_lines(spark, sf_dir).join(
        o.select("pair_id", "side", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = materialize(li.drop("l_orderkey"), "purchase-lines")
    keys = ["pair_id", "side"]
    order_id = F.col("o_orderkey") * LINE_IDS
    line_id = order_id + F.when(F.col("l_linenumber").between(0, LINE_IDS - 2), F.col("l_linenumber") + 1).otherwise(
        F.raise_error(F.lit("line number out of range")).cast("int"))
    tops = o.select(*keys).distinct().withColumn("node_id", F.lit(-1).cast("long"))
    nodes = (tops.withColumn("label", F.lit("customer"))
             .unionByName(o.select(*keys, order_id.alias("node_id"), F.col("o_orderpriority").alias("label")))
             .unionByName(li.select(*keys, line_id.alias("node_id"), F.concat(
                 F.col("l_returnflag"), F.floor(F.col("l_quantity") / 10).cast("string")).alias("label"))))
    edges = (o.select(*keys, F.lit(-1).cast("long").alias("parent_id"), order_id.alias("child_id"),
                      F.concat(F.lit(":"), F.col("o_orderpriority")).alias("role"))
             .unionByName(li.select(*keys, order_id.alias("parent_id"), line_id.alias("child_id"),
                                    F.concat(F.lit(":line"), F.col("l_linenumber").cast("string")).alias("role"))))
    return nodes.withColumn("attrib_type", F.lit("concept")), edges, tops


def text_graph_conv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return text_graph(conv_texts(spark, sf_dir))


def token_array(column: str = "text"):
    return X.tokenize(F.col(column))
