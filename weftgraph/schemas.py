"""Explicit schemas of the tables that operators exchange."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("summary", T.StringType()),
])

TRIPLE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("token_ix", T.ArrayType(T.IntegerType())),
    T.StructField("role_token_ix", T.ArrayType(T.IntegerType())),
])

PARSED_BLOCK = T.StructType([
    T.StructField("sent_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("top", T.StringType()),
    T.StructField("triples", T.ArrayType(TRIPLE)),
    T.StructField("failure", T.StringType()),
])

TOKEN = T.StructType([
    T.StructField("ix", T.IntegerType()),
    T.StructField("norm", T.StringType()),
    T.StructField("begin", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])

NODE_TYPES = ("doc", "sentence", "concept", "attribute")
ALIGNABLE_TYPES = ("sentence", "concept", "attribute")
EDGE_TYPES = ("doc", "sentence", "role")

FAILURE = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("message", T.StringType()),
])
