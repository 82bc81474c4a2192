"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = ["bipartite_pairs", "pair_cosine", "mean_vector", "top_alignments", "reverse_edges", "adjacency", "assign_ids",
         "text_graph_counts", "token_spans", "sentence_index", "graph_corpus_roundtrip", "parse_role", "relation_match",
         "network_edges", "node_counts", "split_components", "merge_annotations", "filter_keys", "corpus_fingerprint",
         "several_corpora", "bleu", "smatch_triples", "rouge_l", "variable_relations", "role_label_failures",
         "summary_terminals", "max_flow_edges", "aligned_without_pruning", "align_one"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
