"""Names of a sentence are looked up in its own row."""

import pytest

from weftgraph.operators import build as B

TRIPLE = "array<struct<source string, role string, target string, token_ix array<int>, role_token_ix array<int>>>"
SCHEMA = f"doc_id long, component string, sent_ix long, text string, top string, triples {TRIPLE}"


def _t(source, role, target):
    return (source, role, target, None, None)


ONE = [_t("a", ":instance", "want-01"), _t("b", ":instance", "boy"), _t("a", ":ARG0", "b"), _t("a", ":polarity", "-"),
       _t("b", ":quant", "3"), _t("x", ":mod", "b"), _t(None, ":mod", "a"), _t("a", None, "b")]
TWICE = [_t("a", ":instance", "go-02"), _t("a", ":instance", "go-03"), _t("a", ":time", "a"), _t("a", ":op1", "now")]


def _plain_joins(rows):
    """Nodes and edges inside sentences by nested loops over all rows."""
    names, triples = [], []
    for doc, comp, sent, _, top, found in rows:
        for pos, t in enumerate(found):
            triples.append(((doc, comp, sent), pos, t))
            if t[1] == ":instance":
                names.append(((doc, comp, sent), t[0], ((sent or 0) + 1 << 24) + pos + 1 if sent is not None else None))

    def of(key, name):
        return [n for k, v, n in names if k == key and None not in key and v is not None and v == name]

    nodes, edges = [], []
    for key, pos, t in triples:
        me = None if key[2] is None else (key[2] + 1 << 24) + pos + 1
        if t[1] == ":instance":
            nodes.append((*key[:2], me, "concept"))
        elif t[1] is not None:
            tails = of(key, t[2])
            if not tails:
                nodes.append((*key[:2], me, "attribute"))
            edges += [(*key[:2], h, c) for h in of(key, t[0]) for c in (tails or [me])]
    for doc, comp, sent, _, top, _ in rows:
        edges += [(doc, comp, sent + 1 << 24, n) for n in of((doc, comp, sent), top)] if sent is not None else []
    return sorted(map(str, nodes)), sorted(map(str, edges))


@pytest.mark.parametrize("wide", [256, 1])
def test_names_of_repeated_wide_and_null_sentences(spark, wide, monkeypatch):
    monkeypatch.setattr(B, "ROW_NAMES", wide)
    rows = [(1, "source", 0, "one", "a", ONE), (1, "source", 1, "two", "a", TWICE), (1, "summary", 0, "x", "q", ONE),
            (2, "source", 0, "one", "b", ONE), (2, "source", 0, "again", "a", TWICE), (2, "source", 0, "one", "b", ONE),
            (3, None, 0, "y", "a", ONE), (None, "source", 4, "z", "a", TWICE), (4, "source", 0, None, None, []),
            (5, "source", 0, "none", "a", None)]
    nodes, edges = B.build_graph(spark.createDataFrame(rows, SCHEMA))
    want_nodes, want_edges = _plain_joins([(*r[:5], r[5] or []) for r in rows])
    got = nodes.where("attrib_type in ('concept', 'attribute')").select("doc_id", "component", "node_id", "attrib_type")
    assert sorted(str(tuple(r)) for r in got.collect()) == want_nodes
    got = edges.where("edge_type = 'role' or relation = 'sent-root'").select("doc_id", "component", "parent_id", "child_id")
    assert sorted(str(tuple(r)) for r in got.collect()) == want_edges


def test_triples_of_plain_sentences_are_not_joined(spark):
    nodes, edges = B.build_graph(spark.createDataFrame([(1, "source", 0, "one", "a", ONE), (1, "source", 1, "two", "a", TWICE)], SCHEMA))
    for table, kind in ((nodes, "attrib_type in ('concept', 'attribute', 'sentence')"), (edges, "edge_type in ('role', 'sentence')")):
        assert "Join" not in table.where(kind)._jdf.queryExecution().optimizedPlan().toString()
