"""Collapsing sections joins only the rows near the doc ids."""

from weftgraph.operators import graph as G


def test_collapsing_joins_only_rows_near_the_doc_ids(spark):
    nodes = spark.createDataFrame([
        (1, "source", 0, "doc", "source", True), (1, "source", 1, "doc", "source.section_0", False), (1, "source", 2, "doc", "source.section_0.header", False),
        (1, "source", 3, "doc", "source.section_0.body-sub", False), (1, "source", 2, "concept", None, False), (1, "source", 99, "sentence", None, False),
        (1, "source", None, "concept", None, False), (2, "source", 2, "concept", None, False)],
        "doc_id long, component string, node_id long, attrib_type string, path string, is_root boolean")
    edges = spark.createDataFrame([(1, "source", 1, 0, 1), (1, "source", 2, 1, 2), (1, "source", 3, 1, 3), (1, "source", 9, 2, 99),
                                   (1, "source", 10, 99, 100), (1, "source", 11, None, 100), (2, "source", 9, 2, 99)],
                                  "doc_id long, component string, edge_id long, parent_id long, child_id long")
    kept, moved = G.collapse_sections(nodes, edges)
    assert sorted(str(tuple(r)) for r in kept.select("doc_id", "node_id", "attrib_type").collect()) == sorted(map(str, [
        (1, 0, "doc"), (1, 3, "doc"), (1, 99, "sentence"), (1, None, "concept"), (2, 2, "concept")]))
    assert sorted(str(tuple(r)) for r in moved.select("doc_id", "edge_id", "parent_id", "child_id").collect()) == sorted(map(str, [
        (1, 3, 0, 3), (1, 9, 0, 99), (1, 10, 99, 100), (1, 11, None, 100), (2, 9, 2, 99)]))
    for table in (kept, moved):
        assert table._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    same, there = G.collapse_sections(nodes.where("attrib_type <> 'doc'"), edges)
    assert same.count() == 4 and there.count() == 7
