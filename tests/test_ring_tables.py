"""Messages of finished rounds are deleted; the rings stay."""

from weftgraph.lineage import lineage_dir
from weftgraph.operators import graph as G


def test_ring_messages_are_deleted(spark):
    def written():
        path = spark._jvm.org.apache.hadoop.fs.Path(lineage_dir(spark))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()

    before = written()
    nodes = spark.createDataFrame([(1, "source", i, [float(i)]) for i in range(4)], "doc_id long, component string, node_id long, vec array<double>")
    edges = spark.createDataFrame([(1, "source", i, i + 1) for i in range(3)], "doc_id long, component string, parent_id long, child_id long")
    rings = G.ring_sums(nodes, edges, 3, 1)
    left = [n for n in written() - before if n.startswith(("ring-message", "ring-links"))]
    assert left == []
    assert sorted((r.node_id, r.hops, r.vec[0], r.n) for r in rings.collect()) == [
        (0, 1, 1.0, 1), (0, 2, 2.0, 1), (0, 3, 3.0, 1), (1, 1, 2.0, 2), (1, 2, 3.0, 1),
        (2, 1, 4.0, 2), (2, 2, 0.0, 1), (3, 1, 2.0, 1), (3, 2, 1.0, 1), (3, 3, 0.0, 1)]
