"""Cut certificates: right flows are certified, altered ones are not."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import maxflow as M

NET = ("doc_id string, component string, edge_id string, edge_type string, from_key string, to_key string, capacity double")


def networks(seed):
    rng, rows = random.Random(seed), []
    for d in range(25):
        n = rng.randint(2, 8)
        names = ["S", *[f"v{i}" for i in range(n)], "T"]
        for i, (a, b) in enumerate({(rng.randint(0, n), rng.randint(1, n + 1)) for _ in range(3 * n)}):
            if a != b:
                rows.append((str(d), "source", str(i), "role", names[a], names[b], rng.choice([0.0, 0.5, 1.0, 2.5, 1e10 if rng.random() < .2 else 3.0])))
        rows += [(str(d), "source", "s", "terminal", "S", "v0", 2.0), (str(d), "source", "t", "terminal", f"v{n - 1}", "T", 1.5)]
    return rows


def test_maximum_flows_are_certified_and_smaller_ones_are_not(spark):
    net = spark.createDataFrame(networks(3), NET)
    for flows in (M.max_flow(net), M.spread_max_flow(net)):
        flows = flows.cache()
        out = M.cut_certificate(flows).collect()
        assert len(out) == 25 and all(r.certified and abs(r.value - r.cut) < 1e-6 for r in out)
        flowing = {r.doc_id for r in out if r.value > 0}
        less = M.cut_certificate(flows.withColumn("flow", F.col("flow") / 2)).collect()
        assert {r.doc_id for r in less if not r.certified} == flowing
        uncut = M.cut_certificate(flows.withColumn("in_cut", F.lit(False))).collect()
        assert {r.doc_id for r in uncut if not r.certified} >= flowing
        flows.unpersist()
