"""Block products: the same pairs as all products, with far fewer blocks opened."""

import numpy as np
from pyspark.sql import functions as F

from weftgraph.operators import similarity as S
from weftgraph.settings import AlignSettings

NODE = "doc_id long, component string, node_id long, attrib_type string, vec array<double>"


def nodes(seed, n=900, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):  # most of the rows are in one document
        d = 1 if i % 10 else 2
        vec = centres[rng.integers(0, 12)] + rng.normal(scale=0.12, size=dim)
        rows.append((d, "source" if i % 2 else "summary", i, "concept" if i % 5 else "sentence", [] if dim == 0 else vec.tolist()))
    rows += [(1, c, 10_000 + k, "concept", [0.0] * dim) for k, c in enumerate(("source", "summary"))]
    return rows + [(3, "source", 1, "concept", [1.0] * dim), (3, "summary", 2, "concept", [2.0] * dim), (4, "source", 1, "concept", [1.0] * dim)]


def plain(rows, threshold, exponent):
    out = {}
    for d, c, i, t, v in rows:
        if c != "source":
            continue
        for e, c2, j, t2, w in rows:
            if c2 == "summary" and (e, t2) == (d, t):
                n = np.linalg.norm(v) * np.linalg.norm(w)
                sim = max(float(np.dot(v, w)) / n, 0.0) ** exponent if n else 0.0
                if sim > threshold:
                    out[d, i, j] = sim
    return out


def test_same_pairs_and_few_blocks(spark):
    rows = nodes(3)
    df = spark.createDataFrame(rows, NODE)
    for threshold, exponent in ((0.5, 1.0), (0.3, 2.0), (0.0, 1.0)):
        got = {(r.doc_id, r.src_node, r.smy_node): r.sim for r in S.cosine_pairs(df, threshold, exponent, block_rows=20).collect()}
        want = plain(rows, threshold, exponent)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    blocked, pivots = S.pivot_blocks(df, 20)
    assert blocked.count() == len(rows)
    units = S.bipartite_blocks(blocked, pivots)
    total, opened, few = units.where("doc_id = 1").agg(
        F.count("*"), F.count_if(F.col("most") > 0.5), F.count_if(F.col("most") > 0.7)).first()
    assert total > 300 and opened < 0.47 * total and few < 0.25 * total
    # no cosine of a unit is above its bound
    a = blocked.where("component = 'source'").select("doc_id", "attrib_type", F.col("block").alias("src_block"), F.col("vec").alias("a"))
    b = blocked.where("component = 'summary'").select("doc_id", "attrib_type", F.col("block").alias("smy_block"), F.col("vec").alias("b"))
    over = units.join(a, ["doc_id", "attrib_type", "src_block"]).join(b, ["doc_id", "attrib_type", "smy_block"]).select(
        "most", S.V.cosine(F.col("a"), F.col("b")).alias("cos")).where("cos > most + 1e-9")
    assert over.count() == 0


def test_whole_similarity_is_the_same(spark):
    rows = nodes(5, 400)
    df = spark.createDataFrame(rows, NODE).withColumn("nvec", F.reverse("vec")).withColumn(
        "svec", F.when(F.col("node_id") % 3 > 0, F.col("vec")).cast("array<double>"))
    one = {tuple(r)[:4]: r.sim for r in S.pair_similarity(df, AlignSettings(block_rows=1_000_000)).collect()}
    many = {tuple(r)[:4]: r.sim for r in S.pair_similarity(df, AlignSettings(block_rows=15)).collect()}
    assert set(one) == set(many) and len(one) > 100 and all(abs(one[k] - many[k]) < 1e-9 for k in one)
