"""Hard negatives: exact rows against all pairs, bounds against exact scores, odd rows."""

import math

import numpy as np
import pytest

from weftgraph.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, block string, A_dim int"


def brute(rows, every=50):
    """The contract by all pairs, in whole numbers."""
    part = []
    for vec_id, vec, label, *_ in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        part.append((vec_id, [math.floor(256 * x) for x in vec], moved))
    out = []
    for a, va, la in part:
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i is None, i or 0, i, lab) for i, v, lab in part if i != a and len(v) == len(va)]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == la][:5]:
            fits = [s for s in scored if s[4] != la and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(a, p[3], k + 1, s[3], -p[0], -s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=str)


def clustered(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + rng.normal(scale=0.6, size=(n, dim))
    v[::9] = v[0]  # one very common vector, so many ties
    lab = rng.integers(0, 10, n)
    lab[::3] = 4
    return [(i, v[i].tolist(), int(lab[i]), 0, "x", 0) for i in range(n)]


@pytest.mark.parametrize(("seed", "rows", "anchors"), [(1, 4096, 512), (2, 7, 3)])
def test_rows_against_all_pairs(spark, seed, rows, anchors, monkeypatch):
    monkeypatch.setattr(H, "TILE", 32)
    data = clustered(seed)
    got = H.mine(spark.createDataFrame(data, SCHEMA).repartition(4), every=20, rows=rows, anchors=anchors).collect()
    want = brute(data, 20)
    assert len(want) > 50 and sorted(map(tuple, got), key=str) == want


def test_odd_rows(spark):
    data = clustered(3, 120, 5)
    data += [(200, None, 1, 0, "", 0), (250, [1.0, None, 0.0, 0.0, 0.0], 1, 0, "", 0), (300, [float("nan")] * 5, 1, 0, "", 0),
             (350, [float("inf")] * 5, 1, 0, "", 0), (400, data[3][1], None, 0, "", 0), (None, data[0][1], 1, 0, "", 0),
             (None, data[0][1], 4, 0, "", 0), (450, [0.5, 0.25], 2, 0, "", 0), (451, [0.5, 0.125], 2, 0, "", 0),
             (452, [0.25, 0.25], 3, 0, "", 0), (500, [], 2, 0, "", 0), (501, [], 2, 0, "", 0), (503, [], 3, 0, "", 0),
             (550, [0.0] * 5, 4, 0, "", 0), data[10], data[20]]
    got = H.mine(spark.createDataFrame(data, SCHEMA), every=50, rows=16, anchors=2).collect()
    assert sorted(map(tuple, got), key=str) == brute(data)
    assert {(450, 451, 1, 452)} <= {tuple(r)[:4] for r in got} and {(500, 501, 1, 503)} <= {tuple(r)[:4] for r in got}
    assert H.mine(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_components_are_exact(spark):
    data = [(0, [2.0 ** 22, 1.0, 3.0], 1, 0, "", 0), (1, [2.0 ** 22, 2.0, 1.0], 2, 0, "", 0),
            (2, [2.0 ** 21, 7.0, 1.0], 3, 0, "", 0), (3, [2.0 ** 21, 9.0, 1.0], 3, 0, "", 0)]
    got = H.mine(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 2 and sorted(map(tuple, got), key=str) == brute(data)
    huge = [(i, [1e40, float(i)], i % 2, 0, "", 0) for i in range(4)]
    assert {r["positive_score"] for r in H.mine(spark.createDataFrame(huge, SCHEMA)).collect()} <= {H.FAR}


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(4)
    v = np.floor(256 * np.cumsum(rng.normal(size=(300, 64)), 1) / 40)
    block = H.Block.of(np.arange(300), np.zeros(300, bool), np.zeros(300, np.int64), v)
    a, r = block.rows(0, 40), block.rows(40, 300)
    exact, asked = a.vecs @ r.vecs.T, []
    least = np.sort(exact, 1)[:, -5]

    def wanted(low, high, ai):
        asked.append(high.size)
        if high.ndim == 2:
            assert (low <= exact + 1e-3).all() and (exact <= high + 1e-3).all()
        return high >= (least[ai][:, None] if high.ndim == 2 else least[ai])

    ai, ri, score = H.open_pairs(a, r, np.ones(exact.shape, bool), wanted)
    assert (score == exact[ai, ri]).all() and set(zip(ai, ri)) == set(zip(*np.nonzero(exact >= least[:, None])))
    assert asked[-1] < asked[0] / 10  # few pairs are followed to the end
