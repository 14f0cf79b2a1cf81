"""Exact search against brute force on awkward tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from grainsight.llm import mtree
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k=5, every=50):
    seen = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in seen]
    out = {}
    for i, q in whole:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in whole if j != i)
            out.setdefault(i, scored[:k])
    return {(i, r + 1): (j, -s) for i, found in out.items() for r, (s, j) in enumerate(found)}


def got(spark, rows, block=64, pivots=8):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, block=block, pivots=pivots).collect()}


def vectors(n, seed=0, width=8):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 1, width).astype(np.float32).tolist()) for i in range(n)]


def test_ties_repeats_and_gaps(spark):
    rows = vectors(300)
    rows += [(300, rows[7][1]), (301, rows[7][1]), rows[3], (None, rows[1][1]), (302, None), (303, [None] * 8), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (306, rows[5][1][:3]), (350, [0.0] * 8), (307, [])]
    assert got(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert got(spark, []) == {} and got(spark, vectors(1)) == {}
    assert got(spark, vectors(3)) == brute(vectors(3))


def test_large_components(spark):
    """Also those that no tree holds; a score beyond 64 bits is an error only where it is returned."""
    rows = vectors(120, 2)
    rows[10] = (10, [1e6, -2e6] + rows[10][1][2:])
    rows[50] = (50, [3e5, 1e7] + rows[50][1][2:])
    assert got(spark, rows) == brute(rows)
    rows[11] = (11, [1e30] * 8)
    rows[100] = (100, [1.0] * 8)
    with pytest.raises(Exception, match="64 bits"):
        got(spark, rows)


@pytest.mark.parametrize(("block", "pivots"), [(16, 3), (64, 20), (4096, 64)])
def test_subtrees(spark, block, pivots):
    """Clustered vectors, whatever the sizes of blocks and of the upper level; ids that come twice with unlike vectors."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.1, 8)).astype(np.float32).tolist()) for i in range(600)]
    assert got(spark, rows, block, pivots) == brute(rows)


def test_bounds_spare_visits(spark, monkeypatch):
    """Queries of a clustered table see few of the subtrees."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (16, 6))
    centres *= 900 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.floor(centres[rng.integers(0, 16, 3000)] + rng.normal(0, 3, (3000, 6))).astype(np.int32)
    vectors = [v.tobytes() for v in x]
    most = float((x.astype(float) ** 2).sum(1).max())
    up = mtree.Upper(x[:64].astype(float), most)
    d = up.distances(vectors, False)
    up.radius = np.array([d[d.argmin(1) == g, g].max(initial=0.0) for g in range(64)]) + up.slack
    up.blocks = np.ones(65, np.int64)
    q = x[100].astype(np.int64)
    mine = sorted((x[d.argmin(1) == d[100].argmin()].astype(np.int64) @ q).tolist(), reverse=True)
    least = mine[min(5, len(mine) - 1)]

    class Shared:
        value = up

    batch = mtree.pa.RecordBatch.from_arrays([mtree.pa.array([100]), mtree.pa.array([vectors[100]], mtree.pa.binary()), mtree.pa.array([False]), mtree.pa.array([int(d[100].argmin())]), mtree.pa.array([least])], ["id", "v", "large", "subtree", "least"])
    seen = sum(b.num_rows for b in mtree._visits(Shared, 5)([batch]))
    assert seen < 40


def test_bounds_spare_work():
    """The tree looks at few of the vectors of a clustered table, and finds the same."""
    rng = np.random.default_rng(3)
    x = (rng.integers(-2000, 2000, (16, 6))[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 6))).astype(np.int32)
    tree = mtree.MTree(np.arange(4000), x)
    q = x[17]
    want = sorted(((int(v.astype(np.int64) @ q.astype(np.int64)), -i) for i, v in enumerate(x) if i != 17), reverse=True)[:5]
    assert tree.search(q, 5, 17) == [(s, -i) for s, i in want] and tree.computed < 2500
