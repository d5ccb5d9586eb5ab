import math

import numpy as np

from clipledger.llm.topk import index, quantised, top_k


def brute(rows, k=5, every=50):
    v = []
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.append((i, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for n, (i, q) in enumerate(v):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, w)), j) for m, (j, w) in enumerate(v) if m != n)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, parts=5, block=16):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, part string").repartition(3)
        return sorted(tuple(r) for r in top_k(index(quantised(df), block)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-2, 3, 8) / 4).tolist(), "x", "y") for i in rng.permutation(700)]
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_clustered_vectors_and_large_values(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(10, 16)) * 5
    rows = [(i, (centre[i // 60] + rng.normal(size=16) / 10).tolist(), "x", "y") for i in range(600)]
    assert run(spark, rows) == brute([r[:2] for r in rows])
    big = [(i, [float(2.0**20 * ((i * 7) % 5 - 2)), 1.0], "", "") for i in range(120)]
    assert run(spark, big) == brute([r[:2] for r in big])


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], None, None), (0, [0.5, 0.5], "a", "a"), (50, [0.25, 1.0], None, None), (1, None, "", ""), (2, [None, 1.0], "", ""), (3, [nan, 1.0], "", ""), (4, [inf, 0.0], "", ""), (None, [1.0, 1.0], "", ""), (5, [1.0], "", ""), (100, [], "", "")]
    assert run(spark, rows) == brute([r[:2] for r in rows])
    assert run(spark, rows[:1]) == [] and run(spark, []) == []
