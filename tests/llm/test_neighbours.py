import numpy as np
from pyspark.sql import functions as F

from strandweave.llm import neighbours as N


def table(spark, seed=1, n=1500, dim=32):
    rng = np.random.RandomState(seed)
    base = rng.randn(n, dim)
    for i in range(0, 400, 4):  # tight groups of four
        base[i + 1 : i + 4] = base[i] + 0.08 * rng.randn(3, dim)
    base[500] = base[501] = base[502]
    rows = [(i, [float(x) for x in v * (1 + i % 3)]) for i, v in enumerate(base)]
    return rows, spark.createDataFrame(rows + rows[:7] + [(9000, None), (9001, [0.0] * dim), (9002, [1.0])], "id long, v array<float>")


def brute(rows):
    v = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 6)
    np.fill_diagonal(s, -2)
    return s


def test_close_pairs_of_brute_force(spark, monkeypatch):
    rows, df = table(spark)
    s = brute(rows)
    kth = -np.sort(-s, axis=1)[:, 2]
    want = {(min(i, j), max(i, j)) for i, j in zip(*np.where((s >= 0.9) & (s >= kth[:, None])), strict=True)}
    for leaf, most in ((4096, 32_768), (256, 200)):
        monkeypatch.setattr(N, "LEAF", leaf)
        monkeypatch.setattr(N, "MOST_ROWS", most)
        got = {(r.a, r.b) for r in N.similar_vectors(df, "id", "v", 3, 0.9).collect()}
        assert got <= want and len(got & want) >= 0.95 * len(want)


def test_recall_of_the_nearest(spark):
    rows, df = table(spark, 2)
    s = brute(rows)
    got = N.neighbours_of(df, "id", "v", F.pmod("id", F.lit(20)) == 0, 5, block=400).toPandas()
    hits = sum(len(set(g.neighbour) & set(np.argsort(-s[k])[:5])) for k, g in got.groupby("id"))
    assert len(got) == 5 * 75 and hits >= 0.9 * len(got)


def test_empty_and_null_only(spark):
    empty = spark.createDataFrame([], "id long, v array<float>")
    assert N.similar_vectors(empty, "id", "v", 5, 0.9).count() == 0
    assert N.similar_vectors(spark.createDataFrame([(1, None), (2, None)], "id long, v array<float>"), "id", "v", 5, 0.9).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0])], "id long, v array<float>")
    assert [(r.a, r.b) for r in N.similar_vectors(one, "id", "v", 5, 0.9).collect()] == [(1, 2)]
