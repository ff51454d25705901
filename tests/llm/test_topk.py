import numpy as np

from orrery.llm import topk
from orrery.llm.topk import SPLITS, Best, search_block, segment_rows, top_k
from pyspark.sql import functions as F


def test_bound_holds():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 13)), rng.normal(size=(50, 13))
    exact = a @ b.T
    last = np.inf
    for s in (1, 2, 4, 13, 40):
        bound = segment_rows(a, s) @ segment_rows(b, s).T
        assert (bound >= exact - 1e-9).all()
        assert bound.sum() <= last + 1e-6 or s not in (2, 4)
        last = bound.sum()


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[300:450] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (1000, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in top_k(df, df.filter(F.col("vec_id") % 100 == 0), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if v and not any(c is None or not np.isfinite(c) for c in v)}
    for q in [i for i in whole if i % 100 == 0]:
        want = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert set(got) == {i for i in whole if i % 100 == 0}
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 7, 2048 * 1024)]


def test_survivors_get_fewer():
    """Finer bounds and exact scores are computed for the survivors of the coarser bound only."""
    rng = np.random.default_rng(2)
    x = np.floor(1024 * (rng.normal(size=(1000, 64)) + 3 * rng.normal(size=(1000, 16)).repeat(4, 1)))
    q, ids = x[::100], np.arange(1000)
    best = Best(len(q), 5)
    met = search_block(best, q, ids[::100], [segment_rows(q, s) for s in SPLITS], x, ids)
    assert met[0] >= met[1] >= met[2] and met[2] < len(q) * 999 / 4
    for i, v in enumerate(q):
        want = sorted((-(v @ x[j]), j) for j in range(1000) if j != 100 * i)[:5]
        assert list(zip(-best.score[i], best.id[i])) == want


def test_null_and_repeated_ids_lengths_and_columns(spark):
    big = (1 << 60) + 1
    rows = [(0, [1.0, 0.0], "a"), (0, [0.0, 1.0], "b"), (big, [2.0, 3.0], "c"), (None, [9.0, 9.0], "d"), (5, [1.0], "e"), (6, [], "f"), (7, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query string").withColumn("score", F.lit("x")).repartition(3)
    got = sorted((r["query_id"], r["vec_id"], r["score"] >> 20) for r in top_k(df, df.filter("vec_id = 0"), 10).collect())
    assert got == sorted([(0, big, 2), (0, 7, 1), (0, big, 3), (0, 7, 1)])
    ranks = sorted(r["rank"] for r in top_k(df, df.filter("vec_id = 0"), 10).collect())
    assert ranks == [1, 1, 2, 2]
    assert top_k(df, df.filter("vec_id is null")).count() == 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, top_k(df, df.filter("vec_id % 30 = 0"), 3).collect()))
    monkeypatch.setattr(topk, "BLOCK_BYTES", 4 * 32)
    assert sorted(map(tuple, top_k(df, df.filter("vec_id % 30 = 0"), 3).collect())) == one and len(one) == 30
