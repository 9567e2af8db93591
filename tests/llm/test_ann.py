import numpy as np
import pytest
from pyspark.sql import functions as F

from plebis.llm import ann


def brute(rows, queries, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q in queries:
        v = dict(rows)[q]
        scores = sorted((-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("n, shard", [(900, 300), (4, 300)])
def test_recall_and_ranks(spark, monkeypatch, n, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.6, size=(n, 24))
    x[n // 2 : n // 2 + n // 4] = x[0]  # one vector with many copies
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).repartition(5)
    got = ann.nearest(df, F.col("id") % 50 == 0).collect()
    expected = brute(rows, [i for i, _ in rows if i % 50 == 0])
    hits = total = 0
    for q, best in expected.items():
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(own, own[1:], strict=False))
        hits += len({i for _, i, _ in own} & {i for i, _ in best})
        total += len(best)
    assert hits >= 0.95 * total
    assert [i for _, i, _ in sorted((r["rank"], r["vec_id"], 0) for r in got if r["query_id"] == 0)] == [i for i, _ in expected[0]]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, [-1.0, 0.0]),
            (8, [1.0]), (None, [1.0, 0.5]), (50, [0.0, 0.0]), (100, [0.0, 2.0]), (6, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 6), (0, 2, 100), (0, 3, 7), (100, 1, 6), (100, 2, 0), (100, 3, 7)]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_repeated_rows_take_no_places(spark):
    x = np.random.default_rng(4).normal(size=(60, 8))
    x[51:59] = x[0]  # ids of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    expected = brute(rows, [0, 50])
    for given in (rows + rows, rows + rows[51:52] * 6 + [rows[i] for i, _ in expected[50][:1]] * 5):
        df = spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(5)
        got = ann.nearest(df, F.col("id") % 50 == 0).collect()
        for q, best in expected.items():
            assert [i for _, i in sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)] == [i for i, _ in best]


def test_queries_are_never_broadcast_to_the_shards(spark):
    shards = spark.createDataFrame([(0, 0, b"", b"", [[1]])], "shard int, entry int, x binary, graph binary, ids array<array<long>>").localCheckpoint()
    queries = spark.createDataFrame([(50, [1.0])], "id long, v array<double>").localCheckpoint()
    plan = ann.search(shards, queries, 1, 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
