from fractions import Fraction

import numpy as np
import pytest

from plebis.llm import whitening

COLUMNS = "vec_id long, embedding array<float>"


def checked(x):
    x = x - x.mean(axis=0)
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((x.shape[1] - len(r), x.shape[1]))])
    v, squared = whitening.directions(r, x.shape[1])
    known = np.linalg.svd(x, compute_uv=False) ** 2
    assert len(squared) == (known > 1e-20 * known[0]).sum()
    assert np.allclose(squared, known[: len(squared)], rtol=1e-6, atol=0)
    assert np.abs(v.T @ v - np.eye(len(squared))).max() < 1e-10
    w = x @ v / np.sqrt(squared)
    assert np.abs(w.T @ w - np.eye(len(squared))).max() < 1e-5
    assert np.abs(x.T @ (x @ v) - v * squared).max() < 1e-12 * squared[0]


def test_solver_against_lapack():
    rng = np.random.default_rng(1)
    half = rng.standard_normal((500, 16))
    q = rng.standard_normal((300, 32))
    q = np.linalg.qr(q - q.mean(axis=0))[0]
    cases = [
        rng.standard_normal((500, 64)), rng.standard_normal((50, 64)), np.hstack([half, half, half * 0, np.ones((500, 3))]), np.vstack([np.eye(8)] * 20),
        rng.standard_normal((800, 64)) * np.logspace(0, -5, 64), rng.standard_normal((800, 64)) * np.logspace(-4, 0, 64), rng.standard_normal((9, 1)), rng.standard_normal((9, 2)), q,
        np.repeat(rng.standard_normal((500, 8)), 8, axis=1) + 1e-7 * rng.standard_normal((500, 64)),
    ]
    for x in cases:
        checked(x)


def test_qd_values_are_relatively_right():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 50):
        a, b = 10.0 ** rng.uniform(-6, 0, n), 10.0 ** rng.uniform(-6, 0, n - 1)
        known = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
        got = whitening.dqds(a, b)
        assert np.allclose(got[: n // 2 + 1], known[: n // 2 + 1], rtol=1e-9)
        # The product of all squared values is known exactly.
        assert np.isclose(np.log(got).sum(), 2 * np.log(a).sum(), rtol=1e-12)


def run(spark, tmp_path, rows, columns=COLUMNS):
    spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return whitening.op12_whitening(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("d", [3, 40])
def test_query_against_brute_force(spark, tmp_path, d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((300, d)).astype(np.float32) @ np.diag(np.linspace(1, 3, d)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[0].tolist())]
    odd = [(900, None), (901, []), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1)), (904, [None] + [0.0] * (d - 1)), (905, [1.0] * (d + 1))]
    got = run(spark, tmp_path, rows + odd)
    k = min(d, 32)
    assert len(got) == len(rows) * k and {r["vec_id"] for r in got} == {i for i, _ in rows}
    m = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1000000 for c in v] for _, v in rows])
    n, s = len(m), m.sum(axis=0)
    centred = m - s / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    w = centred @ vectors / np.sqrt(values)
    table = {}
    for r in got:
        table.setdefault(r["component"], {}).setdefault(r["vec_id"], r)
        assert r["n"] == n and r["identity_error"] < 1e-9
    for j in range(k):
        own = np.array([table[j + 1][i]["whitened"] for i, _ in rows])
        assert min(np.abs(own - w[:, j]).max(), np.abs(own + w[:, j]).max()) < 1e-7
        assert abs(table[j + 1][0]["explained"] / (values[j] / np.trace(cov)) - 1) < 1e-9
    for at, (i, _) in enumerate(rows):
        assert table[1][i]["deviation"] == sum(int(v) ** 2 for v in n * m[at] - s)


def test_tables_without_a_fit(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(1, None)]) == []
    assert run(spark, tmp_path, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = run(spark, tmp_path, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])
    assert [(r["vec_id"], r["component"], abs(r["whitened"]), r["explained"]) for r in got] == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_many_tasks_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2500, 5)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "a", 1) for i, v in enumerate(x)], COLUMNS + ", x string, k int").repartition(40)
    fitted = whitening.fit(rows)
    m = np.floor(64 * x.astype(float)) + 1000000
    known = np.linalg.eigvalsh(np.cov(m.T, bias=True))[::-1]
    assert fitted.n == 2500 and np.allclose(fitted.values, known, rtol=1e-10) and whitening.identity_error(rows, fitted) < 1e-10
    assert whitening.whiten(rows, fitted).count() == 2500


def test_deviations_beyond_a_long(spark):
    fitted = whitening.Whitening(1 << 40, np.array([1 << 41]), np.ones((1, 1)), np.ones(1), 1.0)
    rows = spark.createDataFrame([(1, [1.0]), (2, [-(1e6 - 2) / 64])], COLUMNS)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(rows, fitted).collect()}
    assert got[1] is None and got[2] == Fraction(0)
