"""Operator 12: embedding whitening by a bidiagonal qd solver.

Every task reduces its centred rows, block by block, to one triangle (QR of the triangle
so far and the next block); triangles are merged by sixteens until one, R, is left.
Householder reflections make R bidiagonal, dqds finds the singular values of the
bidiagonal to high relative accuracy, and a twisted factorisation at each of them gives its
vector; where values all but coincide, inverse iteration with orthogonalisation keeps the
vectors apart.  R'R is n times the covariance, so that right singular vectors are the
components and the squares over n the eigenvalues.

A task holds one block of rows and a triangle; the driver sees sums by dimension and one
triangle, both of a size that the vectors' length sets.  The whitened rows' covariance is
measured in a pass over all of them and not taken from R.

Defined results.  Vectors that are null, empty or hold null or non-finite entries take no
part; nor do those of another length than most have (of lengths as frequent the longest
counts).  Repeated rows and null ids take part like any.  Directions without variance, up to
rounding, cannot be whitened and give no component.  A squared deviation beyond a long is null.
An empty table, or one without variance, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plebis.llm.common import durable, table

#: Rows that a task takes up at once.
BLOCK = 2048
#: Triangles that are merged at once.
MERGED = 16
COMPONENTS = 32
EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector holds finite numbers only."""
    v = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False)))


def scaled(vector: str):
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + 1000000)


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one length, a block at a time, with their vectors as a matrix."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            b = whole.slice(at, BLOCK)
            values = b.column(column).flatten().to_numpy(zero_copy_only=False)
            yield b, values.reshape(b.num_rows, -1)


def sums(rows: DataFrame) -> DataFrame:
    """Column x to (length, place, n, total): exact sums of every dimension by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            lengths = np.asarray(b.column("x").value_lengths())
            for d in np.unique(lengths):
                own = b.filter(pa.array(lengths == d)).column("x")
                x = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                n, total = held.get(int(d), (0, np.zeros(d, dtype=np.int64)))
                held[int(d)] = (n + len(x), total + x.sum(axis=0))
        for d, (n, total) in held.items():
            yield pa.RecordBatch.from_pydict({"length": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = rows.select("x").mapInArrow(run, "length int, n long, total array<long>")
    each = parts.select("length", "n", F.posexplode("total").alias("place", "total"))
    return each.groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _triangle(upper: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if upper is None else np.vstack([upper, block]), mode="r")


def _flat(k: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})


def reduced(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The triangle R of all centred rows: R'R is the sum of their outer products."""
    spark, d = rows.sparkSession, len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, k = None, 0
        for b, x in blocks(batches, "x"):
            upper, k = _triangle(upper, x - mean), b.column("k")[0].as_py()
        if upper is not None:
            yield _flat(k, upper)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = None
        for _, r in sorted(((r["k"], r["r"]) for b in batches for r in b.to_pylist()), key=lambda x: x[0]):
            upper = _triangle(upper, np.array(r).reshape(-1, d))
        yield _flat(key[0].as_py(), upper)

    parts = durable(rows.select("x", F.spark_partition_id().cast("long").alias("k")).mapInArrow(run, "k long, r array<double>"))
    while parts.agg(F.max("k")).first()[0]:
        parts = durable(parts.groupBy(F.floor(F.col("k") / MERGED).alias("g")).applyInArrow(merge, "k long, r array<double>"))
    found = parts.first()
    r = np.array(found["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])  # fewer rows than dimensions


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: r = U B V' with B upper bidiagonal; its diagonal, what stands above
    it, and V."""
    a = r.copy()
    d = len(a)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not x[1:].any():
            return None
        u = x / norm
        u[0] += np.copysign(1.0, u[0])
        return u / np.linalg.norm(u)

    for i in range(d):
        if (u := reflector(a[i:, i])) is not None:
            a[i:, i:] -= 2 * np.outer(u, u @ a[i:, i:])
        if i < d - 2 and (u := reflector(a[i, i + 1 :])) is not None:
            a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ u, u)
            v[:, i + 1 :] -= 2 * np.outer(v[:, i + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal, falling, by differential quotient-difference
    sweeps with shifts; what is split off carries the shifts so far."""
    # The sweeps lose small values last when large ones come first.
    q, e = (diagonal**2).tolist(), (above**2).tolist()
    if q[0] < q[-1]:
        q, e = q[::-1], e[::-1]  # the same values: B and its flipped transpose
    q = [max(x, TINY) for x in q]
    found, shifted = [], 0.0
    while q:
        m = len(q)
        if m == 1 or e[-1] <= EPS**2 * (shifted + q[-1]):
            found.append(shifted + q.pop())
            e = e[: m - 2]
            continue
        # The smaller value of the last two rows, less what couples them to the rest.
        p, c, s = q[-2], e[-1], q[-1]
        half = (p + c + s) / 2
        low = p * s / (half + np.sqrt(max(half * half - p * s, 0.0)))
        tries = [max(low - np.sqrt(low * e[-2]) if m > 2 else low * (1 - 2 * EPS), 0.0), low / 4, 0.0]
        for shift in tries:
            swept = _sweep(q, e, shift)
            if swept is not None:
                break
        q, e = swept
        shifted += shift
    return np.sort(np.array(found))[::-1]


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds sweep; None where the shift passes the least value."""
    d, head, rest = q[0] - shift, [], []
    for i, x in enumerate(e):
        if shift and d <= 0:
            return None
        top = max(d + x, TINY)
        t = q[i + 1] / top
        head.append(top)
        rest.append(x * t)
        d = d * t - shift
    if d < 0:
        return None
    head.append(max(d, TINY))
    return head, rest


def twisted(d: np.ndarray, lower: np.ndarray, value: float) -> np.ndarray:
    """A unit vector of the tridiagonal L D L' at an eigenvalue: the factorisations from
    above and from below meet where the twist is smallest."""
    n = len(d)
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    floor = lambda x: x if abs(x) > TINY else TINY
    s[0] = -value
    for i in range(n - 1):
        down[i] = d[i] * lower[i] / floor(s[i] + d[i])
        s[i + 1] = down[i] * lower[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / floor(d[i] * lower[i] ** 2 + p[i + 1])
        up[i] = lower[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size else np.full(n, np.nan)


@dataclass
class Whitening:
    """n vectors with sums ``total``: the components' directions (one a column), their
    eigenvalues, and the sum of all variances."""

    n: int
    total: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of r (columns) and squared singular values, the ``most``
    largest that rounding does not explain."""
    size = np.abs(r).max(initial=0.0)
    if not size:
        return np.zeros((len(r), 0)), np.zeros(0)
    a, b, v = bidiagonal(r / size)
    values = dqds(a, b)
    kept = values[values > (len(a) * EPS) ** 2 * values[0] * 16][:most]
    safe = np.where(np.abs(a) > EPS**2, a, EPS**2)
    d, lower = safe**2, b / safe[:-1] if len(a) > 1 else b
    main, side = a**2, a[:-1] * b
    main[1:] += b**2
    t = np.diag(main) + np.diag(side, 1) + np.diag(side, -1)
    rng = np.random.default_rng(0)
    z: list[np.ndarray] = []
    for j, value in enumerate(kept):
        near = [z[i] for i in range(j) if kept[i] - value <= 1e-5 * kept[i]]
        own = twisted(d, lower, value)
        if near or not np.isfinite(own).all() or np.linalg.norm(t @ own - value * own) > 1e-12 * kept[0]:
            own = _iterated(t, value + (j + 1) * EPS * kept[0], own if np.isfinite(own).all() else rng.standard_normal(len(a)), near, rng)
        z.append(own)
    found = v @ np.array(z).T if z else np.zeros((len(r), 0))
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return found * signs, kept * size**2


def _iterated(t: np.ndarray, value: float, start: np.ndarray, near: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Inverse iteration at right angles to the vectors of all but equal values."""
    z = start
    for _ in range(4):
        for _ in range(2):
            for other in near:
                z = z - other * (other @ z)
        if np.linalg.norm(z) < 1e-6:
            z = rng.standard_normal(len(t))
            continue
        z = z / np.linalg.norm(z)
        try:
            z = np.linalg.solve(t - value * np.eye(len(t)), z)
        except np.linalg.LinAlgError:
            z = np.linalg.solve(t - value * (1 + 4 * EPS) * np.eye(len(t)) - TINY, z)
        z = z / np.linalg.norm(z)
    for _ in range(2):
        for other in near:
            z = z - other * (other @ z)
        z = z / np.linalg.norm(z)
    return z


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; None without any."""
    given = usable(rows, vector).select(scaled(vector).alias("x"))
    by_length = durable(sums(given))
    best = by_length.where("place = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        return None
    total = np.array([r["total"] for r in by_length.where(F.col("length") == best["length"]).orderBy("place").collect()])
    n = best["n"]
    r = reduced(given.where(F.size("x") == len(total)), total / n)
    found, squared = directions(r, components)
    return Whitening(n, total, found, squared / n, float((r**2).sum() / n))


def _whitened(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    return (x - fitted.mean) @ fitted.directions / np.sqrt(fitted.values)


def identity_error(rows: DataFrame, fitted: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity,
    summed over every row."""
    m = len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, total = np.zeros((m, m)), np.zeros(m)
        for _, x in blocks(batches, "x"):
            w = _whitened(x, fitted)
            product += w.T @ w
            total += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([[*product.ravel(), *total]], pa.list_(pa.float64()))})

    given = usable(rows, vector).where(F.size(vector) == len(fitted.total)).select(scaled(vector).alias("x"))
    each = given.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("place", "v"))
    found = np.array([r["v"] for r in each.groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()])
    product, mean = found[: m * m].reshape(m, m) / fitted.n, found[m * m :] / fitted.n
    return float(np.abs(product - np.outer(mean, mean) - np.eye(m)).max())


def whiten(rows: DataFrame, fitted: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for every usable vector: its key, ``whitened`` (array<double>, one entry a
    component) and ``deviation`` (exact sum of (n * x - S)^2)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[key].dataType

    def deviations(x: np.ndarray) -> list[int | None]:
        n = fitted.n
        rough = ((n * (x - fitted.mean)) ** 2).sum(axis=1)
        if rough.max(initial=0.0) < 2**62 and np.abs(fitted.total).max() < 2**62 and n * float(np.abs(x).max(initial=0)) < 2**62:
            return ((n * x - fitted.total) ** 2).sum(axis=1).tolist()
        exact = (sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, fitted.total)) for row in x)
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in blocks(batches, "x"):
            w = _whitened(x, fitted)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("key").cast(to_arrow_type(kind)), flat, pa.array(deviations(x), pa.int64())], names=["key", "whitened", "deviation"])

    given = usable(rows, vector).where(F.size(vector) == len(fitted.total)).select(F.col(key).alias("key"), scaled(vector).alias("x"))
    return given.mapInArrow(run, f"key {kind.simpleString()}, whitened array<double>, deviation long").withColumnRenamed("key", key)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = fit(rows)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(rows, fitted)
    shares = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values])
    each = whiten(rows, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
