"""Operator 6: quality classifier.

Each text gives a vector of statistics.  Random Fourier features approximate a
Gaussian kernel over the scaled statistics; every partition sums its part of the
normal equations of the labelled rows, Spark adds the parts, and the small system
gives ridge scores.  Isotonic calibration on labelled rows that the ridge did not
see turns scores into chances.

Only sums of a fixed size (the square of the number of features) and a histogram
of ``BINS`` score bins reach the driver.  Labelled rows are all used, in place.

Defined results.  Null text is the empty text and is scored.  Rows without a
label, or whose label is null, teach nothing.  With no labelled rows, or only one
label, every score is the share of label 1 (one half without any).  Repeated
label rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plebis.llm.common import durable, table

STATISTICS = 20
FOURIER, WIDTH, RIDGE, BINS, SEED = 192, 3.0, 1.0, 512, 6


def statistics(text: str) -> list[float]:
    """Length, shape and repetition of a text; nothing that depends on its language."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    high = counts[128:].sum()
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n_words = max(1, len(words))
    distinct = len(set(words))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n_words
    some = counts[counts > 0] / n
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        mean,
        (sum(x * x for x in lengths) / n_words - mean * mean) ** 0.5 if words else 0.0,
        upper / n,
        lower / n,
        digit / n,
        high / n,
        counts[[33, 63]].sum() / n_words,
        counts[[44, 46]].sum() / n_words,
        counts[[35, 36, 37, 38, 42, 64, 94, 95, 126]].sum() / n_words,
        counts[124] / n_words,
        counts[[60, 62, 123, 125, 91, 93, 40, 41, 47, 92]].sum() / n_words,
        counts[10] / n_words,
        distinct / n_words,
        distinct / n_words**0.75,
        len(set(lines)) / max(1, len(lines)),
        n_words / max(1, len(lines)) / 100,
        upper / max(1, upper + lower),
        float(-(some * np.log2(some)).sum()) if len(raw) else 0.0,
    ]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["key", "x"]
            )

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, x array<double>")


class Fourier:
    """Cosine features of the scaled statistics, with a constant at the end."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, deviation
        self.directions = rng.normal(0, 1 / WIDTH, (STATISTICS, FOURIER))
        self.phases = rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.deviation, -6, 6)
        waves = np.sqrt(2 / FOURIER) * np.cos(scaled @ self.directions + self.phases)
        return np.hstack([waves, scaled, np.ones((len(x), 1))])


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, in weighted least squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, at: np.ndarray, chance: np.ndarray):
        self.fourier, self.weights, self.at, self.chance = fourier, weights, at, chance

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.chance[0])
        raw = self.raw(x)
        # Within a calibrated step the raw score keeps its say, on a small scale.
        return np.clip(np.interp(raw, self.at, self.chance) * 0.998 + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fit(labelled: DataFrame) -> Model:
    """Rows (x, y, tune): ridge on rows without ``tune``, calibration on the others."""
    moments = (
        labelled.where("not tune")
        .select(F.posexplode("x").alias("i", "v"))
        .groupBy("i")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
        .orderBy("i")
        .toPandas()
    )
    share = labelled.agg(F.avg("y")).first()[0]
    if len(moments) != STATISTICS or share in (None, 0.0, 1.0):
        return Model(None, None, np.zeros(1), np.array([0.5 if share is None else share]))
    deviation = moments["deviation"].to_numpy()
    fourier = Fourier(moments["mean"].to_numpy(), np.where(deviation > 0, deviation, 1.0))
    d = FOURIER + STATISTICS + 1

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d + 1))
        for frame in frames:
            if len(frame):
                z = fourier(np.array(frame["x"].tolist()))
                total += z.T @ np.hstack([z, frame[["y"]].to_numpy(float)])
        yield pd.DataFrame({"i": np.arange(d), "sums": list(total)})

    rows = (
        labelled.where("not tune")
        .select("x", "y")
        .mapInPandas(equations, "i int, sums array<double>")
        .select("i", F.posexplode("sums").alias("j", "v"))
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    system = np.zeros((d, d + 1))
    system[rows["i"], rows["j"]] = rows["v"]
    weights = np.linalg.solve(system[:, :d] + RIDGE * np.eye(d), system[:, d])

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = fourier(np.array(frame["x"].tolist()).reshape(-1, STATISTICS)) @ weights
            bins = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            yield pd.DataFrame({"bin": bins, "y": frame["y"].to_numpy(float)})

    bins = (
        labelled.where("tune")
        .select("x", "y")
        .mapInPandas(binned, "bin int, y double")
        .groupBy("bin")
        .agg(F.avg("y").alias("y"), F.count("*").alias("n"))
        .orderBy("bin")
        .toPandas()
    )
    if not len(bins):
        return Model(fourier, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    # Each bin shrinks a little to the common share: no step says never or always.
    n = bins["n"].to_numpy(float)
    chance = pool_adjacent((bins["y"].to_numpy() * n + share) / (n + 1), n)
    return Model(fourier, weights, (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, chance)


def learn(vectors: DataFrame, labels: DataFrame, label: str, teach: Column, key: str = "doc_id") -> Model:
    """``teach`` is a condition on the labels' key; one row in five calibrates."""
    known = labels.where(teach & labels[label].isNotNull()).select(
        labels[key].alias("k"), labels[label].cast("double").alias("y")
    )
    tune = F.pmod(F.crc32(F.concat(F.lit("tune"), F.col("key").cast("string"))), F.lit(5)) == 0
    return fit(vectors.join(known, F.col("key") == F.col("k")).select("x", "y", tune.alias("tune")).transform(durable))


def apply(vectors: DataFrame, model: Model) -> DataFrame:
    kind = next(f.dataType.simpleString() for f in vectors.schema if f.name == "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["key", "score"])

    return vectors.select("key", "x").mapInArrow(run, f"key {kind}, score double")


def remainder(key: Column, by: int) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(by))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    vectors = document_statistics(table(spark, sf_dir, "documents")).transform(durable)
    model = learn(vectors, labels, "quality", remainder(labels["doc_id"], 4) != 2)
    return apply(vectors, model).select(
        F.col("key").alias("doc_id"),
        (remainder(F.col("key"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
