"""Quality and toxicity: held-out accuracy and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plebis.llm import quality, toxicity


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 9))) for _ in range(3000)]
    rude = ["vilex", "moronx", "grubz"]
    rows = []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 120))
        junk, toxic = rng.random() < 0.2, rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words).capitalize() + "."
        rows.append((k, text, int(not junk), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, k) for k, t, _, _ in rows] + [(5000, None, 1), (5001, "", 1), (5001, "", 1), (None, "x", 1)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(k, q, x) for k, _, q, x in rows] + [(5000, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_quality(tables):
    rows, docs, labels = tables
    vectors = quality.document_statistics(docs)
    model = quality.learn(vectors, labels, "quality", quality.remainder(labels["doc_id"], 4) != 2)
    got = quality.apply(vectors, model).select("key", "score", (quality.remainder(F.col("key"), 4) == 2).alias("held")).collect()
    truth = {k: q for k, _, q, _ in rows}
    held = [(r["score"] >= 0.7) == truth[r["key"]] for r in got if r["held"] and r["key"] in truth]
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in got)
    assert len(held) > 100 and np.mean(held) >= 0.97


def test_toxicity(tables):
    rows, docs, labels = tables
    model = toxicity.learn(docs, labels, "toxic", toxicity.remainder(labels["doc_id"], 5) != 0)
    got = toxicity.apply(docs, model).select("doc_id", "score", (toxicity.remainder(F.col("doc_id"), 5) == 0).alias("held")).collect()
    truth = {k: x for k, _, _, x in rows}
    held = [(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["held"] and r["doc_id"] in truth]
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in got)
    assert len(held) > 100 and np.mean(held) >= 0.95


def test_no_labels(spark, tables):
    _, docs, labels = tables
    none = labels.limit(0)
    vectors = quality.document_statistics(docs)
    assert {r["score"] for r in quality.apply(vectors, quality.learn(vectors, none, "quality", F.lit(True))).collect()} == {0.5}
    assert {r["score"] for r in toxicity.apply(docs, toxicity.learn(docs, none, "toxic", F.lit(True))).collect()} == {0.0}
    one = labels.where("quality = 1")
    assert {r["score"] for r in quality.apply(vectors, quality.learn(vectors, one, "quality", F.lit(True))).collect()} == {1.0}
    assert quality.document_statistics(docs.limit(0)).count() == 0


def test_pool_adjacent():
    assert quality.pool_adjacent(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.ones(5)).tolist() == pytest.approx([0.1, 1 / 3, 1 / 3, 1 / 3, 0.9])


def test_long_text_is_read_whole(spark, tables):
    _, docs, labels = tables
    model = toxicity.learn(docs, labels, "toxic", F.lit(True))
    long = "abc def " * 30_000
    words, bounds = toxicity.hashed_words(__import__("pyarrow").array([long + "vilex grubz moronx", long]))
    scores = model.score(words, bounds)
    assert scores[0] >= 0.5 > scores[1]


def test_two_labels_are_enough(spark):
    docs = spark.createDataFrame([(1, "vilex grubz"), (2, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.apply(docs, toxicity.learn(docs, labels, "toxic", F.lit(True))).collect()}
    assert 0 <= got[2] < got[1] <= 1


def test_sample_is_bounded_by_characters(spark, tables):
    rows, docs, labels = tables
    few = toxicity.learn(docs, labels, "toxic", F.lit(True), sample_chars=20_000)
    got = toxicity.apply(docs, few).select("doc_id", "score").collect()
    truth = {k: x for k, _, _, x in rows}
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.7


def test_network_against_loops():
    """Each filter at every place by itself, the greatest answer of a text, then the sum."""
    rng = np.random.default_rng(4)
    net = toxicity.Network()
    net.bias = [rng.normal(0, 0.2, b.shape).astype(np.float32) for b in net.bias]
    net.out, net.base = rng.normal(0, 1, net.out.shape).astype(np.float32), 0.3
    sizes = [0, 1, 2, 7, 40, 0, 13]
    words = rng.integers(1, 1 << 32, sum(sizes), dtype=np.uint64).astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = net.logits(words, bounds)
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        first, second = net.buckets(words[a:b])
        places = [net.embedding[i] + net.embedding[j] for i, j in zip(first, second, strict=True)]
        blank = np.zeros(toxicity.CHANNELS, np.float32)
        z = net.base
        for k, w in enumerate(toxicity.WIDTHS):
            padded = [blank] * toxicity.PADDING + places + [blank] * toxicity.PADDING
            windows = [np.concatenate(padded[at : at + w]) for at in range(len(places) + toxicity.PADDING)]
            for f in range(toxicity.FILTERS):
                answer = max(float(x @ net.filters[k][:, f]) + float(net.bias[k][f]) for x in windows)
                z += max(0.0, answer) * float(net.out[k * toxicity.FILTERS + f])
        assert got[d] == pytest.approx(z, abs=1e-3)
        # Neighbours have no say.
        assert net.logits(words[a:b], np.array([0, b - a]))[0] == pytest.approx(got[d], abs=1e-4)


def test_ridge_against_all_rows_at_once(tables):
    """Sums by partition give the weights that all rows in one matrix give."""
    rows, docs, labels = tables
    vectors = quality.document_statistics(docs)
    model = quality.learn(vectors.repartition(7), labels, "quality", F.lit(True))
    truth = {k: q for k, _, q, _ in rows}
    tune = F.pmod(F.crc32(F.concat(F.lit("tune"), F.col("key").cast("string"))), F.lit(5)) == 0
    known = [r for r in vectors.where(~tune).collect() if r["key"] in truth]
    x, y = np.array([r["x"] for r in known]), np.array([float(truth[r["key"]]) for r in known])
    deviation = x.std(axis=0)
    z = quality.Fourier(x.mean(axis=0), np.where(deviation > 0, deviation, 1.0))(x)
    stacked = np.vstack([z, np.sqrt(quality.RIDGE) * np.eye(z.shape[1])])
    weights = np.linalg.lstsq(stacked, np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ weights, atol=1e-4)


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    """One id with a thousand texts and one row repeated a thousand times: rows are
    bounded, whatever the ids."""
    rows = [(1, f"text number {k} of one id") for k in range(1000)] + [(2, "the same row")] * 1000 + [(k, f"other text {k}") for k in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] * 20, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.Network, "train", lambda self, words, begin, end, y: seen.append(len(y)))
    monkeypatch.setattr(toxicity.Network, "logits", lambda self, words, bounds: np.zeros(len(bounds) - 1))
    monkeypatch.setattr(toxicity.Network, "calibrate", lambda self, logits, y, language: seen.append(len(y)))
    toxicity.learn(docs, labels, "toxic", F.lit(True), sample=40)
    toxicity.learn(docs, labels, "toxic", F.lit(True), sample_chars=60)
    # At most as many again calibrate, where there are too few to part.
    assert seen[0] + seen[1] <= 2 * 40 and (len(seen) == 2 or seen[2] <= 5)
