"""Operator 10: toxicity.

A convolutional text classifier.  Words are hashed twice into a table of
embeddings; filters of several widths slide over a whole text, max pooling keeps
each filter's strongest answer and a logistic layer weighs them.  It is trained
in numpy on a bounded sample of whole labelled texts (``SAMPLE`` texts and about
``SAMPLE_CHARS`` characters, least hashes of the key first), of which only 32-bit
word hashes leave the workers.  The first channel of
the embeddings starts from the words' log-odds in that sample and the rest at
random, so the filters begin near words that tell the labels apart.

Thresholds are calibrated by language.  The language is told from a text's own
function words, never from a column: each language's score is shifted so that
its best threshold on calibration rows falls on one half.

Scoring is row-local in Arrow batches over whole texts.

Defined results.  Null text is the empty text and is scored.  Rows without a
label teach nothing.  With no labelled rows, or only one label, every score is
the share of label 1 (zero without any).  Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis.llm.common import table
from plebis.llm.quality import remainder

#: Labelled texts that the network is fitted on, at most, and the characters of
#: those before the last of them.
SAMPLE, SAMPLE_CHARS = 12_000, 24_000_000
#: Texts that are scored together.
TOGETHER = 64
BUCKETS, CHANNELS, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
EPOCHS, RATE, DECAY, SEED = 4, 0.05, 1e-4, 10
PADDING = max(WIDTHS) - 1
#: Function words by which a text's language is told.
LANGUAGES = {
    "en": "the and of to that is for with this are",
    "de": "der die das und nicht ist von zu mit ein",
    "fr": "le les des et est une que pour dans qui",
    "es": "el los y del una que con para por las",
}


def _mixed(words: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(word: str) -> int:
    """32 bits, never 0."""
    return xxhash.xxh32_intdigest(word) | 1


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all lower-cased words (runs of letters) and where each
    text's words begin and end among them."""

    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(lower, r"[^\pL]+")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    hashes = np.fromiter(
        (_hash(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary)
    )
    words = hashes[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint32)
    kept = words != 0
    before = np.concatenate([[0], np.cumsum(kept)])
    return words[kept], before[offsets - offsets[0]]


def language_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of the language whose function words are most frequent."""
    counts = []
    for listed in LANGUAGES.values():
        hits = np.isin(words, np.array([_hash(w) for w in listed.split()], np.uint32))
        total = np.concatenate([[0], np.cumsum(hits)])
        counts.append(total[bounds[1:]] - total[bounds[:-1]])
    return np.argmax(np.array(counts), axis=0)


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of all sets and how many sets hold each."""
    flat = np.concatenate([np.zeros(0, np.uint32), *sets])
    sets.clear()
    flat.sort()
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)])
    return flat[first], np.diff(np.append(first, len(flat))).astype(np.float32)


class Network:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        # The last row is the padding between texts.
        self.embedding = rng.normal(0, 0.05, (BUCKETS + 1, CHANNELS)).astype(np.float32)
        self.embedding[-1] = 0
        self.filters = [rng.normal(0, 0.3, (w * CHANNELS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f, w in zip(self.filters, WIDTHS, strict=True):
            f[:: CHANNELS, : FILTERS // 2] = 1.0 / w
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.base = 0.0
        self.shift = np.zeros(len(LANGUAGES))
        self.constant: float | None = None

    @staticmethod
    def buckets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.uint64(BUCKETS)
        return (_mixed(words, 1) % size).astype(np.int64), (_mixed(words, 2) % size).astype(np.int64)

    def _padded(self, words: np.ndarray, bounds: np.ndarray):
        """Both bucket rows of each place, padded before each text and at the end so
        that no window that begins within a text or its padding reaches another."""
        n = np.diff(bounds)
        starts = np.concatenate([[0], np.cumsum(n + PADDING)])
        rows = np.full((2, starts[-1] + PADDING), BUCKETS, np.int64)
        at = np.arange(len(words)) + np.repeat(starts[:-1] + PADDING - bounds[:-1], n)
        rows[0, at], rows[1, at] = self.buckets(words)
        return rows, starts

    def _windows(self, rows: np.ndarray, w: int) -> np.ndarray:
        e = self.embedding[rows[0]] + self.embedding[rows[1]]
        n = len(e) - PADDING
        return np.hstack([e[k : k + n] for k in range(w)])

    def logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows, starts = self._padded(words, bounds)
        total = np.full(len(bounds) - 1, self.base)
        for k, w in enumerate(WIDTHS):
            answers = self._windows(rows, w) @ self.filters[k] + self.bias[k]
            pooled = np.maximum.reduceat(answers, starts[:-1], axis=0)
            total += np.maximum(pooled, 0) @ self.out[k * FILTERS : (k + 1) * FILTERS]
        return total

    def train(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, y: np.ndarray) -> None:
        """Stochastic gradient steps over small groups of texts, given by where each
        begins and ends among the words.  Max pooling lets through one window a
        filter and text, so only those are touched."""
        # A word counts once a text; its odds tell how it is shared by the labels.
        toxic, clean = (_counted([np.unique(words[a:b]) for a, b, t in zip(begin, end, y, strict=True) if t == label]) for label in (1, 0))
        distinct = np.union1d(toxic[0], clean[0])
        with_1, with_0 = (np.zeros(len(distinct), np.float32) for _ in range(2))
        with_1[np.searchsorted(distinct, toxic[0])] = toxic[1]
        with_0[np.searchsorted(distinct, clean[0])] = clean[1]
        del toxic, clean
        prior = 3.0
        share = y.mean()
        odds = np.log((with_1 + prior * share) / (len(y) * share + prior)) - np.log(
            (with_0 + prior * (1 - share)) / (len(y) * (1 - share) + prior)
        )
        # Where words meet in a bucket, the more frequent one sets it.
        order = np.argsort(with_1 + with_0, kind="stable")
        for rows in self.buckets(distinct[order]):
            self.embedding[rows, 0] = 0.25 * odds[order]
        del distinct, order, odds, with_1, with_0
        self.base = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(SEED)
        squares = [np.full(p.shape, 1e-6, np.float32) for p in (*self.filters, *self.bias, self.out)]
        seen = np.full((BUCKETS + 1, CHANNELS), 1e-4, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for group in np.array_split(order, max(1, len(y) // 32)):
                own = np.concatenate([words[begin[d] : end[d]] for d in group])
                ends = np.concatenate([[0], np.cumsum((end - begin)[group])])
                self._step(own, ends, y[group], squares, seen)

    def _step(self, words, bounds, y, squares, seen) -> None:
        rows, starts = self._padded(words, bounds)
        pooled, at, windows = [], [], []
        for k, w in enumerate(WIDTHS):
            x = self._windows(rows, w)
            answers = x @ self.filters[k] + self.bias[k]
            best = np.stack([answers[a:b].argmax(axis=0) + a for a, b in zip(starts[:-1], starts[1:], strict=True)])
            at.append(best)
            windows.append(x[best])  # text, filter, window
            pooled.append(np.take_along_axis(answers, best, axis=0))
        raw = np.hstack(pooled)
        active = np.maximum(raw, 0)
        z = self.base + active @ self.out
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32) / len(y)
        back = error[:, None] * self.out[None, :] * (raw > 0)

        def move(param, gradient, square):
            square += gradient * gradient
            param -= RATE * (gradient / np.sqrt(square) + DECAY * param)

        move(self.out, active.T @ error, squares[-1])
        np.maximum(self.out, 0, out=self.out)
        self.base -= RATE * float(error.sum())
        touched: list[np.ndarray] = []
        pushes: list[np.ndarray] = []
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            to_words = (g[:, :, None] * self.filters[k].T[None, :, :]).reshape(*g.shape, w, CHANNELS)
            for j in range(w):
                places = (at[k] + j).ravel()
                for row in rows:
                    touched.append(row[places])
                    pushes.append(to_words[:, :, j].reshape(-1, CHANNELS))
            move(self.filters[k], np.einsum("df,dfx->xf", g, windows[k]), squares[k])
            move(self.bias[k], g.sum(axis=0), squares[len(WIDTHS) + k])
        where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        push = np.zeros((len(where), CHANNELS), np.float32)
        np.add.at(push, inverse, np.concatenate(pushes))
        push[where == BUCKETS] = 0
        seen[where] += push * push
        self.embedding[where] -= RATE * 0.2 * push / np.sqrt(seen[where])

    def calibrate(self, logits: np.ndarray, y: np.ndarray, language: np.ndarray) -> None:
        """Each language's threshold: the middle of the gap with fewest errors."""
        overall = best_threshold(logits, y)
        for k in range(len(self.shift)):
            own = language == k
            enough = own.sum() >= 50 and 5 <= y[own].sum() < own.sum()
            self.shift[k] = best_threshold(logits[own], y[own]) if enough else overall

    def score(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        shifted = self.logits(words, bounds) - self.shift[language_of(words, bounds)]
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(logits, kind="stable")
    z, sorted_y = logits[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(sorted_y)]) + (len(y) - sorted_y.sum()) - np.concatenate([[0], np.cumsum(1 - sorted_y)])
    edges = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
    best = np.flatnonzero(wrong == wrong.min())
    # Among equally good places, the widest gap.
    gaps = np.concatenate([[0], np.diff(z), [0]])
    return float(edges[best[np.argmax(gaps[best])]])


def learn(
    docs: DataFrame, labels: DataFrame, label: str, teach: Column, key: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS,
) -> Network:
    """Fit on at most ``sample`` labelled texts, of which one in five calibrates; of
    them in order as many as hold ``sample_chars`` characters, and the one that
    passes this bound."""
    known = (
        labels.where(teach & labels[label].isNotNull())
        .select(labels[key].alias("k"), labels[label].cast("double").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("k"), "k", "y")
        .limit(sample)
    )
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("h"))
    # Rows are bounded, not ids: of repeated ids every different text is a row.
    order = [F.xxhash64("k"), F.col("k"), F.col("y"), F.col("chars"), F.col("h")]
    rows = (
        texts.select("key", "h", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
        .join(F.broadcast(known), F.col("key") == F.col("k"))
        .select("k", "y", "chars", "h")
        .distinct()
        .orderBy(*order)
        .limit(sample)
    )
    # At most ``sample`` rows of numbers meet in one window.
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chosen = rows.withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(F.col("before") < sample_chars).select("k", "y", F.col("h").alias("own"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = hashed_words(batch.column(2))
            packed = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            tied = pa.array([xxhash.xxh3_64_intdigest(p) for p in packed], pa.uint64()).cast(pa.int64(), safe=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tied, pa.array(packed, pa.binary())], names=["k", "y", "tie", "words"])

    met = texts.join(F.broadcast(chosen), (F.col("key") == F.col("k")) & (F.col("h") == F.col("own")))
    taught = met.groupBy("k", "y", "h").agg(F.first("text").alias("text"))  # at most ``sample`` rows
    found = taught.select(F.col("k").cast("string"), "y", "text").mapInArrow(words_of, "k string, y double, tie long, words binary").toArrow()
    # Rows come in any order; the same rows give the same network.
    order = pc.sort_indices(found.select(["k", "y", "tie"]), [(c, "ascending") for c in ("k", "y", "tie")]).to_numpy()
    y = found["y"].to_numpy()[order]
    model = Network()
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    end = np.cumsum(pc.binary_length(found["words"]).to_numpy()[order].astype(np.int64)) // 4
    begin = np.concatenate([[0], end[:-1]])
    words = np.empty(int(end[-1]), np.uint32)
    column = found["words"].combine_chunks()
    for k, (a, b) in enumerate(zip(begin, end, strict=True)):
        words[a:b] = np.frombuffer(column[order[k]].as_buffer(), np.uint32)
    del found, column
    pa.default_memory_pool().release_unused()
    tune = np.arange(len(y)) % 5 == 0
    fit = ~tune
    if y[fit].min() == y[fit].max():  # too few rows to part
        fit[:] = tune[:] = True
    model.train(words, begin[fit], end[fit], y[fit])
    logits, languages = [], []
    for at in np.array_split(np.flatnonzero(tune), -(-int(tune.sum()) // TOGETHER)):
        own = np.concatenate([words[begin[d] : end[d]] for d in at])
        bounds = np.concatenate([[0], np.cumsum((end - begin)[at])])
        logits.append(model.logits(own, bounds))
        languages.append(language_of(own, bounds))
    model.calibrate(np.concatenate(logits), y[tune], np.concatenate(languages))
    return model


def apply(docs: DataFrame, model: Network, text: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the score.  The network, a few MB
    whatever the corpus, is sent once an executor."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != into]
    schema = docs.select(*[docs[c] for c in rest]).schema.add(into, "double")
    nth = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            texts = batch.column(nth)
            for at in range(0, len(texts), TOGETHER):
                scores.append(shared.value.score(*hashed_words(texts.slice(at, TOGETHER))))
            made = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    return docs.select(*[docs[c] for c in rest]).mapInArrow(run, schema)


def model_for(spark, docs: DataFrame, sf_dir: str) -> Network:
    labels = table(spark, sf_dir, "labels")
    return learn(docs, labels, "toxic", remainder(labels["doc_id"], 5) != 0)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = apply(docs, model_for(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
