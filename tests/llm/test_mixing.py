import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plebis.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing what is above the ceiling until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.fixture(scope="module")
def corpus(docs_of):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["hot"] * 6 + ["a", "b", "Ž", None, "z"])) for k in range(900)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " \n ", "empty"), (None, "x y", "a"), (5, "again and again", "b"), (5, "again and again", "b")]
    return rows, docs_of(rows)


@pytest.fixture(scope="module")
def plan(corpus):
    return mixing.plan_documents(corpus[1], n_shards=4, n_blocks=64).collect()


def test_targets_and_takes(corpus, plan):
    rows, _ = corpus
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len((text or "").split())
        sizes[source] += n
        largest[source] = max(largest[source], n)
    expected = water(sizes)
    assert len(plan) == len(rows)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert len(r["draws"]) <= 2
        taken[r["source"]] += len(r["draws"]) * r["size"]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(1, largest[s])


def test_reruns_agree(corpus, plan):
    again = mixing.plan_documents(corpus[1].repartition(7), n_shards=4, n_blocks=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))


def test_mixture_repeats_what_is_drawn(corpus, plan):
    got = mixing.mix(corpus[1].withColumn("draws", F.lit(1)).withColumn("h", F.lit(2)), n_shards=4, n_blocks=64)
    assert got.columns == [*corpus[1].columns, "draws", "h"]
    assert got.count() == sum(len(r["draws"]) for r in plan)


def test_split_keeps_quotas(spark):
    quotas = spark.createDataFrame([(1, 700), (2, 0), (3, 123), (4, 1)], "nth int, quota long")
    rows = mixing.split_quotas(quotas, 8, 3).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["n_draws"] >= 0
        by_source[r["nth"]] += r["n_draws"]
        by_shard[r["shard"]] += r["n_draws"]
    assert dict(by_source) == {1: 700, 2: 0, 3: 123, 4: 1}
    assert len(by_shard) == 8 and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_hypergeometric_moments(spark):
    u = (F.col("id") + 0.5) / 4000.0
    x = spark.range(4000).select(mixing.hypergeometric(F.lit(100), F.lit(30), F.lit(40), u).alias("x"))
    mean, var = x.agg(F.avg("x"), F.var_pop("x")).first()
    assert mean == pytest.approx(12, abs=0.02) and var == pytest.approx(40 * 0.3 * 0.7 * 60 / 99, rel=0.02)


def test_empty_table(docs_of):
    assert mixing.plan_documents(docs_of([]), n_shards=2).count() == 0
    assert mixing.mix(docs_of([]), n_shards=2).count() == 0


def test_small_sources_are_filled_from_later_blocks(docs_of):
    for seed in range(4):
        rows = [(k, " ".join(["w"] * (20_000 if k == 7 else 1_000)), "s") for k in range(50)]
        rows += [(100 + k, "w " * 3, "t") for k in range(5)]
        got = mixing.plan_documents(docs_of(rows), n_blocks=512, weights=(1.25, 1), share=1.25, seed=seed).collect()
        for source in "st":
            own = [r for r in got if r["source"] == source]
            taken = sum(r["size"] * len(r["draws"]) for r in own)
            assert own[0]["target"] - min(r["size"] for r in own) < taken <= own[0]["target"]


def test_the_tree_decides(corpus, plan, monkeypatch):
    """Another splitting of the same quotas gives other shards and other documents."""
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, n, seed: split(quotas, n, seed + 1))
    other = mixing.plan_documents(corpus[1], n_shards=4, n_blocks=64).collect()
    key = lambda rows, what: sorted((str(r["key"]), str(what(r["draws"]))) for r in rows)
    assert key(plan, lambda d: [x["shard"] for x in d]) != key(other, lambda d: [x["shard"] for x in d])
    assert key(plan, len) != key(other, len)
    shares = [sum(x["shard"] == k for r in plan for x in r["draws"]) for k in range(4)]
    assert min(shares) > 0.5 * max(shares)


def test_the_tree_decides_in_small_sources(docs_of, monkeypatch):
    """With blocks by each source's own size, also fifty documents a source."""
    rng = random.Random(3)
    docs = docs_of([(k, " ".join(["w"] * rng.randint(50, 150)), f"s{k % 6}") for k in range(300)])
    split = mixing.split_quotas
    drawn = []
    for shift in (0, 1):
        monkeypatch.setattr(mixing, "split_quotas", lambda quotas, n, seed: split(quotas, n, seed + shift))
        got = mixing.plan_documents(docs).collect()
        drawn.append({r["key"]: len(r["draws"]) for r in got})
        for source in {r["source"] for r in got}:
            own = [r for r in got if r["source"] == source]
            taken = sum(r["size"] * len(r["draws"]) for r in own)
            assert abs(taken - own[0]["target"]) <= 0.01 * own[0]["target"]
    assert sum(drawn[0][k] != drawn[1][k] for k in drawn[0]) > 30


def test_tree_is_a_small_plan(spark):
    """The driver holds the plan many times over: no value is written out where it is used."""
    quotas = spark.createDataFrame([(1, 300), (2, 7), (3, 5000)], "nth int, quota long")
    assert len(mixing.split_quotas(quotas, 64, 7)._jdf.queryExecution().optimizedPlan().toString()) < 50_000
