import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plebis.llm import jaccard


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    known = defaultdict(list)
    for i, t in rows:
        if sets_of(t) and i is not None:
            known[sets_of(t)].append(i)
    keys = list(known)
    parent = {i: i for i, _ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for n, a in enumerate(keys):
        for i in known[a]:
            union(i, known[a][0])
        for b in keys[:n]:
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                union(known[a][0], known[b][0])
    return {i: find(i) for i in parent}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for k in range(40):  # clusters of near copies, chained and not
        text = rng.choices(words, k=rng.randint(3, 160))
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    for _ in range(60):
        rows.append((len(rows), passage + " " + " ".join(rng.choices(words, k=rng.randint(1, 90)))))
    base = rng.choices(words, k=90)
    for _ in range(80):  # a large group
        text = list(base)
        text[rng.randrange(90)] = rng.choice(words)
        rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", "one", "ONE", "one two three", "a b c d", "A B C D", "a b c d e"])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["key"]: r for r in jaccard.classes(docs).collect()}
    assert {k: r["component"] for k, r in got.items()} == brute(rows)
    assert all(got[i]["n_shingles"] == len(sets_of(t)) for i, t in rows)


@pytest.mark.parametrize("side, pivots, few, broadcast", [(8, 2, 3, 0), (8, 1, 16, 1000), (4, 3, 1, 0)])
def test_large_bundles_and_joined_order(spark, monkeypatch, side, pivots, few, broadcast):
    for name, value in (("SIDE", side), ("PIVOTS", pivots), ("FEW", few), ("BROADCAST_KEYS", broadcast)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["key"]: r["component"] for r in jaccard.classes(docs).collect()} == brute(rows)


def test_one_key_with_several_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (3, "c"), (3, "d"), (4, b + " x")]
    kept = sorted(map(tuple, jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept == [(1, a), (2, b), (3, "c"), (3, "d")]


def test_keep_one_and_odd_rows(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(3, text, 1), (7, text, 1), (7, text, 1), (3, text, 1), (None, text, 1), (1, None, 1), (2, "", 1), (8, text + " x", 1), (9, "other", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid long")
    found = jaccard.classes(docs).collect()
    assert len(found) == len(rows) and {(r["key"], r["component"]) for r in found} == {(3, 3), (7, 3), (8, 3), (None, None), (1, 1), (2, 2), (9, 9)}
    kept = sorted(((r["doc_id"] if r["doc_id"] is not None else -1) for r in jaccard.keep_one(docs).collect()))
    assert kept == [-1, 1, 2, 3, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.classes(docs).count() == 0 and jaccard.keep_one(docs).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {a: find(a) for a in parent if find(a) != a}
    assert jaccard.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_whole_sets_are_shuffled_once(spark):
    """Apart from packed n-grams for the counts, sets go whole to none but the comparisons that need them."""
    rng = random.Random(8)
    rows = []
    for k in range(0, 240, 2):  # near copies two by two: every document stays open
        text = [f"w{rng.randrange(10**6)}" for _ in range(500)]
        rows += [(k, " ".join(text)), (k + 1, " ".join([*text[:-3], "x", f"y{k}", "z"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def stages():
        store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    name = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        before = stages()
        got = {r["key"]: r["component"] for r in jaccard.classes(docs).collect()}
        written = sum(v for k, v in stages().items() if k not in before)
    finally:
        spark.conf.set(name, usual)
    assert got == {k: k - k % 2 for k, _ in rows}
    whole = sum(8 * len(sets_of(t)) for _, t in rows)
    assert written < 4.5 * whole, written / whole
