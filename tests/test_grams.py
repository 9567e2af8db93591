"""Searches by grams give what scans give."""

import random

import pytest
from pyspark.sql import functions as F

from plebis.operators import grams, lookup
from plebis.plans.fixtures import Tables
from plebis.sources.store import Store

TEXTS = ["Ana Marić", "ana", "an", "a", "", None, "banana", "ĐURĐA Ćosić", "50% za", "50_za", "100\\\\x", "İzmir", "a b", "aa", "x" * 300 + "ana", "žž", "😀 smile", "Ab"]
PATTERNS = ["%an%", "%ana%", "%a_a%", "%n%n%", "%a%", "%%", "_", "__", "%_a_%", "%\\%%", "%\\_za", "%ćos%", "%đur_a%", "%i̇zm%", "%😀%", "zz%", "%xana", "an", "%b %"]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(grams, "BLOCK", 7)


def rows_of(spark, texts):
    return spark.createDataFrame([(k * 3, t, random.Random(k).choice(TEXTS)) for k, t in enumerate(texts)] + [(None, "ana", "ana")], "id long, a string, b string")


def test_every_pattern_as_a_scan(spark, small, tmp_path):
    df = rows_of(spark, TEXTS)
    index = grams.Index(Store(spark, str(tmp_path / "s"))).build("t", df, ["a", "b"])
    for p in PATTERNS:
        like = F.lit(p)
        scan = df.where((F.ilike("a", like) | F.ilike("b", like)) & F.col("id").isNotNull())
        got = index.narrow("t", df, ["a", "b"], like).where("id is not null")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, scan.collect())), p


def test_a_load_writes_only_its_bins(spark, small, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = rows_of(spark, TEXTS)
    index = grams.Index(store).build("t", df, ["a"])
    before = store.manifest()["tables"]["grams_t"]["folders"]
    later = df.where("id <> 3 or id is null").withColumn("a", F.when(F.col("id") == 0, "newly named").otherwise(F.col("a")))
    index.refresh("t", later, ["a"], spark.createDataFrame([(0,), (3,)], "id long"))
    after = store.manifest()["tables"]["grams_t"]["folders"]
    assert {p for p in after if after[p] != before.get(p)} == {"0"}
    assert [r["id"] for r in index.narrow("t", later, ["a"], F.lit("%newly%")).collect()] == [0]
    assert 3 not in {r["id"] for r in index.narrow("t", later, ["a"], F.lit("%ana%")).collect()}


def test_only_the_lists_of_a_term_are_read(spark, data, tmp_path):
    t = Tables(spark, data).written()
    index = lookup.indexed(t, grams.Index(Store(spark, str(tmp_path / "s"))))
    plan = lookup.search_persons(t, "čić", index=index)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,cic)" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    for search in (lookup.search_persons, lookup.search_stations, lookup.search_parties):
        for q in ("an", "a_a", "1", "ta 1", "%%", "no such thing"):
            assert list(map(repr, search(t, q, index=index).collect())) == list(map(repr, search(t, q).collect())), q


def test_searches_read_people_and_lists_as_written(spark, data):
    from plebis.plans import catalog

    plan = catalog.QUERIES["search_indexed"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" not in plan and "lineitem.parquet" not in plan and "/votes-" not in plan
