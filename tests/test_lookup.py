"""Searches with short terms, unknown keys, order and title case."""

import pytest
from pyspark.sql import functions as F

from plebis import schema
from plebis.functions.names import croatian, title_case
from plebis.operators import lookup
from plebis.plans.fixtures import Tables


@pytest.fixture(scope="module")
def t(spark, data):
    return Tables(spark, data)


def test_short_terms_find_nothing(t):
    for search in (lookup.search_persons, lookup.search_parties, lookup.search_stations):
        assert search(t, "a").count() == 0 and search(t, " a ").count() == 0 and search(t, "").count() == 0
    assert lookup.search_persons(t, "an").count() > 0


def test_wildcards_of_a_search(t):
    whole = t.person.count()
    assert lookup.search_persons(t, "%%", k=10_000).count() == whole and lookup.search_persons(t, "A_A", k=10_000).count() > 0


def test_unknown_keys_are_told(t):
    with pytest.raises(lookup.Unknown, match="person -1"):
        lookup.person(t, -1)
    with pytest.raises(LookupError, match="station -5"):
        lookup.station(t, -5)
    with pytest.raises(LookupError, match="1800"):
        lookup.year_of(t, [schema.EUROPE], 1800)
    assert lookup.person(t, t.person.first()["id"]).count() == 1


def test_croatian_order(spark):
    names = ["Cer", "Čer", "Ćer", "Der", "Džep", "Đek", "Lon", "Ljut", "Nov", "Njeg", "Som", "Šum", "Zor", "Žir"]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    assert [r["name"] for r in rows.orderBy(croatian("name")).collect()] == names


def test_title_case_as_python_has_it(spark):
    texts = ["local votes 2votes", "ŽUPAN i zup-skupstina", "o'neil x1y", "", "čl.čl", None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k int, v string").select("k", "v", title_case(F.col("v")).alias("title"))
    for r in rows.collect():
        assert r["title"] == (r["v"].title() if r["v"] is not None else None), r["v"]


def test_siblings_by_blocks_give_all_pairs(spark, monkeypatch):
    from plebis.operators import scope

    monkeypatch.setattr(scope, "BLOCK", 3)
    places = [("a", "x")] * 10 + [("a", None)] * 4 + [(None, None)] * 5 + [(None, "x"), ("b", "x"), ("", "x"), ("", None)]
    rows = [(k, *p) for k, p in enumerate(places)] + [(None, "b", "x"), (20, "b", "x")]
    stations = spark.createDataFrame(rows, "id long, location string, address string")
    found = scope.siblings(stations)
    expected = [(a[0], b[0]) for a in rows for b in rows if a[1:] == b[1:]]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    # Dealt evenly after the blocks have met.
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_siblings_do_not_hold_the_pairs_of_two_blocks(spark):
    """The two explodes run apart: as one generated loop they would hold all pairs of two
    blocks, millions of rows, before giving the first."""
    import re

    from plebis.operators import scope

    found = scope.siblings(spark.createDataFrame([(k, "a", "x") for k in range(5)], "id long, location string, address string"))
    assert len(found.collect()) == 25
    final = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    loops = re.findall(r"(\*\(\d+\) )?Generate explode", final)
    assert len(loops) == 2 and len(set(loops)) == 2 and loops[0] != ""
