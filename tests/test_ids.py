"""Ids of new rows: dense, going on from the largest, the same in every run."""

from pyspark.sql import functions as F

from plebis.operators import maintain


def made(df):
    return {(r["name"], r["town"]): (r["id"], r["place"]) for r in df.collect()}


def test_ids_go_on_without_gaps_and_reruns_agree(spark):
    known = spark.createDataFrame([(7, "a", 1, "x"), (3, None, 1, "y")], "id long, name string, town long, place string")
    rows = [(f"n{k % 500}", k % 3, f"p{k}", k) for k in range(3_000)] + [("a", 1, "later", 0), (None, 1, "later", 0), (None, None, "z", None), (None, None, "w", 5)]
    incoming = spark.createDataFrame(rows, "name string, town long, place string, seq int")
    once = maintain.get_or_create(known, incoming, ["name", "town"], ["place"])
    got = made(once)
    assert got["a", 1] == (7, "x") and got[None, 1] == (3, "y") and got[None, None][1] == "w"
    fresh = sorted(i for i, _ in got.values() if i > 7)
    assert fresh == list(range(8, 8 + 1_501)) and len(got) == 1_503
    assert all(got[f"n{k}", k % 3][1] == f"p{k}" for k in range(500))  # the first that came
    assert made(maintain.get_or_create(known, incoming.repartition(5), ["name", "town"], ["place"])) == got
    assert made(maintain.get_or_create(once, incoming, ["name", "town"], ["place"])) == got
    assert made(maintain.get_or_create(known.limit(0), incoming.limit(0), ["name", "town"], ["place"])) == {}


def test_keys_of_one_digest_stay_two_rows(spark):
    fresh = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    none = spark.createDataFrame([], "id long")
    got = maintain.numbered(fresh, ["name"], none, digest=lambda key: F.lit("0" * 32))
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]
