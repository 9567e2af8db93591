"""Seats against a slow allocator, and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from plebis.operators import apportion, maintain
from plebis.sources import literals


def slow(votes, seats, floor):
    total = sum(v for _, v in votes)
    pool = [(v / d, v, -k) for k, v in votes if v >= total * floor for d in range(1, seats + 1)]
    pool.sort(reverse=True)
    out = {}
    for _, _, k in pool[:seats]:
        out[-k] = out.get(-k, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_highest_averages(spark, seed):
    rng = random.Random(seed)
    rows = [(d, d * 100 + k, rng.choice([5, 10, 20, 40, rng.randint(1, 500)]), rng.choice([1, 3, 14])) for d in range(6) for k in range(9)]
    seats = {d: n for d, _, _, n in rows}
    rows = [(d, k, v, seats[d]) for d, k, v, _ in rows]
    df = spark.createDataFrame(rows, "district_id long, electoral_list_id long, votes long, n_seats int")
    lists = apportion.passing(df, ["district_id"], only=F.col("n_seats") == 14)
    got = {}
    for r in apportion.highest_averages(lists.where("eligible"), ["district_id"]).collect():
        got.setdefault(r["district_id"], {})[r["electoral_list_id"]] = r["seats"]
    for d, n in seats.items():
        assert got[d] == slow([(k, v) for x, k, v, _ in rows if x == d], n, 0.05 if n == 14 else 0)


class Small:
    """Tables for one list of three candidates."""

    def __init__(self, spark, votes):
        self.candidacy = spark.createDataFrame([(k, k, 1, k) for k in votes], "id long, person_id long, electoral_list_id long, position_on_list int")
        rows = [(k, 1, v) for k, v in votes.items() if v]
        self.candidate_result = spark.createDataFrame(rows or [(0, 0, 0)], "candidacy_id long, polling_station_id long, votes long")


@pytest.mark.parametrize(
    "votes, seats, expected",
    [
        ({1: 0, 2: 5, 3: 30}, 2, [3, 1]),  # only the third reaches a tenth
        ({1: 40, 2: 40, 3: 40}, 2, [1, 2]),  # a tie goes by place
        ({1: 0, 2: 0, 3: 0}, 2, [1, 2]),  # nobody is promoted
        ({1: 12, 2: 50, 3: 30}, 5, [2, 3, 1]),  # fewer candidates than seats
    ],
)
def test_preferential(spark, votes, seats, expected):
    seated = spark.createDataFrame([(1, 100, seats)], "electoral_list_id long, votes long, seats long")
    got = apportion.preferential(Small(spark, votes), seated).orderBy("chosen").collect()
    assert [r["candidacy_id"] for r in got] == expected


def test_parliament_has_all_seats(spark, data):
    from plebis.plans.fixtures import Tables

    rows = apportion.parties(apportion.parliament_seats(apportion.parliament_lists(Tables(spark, data)))).groupBy("year").agg(F.sum("seats").alias("n")).collect()
    assert rows and all(140 <= r["n"] <= 147 for r in rows)


def test_summaries_are_consistent():
    for _, registered, cast, valid, invalid in literals.SUMMARIES:
        assert valid == cast - invalid and registered > cast


def test_shared_station_sums(spark):
    key = "election_round_id long, polling_station_id long, registered_voters long, ballots_cast long, valid_ballots long, invalid_ballots long"
    rows = spark.createDataFrame([(1, 1, 27, 21, 21, 0), (1, 1, 28, 25, 25, 0), (1, 2, 713, 500, 468, 32)], key)
    got = {r["polling_station_id"]: (r["registered_voters"], r["ballots_cast"], r["valid_ballots"]) for r in maintain.sum_turnout(rows).collect()}
    assert got == {1: (55, 46, 46), 2: (713, 500, 468)}


def test_merging_keeps_own_results(spark):
    stations = spark.createDataFrame([(1, 10, "001", "a"), (2, 11, "001", "b"), (3, 11, "002", "c")], "id long, municipality_id long, number string, name string")
    mapping = spark.createDataFrame([(11, 10)], "id long, canonical_id long")
    kept, merged = maintain.merged_stations(stations, mapping)
    assert sorted((r["id"], r["municipality_id"]) for r in kept.collect()) == [(1, 10), (3, 10)]
    assert [(r["id"], r["canonical_id"]) for r in merged.collect()] == [(2, 1)]
    facts = spark.createDataFrame([(5, 1, 9), (5, 2, 100), (6, 2, 7)], "electoral_list_id long, polling_station_id long, votes long")
    got = sorted(tuple(r) for r in maintain.move_results(facts, merged, ["electoral_list_id"]).collect())
    assert got == [(5, 1, 9), (6, 1, 7)]


def test_threshold_votes_round_half_to_even(spark):
    from types import SimpleNamespace

    from plebis import schema
    from plebis.operators import apportion

    frame = spark.createDataFrame
    t = SimpleNamespace(
        election_type=frame([(3, "eu", schema.EUROPE)], "id long, slug string, name string"),
        election=frame([(k, 3, 2000 + k, None) for k in (1, 2, 3)], "id long, election_type_id long, year int, name string"),
        election_round=frame([(k, k, 1, None) for k in (1, 2, 3)], "id long, election_id long, round_number int, date date"),
        electoral_list=frame([(k, k, f"L{k}", None) for k in (1, 2, 3)], "id long, election_round_id long, name string, district_id long"),
        list_result=frame([(1, 7, 1001), (2, 7, 1010), (3, 7, 1030)], "electoral_list_id long, polling_station_id long, votes long"),
    )
    got = {r["year"]: r["threshold_votes"] for r in apportion.europe_lists(t).collect()}
    assert got == {2001: 50, 2002: 50, 2003: 52}


def test_seats_by_divisor_on_ties(spark):
    """The same seats as by sorted quotients, on few votes and many ties."""
    import random

    from plebis.operators import apportion

    rng = random.Random(6)
    rows = []
    for district in range(300):
        n = rng.choice([1, 2, 3, 8, 14, 151])
        most = rng.choice([3, 10, 60, 10**6, 10**12])
        for k in range(rng.randint(1, 9)):
            rows.append((district, k, rng.choice([most, most // 2, rng.randint(1, most)]), n))
    rows += [(1000, 5, 0, 3), (1000, 6, 0, 3), (1001, 1, 0, 2), (1001, 2, 1, 2), (1002, 1, 7, 0)]
    lists = spark.createDataFrame(rows, "district_id long, electoral_list_id long, votes long, n_seats int")
    lists = lists.where("n_seats > 0")
    key = lambda df: sorted(map(tuple, df.select("district_id", "electoral_list_id", "seats").collect()))
    searched = apportion.by_divisor(lists, ["district_id"])
    assert key(searched) == key(apportion.highest_averages(lists, ["district_id"]))
    assert "Generate" not in searched._jdf.queryExecution().executedPlan().toString()
