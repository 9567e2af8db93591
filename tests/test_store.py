"""Versions, failed commits, rollbacks and upserts that leave other parts alone."""

import pytest
from pyspark.sql import functions as F

from plebis.sources.store import Change, Conflict, Store, upsert_turnout
from plebis.streaming import ingest

TURNOUT = "election_round_id long, polling_station_id long, registered_voters long, ballots_cast long, valid_ballots long, invalid_ballots long"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def people(spark, *given):
    return spark.createDataFrame([(i,) for i in given], "id long")


def test_a_failed_commit_leaves_the_old_version(spark, store):
    store.commit({"person": Change(people(spark, 1, 2))})
    broken = people(spark, 3).withColumn("id", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.commit({"person": Change(people(spark, 9)), "candidacy": Change(broken)})
    assert store.versions() == [1] and ids(store.read("person")) == [1, 2]
    with pytest.raises(LookupError):
        store.read("candidacy")
    # What the failed commit wrote goes with the next clearing, what is named stays.
    assert store.vacuum() >= 1 and ids(store.read("person")) == [1, 2]


def test_reruns_rollbacks_and_old_versions(spark, store):
    assert store.commit({"person": Change(people(spark, 1))}, key="a") == 1
    assert store.commit({"person": Change(people(spark, 2))}, key="b") == 2
    assert store.commit({"person": Change(people(spark, 3))}, key="b") == 2 and ids(store.read("person")) == [2]
    assert store.rollback(1) == 3 and ids(store.read("person")) == [1] and ids(store.read("person", 2)) == [2]
    store.vacuum(keep=1)
    assert store.versions() == [3] and ids(store.read("person")) == [1]
    with pytest.raises(LookupError):
        store.read("person", 2)


def test_of_two_commits_from_one_version_one_wins(spark, store, monkeypatch):
    store.commit({"person": Change(people(spark, 1))})
    store.commit({"person": Change(people(spark, 2))}, base=1)
    with pytest.raises(Conflict):
        store.commit({"person": Change(people(spark, 3))}, base=1)
    # The other commit comes in after the check: the rename tells.
    monkeypatch.setattr(store, "versions", lambda: [1])
    with pytest.raises(Conflict):
        store.commit({"person": Change(people(spark, 3))})
    monkeypatch.undo()
    assert ids(store.read("person")) == [2]


def test_untouched_parts_keep_their_files(spark, store):
    rows = spark.createDataFrame([(r, s, 10, 8, 7, 1) for r in (1, 2, 3) for s in range(20)], TURNOUT)
    upsert_turnout(store, rows)
    before = store.manifest()["tables"]["turnout"]["folders"]
    load = spark.createDataFrame([(2, 5, 1, 1, 1, 0), (2, 5, 2, 2, 2, 0), (4, 1, 9, 9, 9, 0)], TURNOUT)
    upsert_turnout(store, load)
    after = store.manifest()["tables"]["turnout"]["folders"]
    assert {p for p in after if before.get(p) != after[p]} == {"2", "4"} and set(after) == {"1", "2", "3", "4"}
    got = {(r[0], r[1]): r[2] for r in store.read("turnout").collect()}
    assert len(got) == 61 and got[2, 5] == 3 and got[4, 1] == 9 and got[1, 5] == 10
    assert {r[0] for r in store.read("turnout", parts=[4]).collect()} == {4}
    assert len(store.read("turnout", parts=[4]).inputFiles()) < len(store.read("turnout").inputFiles())
    with pytest.raises(ValueError, match="outside"):
        store.commit({"turnout": Change(load, "election_round_id", [2])})


def test_dry_run_counts_and_writes_nothing(spark, store):
    store.commit({"person": Change(people(spark, 1, 1, 2, 3))})
    told = store.dry_run({"person": Change(people(spark, 1, 3, 4, 4)), "new": Change(people(spark, 1))}).orderBy("table_name").collect()
    assert [tuple(r) for r in told] == [("new", 0, 1, 0), ("person", 4, 2, 2)] and store.versions() == [1]


def test_null_parts_and_empty_loads(spark, store):
    rows = spark.createDataFrame([(None, 1), (2, 2)], "g long, id long")
    store.commit({"t": Change(rows, "g")})
    store.commit({"t": Change(rows.where("g is null").withColumn("id", F.lit(7).cast("long")), "g", [None])})
    assert ids(store.read("t")) == [2, 7] and ids(store.read("t", parts=[None])) == [7]
    store.commit({"t": Change(rows.limit(0), "g", [2])})
    assert ids(store.read("t")) == [7] and store.read("t", parts=[2]).count() == 0


def test_a_stream_writes_versions(spark, store, tmp_path):
    for rows in ([(1, 1, 5, 4, 4, 0), (1, 1, 5, 4, 4, 0), (2, 2, 1, 1, 1, 0)], [(2, 2, 9, 8, 7, 1)]):
        spark.createDataFrame(rows, TURNOUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.turnout_stream(spark, str(tmp_path / "in"), TURNOUT)
        ingest.upsert_versions(stream, store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.versions() == [1, 2] and store.manifest()["key"] == "batch-1"
    first, second = (store.manifest(n)["tables"]["turnout"]["folders"] for n in (1, 2))
    assert first["1"] == second["1"] and first["2"] != second["2"]
    assert sorted(tuple(r)[:3] for r in store.read("turnout").collect()) == [(1, 1, 10), (2, 2, 9)]


@pytest.mark.parametrize("name", ["wipe_committed", "wipe_dry_run"])
def test_wipes_join_the_order_lines_once(spark, data, monkeypatch, name):
    """All tables of a wipe come from votes that are written once, and what is left from the
    tables of the first version."""
    from plebis.plans import catalog
    from plebis.plans.fixtures import Tables

    made = []
    raw = Tables.raw
    monkeypatch.setattr(Tables, "raw", lambda self, table: (made.append(table), raw(self, table))[1])
    df = catalog.QUERIES[name](spark, data)
    assert made.count("lineitem") == 1
    assert "lineitem.parquet" not in df._jdf.queryExecution().executedPlan().toString()


def test_turnout_of_several_files_is_summed_from_files(spark, data):
    from plebis.plans import catalog

    plan = catalog.QUERIES["turnout_sum_duplicates"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "Join" not in plan


def test_the_dry_run_of_a_wipe_tells_of_every_table_it_wipes(spark, data):
    """Turnout as well: what is left by the dry run is what the wipe leaves."""
    from plebis.plans import catalog
    from plebis.plans.upkeep_queries import WIPED

    told = {r["table_name"]: r for r in catalog.QUERIES["wipe_dry_run"](spark, data).collect()}
    assert set(told) == set(WIPED) and told["turnout"]["removed"] > 0
    for r in catalog.QUERIES["wipe_district"](spark, data).collect():
        n = told[r["table_name"]]
        assert n["before"] + n["added"] - n["removed"] == r["n"]
