"""Kept sums answer as the facts do, also after a load."""

from pyspark.sql import functions as F

from plebis.operators import apportion, kept, profiles
from plebis.plans.fixtures import Tables
from plebis.sources.store import Store


def plain(df):
    return sorted(map(repr, df.collect()))


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_answers_before_and_after_a_load(spark, data, tmp_path):
    t = Tables(spark, data).written()
    store = Store(spark, str(tmp_path / "store"))
    k = kept.build(t, store)
    questions = {
        "history": lambda x: profiles.person_history(x),
        "seats": lambda x: apportion.parliament_seats(apportion.parliament_lists(x)),
        "europe": lambda x: apportion.europe_candidates(x, apportion.europe_lists(x)),
    }
    for ask in questions.values():
        assert plain(ask(k)) == plain(ask(t))
    # A load doubles the votes of two rounds.
    rounds = [r["id"] for r in t.election_round.orderBy("id").limit(2).collect()]
    before = {n: store.manifest()["tables"][n]["folders"] for n in kept.FACTS}
    later = Tables(spark, data).written()
    later.__dict__["votes"] = later.votes.withColumn("votes", F.when(F.col("round_id").isin(rounds), F.col("votes") * 2).otherwise(F.col("votes")))
    k = kept.refresh(later, store, rounds)
    for name, ask in questions.items():
        assert plain(ask(k)) == plain(ask(later)), name
    after = {n: store.manifest()["tables"][n]["folders"] for n in kept.FACTS}
    for n in kept.FACTS:
        assert {p for p in after[n] if after[n][p] != before[n].get(p)} <= {str(r) for r in rounds}
    assert scans(profiles.person_history(k)) < 40


def test_shared_tables_are_worked_out_once_and_leave_no_folder(spark, data, tmp_path, monkeypatch):
    import os

    from plebis.sources import store as stores

    staged, plain_staged = [], stores.Store._staged

    def noted(self, name, change, *rest):
        plan = change.rows._jdf.queryExecution().executedPlan().toString()
        staged.append((name, "votes-" in plan))
        return plain_staged(self, name, change, *rest)

    monkeypatch.setattr(stores.Store, "_staged", noted)
    t = Tables(spark, data).written()
    kept.build(t, Store(spark, str(tmp_path / "store")))
    # Of the tables that come from votes only districts and candidates' results are read there again.
    assert sorted(n for n, votes in staged if votes) == sorted([*kept.ASKED_OFTEN, "electoral_district", "candidate_result"])
    assert sorted(os.listdir(tmp_path / "store")) == ["_versions", "data"]
