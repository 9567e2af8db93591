"""Sums by municipality that are kept on disk and follow the facts.

A store holds the tables of the model with its three facts summed by municipality:
each row carries the smallest polling station that its sum is of, so that every question
about a municipality, a county or the country reads them as it reads the facts; with them
the ballots at each list's own stations, which only the facts tell.  A
load changes some rounds; ``refresh`` sums those anew from the facts, and the parts of all
others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plebis.operators import profiles, totals
from plebis.sources.store import At, Change, Store

#: Facts and what their rows are about.
FACTS = {"list_result": "electoral_list_id", "candidate_result": "candidacy_id", "turnout": "election_round_id"}
MEASURES = {"list_result": ["votes"], "candidate_result": ["votes"], "turnout": list(totals.MEASURES)}
SMALL = ("county", "municipality", "polling_station", "election_type", "election", "election_round", "electoral_district", "electoral_list", "person", "candidacy")
#: Those that come from all votes and are asked for by more than one kept table.
ASKED_OFTEN = ("election", "election_round", "electoral_list", "candidacy", "list_result", "turnout")


def _rounds_of(t, fact: str) -> DataFrame | None:
    """(key, election_round_id) of what a fact is about; None where the key is the round."""
    lists = t.electoral_list.select(F.col("id").alias("electoral_list_id"), "election_round_id")
    if fact == "list_result":
        return lists
    if fact == "candidate_result":
        return t.candidacy.select(F.col("id").alias("candidacy_id"), "electoral_list_id").join(lists, "electoral_list_id").drop("electoral_list_id")
    return None


def sums(t, fact: str, rounds: list[int] | None = None) -> DataFrame:
    """A fact summed by municipality, with its round as ``round``."""
    key, of = FACTS[fact], _rounds_of(t, fact)
    rows = getattr(t, fact)
    rows = rows.withColumn("round", F.col(key)) if of is None else rows.join(of.withColumnRenamed("election_round_id", "round"), key)
    if rounds is not None:
        rows = rows.where(F.col("round").isin(rounds))
    places = t.polling_station.select(F.col("id").alias("polling_station_id"), "municipality_id")
    placed = rows.join(places, "polling_station_id").groupBy("round", key, "municipality_id")
    return placed.agg(F.min("polling_station_id").alias("polling_station_id"), *[F.sum(m).alias(m) for m in MEASURES[fact]]).drop("municipality_id")


def ballots(t, rounds: list[int] | None = None) -> DataFrame:
    """Valid ballots at the stations of each list, with its round as ``round``."""
    found = profiles.list_denominators(t).join(_rounds_of(t, "list_result").withColumnRenamed("election_round_id", "round"), "electoral_list_id")
    return found if rounds is None else found.where(F.col("round").isin(rounds))


class Kept:
    """The tables of a store as one version has them, with facts by municipality."""

    def __init__(self, store: Store, raw=None):
        self.store, self.spark, self._raw = store, store.spark, raw

    def __getattr__(self, name: str) -> DataFrame:
        if name in FACTS or name == "list_ballots":
            return self.store.read(name).drop("round")
        if name in SMALL or name == "named_rounds":
            return self.store.read(name)
        if name.startswith("__") or self._raw is None:
            raise AttributeError(name)
        return getattr(self._raw, name)


def build(t, store: Store) -> Kept:
    """The first version.  Tables that several sums ask for are worked out once, in a folder that
    goes when the version is there."""
    once = Store(store.spark, f"{store.folder}/_once")
    once.commit({n: Change(getattr(t, n)) for n in ASKED_OFTEN})
    raw, t = t, At(once, t)
    facts = {n: Change(sums(t, n), "round") for n in FACTS} | {"list_ballots": Change(ballots(t), "round")}
    store.commit({n: Change(getattr(t, n)) for n in SMALL} | facts | {"named_rounds": Change(totals.rounds(t))})
    once.drop()
    return Kept(store, raw)


def refresh(t, store: Store, rounds: list[int], key: str | None = None) -> Kept:
    """The version after a load into these rounds of ``t``, and nothing but their sums and the
    lists and candidacies that may have come with them is written."""
    facts = {n: Change(sums(t, n, rounds), "round", rounds) for n in FACTS} | {"list_ballots": Change(ballots(t, rounds), "round", rounds)}
    store.commit(facts | {n: Change(getattr(t, n)) for n in ("electoral_list", "candidacy")}, key)
    return Kept(store, t)
