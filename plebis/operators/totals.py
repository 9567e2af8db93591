"""Sums of votes and turnout, shares and the largest of each group.

Facts meet dimensions that are far smaller; sums are taken before names are
joined, so that only totals are widened and a shuffle moves partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis.functions.names import election_label
from plebis.operators.scope import within

MEASURES = ("registered_voters", "ballots_cast", "valid_ballots", "invalid_ballots")


def rounds(t, types: list[str] | None = None, year: int | None = None) -> DataFrame:
    """Rounds with their election and type: round_id, round_number, election_id,
    year, date, election_name, type_id, type_name."""
    known = getattr(t, "named_rounds", None)  # joined already, where the tables keep sums
    if known is not None:
        if types is not None:
            known = known.where(F.col("type_name").isin(types))
        return known if year is None else known.where(F.col("year") == year)
    election = t.election if year is None else t.election.where(F.col("year") == year)
    kind = t.election_type if types is None else t.election_type.where(F.col("name").isin(types))
    return (
        t.election_round.withColumnRenamed("id", "round_id")
        .join(election.withColumnsRenamed({"id": "election_id", "name": "election_name"}), "election_id")
        .join(F.broadcast(kind.select(F.col("id").alias("election_type_id"), F.col("name").alias("type_name"))), "election_type_id")
        .withColumnRenamed("election_type_id", "type_id")
    )


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("election", election_label(F.col("election_name"), F.col("type_name"), F.col("year")))


def list_totals(t, of_rounds: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Votes by list: electoral_list_id, election_round_id, district_id, name, votes."""
    sums = within(t.list_result, scope).groupBy("electoral_list_id").agg(F.sum("votes").alias("votes"))
    lists = t.electoral_list.withColumnRenamed("id", "electoral_list_id")
    if of_rounds is not None:
        lists = lists.join(of_rounds.select(F.col("round_id").alias("election_round_id")), "election_round_id", "left_semi")
    return sums.join(lists, "electoral_list_id")


def list_totals_by_name(t, of_rounds: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Votes by round and list name: lists of one name count together."""
    return list_totals(t, of_rounds, scope).groupBy("election_round_id", "name").agg(F.sum("votes").alias("votes"))


def candidate_totals(t, of_rounds: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Votes by round, person's name and list name, of candidates with results."""
    sums = within(t.candidate_result, scope).groupBy("candidacy_id").agg(F.sum("votes").alias("votes"))
    return (
        sums.join(candidacies(t, of_rounds), "candidacy_id")
        .groupBy("election_round_id", "first_name", "last_name", "list_name")
        .agg(F.sum("votes").alias("votes"))
    )


def candidacies(t, of_rounds: DataFrame | None = None) -> DataFrame:
    """Every candidacy with its person and list."""
    lists = t.electoral_list.select(
        F.col("id").alias("electoral_list_id"), "election_round_id", "district_id", F.col("name").alias("list_name")
    )
    if of_rounds is not None:
        lists = lists.join(of_rounds.select(F.col("round_id").alias("election_round_id")), "election_round_id", "left_semi")
    return (
        t.candidacy.withColumnRenamed("id", "candidacy_id")
        .join(lists, "electoral_list_id")
        .join(t.person.withColumnRenamed("id", "person_id"), "person_id")
    )


def personal_votes(t, scope: DataFrame | None = None) -> DataFrame:
    """Every candidacy with its votes, 0 where it has none: the scope limits what
    is summed, never which candidacies are listed."""
    sums = within(t.candidate_result, scope).groupBy("candidacy_id").agg(F.sum("votes").alias("votes"))
    return (
        t.candidacy.withColumnRenamed("id", "candidacy_id")
        .join(sums, "candidacy_id", "left")
        .withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))
    )


def turnout_totals(t, by: list[str | Column], scope: DataFrame | None = None) -> DataFrame:
    return within(t.turnout, scope).groupBy(*by).agg(*[F.sum(m).alias(m) for m in MEASURES])


def top(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their place."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return df.withColumn("place", place).where(F.col("place") <= k)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def share_of_group(df: DataFrame, by: list[str], votes: str = "votes", into: str = "votes_pct") -> DataFrame:
    total = F.sum(votes).over(Window.partitionBy(*by))
    return df.withColumn("total_votes", total).withColumn(into, percent(F.col(votes), F.col("total_votes")))
