"""Finish places of candidates among those they run against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plebis.operators import totals

BY_MUNICIPALITY, BY_COUNTY, BY_DISTRICT = ["Gradonačelnik", "Načelnik"], ["Župan"], ["Predsjednički izbori"]


def list_municipality(t) -> DataFrame:
    """(electoral_list_id, municipality_id): the smallest municipality with results."""
    stations = t.polling_station.select(F.col("id").alias("polling_station_id"), "municipality_id")
    return (
        t.list_result.join(stations, "polling_station_id")
        .groupBy("electoral_list_id")
        .agg(F.min("municipality_id").alias("municipality_id"))
    )


def ranks(t) -> DataFrame:
    """(candidacy_id, scope, rank, field): president by round and district, where
    candidates without votes are ranked too; mayors by round and municipality and
    prefects by round and county, where only those with results are.

    The scope of a mayor's or prefect's list is that of its municipality; votes
    from elsewhere do not count in it.  Equal votes rank by candidacy id.
    """
    kinds = totals.rounds(t).select(F.col("round_id").alias("election_round_id"), "type_name")
    lists = t.electoral_list.select(F.col("id").alias("electoral_list_id"), "election_round_id", "district_id").join(
        F.broadcast(kinds), "election_round_id"
    )
    places = t.polling_station.select(F.col("id").alias("polling_station_id"), "municipality_id").join(
        F.broadcast(t.municipality.select(F.col("id").alias("municipality_id"), "county_id")), "municipality_id"
    )

    president = (
        totals.personal_votes(t)
        .join(lists.where(F.col("type_name").isin(BY_DISTRICT)), "electoral_list_id")
        .select("candidacy_id", F.lit("district").alias("scope"), "election_round_id", F.col("district_id").alias("place"), "votes", F.lit(True).alias("own"))
    )
    local = lists.where(F.col("type_name").isin(BY_MUNICIPALITY + BY_COUNTY)).withColumn(
        "scope", F.when(F.col("type_name").isin(BY_COUNTY), "county").otherwise("muni")
    )
    home = list_municipality(t).join(
        F.broadcast(t.municipality.select(F.col("id").alias("municipality_id"), F.col("county_id").alias("home_county"))), "municipality_id"
    )
    homes = local.join(home, "electoral_list_id").select(
        "electoral_list_id", F.when(F.col("scope") == "county", F.col("home_county")).otherwise(F.col("municipality_id")).alias("home")
    )
    results = (
        t.candidate_result.join(places, "polling_station_id")
        .join(t.candidacy.select(F.col("id").alias("candidacy_id"), "electoral_list_id"), "candidacy_id")
        .join(local, "electoral_list_id")
        .groupBy(
            "candidacy_id",
            "electoral_list_id",
            "scope",
            "election_round_id",
            F.when(F.col("scope") == "county", F.col("county_id")).otherwise(F.col("municipality_id")).alias("place"),
        )
        .agg(F.sum("votes").alias("votes"))
        .join(homes, "electoral_list_id")
        .select("candidacy_id", "scope", "election_round_id", "place", "votes", (F.col("place") == F.col("home")).alias("own"))
    )
    group = Window.partitionBy("scope", "election_round_id", "place")
    return (
        president.unionByName(results)
        .withColumn("rank", F.row_number().over(group.orderBy(F.desc("votes"), "candidacy_id")).cast("long"))
        .withColumn("field", F.count("*").over(group))
        .where("own")
        .select("candidacy_id", "scope", "rank", "field")
    )
