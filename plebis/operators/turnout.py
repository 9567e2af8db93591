"""Groups of rounds and their turnout by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plebis import schema
from plebis.functions.names import station_label
from plebis.operators import totals
from plebis.operators.scope import parse_ids

LEVELS = ("national", "county", "municipality", "station")


def grouped_rounds(t) -> DataFrame:
    """Rounds that count, with their group: local rounds only of canonical types,
    as every voter is in exactly one of those."""
    canonical = F.lit(False)
    for number, types in schema.CANONICAL_LOCAL.items():
        canonical = canonical | ((F.col("round_number") == number) & F.col("type_name").isin(types))
    return (
        totals.rounds(t)
        .join(F.broadcast(schema.category_dimension(t.spark)), "type_name")
        .where((F.col("category") != "lokalni") | canonical)
        .withColumn("id", F.concat_ws("-", "category", F.col("year").cast("string"), F.col("round_number").cast("string")))
    )


def election_groups(t) -> DataFrame:
    suffix = F.when(F.col("round_number") > 1, F.concat(F.lit(" — "), F.col("round_number").cast("string"), F.lit(". krug"))).otherwise("")
    return (
        grouped_rounds(t)
        .groupBy("id", "category", "category_label", "year", "round_number")
        .agg(F.sort_array(F.collect_list("round_id")).alias("round_ids"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("date"))
        .withColumn("label", F.concat(F.concat_ws(" ", "category_label", F.col("year").cast("string")), suffix))
    )


def turnout_at(t, level: str, parent: int | None = None, groups: list[str] | None = None, stations: list[int] | str | None = None) -> DataFrame:
    """Turnout of each group at a level: (group_id, id, name[, address], measures).

    ``parent`` is a county for municipalities, a municipality for stations.
    ``stations`` may be the text of a list, "1, 2"; one that is no list of numbers
    raises ValueError.
    """
    if isinstance(stations, str):
        stations = parse_ids(stations)
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    of_groups = grouped_rounds(t).select(F.col("id").alias("group_id"), F.col("round_id").alias("election_round_id"))
    if groups is not None:
        of_groups = of_groups.where(F.col("group_id").isin(groups))
    facts = t.turnout.join(F.broadcast(of_groups), "election_round_id")
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in totals.MEASURES]
    if level == "national":
        return facts.groupBy("group_id").agg(*sums).select("group_id", F.lit("hr").alias("id"), F.lit("Hrvatska").alias("name"), *totals.MEASURES)
    by_station = facts.groupBy("group_id", "polling_station_id").agg(*[F.sum(m).alias(m) for m in totals.MEASURES])
    places = t.polling_station.withColumnsRenamed({"id": "polling_station_id", "name": "station_name"})
    if level == "station":
        if stations is not None:
            places = places.where(F.col("polling_station_id").isin(stations))
        elif parent is not None:
            places = places.where(F.col("municipality_id") == parent)
        return by_station.join(places, "polling_station_id").select(
            "group_id", F.col("polling_station_id").alias("id"), station_label(F.col("number"), F.col("location"), F.col("station_name")).alias("name"),
            F.coalesce("address", F.lit("")).alias("address"), *totals.MEASURES,
        )
    munis = t.municipality.withColumnsRenamed({"id": "municipality_id", "name": "municipality"})
    if level == "municipality" and parent is not None:
        munis = munis.where(F.col("county_id") == parent)
    placed = by_station.join(places, "polling_station_id").join(F.broadcast(munis), "municipality_id")
    if level == "municipality":
        return placed.groupBy("group_id", F.col("municipality_id").alias("id"), F.col("municipality").alias("name")).agg(*sums)
    counties = t.county.select(F.col("id").alias("county_id"), F.col("name").alias("county"))
    return placed.join(F.broadcast(counties), "county_id").groupBy("group_id", F.col("county_id").alias("id"), F.col("county").alias("name")).agg(*sums)


def turnout_levels(t, groups: list[str] | None = None) -> DataFrame:
    """Turnout of each group at all levels from one pass over the facts: (group_id, level,
    id, name, measures).  Stations are summed first; the levels are grouping sets over
    these sums."""
    of_groups = grouped_rounds(t).select(F.col("id").alias("group_id"), F.col("round_id").alias("election_round_id"))
    if groups is not None:
        of_groups = of_groups.where(F.col("group_id").isin(groups))
    facts = t.turnout.join(F.broadcast(of_groups), "election_round_id")
    by_station = facts.groupBy("group_id", "polling_station_id").agg(*[F.sum(m).alias(m) for m in totals.MEASURES])
    places = t.polling_station.select(
        F.col("id").alias("polling_station_id"), "municipality_id", station_label(F.col("number"), F.col("location"), F.col("name")).alias("station")
    )
    munis = t.municipality.select(F.col("id").alias("municipality_id"), "county_id", F.col("name").alias("municipality"))
    counties = t.county.select(F.col("id").alias("county_id"), F.col("name").alias("county"))
    placed = by_station.join(places, "polling_station_id").join(F.broadcast(munis), "municipality_id").join(F.broadcast(counties), "county_id")
    g, county, muni, station = ("group_id",), ("county_id", "county"), ("municipality_id", "municipality"), ("polling_station_id", "station")
    sets = [[F.col(c) for c in columns] for columns in (g, g + county, g + muni, g + station)]
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in totals.MEASURES]
    each = placed.groupingSets(sets, *g, *county, *muni, *station).agg(F.grouping_id().alias("bits"), *sums)
    level = F.when(F.col("polling_station_id").isNotNull(), "station").when(F.col("municipality_id").isNotNull(), "municipality").when(F.col("county_id").isNotNull(), "county").otherwise("national")
    return each.select(
        "group_id", level.alias("level"), F.coalesce(*[F.col(c).cast("string") for c in ("polling_station_id", "municipality_id", "county_id")], F.lit("hr")).alias("id"),
        F.coalesce("station", "municipality", "county", F.lit("Hrvatska")).alias("name"), *totals.MEASURES,
    )
