"""Searches and pick lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis import schema
from plebis.functions.names import croatian, normalize_person_name, primary_party
from plebis.operators import totals
from plebis.operators.grams import Index


def _long_enough(df: DataFrame, query: str) -> DataFrame:
    return df if len(query.strip()) >= schema.LEAST_QUERY else df.limit(0)


#: The fields that searches look into, by table.
SEARCHED = {"person": ["normalized_name"], "electoral_list": ["name"], "polling_station": ["address", "location", "name"]}


def indexed(t, index: Index) -> Index:
    """Posting lists of all that searches look into."""
    for name, fields in SEARCHED.items():
        index.build(name, getattr(t, name), fields)
    return index


def _holding(t, name: str, wanted: Column, index: Index | None) -> DataFrame:
    """Rows with ``wanted`` in a searched field: by their grams where there is an index,
    else by a scan."""
    rows = getattr(t, name)
    if index is not None:
        return index.narrow(name, rows, SEARCHED[name], wanted)
    return rows.where(reduce(Column.__or__, [F.ilike(f, wanted) for f in SEARCHED[name]]))


def search_persons(t, query: str, k: int = schema.SEARCH_LIMIT, index: Index | None = None) -> DataFrame:
    """People whose normalized name holds the normalized query; % and _ in it are
    wildcards."""
    wanted = F.concat(F.lit("%"), normalize_person_name(F.lit(query)), F.lit("%"))
    found = _holding(t, "person", wanted, index)
    return _long_enough(found, query).orderBy("last_name", "first_name", "id").limit(k).select(
        "id", F.concat_ws(" ", "first_name", "last_name").alias("name")
    )


def search_parties(t, query: str, k: int = schema.SEARCH_LIMIT, index: Index | None = None) -> DataFrame:
    name = primary_party(F.col("name"))
    found = (
        _holding(t, "electoral_list", F.lit(f"%{query}%"), index)
        .select(name.alias("name"))
        .where((F.col("name") != "") & F.contains(F.lower("name"), F.lit(query.lower())))
        .distinct()
    )
    return _long_enough(found, query).orderBy("name").limit(k)


def search_stations(t, query: str, k: int = schema.SEARCH_LIMIT, index: Index | None = None) -> DataFrame:
    """Locations whose address, location, name or municipality holds the query."""
    like = F.lit(f"%{query}%")
    munis = t.municipality.select(F.col("id").alias("municipality_id"), F.col("name").alias("municipality"))
    columns = ["id", "location", "address", "municipality_id"]
    if index is None:
        hit = reduce(Column.__or__, [F.ilike(f, like) for f in [*SEARCHED["polling_station"], "municipality"]])
        hits = t.polling_station.join(F.broadcast(munis), "municipality_id").where(hit)
    else:
        theirs = munis.where(F.ilike("municipality", like)).select("municipality_id")
        by_place = t.polling_station.join(F.broadcast(theirs), "municipality_id", "left_semi").select(*columns)
        either = _holding(t, "polling_station", like, index).select(*columns).unionByName(by_place)
        hits = either.join(F.broadcast(munis), "municipality_id")  # smallest ids don't mind repeats
    found = (
        hits
        .groupBy("location", "address")
        .agg(F.min("id").alias("id"), F.min("municipality").alias("municipality"))
    )
    return _long_enough(found, query).orderBy("municipality", "location", "id").limit(k).select(
        "id", F.concat_ws(", ", "location", "address").alias("name"), "municipality"
    )


def list_counties(t) -> DataFrame:
    """Without those abroad and the synthetic one: codes compare as text."""
    return t.county.where((F.col("code") < schema.ABROAD_FROM) | F.col("code").isNull()).select("id", "name")


def list_municipalities(t, county: int) -> DataFrame:
    return t.municipality.where((F.col("county_id") == county) & ~F.col("name").contains("IZBORNA JEDINICA")).select("id", "name").orderBy(croatian("name"), "id")


def dedup_stations(t, municipality: int | None = None) -> DataFrame:
    """One station a location and address: the smallest id."""
    rows = t.polling_station if municipality is None else t.polling_station.where(F.col("municipality_id") == municipality)
    return rows.groupBy("municipality_id", "location", "address").agg(F.min("id").alias("id"))


def list_streets(t, municipality: int) -> DataFrame:
    return (
        t.polling_station.where(F.col("municipality_id") == municipality)
        .select(F.col("address").alias("name"))
        .distinct()
        .where(F.col("name").isNotNull() & (F.col("name") != ""))
    )


def stations_by_street(t, municipality: int, street: str) -> DataFrame:
    rows = dedup_stations(t, municipality).where(F.col("address") == street)
    return (rows if street.strip() else rows.limit(0)).select("id", F.concat_ws(", ", "location", "address").alias("name"))


def category_years(t) -> DataFrame:
    kinds = schema.category_dimension(t.spark)
    return totals.rounds(t).join(F.broadcast(kinds), "type_name").select("category", "year").distinct()


def district_list(t, year: int) -> DataFrame:
    elections = t.election.where(F.col("year") == year).select(F.col("id").alias("election_id"))
    return t.electoral_district.join(F.broadcast(elections), "election_id", "left_semi").where(F.col("number") < 121).select("id", "number", "name")


def district_municipalities(t, least: int = schema.LEAST_DISTRICT_VOTES) -> DataFrame:
    """Municipalities of each parliament district with at least ``least`` votes in it."""
    places = t.polling_station.select(F.col("id").alias("polling_station_id"), "municipality_id")
    lists = t.electoral_list.where("district_id is not null").select(F.col("id").alias("electoral_list_id"), "district_id")
    munis = t.municipality.select(F.col("id").alias("municipality_id"), F.col("name"), "county_id").join(
        t.county.select(F.col("id").alias("county_id"), F.col("name").alias("county")), "county_id", "left"
    )
    return (
        t.list_result.join(lists, "electoral_list_id")
        .join(places, "polling_station_id")
        .groupBy("district_id", "municipality_id")
        .agg(F.sum("votes").alias("votes"))
        .where(F.col("votes") >= least)
        .join(F.broadcast(munis), "municipality_id")
        .select("district_id", "municipality_id", "name", "county", "votes")
    )


def names_in_order(t) -> DataFrame:
    """(last_name, nth): every last name once, in the order that people look for it.
    Names are few beside the people who bear them."""
    names = t.person.select("last_name").distinct()
    return names.withColumn("nth", F.row_number().over(Window.orderBy(croatian("last_name"), "last_name")).cast("long"))


class Unknown(LookupError):
    """What a question is about isn't there."""


def known(rows: DataFrame, what: str) -> DataFrame:
    """The rows, of which there have to be some."""
    if rows.isEmpty():
        raise Unknown(f"no {what}")
    return rows


def person(t, number: int) -> DataFrame:
    return known(t.person.where(F.col("id") == number), f"person {number}")


def station(t, number: int) -> DataFrame:
    return known(t.polling_station.where(F.col("id") == number), f"station {number}")


def year_of(t, types: list[str], year: int) -> DataFrame:
    """The rounds of these types in a year."""
    return known(totals.rounds(t, types, year), f"election in {year}")
