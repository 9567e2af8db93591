"""Which polling stations a question is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_stations(t, station=None, municipality=None, county=None, district=None, street=None) -> DataFrame | None:
    """Column polling_station_id of the first scope that is given, else None for
    the whole country.  ``street`` is an address within ``municipality``."""
    stations = t.polling_station
    if station is not None:
        found = stations.where(F.col("id") == station)
    elif street is not None:
        found = stations.where(F.col("address") == street)
        if municipality is not None:
            found = found.where(F.col("municipality_id") == municipality)
    elif municipality is not None:
        found = stations.where(F.col("municipality_id") == municipality)
    elif county is not None:
        munis = t.municipality.where(F.col("county_id") == county).select(F.col("id").alias("municipality_id"))
        found = stations.join(munis, "municipality_id", "left_semi")
    elif district is not None:
        lists = t.electoral_list.where(F.col("district_id") == district).select(F.col("id").alias("electoral_list_id"))
        return t.list_result.join(lists, "electoral_list_id", "left_semi").select("polling_station_id").distinct()
    else:
        return None
    return found.select(F.col("id").alias("polling_station_id"))


def parse_ids(text: str | None) -> list[int]:
    """Ids from a comma-separated list; blank parts are skipped, anything else that
    is no number raises ValueError."""
    return [int(part) for part in map(str.strip, (text or "").split(",")) if part]


def within(facts: DataFrame, scope: DataFrame | None) -> DataFrame:
    return facts if scope is None else facts.join(scope, "polling_station_id", "left_semi")


#: Stations of a block: a row makes pairs of two blocks.
BLOCK = 2048


def _all_siblings(stations: DataFrame) -> DataFrame:
    """Pairs of all stations, made from pairs of blocks of a place's stations, which are dealt
    evenly: a task holds two blocks and the pairs of one station with a block, however many
    stations share a place."""
    place = ["location", "address"]
    same = lambda a, b: a["location"].eqNullSafe(b["location"]) & a["address"].eqNullSafe(b["address"])
    slices = stations.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).alias("slices"))
    sliced = stations.alias("a").join(slices.alias("b"), same(stations, slices)).select("a.id", "a.location", "a.address", F.pmod(F.xxhash64(F.col("a.id")), F.col("slices")).alias("slice"))
    # Ids in a struct, as a list drops what is null.
    blocks = sliced.groupBy(*place, "slice").agg(F.collect_list(F.struct("id")).alias("block"))
    plain = lambda block: F.transform(block, lambda s: s["id"])
    left = blocks.select(F.col("location").alias("l"), F.col("address").alias("a"), F.col("block").alias("own"))
    right = blocks.select(*place, plain("block").alias("ids"))
    both = left.join(right, F.col("l").eqNullSafe(F.col("location")) & F.col("a").eqNullSafe(F.col("address"))).select("own", "ids")
    dealt = both.repartition(int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # One generated loop over both lists would hold all pairs of two blocks before it gave the
    # first; the transform keeps the outer explode out of it, which gives station by station.
    each = dealt.select(F.explode(plain("own")).alias("id"), "ids")
    return each.select("id", F.explode("ids").alias("sibling_id"))


def siblings(stations: DataFrame, station: int | None = None) -> DataFrame:
    """(id, sibling_id): stations at the same location and address, null-safe; of
    one station, or of all."""
    if station is None:
        return _all_siblings(stations)
    own = stations.where(F.col("id") == station)
    left = own.select("id", F.col("location").alias("l"), F.col("address").alias("a"))
    right = stations.select(F.col("id").alias("sibling_id"), "location", "address")
    return left.join(right, F.col("l").eqNullSafe(F.col("location")) & F.col("a").eqNullSafe(F.col("address"))).select("id", "sibling_id")
