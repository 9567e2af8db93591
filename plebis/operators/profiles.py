"""Histories of people and parties, profiles of places, national and local results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis import schema
from plebis.functions.names import primary_party
from plebis.operators import apportion, rank, totals
from plebis.operators.scope import scope_stations, siblings, within


def list_denominators(t) -> DataFrame:
    """(electoral_list_id, valid_ballots): those of the list's round at the
    stations where the list has results."""
    lists = t.electoral_list.select(F.col("id").alias("electoral_list_id"), "election_round_id")
    known = getattr(t, "list_ballots", None)  # summed already, where the tables keep sums
    if known is not None:
        return known
    return (
        t.list_result.select("electoral_list_id", "polling_station_id")
        .join(lists, "electoral_list_id")
        .join(t.turnout.select("election_round_id", "polling_station_id", "valid_ballots"), ["election_round_id", "polling_station_id"])
        .groupBy("electoral_list_id")
        .agg(F.sum("valid_ballots").alias("valid_ballots"))
    )


def vote_shares(t) -> DataFrame:
    """Every candidacy with its votes, its list's, the valid ballots there and the
    share, exact and rounded to one digit, halves to even."""
    lists = t.list_result.groupBy("electoral_list_id").agg(F.sum("votes").alias("list_votes"))
    share = totals.percent(F.col("candidate_votes"), F.col("valid_ballots"))
    return (
        totals.personal_votes(t)
        .withColumnRenamed("votes", "candidate_votes")
        .join(lists, "electoral_list_id", "left")
        .join(list_denominators(t), "electoral_list_id", "left")
        .withColumn("list_votes", F.coalesce("list_votes", F.lit(0).cast("long")))
        .withColumn("valid_ballots", F.coalesce("valid_ballots", F.lit(0).cast("long")))
        .withColumn("share", share)
        .withColumn("vote_share", F.bround("share", 1))
    )


def person_history(t, person: int | None = None, mandates: DataFrame | None = None) -> DataFrame:
    """All candidacies of a person, newest first, or of all people, each with its
    place ``nth`` in that order."""
    of_rounds = totals.with_label(totals.rounds(t)).select(
        F.col("round_id").alias("election_round_id"), "round_number", "election", "type_name", "year", "date"
    )
    lists = (
        t.electoral_list.select(F.col("id").alias("electoral_list_id"), "election_round_id", "district_id", F.col("name").alias("list_name"))
        .join(F.broadcast(of_rounds), "election_round_id")
        .join(F.broadcast(t.electoral_district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))), "district_id", "left")
    )
    home = rank.list_municipality(t).join(
        F.broadcast(t.municipality.select(F.col("id").alias("municipality_id"), "county_id")), "municipality_id"
    )
    kinds = F.create_map(*[F.lit(x) for pair in schema.KIND_OF_TYPE.items() for x in pair])
    winners = apportion.preferential(t, apportion.parliament_seats(apportion.parliament_lists(t))).select("candidacy_id", F.lit(True).alias("won"))
    rows = vote_shares(t)
    if person is not None:
        rows = rows.where(F.col("person_id") == person)
    rows = (
        rows.join(lists, "electoral_list_id")
        .join(home, "electoral_list_id", "left")
        .join(rank.ranks(t).select("candidacy_id", "rank", "field"), "candidacy_id", "left")
        .join(winners, "candidacy_id", "left")
        .withColumn("kind", F.try_element_at(kinds, F.col("type_name")))
    )
    if mandates is None:
        rows = rows.withColumn("group", F.lit(None).cast("string"))
    else:
        rows = rows.join(mandates.select("candidacy_id", "group"), "candidacy_id", "left")
    europe = F.col("type_name") == schema.EUROPE
    local = F.col("kind").isNotNull()
    newest = Window.partitionBy("person_id").orderBy(*newest_first("round_number"), "candidacy_id")
    rows = rows.withColumn("nth", F.row_number().over(newest).cast("long"))
    found = rows.select(
        "person_id", "candidacy_id", "election", F.col("type_name").alias("election_type"), "year", F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("round_number").alias("round"), "list_name", F.col("position_on_list").alias("position"), "district", "candidate_votes", "list_votes",
        F.col("valid_ballots").alias("total_valid_ballots"), "vote_share", "rank", F.col("field").alias("total_candidates_in_round"),
        F.coalesce("won", F.lit(False)).alias("won_seat"), (europe & F.col("group").isNotNull()).alias("eu_mep"), F.when(europe, F.col("group")).alias("eu_group"),
        F.col("kind").alias("lokalni_kind"), F.when(local, F.col("county_id")).alias("county_id"), F.when(local, F.col("municipality_id")).alias("municipality_id"), "nth",
    )
    return found if person is None else found.orderBy("nth")


def newest_first(round_: str = "round") -> list[Column]:
    return [F.desc("year"), F.col("date").desc_nulls_last(), F.desc(round_)]


def _list_history(t, lists: DataFrame) -> DataFrame:
    of_rounds = totals.with_label(totals.rounds(t)).select(
        F.col("round_id").alias("election_round_id"), F.col("round_number").alias("round"), "election", F.col("type_name").alias("election_type"), "year",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
    )
    sums = t.list_result.groupBy("electoral_list_id").agg(F.sum("votes").alias("total_votes"))
    return (
        lists.withColumnRenamed("id", "electoral_list_id")
        .join(F.broadcast(of_rounds), "election_round_id")
        .join(F.broadcast(t.electoral_district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))), "district_id", "left")
        .join(sums, "electoral_list_id", "left")
        .withColumn("total_votes", F.coalesce("total_votes", F.lit(0).cast("long")))
        .withColumnRenamed("name", "list_name")
        .select("electoral_list_id", "election", "election_type", "year", "date", "round", "list_name", "district", "total_votes")
    )


def party_history(t, name: str) -> DataFrame:
    """Lists whose primary party is ``name``: newest year first, then by date."""
    if not name.strip():
        raise ValueError("missing name")
    lists = t.electoral_list.where(primary_party(F.col("name")) == name.strip())
    return _list_history(t, lists).orderBy(F.desc("year"), F.col("date").asc_nulls_first(), F.desc("round"), "electoral_list_id")


def party_history_by_id(t, bridge: DataFrame, party: int) -> DataFrame:
    """Lists that a bridge table (electorallist_id, party_id) ties to a party."""
    of_party = bridge.where(F.col("party_id") == party).select(F.col("electorallist_id").alias("id"))
    return _list_history(t, t.electoral_list.join(of_party, "id")).orderBy(*newest_first(), "electoral_list_id")


def place_profile(t, scope: DataFrame, k: int = schema.TOP_LIMIT) -> DataFrame:
    """Rounds with turnout in the scope, each with its first lists and candidates."""
    of_rounds = totals.with_label(totals.rounds(t)).select(
        F.col("round_id").alias("election_round_id"), F.col("round_number").alias("round"), "election", F.col("type_name").alias("election_type"), "year",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
    )
    lists = top_lists(t, scope, k).groupBy("election_round_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "name", "votes"))).alias("top_lists")
    )
    people = top_candidates(t, scope, k).groupBy("election_round_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "name", "votes", "list_name"))).alias("top_candidates")
    )
    return (
        totals.turnout_totals(t, ["election_round_id"], scope)
        .join(F.broadcast(of_rounds), "election_round_id")
        .join(lists, "election_round_id", "left")
        .join(people, "election_round_id", "left")
    )


def top_lists(t, scope: DataFrame | None = None, k: int = schema.TOP_LIMIT) -> DataFrame:
    return totals.top(totals.list_totals_by_name(t, None, scope), k, ["election_round_id"], [F.desc("votes"), F.col("name")])


def top_candidates(t, scope: DataFrame | None = None, k: int = schema.TOP_LIMIT) -> DataFrame:
    people = totals.candidate_totals(t, None, scope).withColumn("name", F.concat_ws(" ", "first_name", "last_name"))
    return totals.top(people, k, ["election_round_id"], [F.desc("votes"), F.col("name"), F.col("list_name")])


def station_profile(t, station: int) -> DataFrame:
    own = siblings(t.polling_station, station).select(F.col("sibling_id").alias("polling_station_id"))
    return place_profile(t, own)


def location_profile(t, **scope) -> DataFrame:
    found = scope_stations(t, **scope)
    if found is None:
        raise ValueError("no filter")
    return place_profile(t, found)


def category_types(category: str) -> list[str]:
    if category not in schema.CATEGORIES:
        raise ValueError(f"unknown category {category}")
    return schema.CATEGORIES[category][1]


def national_turnout(t, category: str, year: int | None = None, **scope) -> DataFrame:
    of_rounds = totals.with_label(totals.rounds(t, category_types(category), year))
    sums = totals.turnout_totals(t, ["election_round_id"], scope_stations(t, **scope)).withColumnRenamed("election_round_id", "round_id")
    return of_rounds.join(sums, "round_id", "left").select(
        "round_id", "election", F.col("type_name").alias("election_type"), "year", F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("round_number").alias("round"), *[F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in totals.MEASURES],
    )


def national_lists(t, category: str, year: int | None = None, **scope) -> DataFrame:
    return totals.list_totals_by_name(t, totals.rounds(t, category_types(category), year), scope_stations(t, **scope))


def national_candidates(t, category: str, year: int | None = None, **scope) -> DataFrame:
    return totals.candidate_totals(t, totals.rounds(t, category_types(category), year), scope_stations(t, **scope))


def local_round(t, kind: str, muni_type: str | None = None, year: int | None = None, number: int = 1) -> DataFrame:
    """The one round of a local race: of the newest year, or the given one."""
    if kind in schema.COUNTY_KINDS:
        type_name = schema.COUNTY_KINDS[kind]
    elif kind in schema.LOCAL_KINDS and muni_type in schema.LOCAL_KINDS[kind]:
        type_name = schema.LOCAL_KINDS[kind][muni_type]
    else:
        raise ValueError(f"unknown kind {kind} for {muni_type}")
    of_rounds = totals.rounds(t, [type_name], year)
    newest = of_rounds.agg(F.max_by("election_id", F.struct("year", -F.col("election_id"))).alias("election_id"))
    return of_rounds.join(F.broadcast(newest), "election_id", "left_semi").where(F.col("round_number") == number)


def local_results(t, of_round: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Every list of the round with its votes in the scope, 0 where none."""
    lists = t.electoral_list.withColumnRenamed("id", "electoral_list_id").join(
        F.broadcast(of_round.select(F.col("round_id").alias("election_round_id"))), "election_round_id", "left_semi"
    )
    sums = within(t.list_result, scope).groupBy("electoral_list_id").agg(F.sum("votes").alias("votes"))
    rows = lists.join(sums, "electoral_list_id", "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))
    return totals.share_of_group(rows, ["election_round_id"]).select("electoral_list_id", "name", "votes", "total_votes", "votes_pct")


def stations_breakdown(t, of_round: DataFrame, municipality: int | None = None, county: int | None = None) -> DataFrame:
    """Every station of the place with its turnout in the round, 0 where none."""
    places = t.polling_station.join(
        scope_stations(t, municipality=municipality, county=county).withColumnRenamed("polling_station_id", "id"), "id", "left_semi"
    )
    own = t.turnout.join(F.broadcast(of_round.select(F.col("round_id").alias("election_round_id"))), "election_round_id", "left_semi")
    rows = places.join(own, places["id"] == own["polling_station_id"], "left")
    for m in totals.MEASURES:
        rows = rows.withColumn(m, F.coalesce(m, F.lit(0).cast("long")))
    return rows.select(
        "id", "number", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "location", "address")], *totals.MEASURES,
        totals.percent(F.col("ballots_cast"), F.col("registered_voters")).alias("turnout_pct"),
    )
