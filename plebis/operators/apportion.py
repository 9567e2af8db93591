"""Seats: thresholds, highest averages and preferential votes.

One plan for all districts at once.  Quotients are made from list totals, of
which a district has dozens; every window is partitioned by district or list.
Ties: greater quotient, then more votes, then smaller list id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis import schema
from plebis.functions.names import primary_party, primary_party_comma
from plebis.operators import totals


def seats_of_district(number: Column) -> Column:
    found = F.lit(None).cast("int")
    found = F.when(number.isNull(), found)
    for n, seats in schema.SPECIAL_SEATS.items():
        found = found.when(number == n, seats)
    return found.otherwise(schema.STANDARD_SEATS)


def passing(lists: DataFrame, by: list[str], floor: float = schema.THRESHOLD, only: Column | None = None) -> DataFrame:
    """Adds total_votes and eligible: votes reach ``floor`` of the group's votes,
    or the group is not among ``only``."""
    total = F.sum("votes").over(Window.partitionBy(*by))
    reaches = F.col("votes") >= F.col("total_votes") * F.lit(float(floor))
    return lists.withColumn("total_votes", total).withColumn("eligible", reaches if only is None else (~only | reaches))


def quotients(lists: DataFrame, n_seats: str = "n_seats") -> DataFrame:
    """A row for each list and divisor from 1 to the seats of its district."""
    return lists.withColumn("divisor", F.explode(F.sequence(F.lit(1), F.col(n_seats)))).withColumn(
        "quotient", F.col("votes") / F.col("divisor")
    )


def highest_averages(lists: DataFrame, by: list[str], n_seats: str = "n_seats") -> DataFrame:
    """Lists with at least one seat: group, electoral_list_id, seats."""
    order = Window.partitionBy(*by).orderBy(F.desc("quotient"), F.desc("votes"), "electoral_list_id")
    won = quotients(lists, n_seats).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col(n_seats))
    return won.groupBy(*by, "electoral_list_id").agg(F.count("*").alias("seats"))


#: Halvings of the range in which a district's divisor lies: no list has two quotients
#: in what is left.
HALVINGS = 42


def by_divisor(lists: DataFrame, by: list[str], n_seats: str = "n_seats") -> DataFrame:
    """``highest_averages`` without a row for each quotient: a search for the divisor that
    hands out no more than all seats, one window a group; what it leaves goes, a seat a list,
    by the next quotient, then votes, then id.  A group without any votes gives all
    to its first list."""
    group = Window.partitionBy(*by)
    in_turn = group.orderBy(F.desc("__next"), F.desc("votes"), "electoral_list_id")
    n = F.col(n_seats)
    given = lambda at: F.aggregate("__all", F.lit(0).cast("long"), lambda a, v: a + F.floor(v / at))
    top = F.array_max("__all").cast("double")
    ends = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halved(a: Column, _: Column) -> Column:
        middle = (a["lo"] + a["hi"]) / 2
        enough = given(middle) > n
        return ends(F.when(enough, middle).otherwise(a["lo"]), F.when(enough, a["hi"]).otherwise(middle))

    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), ends(top / (n + 1) / 2, top + 1), halved, lambda a: a["hi"])
    sure = lists.withColumn("__all", F.collect_list("votes").over(group)).withColumn("__seats", F.floor(F.col("votes") / divisor))
    left = sure.withColumn("__left", n - F.sum("__seats").over(group)).withColumn("__next", F.col("votes") / (F.col("__seats") + 1))
    placed = left.withColumn("__place", F.row_number().over(in_turn))
    more = F.when(top == 0, F.when(F.col("__place") == 1, n).otherwise(0)).otherwise((F.col("__place") <= F.col("__left")).cast("int"))
    return placed.select(*by, "electoral_list_id", (F.col("__seats") + more).cast("long").alias("seats")).where("seats > 0")


def parliament_lists(t, year: int | None = None) -> DataFrame:
    """List totals of parliament districts with their seats and eligibility."""
    of_rounds = totals.rounds(t, [schema.PARLIAMENT], year)
    lists = (
        totals.list_totals(t, of_rounds)
        .join(F.broadcast(of_rounds.select(F.col("round_id").alias("election_round_id"), "year")), "election_round_id")
        .join(
            F.broadcast(t.electoral_district.select(F.col("id").alias("district_id"), "number", F.col("name").alias("district"))),
            "district_id",
        )
        .withColumn("n_seats", seats_of_district(F.col("number")))
    )
    return passing(lists, ["election_round_id", "district_id"], only=F.col("n_seats") == schema.STANDARD_SEATS)


def parliament_seats(lists: DataFrame) -> DataFrame:
    """All lists of the districts with their seats, 0 included."""
    won = highest_averages(lists.where("eligible"), ["district_id"])
    return lists.join(won, ["district_id", "electoral_list_id"], "left").withColumn("seats", F.coalesce("seats", F.lit(0).cast("long")))


def preferential(t, seated: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Who takes the seats of each list: candidates whose own votes reach a tenth
    of the list's come first, by votes; then the others by place on the list."""
    members = totals.personal_votes(t, scope).withColumnRenamed("votes", "personal_votes")
    own = seated.where("seats > 0").select("electoral_list_id", F.col("votes").alias("list_votes"), "seats")
    promoted = F.col("personal_votes") >= F.col("list_votes") * 10.0 / 100.0
    order = Window.partitionBy("electoral_list_id").orderBy(
        F.desc("promoted"),
        F.when(F.col("promoted"), F.col("personal_votes")).desc_nulls_last(),
        F.col("position_on_list").asc_nulls_first(),
        "candidacy_id",
    )
    return (
        members.join(own, "electoral_list_id")
        .withColumn("promoted", promoted)
        .withColumn("chosen", F.row_number().over(order).cast("long"))
        .where(F.col("chosen") <= F.col("seats"))
        .select("electoral_list_id", "candidacy_id", "person_id", "position_on_list", "personal_votes", "promoted", "chosen", "seats")
    )


def is_minority(number: Column) -> Column:
    return number.isin(*schema.MINORITY_DISTRICTS)


def party_of_list(name: Column, number: Column) -> Column:
    return F.when(is_minority(number), schema.MINORITY_GROUP).otherwise(primary_party_comma(name))


def parties(seated: DataFrame) -> DataFrame:
    """Seats by year and party; minority districts are pooled."""
    return (
        seated.where("seats > 0")
        .groupBy("year", party_of_list(F.col("name"), F.col("number")).alias("party"))
        .agg(F.sum("seats").alias("seats"))
    )


def seat_holders(t, seated: DataFrame) -> DataFrame:
    """One row a seat: the person, or the party's own name where a list has fewer
    candidates than seats; with the party's place in the order of seats, and the
    row's own place in the order of parties and districts."""
    chosen = preferential(t, seated).join(
        t.person.select(F.col("id").alias("person_id"), F.concat_ws(" ", "first_name", "last_name").alias("name")), "person_id"
    )
    seats = seated.where("seats > 0").select(
        "year", "district_id", "district", "number", "electoral_list_id", party_of_list(F.col("name"), F.col("number")).alias("party"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("seats"))).alias("chosen"),
    )
    order = Window.partitionBy("year").orderBy(F.desc("seats"), "party")
    ranks = parties(seated).withColumn("party_rank", F.row_number().over(order).cast("long")).select("year", "party", "party_rank")
    in_turn = Window.partitionBy("year").orderBy("party_rank", "district", "electoral_list_id", "chosen")
    return (
        seats.join(chosen.select("electoral_list_id", "chosen", "name", "candidacy_id"), ["electoral_list_id", "chosen"], "left")
        .withColumn("name", F.coalesce("name", "party"))
        .join(ranks, ["year", "party"])
        .withColumn("place", F.row_number().over(in_turn).cast("long"))
    )


def first_lists(lists: DataFrame, by: list[str]) -> DataFrame:
    """The other rule for minorities: the first lists of a district, a seat each."""
    order = Window.partitionBy(*by).orderBy(F.desc("votes"), "name")
    return lists.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= F.col("n_seats"))


def raw_parliament(t, year: int | None = None) -> DataFrame:
    """Lists by name of every district, and one district of minority winners."""
    lists = (
        parliament_lists(t, year)
        .groupBy("year", "district_id", "district", "number", "n_seats", "name")
        .agg(F.sum("votes").alias("votes"))
        .withColumn("district_votes", F.sum("votes").over(Window.partitionBy("district_id")))
    )
    plain = lists.where(~is_minority(F.col("number"))).select(
        "year", "district", F.col("n_seats").alias("seats"), F.col("district_votes").alias("total_votes"), "name", "votes",
        primary_party_comma(F.col("name")).alias("party"), F.lit(None).cast("int").alias("fixed_seats"),
    )
    small = lists.where(is_minority(F.col("number")))
    all_votes = small.groupBy("year").agg(F.sum("votes").alias("total_votes"))
    winners = (
        first_lists(small, ["district_id"])
        .join(all_votes, "year")
        .select(
            "year", F.lit(schema.MINORITY_DISTRICT_NAME).alias("district"), F.lit(schema.LEGACY_MINORITY_SEATS).alias("seats"), "total_votes",
            "name", "votes", F.lit(schema.MINORITY_GROUP).alias("party"), F.lit(1).alias("fixed_seats"),
        )
    )
    return plain.unionByName(winners)


def europe_lists(t, scope: DataFrame | None = None, year: int | None = None) -> DataFrame:
    """Lists of European elections with seats; a scope apportions its own votes."""
    of_rounds = totals.rounds(t, [schema.EUROPE], year)
    seats = F.lit(schema.EU_DEFAULT_SEATS)
    for y, n in schema.EU_SEATS.items():
        seats = F.when(F.col("year") == y, n).otherwise(seats)
    lists = (
        totals.list_totals(t, of_rounds, scope)
        .join(F.broadcast(of_rounds.select(F.col("round_id").alias("election_round_id"), "year")), "election_round_id")
        .withColumn("n_seats", seats)
    )
    lists = passing(lists, ["election_round_id"])
    # The percentage is applied first, and halves go to the even number.
    bar = F.col("total_votes") * F.lit(schema.THRESHOLD * 100) / 100
    lists = lists.withColumn("threshold_votes", F.bround(bar, 0).cast("long"))
    won = highest_averages(lists.where("eligible"), ["election_round_id"])
    return lists.join(won, ["election_round_id", "electoral_list_id"], "left").withColumn(
        "seats", F.coalesce("seats", F.lit(0).cast("long"))
    )


def europe_parties(lists: DataFrame) -> DataFrame:
    """Lists by party and year; ``place`` orders them by seats, then votes."""
    in_turn = Window.partitionBy("year").orderBy(F.desc("seats"), F.desc("votes"), "party")
    return (
        lists.withColumn("pct", totals.percent(F.col("votes"), F.col("total_votes")))
        .groupBy("year", primary_party(F.col("name")).alias("party"))
        .agg(
            F.sum("votes").alias("votes"),
            F.sum("pct").alias("votes_pct"),
            F.sum("seats").alias("seats"),
            F.bool_or("eligible").alias("eligible"),
            F.max("threshold_votes").alias("threshold_votes"),
        )
        .withColumn("place", F.row_number().over(in_turn).cast("long"))
    )


def europe_candidates(t, lists: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Every candidacy of the elections with its share of all votes, whether it
    takes a seat, and its place by votes."""
    in_turn = Window.partitionBy("year").orderBy(F.desc("personal_votes"), "candidacy_id")
    winners = preferential(t, lists, scope).select("candidacy_id", F.lit(True).alias("is_winner"))
    whole = lists.groupBy("election_round_id", "year").agg(F.max("total_votes").alias("total_votes"))
    members = totals.candidacies(t).join(F.broadcast(whole), "election_round_id")
    sums = totals.personal_votes(t, scope).select("candidacy_id", F.col("votes").alias("personal_votes"))
    return (
        members.join(sums, "candidacy_id")
        .join(winners, "candidacy_id", "left")
        .select(
            "year", "candidacy_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), primary_party(F.col("list_name")).alias("party"),
            "list_name", "position_on_list", "personal_votes", totals.percent(F.col("personal_votes"), F.col("total_votes")).alias("personal_pct"),
            F.coalesce("is_winner", F.lit(False)).alias("is_winner"),
        )
        .withColumn("place", F.row_number().over(in_turn).cast("long"))
    )
