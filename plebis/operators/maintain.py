"""Upkeep of the tables: pure functions from DataFrames to DataFrames.

Nothing is changed in place.  Every function returns a mapping or a new table, so
a dry run is to look at it and a commit to write it and swap paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis import schema
from plebis.functions.names import clean_candidate_name, normalize_municipality, normalize_person_name, title_case


def duplicates(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def repoint(facts: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its canonical id where ``mapping`` (id, canonical_id)
    names one."""
    moved = mapping.select(F.col("id").alias(column), "canonical_id")
    return facts.join(moved, column, "left").withColumn(column, F.coalesce("canonical_id", column)).drop("canonical_id").select(*facts.columns)


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Existing rows and those incoming ones, the first of each key, whose key is new."""
    return existing.unionByName(
        keep_first(incoming, key, order).join(existing.select(*key), key, "left_anti").select(*existing.columns)
    )


def sum_turnout(rows: DataFrame) -> DataFrame:
    """Rows of one load, from several files, summed by round and station."""
    return rows.groupBy("election_round_id", "polling_station_id").agg(
        *[F.sum(m).alias(m) for m in ("registered_voters", "ballots_cast", "valid_ballots", "invalid_ballots")]
    )


def upsert_turnout(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A load's sums replace what an earlier load wrote for the same key."""
    key = ["election_round_id", "polling_station_id"]
    fresh = sum_turnout(incoming)
    return fresh.unionByName(existing.join(fresh, key, "left_anti").select(*fresh.columns))


def key_digest(key: list[str]) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key]))


#: Digits of the digest that tell a range: 4,096 ranges of about equal size.
RANGE_DIGITS = 3


def numbered(fresh: DataFrame, key: list[str], after: DataFrame, digest: Callable[[list[str]], Column] = key_digest) -> DataFrame:
    """``fresh``, whose keys are distinct, with ids that go on from the largest of
    ``after`` without gaps, in the order of the key's digest and then of the key itself, so
    keys of one digest stay apart.  Ranges of the digest are numbered side by side, each
    from the sum of those before it; only one row a range meets the others."""
    keyed = fresh.withColumn("__digest", digest(key)).withColumn("__range", F.substring("__digest", 1, RANGE_DIGITS))
    present = after.agg(F.lit("").alias("__range"), F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = present.unionByName(keyed.groupBy("__range").agg(F.count("*").alias("n"))).select("__range", F.sum("n").over(before).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy("__digest", *key))
    return keyed.withColumn("__nth", nth).join(F.broadcast(starts), "__range").withColumn("id", F.col("__start") + F.col("__nth")).drop("__digest", "__range", "__nth", "__start")


def _first_of_new(existing: DataFrame, incoming: DataFrame, key: list[str], attributes: list[str], seq: str) -> DataFrame:
    """Keys that ``existing`` lacks (null equals null), each with the attributes that came
    first; rows without a place come last, and of one place the smallest values count."""
    known = existing.select(*[F.col(k).alias(f"__known_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"__known_{k}")) for k in key]
    first = F.min(F.struct(F.col(seq).isNull().alias("__last"), F.col(seq).alias("__seq"), *attributes)).alias("__first")
    return incoming.join(known, same, "left_anti").groupBy(*key).agg(first).select(*key, *[F.col(f"__first.{a}").alias(a) for a in attributes])


def get_or_create(existing: DataFrame, incoming: DataFrame, key: list[str], attributes: list[str], seq: str = "seq") -> DataFrame:
    """Rows (id, key, attributes): known keys keep all they have, new ones take the
    next ids and the attributes that came first."""
    fresh = _first_of_new(existing, incoming, key, attributes, seq)
    columns = ["id", *key, *attributes]
    return existing.select(*columns).unionByName(numbered(fresh, key, existing).select(*columns))


def municipalities_get_or_create(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows (id, county_id, name, type): towns are known by county and normalised
    name, whatever prefix they come with; a new one keeps the name and type of the
    row that came first (by ``seq``)."""
    keyed = lambda df: df.withColumn("__key", normalize_municipality(F.col("name")))
    key = ["county_id", "__key"]
    fresh = numbered(_first_of_new(keyed(existing), keyed(incoming), key, ["name", "type"], "seq"), key, existing)
    columns = ["id", "county_id", "name", "type"]
    return existing.select(*columns).unionByName(fresh.withColumn("type", municipality_type(F.col("type"))).select(*columns))


def municipality_type(written: Column) -> Column:
    """The types as they are kept; spellings that lost a letter are mended."""
    lower = F.lower(F.trim(written))
    return (
        F.when(lower.isin("opcina", "op ina", "općina"), "općina").when(lower.isin("drzava", "dr ava", "država"), "država").otherwise(lower)
    )


def types_get_or_create(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows (slug, name, parent): new types, and parents that nobody has named,
    whose name is their slug in title case."""
    known = existing.select("slug")
    fresh = keep_first(incoming, ["slug"], [F.col("seq")]).join(known, "slug", "left_anti").select("slug", "name", "parent")
    parents = incoming.where("parent is not null").select(F.col("parent").alias("slug")).distinct()
    named = parents.join(known, "slug", "left_anti").join(fresh.select("slug"), "slug", "left_anti")
    made = named.select("slug", title_case(F.replace("slug", F.lit("_"), F.lit(" "))).alias("name"), F.lit(None).cast("string").alias("parent"))
    return existing.select("slug", "name", "parent").unionByName(fresh).unionByName(made)


def person_mapping(persons: DataFrame) -> DataFrame:
    """(id, canonical_id) of people that are not the smallest id of their
    normalized name."""
    canonical = F.min("id").over(Window.partitionBy("normalized_name"))
    return persons.select("id", canonical.alias("canonical_id")).where("id <> canonical_id")


def merged(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """The rows that no mapping (id, canonical_id) sends to another."""
    return rows.join(mapping.where("id <> canonical_id").select("id"), "id", "left_anti").select(*rows.columns)


def without_titles(persons: DataFrame, mapping: DataFrame) -> DataFrame:
    """People after ``title_mapping``: merged ones go, others take the clean name."""
    renamed = mapping.where("action = 'rename'").select("id", "clean_name")
    kept = merged(persons, mapping.where("action = 'merge'")).join(renamed, "id", "left")
    parts = F.split("clean_name", " ", 2)
    return kept.select(
        "id",
        F.coalesce(F.get(parts, F.lit(0)), "first_name").alias("first_name"),
        F.coalesce(F.get(parts, F.lit(1)), "last_name").alias("last_name"),
        F.coalesce(normalize_person_name(F.col("clean_name")), "normalized_name").alias("normalized_name"),
    )


def title_mapping(persons: DataFrame) -> DataFrame:
    """(id, action, canonical_id, clean_name) for people whose name changes when
    titles go: merged into the smallest id that has the cleaned name already, else
    into the smallest id that is being cleaned to it, which is renamed."""
    full = F.concat_ws(" ", "first_name", "last_name")
    cleaned = clean_candidate_name(full)
    rows = persons.select("id", "normalized_name", cleaned.alias("clean_name"), normalize_person_name(cleaned).alias("clean_norm"))
    changed = rows.where("clean_norm <> normalized_name and clean_norm <> ''")
    known = persons.groupBy(F.col("normalized_name").alias("clean_norm")).agg(F.min("id").alias("known_id"))
    first = F.min("id").over(Window.partitionBy("clean_norm"))
    return (
        changed.join(known, "clean_norm", "left")
        .withColumn("canonical_id", F.coalesce("known_id", first))
        .select("id", F.when(F.col("id") == F.col("canonical_id"), "rename").otherwise("merge").alias("action"), "canonical_id", "clean_name")
    )


def municipality_mapping(munis: DataFrame) -> DataFrame:
    """(id, canonical_id): towns of one county and one normalized name, but not
    where they are of two real types.  The canonical one is the smallest id with a
    real type, else the smallest id."""
    real = F.col("type").isin("grad", "općina")
    group = Window.partitionBy("county_id", "key")
    return (
        munis.withColumn("key", normalize_municipality(F.col("name")))
        .withColumn("kinds", F.size(F.collect_set(F.when(real, F.col("type"))).over(group)))
        .withColumn("canonical_id", F.coalesce(F.min(F.when(real, F.col("id"))).over(group), F.min("id").over(group)))
        .where("kinds < 2 and id <> canonical_id")
        .select("id", "canonical_id")
    )


def merged_stations(stations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations under their canonical municipality, one a number, and the mapping
    of those that were merged; a station that was there already stays."""
    moved = mapping.select(F.col("id").alias("municipality_id"), F.col("canonical_id").alias("to"))
    placed = stations.join(moved, "municipality_id", "left").select(
        "id", F.coalesce("to", "municipality_id").alias("municipality_id"), F.col("to").isNotNull().alias("moved"), "number",
        *[c for c in stations.columns if c not in ("id", "municipality_id", "number")],
    )
    group = Window.partitionBy("municipality_id", "number")
    stays = F.first("id").over(group.orderBy("moved", "id"))
    ranked = placed.withColumn("canonical_id", stays)
    return (
        ranked.where("id = canonical_id").select(*stations.columns),
        ranked.where("id <> canonical_id").select("id", "canonical_id"),
    )


def move_results(facts: DataFrame, merged: DataFrame, key: list[str]) -> DataFrame:
    """Results of merged stations go to the one that stays, unless it has a row
    for the same key itself; of several that move, the smallest station's."""
    moved = merged.select(F.col("id").alias("polling_station_id"), "canonical_id")
    both = facts.join(moved, "polling_station_id", "left").withColumn("from", F.col("polling_station_id"))
    both = both.withColumn("polling_station_id", F.coalesce("canonical_id", "polling_station_id"))
    return keep_first(both, [*key, "polling_station_id"], [F.col("canonical_id").isNotNull(), F.col("from")]).select(*facts.columns)


def mandates(t, roster: DataFrame, types: list[str]) -> DataFrame:
    """Roster rows (year, normalized_name, group) to (candidacy_id, year, group):
    the first candidacy of that name in the year's rounds.  What a year had before
    is replaced by it as a whole."""
    from plebis.operators import totals

    of_rounds = totals.rounds(t, types).select(F.col("round_id").alias("election_round_id"), "year")
    found = totals.candidacies(t).join(F.broadcast(of_rounds), "election_round_id").join(roster, ["year", "normalized_name"])
    return found.groupBy("year", "normalized_name").agg(
        F.min("candidacy_id").alias("candidacy_id"), F.min_by("group", "candidacy_id").alias("group")
    )


def replace_years(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    return existing.join(fresh.select("year").distinct(), "year", "left_anti").unionByName(fresh.select(*existing.columns))


def wiped(t, number: int) -> dict[str, DataFrame]:
    """The tables without a parliament district: its lists and all that hangs on
    them.  District 12 takes its sub-districts along but leaves turnout, which
    other ballots share."""
    numbers = [number, *range(121, 127)] if number == 12 else [number]
    districts = t.electoral_district.where(F.col("number").isin(numbers)).select(F.col("id").alias("district_id"))
    lists = t.electoral_list.join(districts, "district_id", "left_semi").select(F.col("id").alias("electoral_list_id"), "election_round_id")
    gone = t.candidacy.join(lists, "electoral_list_id", "left_semi").select(F.col("id").alias("candidacy_id"))
    tables = {
        "electoral_list": t.electoral_list.join(lists.select(F.col("electoral_list_id").alias("id")), "id", "left_anti"),
        "list_result": t.list_result.join(lists, "electoral_list_id", "left_anti"),
        "candidacy": t.candidacy.join(gone.withColumnRenamed("candidacy_id", "id"), "id", "left_anti"),
        "candidate_result": t.candidate_result.join(gone, "candidacy_id", "left_anti"),
        "turnout": t.turnout,
    }
    if number != 12:
        places = t.list_result.join(lists, "electoral_list_id").select("election_round_id", "polling_station_id").distinct()
        tables["turnout"] = t.turnout.join(places, ["election_round_id", "polling_station_id"], "left_anti")
    return tables


def dependents(root: str, keys: dict[str, dict[str, str]] = schema.FOREIGN_KEYS) -> list[str]:
    """The tables that rows of ``root`` can take along, each after all it depends on."""
    reached, waiting = [root], [root]
    while waiting:
        parent = waiting.pop()
        for table, columns in keys.items():
            if parent in columns.values() and table not in reached:
                reached.append(table)
                waiting.append(table)
    placed: list[str] = [root]
    while len(placed) < len(reached):
        ready = [x for x in reached if x not in placed and all(p in placed or p not in reached or p == x for p in keys[x].values())]
        if not ready:
            raise ValueError(f"keys go round in a circle below {root}")
        placed += sorted(ready)
    return placed


def cascade(t, root: str, gone: DataFrame, keys: dict[str, dict[str, str]] = schema.FOREIGN_KEYS) -> dict[str, DataFrame]:
    """The tables that change when the rows of ``root`` with the ids ``gone`` (id) are
    deleted, without what hangs on them: the declared keys are walked from parents to
    children, and a row goes when any row that it names goes."""
    lost, left = {root: gone.select("id").distinct()}, {}
    for name in dependents(root, keys):
        rows = getattr(t, name)
        parents = {c: p for c, p in keys.get(name, {}).items() if p in lost and p != name}
        kept = rows if name != root else rows.join(lost[root], "id", "left_anti")
        for column, parent in parents.items():
            kept = kept.join(lost[parent].withColumnRenamed("id", column), column, "left_anti")
        left[name] = kept.select(*rows.columns)
        if name != root and "id" in rows.columns:
            named = [rows.join(lost[p].withColumnRenamed("id", c), c, "left_semi").select("id") for c, p in parents.items()]
            found = named[0]
            for more in named[1:]:
                found = found.unionByName(more)
            lost[name] = found.distinct()
    return left


def orphan_stations(t) -> DataFrame:
    """Stations without turnout, list results and candidate results."""
    found = t.polling_station
    for facts in (t.turnout, t.list_result, t.candidate_result):
        found = found.join(facts.select(F.col("polling_station_id").alias("id")), "id", "left_anti")
    return found


def resolve_county(rows: DataFrame, counties: DataFrame) -> DataFrame:
    """Rows (code, county_name) with county_id: by normalized name, else by code."""
    from plebis.functions.names import normalize_county, zfill

    named = counties.select(F.col("id").alias("by_name"), normalize_county(F.col("name")).alias("norm"))
    coded = counties.select(F.col("id").alias("by_code"), F.col("code").alias("padded"))
    return (
        rows.withColumn("norm", normalize_county(F.col("county_name")))
        .withColumn("padded", zfill(F.col("code"), 2))
        .join(F.broadcast(named), "norm", "left")
        .join(F.broadcast(coded), "padded", "left")
        .withColumn("county_id", F.coalesce("by_name", "by_code"))
        .drop("norm", "padded", "by_name", "by_code")
    )
