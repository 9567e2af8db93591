"""Upkeep of the tables, on copies with injected duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plebis.operators import maintain
from plebis.plans.catalog import query
from plebis.plans.fixtures import new_folder
from plebis.sources.store import At, Change, Store
from plebis.sources.store import upsert_turnout as upsert_turnout_versions

WIPED = ("electoral_list", "list_result", "candidacy", "candidate_result", "turnout")


@query(
    "SELECT id, min(id) OVER (PARTITION BY name) AS canonical_id FROM (SELECT p_partkey::BIGINT AS id, upper(p_name) AS name FROM part) QUALIFY id <> min(id) OVER (PARTITION BY name)",
    own=True,
)
def merge_persons(t):
    from plebis.functions.names import normalize_person_name

    people = t.raw("part").select(F.col("p_partkey").alias("id"), normalize_person_name(F.col("p_name")).alias("normalized_name"))
    return maintain.person_mapping(people)


@query("SELECT 'candidacy' AS kind, id, person_id FROM candidacy UNION ALL SELECT 'person', id, id FROM person")
def merge_persons_applied(t):
    """Every person stands twice, and every other candidacy is the copy's: copies
    go, their candidacies pass to whom they copy."""
    copies = t.person.withColumn("id", F.col("id") + 100000)
    people = t.person.unionByName(copies)
    theirs = t.candidacy.withColumn("person_id", F.col("person_id") + F.when(F.col("id") % 2 == 0, 100000).otherwise(0))
    mapping = maintain.person_mapping(people)
    moved = maintain.repoint(theirs, mapping, "person_id").select(F.lit("candidacy").alias("kind"), "id", "person_id")
    return moved.unionByName(maintain.merged(people, mapping).select(F.lit("person").alias("kind"), "id", F.col("id").alias("person_id")))


@query(
    "SELECT id, first_name, last_name, normalized_name FROM person WHERE id % 3 = 0 UNION ALL SELECT id + 100000, first_name, last_name, normalized_name FROM person WHERE id % 3 <> 0"
)
def clean_titles_applied(t):
    bare, titled = _titled(t)
    people = bare.unionByName(titled)
    return maintain.without_titles(people, maintain.title_mapping(people))


@query(
    "SELECT id + 100000 AS id, CASE WHEN id % 3 = 0 THEN 'merge' ELSE 'rename' END AS action, CASE WHEN id % 3 = 0 THEN id ELSE id + 100000 END AS canonical_id, "
    "first_name || ' ' || last_name AS clean_name FROM person"
)
def clean_titles(t):
    """Every person once more with a title; every third is known without it."""
    bare, titled = _titled(t)
    return maintain.title_mapping(bare.unionByName(titled))


def _titled(t):
    bare = t.person.where("id % 3 = 0")
    titled = t.person.select(
        (F.col("id") + 100000).alias("id"),
        F.concat(F.lit("dr.sc. "), "first_name").alias("first_name"),
        "last_name",
        F.concat(F.lit("DR.SC. "), "normalized_name").alias("normalized_name"),
    )
    return bare, titled


@query(
    "SELECT 'station' AS kind, id AS station, municipality_id AS at, 0::BIGINT AS votes FROM polling_station UNION ALL "
    "SELECT 'result', polling_station_id, electoral_list_id, votes FROM list_result"
)
def merge_municipalities_applied(t):
    """Stations stand again under a town's copy; odd ones' results are kept there,
    even ones' stand in both places, with other votes in the copy."""
    munis = t.municipality
    copies = munis.withColumn("id", F.col("id") + 1000).withColumn("name", F.concat(F.lit("GRAD "), F.lower("name"))).withColumn("type", F.lit(""))
    mapping = maintain.municipality_mapping(munis.unionByName(copies))
    shift = 10_000_000
    again = t.polling_station.withColumn("id", F.col("id") + shift).withColumn("municipality_id", F.col("municipality_id") + 1000)
    stations, gone = maintain.merged_stations(t.polling_station.unionByName(again), mapping)
    odd = F.col("polling_station_id") % 2 != 0
    there = t.list_result.withColumn("polling_station_id", F.col("polling_station_id") + shift)
    facts = (
        t.list_result.where(~odd)
        .unionByName(there.where(odd))
        .unionByName(there.where(~odd).withColumn("votes", F.col("votes") + 5))
    )
    moved = maintain.move_results(facts, gone, ["electoral_list_id"])
    left = stations.select(F.lit("station").alias("kind"), F.col("id").alias("station"), F.col("municipality_id").alias("at"), F.lit(0).cast("long").alias("votes"))
    return left.unionByName(moved.select(F.lit("result").alias("kind"), F.col("polling_station_id").alias("station"), F.col("electoral_list_id").alias("at"), "votes"))


@query("SELECT id + 1000 AS id, id AS canonical_id FROM municipality WHERE id % 5 <> 0")
def merge_municipalities(t):
    """Every municipality again under its full name; every fifth copy is of the
    other type and stays apart."""
    other = F.when(F.col("type") == "grad", "općina").otherwise("grad")
    copies = t.municipality.select(
        (F.col("id") + 1000).alias("id"),
        "county_id",
        F.concat(F.lit("GRAD "), F.lower("name")).alias("name"),
        F.when(F.col("id") % 5 == 0, other).otherwise(F.lit("")).alias("type"),
    )
    return maintain.municipality_mapping(t.municipality.unionByName(copies))


@query(
    "SELECT x.year, p.normalized_name, min(c.id)::BIGINT AS candidacy_id, 'G' || (min(p.id) % 4)::VARCHAR AS \"group\" FROM candidacy c JOIN person p ON p.id = c.person_id "
    "JOIN electoral_list l ON l.id = c.electoral_list_id JOIN election_round r ON r.id = l.election_round_id JOIN election x ON x.id = r.election_id "
    "WHERE x.election_type_id = 3 AND p.id % 14 = x.year % 14 GROUP BY ALL"
)
def mandate_upsert(t):
    years = t.election.where("election_type_id = 3").select("year")
    roster = (
        t.person.join(F.broadcast(years), F.col("id") % 14 == F.col("year") % 14)
        .select("year", "normalized_name", F.concat(F.lit("G"), (F.col("id") % 4).cast("string")).alias("group"))
    )
    return maintain.mandates(t, roster, ["Izbori za Europski parlament"])


@query(
    "SELECT x.year, min(c.id)::BIGINT AS candidacy_id FROM candidacy c JOIN person p ON p.id = c.person_id JOIN electoral_list l ON l.id = c.electoral_list_id "
    "JOIN election_round r ON r.id = l.election_round_id JOIN election x ON x.id = r.election_id WHERE x.election_type_id = 3 AND x.year % 2 = 0 AND p.id % 14 = x.year % 14 GROUP BY x.year, p.normalized_name "
    "UNION ALL SELECT year, -1::BIGINT FROM election WHERE election_type_id = 3 AND year % 2 = 1"
)
def mandate_stale(t):
    """Every year has a stale row; rosters come for even years, whose rows go."""
    years = t.election.where("election_type_id = 3").select("year")
    roster = t.person.join(F.broadcast(years.where("year % 2 = 0")), F.col("id") % 14 == F.col("year") % 14).select("year", "normalized_name", F.lit("G").alias("group"))
    fresh = maintain.mandates(t, roster, ["Izbori za Europski parlament"])
    stale = years.select("year", F.lit("X").alias("normalized_name"), F.lit(-1).cast("long").alias("candidacy_id"), F.lit("G").alias("group"))
    return maintain.replace_years(stale, fresh).select("year", "candidacy_id")


@query(
    "SELECT 'electoral_list' AS table_name, count(*)::BIGINT AS n FROM electoral_list WHERE district_id IS NULL OR district_id % 1000 NOT IN (12, 121, 122, 123, 124, 125, 126) "
    "UNION ALL SELECT 'list_result', count(*)::BIGINT FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id WHERE l.district_id IS NULL OR l.district_id % 1000 NOT IN (12, 121, 122, 123, 124, 125, 126) "
    "UNION ALL SELECT 'candidacy', count(*)::BIGINT FROM candidacy c JOIN electoral_list l ON l.id = c.electoral_list_id WHERE l.district_id IS NULL OR l.district_id % 1000 NOT IN (12, 121, 122, 123, 124, 125, 126) "
    "UNION ALL SELECT 'candidate_result', count(*)::BIGINT FROM candidate_result r JOIN candidacy c ON c.id = r.candidacy_id JOIN electoral_list l ON l.id = c.electoral_list_id WHERE l.district_id IS NULL OR l.district_id % 1000 NOT IN (12, 121, 122, 123, 124, 125, 126) "
    "UNION ALL SELECT 'turnout', count(*)::BIGINT FROM turnout"
)
def wipe_district_12(t):
    """District 12 takes its sub-districts along and leaves turnout."""
    counts = [left.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, left in maintain.wiped(t, 12).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).unionByName(counts[4])


@query(
    "SELECT county_id, name, type FROM municipality WHERE id % 2 = 0 UNION ALL SELECT county_id, 'GRAD ' || lower(name), CASE WHEN id % 3 = 0 THEN 'općina' ELSE 'grad' END FROM municipality WHERE id % 2 = 1"
)
def municipality_get_or_create(t):
    """Even towns are known; all come in twice, first with a prefix and a type as
    it may be written."""
    munis = t.municipality
    written = F.when(F.col("id") % 3 == 0, "OP INA").otherwise("Grad ")
    first = munis.select("county_id", F.concat(F.lit("GRAD "), F.lower("name")).alias("name"), written.alias("type"), F.lit(1).alias("seq"))
    later = munis.select("county_id", "name", "type", F.lit(2).alias("seq"))
    return maintain.municipalities_get_or_create(munis.where("id % 2 = 0"), first.unionByName(later)).select("county_id", "name", "type")


@query(
    "SELECT slug, name, NULL::VARCHAR AS parent FROM election_type UNION ALL SELECT 'local_' || id::VARCHAR, 'Town ' || id::VARCHAR, 'local_votes_' || (id % 3)::VARCHAR FROM municipality "
    "UNION ALL SELECT DISTINCT 'local_votes_' || (id % 3)::VARCHAR, 'Local Votes ' || (id % 3)::VARCHAR, NULL FROM municipality"
)
def type_get_or_create(t):
    """A type for each town under one of three parents that nobody has named."""
    known = t.election_type.select("slug", "name", F.lit(None).cast("string").alias("parent"))
    key = F.col("id").cast("string")
    incoming = t.municipality.select(
        F.concat(F.lit("local_"), key).alias("slug"), F.concat(F.lit("Town "), key).alias("name"),
        F.concat(F.lit("local_votes_"), (F.col("id") % 3).cast("string")).alias("parent"), F.lit(1).alias("seq"),
    )
    return maintain.types_get_or_create(known, incoming)


@query(
    "SELECT 'list_result' AS table_name, count(*)::BIGINT AS n FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id WHERE l.district_id IS NULL OR l.district_id % 1000 <> 5 "
    "UNION ALL SELECT 'candidacy', count(*)::BIGINT FROM candidacy c JOIN electoral_list l ON l.id = c.electoral_list_id WHERE l.district_id IS NULL OR l.district_id % 1000 <> 5 "
    "UNION ALL SELECT 'turnout', count(*)::BIGINT FROM turnout x WHERE (election_round_id, polling_station_id) NOT IN (SELECT (l.election_round_id, r.polling_station_id) FROM list_result r "
    "JOIN electoral_list l ON l.id = r.electoral_list_id WHERE l.district_id % 1000 = 5)"
)
def wipe_district(t):
    left = maintain.wiped(t, 5)
    counts = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("list_result", "candidacy", "turnout")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "SELECT electoral_list_id, polling_station_id, CASE WHEN polling_station_id % 2 = 0 THEN votes ELSE votes + 1 END::BIGINT AS votes FROM list_result"
)
def insert_ignore(t):
    """Half of the stations are stored; all come in again, twice, with other votes."""
    stored = t.list_result.where("polling_station_id % 2 = 0")
    again = t.list_result.withColumn("votes", F.col("votes") + 1).withColumn("seq", F.lit(1))
    later = t.list_result.withColumn("votes", F.col("votes") + 2).withColumn("seq", F.lit(2))
    incoming = again.unionByName(later)
    return maintain.insert_ignore(stored, incoming, ["electoral_list_id", "polling_station_id"], [F.col("seq")])


@query(
    "SELECT election_round_id, polling_station_id, CASE WHEN polling_station_id % 3 = 0 THEN 2 * registered_voters ELSE registered_voters END::BIGINT AS registered_voters, "
    "CASE WHEN polling_station_id % 3 = 0 THEN 2 * ballots_cast ELSE ballots_cast END::BIGINT AS ballots_cast FROM turnout"
)
def upsert_turnout(t):
    """Every third station comes in from two files, whose sum replaces what was."""
    part = t.turnout.where("polling_station_id % 3 = 0")
    return maintain.upsert_turnout(t.turnout, part.unionByName(part)).select(
        "election_round_id", "polling_station_id", "registered_voters", "ballots_cast"
    )


@query(
    "SELECT name, municipality_id, location FROM (SELECT c_name AS name, c_nationkey::BIGINT AS municipality_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'first ' || c_mktsegment END AS location FROM customer)",
    own=True,
)
def get_or_create_dim(t):
    """Even stations are known; all come in twice, and the first attributes stay."""
    rows = t.polling_station.select("id", "name", "municipality_id", "location")
    incoming = rows.select("name", "municipality_id", F.concat(F.lit("first "), "location").alias("location"), F.lit(1).alias("seq")).unionByName(
        rows.select("name", "municipality_id", F.concat(F.lit("later "), "location").alias("location"), F.lit(2).alias("seq"))
    )
    made = maintain.get_or_create(rows.where("id % 2 = 0"), incoming, ["name", "municipality_id"], ["location"])
    return made.select("name", "municipality_id", "location")


@query(
    "SELECT id, name, municipality_id FROM polling_station WHERE id % 2 = 0 UNION ALL SELECT (SELECT max(id) FROM polling_station WHERE id % 2 = 0) "
    "+ row_number() OVER (ORDER BY md5(concat_ws(chr(31), name, municipality_id::VARCHAR)), name, municipality_id), name, municipality_id FROM polling_station WHERE id % 2 = 1"
)
def get_or_create_ids(t):
    """Odd stations are new and take the ids after the largest; a second load of the same
    rows changes none."""
    rows = t.polling_station.select("id", "name", "municipality_id", "location")
    incoming = rows.select("name", "municipality_id", "location", F.lit(1).alias("seq"))
    key = ["name", "municipality_id"]
    once = maintain.get_or_create(rows.where("id % 2 = 0"), incoming, key, ["location"])
    return maintain.get_or_create(once, incoming, key, ["location"]).select("id", *key)


@query("SELECT c_custkey::BIGINT AS c_custkey, n_regionkey::BIGINT AS county_id FROM customer JOIN nation ON n_nationkey = c_nationkey", own=True)
def resolve_county(t):
    """Half of the rows name their county in full, the others only give its code."""
    places = t.polling_station.select(F.col("id").alias("c_custkey"), "municipality_id").join(
        F.broadcast(t.municipality.select(F.col("id").alias("municipality_id"), F.col("county_id").alias("c"))), "municipality_id"
    )
    named = places.join(F.broadcast(t.county.withColumnsRenamed({"id": "c", "name": "n", "code": "k"})), "c")
    rows = named.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 2 == 0, F.lit("77")).otherwise(F.regexp_replace("k", "^0", "")).alias("code"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("n"), F.lit(" županija"))).otherwise("inozemstvo").alias("county_name"),
    )
    return maintain.resolve_county(rows, t.county).select("c_custkey", "county_id")


def _store(t) -> Store:
    return Store(t.spark, new_folder(t.spark, "store"))


@query(
    "SELECT election_round_id, polling_station_id, CASE WHEN election_round_id % 2 = 0 AND polling_station_id % 3 = 0 THEN 2 * registered_voters ELSE registered_voters END::BIGINT AS registered_voters, "
    "CASE WHEN election_round_id % 2 = 0 AND polling_station_id % 3 = 0 THEN 2 * ballots_cast ELSE ballots_cast END::BIGINT AS ballots_cast FROM turnout"
)
def upsert_by_round(t):
    """Turnout kept by round; every third station of even rounds comes in from two
    files.  Odd rounds keep their files."""
    store = _store(t)
    store.commit({"turnout": Change(t.turnout, "election_round_id")})
    part = t.turnout.where("election_round_id % 2 = 0 AND polling_station_id % 3 = 0")
    upsert_turnout_versions(store, part.unionByName(part))
    return store.read("turnout").select("election_round_id", "polling_station_id", "registered_voters", "ballots_cast")


_KEPT = "(l.district_id IS NULL OR l.district_id % 1000 <> 5)"


@query(
    f"SELECT 'now' AS version, r.electoral_list_id, r.polling_station_id, r.votes FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id WHERE {_KEPT} "
    "UNION ALL SELECT 'before', electoral_list_id, polling_station_id, votes FROM list_result UNION ALL SELECT 'back', electoral_list_id, polling_station_id, votes FROM list_result"
)
def wipe_committed(t):
    """A district wiped in one commit over several tables, the version before, and
    the rollback."""
    t, store = t.written(), _store(t)
    first = store.commit({n: Change(getattr(t, n)) for n in WIPED})
    second = store.commit({n: Change(rows) for n, rows in maintain.wiped(At(store, t, first), 5).items()}, base=first)
    third = store.rollback(first)
    rows = lambda name, v: store.read("list_result", v).select(F.lit(name).alias("version"), "electoral_list_id", "polling_station_id", "votes")
    return rows("now", second).unionByName(rows("before", first)).unionByName(rows("back", third))


@query(
    f"SELECT 'electoral_list' AS table_name, count(*)::BIGINT AS before, 0::BIGINT AS added, count(*) FILTER (NOT {_KEPT})::BIGINT AS removed FROM electoral_list l "
    f"UNION ALL SELECT 'list_result', count(*)::BIGINT, 0::BIGINT, count(*) FILTER (NOT {_KEPT})::BIGINT FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id "
    f"UNION ALL SELECT 'candidacy', count(*)::BIGINT, 0::BIGINT, count(*) FILTER (NOT {_KEPT})::BIGINT FROM candidacy c JOIN electoral_list l ON l.id = c.electoral_list_id "
    f"UNION ALL SELECT 'candidate_result', count(*)::BIGINT, 0::BIGINT, count(*) FILTER (NOT {_KEPT})::BIGINT FROM candidate_result r JOIN candidacy c ON c.id = r.candidacy_id JOIN electoral_list l ON l.id = c.electoral_list_id "
    "UNION ALL SELECT 'turnout', count(*)::BIGINT, 0::BIGINT, count(*) FILTER ((election_round_id, polling_station_id) IN (SELECT (l.election_round_id, r.polling_station_id) FROM list_result r "
    f"JOIN electoral_list l ON l.id = r.electoral_list_id WHERE NOT {_KEPT}))::BIGINT FROM turnout"
)
def wipe_dry_run(t):
    """What wiping a district would take away, told without a commit."""
    t, store = t.written(), _store(t)
    first = store.commit({n: Change(getattr(t, n)) for n in WIPED})
    return store.dry_run({n: Change(rows) for n, rows in maintain.wiped(At(store, t, first), 5).items()})


_LEFT = {
    "electoral_list": ("electoral_list l", "l.id, l.election_round_id", "l.election_round_id"),
    "candidacy": ("candidacy c JOIN electoral_list l ON l.id = c.electoral_list_id", "c.id, c.person_id", "l.election_round_id"),
    "list_result": ("list_result r JOIN electoral_list l ON l.id = r.electoral_list_id", "r.electoral_list_id, r.polling_station_id", "l.election_round_id"),
    "candidate_result": (
        "candidate_result r JOIN candidacy c ON c.id = r.candidacy_id JOIN electoral_list l ON l.id = c.electoral_list_id", "r.candidacy_id, r.polling_station_id", "l.election_round_id",
    ),
    "turnout": ("turnout x", "x.election_round_id, x.polling_station_id", "x.election_round_id"),
    "election_round": ("election_round e", "e.id, e.election_id", "e.id"),
}


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, a::BIGINT AS a, b::BIGINT AS b FROM (SELECT {columns.split(', ')[0]} AS a, {columns.split(', ')[1]} AS b, {by} AS round_id FROM {source}) WHERE round_id % 20 <> 12"
        for name, (source, columns, by) in _LEFT.items()
    )
)
def delete_cascade(t):
    """Rounds deleted with all that hangs on them, by the declared keys; what is left."""
    left = maintain.cascade(t, "election_round", t.election_round.where("id % 20 = 12"))
    out = None
    for name, (_, columns, _) in _LEFT.items():
        a, b = (c.split(".")[1] for c in columns.split(", "))
        rows = left[name].select(F.lit(name).alias("table_name"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out
