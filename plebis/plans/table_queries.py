"""Scans, filters, scopes, joins, sums, lookups and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plebis.functions import names
from plebis.operators import lookup, maintain, rank, totals
from plebis.operators.grams import Index
from plebis.operators.scope import scope_stations, siblings
from plebis.plans.catalog import query
from plebis.plans.fixtures import new_folder
from plebis.sources.store import At, Change, Store

# ---- scans and filters


@query("SELECT id, municipality_id, number, name AS station_name FROM polling_station")
def scan_table(t):
    return t.polling_station.select("id", "municipality_id", "number", F.col("name").alias("station_name"))


@query("SELECT id, name FROM municipality WHERE type = 'grad' AND county_id = 2")
def filter_eq(t):
    return t.municipality.where((F.col("type") == "grad") & (F.col("county_id") == 2)).select("id", "name")


@query("SELECT id, election_round_id, name FROM electoral_list WHERE name IN ('LISTA 2', 'LISTA 5', 'LISTA 8')")
def filter_in(t):
    return t.electoral_list.where(F.col("name").isin("LISTA 2", "LISTA 5", "LISTA 8")).select("id", "election_round_id", "name")


@query("SELECT id, name FROM electoral_list WHERE district_id IS NULL")
def filter_null(t):
    return t.electoral_list.where(F.col("district_id").isNull()).select("id", "name")


@query("SELECT id, name FROM electoral_list WHERE name NOT LIKE '%PARTNER%'")
def filter_not_like(t):
    return t.electoral_list.where(~F.col("name").contains("PARTNER")).select("id", "name")


@query("SELECT d.id, d.number FROM electoral_district d, county c WHERE d.number < 121 AND c.code < '02'")
def filter_range(t):
    low = t.county.where(F.col("code") < "02").select(F.lit(True).alias("low"))
    return t.electoral_district.where(F.col("number") < 121).join(F.broadcast(low)).select("id", "number")


@query(
    "SELECT electoral_list_id, polling_station_id, votes FROM list_result WHERE polling_station_id IN "
    "(SELECT p.id FROM polling_station p JOIN municipality m ON m.id = p.municipality_id WHERE m.county_id = 1)"
)
def semi_join_scope(t):
    return t.list_result.join(scope_stations(t, county=1), "polling_station_id", "left_semi").select(
        "electoral_list_id", "polling_station_id", "votes"
    )


@query(
    "SELECT DISTINCT polling_station_id FROM turnout WHERE polling_station_id NOT IN "
    "(SELECT polling_station_id FROM turnout t JOIN election_round r ON r.id = t.election_round_id JOIN election e ON e.id = r.election_id "
    "WHERE e.election_type_id = 3)"
)
def anti_join_merge(t):
    europe = totals.rounds(t, ["Izbori za Europski parlament"]).select(F.col("round_id").alias("election_round_id"))
    voted = t.turnout.join(F.broadcast(europe), "election_round_id", "left_semi").select("polling_station_id")
    return t.turnout.select("polling_station_id").distinct().join(voted, "polling_station_id", "left_anti")


@query(
    "SELECT id, number FROM polling_station p WHERE NOT EXISTS (SELECT 1 FROM turnout x WHERE x.polling_station_id = p.id) "
    "AND NOT EXISTS (SELECT 1 FROM list_result x WHERE x.polling_station_id = p.id) "
    "AND NOT EXISTS (SELECT 1 FROM candidate_result x WHERE x.polling_station_id = p.id)"
)
def orphan_stations(t):
    return maintain.orphan_stations(t).select("id", "number")


@query(
    "SELECT a.id, b.id AS sibling_id FROM polling_station a JOIN polling_station b "
    "ON a.location IS NOT DISTINCT FROM b.location AND a.address IS NOT DISTINCT FROM b.address"
)
def sibling_stations(t):
    return siblings(t.polling_station)


# ---- scopes


def _scoped(t, **scope):
    return totals.turnout_totals(t, ["election_round_id"], scope_stations(t, **scope))


_SUMS = (
    "sum(registered_voters)::BIGINT AS registered_voters, sum(ballots_cast)::BIGINT AS ballots_cast, "
    "sum(valid_ballots)::BIGINT AS valid_ballots, sum(invalid_ballots)::BIGINT AS invalid_ballots"
)


@query(f"SELECT election_round_id, {_SUMS} FROM turnout WHERE polling_station_id = 7 GROUP BY ALL")
def scope_station(t):
    return _scoped(t, station=7)


@query(
    f"SELECT election_round_id, {_SUMS} FROM turnout WHERE polling_station_id IN "
    "(SELECT id FROM polling_station WHERE municipality_id = 4) GROUP BY ALL"
)
def scope_municipality(t):
    return _scoped(t, municipality=4)


@query(
    f"SELECT election_round_id, {_SUMS} FROM turnout WHERE polling_station_id IN "
    "(SELECT p.id FROM polling_station p JOIN municipality m ON m.id = p.municipality_id WHERE m.county_id = 3) GROUP BY ALL"
)
def scope_county(t):
    return _scoped(t, county=3)


@query(
    f"SELECT election_round_id, {_SUMS} FROM turnout WHERE polling_station_id IN (SELECT polling_station_id FROM list_result r "
    "JOIN electoral_list l ON l.id = r.electoral_list_id WHERE l.district_id = 21998003) GROUP BY ALL"
)
def scope_district(t):
    return _scoped(t, district=21998003)


@query(
    f"SELECT election_round_id, {_SUMS} FROM turnout WHERE polling_station_id IN "
    "(SELECT id FROM polling_station WHERE municipality_id = 4 AND address = 'MACHINERY 5') GROUP BY ALL"
)
def scope_street(t):
    return _scoped(t, municipality=4, street="MACHINERY 5")


# ---- joins

_ROUNDS = (
    "rounds AS (SELECT r.id AS round_id, r.round_number, e.id AS election_id, e.year, e.date, e.name AS election_name, t.id AS type_id, "
    "t.name AS type_name, CASE WHEN e.name IS NULL OR e.name = '' THEN t.name || ' ' || e.year::VARCHAR ELSE e.name END AS election "
    "FROM election_round r JOIN election e ON e.id = r.election_id JOIN election_type t ON t.id = e.election_type_id)"
)


@query(
    "SELECT m.name AS municipality, x.type_name, x.year, sum(r.votes)::BIGINT AS votes FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id "
    "JOIN rounds x ON x.round_id = l.election_round_id JOIN polling_station p ON p.id = r.polling_station_id "
    "JOIN municipality m ON m.id = p.municipality_id GROUP BY ALL",
    _ROUNDS,
)
def join_fk_chain(t):
    lists = t.electoral_list.select(F.col("id").alias("electoral_list_id"), F.col("election_round_id").alias("round_id"))
    places = t.polling_station.select(F.col("id").alias("polling_station_id"), "municipality_id").join(
        F.broadcast(t.municipality.select(F.col("id").alias("municipality_id"), F.col("name").alias("municipality"))), "municipality_id"
    )
    return (
        t.list_result.join(lists, "electoral_list_id")
        .join(F.broadcast(totals.rounds(t).select("round_id", "type_name", "year")), "round_id")
        .join(places, "polling_station_id")
        .groupBy("municipality", "type_name", "year")
        .agg(F.sum("votes").alias("votes"))
    )


@query(
    "SELECT c.id AS candidacy_id, coalesce(sum(r.votes), 0)::BIGINT AS votes FROM candidacy c LEFT JOIN candidate_result r ON r.candidacy_id = c.id GROUP BY ALL"
)
def left_join_zero_fill(t):
    return totals.personal_votes(t).select("candidacy_id", "votes")


@query(
    "SELECT c.id AS candidacy_id, coalesce(sum(r.votes), 0)::BIGINT AS votes FROM candidacy c LEFT JOIN candidate_result r ON r.candidacy_id = c.id "
    "AND r.polling_station_id IN (SELECT id FROM polling_station WHERE municipality_id = 4) GROUP BY ALL"
)
def left_join_filtered_on(t):
    return totals.personal_votes(t, scope_stations(t, municipality=4)).select("candidacy_id", "votes")


@query(
    "SELECT b.party_id, count(*)::BIGINT AS n_lists, sum(v.votes)::BIGINT AS votes FROM (SELECT id AS electorallist_id, id % 25 AS party_id FROM electoral_list) b "
    "JOIN (SELECT electoral_list_id, sum(votes) AS votes FROM list_result GROUP BY ALL) v ON v.electoral_list_id = b.electorallist_id GROUP BY ALL"
)
def join_bridge(t):
    sums = totals.list_totals(t).select(F.col("electoral_list_id").alias("electorallist_id"), "votes")
    return bridge(t).join(sums, "electorallist_id").groupBy("party_id").agg(F.count("*").alias("n_lists"), F.sum("votes").alias("votes"))


def bridge(t):
    """List and party ids: a list belongs to the party of its number."""
    return t.electoral_list.select(F.col("id").alias("electorallist_id"), (F.col("id") % 25).alias("party_id"))


# ---- sums


@query(
    "SELECT l.id AS electoral_list_id, l.name, sum(r.votes)::BIGINT AS votes FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id GROUP BY ALL"
)
def sum_by_list(t):
    return totals.list_totals(t).select("electoral_list_id", "name", "votes")


@query(
    "SELECT l.election_round_id, l.name, sum(r.votes)::BIGINT AS votes FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id GROUP BY ALL"
)
def sum_by_list_name(t):
    return totals.list_totals_by_name(t)


@query("SELECT coalesce(sum(votes), 0)::BIGINT AS list_votes, count(*)::BIGINT AS n FROM list_result")
def sum_scalar(t):
    return t.list_result.agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("list_votes"), F.count("*").alias("n"))


@query(
    "SELECT election_round_id, polling_station_id, (3 * registered_voters)::BIGINT AS registered_voters, (3 * ballots_cast)::BIGINT AS ballots_cast, "
    "(3 * valid_ballots)::BIGINT AS valid_ballots, (3 * invalid_ballots)::BIGINT AS invalid_ballots FROM turnout"
)
def turnout_sum_duplicates(t):
    """Three files that share every station: their turnout adds up."""
    folder = new_folder(t.spark, "files")
    t.turnout.write.parquet(folder)
    files = [t.spark.read.parquet(folder) for _ in range(3)]
    return maintain.sum_turnout(files[0].unionByName(files[1]).unionByName(files[2]))


@query("SELECT location, address, count(*)::BIGINT AS n FROM polling_station GROUP BY ALL HAVING count(*) > 1")
def dup_groups(t):
    return maintain.duplicates(t.polling_station, ["location", "address"])


@query("SELECT municipality_id, location, address, min(id)::BIGINT AS id FROM polling_station GROUP BY ALL")
def dedup_stations(t):
    return lookup.dedup_stations(t)


@query(
    "SELECT x.polling_station_id, count(DISTINCT r.election_id)::BIGINT AS elections, min(e.date) AS first_date, min(e.year) AS first_year "
    "FROM turnout x JOIN election_round r ON r.id = x.election_round_id JOIN election e ON e.id = r.election_id GROUP BY ALL"
)
def station_elections(t):
    of_rounds = totals.rounds(t).select(F.col("round_id").alias("election_round_id"), "election_id", "year", "date")
    return (
        t.turnout.join(F.broadcast(of_rounds), "election_round_id")
        .groupBy("polling_station_id")
        .agg(F.count_distinct("election_id").alias("elections"), F.min("date").alias("first_date"), F.min("year").alias("first_year"))
    )


@query(
    "SELECT r.electoral_list_id, min(p.municipality_id)::BIGINT AS municipality_id FROM list_result r JOIN polling_station p ON p.id = r.polling_station_id GROUP BY ALL"
)
def list_to_muni(t):
    return rank.list_municipality(t)


# ---- lookups

_CATEGORY = (
    "CASE WHEN type_id = 1 THEN 'predsjednicki' WHEN type_id = 2 THEN 'sabor' WHEN type_id = 3 THEN 'eu' ELSE 'lokalni' END"
)


@query(f"SELECT DISTINCT {_CATEGORY} AS category, year FROM rounds", _ROUNDS)
def category_years(t):
    return lookup.category_years(t)


@query("SELECT d.id, d.number, d.name FROM electoral_district d JOIN election e ON e.id = d.election_id WHERE e.year = 1998 AND d.number < 121")
def district_list(t):
    return lookup.district_list(t, 1998)


@query(
    "SELECT l.district_id, m.id AS municipality_id, m.name, c.name AS county, sum(r.votes)::BIGINT AS votes FROM list_result r "
    "JOIN electoral_list l ON l.id = r.electoral_list_id JOIN polling_station p ON p.id = r.polling_station_id JOIN municipality m ON m.id = p.municipality_id "
    "LEFT JOIN county c ON c.id = m.county_id WHERE l.district_id IS NOT NULL GROUP BY ALL HAVING sum(r.votes) >= 50"
)
def district_municipalities(t):
    return lookup.district_municipalities(t)


@query("SELECT id, name FROM county WHERE code < '90' OR code IS NULL")
def list_counties(t):
    return lookup.list_counties(t)


@query("SELECT id, name FROM municipality WHERE county_id = 1 AND name NOT LIKE '%IZBORNA JEDINICA%'")
def list_municipalities(t):
    return lookup.list_municipalities(t, 1)


@query(
    "SELECT DISTINCT last_name, list_position(['Anić', 'Babić', 'Čačić', 'Ćosić', 'Drašković', 'Đapić', 'Erceg', 'Filipović', 'Grgić', 'Hoić', 'Ivšić', 'Jurić', 'Kos', 'Lončar', 'Ljubić', 'Matić', 'Nović', "
    "'Njegač', 'Oreč', 'Pešić', 'Radoš', 'Šarić', 'Tadić', 'Vukoja', 'Žanić'], last_name)::BIGINT AS nth FROM person"
)
def names_in_order(t):
    return lookup.names_in_order(t)


@query("SELECT DISTINCT address AS name FROM polling_station WHERE municipality_id = 4 AND address IS NOT NULL AND address <> ''")
def list_streets(t):
    return lookup.list_streets(t, 4)


@query(
    "SELECT min(id)::BIGINT AS id, location || ', ' || address AS name FROM polling_station WHERE municipality_id = 4 AND address = 'MACHINERY 5' GROUP BY location, address"
)
def stations_by_street(t):
    return lookup.stations_by_street(t, 4, "MACHINERY 5")


@query(
    "SELECT id, first_name || ' ' || last_name AS name FROM person WHERE normalized_name ILIKE '%CIC%' ORDER BY last_name, first_name, id LIMIT 20"
)
def search_persons(t):
    return lookup.search_persons(t, "čić")


@query(
    r"SELECT DISTINCT trim(split_part(split_part(name, chr(10), 1), ',', 1)) AS name FROM electoral_list WHERE name ILIKE '%ta 1%' "
    "AND contains(lower(trim(split_part(split_part(name, chr(10), 1), ',', 1))), 'ta 1') ORDER BY name LIMIT 20"
)
def search_parties(t):
    return lookup.search_parties(t, "ta 1")


@query(
    "SELECT min(p.id)::BIGINT AS id, p.location || ', ' || p.address AS name, min(m.name) AS municipality FROM polling_station p JOIN municipality m ON m.id = p.municipality_id "
    "WHERE p.address ILIKE '%hold 1%' OR p.location ILIKE '%hold 1%' OR p.name ILIKE '%hold 1%' OR m.name ILIKE '%hold 1%' "
    "GROUP BY p.location, p.address ORDER BY min(m.name), p.location, min(p.id) LIMIT 20"
)
def search_stations(t):
    return lookup.search_stations(t, "hold 1")


#: Search terms: letters, two of them, wildcards, a wildcard between short stretches.
TERMS = {"person": ("čić", "an", "A_A", "n%r", "%%"), "station": ("hold 1", "ld", "1%2", "b_ild"), "party": ("ta 1", "ta")}


@query(
    " UNION ALL ".join(
        [
            f"(SELECT 'person' AS kind, '{q}' AS term, id, first_name || ' ' || last_name AS name FROM person WHERE normalized_name ILIKE '%' || '{like}' || '%' ORDER BY last_name, first_name, id LIMIT 20)"
            for q, like in zip(TERMS["person"], ("CIC", "AN", "A_A", "N%R", "%%"))
        ]
        + [
            f"(SELECT 'station', '{q}', min(p.id)::BIGINT, p.location || ', ' || p.address FROM polling_station p JOIN municipality m ON m.id = p.municipality_id "
            f"WHERE p.address ILIKE '%{q}%' OR p.location ILIKE '%{q}%' OR p.name ILIKE '%{q}%' OR m.name ILIKE '%{q}%' GROUP BY p.location, p.address ORDER BY min(m.name), p.location, min(p.id) LIMIT 20)"
            for q in TERMS["station"]
        ]
        + [
            f"(SELECT DISTINCT 'party', '{q}', NULL::BIGINT, trim(split_part(split_part(name, chr(10), 1), ',', 1)) AS n FROM electoral_list WHERE name ILIKE '%{q}%' AND contains(lower(trim(split_part(split_part(name, chr(10), 1), ',', 1))), '{q}') ORDER BY n LIMIT 20)"
            for q in TERMS["party"]
        ]
    )
)
def search_indexed(t):
    """The same searches by posting lists of three-letter grams."""
    t, store = t.written(), Store(t.spark, new_folder(t.spark, "grams"))
    store.commit({n: Change(getattr(t, n)) for n in ("person", "electoral_list")})  # asked once a search
    t = At(store, t)
    index = lookup.indexed(t, Index(store))
    found = [lookup.search_persons(t, q, index=index).select(F.lit("person").alias("kind"), F.lit(q).alias("term"), "id", "name") for q in TERMS["person"]]
    found += [lookup.search_stations(t, q, index=index).select(F.lit("station").alias("kind"), F.lit(q).alias("term"), "id", "name") for q in TERMS["station"]]
    found += [lookup.search_parties(t, q, index=index).select(F.lit("party").alias("kind"), F.lit(q).alias("term"), F.lit(None).cast("long").alias("id"), "name") for q in TERMS["party"]]
    return reduce(DataFrame.unionByName, found)


# ---- scalar functions


@query("SELECT doc_id, replace(replace(strip_accents(text), 'Đ', 'D'), 'đ', 'd') AS bare FROM documents", own=True)
def strip_diacritics(t):
    return t.raw("documents").select("doc_id", names.strip_diacritics(F.col("text")).alias("bare"))


@query("SELECT p_partkey, upper(trim(regexp_replace('  duric ' || p_name || '  s' || p_type, '\\s+', ' ', 'g'))) AS x FROM part", own=True)
def normalize_person_name(t):
    raw = F.concat(F.lit("  đurić "), F.col("p_name"), F.lit("  š"), F.col("p_type"))
    return t.raw("part").select("p_partkey", names.normalize_person_name(raw).alias("x"))


@query(
    "SELECT p_partkey, upper(p_type) || ' ' || p_name || '-' || p_brand AS name FROM part", own=True
)
def clean_candidate_name(t):
    raw = F.concat(F.lit("prof.dr.sc. "), F.upper("p_type"), F.lit(" , "), F.col("p_name"), F.lit("- "), F.col("p_brand"), F.lit(", , univ.bacc.ing.el."))
    return t.raw("part").select("p_partkey", names.clean_candidate_name(raw).alias("name"))


@query(
    "SELECT p_partkey, split_part(p_name, ' ', 1) AS first_name, substr(p_name || ' ' || p_type, length(split_part(p_name, ' ', 1)) + 2) AS last_name FROM part",
    own=True,
)
def parse_person_name(t):
    return t.raw("part").select("p_partkey", names.parse_person_name(F.concat_ws(" ", "p_name", "p_type")).alias("n")).select(
        "p_partkey", "n.first_name", "n.last_name"
    )


@query(
    "SELECT c_custkey, upper(c_mktsegment) || ' ' || (c_custkey % 7)::VARCHAR AS name FROM customer", own=True
)
def normalize_municipality(t):
    prefix = F.element_at(F.array(F.lit("Grad "), F.lit("općina  "), F.lit("OPCINA "), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    raw = F.concat(prefix, F.col("c_mktsegment"), F.lit(" - "), (F.col("c_custkey") % 7).cast("string"))
    return t.raw("customer").select("c_custkey", names.normalize_municipality(raw).alias("name"))


@query("SELECT s_suppkey, upper('sisacko ' || s_name) AS name FROM supplier", own=True)
def normalize_county(t):
    raw = F.concat(F.lit(" sisačko "), F.col("s_name"), F.lit("  Županija"))
    return t.raw("supplier").select("s_suppkey", names.normalize_county(raw).alias("name"))


@query(
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN (1000 + event_id)::INT WHEN 3 THEN trunc(value)::INT ELSE 0 END AS n FROM events",
    own=True,
)
def parse_int(t):
    kind = F.col("event_id") % 5
    number = (F.col("event_id") + 1000).cast("string")
    raw = (
        F.when(kind == 0, "-")
        .when(kind == 1, " ")
        .when(kind == 2, F.concat(F.lit(" "), F.expr("left(cast(event_id + 1000 as string), length(cast(event_id + 1000 as string)) - 3)"), F.lit("."), F.expr("right(cast(event_id + 1000 as string), 3)")))
        .when(kind == 3, F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")))
        .otherwise(F.concat(number, F.lit(" x")))
    )
    return t.raw("events").select("event_id", names.parse_int(raw).alias("n"))


@query(
    "SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS code FROM customer",
    own=True,
)
def zfill(t):
    return t.raw("customer").select("c_custkey", names.zfill(F.col("c_custkey").cast("string"), 3).alias("code"))


@query("SELECT id, trim(split_part(split_part(name, chr(10), 1), ',', 1)) AS party FROM electoral_list")
def primary_party(t):
    return t.electoral_list.select("id", names.primary_party(F.col("name")).alias("party"))


@query("SELECT id, trim(split_part(name, ',', 1)) AS party FROM electoral_list")
def primary_party_comma(t):
    return t.electoral_list.select("id", names.primary_party_comma(F.col("name")).alias("party"))


@query("SELECT round_id, election, strftime(date, '%Y-%m-%d') AS date FROM rounds", _ROUNDS)
def election_label(t):
    return totals.with_label(totals.rounds(t)).select("round_id", "election", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("SELECT id, number || ' — ' || location AS label FROM polling_station")
def station_label(t):
    return t.polling_station.select("id", names.station_label(F.col("number"), F.col("location"), F.col("name")).alias("label"))


@query(
    "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'grad' WHEN 1 THEN 'općina' WHEN 2 THEN 'država' ELSE 'sažetak' END AS type FROM nation", own=True
)
def normalize_muni_type(t):
    raw = F.element_at(F.array(F.lit(" Grad"), F.lit("OPCINA"), F.lit("drzava "), F.lit("Sažetak")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return t.raw("nation").select("n_nationkey", names.normalize_municipality_type(raw).alias("type"))


@query(
    "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'I' ELSE '' END AS prefix FROM supplier", own=True
)
def station_prefix(t):
    kind = F.element_at(F.array(F.lit("_posebna"), F.lit("_inozemstvo"), F.lit("")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return t.raw("supplier").select("s_suppkey", names.station_prefix(F.concat(F.lit("02_01_rezultati"), kind, F.lit(".csv"))).alias("prefix"))


@query(
    "SELECT p_partkey, repeat('X', (p_size % 40) // 10) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_size % 10 + 1] AS numeral FROM part", own=True
)
def roman(t):
    return t.raw("part").select("p_partkey", names.roman(F.col("p_size") % 40).alias("numeral"))


@query(
    "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'local_mayor' WHEN 1 THEN 'local_deputy_mayor' WHEN 2 THEN 'local_county_assembly' END AS slug, "
    "CASE s_suppkey % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true END AS is_list FROM supplier",
    own=True,
)
def classify_sheet(t):
    raw = F.element_at(
        F.array(F.lit("Načelnik "), F.lit("ZAMJENIK NAČELNIKA iz reda"), F.lit("Županijska skupština"), F.lit("Upute")), (F.col("s_suppkey") % 4 + 1).cast("int")
    )
    return t.raw("supplier").select("s_suppkey", names.classify_sheet(raw).alias("c")).select("s_suppkey", "c.slug", "c.is_list")


@query(
    f"SELECT round_id, {_CATEGORY} AS category, CASE type_id WHEN 4 THEN 'vijece' WHEN 5 THEN 'vijece' WHEN 6 THEN 'nacelnik' WHEN 7 THEN 'nacelnik' "
    "WHEN 8 THEN 'zupan' WHEN 9 THEN 'zup_skupstina' END AS kind FROM rounds",
    _ROUNDS,
)
def category_of_type(t):
    from plebis import schema

    kinds = F.create_map(*[F.lit(x) for pair in schema.KIND_OF_TYPE.items() for x in pair])
    return (
        totals.rounds(t)
        .join(F.broadcast(schema.category_dimension(t.spark)), "type_name")
        .select("round_id", "category", F.try_element_at(kinds, F.col("type_name")).alias("kind"))
    )
