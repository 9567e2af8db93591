"""Shares, histories, profiles, national and local results, turnout."""

from __future__ import annotations

from pyspark.sql import functions as F

from plebis.operators import kept, profiles, totals, turnout
from plebis.operators.scope import scope_stations
from plebis.plans.catalog import query
from plebis.plans.fixtures import new_folder
from plebis.plans.seat_queries import _LISTS, _RANKS
from plebis.plans.table_queries import _CATEGORY, _ROUNDS, bridge
from plebis.sources.store import Store

_SHARES = """,
den AS (SELECT r.electoral_list_id, sum(x.valid_ballots)::BIGINT AS valid_ballots FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id
        JOIN turnout x ON x.election_round_id = l.election_round_id AND x.polling_station_id = r.polling_station_id GROUP BY ALL),
shares AS (SELECT pv.id AS candidacy_id, pv.person_id, pv.electoral_list_id, pv.position_on_list, personal_votes AS candidate_votes, coalesce(lt.votes, 0)::BIGINT AS list_votes,
             coalesce(den.valid_ballots, 0)::BIGINT AS valid_ballots,
             CASE WHEN den.valid_ballots > 0 THEN personal_votes / den.valid_ballots * 100.0::DOUBLE ELSE 0.0 END AS share
           FROM pv LEFT JOIN lt ON lt.electoral_list_id = pv.electoral_list_id LEFT JOIN den ON den.electoral_list_id = pv.electoral_list_id)"""


@query("SELECT candidacy_id, candidate_votes, list_votes, valid_ballots, share, round_even(share, 1) AS vote_share FROM shares", _LISTS + _SHARES)
def vote_share(t):
    return profiles.vote_shares(t).select("candidacy_id", "candidate_votes", "list_votes", "valid_ballots", "share", "vote_share")


@query(
    "SELECT election_round_id, polling_station_id, CASE WHEN registered_voters > 0 THEN ballots_cast / registered_voters * 100.0::DOUBLE ELSE 0.0 END AS turnout_pct FROM turnout"
)
def turnout_pct(t):
    return t.turnout.select(
        "election_round_id", "polling_station_id", totals.percent(F.col("ballots_cast"), F.col("registered_voters")).alias("turnout_pct")
    )


_PERSON_HISTORY = (
    "SELECT s.person_id, s.candidacy_id, x.election, x.type_name AS election_type, x.year, strftime(x.date, '%Y-%m-%d') AS date, x.round_number AS round, l.name AS list_name, "
    "s.position_on_list AS position, d.name AS district, s.candidate_votes, s.list_votes, s.valid_ballots AS total_valid_ballots, k.rank, k.field AS total_candidates_in_round, "
    "c.id IS NOT NULL AS won_seat, CASE x.type_id WHEN 4 THEN 'vijece' WHEN 5 THEN 'vijece' WHEN 6 THEN 'nacelnik' WHEN 7 THEN 'nacelnik' WHEN 8 THEN 'zupan' WHEN 9 THEN 'zup_skupstina' END AS lokalni_kind, "
    "CASE WHEN x.type_id > 3 THEN h.county_id END AS county_id, CASE WHEN x.type_id > 3 THEN h.municipality_id END AS municipality_id, round_even(s.share, 1) AS vote_share, "
    "x.type_id = 3 AND s.person_id % 3 = 0 AS eu_mep, CASE WHEN x.type_id = 3 AND s.person_id % 3 = 0 THEN 'G' || (s.candidacy_id % 4)::VARCHAR END AS eu_group, "
    "row_number() OVER (PARTITION BY s.person_id ORDER BY x.year DESC, x.date DESC NULLS LAST, x.round_number DESC, s.candidacy_id) AS nth FROM shares s JOIN electoral_list l ON l.id = s.electoral_list_id JOIN rounds x ON x.round_id = l.election_round_id LEFT JOIN electoral_district d ON d.id = l.district_id "
    "LEFT JOIN home2 h ON h.electoral_list_id = l.id LEFT JOIN (SELECT * FROM ranked WHERE own) k ON k.candidacy_id = s.candidacy_id LEFT JOIN chosen c ON c.id = s.candidacy_id"
)


@query(_PERSON_HISTORY, _LISTS + _SHARES + _RANKS)
def person_history(t):
    """Every third person sat in the European Parliament."""
    members = t.candidacy.where("person_id % 3 = 0").select(F.col("id").alias("candidacy_id"), F.concat(F.lit("G"), (F.col("id") % 4).cast("string")).alias("group"))
    return profiles.person_history(t, mandates=members)


@query(_PERSON_HISTORY, _LISTS + _SHARES + _RANKS)
def person_history_kept(t):
    """The same from sums by municipality that are kept on disk."""
    return person_history(kept.build(t.written(), Store(t.spark, new_folder(t.spark, "kept"))))


_HISTORY = (
    "SELECT l.id AS electoral_list_id, x.election, x.type_name AS election_type, x.year, strftime(x.date, '%Y-%m-%d') AS date, x.round_number AS round, l.name AS list_name, d.name AS district, "
    "coalesce(lt.votes, 0)::BIGINT AS total_votes FROM electoral_list l JOIN rounds x ON x.round_id = l.election_round_id LEFT JOIN electoral_district d ON d.id = l.district_id "
    "LEFT JOIN lt ON lt.electoral_list_id = l.id WHERE "
)


@query(_HISTORY + "trim(split_part(split_part(l.name, chr(10), 1), ',', 1)) = 'LISTA 13'", _LISTS)
def party_history(t):
    return profiles.party_history(t, "LISTA 13")


@query(_HISTORY + "l.id % 25 = 7", _LISTS)
def party_history_by_id(t):
    return profiles.party_history_by_id(t, bridge(t), 7)


def _profile_sql(scope: str) -> str:
    return (
        f"SELECT z.election_round_id, z.election, z.year, z.registered_voters, z.ballots_cast, z.valid_ballots, z.invalid_ballots, a.top_lists, b.top_candidates FROM "
        "(SELECT x.election_round_id, r.election, r.year, sum(x.registered_voters)::BIGINT AS registered_voters, sum(x.ballots_cast)::BIGINT AS ballots_cast, "
        f"sum(x.valid_ballots)::BIGINT AS valid_ballots, sum(x.invalid_ballots)::BIGINT AS invalid_ballots FROM turnout x JOIN rounds r ON r.round_id = x.election_round_id WHERE x.polling_station_id IN ({scope}) GROUP BY ALL) z "
        "LEFT JOIN (SELECT election_round_id, string_agg(name || '=' || votes::VARCHAR, ';' ORDER BY place) AS top_lists FROM "
        "(SELECT *, row_number() OVER (PARTITION BY election_round_id ORDER BY votes DESC, name) AS place FROM (SELECT l.election_round_id, l.name, sum(r.votes)::BIGINT AS votes FROM list_result r "
        f"JOIN electoral_list l ON l.id = r.electoral_list_id WHERE r.polling_station_id IN ({scope}) GROUP BY ALL)) WHERE place <= 5 GROUP BY ALL) a ON a.election_round_id = z.election_round_id "
        "LEFT JOIN (SELECT election_round_id, string_agg(name || '=' || votes::VARCHAR, ';' ORDER BY place) AS top_candidates FROM "
        "(SELECT *, row_number() OVER (PARTITION BY election_round_id ORDER BY votes DESC, name, list_name) AS place FROM (SELECT l.election_round_id, p.first_name || ' ' || p.last_name AS name, l.name AS list_name, "
        "sum(r.votes)::BIGINT AS votes FROM candidate_result r JOIN candidacy c ON c.id = r.candidacy_id JOIN person p ON p.id = c.person_id JOIN electoral_list l ON l.id = c.electoral_list_id "
        f"WHERE r.polling_station_id IN ({scope}) GROUP BY ALL)) WHERE place <= 5 GROUP BY ALL) b ON b.election_round_id = z.election_round_id"
    )


def _flat(profile):
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["name"], F.lit("="), s["votes"].cast("string"))), ";")
    return profile.select(
        "election_round_id", "election", "year", *totals.MEASURES, written("top_lists").alias("top_lists"), written("top_candidates").alias("top_candidates")
    )


@query(
    _profile_sql("SELECT b.id FROM polling_station a JOIN polling_station b ON a.location IS NOT DISTINCT FROM b.location AND a.address IS NOT DISTINCT FROM b.address WHERE a.id = 7"),
    _ROUNDS,
)
def station_profile(t):
    return _flat(profiles.station_profile(t, 7))


@query(_profile_sql("SELECT p.id FROM polling_station p JOIN municipality m ON m.id = p.municipality_id WHERE m.county_id = 2"), _ROUNDS)
def location_profile(t):
    return _flat(profiles.location_profile(t, county=2))


@query(
    "SELECT x.round_id, x.election, x.type_name AS election_type, x.year, strftime(x.date, '%Y-%m-%d') AS date, x.round_number AS round, coalesce(sum(z.registered_voters), 0)::BIGINT AS registered_voters, "
    "coalesce(sum(z.ballots_cast), 0)::BIGINT AS ballots_cast, coalesce(sum(z.valid_ballots), 0)::BIGINT AS valid_ballots, coalesce(sum(z.invalid_ballots), 0)::BIGINT AS invalid_ballots "
    "FROM rounds x LEFT JOIN turnout z ON z.election_round_id = x.round_id WHERE x.type_id > 3 GROUP BY ALL",
    _ROUNDS,
)
def national_turnout(t):
    return profiles.national_turnout(t, "lokalni")


@query(
    "SELECT l.election_round_id, l.name, sum(r.votes)::BIGINT AS votes FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id "
    "JOIN rounds x ON x.round_id = l.election_round_id WHERE x.type_id = 2 GROUP BY ALL",
    _ROUNDS,
)
def national_lists(t):
    return profiles.national_lists(t, "sabor")


@query(
    "SELECT l.election_round_id, p.first_name, p.last_name, l.name AS list_name, sum(r.votes)::BIGINT AS votes FROM candidate_result r JOIN candidacy c ON c.id = r.candidacy_id "
    "JOIN person p ON p.id = c.person_id JOIN electoral_list l ON l.id = c.electoral_list_id JOIN rounds x ON x.round_id = l.election_round_id WHERE x.type_id = 1 GROUP BY ALL",
    _ROUNDS,
)
def national_candidates(t):
    return profiles.national_candidates(t, "predsjednicki")


_LOCAL = "r0 AS (SELECT r.id AS round_id FROM election_round r JOIN election e ON e.id = r.election_id WHERE e.election_type_id = {type} AND r.round_number = 1 AND e.year = (SELECT max(year) FROM election WHERE election_type_id = {type}))"


@query(
    "SELECT electoral_list_id, name, votes, (sum(votes) OVER ())::BIGINT AS total_votes, CASE WHEN sum(votes) OVER () > 0 THEN votes / sum(votes) OVER () * 100.0::DOUBLE ELSE 0.0 END AS votes_pct FROM "
    "(SELECT l.id AS electoral_list_id, l.name, coalesce(sum(r.votes), 0)::BIGINT AS votes FROM electoral_list l LEFT JOIN list_result r ON r.electoral_list_id = l.id AND r.polling_station_id IN "
    "(SELECT id FROM polling_station WHERE municipality_id = 4) WHERE l.election_round_id IN (SELECT round_id FROM r0) GROUP BY ALL)",
    _LOCAL.format(type=4),
)
def local_results(t):
    return profiles.local_results(t, profiles.local_round(t, "vijece", "grad"), scope_stations(t, municipality=4))


@query(
    "SELECT p.id, p.number, p.name, p.location, p.address, coalesce(x.registered_voters, 0)::BIGINT AS registered_voters, coalesce(x.ballots_cast, 0)::BIGINT AS ballots_cast, "
    "coalesce(x.valid_ballots, 0)::BIGINT AS valid_ballots, coalesce(x.invalid_ballots, 0)::BIGINT AS invalid_ballots, "
    "CASE WHEN x.registered_voters > 0 THEN x.ballots_cast / x.registered_voters * 100.0::DOUBLE ELSE 0.0 END AS turnout_pct "
    "FROM polling_station p JOIN municipality m ON m.id = p.municipality_id LEFT JOIN turnout x ON x.polling_station_id = p.id AND x.election_round_id IN (SELECT round_id FROM r0) WHERE m.county_id = 1",
    _LOCAL.format(type=8),
)
def stations_breakdown(t):
    return profiles.stations_breakdown(t, profiles.local_round(t, "zupan"), county=1)


_GROUPS = (
    _ROUNDS
    + f", gr AS (SELECT *, {_CATEGORY} AS category FROM rounds WHERE type_id <= 3 OR (round_number = 1 AND type_id IN (4, 5)) OR (round_number = 2 AND type_id IN (6, 7))), "
    "g AS (SELECT category || '-' || year::VARCHAR || '-' || round_number::VARCHAR AS group_id, * FROM gr)"
)


@query(
    "SELECT group_id AS id, category, CASE category WHEN 'predsjednicki' THEN 'Predsjednički' WHEN 'sabor' THEN 'Sabor' WHEN 'eu' THEN 'EU parlament' ELSE 'Lokalni' END AS category_label, year, round_number, "
    "string_agg(round_id::VARCHAR, ',' ORDER BY round_id) AS round_ids, strftime(min(date), '%Y-%m-%d') AS date, "
    "CASE category WHEN 'predsjednicki' THEN 'Predsjednički' WHEN 'sabor' THEN 'Sabor' WHEN 'eu' THEN 'EU parlament' ELSE 'Lokalni' END || ' ' || year::VARCHAR || "
    "CASE WHEN round_number > 1 THEN ' — ' || round_number::VARCHAR || '. krug' ELSE '' END AS label FROM g GROUP BY ALL",
    _GROUPS,
)
def election_groups(t):
    return turnout.election_groups(t).withColumn("round_ids", F.array_join(F.col("round_ids").cast("array<string>"), ","))


_M = "sum(registered_voters)::BIGINT AS registered_voters, sum(ballots_cast)::BIGINT AS ballots_cast, sum(valid_ballots)::BIGINT AS valid_ballots, sum(invalid_ballots)::BIGINT AS invalid_ballots"


@query(f"SELECT group_id, 'hr' AS id, 'Hrvatska' AS name, {_M} FROM turnout JOIN g ON g.round_id = election_round_id GROUP BY ALL", _GROUPS)
def turnout_national(t):
    return turnout.turnout_at(t, "national")


_PLACED = "FROM turnout x JOIN g ON g.round_id = x.election_round_id JOIN polling_station p ON p.id = x.polling_station_id JOIN municipality m ON m.id = p.municipality_id JOIN county c ON c.id = m.county_id"


@query(f"SELECT group_id, c.id, c.name, {_M} {_PLACED} GROUP BY ALL", _GROUPS)
def turnout_county(t):
    return turnout.turnout_at(t, "county")


@query(f"SELECT group_id, m.id, m.name, {_M} {_PLACED} WHERE c.id = 2 GROUP BY ALL", _GROUPS)
def turnout_municipality(t):
    return turnout.turnout_at(t, "municipality", parent=2)


@query(
    f"SELECT group_id, 'national' AS level, 'hr' AS id, 'Hrvatska' AS name, {_M} FROM turnout JOIN g ON g.round_id = election_round_id GROUP BY ALL "
    f"UNION ALL SELECT group_id, 'county', c.id::VARCHAR, c.name, {_M} {_PLACED} GROUP BY ALL UNION ALL SELECT group_id, 'municipality', m.id::VARCHAR, m.name, {_M} {_PLACED} GROUP BY ALL "
    f"UNION ALL SELECT group_id, 'station', p.id::VARCHAR, p.number || ' — ' || p.location, {_M} {_PLACED} GROUP BY ALL",
    _GROUPS,
)
def turnout_levels(t):
    """All levels from one scan of the facts."""
    return turnout.turnout_levels(t)


@query(f"SELECT group_id, p.id, p.number || ' — ' || p.location AS name, p.address, {_M} {_PLACED} WHERE p.id IN (3, 7, 11, 19) GROUP BY ALL", _GROUPS)
def turnout_listed_stations(t):
    """Stations given as the text of a list."""
    return turnout.turnout_at(t, "station", stations="3, 7,11,,19")


@query(f"SELECT group_id, p.id, p.number || ' — ' || p.location AS name, p.address, {_M} {_PLACED} GROUP BY ALL", _GROUPS)
def turnout_station(t):
    return turnout.turnout_at(t, "station")


@query(
    """SELECT z.election_round_id, '{"election":' || to_json(z.election)::VARCHAR || ',"year":' || z.year::VARCHAR || ',"registered_voters":' || registered_voters::VARCHAR || ',"ballots_cast":' || ballots_cast::VARCHAR
       || ',"valid_ballots":' || valid_ballots::VARCHAR || ',"invalid_ballots":' || invalid_ballots::VARCHAR || ',"top_lists":[' || a.top_lists || '],"top_candidates":[' || b.top_candidates || ']}' AS payload FROM
       (SELECT x.election_round_id, r.election, r.year, sum(x.registered_voters)::BIGINT AS registered_voters, sum(x.ballots_cast)::BIGINT AS ballots_cast, sum(x.valid_ballots)::BIGINT AS valid_ballots,
        sum(x.invalid_ballots)::BIGINT AS invalid_ballots FROM turnout x JOIN rounds r ON r.round_id = x.election_round_id WHERE x.polling_station_id IN (SELECT station FROM inside) GROUP BY ALL) z
       JOIN (SELECT election_round_id, string_agg('{"place":' || place::VARCHAR || ',"name":' || to_json(name)::VARCHAR || ',"votes":' || votes::VARCHAR || '}', ',' ORDER BY place) AS top_lists FROM
        (SELECT *, row_number() OVER (PARTITION BY election_round_id ORDER BY votes DESC, name) AS place FROM (SELECT l.election_round_id, l.name, sum(r.votes)::BIGINT AS votes FROM list_result r
         JOIN electoral_list l ON l.id = r.electoral_list_id WHERE r.polling_station_id IN (SELECT station FROM inside) GROUP BY ALL)) WHERE place <= 5 GROUP BY ALL) a ON a.election_round_id = z.election_round_id
       JOIN (SELECT election_round_id, string_agg('{"place":' || place::VARCHAR || ',"name":' || to_json(name)::VARCHAR || ',"votes":' || votes::VARCHAR || ',"list_name":' || to_json(list_name)::VARCHAR || '}', ',' ORDER BY place) AS top_candidates FROM
        (SELECT *, row_number() OVER (PARTITION BY election_round_id ORDER BY votes DESC, name, list_name) AS place FROM (SELECT l.election_round_id, p.first_name || ' ' || p.last_name AS name, l.name AS list_name,
         sum(r.votes)::BIGINT AS votes FROM candidate_result r JOIN candidacy c ON c.id = r.candidacy_id JOIN person p ON p.id = c.person_id JOIN electoral_list l ON l.id = c.electoral_list_id
         WHERE r.polling_station_id IN (SELECT station FROM inside) GROUP BY ALL)) WHERE place <= 5 GROUP BY ALL) b ON b.election_round_id = z.election_round_id""",
    _ROUNDS + ", inside AS (SELECT p.id AS station FROM polling_station p JOIN municipality m ON m.id = p.municipality_id WHERE m.county_id = 2)",
)
def json_payload(t):
    """A profile as the nested text that an interface would send."""
    return profiles.location_profile(t, county=2).select("election_round_id", F.to_json(F.struct("election", "year", *totals.MEASURES, "top_lists", "top_candidates")).alias("payload"))
