"""Ranks, thresholds, seats and their holders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plebis import schema
from plebis.operators import apportion, rank, totals
from plebis.operators.scope import scope_stations
from plebis.plans.catalog import query
from plebis.plans.table_queries import _ROUNDS

_LISTS = f"""{_ROUNDS},
lt AS (
  SELECT l.id AS electoral_list_id, l.election_round_id, l.district_id, l.name, sum(r.votes)::BIGINT AS votes
  FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id GROUP BY ALL),
pl0 AS (
  SELECT lt.*, x.year, d.number, d.name AS district,
         CASE d.number WHEN 11 THEN 3 WHEN 12 THEN 8 WHEN 121 THEN 3 WHEN 122 THEN 1 WHEN 123 THEN 1 WHEN 124 THEN 1 WHEN 125 THEN 1 WHEN 126 THEN 1 ELSE 14 END AS n_seats,
         (sum(votes) OVER (PARTITION BY election_round_id, district_id))::BIGINT AS total_votes
  FROM lt JOIN rounds x ON x.round_id = lt.election_round_id JOIN electoral_district d ON d.id = lt.district_id WHERE x.type_id = 2),
pl AS (SELECT *, n_seats <> 14 OR votes >= total_votes * 0.05::DOUBLE AS eligible FROM pl0),
pq AS (SELECT *, votes / divisor AS quotient FROM (SELECT *, unnest(generate_series(1, n_seats)) AS divisor FROM pl WHERE eligible)),
pw AS (
  SELECT district_id, electoral_list_id, count(*)::BIGINT AS seats FROM (
    SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY quotient DESC, votes DESC, electoral_list_id) AS nth FROM pq) WHERE nth <= n_seats GROUP BY ALL),
ps AS (SELECT pl.*, coalesce(pw.seats, 0)::BIGINT AS seats,
         CASE WHEN number BETWEEN 121 AND 126 THEN 'NACIONALNE MANJINE' ELSE trim(split_part(name, ',', 1)) END AS party
       FROM pl LEFT JOIN pw USING (district_id, electoral_list_id)),
pv AS (SELECT c.*, coalesce(v.votes, 0)::BIGINT AS personal_votes FROM candidacy c
       LEFT JOIN (SELECT candidacy_id, sum(votes) AS votes FROM candidate_result GROUP BY ALL) v ON v.candidacy_id = c.id),
chosen AS (
  SELECT * FROM (SELECT pv.*, seats, votes AS list_votes, personal_votes >= votes * 10.0::DOUBLE / 100.0::DOUBLE AS promoted,
      row_number() OVER (PARTITION BY electoral_list_id ORDER BY (personal_votes >= votes * 10.0::DOUBLE / 100.0::DOUBLE) DESC,
        CASE WHEN personal_votes >= votes * 10.0::DOUBLE / 100.0::DOUBLE THEN personal_votes END DESC NULLS LAST, position_on_list ASC NULLS FIRST, pv.id) AS nth
    FROM pv JOIN (SELECT electoral_list_id, seats, votes FROM ps WHERE seats > 0) USING (electoral_list_id)) WHERE nth <= seats)"""

_EUROPE = """,
el0 AS (SELECT lt.*, x.year, CASE x.year WHEN 2014 THEN 11 ELSE 12 END AS n_seats, (sum(votes) OVER (PARTITION BY election_round_id))::BIGINT AS total_votes
        FROM lt JOIN rounds x ON x.round_id = lt.election_round_id WHERE x.type_id = 3),
el AS (SELECT *, votes >= total_votes * 0.05::DOUBLE AS eligible FROM el0),
ew AS (
  SELECT electoral_list_id, count(*)::BIGINT AS seats FROM (
    SELECT *, row_number() OVER (PARTITION BY election_round_id ORDER BY quotient DESC, votes DESC, electoral_list_id) AS nth FROM (
      SELECT *, votes / divisor AS quotient FROM (SELECT *, unnest(generate_series(1, n_seats)) AS divisor FROM el WHERE eligible))) WHERE nth <= n_seats GROUP BY ALL),
es AS (SELECT el.*, coalesce(ew.seats, 0)::BIGINT AS seats FROM el LEFT JOIN ew USING (electoral_list_id))"""

_RANKS = """,
home AS (SELECT r.electoral_list_id, min(p.municipality_id)::BIGINT AS municipality_id FROM list_result r JOIN polling_station p ON p.id = r.polling_station_id GROUP BY ALL),
home2 AS (SELECT h.*, m.county_id FROM home h JOIN municipality m ON m.id = h.municipality_id),
ranked AS (
  SELECT candidacy_id, scope, own, (row_number() OVER w)::BIGINT AS rank, (count(*) OVER (PARTITION BY scope, election_round_id, place))::BIGINT AS field FROM (
    SELECT pv.id AS candidacy_id, 'district' AS scope, l.election_round_id, l.district_id AS place, personal_votes AS votes, true AS own
    FROM pv JOIN electoral_list l ON l.id = pv.electoral_list_id JOIN rounds x ON x.round_id = l.election_round_id WHERE x.type_id = 1
    UNION ALL
    SELECT c.id, CASE WHEN x.type_id = 8 THEN 'county' ELSE 'muni' END, l.election_round_id,
           CASE WHEN x.type_id = 8 THEN m.county_id ELSE p.municipality_id END, sum(r.votes)::BIGINT,
           any_value(CASE WHEN x.type_id = 8 THEN h.county_id ELSE h.municipality_id END) = CASE WHEN x.type_id = 8 THEN m.county_id ELSE p.municipality_id END
    FROM candidate_result r JOIN candidacy c ON c.id = r.candidacy_id JOIN electoral_list l ON l.id = c.electoral_list_id
    JOIN rounds x ON x.round_id = l.election_round_id JOIN polling_station p ON p.id = r.polling_station_id JOIN municipality m ON m.id = p.municipality_id
    JOIN home2 h ON h.electoral_list_id = l.id WHERE x.type_id IN (6, 7, 8)
    GROUP BY c.id, x.type_id, l.election_round_id, CASE WHEN x.type_id = 8 THEN m.county_id ELSE p.municipality_id END)
  WINDOW w AS (PARTITION BY scope, election_round_id, place ORDER BY votes DESC, candidacy_id))"""


def _parliament(t):
    return apportion.parliament_seats(apportion.parliament_lists(t))


@query("SELECT candidacy_id, scope, rank, field FROM ranked WHERE own", _LISTS + _RANKS)
def rank_in_scope(t):
    return rank.ranks(t)


@query("SELECT electoral_list_id, votes, total_votes, eligible FROM pl", _LISTS)
def threshold_filter(t):
    return apportion.parliament_lists(t).select("electoral_list_id", "votes", "total_votes", "eligible")


@query("SELECT electoral_list_id, divisor::INT AS divisor, quotient FROM pq", _LISTS)
def dhondt_quotients(t):
    return apportion.quotients(apportion.parliament_lists(t).where("eligible")).select("electoral_list_id", "divisor", "quotient")


@query("SELECT district_id, electoral_list_id, seats FROM pw", _LISTS)
def dhondt_district(t):
    return apportion.highest_averages(apportion.parliament_lists(t).where("eligible"), ["district_id"])


@query("SELECT district_id, electoral_list_id, seats FROM pw", _LISTS)
def dhondt_by_divisor(t):
    """The same seats by a search for each district's divisor."""
    return apportion.by_divisor(apportion.parliament_lists(t).where("eligible"), ["district_id"])


@query("SELECT id AS candidacy_id, electoral_list_id, personal_votes, promoted, nth::BIGINT AS chosen FROM chosen", _LISTS)
def preferential_seats(t):
    return apportion.preferential(t, _parliament(t)).select("candidacy_id", "electoral_list_id", "personal_votes", "promoted", "chosen")


@query("SELECT year, party, sum(seats)::BIGINT AS seats FROM ps WHERE seats > 0 GROUP BY ALL", _LISTS, name="seats_by_party")
@query("SELECT year, party, sum(seats)::BIGINT AS seats FROM ps WHERE seats > 0 GROUP BY ALL ORDER BY ALL", _LISTS)
def sabor_seats(t):
    return apportion.parties(_parliament(t)).orderBy("year", F.desc("seats"), "party")


@query("SELECT year, district, n_seats, name, votes, seats FROM ps", _LISTS)
def sabor_district_detail(t):
    return _parliament(t).select("year", "district", "n_seats", "name", "votes", "seats")


@query(
    "SELECT s.year, s.district, s.party, coalesce(p.first_name || ' ' || p.last_name, s.party) AS name, s.chosen, k.party_rank, "
    "row_number() OVER (PARTITION BY s.year ORDER BY k.party_rank, s.district, s.electoral_list_id, s.chosen) AS place FROM "
    "(SELECT year, district, party, electoral_list_id, unnest(generate_series(1, seats)) AS chosen FROM ps WHERE seats > 0) s "
    "LEFT JOIN chosen c ON c.electoral_list_id = s.electoral_list_id AND c.nth = s.chosen LEFT JOIN person p ON p.id = c.person_id "
    "JOIN (SELECT year, party, row_number() OVER (PARTITION BY year ORDER BY seats DESC, party) AS party_rank FROM "
    "(SELECT year, party, sum(seats) AS seats FROM ps WHERE seats > 0 GROUP BY ALL)) k ON k.year = s.year AND k.party = s.party",
    _LISTS,
)
def seat_holders(t):
    return apportion.seat_holders(t, _parliament(t)).select("year", "district", "party", "name", "chosen", "party_rank", "place")


@query("SELECT year, id AS candidacy_id FROM chosen JOIN (SELECT electoral_list_id, year FROM ps) USING (electoral_list_id)", _LISTS)
def seat_winners(t):
    seated = _parliament(t)
    return apportion.preferential(t, seated).join(seated.select("electoral_list_id", "year"), "electoral_list_id").select("year", "candidacy_id")


_BY_NAME = """,
bn AS (SELECT year, district_id, district, number, n_seats, name, sum(votes)::BIGINT AS votes FROM pl GROUP BY ALL),
bw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY votes DESC, name) AS place FROM bn WHERE number BETWEEN 121 AND 126) WHERE place <= n_seats)"""


@query("SELECT year, district, name, votes, place::BIGINT AS place FROM bw", _LISTS + _BY_NAME)
def minority_winners(t):
    lists = apportion.parliament_lists(t).where(apportion.is_minority(F.col("number")))
    by_name = lists.groupBy("year", "district_id", "district", "n_seats", "name").agg(F.sum("votes").alias("votes"))
    return apportion.first_lists(by_name, ["district_id"]).select("year", "district", "name", "votes", "place")


@query(
    "SELECT year, district, n_seats AS seats, (sum(votes) OVER (PARTITION BY district_id))::BIGINT AS total_votes, name, votes, trim(split_part(name, ',', 1)) AS party, "
    "NULL::INT AS fixed_seats FROM bn WHERE number NOT BETWEEN 121 AND 126 UNION ALL "
    "SELECT bw.year, 'XII. IZBORNA JEDINICA - NACIONALNE MANJINE', 8, s.total::BIGINT, name, votes, 'NACIONALNE MANJINE', 1 FROM bw "
    "JOIN (SELECT year, sum(votes) AS total FROM bn WHERE number BETWEEN 121 AND 126 GROUP BY ALL) s ON s.year = bw.year",
    _LISTS + _BY_NAME,
)
def sabor_raw(t):
    return apportion.raw_parliament(t)


@query(
    "SELECT year, trim(split_part(split_part(name, chr(10), 1), ',', 1)) AS party, sum(votes)::BIGINT AS votes, round(sum(votes / total_votes * 100.0::DOUBLE), 9) AS votes_pct, "
    "sum(seats)::BIGINT AS seats, bool_or(eligible) AS eligible, max(round_even(total_votes * 5.0::DOUBLE / 100.0::DOUBLE, 0))::BIGINT AS threshold_votes, "
    "row_number() OVER (PARTITION BY year ORDER BY sum(seats) DESC, sum(votes) DESC, trim(split_part(split_part(name, chr(10), 1), ',', 1))) AS place FROM es GROUP BY year, trim(split_part(split_part(name, chr(10), 1), ',', 1))",
    _LISTS + _EUROPE,
)
def eu_seats(t):
    return apportion.europe_parties(apportion.europe_lists(t)).withColumn("votes_pct", F.round("votes_pct", 9))


_COUNTY_LISTS = _LISTS.replace(
    "FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id GROUP BY ALL),\npl0",
    "FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id WHERE r.polling_station_id IN "
    "(SELECT p.id FROM polling_station p JOIN municipality m ON m.id = p.municipality_id WHERE m.county_id = 2) GROUP BY ALL),\npl0",
)


@query(
    "SELECT year, name, votes, total_votes, round_even(total_votes * 5.0::DOUBLE / 100.0::DOUBLE, 0)::BIGINT AS threshold_votes, eligible, seats FROM es",
    _COUNTY_LISTS + _EUROPE,
)
def eu_scope_seats(t):
    """Seats as the votes of one county would give them."""
    return apportion.europe_lists(t, scope_stations(t, county=2)).select("year", "name", "votes", "total_votes", "threshold_votes", "eligible", "seats")


@query(
    "SELECT es.year, pv.id AS candidacy_id, p.first_name || ' ' || p.last_name AS name, trim(split_part(split_part(l.name, chr(10), 1), ',', 1)) AS party, l.name AS list_name, "
    "pv.position_on_list, pv.personal_votes, CASE WHEN es.total_votes > 0 THEN pv.personal_votes / es.total_votes * 100.0::DOUBLE ELSE 0 END AS personal_pct, "
    "coalesce(w.won, false) AS is_winner, row_number() OVER (PARTITION BY es.year ORDER BY pv.personal_votes DESC, pv.id) AS place FROM pv JOIN electoral_list l ON l.id = pv.electoral_list_id JOIN person p ON p.id = pv.person_id "
    "JOIN (SELECT election_round_id, year, max(total_votes) AS total_votes FROM es GROUP BY ALL) es ON es.election_round_id = l.election_round_id "
    "LEFT JOIN (SELECT id, true AS won FROM (SELECT pv.id, es.seats, row_number() OVER (PARTITION BY electoral_list_id ORDER BY (personal_votes >= es.votes * 10.0::DOUBLE / 100.0::DOUBLE) DESC, "
    "CASE WHEN personal_votes >= es.votes * 10.0::DOUBLE / 100.0::DOUBLE THEN personal_votes END DESC NULLS LAST, position_on_list, pv.id) AS nth "
    "FROM pv JOIN es USING (electoral_list_id) WHERE es.seats > 0) WHERE nth <= seats) w ON w.id = pv.id",
    _LISTS + _EUROPE,
)
def eu_candidates(t):
    return apportion.europe_candidates(t, apportion.europe_lists(t))


@query(
    "SELECT id AS candidacy_id FROM chosen UNION SELECT id FROM (SELECT pv.id, row_number() OVER (PARTITION BY l.election_round_id ORDER BY personal_votes DESC, pv.id) AS nth "
    "FROM pv JOIN electoral_list l ON l.id = pv.electoral_list_id JOIN rounds x ON x.round_id = l.election_round_id WHERE x.type_id = 1) WHERE nth = 1",
    _LISTS,
)
def winner_union(t):
    """Who won a seat in parliament, or came first of a presidential round."""
    seats = apportion.preferential(t, _parliament(t)).select("candidacy_id")
    president = totals.rounds(t, [schema.PRESIDENT]).select(F.col("round_id").alias("election_round_id"))
    lists = t.electoral_list.join(F.broadcast(president), "election_round_id", "left_semi").select(F.col("id").alias("electoral_list_id"), "election_round_id")
    people = totals.personal_votes(t).join(lists, "electoral_list_id")
    first = totals.top(people, 1, ["election_round_id"], [F.desc("votes"), F.col("candidacy_id")]).select("candidacy_id")
    return seats.unionByName(first).distinct()


@query(
    "SELECT election_round_id, name, votes, (row_number() OVER (PARTITION BY election_round_id ORDER BY votes DESC, name))::BIGINT AS place FROM "
    "(SELECT l.election_round_id, l.name, sum(r.votes)::BIGINT AS votes FROM list_result r JOIN electoral_list l ON l.id = r.electoral_list_id GROUP BY ALL) "
    "QUALIFY row_number() OVER (PARTITION BY election_round_id ORDER BY votes DESC, name) <= 5"
)
def top5_lists(t):
    from plebis.operators import profiles

    return profiles.top_lists(t)


@query(
    "SELECT election_round_id, name, list_name, votes, (row_number() OVER (PARTITION BY election_round_id ORDER BY votes DESC, name, list_name))::BIGINT AS place FROM "
    "(SELECT l.election_round_id, p.first_name || ' ' || p.last_name AS name, l.name AS list_name, sum(r.votes)::BIGINT AS votes FROM candidate_result r "
    "JOIN candidacy c ON c.id = r.candidacy_id JOIN person p ON p.id = c.person_id JOIN electoral_list l ON l.id = c.electoral_list_id GROUP BY ALL) "
    "QUALIFY row_number() OVER (PARTITION BY election_round_id ORDER BY votes DESC, name, list_name) <= 5"
)
def top5_candidates(t):
    from plebis.operators import profiles

    return profiles.top_candidates(t).select("election_round_id", "name", "list_name", "votes", "place")


@query(
    "SELECT election_type_id, max(year)::INT AS year FROM election GROUP BY ALL"
)
def latest_election(t):
    order = Window.partitionBy("election_type_id").orderBy(F.desc("year"), "id")
    return t.election.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("election_type_id", "year")


@query(
    "SELECT id, (row_number() OVER (ORDER BY d DESC NULLS LAST, id))::BIGINT AS place FROM (SELECT id, CASE WHEN year % 2 = 0 THEN date END AS d FROM election)"
)
def order_nulls_last(t):
    dated = t.election.select("id", F.when(F.col("year") % 2 == 0, F.col("date")).alias("d"))
    return dated.select("id", F.row_number().over(Window.orderBy(F.col("d").desc_nulls_last(), "id")).cast("long").alias("place"))
