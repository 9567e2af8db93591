"""Scans and melts of result sheets, written from the tables and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plebis.functions.names import parse_int
from plebis.operators import totals
from plebis.plans.catalog import query
from plebis.plans.fixtures import FIRST_NAMES, LAST_NAMES, new_folder
from plebis.sources import cells, literals, melt, sheets

BRANDS, PLACES = 25, 14
#: Rows of a written file or workbook, as a task parses one whole.
ROWS_A_FILE = 20_000


def _written(df: DataFrame) -> str:
    folder = new_folder(df.sparkSession, "sheets")
    df.write.option("header", True).option("sep", ";").option("emptyValue", "").csv(folder)
    return folder


def _stations(t) -> DataFrame:
    return t.polling_station.select("id", "number", "name", "location", F.concat("address", F.lit("\nbb")).alias("address"))


@query("SELECT id, number, name, location, address || chr(10) || 'bb' AS address FROM polling_station")
def scan_cells(t):
    """Sheets with line ends inside quoted cells."""
    read = cells.scan_cells(t.spark, _written(_stations(t)), "*.csv")
    c = lambda k: F.get("cells", F.lit(k))
    return cells.body_of(read, 5).select(
        c(0).cast("long").alias("id"), c(1).alias("number"), c(2).alias("name"), c(3).alias("location"), c(4).alias("address")
    )


@query(
    "SELECT id::VARCHAR AS id, unnest(['number', 'location']) AS header, unnest([number, location]) AS value FROM polling_station"
)
def scan_multi_file(t):
    """Several files under the header of the first by name."""
    stations = _stations(t)
    n_files = max(6, stations.count() // ROWS_A_FILE)
    read = cells.scan_cells(t.spark, _written(stations.repartition(n_files)), "part-*.csv")
    header = cells.header_of(read)
    long = cells.body_of(read).select(F.get("cells", F.lit(0)).alias("id"), F.posexplode("cells").alias("col", "value"))
    return long.join(F.broadcast(header), "col").where(F.col("text").isin("number", "location")).select("id", F.col("text").alias("header"), "value")


@query(
    "SELECT m.name AS sheet, p.id, p.number, coalesce(x.votes, 0)::BIGINT AS votes FROM polling_station p JOIN municipality m ON m.id = p.municipality_id "
    "LEFT JOIN (SELECT polling_station_id, sum(votes)::BIGINT AS votes FROM list_result GROUP BY ALL) x ON x.polling_station_id = p.id"
)
def scan_sheets(t):
    """Workbooks with a sheet a municipality: title, header, rows."""
    sums = t.list_result.groupBy(F.col("polling_station_id").alias("id")).agg(F.sum("votes").alias("votes"))
    munis = t.municipality.select(F.col("id").alias("municipality_id"), F.col("name").alias("sheet"))
    rows = (
        t.polling_station.select("id", "municipality_id", "number")
        .join(sums, "id", "left")
        .join(F.broadcast(munis), "municipality_id")
        .select("sheet", "id", "number", "votes", (F.col("id") % max(40, t.polling_station.count() // ROWS_A_FILE)).alias("file_no"))
    )

    def book(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pages = {}
        for sheet, part in frame.sort_values("id").groupby("sheet"):
            body = [[str(i), n, "" if pd.isna(v) else str(int(v))] for i, n, v in zip(part["id"], part["number"], part["votes"], strict=True)]
            pages[sheet] = [["Rezultati"], ["id", "number", "votes"], *body]
        return pd.DataFrame({"path": [f"book-{key[0]}.xlsx"], "content": [sheets.workbook_bytes(pages)]})

    books = rows.groupBy("file_no").applyInPandas(book, "path string, content binary")
    c = lambda k: F.get("cells", F.lit(k))
    return (
        sheets.parse_sheets(books)
        .where("row_no > 0")
        .select("sheet", c(0).cast("long").alias("id"), c(1).alias("number"), parse_int(F.coalesce(c(2), F.lit(""))).cast("long").alias("votes"))
    )


def _geography(t) -> DataFrame:
    return (
        t.turnout.groupBy("polling_station_id")
        .agg(*[F.sum(m).alias(m) for m in totals.MEASURES])
        .join(t.polling_station, F.col("polling_station_id") == F.col("id"))
        .join(F.broadcast(t.municipality.select(F.col("id").alias("municipality_id"), F.col("name").alias("muni"), F.col("type").alias("mtype"), "county_id")), "municipality_id")
        .join(F.broadcast(t.county.select(F.col("id").alias("county_id"), "code", F.col("name").alias("county"))), "county_id")
    )


def _thousands(c: str) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))


@query(
    "SELECT c.code AS county_code, m.name AS muni_name, p.number AS station_number, p.address, sum(x.registered_voters)::INT AS registered, sum(x.ballots_cast)::INT AS cast, "
    "sum(x.valid_ballots)::INT AS valid, sum(x.invalid_ballots)::INT AS invalid FROM turnout x JOIN polling_station p ON p.id = x.polling_station_id "
    "JOIN municipality m ON m.id = p.municipality_id JOIN county c ON c.id = m.county_id GROUP BY c.code, m.name, p.id, p.number, p.address"
)
def layout_project(t):
    """Counts with dots between thousands, under the standard layout."""
    wide = _geography(t).select(
        F.array(
            "code", "county", "mtype", F.col("muni"), F.concat(F.lit(" "), "number"), "name", "location", "address",
            _thousands("registered_voters"), _thousands("ballots_cast"), F.lit("x"), _thousands("valid_ballots"), _thousands("invalid_ballots"),
        ).alias("cells")
    )
    return wide.select(*cells.layout_columns(cells.STANDARD)).select(
        "county_code", "muni_name", "station_number", "address", "registered", "cast", "valid", "invalid"
    )


@query("SELECT number AS station_number, location, (id % 900)::INT AS registered, (id % 800)::INT AS cast FROM polling_station")
def layout_europe_2014(t):
    """Six columns of town and district parts stand before the station's."""
    blank = [F.lit("x")] * 6
    rows = t.polling_station.select(
        F.array(
            F.lit("1"), F.lit("c"), F.lit("grad"), F.lit("m"), *blank, "number", "name", "location", "address",
            (F.col("id") % 900).cast("string"), (F.col("id") % 800).cast("string"), F.lit("x"), F.lit("1"), F.lit("0"),
        ).alias("cells")
    )
    return rows.select(*cells.layout_columns(cells.LAYOUTS["europe_2014"])).select("station_number", "location", "registered", "cast")


@query("SELECT name AS muni_name, NULL::VARCHAR AS station_number, (id * 3)::INT AS registered, id::INT AS invalid FROM municipality")
def layout_abroad(t):
    """A row a country: no county, no station."""
    rows = t.municipality.select(F.array("name", (F.col("id") * 3).cast("string"), F.lit("2"), F.lit("1"), F.col("id").cast("string"), F.lit("7")).alias("cells"))
    return rows.select(*cells.layout_columns(cells.LAYOUTS["presidential_2000_abroad"])).select("muni_name", "station_number", "registered", "invalid")


@query("SELECT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS label, id::VARCHAR AS id FROM polling_station")
def scan_missing_skipped(t):
    """Of three folders one is not there; the others are read."""
    even, odd = (_written(_stations(t).where(F.col("id") % 2 == k)) for k in (0, 1))
    read = cells.scan_each(t.spark, {"even": even, "gone": f"{even}-gone", "odd": odd}, glob="*.csv")
    return read.where("row_no > 0").select("label", F.get("cells", F.lit(0)).alias("id"))


@query("SELECT number, name FROM polling_station WHERE id % 3 <> 0")
def row_guards_local(t):
    """Rows of workbooks whose first cell is missing go."""
    rows = t.polling_station.select(F.array(F.when(F.col("id") % 3 != 0, F.col("number")), F.col("name")).alias("cells"))
    return cells.begun(rows).select(F.get("cells", F.lit(0)).alias("number"), F.get("cells", F.lit(1)).alias("name"))


@query("SELECT number AS station_number, CASE WHEN id % 7 = 3 THEN 0 ELSE 1 END::INT AS registered FROM polling_station WHERE id % 7 NOT IN (1, 2)")
def row_guards(t):
    """Rows that are short (every seventh) or lack a municipality go; a missing
    count is 0."""
    kind = F.col("id") % 7
    full = F.array(
        F.lit("1"), F.lit("c"), F.lit("grad"), F.when(kind == 2, " ").otherwise("m"), "number", "name", "location", "address",
        F.when(kind == 3, "-").otherwise("1"), F.lit("1"), F.lit(""), F.lit("1"), F.lit("0"),
    )
    rows = t.polling_station.select(F.when(kind == 1, F.slice(full, 1, 6)).otherwise(full).alias("cells"), F.lit(1).alias("row_no"))
    kept = cells.guarded(cells.body_of(rows, 13).select(*cells.layout_columns(cells.STANDARD)))
    return kept.select("station_number", "registered")


@query(
    "SELECT * FROM (VALUES (1992, 3575032::BIGINT, 2677764::BIGINT, 2627061::BIGINT, 50703::BIGINT), (1997, 4061479, 2218448, 2178792, 39656)) v(year, registered_voters, ballots_cast, valid_ballots, invalid_ballots) "
    "UNION ALL SELECT e.year, sum(registered_voters)::BIGINT, sum(ballots_cast)::BIGINT, sum(valid_ballots)::BIGINT, sum(invalid_ballots)::BIGINT FROM turnout x "
    "JOIN election_round r ON r.id = x.election_round_id JOIN election e ON e.id = r.election_id WHERE e.election_type_id = 1 AND r.round_number = 1 GROUP BY e.year"
)
def src_literals(t):
    """Presidential turnout: the national summaries, then first rounds from stations."""
    of_rounds = totals.rounds(t, ["Predsjednički izbori"]).where("round_number = 1").select(F.col("round_id").alias("election_round_id"), "year")
    later = t.turnout.join(F.broadcast(of_rounds), "election_round_id").groupBy("year").agg(*[F.sum(m).alias(m) for m in totals.MEASURES])
    return literals.summaries(t.spark).select("year", *totals.MEASURES).unionByName(later)


# ---- melts: votes are pivoted to sheets, then melted back


def _wide(t, at: Column, width: int, by_place: bool) -> DataFrame:
    """A row (round_id, polling_station_id, cells); ``at`` gives the column of brand
    and position (0: the list)."""
    sheet_row = ["round_id", "polling_station_id"]
    # Each vote counts for its list and, by place, for its candidate; one shuffle by sheet row
    # serves the sums and the rows.
    counted = F.array(F.lit(0), F.col("position")) if by_place else F.array(F.lit(0))
    votes = t.votes.select(*sheet_row, "brand", "position", "votes").repartition(*sheet_row)
    rows = votes.select(*sheet_row, "brand", "votes", F.explode(counted).alias("position")).groupBy(*sheet_row, "brand", "position").agg(F.sum("votes").alias("votes"))
    placed = rows.withColumn("col", at).where("col is not null")
    gap = lambda n: F.array_repeat(F.lit("-"), n.cast("int"))
    before = lambda k: F.coalesce(F.get("cells", k - 1)["col"], F.lit(-1))
    filled = F.flatten(F.transform("cells", lambda x, k: F.concat(gap(x["col"] - before(k) - 1), F.array(x["votes"]))))
    return (
        placed.groupBy("round_id", "polling_station_id")
        .agg(F.sort_array(F.collect_list(F.struct("col", F.col("votes").cast("string").alias("votes")))).alias("cells"))
        .select("round_id", "polling_station_id", F.concat(filled, gap(F.lit(width - 1) - F.get("cells", F.size("cells") - 1)["col"])).alias("cells"))
    )


def _header(t, texts: dict[int, str], width: int) -> DataFrame:
    return t.spark.createDataFrame([(k, texts.get(k, "")) for k in range(width)], "col int, text string")


def _person(brand: int, place: int) -> str:
    return f"{FIRST_NAMES[place - 1]} {LAST_NAMES[brand - 1]}"


def _some(df: DataFrame) -> DataFrame:
    return df.where("votes > 0")


_FIRST = "[" + ", ".join(f"'{n}'" for n in FIRST_NAMES) + "]"
_LAST = "[" + ", ".join(f"'{n}'" for n in LAST_NAMES) + "]"
_BY_BRAND = "SELECT round_id, polling_station_id, brand, sum(votes)::BIGINT AS votes FROM votes GROUP BY ALL"
_BY_PLACE = "SELECT round_id, polling_station_id, brand, position, sum(votes)::BIGINT AS votes FROM votes GROUP BY ALL"


@query(
    f"SELECT round_id, polling_station_id, 'L' || brand::VARCHAR AS list_name, 0 AS position, 'L' || brand::VARCHAR AS name, votes FROM ({_BY_BRAND}) UNION ALL "
    f"SELECT round_id, polling_station_id, 'L' || brand::VARCHAR, position, {_FIRST}[position] || ' ' || {_LAST}[brand], votes FROM ({_BY_PLACE})"
)
def melt_fixed_groups(t):
    size, first = PLACES + 1, 15
    width = first + BRANDS * size + 3  # three columns of a group that is incomplete
    texts = {first + (b - 1) * size: f"L{b}" for b in range(1, BRANDS + 1)}
    texts |= {first + (b - 1) * size + p: _person(b, p) for b in range(1, BRANDS + 1) for p in range(1, PLACES + 1)}
    wide = _wide(t, F.lit(first) + (F.col("brand") - 1) * size + F.col("position"), width, True)
    return _some(melt.melt(wide, melt.fixed_groups(_header(t, texts, width), first, size), ["round_id", "polling_station_id"], blanks=False))


_LIST_NAME = "CASE brand % 3 WHEN 0 THEN 'L' || brand::VARCHAR || ' - SAVEZ' WHEN 1 THEN 'S.D.P. L' || brand::VARCHAR ELSE 'HDZ L' || brand::VARCHAR END"
_SURNAME = f"CASE brand WHEN 7 THEN 'Nova' WHEN 8 THEN 'Most' ELSE {_LAST}[brand] END"


@query(
    f"SELECT round_id, polling_station_id, {_LIST_NAME} AS list_name, 0 AS position, {_LIST_NAME} AS name, votes FROM ({_BY_BRAND}) UNION ALL "
    f"SELECT round_id, polling_station_id, {_LIST_NAME}, position, {_FIRST}[position + CASE WHEN brand % 5 = 0 AND position >= 2 THEN 1 ELSE 0 END] || ' ' || {_SURNAME}, votes "
    f"FROM ({_BY_PLACE}) WHERE position <= 5 + brand % 9 - CASE WHEN brand % 5 = 0 THEN 1 ELSE 0 END"
)
def melt_variable_groups(t):
    """Lists of 5 to 13 candidates, some known by a keyword alone, beside people
    whose surnames read like one in other letters; where a blank header cell stands
    between candidates, those behind it are read one column further left."""
    first, start, texts = 15, [], {}
    at = first
    for b in range(1, BRANDS + 1):
        start.append(at)
        texts[at] = (f"L{b} - SAVEZ", f"S.D.P. L{b}", f"HDZ L{b}")[b % 3]
        n = 5 + b % 9
        surname = {7: "Nova", 8: "Most"}.get(b, LAST_NAMES[b - 1])
        texts |= {at + p: f"{FIRST_NAMES[p - 1]} {surname}" for p in range(1, n + 1) if not (b % 5 == 0 and p == 2)}
        at += n + 1
    begins = F.element_at(F.array(*map(F.lit, start)), F.col("brand"))
    col = F.when(F.col("position") <= 5 + F.col("brand") % 9, begins + F.col("position"))
    wide = _wide(t, col, at, True)
    return _some(melt.melt(wide, melt.variable_groups(_header(t, texts, at), first), ["round_id", "polling_station_id"], blanks=False))


def _europe(t, year: int):
    first, size = cells.EUROPE_GROUPS[year]
    width = first + BRANDS * size
    texts = {first + (b - 1) * size: f"L{b}" for b in range(1, BRANDS + 1)}
    texts |= {first + (b - 1) * size + p: _person(b, p) for b in range(1, BRANDS + 1) for p in range(1, size)}
    at = F.when(F.col("position") < size, F.lit(first) + (F.col("brand") - 1) * size + F.col("position"))
    wide = _wide(t, at, width, True)
    return _some(melt.melt(wide, melt.fixed_groups(_header(t, texts, width), first, size), ["round_id", "polling_station_id"], blanks=False))


def _europe_sql(candidates: int) -> str:
    return (
        f"SELECT round_id, polling_station_id, 'L' || brand::VARCHAR AS list_name, 0 AS position, 'L' || brand::VARCHAR AS name, votes FROM ({_BY_BRAND}) UNION ALL "
        f"SELECT round_id, polling_station_id, 'L' || brand::VARCHAR, position, {_FIRST}[position] || ' ' || {_LAST}[brand], votes FROM ({_BY_PLACE}) WHERE position <= {candidates}"
    )


@query(_europe_sql(11))
def melt_europe_2014(t):
    """Lists of eleven behind nineteen columns of geography."""
    return _europe(t, 2014)


@query(_europe_sql(12))
def melt_europe_2019(t):
    return _europe(t, 2019)


@query(f"SELECT round_id, polling_station_id, 'KANDIDAT ' || brand::VARCHAR AS name, votes FROM ({_BY_BRAND})")
def melt_pct_interleaved(t):
    first, width = 13, 13 + 2 * BRANDS
    texts = {first + 2 * (b - 1): f"mr.sc. Kandidat {b}" for b in range(1, BRANDS + 1)} | {first + 2 * b - 1: "%" for b in range(1, BRANDS + 1)}
    wide = _wide(t, F.lit(first) + (F.col("brand") - 1) * 2, width, False)
    found = melt.melt(wide, melt.interleaved(_header(t, texts, width), first), ["round_id", "polling_station_id"], blanks=False)
    return _some(found).select("round_id", "polling_station_id", "name", "votes")


@query(f"SELECT round_id, polling_station_id, 'L' || brand::VARCHAR AS name, votes FROM ({_BY_BRAND}) WHERE brand % 6 <> 0")
def melt_simple(t):
    first, width = 13, 13 + BRANDS
    texts = {first + b - 1: f" L{b}".strip() for b in range(1, BRANDS + 1) if b % 6}
    wide = _wide(t, F.lit(first) + F.col("brand") - 1, width, False)
    found = melt.melt(wide, melt.filled(_header(t, texts, width), first), ["round_id", "polling_station_id"], blanks=False)
    return _some(found).select("round_id", "polling_station_id", "name", "votes")


@query(
    f"SELECT round_id, polling_station_id, 'L' || (brand + (brand - 1) // 5)::VARCHAR AS name, votes FROM ({_BY_BRAND}) WHERE brand <= 21"
)
def melt_minority(t):
    """Blank header cells (every sixth) are dropped before columns are counted."""
    first, width = 15, 15 + BRANDS
    texts = {first + b - 1: f"L{b}" for b in range(1, BRANDS + 1) if b % 6}
    wide = _wide(t, F.lit(first) + F.col("brand") - 1, width, False)
    found = melt.melt(wide, melt.compacted(_header(t, texts, width), first), ["round_id", "polling_station_id"], blanks=False)
    return _some(found).select("round_id", "polling_station_id", "name", "votes")
