"""Sheets in old encodings, and streams."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plebis.sources import cells, melt, sheets
from plebis.streaming import ingest


def test_old_encoding_and_quoted_line_ends(spark, tmp_path):
    text = 'Naslov\r\nšifra;županija;"LISTA\nDVA"\r\n1;Šibenik;1.234\r\n2;Đurđevac\r\n'
    (tmp_path / "b_rezultati.csv").write_bytes(text.encode("windows-1250"))
    (tmp_path / "c_other.txt").write_bytes(b"x")
    read = cells.scan_cells(spark, str(tmp_path), "*_rezultati*.csv", encoding="windows-1250", title_rows=1)
    rows = read.orderBy("row_no").collect()
    assert [list(r["cells"]) for r in rows] == [["šifra", "županija", "LISTA\nDVA"], ["1", "Šibenik", "1.234"], ["2", "Đurđevac"]]
    assert cells.body_of(read, 3).count() == 1


def test_first_file_gives_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "b.csv").write_text("p;q\n3;4\n")
    read = cells.scan_cells(spark, str(tmp_path), "*.csv")
    assert [r["text"] for r in cells.header_of(read).orderBy("col").collect()] == ["x", "y"]


def test_workbook_round_trip_and_broken_file(spark):
    book = sheets.workbook_bytes({"Župan": [["t"], ["a", "b"], ["1", "<&>"]], "Other": [["t"], ["z"]]})
    df = spark.createDataFrame([("dir/x.xlsx", bytearray(book)), ("dir/bad.xlsx", bytearray(b"no zip"))], "path string, content binary")
    got = [(r["file"], r["sheet"], r["row_no"], list(r["cells"])) for r in sheets.parse_sheets(df).orderBy("sheet", "row_no").collect()]
    assert got == [("x.xlsx", "Other", 0, ["z"]), ("x.xlsx", "Župan", 0, ["a", "b"]), ("x.xlsx", "Župan", 1, ["1", "<&>"])]


def test_variable_groups(spark):
    texts = ["g", "HDZ - X", "Ana A", "", "Iva B", "NOVA SNAGA", "Luka C"]
    header = spark.createDataFrame(list(enumerate(texts)), "col int, text string")
    got = sorted(tuple(r) for r in melt.variable_groups(header, 1).collect())
    assert got == [
        (1, "HDZ - X", 0, "HDZ - X"), (2, "HDZ - X", 1, "Ana A"), (3, "HDZ - X", 2, "Iva B"),
        (5, "NOVA SNAGA", 0, "NOVA SNAGA"), (6, "NOVA SNAGA", 1, "Luka C"),
    ]


def test_stream_replaces_keys(spark):
    base = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    schema = "election_round_id long, polling_station_id long, registered_voters long, ballots_cast long, valid_ballots long, invalid_ballots long"
    for rows in ([(1, 1, 5, 4, 4, 0), (1, 1, 5, 4, 4, 0), (1, 2, 1, 1, 1, 0)], [(1, 2, 9, 8, 7, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(base / "in"))
        stream = ingest.turnout_stream(spark, str(base / "in"), schema)
        ingest.upsert_into(stream, str(base / "out"), str(base / "cp")).awaitTermination(120)
    newest = max(base.glob("out/v=*"), key=lambda p: int(p.name[2:]))
    got = sorted(tuple(r)[:4] for r in spark.read.parquet(str(newest)).select(*[F.col(c.split()[0]) for c in schema.split(", ")]).collect())
    assert got == [(1, 1, 10, 8), (1, 2, 9, 8)]


def test_ids_from_text():
    from plebis.operators.scope import parse_ids

    assert parse_ids(" 1, 22,,3 ") == [1, 22, 3] and parse_ids(None) == []
    with pytest.raises(ValueError):
        parse_ids("1,x")


def test_lists_by_keyword(spark):
    from plebis.sources import melt

    header = ["g", "HDZ", "Ana Nova", "Marko Most", "S.D.P.", "Iva Kos", "", "NOVA!", "Rok Kos"]
    rows = spark.createDataFrame(list(enumerate(header)), "col int, text string")
    got = sorted(map(tuple, melt.variable_groups(rows, 1).collect()))
    assert got == [
        (1, "HDZ", 0, "HDZ"), (2, "HDZ", 1, "Ana Nova"), (3, "HDZ", 2, "Marko Most"), (4, "S.D.P.", 0, "S.D.P."), (5, "S.D.P.", 1, "Iva Kos"),
        (7, "NOVA!", 0, "NOVA!"), (8, "NOVA!", 1, "Rok Kos"),
    ]


def test_melt_reads_what_a_row_reaches(spark):
    from plebis.sources import melt

    columns = spark.createDataFrame([(1, "a", 0, "a"), (2, "b", 0, "b"), (3, "c", 0, "c")], "col int, list_name string, position int, name string")
    rows = spark.createDataFrame([(1, ["x", "5", None, "1.200"]), (2, ["x", "-"]), (3, [])], "k int, cells array<string>")
    got = lambda blanks: sorted((r["k"], r["name"], r["votes"]) for r in melt.melt(rows, columns, ["k"], blanks=blanks).collect())
    assert got(True) == [(1, "a", 5), (1, "b", 0), (1, "c", 1200), (2, "a", 0)] and got(False) == [(1, "a", 5), (1, "c", 1200)]


def test_sheets_and_columns_that_are_not_asked_for_are_not_read(spark):
    import io
    import zipfile

    book = sheets.workbook_bytes({"Župan": [["t"], ["a", "b", "c"], ["1", "2", "3"], ["4"]], "Broken": [["t"]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as z, zipfile.ZipFile(out, "w") as w:
        for name in z.namelist():  # the second sheet is no XML
            w.writestr(name, b"<<<" if name.endswith("sheet2.xml") else z.read(name))
    df = spark.createDataFrame([("x.xlsx", bytearray(out.getvalue()))], "path string, content binary")
    read = sheets.parse_sheets(df, names=["Župan"], columns=[2, 0]).orderBy("row_no")
    assert [(r["sheet"], list(r["cells"])) for r in read.collect()] == [("Župan", ["c", "a"]), ("Župan", ["3", "1"]), ("Župan", [None, "4"])]
    assert sheets.parse_sheets(df).count() == 0 and sheets.parse_sheets(df, names=["None"]).count() == 0
    # Blank cells before the last one are kept, and a sheet longer than a batch is whole.
    long = sheets.workbook_bytes({"s": [["t"]] + [[str(k), "", "z"] for k in range(12_000)]})
    df = spark.createDataFrame([("y.xlsx", bytearray(long))], "path string, content binary")
    assert sheets.parse_sheets(df).where("size(cells) = 3").count() == 12_000


def test_melts_shuffle_votes_once_and_take_cells_apart_in_generated_code(spark, data):
    from plebis.plans import catalog

    for name in ("melt_fixed_groups", "melt_variable_groups", "melt_europe_2014", "melt_europe_2019"):
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == plan.count("FileScan parquet [l_") == 1, name
        assert plan.count("transform(") == 1 and "inline(" not in plan and "filter(" not in plan, name


def test_melt_of_rows_without_cells(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, ["", "4"]), (4, ["7", None, "9"])], "k int, cells array<string>")
    columns = spark.createDataFrame([(0, "L", 0, "L"), (1, "L", 1, "A"), (5, "M", 0, "M")], "col int, list_name string, position int, name string")
    got = lambda blanks: sorted((r["k"], r["name"], r["votes"]) for r in melt.melt(rows, columns, ["k"], blanks=blanks).collect())
    assert got(True) == [(3, "A", 4), (3, "L", 0), (4, "A", 0), (4, "L", 7)]
    assert got(False) == [(3, "A", 4), (4, "L", 7)]
