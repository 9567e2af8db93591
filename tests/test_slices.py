"""Files cut anywhere give the rows of the csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from plebis.sources import slices


@pytest.fixture
def cut(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield to
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def rows_of(df):
    return [(r["file"], r["row_no"], list(r["cells"])) for r in df.orderBy("file", "row_no").collect()]


def known(name, text, title_rows=0):
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=";"))[title_rows:]
    return [(name, k, r) for k, r in enumerate(rows)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 40, 1000])
def test_cut_at_any_byte(spark, cut, tmp_path, size):
    text = 'a;b;c\r\n"x;1";"line\nend";z\n\n"say ""yes""";"";"\n\n\n"\nplain "quote;in;it\n"closed"tail;";";"last\r\nline"\r\nend;;'
    (tmp_path / "in 1.csv").write_bytes(text.encode())
    cut(size)
    read = slices.scan(spark, str(tmp_path), "*.csv")
    assert rows_of(read) == known("in 1.csv", text)
    if size < 9:
        assert slices.lines(spark, str(tmp_path), "*.csv", ";", True).select("slice").distinct().count() > 3


def test_random_sheets(spark, cut, tmp_path):
    rng = random.Random(1)
    texts = {}
    for k in range(12):
        parts = rng.choices(['"', '""', ";", "\n", "\r\n", "a", "bc", "š", ' ', '"q"', '"x\ny"'], k=rng.randint(1, 120))
        text = "".join(parts)
        # The module's last row, where quotes stay open, ends with the line end.
        texts[f"f{k:02d}.csv"] = text + ('"' if text.count('"') % 2 else "") + ";end"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for size in (4, 17, 90):
        cut(size)
        assert rows_of(slices.scan(spark, str(tmp_path))) == [r for name, text in texts.items() for r in known(name, text)]


def test_old_encodings_titles_and_marks(spark, cut, tmp_path):
    text = 'Naslov\r\nšifra;"ŽUPANIJA\nDRUGA"\r\n1;Đurđevac\r\n'
    (tmp_path / "w.csv").write_bytes(text.encode("windows-1250"))
    cut(7)
    assert rows_of(slices.scan(spark, str(tmp_path), "w.csv", encoding="windows-1250", title_rows=1)) == known("w.csv", text, 1)
    (tmp_path / "m.csv").write_bytes(('"a\nb";c\n' + text).encode("utf-8-sig"))
    assert rows_of(slices.scan(spark, str(tmp_path), "m.csv")) == known("m.csv", '"a\nb";c\n' + text)
    (tmp_path / "e.csv").write_bytes(b"")
    assert rows_of(slices.scan(spark, str(tmp_path), "e.csv")) == []


def test_a_cell_over_many_slices(spark, cut, tmp_path):
    text = "h;i\n" + 'x;"' + "long line of a cell\n" * 500 + '";y\n' + "1;2\n" * 50
    (tmp_path / "long.csv").write_text(text)
    cut(512)
    assert rows_of(slices.scan(spark, str(tmp_path))) == known("long.csv", text)


def test_no_text_is_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    plan = slices.scan(spark, str(tmp_path)).where(F.col("row_no") > 0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "line#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
