"""Unit vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from plebis.functions import names

CASES = [
    (names.normalize_municipality, "ZLATAR-BISTRICA", "ZLATAR BISTRICA"),
    (names.normalize_municipality, "GRAD DUGO SELO", "DUGO SELO"),
    (names.normalize_municipality, "općina  Čazma - Sjever ", "ČAZMA SJEVER"),
    (names.normalize_municipality, "OPCINA X", "X"),
    (names.normalize_municipality, None, ""),
    (names.strip_diacritics, "ČŠŽĐ čšžđ é", "CSZD cszd e"),
    (names.normalize_person_name, "  Željka   Đurić ", "ZELJKA DURIC"),
    (names.clean_candidate_name, "prof.dr.sc. MILAN , KUJUNDŽIĆ", "MILAN KUJUNDŽIĆ"),
    (names.clean_candidate_name, "IVAN SINČIĆ, , univ.bacc.ing.el.", "IVAN SINČIĆ"),
    (names.clean_candidate_name, "KOLINDA GRABAR-, KITAROVIĆ", "KOLINDA GRABAR-KITAROVIĆ"),
    (names.clean_candidate_name, "ANA ANIĆ, STRUČ. SPEC.", "ANA ANIĆ"),
    (names.clean_candidate_name, None, ""),
    (names.normalize_county, " Sisačko-moslavačka  županija", "SISACKO-MOSLAVACKA"),
    (names.parse_int, "1.234", 1234),
    (names.parse_int, "12,9", 12),
    (names.parse_int, "-", 0),
    (names.parse_int, "", 0),
    (names.parse_int, None, 0),
    (names.parse_int, "abc", 0),
    (names.parse_int, "  7 ", 7),
    (lambda c: names.zfill(c, 3), "P6", "0P6"),
    (lambda c: names.zfill(c, 3), "P0061", "P0061"),
    (names.primary_party, "HDZ\nHSLS, X", "HDZ"),
    (names.primary_party, "SDP, HSS", "SDP"),
    (names.primary_party_comma, "HDZ\nHSLS, X", "HDZ\nHSLS"),
    (names.normalize_municipality_type, " Opcina", "općina"),
    (names.normalize_municipality_type, "Sažetak", "sažetak"),
    (names.station_prefix, "02_01_rezultati_posebna.csv", "P"),
    (names.station_prefix, "02_01_rezultati_inozemstvo.csv", "I"),
    (names.station_prefix, "02_01_rezultati.csv", ""),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_vectors(spark, n):
    f, given, expected = CASES[n]
    got = spark.createDataFrame([(given,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert got == expected


def test_person_parts(spark):
    rows = [("ANA SELAK RASPUDIĆ",), ("ANA",), ("",)]
    got = spark.createDataFrame(rows, "x string").select(names.parse_person_name(F.col("x")).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in got] == [("ANA", "SELAK RASPUDIĆ"), ("ANA", ""), ("", "")]


def test_roman(spark):
    rows = spark.range(1, 40).select("id", names.roman(F.col("id")).alias("r")).collect()
    known = {r["id"]: r["r"] for r in rows}
    assert (known[4], known[9], known[11], known[39]) == ("IV", "IX", "XI", "XXXIX")


def test_sheets(spark):
    rows = [("Župan ",), ("zamjenik župana 2",), ("Upute",), ("Skupština grada Zagreba",)]
    got = spark.createDataFrame(rows, "x string").select(names.classify_sheet(F.col("x"))["type"].alias("t")).collect()
    assert [r["t"] for r in got] == ["Župan", "Zamjenik župana", None, "Gradsko vijeće"]


def test_labels(spark):
    df = spark.createDataFrame([("", "T", 2001, "1", None, "N"), ("E", "T", 2001, "2", "L", "N"), (None, "T", 2001, "", "", None)],
                               "name string, t string, y int, n string, l string, s string")
    got = df.select(
        names.election_label(F.col("name"), F.col("t"), F.col("y")).alias("e"), names.station_label(F.col("n"), F.col("l"), F.col("s")).alias("s")
    ).collect()
    assert [tuple(r) for r in got] == [("T 2001", "1 — N"), ("E", "2 — L"), ("T 2001", "")]


def test_full_decomposition(spark):
    got = spark.createDataFrame([("ﬁ Đ é",), (None,)], "x string").select(names.strip_diacritics_full("x").alias("y")).collect()
    assert [r["y"] for r in got] == ["fi D e", None]
