"""Scalar functions on names, numbers and labels, as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Academic titles before and after names.
TITLE_PREFIX = (
    r"(?iU)^(prof\.dr\.sc\.|doc\.dr\.sc\.|dr\.sc\.|mr\.sc\.|prof\.|doc\.|dr\.|mr\.|mag\.\w*\.?|dipl\.\w*\.?)\s+"
)
TITLE_TAIL = r"(?iU),\s*(prof|doc|dr|mr|mag|dipl|univ|bacc|ing|spec|oec|iur|med|sc|akad|struc|struč)\b.*$"
# Spellings of municipality types.
MUNICIPALITY_TYPES = {
    "grad": "grad", "općina": "općina", "opcina": "općina", "op ina": "općina",
    "država": "država", "drzava": "država", "dr ava": "država",
}


def strip(c: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@cache
def _base_letters() -> tuple[str, str]:
    """All letters that decompose to one letter and marks, and those letters."""
    source, target = ["Đ", "đ"], ["D", "d"]
    for code in range(0xA0, min(0x3000, sys.maxunicode)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != chr(code) and unicodedata.category(chr(code)) != "Mn":
            source.append(chr(code))
            target.append(bare)
    return "".join(source), "".join(target)


def strip_diacritics(c: Column) -> Column:
    """Letters without their marks, in whole-stage code.  Signs that decompose to
    several letters stay; ``strip_diacritics_full`` takes those apart too."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), *_base_letters())


@F.pandas_udf(StringType())
def strip_diacritics_full(texts: pd.Series) -> pd.Series:
    def bare(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", t.replace("Đ", "D").replace("đ", "d"))
        return "".join(x for x in t if unicodedata.category(x) != "Mn")

    return texts.map(bare, na_action="ignore")


def normalize_person_name(c: Column) -> Column:
    return squeeze(F.upper(strip_diacritics(strip(c))))


def clean_candidate_name(c: Column) -> Column:
    """Without academic titles and stray commas; broken hyphens joined."""
    c = strip(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, TITLE_PREFIX, "")
    c = F.regexp_replace(c, TITLE_TAIL, "")
    c = F.replace(F.replace(c, F.lit(", "), F.lit(" ")), F.lit(","), F.lit(""))
    return squeeze(F.regexp_replace(c, r"(?U)-\s+", "-"))


def parse_person_name(c: Column) -> Column:
    """(first_name, last_name): the first word and all others."""
    words = F.split(squeeze(c), " ", 2)
    return F.struct(F.get(words, F.lit(0)).alias("first_name"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("last_name"))


def normalize_municipality(c: Column) -> Column:
    c = F.regexp_replace(strip(F.upper(F.coalesce(c, F.lit("")))), r"(?U)^(GRAD|OP[ĆC]INA)\s+", "")
    return squeeze(F.regexp_replace(c, r"(?U)\s*-\s*", " "))


def normalize_county(c: Column) -> Column:
    return squeeze(F.replace(strip_diacritics(F.upper(strip(c))), F.lit("ZUPANIJA"), F.lit("")))


def parse_int(c: Column) -> Column:
    """Dots group thousands, a comma is the decimal sign; anything else is 0."""
    text = F.replace(F.replace(strip(c), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(text.try_cast("double").try_cast("int"), F.lit(0))


def zfill(c: Column, n: int) -> Column:
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def primary_party(c: Column) -> Column:
    """What stands before the first line end, then before the first comma."""
    return strip(F.substring_index(F.substring_index(c, "\n", 1), ",", 1))


def primary_party_comma(c: Column) -> Column:
    return strip(F.substring_index(c, ",", 1))


def election_label(name: Column, type_name: Column, year: Column) -> Column:
    return F.when(name.isNull() | (name == ""), F.concat_ws(" ", type_name, year.cast("string"))).otherwise(name)


def station_label(number: Column, location: Column, name: Column) -> Column:
    place = F.coalesce(F.when(location != "", location), name, F.lit(""))
    return F.regexp_replace(F.concat(F.coalesce(number, F.lit("")), F.lit(" — "), place), r"^[ —]+|[ —]+$", "")


def normalize_municipality_type(c: Column) -> Column:
    lower = F.lower(strip(F.coalesce(c, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in MUNICIPALITY_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, lower), lower)


def station_prefix(file_name: Column) -> Column:
    return F.when(file_name.contains("_posebna"), "P").when(file_name.contains("_inozemstvo"), "I").otherwise("")


def roman(c: Column) -> Column:
    """1 to 39 in Roman numerals, tens before units."""
    tens = F.element_at(F.array(*[F.lit(x) for x in ("", "X", "XX", "XXX")]), (F.floor(c / 10) + 1).cast("int"))
    units = F.element_at(
        F.array(*[F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]), (c % 10 + 1).cast("int")
    )
    return F.when((c >= 1) & (c <= 39), F.concat(tens, units)).otherwise("")


# Sheets of a workbook by name, then by beginning: slug, type, whether it lists parties.
SHEETS = {
    "općinsko vijeće": ("local_municipal_council", "Općinsko vijeće", True),
    "načelnik": ("local_mayor", "Načelnik", False),
    "gradsko vijeće": ("local_city_council", "Gradsko vijeće", True),
    "gradonačelnik": ("local_city_mayor", "Gradonačelnik", False),
    "županijska skupština": ("local_county_assembly", "Županijska skupština", True),
    "župan": ("local_county_prefect", "Župan", False),
    "skupština grada zagreba": ("local_city_council", "Gradsko vijeće", True),
    "gradonačelnik grada zagreba": ("local_city_mayor", "Gradonačelnik", False),
}
SHEET_BEGINNINGS = {
    "zamjenik načelnika": ("local_deputy_mayor", "Zamjenik načelnika", False),
    "zamjenik gradonačelnika": ("local_deputy_city_mayor", "Zamjenik gradonačelnika", False),
    "zamjenik župana": ("local_deputy_county_prefect", "Zamjenik župana", False),
}


def classify_sheet(c: Column) -> Column:
    """(slug, type, is_list) of a sheet name, or null."""
    name = F.lower(strip(c))
    found = F.when(F.lit(False), F.lit(None))
    for fits, table in ((lambda k: name == k, SHEETS), (name.startswith, SHEET_BEGINNINGS)):
        for key, (slug, kind, is_list) in table.items():
            value = F.struct(F.lit(slug).alias("slug"), F.lit(kind).alias("type"), F.lit(is_list).alias("is_list"))
            found = found.when(fits(key), value)
    return found


def croatian(c: Column | str) -> Column:
    """A sort key: Č and Ć follow C, Đ follows D and Dž, Lj and Nj are letters, Š and Ž come last of
    theirs; for lists that are shown, not for keys."""
    return F.collate(c, "hr")


def title_case(c: Column | str) -> Column:
    """The first letter of every run of letters as a capital, all others small; a digit or a
    mark ends a run."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda part: F.initcap(part)), "")
