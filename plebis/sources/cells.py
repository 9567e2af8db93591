"""Delimited result sheets as rows of cells.

Files are read by slices (``slices``).  ``parse_cells`` takes contents that are in a column
already, each whole.  All that follows works on the cells with built-in functions.
"""

from __future__ import annotations

import csv
import io
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plebis.functions.names import parse_int, strip
from plebis.sources import slices

LOG = logging.getLogger(__name__)
CELLS = slices.CELLS

#: Column offsets by layout; None where a sheet lacks the cell.
STANDARD = {
    "county_code": 0, "county_name": 1, "muni_type": 2, "muni_name": 3, "station_number": 4, "station_name": 5, "location": 6, "address": 7,
    "registered": 8, "cast": 9, "valid": 11, "invalid": 12,
}
LAYOUTS = {
    "standard": STANDARD,
    "presidential_2005": {
        "county_code": 0, "county_name": 1, "muni_type": None, "muni_name": 2, "station_number": 3, "station_name": None, "location": None,
        "address": None, "registered": 4, "cast": 5, "valid": 6, "invalid": 7,
    },
    "presidential_2000": {
        "county_code": None, "county_name": 0, "muni_type": 1, "muni_name": 2, "station_number": 3, "station_name": None, "location": None,
        "address": None, "registered": 4, "cast": 5, "valid": 6, "invalid": 7,
    },
    "parliament": {
        "county_code": 2, "county_name": 3, "muni_type": 4, "muni_name": 5, "station_number": 6, "station_name": 7, "location": 8, "address": 9,
        "registered": 10, "cast": 11, "valid": 13, "invalid": 14,
    },
    "presidential_2000_abroad": {
        "county_code": None, "county_name": None, "muni_type": None, "muni_name": 0, "station_number": None, "station_name": None, "location": None,
        "address": None, "registered": 1, "cast": 2, "valid": 3, "invalid": 4,
    },
    "europe": STANDARD,
    "europe_2014": {
        "county_code": 0, "county_name": 1, "muni_type": 2, "muni_name": 3, "station_number": 10, "station_name": 11, "location": 12, "address": 13,
        "registered": 14, "cast": 15, "valid": 17, "invalid": 18,
    },
}
#: First column of votes, and columns a list with its candidates, of European sheets.
EUROPE_GROUPS = {2013: (13, 13), 2014: (19, 12), 2019: (13, 13), 2024: (13, 13)}
MEASURES = ("registered", "cast", "valid", "invalid")


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def parse_cells(found: DataFrame, encoding: str = "utf-8-sig", delimiter: str = ";", title_rows: int = 0) -> DataFrame:
    """Files (path, content) to rows (file, row_no, cells); row 0 is the header."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = list(csv.reader(io.StringIO(bytes(content).decode(encoding), newline=""), delimiter=delimiter))[title_rows:]
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "row_no": range(len(rows)), "cells": rows})

    return found.select("path", "content").mapInPandas(run, CELLS)


def scan_cells(spark: SparkSession, path: str, glob: str | None = None, **options) -> DataFrame:
    """Files below ``path`` to rows (file, row_no, cells); a file is parsed by as many
    tasks as it has slices."""
    return slices.scan(spark, path, glob, **options)


def scan_each(spark: SparkSession, paths: dict[str, str], **options) -> DataFrame:
    """Sheets of several paths, with the label that each has in ``paths``; a path
    that is not there is logged and left out."""
    found = spark.createDataFrame([], f"label string, {CELLS}")
    for label, path in paths.items():
        try:
            read = scan_cells(spark, path, **options)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            LOG.warning("%s: nothing at %s", label, path)
            continue
        if not files(spark, path, options.get("glob")).inputFiles():
            LOG.warning("%s: no file at %s", label, path)
        found = found.unionByName(read.withColumn("label", F.lit(label)))
    return found


def header_of(cells: DataFrame) -> DataFrame:
    """(col, text) of the header; of several files, that of the first by name."""
    first = cells.where("row_no = 0").orderBy("file").limit(1)
    return first.select(F.posexplode("cells").alias("col", "text")).select("col", strip(F.coalesce("text", F.lit(""))).alias("text"))


def body_of(cells: DataFrame, least: int = 0) -> DataFrame:
    """Rows below the header that have at least ``least`` cells."""
    return cells.where((F.col("row_no") > 0) & (F.size("cells") >= least))


def begun(cells: DataFrame) -> DataFrame:
    """Rows whose first cell is there."""
    return cells.where(F.get("cells", F.lit(0)).isNotNull())


def layout_columns(layout: dict[str, int | None], cells: str | Column = "cells") -> list[Column]:
    """The cells that a layout names, null where it has none; counts as integers."""
    out = []
    for name, at in layout.items():
        value = F.lit(None).cast("string") if at is None else strip(F.get(cells, F.lit(at)))
        out.append((parse_int(value) if name in MEASURES else value).alias(name))
    return out


def guarded(rows: DataFrame) -> DataFrame:
    """Without rows whose municipality or station number is blank."""
    return rows.where("coalesce(muni_name, '') <> '' and coalesce(station_number, '') <> ''")
