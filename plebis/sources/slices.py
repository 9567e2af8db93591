"""Delimited sheets of any size, each parsed by as many tasks as it has slices.

Spark's text source cuts a file at line ends wherever a slice ends, be it within
quotes.  Whether a line begins within quotes depends on all lines before it, but a line
only ever maps "outside" and "within" to one of both: so every slice tells where it would
end from either start and how many rows begin in it (``folded``), slices are put in a row
file by file (a row a slice), and then every slice is parsed with the right start
(``parsed``).  Rows that run over slices are put together from their pieces; a
task holds one row.

Line ends are \\n or \\r\\n; what lies within quotes is kept as written.  A byte-order mark
at the beginning of a line goes, where the encoding is utf-8-sig.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "file string, row_no long, cells array<string>"
#: Rows of a batch that a task hands on.
BATCH = 2000


def lines(spark: SparkSession, path: str, glob: str | None, delimiter: str, marked: bool) -> DataFrame:
    """Lines with file, slice (its first byte), raw bytes, and where each ends (true: within
    quotes) if it begins outside and if it begins within."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    text = F.regexp_replace("value", "^﻿", "") if marked else F.col("value")
    d = f"\\x{ord(delimiter):02x}"
    # A quote opens a cell only as its first character; after the closing one the rest
    # of the cell is plain.
    closed = f'(?:[^"]++|"")*+"[^{d}]*+'
    cell = f'(?:"{closed}|[^"{d}][^{d}]*+|)'
    rest = f"(?:{d}{cell})*+"
    return found.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("slice"),
        F.col("value").cast("binary").alias("line"),
        (~text.rlike(f"^(?s:{cell}{rest})\\z")).alias("outside"),
        (~text.rlike(f"^(?s:{closed}{rest})\\z")).alias("within"),
    )


def folded(found: DataFrame) -> DataFrame:
    """A row a slice: end and begun rows if it begins outside (a, n_a) and within (b, n_b)."""
    schema = pa.schema([("path", pa.string()), ("slice", pa.int64()), ("a", pa.bool_()), ("n_a", pa.int64()), ("b", pa.bool_()), ("n_b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for path, at, outside, within in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault((path, at), [False, 0, True, 0])
                for k in (0, 2):
                    own[k + 1] += not own[k]
                    own[k] = within if own[k] else outside
        out = [dict(zip(schema.names, (*key, *own), strict=True)) for key, own in held.items()]
        yield pa.RecordBatch.from_pylist(out, schema)

    # A task has a few slices at most.
    return found.select("path", "slice", "outside", "within").mapInArrow(run, "path string, slice long, a boolean, n_a long, b boolean, n_b long")


def starts(slices: DataFrame) -> DataFrame:
    """Of each slice whether it begins within quotes and how many rows began before it."""
    before = Window.partitionBy("path").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # A slice that ends alike from either start settles what follows it; between such
    # slices the others only turn the state or leave it.
    settled = F.col("a") == F.col("b")
    turns = F.coalesce(F.sum(F.when(~settled & F.col("a"), 1).otherwise(0)).over(before), F.lit(0))
    own = slices.withColumn("turns", turns).withColumn("mine", F.when(settled, F.col("a").cast("int")))
    # After a settled slice the turns counted so far include none of its own.
    last = F.last(F.when(settled, F.struct("mine", "turns")), ignorenulls=True).over(before)
    known = own.withColumn("last", last).withColumn(
        "inside", F.pmod(F.coalesce(F.col("last.mine"), F.lit(0)) + F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0)), F.lit(2)) == 1
    )
    count = F.when(F.col("inside"), F.col("n_b")).otherwise(F.col("n_a"))
    return known.withColumn("first", F.coalesce(F.sum(count).over(before), F.lit(0))).select("path", "slice", "inside", "first")


def parsed(found: DataFrame, begun: DataFrame, encoding: str, delimiter: str) -> DataFrame:
    """Rows (path, row_no, cells), and pieces (path, row_no, slice, nth, piece) of rows that run
    over the end of their slice."""
    plain = "utf-8" if encoding == "utf-8-sig" else encoding
    schema = pa.schema([("path", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string())), ("slice", pa.int64()), ("piece", pa.string())])

    def decoded(line: bytes) -> str:
        text = line.decode(plain)
        return text.removeprefix("﻿") if encoding == "utf-8-sig" else text

    def cells_of(text: str) -> list[str]:
        text = text.removesuffix("\r")
        return next(csv.reader([text] if "\n" not in text and "\r" not in text else text.splitlines(keepends=True), delimiter=delimiter), [])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, inside, number, held, whole = None, False, 0, [], True
        for batch in batches:
            for path, start, line, outside, within, begins, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, start) != at:
                    if held:
                        yield {"path": at[0], "row_no": number, "slice": at[1], "piece": "\n".join(held)}
                    at, inside, number, held, whole = (path, start), begins, first - 1, [], not begins
                if not inside:
                    number, held, whole = number + 1, [], True
                held.append(decoded(line))
                inside = within if inside else outside
                if not inside:
                    text = "\n".join(held)
                    yield {"path": path, "row_no": number, "cells": cells_of(text)} if whole else {"path": path, "row_no": number, "slice": start, "piece": text}
                    held = []
        if held:
            yield {"path": at[0], "row_no": number, "slice": at[1], "piece": "\n".join(held)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for r in rows(batches):
            out.append(r)
            if len(out) == BATCH:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    # A row a slice of some hundred MB: small beside what it tells of.
    placed = found.join(F.broadcast(begun), ["path", "slice"]).select("path", "slice", "line", "outside", "within", "inside", "first")
    read = placed.mapInArrow(run, "path string, row_no long, cells array<string>, slice long, piece string")

    def mended(texts: pa.Table) -> pa.Table:
        text = "\n".join(texts.sort_by("slice")["piece"].to_pylist())
        return pa.table({"path": texts["path"][:1], "row_no": texts["row_no"][:1], "cells": pa.array([cells_of(text)], pa.list_(pa.string()))})

    pieces = read.where("piece is not null").groupBy("path", "row_no").applyInArrow(mended, "path string, row_no long, cells array<string>")
    return read.where("piece is null").select("path", "row_no", "cells").unionByName(pieces)


def scan(spark: SparkSession, path: str, glob: str | None = None, encoding: str = "utf-8-sig", delimiter: str = ";", title_rows: int = 0) -> DataFrame:
    """Files below ``path`` to rows (file, row_no, cells); row 0 is the header.  Encodings are
    those in which quotes, delimiters and line ends are single ASCII bytes."""
    found = lines(spark, path, glob, delimiter, encoding == "utf-8-sig")
    rows = parsed(found, starts(folded(found)), encoding, delimiter)
    return rows.where(F.col("row_no") >= title_rows).select(
        F.element_at(F.split(_plain(F.col("path")), "/"), -1).alias("file"), (F.col("row_no") - title_rows).alias("row_no"), "cells"
    )


def _plain(path: Column) -> Column:
    """File paths as they were named: metadata has them encoded as in addresses."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
