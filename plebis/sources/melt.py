"""From wide sheets to long votes, led by the header.

Each layout is a rule from the header (col, text) to the columns that hold votes:
(col, list_name, position, name), position 0 for the list itself.  The header is
as wide as a sheet, so it is broadcast; cells are taken apart with their column by
generated code, blank ones go before they meet the header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plebis.functions.names import clean_candidate_name, parse_int

# Words that tell the name of a list.
LIST_WORDS = (
    "HDZ", "SDP", "DP", "HSS", "HSP", "MOST", "HKS", "IDS", "HNS", "HSLS", "SDSS", "BDSH", "OIP", "FOKUS", "AUTOHTONA", "CENTAR",
    "MOŽEMO", "STRANKA", "PLATFORMA", "REPUBLIKA", "POKRET", "KOALICIJA", "SAVEZ", "UNIJA", "FORUM", "DOMOVINSKI", "HRVATSKA",
    "HRVATSKI", "HRVATSKO", "HRVATSKE", "DEMOKRATSKA", "DEMOKRATSKI", "ZAJEDNICA", "BILO", "POLITIČKA", "LIBERALNA", "SELJAČKA",
    "SOCIJALDEMOKRATSKA", "NARODNA", "NARODNI", "PRAVA", "LIJEVI", "DESNI", "ODLUČNOST", "PRAVEDNOST", "ZELENA", "NOVA", "PRAVDA",
    "RIJEKA", "RDS",
)


def _ordered():
    return Window.partitionBy("sheet").orderBy("col")


def fixed_groups(header: DataFrame, first: int, size: int) -> DataFrame:
    """Groups of a list and size - 1 candidates; an incomplete last group is left."""
    width = F.count("*").over(Window.partitionBy())
    group = Window.partitionBy("group")
    return (
        header.withColumn("groups", F.floor((width - first) / size))
        .where(F.col("col") >= first)
        .withColumn("group", F.floor((F.col("col") - first) / size))
        .withColumn("position", ((F.col("col") - first) % size).cast("int"))
        .where("group < groups")
        .withColumn("list_name", F.max(F.when(F.col("position") == 0, F.col("text"))).over(group))
        .select("col", "list_name", "position", F.col("text").alias("name"))
    )


def variable_groups(header: DataFrame, first: int) -> DataFrame:
    """A list starts at a cell that reads like one; its candidates are the filled
    cells up to the next.  The i-th of them is read i columns after the list, blank
    cells between them or not."""
    words = F.split(F.replace(F.replace("text", F.lit("."), F.lit("")), F.lit("!"), F.lit("")), r"(?U)\s+")
    is_list = F.contains("text", F.lit(" - ")) | F.contains("text", F.lit(",")) | F.contains("text", F.lit("!")) | F.arrays_overlap(
        words, F.array(*map(F.lit, LIST_WORDS))
    )
    cells = (
        header.where((F.col("col") >= first) & (F.col("text") != ""))
        .withColumn("sheet", F.lit(0))
        .withColumn("is_list", is_list)
        .withColumn("list_col", F.last(F.when(F.col("is_list"), F.col("col")), ignorenulls=True).over(_ordered()))
        .where("list_col is not null")
    )
    group = Window.partitionBy("list_col").orderBy("col")
    return (
        cells.withColumn("position", (F.row_number().over(group) - 1).cast("int"))
        .withColumn("list_name", F.first("text").over(group))
        .select((F.col("list_col") + F.col("position")).alias("col"), "list_name", "position", F.col("text").alias("name"))
    )


def interleaved(header: DataFrame, first: int) -> DataFrame:
    """One candidate a column, or every second where the header has shares."""
    share = F.col("text").isin("%", "(%)")
    step = F.max(F.when(share, 2).otherwise(1)).over(Window.partitionBy())
    return (
        header.where(F.col("col") >= first)
        .withColumn("step", step)
        .where((F.pmod(F.col("col") - first, F.col("step")) == 0) & ~share & (F.col("text") != ""))
        .withColumn("name", F.upper(clean_candidate_name(F.col("text"))))
        .select("col", F.col("name").alias("list_name"), F.lit(1).alias("position"), "name")
    )


def filled(header: DataFrame, first: int) -> DataFrame:
    """One list or candidate a filled header cell."""
    return header.where((F.col("col") >= first) & (F.col("text") != "")).select(
        "col", F.col("text").alias("list_name"), F.lit(1).alias("position"), F.col("text").alias("name")
    )


def compacted(header: DataFrame, first: int) -> DataFrame:
    """As ``filled``, but blank header cells are dropped before columns are
    counted, so what stands behind a blank is read further left."""
    at = F.row_number().over(_ordered()) - 1 + first
    return filled(header, first).withColumn("sheet", F.lit(0)).withColumn("col", at.cast("int")).drop("sheet")


def melt(rows: DataFrame, columns: DataFrame, keys: list[str], cells: str = "cells", blanks: bool = True) -> DataFrame:
    """One row a row and vote column that the row reaches; missing cells count 0,
    or are left out without ``blanks``."""
    wanted = columns.select(F.col("col").alias("__col"), "list_name", "position", "name")
    # The outer form has no filter inferred, for which cells would be worked out twice.
    read = rows.select(*keys, F.posexplode_outer(cells).alias("__col", "__cell"))
    cell = F.coalesce("__cell", F.lit(""))
    if not blanks:
        read = read.where(~cell.isin("", "-", "0"))
    # As many rows as a sheet has columns.
    return read.join(F.broadcast(wanted), "__col").select(*keys, "list_name", "position", "name", parse_int(cell).cast("long").alias("votes"))
