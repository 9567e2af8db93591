"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; a
    temporary one only where the session names none (tests on one machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plebis-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def joined(parts: Column) -> Column:
    return F.array_join(parts, ",")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, also within lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Matches whose places are added up together.
STRIDE = 128
_MATCHES = "array<struct<start:int,end:int,match:string>>"


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points.  Places are
    summed in strides and the strides put in a row, as a growing array is copied with
    every match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def places(stride: Column) -> Column:
        return F.aggregate(
            stride,
            F.struct(F.lit(0).alias("at"), F.array().cast(_MATCHES).alias("out")),
            lambda a, x: let(
                a["at"] + x["g"],
                lambda start: F.struct(
                    (start + F.length(x["m"])).alias("at"),
                    F.array_append(a["out"], F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("match"))).alias("out"),
                ),
            ),
        )

    def in_a_row(strides: Column) -> Column:
        starts = F.aggregate(
            strides,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, s: F.struct((a["at"] + s["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
            lambda a: a["out"],
        )
        moved = F.zip_with(
            starts, strides, lambda at, s: F.transform(s["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["match"].alias("match")))
        )
        return F.flatten(moved)

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STRIDE).cast("int")), lambda k: places(F.slice(p, k * STRIDE + 1, F.lit(STRIDE))))
    walked = let(let(pairs, cut), in_a_row)
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(_MATCHES))
