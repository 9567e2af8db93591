"""National summaries that are known as totals only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Year, registered, cast, valid, invalid.
SUMMARIES = (
    (1992, 3575032, 2677764, 2627061, 50703),
    (1997, 4061479, 2218448, 2178792, 39656),
)
COUNTY_CODE = "99"


def summaries(spark: SparkSession) -> DataFrame:
    """One row a year, placed on the synthetic county."""
    rows = [(COUNTY_CODE, *s) for s in SUMMARIES]
    return spark.createDataFrame(
        rows, "county_code string, year int, registered_voters long, ballots_cast long, valid_ballots long, invalid_ballots long"
    )
