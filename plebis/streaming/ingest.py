"""Results as they come in: files to turnout, batch by batch.

An extension of the batch load: every micro-batch of long turnout rows is summed
and replaces what was known of its keys, as a load of the same rows would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plebis.operators.maintain import upsert_turnout
from plebis.sources.store import Store
from plebis.sources.store import upsert_turnout as upsert_turnout_versions


def turnout_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_into(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each batch writes the state of the table anew in ``folder``/v=<batch>, so a
    batch that runs twice writes the same and a reader takes the newest."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = f"{folder}/v={number - 1}"
        known = spark.read.parquet(before) if number else batch.limit(0)
        upsert_turnout(known, batch).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_versions(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each batch is a version of the store's turnout: only the rounds that come in are
    written anew, and a batch that runs twice gives the version it gave."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert_turnout_versions(store, batch.persist(), key=f"batch-{number}")
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
