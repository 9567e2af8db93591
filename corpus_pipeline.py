"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; its result is written as Parquet and read again as the next
one's ``docs``, and removed when the stage after that has been written.  All but
the last return the columns of ``docs``.

Defined results.  An empty table gives an empty one at every stage.  Null and empty
texts are scored like any text, are copies of nothing, hold no secrets, have size 0
in the mixture and encode to no ids.  Rows with a null id are never copies.  Of
rows that repeat one stays in the second stage.  Ties go to the smallest id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plebis.llm import bpe, jaccard, mixing, secrets, toxicity
from plebis.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores one half or more go; null text is scored
    as the empty one, repeated rows alike."""
    scored = toxicity.apply(docs, toxicity.model_for(spark, docs, sf_dir), into="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked by a Jaccard of 80 % over
    five-word shingles, stays: that of the smallest id."""
    return jaccard.keep_one(docs, n=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are replaced by a mark; every document stays, null texts null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture draws it, in the mixture's order; null
    and empty texts have size 0 and go out with their block."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mixture; a null text has no
    tokens."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages use a trained network, hashes and a tokenizer: no SQL for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            _remove(spark, earlier)
        earlier = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """A folder of this run that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
