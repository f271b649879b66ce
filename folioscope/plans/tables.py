"""The engine's inputs, drawn from the test tables.

A paged document ("binder") is a source's documents within a block of BLOCK consecutive ids, one to a page, so that a
source of any size gives many binders of at most BLOCK pages. A text document is a row of documents, on one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.sources.store import table

BLOCK = 256


def binders(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of binders."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.concat("source", F.lit("/"), F.expr(f"doc_id div {BLOCK}").cast("string")).alias("doc_id"), F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).cast("int")
    return rows.select("doc_id", page.alias("page"), "text")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Text documents, each on one page."""
    return table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def inline(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table."""
    return spark.createDataFrame(rows, columns)


#: Terms that occur in all test tables.
PROBES = ["the", "and", "of the", "is the", "er", "this"]


def probes(spark: SparkSession) -> DataFrame:
    return inline(spark, "term string", [(t,) for t in PROBES])


def learners(spark: SparkSession, sf: str) -> DataFrame:
    """A log of scores and exposures by (user_id, concept), from events: views are exposures, values scores out of 100."""
    score = F.when(F.col("event_type") != "view", F.least(F.col("value") / 100, F.lit(1.0)))
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("concept"), "ts", "event_id", score.alias("score"))
