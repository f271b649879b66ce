"""Streaming twins of batch operators: content deduplication and the mastery log.

Each runs over a folder of Parquet files with the availableNow trigger and returns what its sink holds. State is kept by
the RocksDB provider where the session sets it; checkpoints and sinks are in the folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators.mastery import NEW, advance
from folioscope.sources.store import content_hash, place


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files at a path, a file or a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path) if not _is_file(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def dedup_content(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash) of each content once, however often it comes."""
    out, mark = place(spark, "stream-dedup"), place(spark, "stream-mark")
    rows = _source(spark, path).select(content_hash(F.coalesce("text", F.lit(""))).alias("content_hash")).dropDuplicates(["content_hash"])
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


STATE = "mastery double, attempts int, correct int, exposures int, ease double, interval int, reps int"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    now = state.get if state.exists else NEW
    for score in rows["score"]:
        now = advance(now, None if pd.isna(score) else float(score))
    state.update(now)
    yield pd.DataFrame([(*key, *now)], columns=["user_id", "concept", "mastery", "attempts", "correct", "exposures", "ease", "interval", "reps"])


def mastery(spark: SparkSession, path: str) -> DataFrame:
    """The state of each (user_id, concept) after all events of the stream.

    Within a micro-batch events go by (ts, event_id); over batches in order of arrival, as a schedule can't be revised."""
    out, mark = place(spark, "stream-mastery"), place(spark, "stream-mark")
    score = F.when(F.col("event_type") != "view", F.least(F.col("value") / 100, F.lit(1.0)))
    rows = _source(spark, path).select("user_id", F.col("event_type").alias("concept"), F.col("ts").cast("timestamp").alias("ts"), "event_id", score.alias("score"))
    states = rows.groupBy("user_id", "concept").applyInPandasWithState(_update, f"user_id long, concept string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    states.writeStream.foreachBatch(keep).option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    held = spark.read.parquet(out)
    value = F.struct("batch", *[c.split()[0] for c in STATE.split(", ")])
    return held.groupBy("user_id", "concept").agg(F.max(value).alias("s")).select("user_id", "concept", "s.*").drop("batch")
