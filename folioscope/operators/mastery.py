"""Mastery of concepts: events folded into states, review schedules, what to quiz next, and grading."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from folioscope.functions import terms as tm
from folioscope.functions import text as tx

# Fixed values.
ALPHA, MASTERED, READY, CORRECT, EASE, LEAST_EASE = 0.5, 0.8, 0.5, 0.6, 2.5, 1.3
NOT_DUE, BLOCKED = 0.25, 0.35
DONT_KNOW = r"(?iU)^\s*(?:i\s+)?(?:don'?t|do not)\s+know\b|^\s*(?:no idea|idk|pass|skip|\?+)\s*[.!]*\s*$"
STATE = "struct<mastery:double,attempts:int,correct:int,exposures:int,ease:double,interval:int,reps:int,due:timestamp,last_score:double,last_seen:timestamp>"


def rounded(x: Column, digits: int) -> Column:
    """Half up at so many decimals, by one multiplication: alike in every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def new_state() -> Column:
    zero, none = F.lit(0), F.lit(None)
    named = {"mastery": F.lit(0.0), "attempts": zero, "correct": zero, "exposures": zero, "ease": F.lit(EASE), "interval": zero, "reps": zero, "due": none, "last_score": none, "last_seen": none}
    return F.struct(*(v.alias(k) for k, v in named.items())).cast(STATE)


def _half_up(x: float, digits: int) -> float:
    """As rounded, of a number."""
    scale = float(10**digits)
    return math.floor(x * scale + 0.5) / scale


def advance(state: tuple, score: float | None) -> tuple:
    """(mastery, attempts, correct, exposures, ease, interval, reps) after one event; a null or NaN score is an exposure."""
    mastery, attempts, correct, exposures, ease, interval, reps = state
    if score is None or score != score:
        return mastery, attempts, correct, exposures + 1, ease, interval, reps
    quality = round(score * 5)
    reps = 0 if quality < 3 else reps + 1
    interval = 1 if reps < 2 else 6 if reps == 2 else round(interval * ease)
    ease = _half_up(max(LEAST_EASE, ease + 0.1 - (5 - quality) * (0.08 + (5 - quality) * 0.02)), 3)
    return _half_up(mastery + ALPHA * (score - mastery), 4), attempts + 1, correct + (score >= CORRECT), exposures, ease, interval, reps


NEW = (0.0, 0, 0, 0, EASE, 0, 0)
FOLDED = [("mastery", "double"), *((k, "int") for k in ("attempts", "correct", "exposures")), ("ease", "double"), ("interval", "int"), ("reps", "int"), ("due", "long"), ("last_score", "double"), ("last_seen", "long")]
DAY, ROWS = 86_400_000_000, 1 << 13


def _folded(n: int):
    """Sorted batches of n key columns, the time in microseconds and the score: a row for each key, when its last event is past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64() if t == "double" else pa.int32() if t == "int" else pa.int64() for _, t in FOLDED]
        key, state, due, last, seen, done, types = None, NEW, None, None, None, [], []
        same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))

        def table() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types + kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])

        for batch in batches:
            types = [batch.schema.field(k).type for k in range(n)]
            columns = [batch.column(k).to_pylist() for k in range(n + 2)]
            for *own, ts, score in zip(*columns, strict=True):
                if key is None or not same(own, key):
                    if key is not None:
                        done.append((*key, *state, due, last, seen))
                    if len(done) >= ROWS:
                        yield table()
                    key, state, due, last = own, NEW, None, None
                state, seen = advance(state, score), ts
                if score is not None and score == score:
                    due, last = None if ts is None else ts + state[5] * DAY, _half_up(score, 3)
        if key is not None:
            done.append((*key, *state, due, last, seen))
        if done:
            yield table()

    return run


def fold(events: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """State of each key after its events (keys, ts, score, and an id for ties) in order of time, equal ones by score.

    The steps round, so a log has to be walked in order. Events are sorted by Spark, which spills, and pass in Arrow batches
    with one state at a time: the log of one learner may hold any share of all events and never is in memory as a whole."""
    order = order or ["ts", "event_id"]
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("score", F.col("score").cast("double"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order, "score").select(*keys, F.unix_micros("ts"), "score")
    schema = StructType([StructField(k, events.schema[k].dataType) for k in keys] + [StructField(k, {"double": DoubleType(), "int": IntegerType(), "long": LongType()}[t]) for k, t in FOLDED])
    states = rows.mapInArrow(_folded(len(keys)), schema)
    return states.select(*keys, *(F.timestamp_micros(k).alias(k) if t == "long" else k for k, t in FOLDED))


def status(attempts: Column, mastery: Column, exposures: Column) -> Column:
    return F.when((attempts > 0) & (mastery >= MASTERED), "mastered").when(attempts > 0, "learning").when(exposures > 0, "explored").otherwise("unseen")


def with_states(topics: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """topics with the state of each, a new one where there is none, and its status."""
    names = [f.name for f in states.schema if f.name not in keys]
    fresh = topics.join(states.select(*keys, F.struct(*names).cast(STATE).alias("_s")), keys, "left").withColumn("_s", F.coalesce("_s", new_state()))
    rows = fresh.select(*topics.columns, "_s.*")
    return rows.withColumn("status", status(F.col("attempts"), F.col("mastery"), F.col("exposures")))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Topics by status, and how many core ones there are and are mastered."""
    count = lambda c: F.count_if(c)
    core = F.col("tier") == "core"
    named = {k: F.col("status") == k for k in ("unseen", "explored", "learning", "mastered")} | {"total": F.lit(True), "core_total": core, "core_mastered": core & (F.col("status") == "mastered")}
    return rows.groupBy(*by).agg(*(count(c).alias(k) for k, c in named.items()))


def is_due(due: Column, now: Column) -> Column:
    return due.isNull() | (due <= now)


def percent(x: Column) -> Column:
    return F.concat(F.bround(F.round(x * 100, 9), 0).cast("int").cast("string"), F.lit("%"))


def quiz_target(rows: DataFrame, edges: DataFrame, steps: DataFrame, by: list[str], now: Column) -> DataFrame:
    """(by, term, priority, reason): the concept to quiz next. rows: topics with states; edges and steps of the path."""
    ready = rows.select(*by, F.col("term").alias("source"), F.col("mastery").alias("source_mastery"))
    needs = edges.select(*by, "source", F.col("target").alias("term")).join(ready, [*by, "source"])
    needs = needs.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("needs"), F.count_if(F.col("source_mastery") < READY).alias("open"))
    out = rows.join(needs, [*by, "term"], "left").join(steps.select(*by, "term", F.col("pos").alias("step")), [*by, "term"], "left")
    out = out.withColumn("is_due", is_due(F.col("due"), now)).withColumn("open", F.coalesce("open", F.lit(0)))
    priority = F.col("score") * (1 - F.col("mastery")) * F.when(F.col("is_due"), 1.0).otherwise(NOT_DUE) * F.when(F.col("open") > 0, BLOCKED).otherwise(1.0)
    out = out.withColumn("priority", F.round(priority, 9))
    order = Window.partitionBy(*by).orderBy(F.desc("priority"), F.asc_nulls_last("step"), "pos")
    best = out.withColumn("k", F.row_number().over(order)).where("k = 1")
    parts = F.array_compact(
        F.array(
            F.concat(F.initcap("tier"), F.lit(" concept (importance "), percent(F.col("score")), F.lit(")")),
            F.when(F.col("attempts") == 0, "not quizzed yet").otherwise(F.concat(F.lit("current mastery "), percent(F.col("mastery")))),
            F.when((F.col("attempts") > 0) & F.col("is_due"), "due for review"),
            F.when((F.col("needs") > 0) & (F.col("open") == 0), "its prerequisites are in place"),
        )
    )
    return best.select(*by, "term", "priority", F.array_join(parts, ", ").alias("reason"))


def prerequisite_gap(edges: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """(by, term, gap): prerequisites of each concept that aren't ready."""
    have = states.select(*by, F.col("term").alias("source"), "mastery")
    rows = edges.select(*by, "source", F.col("target").alias("term")).join(have, [*by, "source"], "left")
    return rows.where(F.coalesce("mastery", F.lit(0.0)) < READY).groupBy(*by, "term").agg(F.sort_array(F.collect_list("source")).alias("gap"))


def cloze(sentence: Column, pattern: Column) -> Column:
    """The sentence with every match blanked, if five words are left; else null."""
    blanked = F.regexp_replace(sentence, pattern, F.lit("_____"))
    return F.when(F.rlike(sentence, pattern) & (tx.words(F.replace(blanked, F.lit("_____"), F.lit(""))) >= 5), blanked)


def is_dont_know(answer: Column) -> Column:
    return (tx.words(answer) <= 5) & answer.rlike(DONT_KNOW)


@F.pandas_udf(DoubleType())
def _likeness(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def grade_exact(answer: Column, expected: Column) -> Column:
    """1 for the same words or a match, 0.75 for a near miss in spelling, else 0. The ratio of matching blocks is not an
    edit distance, hence a function on Arrow batches; it only runs where the rules before it do not decide."""
    a, e = tm.term_key(answer), tm.term_key(expected)
    exact = (a == e) | F.rlike(answer, tm.pattern(expected))
    alike = _likeness(F.when((a != "") & ~exact, a), F.when((a != "") & ~exact, e))
    return F.when(a == "", 0.0).when(exact, 1.0).when(alike >= 0.8, 0.75).otherwise(0.0)


def similarity_score(cosine: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - 0.25) / 0.5))


def blend(model: Column, similarity: Column) -> Column:
    return F.coalesce(0.6 * model + 0.4 * similarity, similarity)


def verdict(score: Column) -> Column:
    return F.when(score >= MASTERED, "correct").when(score >= 0.5, "partial").otherwise("incorrect")


def grade(kind: Column, answer: Column, expected: Column, model: Column, cosine: Column) -> tuple[Column, Column]:
    """(score, graded_by) of an answer to a cloze or a short question."""
    none = (F.trim(answer) == "") | is_dont_know(answer)
    score = F.when(none, 0.0).when(kind == "cloze", grade_exact(answer, expected)).otherwise(blend(model, similarity_score(cosine)))
    by = F.when(none, "no answer").when(kind == "cloze", "exact match").when(model.isNotNull(), "llm + embedding similarity").otherwise("embedding similarity")
    return score, by


def save_states(states: DataFrame, path: str) -> None:
    """The states of all keys as a table; the one before is replaced as a whole."""
    states.write.mode("overwrite").parquet(path)


def load_states(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """The states saved at a path; the empty table where none have been."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(empty.schema).parquet(path) if there else empty
