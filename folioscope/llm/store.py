"""Tables and files that a job writes between its steps, in the folder that all executors share (``sources.store``), and
names of columns that do not clash with those of a caller's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioscope.sources import store as shared
from folioscope.sources.store import removed

#: Bytes of an Arrow batch between the JVM and Python: what a task holds at once does not hang on the length of texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes, not only the rows, of the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    small_batches(spark)
    return shared.place(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read from there: no lineage beyond it."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, t._path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark parses it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def every(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """All columns, or those named, by quoted names."""
    return [F.col(quoted(n)) for n in (df.columns if names is None else names)]


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until df has no such column in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def in_arrow(df: DataFrame, run, added: list[tuple] = (), keep: int | None = None) -> DataFrame:
    """df through a function of Arrow batches, with (name, type) columns added behind its own (the first ``keep`` of them).

    Spark's ``mapInArrow`` parses the names of columns; so they are plain ones on the way, and the function goes by position."""
    keep = len(df.columns) if keep is None else keep
    own = [StructField(f"c{k}", f.dataType) for k, f in enumerate(df.schema.fields)]
    out = [*own[:keep], *(StructField(f"c{k}", t) for k, (_, t) in enumerate(added, keep))]
    return df.toDF(*(f.name for f in own)).mapInArrow(run, StructType(out)).toDF(*df.columns[:keep], *(n for n, _ in added))


def keys_of(df: DataFrame) -> list[Column]:
    """128 bits of a row's doc_id and text in two longs: rows with both equal are one document, others are not."""
    own = [F.col("doc_id"), F.col("text")]
    return [F.xxhash64(*own), F.xxhash64(F.lit(1), *reversed(own))]
