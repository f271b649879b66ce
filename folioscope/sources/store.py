"""Reading and writing tables: parquet and JSON stores, and tables written between the steps of a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPLOAD_BYTES, MIN_TEXT = 50 << 20, 20
UNFOLDS = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    A session that names none gets a temporary folder if all its executors are threads of this machine; elsewhere that
    is an error, as each executor would write to a disk of its own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="folioscope-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


_MARKED: set[str] = set()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one of this application's own that goes when the driver ends."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _MARKED:
        _MARKED.add(own)
        where, files = _file_system(spark, own)
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    where, files = _file_system(spark, path)
    files.delete(where, True)


def stored(df: DataFrame, name: str = "step", by: str | None = None, dealt: bool = False) -> DataFrame:
    """The rows of df, written once and read from there, so that what follows shares them and nothing runs twice.

    by: a column that what follows joins and groups by, alone or with others. Tables dealt by it into buckets, UNFOLDS for
    each partition of a shuffle as their rows unfold into many, are then joined and grouped where they lie. Its groups have
    to be bounded: no bucket is split. dealt: the rows come from such a repartition already.
    The catalogue knows such a table only until it is read."""
    spark = df.sparkSession
    path = place(spark, name)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # buckets by a part of the keys will do
    n, known = UNFOLDS * int(spark.conf.get("spark.sql.shuffle.partitions")), f"folioscope_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, by)).write.bucketBy(n, by).sortBy(by).option("path", path).option("compression", "zstd").saveAsTable(known)
    rows = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # an external table: its files stay
    return rows


def write_json(df: DataFrame, path: str) -> None:
    """A JSON document store; a job's files appear as a whole or not at all."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON document store; records that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def content_hash(text: Column) -> Column:
    """SHA-256 of the stripped text."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", ""), 256)


def first_of_content(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash, first_doc_id, reused): documents with equal content, of which the first one counts.

    Minima are taken before the shuffle, and only content that occurs twice goes into the join. Hashes and their first
    documents are written before, so that Spark can split the partition of content that a third of all rows share."""
    rows = stored(docs.select("doc_id", content_hash(F.col("text")).alias("content_hash")), "hashes")
    firsts = rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(stored(firsts.drop("n"), "firsts"), "content_hash", "left")
    return rows.withColumn("first_doc_id", F.coalesce("first_doc_id", "doc_id")).withColumn("reused", F.col("doc_id") != F.col("first_doc_id"))


def admit_text(docs: DataFrame) -> DataFrame:
    """(doc_id, verdict): texts long enough and not too large."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""))
    return docs.select("doc_id", F.when(F.octet_length(text) > UPLOAD_BYTES, "too large").when(size < MIN_TEXT, "too short").otherwise("admitted").alias("verdict"))


def admit_upload(files: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(name, verdict) of files (name, content): suffix, size and a page that is not blank."""
    return files.select(
        "name",
        F.when(~F.lower("name").endswith(suffix), "not a document")
        .when(F.octet_length("content") > UPLOAD_BYTES, "too large")
        .when(F.trim(F.col("content").cast("string")) == "", "blank")
        .otherwise("admitted")
        .alias("verdict"),
    )
