"""A corpus from raw documents: STAGES in order, each written as Parquet and read again by the next; run() applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, line_dedup, packing, quality, simhash
from folioscope.llm.store import written

#: (name, function of (spark, docs, sf_dir)).
STAGES = [
    ("quality_classifier", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: A trained model and winnowed line hashes decide on rows, which SQL cannot express; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of all documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
