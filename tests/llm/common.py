"""Small tables with every awkward case: nulls, blanks, ties, repeated rows, clashing columns, long texts."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = SCHEMA + ", count long, root long, a string, t string, fp string, print string, _key long"


def rows(texts, start=0):
    return [(i + start, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def documents(spark, texts, start=0):
    return spark.createDataFrame(rows(texts, start), SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    for name in ("count", "root", "a", "t", "fp", "print", "spans", "kept", "score", "ids", "b", "row"):
        df = df.withColumn(name, F.lit("x"))
    return df


AWKWARD = ["", None, " \n\t", "one", "ONE two", "x" * 5000, "word " * 40000, "dup line here\n" * 300, "é ñ ü ß", "a\x00b c"]

#: Names that the operators use inside, and some that Spark has to quote.
CLASHES = (
    "count", "root", "a", "t", "fp", "print", "spans", "kept", "score", "ids", "b", "row", "set", "own", "key", "k", "k1", "k2", "h", "label", "rid", "n", "part", "c0", "c1",
    "_lines", "_gone", "_words", "_spans", "_score", "_key", "_own", "_id", "_k1", "_k2", "item_id", "tail", "shard", "a.b", "back`tick", "two words",
)


def clashing(df):
    """df with a column of each of these names."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(n) for n in CLASHES))


def other_texts(spark):
    """Rows that share a doc_id, or have none, over different long texts, with clashing columns."""
    words = lambda seed: " ".join(f"w{seed}x{i}" for i in range(60))
    rows = [(None, words(1)), (None, words(2)), (5, words(3)), (5, words(4)), (5, f"{words(6)}\n{words(7)}"), (6, words(5))]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))
