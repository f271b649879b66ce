from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate as op
from tests.llm.common import AWKWARD, documents, with_clashes

BLANK = str.maketrans({c: " " for c in string.punctuation})


def grams(text):
    words = (text or "").translate(BLANK).encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items):
    out = set()
    sets = [(k, grams(t)) for k, t in items]
    for d, t in docs:
        own = grams(t)
        out |= {(d, k, len(s), len(s & own)) for k, s in sets if s and len(s & own) >= 0.8 * len(s)}
    return out


def test_sf_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {tuple(r)[:4] for r in op.query(spark, sf).collect()}
    assert got == brute(docs, items)
    assert got


def test_short_items_in_long_texts(spark):
    """Edited items inside texts of thousands of words: none of those at 0.8 or more is missed, at any place."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(n, " ".join(word() for _ in range(rnd.choice([5, 6, 9, 12, 30, 70, 200])))) for n in range(60)]
    docs = []
    for d in range(150):
        text = [word() for _ in range(rnd.choice([0, 30, 5000]))]
        for _, t in rnd.sample(items, 2):
            w = t.split()
            if rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = "CHANGED"
            at = rnd.randint(0, len(text))
            text[at:at] = [x.upper() + "," for x in w]
        docs.append((d, " \n".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = op.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {tuple(r) for r in found} == want
    assert len(want) > 150


def test_blocks_of_items(spark, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {tuple(r) for r in op.leaks(docs, items).collect()}
    monkeypatch.setattr(op, "BLOCK_BYTES", 3000)
    assert {tuple(r) for r in op.leaks(docs, items).collect()} == whole


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    df = with_clashes(documents(spark, texts))
    items = documents(spark, [*AWKWARD, "dup line here dup line here"]).withColumnRenamed("doc_id", "item_id")
    got = {(r.doc_id, r.item_id) for r in op.leaks(df, items).collect()}
    assert got == {(d, k) for d, k, *_ in brute(list(enumerate(texts)), list(enumerate([*AWKWARD, "dup line here dup line here"])))}
    assert op.leaks(df, items.limit(0)).count() == 0


def test_stage_keeps_clean_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r.doc_id for r in op.query(spark, sf).collect()}
    kept = op.stage(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_stage_judges_each_row_by_itself(spark, tmp_path):
    """Equal and null ids over different texts, odd names of columns, repeated items, no items, no documents."""
    leak = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(1, leak), (1, leak), (None, leak), (2, None), (3, "short one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "clean text", 1), (None, f"before {leak} after", 2), (7, leak.upper(), 3), (7, "other clean text", 4), (None, None, 5), (8, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    df = df.select("*", *(F.lit("x").alias(name) for name in ("_k`ey", "_key", "_lines", "_score", "item_id", "a.b")))
    kept = op.stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(r[2] for r in kept.collect()) == [1, 4, 5, 6]
    assert op.stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert op.without_leaks(df, df.limit(0).select(F.col("doc_id").alias("item_id"), "text")).count() == 6
    assert op.leaks(df, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).count() == 6  # two texts, three items


def test_items_that_share_their_shingles(spark):
    """Many items of one template: windows are looked at once, whatever the number of items."""
    stem = " ".join(f"w{k}" for k in range(30))
    items = [(n, f"{stem} ending{n}") for n in range(300)]
    docs = [(0, f"x y {stem} ending7 z"), (1, stem), (2, "nothing here " * 50)]
    got = {tuple(r) for r in op.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) == 600
