"""Words of headings, also beside digits and letters beyond a to z, and plurals whose folded form is short."""

from __future__ import annotations

import duckdb

from folioscope.operators import concepts as cc
from folioscope.plans import catalogue, oracles


def test_every_word_of_a_heading_is_found(spark, tmp_path):
    html = ["<h1>inhe.83@mail0.example.com thes</h1>", "<h1>token = 2abc3ff2ca8fb</h1>", "<h1>De ciónboesci cióncies</h1>", "<h1>Tries and Flies</h1>", "<h1></h1>", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        wanted = sorted(db.execute(f"SELECT doc_id, term, heading FROM ({oracles.oracle_sql()['heading_weight']})").fetchall())
    assert sorted(map(tuple, catalogue.queries()["heading_weight"](spark, str(tmp_path)).select("doc_id", "term", "heading").collect())) == wanted
    assert {"mail", "abc", "ncies", "tries"} <= {t for _, t, _ in wanted}


def test_blank_terms_and_parts_of_words_stay_unfound(spark):
    terms = spark.createDataFrame([(1, "  "), (1, "art"), (1, "parties")], "doc_id long, term string")
    headings = spark.createDataFrame([(1, "A  -  Party", 2)], "doc_id long, text string, level int")
    assert [tuple(r) for r in cc.heading_weight(terms, headings).collect()] == [(1, "parties", 2.0)]
