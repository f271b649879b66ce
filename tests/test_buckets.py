"""Tables dealt by document: what follows joins and groups them where they lie, and nothing is looked for twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import concepts as cc
from folioscope.operators import context as cx
from folioscope.operators import paths as ps
from folioscope.operators import replies as rp
from folioscope.sources.store import stored

TEXT = (
    "Gradient descent is a method that lowers a loss. A learning rate scales each step of gradient descent. "
    "Momentum relies on gradient descent and on a learning rate. Stochastic gradient descent is a variant of gradient descent. "
    "Momentum tries the step before it again. The learning rate of momentum is often small."
)


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def analysis(spark):
    pages = spark.createDataFrame([(k, 1, TEXT.replace("method", f"method{k}")) for k in range(9)], "doc_id long, page int, text string")
    return cc.Analysis(cx.Context(pages, kind="text"))


def test_tables_by_document_meet_without_a_shuffle(spark):
    before = len(spark.catalog.listTables())
    left = stored(spark.range(500).select((F.col("id") % 50).alias("doc_id"), F.col("id").alias("x")), "left", "doc_id")
    right = stored(spark.range(500).select((F.col("id") % 50).alias("doc_id"), F.col("id").alias("x"), F.lit(1).alias("y")), "right", "doc_id")
    both = left.hint("merge").join(right, ["doc_id", "x"]).groupBy("doc_id", "x").agg(F.sum("y").alias("n"))
    assert "Exchange" not in plan(both)
    assert both.count() == 500 and both.agg(F.sum("n")).first()[0] == 500
    assert len(spark.catalog.listTables()) == before


def test_steps_within_documents_move_no_rows(spark):
    a = analysis(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (cc.heard(a.ctx, a.mentions), cc.mentions(a.ctx, a.candidates), ps.introductions(a.heard)):
            assert "Exchange" not in plan(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_is_heard_equals_the_sentences_with_text(spark):
    a = analysis(spark)
    cols = ["doc_id", "term", "sent", "sec", "page", "words", "defines"]
    wanted = sorted(map(tuple, ps.occurrences(a.ctx, a.mentions).select(*cols).collect()))
    assert wanted and sorted(map(tuple, a.heard.select(*cols).collect())) == wanted
    assert any(r[-1] for r in wanted) and not all(r[-1] for r in wanted)


def test_mentions_at_hand_equal_those_looked_for(spark):
    a = analysis(spark)
    new = spark.createDataFrame([(k, "step before") for k in range(9)], "doc_id long, term string")
    terms = stored(a.topics.select("doc_id", "term").union(new).distinct(), "terms", "doc_id")
    found, heard = rp.sought(a, terms)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, cc.mentions(a.ctx, terms).collect()))
    assert sorted(map(tuple, heard.collect())) == sorted(map(tuple, cc.heard(a.ctx, found).collect()))


def test_only_the_first_shared_sentences_state_a_dependency(spark):
    """A statement counts among the first SHARED sentences of a pair, and not beyond them."""
    for gap, stated in ((ps.SHARED - 1, True), (ps.SHARED, False)):
        text = " ".join(["Plain alpha goes along with a plain omega here."] * gap + ["The omega relies on alpha in all of these cases."])
        ctx = cx.Context(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string"), kind="text")
        topics = spark.createDataFrame([(1, "alpha", "core", 1), (1, "omega", "core", 2)], "doc_id long, term string, tier string, pos int")
        edges = ps.prerequisite_edges(ctx, topics, cc.mentions(ctx, topics.select("doc_id", "term"))).collect()
        assert [r.reason for r in edges if (r.source, r.target) == ("alpha", "omega")] == (["stated_dependency"] if stated else [])
