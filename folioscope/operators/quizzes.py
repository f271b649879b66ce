"""The next quiz of each document: what to ask about, from which text, and the question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import terms as tm
from folioscope.functions import text as tx
from folioscope.operators import mastery as ms
from folioscope.operators import paths as ps
from folioscope.operators import replies as rp
from folioscope.operators import retrieval as rt
from folioscope.operators.context import Context, chunks
from folioscope.sources.store import stored

SOURCES, PENDING = 3, 500
PICKED = "You picked this concept"


def targets(topics: DataFrame, steps: DataFrame, edges: DataFrame, states: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """(doc_id, term, reason): the concept that was asked for (doc_id, concept), with what it builds on and isn't mastered
    yet, else the one that is due most. A concept that is not among a document's topics gives no row."""
    rows = ms.with_states(topics, states, ["doc_id", "term"])
    due = ms.quiz_target(rows, edges, steps.select("doc_id", "term", "pos"), ["doc_id"], now).select("doc_id", "term", "reason")
    named = asked.select("doc_id", tm.term_key(F.col("concept")).alias("key")).join(topics.select("doc_id", "term", "pos", tm.term_key(F.col("term")).alias("key")), ["doc_id", "key"])
    named = named.groupBy("doc_id").agg(F.min_by("term", "pos").alias("term"))
    gap = ms.prerequisite_gap(edges, rows, ["doc_id"])
    tip = F.concat(F.lit(f"{PICKED}. Tip: it builds on "), F.array_join("gap", ", "), F.lit(", which you haven't mastered yet"))
    named = named.join(gap, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce(tip, F.lit(PICKED)).alias("reason"))
    return due.join(asked.select("doc_id"), "doc_id", "left_anti").unionByName(named)


def excerpts(ctx: Context, wanted: DataFrame, most: int = SOURCES) -> DataFrame:
    """(doc_id, pos from 0, label, text): the chunks of a document that speak most of its wanted term (doc_id, term).

    A document has an index of its own; only chunks that hold a word of the term are weighed."""
    own = stored(chunks(ctx.texts).select("doc_id", "chunk", "page_start", "page_end", "text", tm.tokens(F.col("text")).alias("t")), "chunks", "doc_id")
    sizes = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"))
    words = wanted.select("doc_id", F.explode(F.array_distinct(tm.tokens(F.col("term")))).alias("w"))
    held = own.select("doc_id", "chunk", F.size("t").alias("length"), "t").join(words, "doc_id")
    held = held.withColumn("tf", F.size(F.filter("t", lambda x: x == F.col("w")))).where("tf > 0").drop("t")
    held = held.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "w"))).join(sizes, "doc_id")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (rt.K1 + 1) / (F.col("tf") + rt.K1 * (1 - rt.B + rt.B * F.col("length") / F.col("mean")))
    best = rt.top(held.groupBy("doc_id", "chunk").agg(F.sum(weight).alias("score")), "doc_id", "chunk", most)
    label = tx.source_label(F.lit(ctx.kind), F.col("page_start"), F.col("page_end"), F.col("chunk"))
    return best.join(own, ["doc_id", "chunk"]).select("doc_id", (F.col("rank") - 1).alias("pos"), label.alias("label"), "text")


def next_quiz(ctx: Context, topics: DataFrame, found: DataFrame, steps: DataFrame, edges: DataFrame, states: DataFrame, asked: DataFrame, replies: DataFrame, now: Column, heard: DataFrame | None = None) -> DataFrame:
    """(doc_id, concept, reason, kind, question, answer, generated_by, context, quotes): a model's question, given its reply
    (doc_id, raw), else a cloze from the first of the concept's quotes that can be blanked. kind is null where there is not
    enough text for either."""
    wanted = stored(targets(topics, steps, edges, states, asked, now), "targets", "doc_id")
    evidence = ps.concept_evidence(ctx, topics.join(wanted.select("doc_id", "term"), ["doc_id", "term"], "left_semi"), found, steps, edges, heard=heard)
    evidence = stored(evidence.select("doc_id", "term", "definitions", "mentions"), "evidence", "doc_id")
    held = rp.quiz_context(evidence, excerpts(ctx, wanted), ["doc_id"])
    quotes = F.concat(F.coalesce("definitions", F.expr("array()")), F.coalesce("mentions", F.expr("array()")))
    blanks = evidence.select("doc_id", tm.pattern(F.col("term")).alias("p"), F.posexplode(quotes).alias("k", "q"))
    blanks = blanks.withColumn("cloze", ms.cloze(F.col("q.text"), F.col("p"))).where("cloze is not null")
    blanks = blanks.groupBy("doc_id").agg(F.min_by("cloze", "k").alias("cloze"), F.min_by("q", "k").alias("quote"))
    rows = wanted.join(held, "doc_id").join(replies.select("doc_id", rp.parse_quiz(F.col("raw")).alias("quiz")), "doc_id", "left").join(blanks, "doc_id", "left")
    short, cloze = F.col("quiz").isNotNull(), F.col("cloze").isNotNull()
    return rows.select(
        "doc_id",
        F.col("term").alias("concept"),
        "reason",
        F.when(short, "short").when(cloze, "cloze").alias("kind"),
        F.when(short, F.col("quiz.question")).otherwise(F.col("cloze")).alias("question"),
        F.when(short, F.col("quiz.answer")).when(cloze, F.col("term")).alias("answer"),
        F.when(short, "llm").when(cloze, "cloze").alias("generated_by"),
        "context",
        F.when(short, F.col("quotes")).when(cloze, F.array("quote")).alias("quotes"),
    )


def pending(quizzes: DataFrame, made: str, key: str, most: int = PENDING) -> DataFrame:
    """The quizzes that still wait for an answer: first in, first out, at most so many."""
    return rt.latest_sessions(quizzes, made, key, most)
