"""Concepts of documents: nomination by TF-IDF, mentions, four signals, graph centrality, ranking.

All groups are within a document; at most FEATURES terms of a document are measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import terms as tm
from folioscope.functions import text as tx
from folioscope.functions.lexicon import content_stops, english
from folioscope.operators.context import Context
from folioscope.sources.store import stored

# Weights, boosts and limits.
WEIGHTS = {"frequency": 0.30, "spread": 0.25, "heading": 0.20, "centrality": 0.25}
TIERS = {1: 3.0, 2: 2.0, 3: 1.5}
DEFINITION, FIGURE, EXAMPLE, ENDORSED = 1.3, 1.2, 1.15, 2.0
CORE, SUPPORTING = 0.55, 0.30
TOPICS, MERGED, FEATURES, SCANNED = 20, 25, 50, 300
EDGE, SHOWN, FRAGMENT = 0.05, 0.10, 0.7


def branding(pages: DataFrame) -> DataFrame:
    """(doc_id, word) of words on the first and the last page, three times in all, and on no page between; five pages or more."""
    sizes = pages.groupBy("doc_id").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0))
    rows = pages.join(sizes, "doc_id").select("doc_id", "page", "last", F.explode(found).alias("word")).where(~F.col("word").isin(*content_stops()))
    at = lambda c: F.sum(F.when(c, 1).otherwise(0))
    page, last = F.col("page"), F.col("last")
    sums = rows.groupBy("doc_id", "word").agg(at(page == 1).alias("a"), at(page == last).alias("z"), at((page != 1) & (page != last)).alias("m"))
    return sums.where("a > 0 and z > 0 and m = 0 and a + z >= 3").select("doc_id", "word")


def nominate(sections: DataFrame, brands: DataFrame | None = None, most: int = FEATURES) -> DataFrame:
    """(doc_id, term, score, ord from 1): candidate terms of one or two words by their mean TF-IDF over sections."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-zA-Z][a-zA-Z]+\b"), F.lit(0)), lambda t: ~t.isin(*content_stops()))
    rows = sections.select("doc_id", "sec", words.alias("w"))
    if brands is not None:
        held = brands.groupBy("doc_id").agg(F.collect_set("word").alias("brands"))
        rows = rows.join(held, "doc_id", "left")
        rows = rows.withColumn("w", F.when(F.col("brands").isNull(), F.col("w")).otherwise(F.filter("w", lambda t: ~F.array_contains("brands", t))))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    counts = rows.select("doc_id", "sec", F.explode(F.concat("w", pairs)).alias("term")).groupBy("doc_id", "sec", "term").agg(F.count(F.lit(1)).alias("tf"))
    sizes = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    least = F.when(F.col("n") < 8, 1).otherwise(2)
    share = F.when(F.col("n") < 3, 1.0).when(F.col("n") < 8, 0.95).otherwise(0.7)
    vocab = counts.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), F.collect_list(F.struct("sec", "tf")).alias("secs")).join(sizes, "doc_id")
    strict = (F.col("df") >= least) & (F.col("df") <= share * F.col("n")) & (share * F.col("n") >= least)
    doc = Window.partitionBy("doc_id")
    vocab = vocab.withColumn("ok", strict).withColumn("any", F.max("ok").over(doc)).where("ok or not any")
    vocab = vocab.withColumn("k", F.row_number().over(doc.orderBy(F.desc("total"), "term"))).where(F.col("k") <= most)
    rows = vocab.select("doc_id", "term", "df", "n", F.explode("secs").alias("s")).select("doc_id", "term", "df", "n", "s.sec", "s.tf")
    weight = F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    rows = rows.withColumn("x", weight)
    rows = rows.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id", "sec"))))
    mean = rows.groupBy("doc_id", "term").agg((F.sum("x") / F.first("n")).alias("score"))
    return mean.withColumn("ord", F.row_number().over(doc.orderBy(F.desc(F.round("score", 9)), "term")).cast("int"))


def stem(term: Column) -> Column:
    """What every match of a term contains: its last word without an ending that changes in the plural."""
    return F.regexp_replace(tm.singular(F.element_at(F.split(tm.concept_key(term), " "), -1)), "y$", "")


def mentions(ctx: Context, terms: DataFrame) -> DataFrame:
    """(doc_id, term, sent, sent_sec, at, stop, sec, surface): every match; offsets in the document's text, sec by offset.

    Sentences meet terms by document; a plain substring test on the last word's stem comes before any pattern. Terms lead
    the join, so that each one's sentences come in a run and its pattern compiles once for it."""
    known = terms.select("doc_id", "term", tm.pattern(F.col("term")).alias("pattern"), stem(F.col("term")).alias("stem"))
    sents = ctx.sentences.select("doc_id", "sent", F.col("sec").alias("sent_sec"), F.col("start").alias("from"), "text", F.lower("text").alias("low"))
    rows = known.hint("merge").join(sents, "doc_id").where(F.contains("low", F.col("stem")) & (F.regexp_instr("text", F.col("pattern")) > 0))  # a blank stem holds everywhere
    rows = rows.select("doc_id", "term", "sent", "sent_sec", "from", F.explode(tm.spans(F.col("text"), F.col("pattern"))).alias("m"))
    starts = ctx.sections.groupBy("doc_id").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    at = F.col("from") + F.col("m.at")
    sec = F.size(F.filter("starts", lambda s: s <= at)) - 1
    return rows.join(starts, "doc_id").select("doc_id", "term", "sent", "sent_sec", at.alias("at"), (F.col("from") + F.col("m.stop")).alias("stop"), sec.alias("sec"), F.col("m.surface").alias("surface"))


def heard(ctx: Context, found: DataFrame) -> DataFrame:
    """(doc_id, term, sent, sec, page, words, defines): the sentences that mention each term, and whether they define it.

    Only the text of sentences that may define something goes along; a term's sentences come in a run, so that its pattern
    compiles once."""
    may = tm.may_define(F.col("text"))
    sents = ctx.sentences.select("doc_id", "sent", "sec", "page", "words", F.when(may, F.col("text")).alias("told"))
    rows = found.select("doc_id", "term", "sent").distinct().join(sents, ["doc_id", "sent"]).sortWithinPartitions("doc_id", "term")
    own = F.when(F.col("told").isNotNull(), F.regexp_instr("told", tm.definition_pattern(tm.pattern_body(F.col("term")))) > 0).otherwise(False)
    return rows.select("doc_id", "term", "sent", "sec", "page", "words", own.alias("defines"))


def surface_forms(found: DataFrame) -> DataFrame:
    """(doc_id, term, form): the commonest spelling, the first seen among equals; lower case but for inner capitals."""
    forms = found.withColumn("form", F.regexp_replace("surface", r"(?U)\s+", " ")).groupBy("doc_id", "term", "form").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    best = forms.groupBy("doc_id", "term").agg(F.max_by("form", F.struct("n", -F.col("first"))).alias("form"))
    return best.withColumn("form", F.when(F.expr("substring(form, 2)").rlike(r"\p{Lu}"), F.col("form")).otherwise(F.lower("form")))


def drop_fragments(terms: DataFrame, found: DataFrame) -> DataFrame:
    """terms that are mentioned, and not mostly inside longer terms."""
    size = lambda c: F.size(F.split(tm.concept_key(c), " "))
    short = terms.select("doc_id", "term", tm.pattern(F.col("term")).alias("p"), stem(F.col("term")).alias("stem"), size(F.col("term")).alias("n"))
    long = terms.select("doc_id", F.col("term").alias("longer"), size(F.col("term")).alias("m"))
    pairs = short.join(long, "doc_id").where((F.col("m") > F.col("n")) & F.contains(F.lower("longer"), F.col("stem")) & F.rlike("longer", F.col("p"))).select("doc_id", "term", "longer")
    spans = found.select("doc_id", F.col("term").alias("longer"), F.struct("at", "stop").alias("span"))
    around = pairs.join(spans, ["doc_id", "longer"]).groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    rows = found.join(around, ["doc_id", "term"], "left")
    before = F.element_at(F.filter("spans", lambda s: s["at"] <= F.col("at")), -1)
    inside = F.coalesce(F.when(F.size(F.filter("spans", lambda s: s["at"] <= F.col("at"))) > 0, (F.col("at") < before["stop"]).cast("int")), F.lit(0))
    kept = rows.groupBy("doc_id", "term").agg(F.avg(inside).alias("inside")).where(F.col("inside") < FRAGMENT)
    return terms.join(kept.select("doc_id", "term"), ["doc_id", "term"], "left_semi")


def heading_weight(terms: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, term, heading): the best tier among the headings that match the term or one of its content words.

    A word is always found as it stands, also where its folded form is too short for both endings (tries, try)."""
    words = F.filter(F.split(tm.concept_key(F.col("term")), " "), lambda w: (F.length(w) > 2) & ~w.isin(*english()))
    wanted = terms.select("doc_id", "term", F.explode(F.array_distinct(F.concat(F.array("term"), words))).alias("part"))
    key = tm.concept_key(F.col("part"))
    own = F.when(key == "", tm.NEVER).otherwise(F.concat(F.lit(tm.BEFORE + "\\Q"), key, F.lit("\\E" + tm.AFTER)))
    wanted = wanted.withColumn("p", F.concat(tm.pattern(F.col("part")), F.lit("|"), own))
    tier = F.when(F.col("level") == 1, TIERS[1]).when(F.col("level") == 2, TIERS[2]).otherwise(TIERS[3])
    hits = wanted.join(headings.select("doc_id", F.col("text").alias("heading_text"), tier.alias("tier")), "doc_id").where(F.rlike("heading_text", F.col("p")))
    return hits.groupBy("doc_id", "term").agg(F.max("tier").alias("heading"))


def cooccurrence(found: DataFrame, sizes: DataFrame, least: float = EDGE) -> DataFrame:
    """(doc_id, source, target, weight): share of sections with both terms; source before target by ord."""
    held = found.select("doc_id", "sec", "term", "ord").distinct()
    a, b = held.alias("a"), held.alias("b")
    pairs = a.join(b, ["doc_id", "sec"]).where(F.col("a.ord") < F.col("b.ord"))
    counted = pairs.groupBy("doc_id", F.col("a.term").alias("source"), F.col("b.term").alias("target")).agg(F.count(F.lit(1)).alias("k"))
    return counted.join(sizes, "doc_id").select("doc_id", "source", "target", (F.col("k") / F.col("n")).alias("weight")).where(F.col("weight") >= least)


def _ranks(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """PageRank of a small undirected graph by power iteration; equal ranks where it does not settle."""
    m = np.zeros((n, n))
    m[i, j] = m[j, i] = w
    out = m.sum(1)
    loose = out == 0
    m = m / np.where(loose, 1, out)[:, None]
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = damping * (x @ m + x[loose].sum() / n) + (1 - damping) / n
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    return np.full(n, 1 / n)


def pagerank(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, term, centrality): rank over the largest rank. A row holds a document's graph, of at most FEATURES nodes, as
    arrays of numbers; ranks come back as an array and meet their terms again by position."""
    nodes = terms.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "term"))).alias("nodes"))
    nodes = nodes.withColumn("names", F.transform("nodes", lambda x: x["term"]))
    links = edges.groupBy("doc_id").agg(*(F.collect_list(k).alias(k) for k in ("source", "target", "weight")))  # one order for all three
    rows = nodes.join(links, "doc_id", "left")
    place = lambda k: F.transform(F.coalesce(k, F.array().cast("array<string>")), lambda t: F.array_position("names", t).cast("int") - 1)
    rows = rows.select("doc_id", "names", F.size("names").alias("n"), place("source").alias("i"), place("target").alias("j"), F.coalesce("weight", F.array().cast("array<double>")).alias("w"))
    kind = dict(terms.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ranks = [_ranks(n, i, j, w) for n, i, j, w in zip(frame["n"], frame["i"], frame["j"], frame["w"], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "names": frame["names"], "rank": [r / r.max() for r in ranks]})

    out = rows.mapInPandas(run, f"doc_id {kind}, names array<string>, rank array<double>")
    return out.select("doc_id", F.explode(F.arrays_zip("names", "rank")).alias("x")).select("doc_id", F.col("x.names").alias("term"), F.col("x.rank").alias("centrality"))


def exam_signals(ctx: Context, terms: DataFrame, found: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, definition, figure, example): whether a sentence defines the term, and the flags of its sections.

    told: what heard() gives, if it is at hand."""
    order = Window.partitionBy("doc_id", "term").orderBy("sent")
    told = heard(ctx, found) if told is None else told
    told = told.select("doc_id", "term", "sent", "defines").withColumn("k", F.row_number().over(order)).where(F.col("k") <= SCANNED)
    told = told.groupBy("doc_id", "term").agg(F.max("defines").alias("definition"))
    flags = found.select("doc_id", "term", "sec").distinct().join(ctx.sections.select("doc_id", "sec", "flags"), ["doc_id", "sec"])
    flags = flags.groupBy("doc_id", "term").agg(*(F.max(F.array_contains("flags", k)).alias(k) for k in ("figure", "example")))
    return told.join(flags, ["doc_id", "term"])


def measure(ctx: Context, terms: DataFrame, found: DataFrame, told: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Signals of terms (doc_id, term, ord), and the co-occurrence edges of their graph."""
    terms = stored(terms, "kept", "doc_id")
    found = found.join(terms.select("doc_id", "term", "ord"), ["doc_id", "term"])
    sizes = ctx.sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    words = ctx.sections.select("doc_id", "sec", F.greatest(F.lit(1), tx.words(F.col("text"))).alias("words"))
    counts = found.groupBy("doc_id", "sec", "term").agg(F.count(F.lit(1)).alias("c")).join(words, ["doc_id", "sec"]).join(sizes, "doc_id")
    counts = counts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "term")))
    x = F.col("c") / F.col("words") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    counts = counts.withColumn("x", x).withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id", "sec"))))
    base = counts.groupBy("doc_id", "term").agg((F.sum("x") / F.first("n")).alias("frequency"), (F.first("df") / F.first("n")).alias("spread"))
    base = base.withColumn("frequency", F.col("frequency") / F.max("frequency").over(Window.partitionBy("doc_id")))
    edges = stored(cooccurrence(found, sizes), "pairs", "doc_id")
    rows = terms.select("doc_id", "term", "ord").join(base, ["doc_id", "term"]).join(pagerank(terms, edges), ["doc_id", "term"])
    if ctx.headings is not None:
        rows = rows.join(heading_weight(terms, ctx.headings), ["doc_id", "term"], "left").withColumn("heading", F.coalesce("heading", F.lit(0.0)) / 3)
    else:
        rows = rows.withColumn("heading", F.lit(0.0))
    rows = rows.join(exam_signals(ctx, terms, found, told), ["doc_id", "term"])
    marks = ("definition", "figure", "example")
    boost = F.lit(1.0)
    for k, v in zip(marks, (DEFINITION, FIGURE, EXAMPLE), strict=True):
        boost = boost * F.when(F.col(k), v).otherwise(1.0)
    signals = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in marks]))
    total = sum(F.col(k) * v for k, v in WEIGHTS.items())
    rows = rows.withColumn("exam_boost", boost).withColumn("exam_signals", signals).withColumn("composite", total * F.col("exam_boost"))
    return rows, edges


def tier(score: Column) -> Column:
    return F.when(score > CORE, "core").when(score > SUPPORTING, "supporting").otherwise("minor")


def rank(ctx: Context, terms: DataFrame, found: DataFrame, told: DataFrame | None = None, endorsed: DataFrame | None = None, most: int = TOPICS) -> tuple[DataFrame, DataFrame]:
    """Topics (doc_id, pos from 1, term, score, tier, ...) and the edges between them that are shown.

    endorsed: (doc_id, key) of terms whose score counts twice; told: what heard() gives of found, if it is at hand."""
    rows, edges = measure(ctx, drop_fragments(terms, found), found, told)
    rows = rows.withColumn("key", tm.term_key(F.col("term")))
    if endorsed is not None:
        rows = rows.join(endorsed.select("doc_id", "key", F.lit(True).alias("llm_endorsed")).distinct(), ["doc_id", "key"], "left").withColumn("llm_endorsed", F.coalesce("llm_endorsed", F.lit(False)))
    else:
        rows = rows.withColumn("llm_endorsed", F.lit(False))
    rows = rows.withColumn("raw", F.round(F.col("composite") * F.when(F.col("llm_endorsed"), ENDORSED).otherwise(1.0), 9)).where("raw > 0")
    order = Window.partitionBy("doc_id").orderBy(F.desc("raw"), "ord")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.desc("raw"), "ord"))).where("k = 1")
    rows = rows.withColumn("pos", F.row_number().over(order).cast("int")).where(F.col("pos") <= most)
    rows = rows.withColumn("score", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy("doc_id")), 3)).withColumn("tier", tier(F.col("score")))
    if ctx.headings is not None:
        words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
        named = ctx.headings.select("doc_id", words.alias("w")).where("length(w) > 2").groupBy("doc_id").agg(F.collect_set("w").alias("named"))
        rows = rows.join(named, "doc_id", "left").withColumn("is_heading", F.coalesce(F.arrays_overlap(F.split(F.lower("term"), " "), "named"), F.lit(False)))
    else:
        rows = rows.withColumn("is_heading", F.lit(False))
    topics = rows.select(  # rounded in two steps: sums in another order differ in the last bits, also at a half
        "doc_id", "pos", "term", "score", "tier", "is_heading", "llm_endorsed", *(F.round(F.round(k, 9), 3).alias(k) for k in (*WEIGHTS, "exam_boost")), "exam_signals"
    )
    topics = stored(topics, "topics", "doc_id")
    names = topics.select("doc_id", "term")
    shown = edges.where(F.col("weight") >= SHOWN)
    for side in ("source", "target"):
        shown = shown.join(names.withColumnRenamed("term", side), ["doc_id", side], "left_semi")
    return topics, shown.withColumn("weight", F.round("weight", 3))


def study_priority(topics: DataFrame) -> DataFrame:
    """(doc_id, coverage, study_priority): how much of all scores the first five hold, in percent."""
    sums = topics.groupBy("doc_id").agg(F.sum(F.when(F.col("pos") <= 5, F.col("score")).otherwise(0.0)).alias("top"), F.sum("score").alias("all"))
    share = F.when(F.col("all") > 0, F.bround(F.round(F.col("top") / F.col("all") * 100, 9), 0)).otherwise(0).cast("int")
    return sums.select("doc_id", share.alias("coverage"), F.format_string("Top 5 topics cover ~%d%% of this document", share).alias("study_priority"))


class Analysis:
    """Candidates, mentions, sentences that mention them, topics and edges of documents."""

    def __init__(self, ctx: Context):
        self.ctx = ctx
        self.candidates = stored(nominate(ctx.sections, branding(ctx.pages)), "candidates", "doc_id")
        self.mentions = stored(mentions(ctx, self.candidates), "mentions", "doc_id")
        self.heard = stored(heard(ctx, self.mentions), "heard", "doc_id")
        topics, edges = rank(ctx, self.candidates, self.mentions, told=self.heard)
        self.topics, self.edges = topics, stored(edges, "edges", "doc_id")
