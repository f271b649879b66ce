"""Operators on small texts, against plain functions or stated results."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import terms as tm
from folioscope.functions import text as tx
from folioscope.operators import concepts as cc
from folioscope.operators import context as cx
from folioscope.operators import mastery as ms
from folioscope.operators import paths as ps
from folioscope.operators import replies as rp
from folioscope.operators import retrieval as rt
from folioscope.sources.store import stored

HEADER = "Notes on learning machines"
PAGES = [
    "Contents\nGradient descent (page 2)\nLoss functions (page 3)\nNeural networks (page 4)",
    "Gradient descent\nGradient descent is a method that lowers a loss function step by step.\nFor example, gradient descent follows the slope of a loss function downhill.\nThe learning rate sets how far gradient descent moves in each step.",
    "Loss functions\nA loss function is a measure of how wrong a model is on its data.\nThe figure below shows a loss function with two valleys and a ridge.",
    "Neural networks\nA neural network is a model with many layers that learn together.\nA neural network relies on gradient descent and a loss function to learn.\nFor instance, a deep neural network has many layers of weights.",
    "Overfitting\nOverfitting is when a neural network remembers its data instead of learning.\nA loss function alone cannot show overfitting of a neural network to us.",
    "Transformers\nA transformer is a type of neural network with attention between its words.\nA transformer requires much data and gradient descent with care.",
]


def paged(spark, pages=PAGES, header=HEADER):
    rows = [("d", k + 1, f"{header}\n{p}\n{k + 1}") for k, p in enumerate(pages)]
    return spark.createDataFrame(rows, "doc_id string, page int, text string")


def headings(spark):
    rows = [("d", k, p.split("\n")[0], 1, k + 1) for k, p in enumerate(PAGES)]
    return spark.createDataFrame(rows, "doc_id string, ord int, text string, level int, page int")


@pytest.fixture(scope="module")
def ctx(spark):
    return cx.Context(paged(spark), headings(spark))


@pytest.fixture(scope="module")
def analysis(ctx):
    return cc.Analysis(ctx)


def test_cleaning(ctx):
    pages = {r.page: r.text for r in ctx.pages.collect()}
    assert len(pages) == 6 and all(HEADER not in t for t in pages.values())
    assert "(page 2)" not in pages[1] and pages[2].startswith("Gradient descent\nGradient descent is a method")
    assert not any(re.search(r"^\d+$", t, re.M) for t in pages.values())


def test_sections_and_sentences(ctx):
    text = ctx.texts.first().text
    secs = ctx.sections.orderBy("sec").collect()
    assert [s.title for s in secs if s.title == "Loss functions"] and {s.title: s.page for s in secs}["Loss functions"] == 3
    assert "".join(s.text for s in secs) == text
    assert "figure" in {s.title: s.flags for s in secs}["Loss functions"]
    starts = [s.start for s in secs]
    for s in ctx.sentences.collect():
        assert text[s.start : s.start + len(s.text)] == s.text
        assert s.sec == max(k for k, a in enumerate(starts) if a <= s.start)
        assert s.words == len(s.text.split())


def joined(page):
    """Segments of wrapped lines, as a loop."""
    out, buf = [], ""
    for line in [*(x.strip() for x in page.split("\n")), ""]:
        if not buf or not line:
            out += [buf] if buf else []
            buf = line
            continue
        if buf[-1] == "-" and line[0].islower():
            buf = buf[:-1] + line
            continue
        if buf[-1] in ".!?:;":
            stop = not line[0].islower()
        else:
            item = re.match(r"(?:[•\-–*▪●◦]|\d+[.)])\s", line)
            stop = bool(item) or (len(buf) < 60 and len(buf.split()) <= 8 and buf[-1] not in ",(" and line[0].isupper())
        if stop:
            out.append(buf)
            buf = line
        else:
            buf += " " + line
    return "\n".join(out)


def test_reflow_equals_a_loop(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["Wrapped line goes\non and hyphen-\nated words end.\n\nTitle\nA sentence follows here\n- item one\n2) item two\nlower, (\nUpper", "", "\n \n", "a-\nB"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.r for r in df.select("k", tx.reflow(F.col("t")).alias("r")).collect()}
    assert got == {k: joined(t) for k, t in enumerate(texts)}


def test_chunks(spark, sf):
    texts = cx.document_texts(paged(spark, [" ".join(f"Sentence {i} speaks of topic{k}." for i in range(60)) for k in range(3)], ""))
    rows = cx.chunks(texts).orderBy("chunk").collect()
    text = texts.first().text
    assert rows[0].page_start == 1 and rows[-1].page_end == 3 and any((r.page_start, r.page_end) == (1, 2) for r in rows)
    for r in rows:
        assert len(r.text) <= 1000 and r.text == r.text.strip() == text[r.s : r.e]
        assert r.s == 0 or text[r.s - 1].isspace()
    covered = set(itertools.chain(*(range(r.s, r.e) for r in rows)))
    assert all(k in covered or text[k].isspace() for k in range(len(text)))


def test_topics(ctx, analysis):
    topics = analysis.topics.orderBy("pos").collect()
    names = [t.term for t in topics]
    assert topics[0].score == 1.0 and all(0 < t.score <= 1 for t in topics)
    assert [t.score for t in topics] == sorted((t.score for t in topics), reverse=True)
    assert all(t.tier == ("core" if t.score > 0.55 else "supporting" if t.score > 0.3 else "minor") for t in topics)
    assert "neural network" in names and "neural" not in names
    best = next(t for t in topics if t.term == "neural network")
    assert "definition" in best.exam_signals and best.is_heading


def test_edges_equal_counted_sections(ctx, analysis):
    secs = [s.text for s in ctx.sections.collect()]
    gap = r"(?:[^\S\n]|-)+"
    has = lambda t, s: re.search(rf"(?<![A-Za-z0-9]){gap.join(t.split())}(?:s|es)?(?![A-Za-z0-9])", s, re.I)
    edges = analysis.edges.collect()
    assert edges
    for e in edges:
        if all(not x.endswith(("s", "y")) for x in (e.source, e.target)):
            assert e.weight == round(sum(bool(has(e.source, s)) and bool(has(e.target, s)) for s in secs) / len(secs), 3)


def test_path(ctx, analysis):
    heard = ps.occurrences(ctx, analysis.mentions)
    edges = stored(ps.prerequisite_edges(ctx, analysis.topics, analysis.mentions))
    found = {(e.source, e.target): e.reason for e in edges.collect()}
    assert found[("neural network", "transformer")] == "stated_dependency"
    steps, kept = ps.learning_path(analysis.topics, ps.introductions(heard), edges)
    steps, kept = stored(steps), stored(kept)
    place = {s.term: s.pos for s in steps.collect()}
    assert sorted(place.values()) == list(range(1, len(place) + 1))
    assert all(place[e.source] < place[e.target] for e in kept.collect())
    rows = {r.term: r for r in ps.concept_evidence(ctx, analysis.topics, analysis.mentions, steps, kept).collect()}
    own = rows["neural network"]
    assert own.definitions[0]["text"].startswith("A neural network is a model") and own.definitions[0]["label"] == "p. 4"
    assert own.n_mentions >= own.n_sentences >= own.n_sections
    pairs = stored(analysis.edges).select("doc_id", F.col("source").alias("a"), F.col("target").alias("b"))
    for r in ps.relation_evidence(ctx, pairs, analysis.mentions, kept).collect():
        assert 0 < r.weight <= 1 and (r.shared_sentences == 0) == (r.sentences is None) == (r.section_pairs is not None)


def test_order_breaks_cycles_and_drops_long_ways():
    intro = {"a": 0, "b": 3, "c": 5, "d": float("inf")}
    steps, edges = ps.order_concepts(["c", "b", "a", "d"], intro, {("a", "b"): 1, ("b", "a"): 1, ("b", "c"): 2, ("a", "c"): 1, ("c", "b"): 1})
    assert [s[0] for s in steps] == ["a", "b", "c", "d"]
    assert [s[1] for s in steps] == [0, 1, 2, 0]
    assert set(edges) == {("a", "b"), ("b", "c")}
    assert steps[0][2] == 2


def test_merge(analysis, spark):
    asked = spark.createDataFrame([("d", 0, "Neural Networks"), ("d", 1, "quantum biology"), ("d", 2, "many layers"), ("d", 3, "network"), ("d", 4, "the")], "doc_id string, ord int, raw string")
    topics, _, verdicts = rp.merge(analysis, asked)
    got = {r.raw: r.verdict for r in verdicts.collect()}
    assert got["Neural Networks"] == "endorsed" and got["quantum biology"] == "rejected" and got["the"] == "invalid"
    assert any(t.llm_endorsed for t in topics.collect())


def test_digest(spark):
    pages = [" ".join(f"Page {k} has sentence {i} here." for i in range(25)) for k in range(40)]
    ctx = cx.Context(paged(spark, pages, ""))
    d = rp.digest(ctx).first().digest
    assert len(d) <= 8000 and d.startswith(rp.HEADER) and "Page 39" in d


def fold(spark, scores, now="2026-01-01 00:00:00"):
    rows = [("u", "c", k, s) for k, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "u string, c string, event_id int, score double").withColumn("ts", F.to_timestamp(F.lit(now)))
    return ms.fold(df, ["u", "c"]).first()


def test_mastery(spark):
    s = fold(spark, [1.0, 1.0, 1.0])
    assert (s.mastery, s.attempts, s.correct, s.reps) == (0.875, 3, 3, 3) and s.interval > 6
    s = fold(spark, [1.0, 1.0, 1.0, 0.0])
    assert (s.reps, s.interval, s.due.day) == (0, 1, 2)
    assert fold(spark, [None]).exposures == 1
    s = fold(spark, [0.5])
    assert s.reps == 0 and fold(spark, [0.55]).reps == 1


def test_logs_of_any_length_and_odd_keys(spark):
    """One learner with most events over many batches, null keys, times and scores, NaN, ties: as a walk through each log."""
    rnd = random.Random(11)
    scores = [None, float("nan"), 0.0, 0.3, 0.55, 0.7, 1.0]
    rows = [(None if rnd.random() < 0.05 else "hot" if rnd.random() < 0.7 else f"u{rnd.randint(0, 900)}", rnd.choice([None, 1.5, float("nan")]), None if rnd.random() < 0.02 else rnd.randint(0, 500), rnd.randint(0, 3), rnd.choice(scores)) for _ in range(30000)]
    df = spark.createDataFrame(rows, "u string, c double, s long, event_id int, score double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.u, str(r.c)): r for r in ms.fold(df, ["u", "c"]).withColumn("due", F.unix_seconds("due")).withColumn("last_seen", F.unix_seconds("last_seen")).collect()}
    logs = {}
    rank = lambda x: (0, 0) if x is None else (2, 0) if x != x else (1, x)
    for u, c, *event in sorted(rows, key=lambda r: [rank(x) for x in r[2:]]):
        logs.setdefault((u, str(c)), []).append(event)
    assert set(got) == set(logs)
    for key, log in logs.items():
        state, due, last = ms.NEW, None, None
        for at, _, score in log:
            state = ms.advance(state, score)
            if score is not None and score == score:
                due, last = None if at is None else at + 86400 * state[5], score
        r = got[key]
        assert (r.mastery, r.attempts, r.correct, r.exposures, r.ease, r.interval, r.reps, r.due, r.last_score, r.last_seen) == (*state, due, last, log[-1][0])
    assert ms.fold(df.limit(0), ["u", "c"]).collect() == []


def test_retrieval_finds_the_document(spark):
    docs = spark.createDataFrame([(0, "cats purr softly"), (1, "dogs bark loudly at cats"), (2, "stones are silent")], "doc_id int, text string")
    asked = spark.createDataFrame([(0, "Why do dogs bark?")], "q int, question string")
    got = rt.top(rt.bm25_scores(docs, "doc_id", "text", asked, "q", "question"), "q", "doc_id", 5).collect()
    assert [r.doc_id for r in got] == [1]


def test_spans_equal_a_regex(spark):
    texts = ["a cat, two cats and a bobcat; CAT", "", "cat", "none here", "cat cat\ncat"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", tm.spans(F.col("t"), tm.pattern(F.lit("cat"))).alias("s")).collect()
    rx = re.compile(r"(?<![A-Za-z0-9])cat(?:s|es)?(?![A-Za-z0-9])", re.I)
    for r in rows:
        assert [(x["at"], x["stop"], x["surface"]) for x in r.s] == [(m.start(), m.end(), m.group()) for m in rx.finditer(r.t)]


def test_pagerank_settles(spark):
    terms = spark.createDataFrame([("d", t, k) for k, t in enumerate("abc")], "doc_id string, term string, ord int")
    edges = spark.createDataFrame([("d", "a", "b", 1.0), ("d", "b", "c", 1.0)], "doc_id string, source string, target string, weight double")
    got = {r.term: r.centrality for r in cc.pagerank(terms, edges).collect()}
    assert got["b"] == 1.0 and abs(got["a"] - got["c"]) < 1e-9 and abs(got["a"] - 0.257 / 0.486) < 2e-3
    alone = {r.term: r.centrality for r in cc.pagerank(terms, edges.limit(0)).collect()}
    assert set(alone.values()) == {1.0}


def test_streams_equal_batch(spark, sf):
    from folioscope.plans import catalogue

    names = ["user_id", "concept", "mastery", "attempts", "correct", "exposures", "ease", "interval", "reps"]
    batch = {tuple(r) for r in catalogue.queries()["mastery_fold"](spark, sf).select(*names).collect()}
    assert {tuple(r) for r in catalogue.queries()["stream_mastery"](spark, sf).select(*names).collect()} == batch
