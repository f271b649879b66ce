"""Prerequisites between concepts, the learning path, and the evidence for both."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import terms as tm
from folioscope.functions import text as tx
from folioscope.operators import concepts as cc
from folioscope.operators.context import Context
from folioscope.sources.store import stored

# Fixed values.
SUBSTANTIVE, INTRODUCTION, SHARED, DEFINITIONS = 6, 3, 150, 3


def occurrences(ctx: Context, found: DataFrame) -> DataFrame:
    """(doc_id, term, sent, sec, page, words, text, defines): the sentences that mention each term."""
    held = found.select("doc_id", "term", "sent").distinct().join(ctx.sentences, ["doc_id", "sent"])
    return held.select("doc_id", "term", "sent", "sec", "page", "words", "text", tm.defines(F.col("text"), tm.pattern_body(F.col("term"))).alias("defines"))


def introductions(heard: DataFrame) -> DataFrame:
    """(doc_id, term, intro): the first sentence that defines a term, else the first that mentions it; of some length."""
    rows = heard.where(F.col("words") >= SUBSTANTIVE).groupBy("doc_id", "term")
    return rows.agg(F.coalesce(F.min(F.when(F.col("defines"), F.col("sent"))), F.min("sent")).alias("intro"))


def contexts(ctx: Context, heard: DataFrame, intros: DataFrame) -> DataFrame:
    """(doc_id, term, sent): the sentences from the introduction on in its section, and the first definitions."""
    at = ctx.sentences.select("doc_id", F.col("sent").alias("intro"), F.col("sec").alias("intro_sec"))
    near = intros.join(at, ["doc_id", "intro"]).select("doc_id", "term", "intro_sec", F.explode(F.sequence(F.col("intro"), F.col("intro") + INTRODUCTION - 1)).alias("sent"))
    near = near.join(ctx.sentences.select("doc_id", "sent", "sec"), ["doc_id", "sent"]).where("sec = intro_sec").select("doc_id", "term", "sent")
    order = Window.partitionBy("doc_id", "term").orderBy("sent")
    defs = heard.where(F.col("defines") & (F.col("words") >= SUBSTANTIVE)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= DEFINITIONS)
    return near.unionByName(defs.select("doc_id", "term", "sent")).distinct()


def prerequisite_edges(ctx: Context, topics: DataFrame, found: DataFrame, heard: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, target, weight, reason, evidence): source before target; evidence is a sentence number.

    heard: what concepts.heard() gives of found, if it is at hand. Each reason is looked for where it can hold: uses in the
    few sentences of introductions, statements in sentences that can state any, heads of names by equal keys."""
    names = topics.select("doc_id", "term")
    found = found.join(names, ["doc_id", "term"], "left_semi").select("doc_id", "term", "sent", "at", "stop")
    heard = stored((cc.heard(ctx, found) if heard is None else heard.join(names, ["doc_id", "term"], "left_semi")), "occurrences", "doc_id")
    intros = introductions(heard)
    info = topics.select("doc_id", "term", "tier", tm.term_key(F.col("term")).alias("key"), tm.pattern_body(F.col("term")).alias("body")).join(intros, ["doc_id", "term"])
    info = stored(info, "introductions", "doc_id")
    a = info.select("doc_id", *(F.col(k).alias(f"a_{k}") for k in ("term", "tier", "key", "body", "intro"))).where("a_tier != 'minor'")
    b = info.select("doc_id", *(F.col(k).alias(f"b_{k}") for k in ("term", "key", "body", "intro")))
    pair = ["doc_id", "a_term", "b_term"]
    # used in the introduction, outside the name of what is introduced
    near = contexts(ctx, heard, info.select("doc_id", "term", "intro")).select("doc_id", F.col("term").alias("b_term"), "sent")
    inner = found.select("doc_id", "sent", F.col("term").alias("a_term"), F.col("at").alias("a_at"), F.col("stop").alias("a_stop"))
    outer = found.select("doc_id", "sent", F.col("term").alias("b_term"), F.struct("at", "stop").alias("span")).groupBy("doc_id", "sent", "b_term").agg(F.collect_list("span").alias("spans"))
    used = near.join(outer, ["doc_id", "sent", "b_term"], "left").join(inner, ["doc_id", "sent"]).where("a_term != b_term")
    inside = F.coalesce(F.exists("spans", lambda s: (s["at"] <= F.col("a_at")) & (F.col("a_stop") <= s["stop"])), F.lit(False))
    used = used.where(~inside).groupBy(*pair).agg(F.count_distinct("sent").alias("hits"), F.min("sent").alias("hit"))
    # stated in a sentence with both
    real = heard.where(F.col("words") >= SUBSTANTIVE).select("doc_id", "sent", "term")
    side = lambda k: real.withColumnRenamed("term", f"{k}_term")
    can = ctx.sentences.where((F.col("words") >= SUBSTANTIVE) & tm.may_depend(F.col("text"))).select("doc_id", "sent", "text")
    both = side("a").join(can, ["doc_id", "sent"]).join(side("b"), ["doc_id", "sent"]).where("a_term != b_term")
    both = both.join(a.select("doc_id", "a_term", "a_body"), ["doc_id", "a_term"]).join(b.select("doc_id", "b_term", "b_body"), ["doc_id", "b_term"])
    stated = both.where(F.rlike("text", tm.dependency_pattern(F.col("b_body"), F.col("a_body")))).groupBy(*pair).agg(F.min("sent").alias("stated"))
    stated = stored(stated, "stated", "doc_id")
    late = stated.where(F.col("stated") >= SHARED)  # only there can a sentence be beyond the first SHARED that a pair shares
    late = late.join(side("a"), ["doc_id", "a_term"]).where("sent <= stated").join(side("b"), [*pair[:1], "b_term", "sent"]).groupBy(*pair).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > SHARED)
    stated = stated.join(late.select(*pair), pair, "left_anti")
    # a longer name with the other as its head
    tails = F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.size("w")), " "))
    heads = b.select("doc_id", "b_term", F.split("b_key", " ").alias("w")).where(F.size("w") > 1).select("doc_id", "b_term", F.explode(tails).alias("a_key"))
    special = heads.join(a.select("doc_id", "a_term", "a_key"), ["doc_id", "a_key"]).where("a_term != b_term and a_key != ''").select(*pair).distinct()

    blank = lambda k: F.lit(None).cast("long" if k == "hits" else "int").alias(k)
    parts = ((used, ("hits", "hit")), (stated, ("stated",)), (special.withColumn("special", F.lit(1)), ("special",)))
    cols = ("hits", "hit", "stated", "special")
    rows = [part.select(*pair, *(F.col(k) if k in held else blank(k) for k in cols)) for part, held in parts]
    rows = rows[0].union(rows[1]).union(rows[2]).groupBy(*pair).agg(*(F.max(k).alias(k) for k in cols))
    rows = rows.join(a.select("doc_id", "a_term", "a_intro"), ["doc_id", "a_term"]).join(b.select("doc_id", "b_term", "b_intro"), ["doc_id", "b_term"])
    hits = F.when(F.col("a_intro") < F.col("b_intro"), F.coalesce("hits", F.lit(0))).otherwise(0)
    said = F.col("stated").isNotNull()
    rows = rows.withColumn("h", hits).where((F.col("h") > 0) | said | F.col("special").isNotNull())
    return rows.select(
        "doc_id",
        F.col("a_term").alias("source"),
        F.col("b_term").alias("target"),
        F.when((F.col("h") == 0) & ~said, 1.0).otherwise(F.col("h") + F.when(said, 2.0).otherwise(0.0)).alias("weight"),
        F.when(said, "stated_dependency").when(F.col("h") > 0, "introduced_using").otherwise("specialization").alias("reason"),
        F.when(said, F.col("stated")).when(F.col("h") > 0, F.col("hit")).otherwise(F.col("b_intro")).alias("evidence"),
    )


def _cycle(names: list[str], after: dict[str, list[str]]) -> list[tuple[str, str]]:
    """The first cycle that a depth-first walk closes, nodes and edges in the given order; empty without one."""
    done: set[str] = set()
    for root in names:
        path, open_edges = [root], [iter(after[root])]
        while path and root not in done:
            step = next((v for v in open_edges[-1] if v not in done), None)
            if step is None:
                done.add(path.pop())
                open_edges.pop()
            elif step in path:
                ring = path[path.index(step) :] + [step]
                return list(zip(ring, ring[1:], strict=False))
            else:
                path.append(step)
                open_edges.append(iter(after[step]))
    return []


def order_concepts(names: list[str], intro: dict[str, float], weights: dict[tuple[str, str], float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, str]]]:
    """Steps (name, level, number of concepts it unlocks) in learning order, and the edges that are left.

    Cycles lose their lightest edge, one against the order of introduction first; an edge that a longer way replaces goes;
    of the concepts that are free to come next, the one that unlocks most comes first, then the one introduced first."""
    weights = dict(weights)
    rank = {n: k for k, n in enumerate(names)}
    link = lambda: {n: sorted((v for u, v in weights if u == n), key=rank.get) for n in names}
    while ring := _cycle(names, link()):
        del weights[min(ring, key=lambda e: (weights[e], intro[e[0]] < intro[e[1]]))]
    after, reach = link(), {}

    def reached(n: str) -> set[str]:
        if n not in reach:
            reach[n] = set(after[n]).union(*(reached(v) for v in after[n]))
        return reach[n]

    edges = [(u, v) for u in names for v in after[u] if not any(v in reached(w) for w in after[u] if w != v)]
    before = {n: [u for u, v in edges if v == n] for n in names}
    key = {n: (-len(reached(n)), intro[n], n) for n in names}
    heap, missing, steps, level = [key[n] for n in names if not before[n]], {n: len(before[n]) for n in names}, [], {}
    heapq.heapify(heap)
    while heap:
        n = heapq.heappop(heap)[2]
        level[n] = 1 + max((level[p] for p in before[n]), default=-1)
        steps.append((n, level[n], len(reached(n))))
        for v in (v for u, v in edges if u == n):
            missing[v] -= 1
            if not missing[v]:
                heapq.heappush(heap, key[v])
    return steps, edges


def learning_path(topics: DataFrame, intros: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps (doc_id, pos from 1, term, level, prerequisites, unlocks, unlocks_total, tier, score, intro) and the edges kept.

    A row holds one document's graph of at most a few dozen topics; breaking cycles goes edge by edge."""
    own = topics.join(intros, ["doc_id", "term"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term", "intro"))).alias("nodes"))
    links = edges.groupBy("doc_id").agg(F.collect_list(F.struct("source", "target", "weight")).alias("links"))
    kind = dict(topics.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, nodes, pairs in zip(frame["doc_id"], frame["nodes"], frame["links"], strict=True):
                names = [x["term"] for x in nodes]
                intro = {x["term"]: float("inf") if x["intro"] is None else x["intro"] for x in nodes}
                weights = {} if pairs is None else {(p["source"], p["target"]): p["weight"] for p in pairs}
                steps, kept = order_concepts(names, intro, weights)
                place = {n: k for k, (n, _, _) in enumerate(steps)}
                for k, (n, level, total) in enumerate(steps):
                    before, after = (sorted((e[i] for e in kept if e[1 - i] == n), key=place.get) for i in (0, 1))
                    out.append((doc, k + 1, n, level, before, after, total))
            yield pd.DataFrame(out, columns=["doc_id", "pos", "term", "level", "prerequisites", "unlocks", "unlocks_total"])

    shape = f"doc_id {kind}, pos int, term string, level int, prerequisites array<string>, unlocks array<string>, unlocks_total int"
    steps = own.join(links, "doc_id", "left").mapInPandas(run, shape)
    kept = steps.select("doc_id", F.col("term").alias("source"), F.explode("unlocks").alias("target"))
    steps = steps.join(topics.select("doc_id", "term", "tier", "score"), ["doc_id", "term"]).join(intros, ["doc_id", "term"], "left")
    return steps, edges.join(kept, ["doc_id", "source", "target"], "left_semi")


def reference(kind: str, text: Column, page: Column) -> Column:
    """How a sentence is quoted: text, page and label; the latter for paged documents only."""
    paged = kind == "pdf"
    return F.struct(
        tx.excerpt(text).alias("text"),
        (page if paged else F.lit(None)).cast("int").alias("page"),
        (F.format_string("p. %d", page) if paged else F.lit(None).cast("string")).alias("label"),
    )


def concept_evidence(ctx: Context, topics: DataFrame, found: DataFrame, steps: DataFrame, edges: DataFrame, limit: int = 4, heard: DataFrame | None = None) -> DataFrame:
    """A row for each topic: definitions, mentions in different sections, counts, edges in and out, place in the path.

    heard: what concepts.heard() gives of found, if it is at hand. Only sentences that are quoted bring their text."""
    names = topics.select("doc_id", "term")
    found = found.join(names, ["doc_id", "term"], "left_semi")
    heard = stored((cc.heard(ctx, found) if heard is None else heard.join(names, ["doc_id", "term"], "left_semi")), "occurrences", "doc_id")
    by = Window.partitionBy("doc_id", "term").orderBy("sent")
    good = heard.withColumn("d", F.when(F.col("defines") & (F.col("words") >= 4), 1)).withColumn("d", F.when(F.col("d") == 1, F.sum("d").over(by)))
    good = good.withColumn("definition", F.coalesce(F.col("d") <= 2, F.lit(False)))
    free = good.where(~F.col("definition") & (F.col("words") >= SUBSTANTIVE))
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "term", "sec").orderBy("sent"))).where("k = 1")
    free = free.withColumn("k", F.row_number().over(by)).where(F.col("k") <= limit)
    chosen = good.where("definition").select("doc_id", "term", "sent", "definition").union(free.select("doc_id", "term", "sent", "definition"))
    text = ctx.sentences.select("doc_id", "sent", reference(ctx.kind, F.col("text"), F.col("page")).alias("ref"))
    row = F.struct("sent", "ref")
    quoted = lambda of, name: F.transform(F.sort_array(F.collect_list(F.when(of, row))), lambda r: r["ref"]).alias(name)
    quotes = chosen.join(text, ["doc_id", "sent"]).groupBy("doc_id", "term").agg(quoted(F.col("definition"), "definitions"), quoted(~F.col("definition"), "mentions"))
    quotes = quotes.select("doc_id", "term", *(F.when(F.size(k) > 0, F.col(k)).alias(k) for k in ("definitions", "mentions")))
    stats = heard.groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.count_distinct("sec").alias("n_sections"), F.sort_array(F.collect_set("page")).alias("pages")
    )
    counts = found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n_mentions"))
    sizes = ctx.sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_sections"))
    ends = {s: edges.groupBy("doc_id", F.col(s).alias("term")).agg(F.sort_array(F.collect_list(F.struct(o, "weight", "reason"))).alias(n)) for s, o, n in (("target", "source", "prerequisites"), ("source", "target", "unlocks"))}
    out = topics.join(stats, ["doc_id", "term"], "left").join(counts, ["doc_id", "term"], "left").join(sizes, "doc_id")
    for part in (quotes, *ends.values(), steps.select("doc_id", "term", F.col("pos").alias("path_position"))):
        out = out.join(part, ["doc_id", "term"], "left")
    if ctx.kind != "pdf":
        out = out.withColumn("pages", F.array().cast("array<int>"))
    return out


def relation_evidence(ctx: Context, pairs: DataFrame, found: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """(doc_id, a, b, ...): sentences and sections that two concepts share, a quote of each where no sentence has both.

    Terms meet by sentence and by section, then the pairs; only sentences that are quoted bring their text."""
    key = ["doc_id", "a", "b"]
    names = pairs.select("doc_id", F.explode(F.array("a", "b")).alias("term")).distinct()
    heard = stored(found.join(names, ["doc_id", "term"], "left_semi").select("doc_id", "term", "sent", F.col("sent_sec").alias("sec")).distinct(), "heard", "doc_id")
    text = ctx.sentences.select("doc_id", "sent", reference(ctx.kind, F.col("text"), F.col("page")).alias("ref"))
    side = lambda rows, k: rows.withColumnRenamed("term", k)
    said = heard.select("doc_id", "term", "sent")
    sents = side(said, "a").join(side(said, "b"), ["doc_id", "sent"]).join(pairs, key, "left_semi")
    sents = sents.groupBy(*key).agg(F.count(F.lit(1)).alias("shared_sentences"), F.slice(F.sort_array(F.collect_list("sent")), 1, limit).alias("sents"))
    sents = stored(sents, "shared", "doc_id")
    quotes = sents.select(*key, F.explode("sents").alias("sent")).join(text, ["doc_id", "sent"]).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("sent", "ref"))), lambda r: r["ref"]).alias("sentences"))
    counts = sents.select(*key, "shared_sentences")
    firsts = lambda k: heard.groupBy("doc_id", F.col("term").alias(k), "sec").agg(F.min("sent").alias(f"{k}_first"))
    secs = firsts("a").join(firsts("b"), ["doc_id", "sec"]).join(pairs, key, "left_semi")
    place = F.struct("sec", "a_first", "b_first")
    secs = stored(secs.groupBy(*key).agg(F.count(F.lit(1)).alias("shared_sections"), F.slice(F.sort_array(F.collect_list(place)), 1, 3).alias("secs")), "shared", "doc_id")
    n_secs = secs.select(*key, "shared_sections")
    few = secs.join(counts, key, "left_anti").select(*key, F.explode("secs").alias("s")).select(*key, "s.*").join(ctx.sections.select("doc_id", "sec", "title"), ["doc_id", "sec"])
    for k in ("a", "b"):
        few = few.join(text.select("doc_id", F.col("sent").alias(f"{k}_first"), F.col("ref").alias(f"{k}_ref")), ["doc_id", f"{k}_first"])
    shown = few.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("sec", "title", "a_ref", "b_ref"))).alias("section_pairs"))
    sizes = ctx.sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_sections"))
    need = F.struct("source", "target", "weight", "reason").alias("prerequisite")
    both = edges.select("doc_id", F.col("source").alias("a"), F.col("target").alias("b"), need).union(edges.select("doc_id", F.col("target").alias("a"), F.col("source").alias("b"), need))
    out = pairs.join(sizes, "doc_id")
    for part in (counts, n_secs, quotes, shown, both.groupBy(*key).agg(F.min("prerequisite").alias("prerequisite"))):
        out = out.join(part, key, "left")
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    weight = F.round(F.coalesce("shared_sections", F.lit(0)) / F.col("total_sections"), 3).alias("weight")
    return out.select(*key, weight, zero("shared_sentences"), zero("shared_sections"), "total_sections", "sentences", "section_pairs", "prerequisite")


def reachability(edges: DataFrame) -> DataFrame:
    """(doc_id, source, target, hops): all pairs joined by a way, with the length of the longest one, of acyclic graphs.

    Each round joins all ways known so far with themselves, so ways of any length take the logarithm of it in rounds, and
    writes the longest of each pair. An acyclic graph is done when nothing grows; a pair of a node with itself is a cycle,
    which is an error."""
    key = ["doc_id", "source", "target"]
    ways = stored(edges.select(*key).distinct().withColumn("hops", F.lit(1)), "ways", "doc_id")
    done = None
    while True:
        ring = ways.where(F.col("source") == F.col("target")).limit(1).collect()
        if ring:
            raise ValueError(f"the graph of {ring[0]['doc_id']!r} has a cycle through {ring[0]['source']!r}")
        now = tuple(ways.agg(F.count(F.lit(1)), F.sum("hops")).first())
        if now == done:
            return ways
        done = now
        on = ways.select("doc_id", F.col("source").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"))
        longer = ways.join(on, ["doc_id", "target"]).select("doc_id", "source", F.col("next").alias("target"), (F.col("hops") + F.col("more")).alias("hops"))
        ways = stored(ways.union(longer).groupBy(*key).agg(F.max("hops").alias("hops")), "ways", "doc_id")


def transitive_reduction(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Edges that no longer way replaces: those whose longest way is the edge itself."""
    return edges.join(reach.where("hops = 1").select("doc_id", "source", "target"), ["doc_id", "source", "target"], "left_semi")


def levels(names: DataFrame, reach: DataFrame) -> DataFrame:
    """(doc_id, term, level): the length of the longest way to each of the names (doc_id, term), 0 where none leads."""
    longest = reach.groupBy("doc_id", F.col("target").alias("term")).agg(F.max("hops").alias("level"))
    return names.join(longest, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("level", F.lit(0)).alias("level"))
