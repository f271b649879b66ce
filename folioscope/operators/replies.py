"""What goes to a language model and what comes back: digests, topic lists, quizzes and grades. Replies are input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import terms as tm
from folioscope.functions import text as tx
from folioscope.functions.lexicon import english
from folioscope.operators import concepts as cc
from folioscope.operators.context import Context
from folioscope.sources.store import stored

# Fixed values.
BUDGET, OUTLINE = 8000, 1500
HEADER, SEPARATOR = "Excerpts from across the document:\n", "\n...\n"
TOPIC_LIST = r'(?s)\[\s*"[^"]+"(?:\s*,\s*"[^"]+")*\s*\]'
EDGES = "\"'“”‘’.,;:•-"


def digest(ctx: Context, budget: int = BUDGET) -> DataFrame:
    """(doc_id, digest): the outline of the upper headings and excerpts of evenly spread sections, within the budget."""
    secs = ctx.sections.withColumn("body", tx.strip(F.col("text"))).where("body != ''")
    rows = secs.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sec", "body"))), lambda s: s["body"]).alias("s"))
    if ctx.headings is not None:
        line = F.concat(F.when(F.col("level") == 2, "  ").otherwise(""), F.col("text"))
        lines = ctx.headings.where("coalesce(level, 3) <= 2").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("h"))
        rows = rows.join(lines, "doc_id", "full")
        text = F.left(F.array_join(F.array_distinct(F.transform("h", lambda x: x["line"])), "\n"), F.lit(OUTLINE))
        rows = rows.withColumn("outline", F.when(F.size("h") > 0, F.concat(F.lit("Outline:\n"), text)))
    else:
        rows = rows.withColumn("outline", F.lit(None).cast("string"))
    n = F.size("s")
    left = budget - F.coalesce(F.length("outline") + 2, F.lit(0)) - len(HEADER)
    rows = rows.withColumn("left", left).withColumn("per", F.greatest(F.lit(250), F.expr("left div size(s)") - len(SEPARATOR)).cast("int"))
    rows = rows.withColumn("k", F.greatest(F.lit(1), F.least(n, F.floor(F.col("left") / (F.col("per") + len(SEPARATOR))))).cast("int"))

    def cut(i: Column) -> Column:
        at = F.when(i == F.col("k") - 1, n - 1).otherwise(F.floor(i * (n / F.col("k"))).cast("int"))
        part = F.left(F.get("s", at), F.col("per"))
        stop = F.length(part) - F.call_function("locate", F.lit(" ."), F.reverse(part)) - 1  # of the last full stop, from 0
        found = F.call_function("locate", F.lit(" ."), F.reverse(part)) > 0
        return F.when(found & (stop > F.floor(F.col("per") / 2)), F.left(part, stop + 1)).otherwise(part)

    parts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), cut)
    body = F.when((n > 0) & (F.col("left") > 0), F.concat(F.lit(HEADER), F.array_join(parts, SEPARATOR)))
    return rows.select("doc_id", F.left(F.array_join(F.array_compact(F.array("outline", body)), "\n\n"), F.lit(budget)).alias("digest"))


def parse_topics(raw: Column) -> Column:
    """The topics of a reply: a JSON array, one under topics or concepts, the first one of an object, or one inside prose."""
    whole = F.try_parse_json(raw)
    listed = lambda path: F.try_variant_get(whole, path, "array<variant>")
    values = F.map_values(F.try_variant_get(whole, "$", "map<string,variant>"))
    first = F.get(F.filter(F.transform(values, lambda v: F.try_variant_get(v, "$", "array<variant>")), lambda a: a.isNotNull()), F.lit(0))
    inside = F.try_variant_get(F.try_parse_json(F.regexp_substr(raw, F.lit(TOPIC_LIST))), "$", "array<variant>")
    items = F.coalesce(listed("$"), listed("$.topics"), listed("$.concepts"), first, inside)
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: tx.strip(F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.filter(texts, lambda t: F.length(t) > 1), F.array().cast("array<string>"))


def clean_term(raw: Column) -> Column:
    """A proposed term without quotes and blanks around it; null where it can't be a concept."""
    term = F.trim(F.regexp_replace(F.btrim(tx.strip(raw), F.lit(EDGES)), r"(?U)\s+", " "))
    bad = ~F.length(term).between(2, 60) | (tx.words(term) > 6) | ~term.rlike("[A-Za-z]") | F.lower(term).isin(*english())
    return F.when(~bad, term)


def merge(analysis: cc.Analysis, proposals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, edges, verdicts) after proposals (doc_id, ord, raw): verdicts are endorsed, container, repeated, rejected,
    added or invalid; terms that a document has are added and ranked anew with the endorsed ones counting twice."""
    ctx, topics = analysis.ctx, analysis.topics
    asked = proposals.select("doc_id", "ord", "raw", clean_term(F.col("raw")).alias("term"))
    asked = asked.withColumn("key", tm.term_key(F.col("term"))).withColumn("p", tm.pattern(F.col("term"))).withColumn("n", tx.words(F.col("term")))
    known = topics.select("doc_id", F.col("term").alias("own"), "pos", tm.term_key(F.col("term")).alias("own_key"), tx.words(F.col("term")).alias("m"))
    same = known.groupBy("doc_id", F.col("own_key").alias("key")).agg(F.min("own").alias("same"))
    longer = asked.join(known, "doc_id").where((F.col("m") > F.col("n")) & F.rlike("own", F.col("p"))).groupBy("doc_id", "ord").agg(F.min_by("own_key", "pos").alias("container"))
    new = asked.where("term is not null").select("doc_id", "term").distinct()
    found = stored(cc.mentions(ctx, new), "mentions", "doc_id")
    forms = cc.surface_forms(found)
    rows = asked.join(same, ["doc_id", "key"], "left").join(longer, ["doc_id", "ord"], "left").join(forms, ["doc_id", "term"], "left")
    from pyspark.sql import Window

    free = F.col("term").isNotNull() & F.col("same").isNull() & F.col("container").isNull()
    heard = F.col("form").isNotNull()
    before = Window.partitionBy("doc_id", "key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max((free & heard).cast("int")).over(before), F.lit(0)) == 1
    verdict = F.when(F.col("term").isNull(), "invalid").when(F.col("same").isNotNull(), "endorsed").when(F.col("container").isNotNull(), "container").when(earlier, "repeated").when(~heard, "rejected").otherwise("added")
    rows = stored(rows.withColumn("verdict", verdict), "verdicts", "doc_id")
    endorsed = rows.where("verdict in ('endorsed', 'added')").select("doc_id", "key").union(rows.where("verdict = 'container'").select("doc_id", F.col("container").alias("key")))
    endorsed = endorsed.union(topics.where("llm_endorsed").select("doc_id", tm.term_key(F.col("term")))).distinct()
    touched = asked.select("doc_id").distinct()
    old = topics.select("doc_id", "term", F.col("pos").alias("ord")).join(touched, "doc_id", "left_semi")
    added = rows.where("verdict = 'added'").select("doc_id", F.col("form").alias("term"), (F.col("ord") + 1000).alias("ord"))
    terms = stored(old.union(added).groupBy("doc_id", "term").agg(F.min("ord").alias("ord")), "terms", "doc_id")
    merged, edges = cc.rank(ctx, terms, *sought(analysis, terms), endorsed, cc.MERGED)
    return merged, edges, rows.select("doc_id", "ord", "raw", "term", "verdict", "form")


def sought(analysis: cc.Analysis, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions of terms (doc_id, term), and what concepts.heard() gives of them: only terms that are not among the
    analysis' candidates are looked for in the text."""
    key = ["doc_id", "term"]
    fresh = stored(cc.mentions(analysis.ctx, terms.select(*key).join(analysis.candidates, key, "left_anti")), "mentions", "doc_id")
    own = lambda rows: rows.join(terms.select(*key), key, "left_semi")
    found = stored(own(analysis.mentions).union(fresh), "mentions", "doc_id")
    return found, stored(own(analysis.heard).union(cc.heard(analysis.ctx, fresh)), "heard", "doc_id")


def parse_quiz(raw: Column) -> Column:
    """struct<question, answer> of a reply, or null."""
    data = F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")
    part = lambda k: tx.strip(F.coalesce(F.try_variant_get(F.try_element_at(data, F.lit(k)), "$", "string"), F.lit("")))
    question, answer = part("question"), part("answer")
    return F.when(F.length(question).between(10, 400) & (answer != ""), F.struct(question.alias("question"), answer.alias("answer")))


def parse_grade(raw: Column) -> Column:
    """struct<score, feedback> of a reply; a score above 1 is a percentage. Null without a score."""
    data = F.try_parse_json(raw)
    score = F.try_variant_get(data, "$.score", "double")
    score = F.when(score > 1, score / 100).otherwise(score)
    feedback = F.nullif(tx.strip(F.try_variant_get(data, "$.feedback", "string")), F.lit(""))
    return F.when(score.isNotNull(), F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"), feedback.alias("feedback")))


def quiz_context(evidence: DataFrame, sources: DataFrame, by: list[str], most: int = 3500) -> DataFrame:
    """(by, context, quotes): quotes of the concept, then labelled excerpts; three quotes are kept. evidence has
    definitions and mentions, sources (by, pos, label, text)."""
    quotes = evidence.select(*by, F.concat(F.coalesce("definitions", F.expr("array()")), F.coalesce("mentions", F.expr("array()"))).alias("q"))
    held = sources.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label", "text"))), lambda s: F.concat(F.lit("["), s["label"], F.lit("] "), s["text"])).alias("s"))
    lines = F.transform("q", lambda q: F.coalesce(F.concat(F.lit("["), q["label"], F.lit("] "), q["text"]), q["text"]))
    rows = quotes.join(held, by, "left")
    text = F.array_join(F.concat(lines, F.coalesce("s", F.array().cast("array<string>"))), "\n\n")
    return rows.select(*by, F.left(text, F.lit(most)).alias("context"), F.slice("q", 1, 3).alias("quotes"))
