"""Keyword, vector and fused retrieval, labels, and what goes into a prompt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import terms as tm
from folioscope.sources.store import stored

# Fixed values.
K1, B, FUSION = 1.5, 0.75, 60
CANDIDATES, FINAL = 20, 5
BLOCK = 1024
CONTEXT, ANSWER, CHARS = 4096, 768, 3.5


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyword index: (key, term, tf), (key, length), and (term, idf) over all rows."""
    rows = stored(docs.select(key, tm.tokens(F.col(text)).alias("t")), "tokens")
    tf = rows.select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = rows.select(key, F.size("t").alias("length"))
    n = lengths.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("term", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # n: one row
    return tf, lengths, idf


class Index:
    """The keyword index of a table, written once, for any number of searches."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        tf, lengths, idf = postings(docs, key, text)
        self.key, self.lengths = key, stored(lengths, "lengths")
        self.tf, self.idf = stored(tf, "postings"), stored(idf, "idf")

    def scores(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        """(query_key, key, score) of every pair that shares a term.

        Only the queries' terms leave the index: postings meet them on the term, weights are summed before the shuffle by pair."""
        wanted = queries.select(query_key, F.explode(F.array_distinct(tm.tokens(F.col(query_text)))).alias("term"))
        mean = self.lengths.agg(F.avg("length").alias("mean"))
        rows = self.tf.join(wanted.select("term").distinct(), "term", "left_semi").join(self.idf, "term").join(self.lengths, self.key).crossJoin(F.broadcast(mean))  # one row
        weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return rows.select("term", self.key, weight.alias("w")).join(wanted, "term").groupBy(query_key, self.key).agg(F.sum("w").alias("score"))


def bm25_scores(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """A single search of a table that has no index."""
    return Index(docs, key, text).scores(queries, query_key, query_text)


def top(scores: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """The k best of each query, positive ones only, with rank from 1; equal scores by key."""
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)
    return scores.withColumn("rank", F.row_number().over(order).cast("int")).where((F.col("rank") <= k) & (F.col("score") > 0))


def normalised(vector: Column) -> Column:
    """A vector of doubles of length 1."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dense_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, k: int) -> DataFrame:
    """Exact nearest rows by cosine. queries (query_key, q): a stated set, held as one array on every task, so their number
    must be bounded by the caller; each partition keeps k of each query before anything moves."""
    unit = vectors.select(key, normalised(F.col(vector)).alias("v"))
    own = queries.select(F.struct(F.col(query_key), normalised(F.col("q")).alias("q")).alias("one")).agg(F.collect_list("one").alias("all"))
    rows = unit.crossJoin(F.broadcast(own)).select(key, "v", F.explode("all").alias("one"))  # one row
    scores = rows.select(F.col(f"one.{query_key}").alias(query_key), key, dot(F.col("v"), F.col("one.q")).alias("score"))
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)
    return scores.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def dense_top_blocks(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, k: int, block: int = BLOCK) -> DataFrame:
    """dense_top for any number of queries: about ``block`` of them at a time, each a pass over the vectors, written before the next."""
    blocks = max(1, -(-queries.count() // block))
    own = F.pmod(F.xxhash64(query_key), F.lit(blocks))
    parts = [stored(dense_top(vectors, key, vector, queries.where(own == b), query_key, k), "nearest") for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def fuse(rankings: DataFrame, query_key: str, key: str, k: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of (query_key, list_id, key, rank from 1): (query_key, key, score, pos); ties by first list, then rank."""
    summed = rankings.groupBy(query_key, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_id", "rank")).alias("first"))
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 12)), "first")
    return summed.withColumn("pos", F.row_number().over(order).cast("int")).select(query_key, key, "score", "pos")


def hybrid(dense: DataFrame, keyword: DataFrame, query_key: str, key: str, k: int = FINAL) -> DataFrame:
    """The k best of both rankings fused, with the rank in either."""
    lists = dense.select(query_key, key, "rank", F.lit(0).alias("list_id")).unionByName(keyword.select(query_key, key, "rank", F.lit(1).alias("list_id")))
    fused = fuse(lists, query_key, key).where(F.col("pos") <= k)
    for name, side in (("dense_rank", dense), ("keyword_rank", keyword)):
        fused = fused.join(side.select(query_key, key, F.col("rank").alias(name)), [query_key, key], "left")
    return fused


def context_block(sources: DataFrame, by: str) -> DataFrame:
    """(by, block): labelled excerpts in order of pos, a blank line between."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "label", "text")))
    return sources.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["label"], F.lit("]\n"), r["text"])), "\n\n").alias("block"))


def last_messages(messages: DataFrame, key: str, turn: str, most: int) -> DataFrame:
    """The last messages of each session."""
    order = Window.partitionBy(key).orderBy(F.desc(turn))
    return messages.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def fit_history(messages: DataFrame, key: str, turn: str, budget: Column) -> DataFrame:
    """The latest messages (role, text) that fit the budget of characters together, from a user's message on."""
    back = Window.partitionBy(key).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    kept = messages.withColumn("_sum", F.sum(F.length("text")).over(back)).where(F.col("_sum") <= budget).drop("_sum")
    first = F.min(F.when(F.col("role") == "user", F.col(turn))).over(Window.partitionBy(key))
    return kept.withColumn("_first", first).where(F.col(turn) >= F.col("_first")).drop("_first")


def prompt_budget(system: Column, user: Column) -> Column:
    """Characters left for history in a prompt."""
    return F.greatest(F.lit(0), F.lit(int((CONTEXT - ANSWER) * CHARS)) - F.length(system) - F.length(user))


def remembered(messages: DataFrame, key: str, turn: str, most: int = 20) -> DataFrame:
    """A session's memory: no empty answers, the last ``most`` messages."""
    return last_messages(messages.where(~((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) == ""))), key, turn, most)


def session_messages(requests: DataFrame, key: str, at: str, most: int = 20) -> DataFrame:
    """(key, doc_id, turn, role, text): what a session remembers after all its requests (key, doc_id, at, question, answer).

    A request about another document than the one before begins the session anew. A question is kept, an answer only if
    there is one; the last ``most`` messages stay."""
    order = Window.partitionBy(key).orderBy(at)
    new = F.coalesce(F.lag("doc_id").over(order) != F.col("doc_id"), F.lit(True)).cast("int")
    runs = requests.withColumn("_run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = runs.withColumn("_last", F.max("_run").over(Window.partitionBy(key))).where("_run = _last")
    said = F.array(F.struct(F.lit(0).alias("n"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(1).alias("n"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    rows = last.select(key, "doc_id", at, F.explode(said).alias("m")).where("m.role = 'user' or coalesce(m.text, '') != ''")
    rows = rows.withColumn("turn", (F.row_number().over(Window.partitionBy(key).orderBy(at, "m.n")) - 1).cast("int"))
    return last_messages(rows.select(key, "doc_id", "turn", "m.role", "m.text"), key, "turn", most)


def latest_sessions(sessions: DataFrame, used: str, key: str, most: int = 200) -> DataFrame:
    """The sessions used last; a top-k, of which each partition keeps its own."""
    return sessions.orderBy(F.desc(used), F.desc(key)).limit(most)


def exposures(messages: DataFrame, key: str, topics: DataFrame) -> DataFrame:
    """(key, term, turns) of the users' questions that name a topic of the same document."""
    named = topics.select(key, "term", tm.pattern(F.col("term")).alias("p"))
    rows = messages.where("role = 'user'").join(named, key).where(F.rlike("text", F.col("p")))
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("turns"))
