"""Line deduplication by winnowing over line hashes.

A line counts by its words, ASCII letters in lower case; lines without a word are skipped over. A *run* is a series of
such lines with at least ``min_words`` words. A run that has occurred earlier - in order of doc_id, then line - is
deleted, whatever surrounds it; its first occurrence stays.

Method: every minimal window of at least ``min_words`` words (from each line onwards and from each line backwards) is
winnowed to the line with the smallest hash, so two texts that share a run share a fingerprint: each such run holds a
whole window in both. Fingerprints that have a single position are set aside. The positions of the others are joined;
their matches extend both ways, over all windows that hold the fingerprint, by comparing the windows' own hashes. Forward
windows reach back to the first line of a shared run and backward windows on to its last, so that together they cover it
exactly. Positions are joined with the first occurrence of their window, never with one another, so a passage that stands
in a third of all documents costs a row for each place and no pairs.

Only whole lines count: of a passage that begins or ends inside a line, the lines that it fills are a run, and if they
have under ``min_words`` words together, it stays.

Defined results: a document is a doc_id with a text, so rows that share both count as one (each keeps or loses the same
lines), rows that share a doc_id, or have none, over different texts do not. A null or empty text has nothing to delete; a
null doc_id sorts before all others, and equal ones go by a hash of their texts (ties). A very long text is cut by one
task, its windows are rows like all others. Without documents the result is empty. Other columns, whatever their names,
pass unchanged; the names of added ones get underscores until they are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from folioscope.llm import textbuf as tb
from folioscope.llm.store import dropped, every, free, in_arrow, table, written

MIN_WORDS = 50


def line_table(buf: np.ndarray, offs: np.ndarray):
    """Of all lines with a word: number in its row, hash, words; and the index of each row's first."""
    low = tb.lower(buf)
    starts, ends, first = tb.words(low, offs)
    l_start, l_end, l_first = tb.lines(buf, offs)
    a, b = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    up, down = tb._powers(len(starts) + 2)
    total = np.zeros(len(starts) + 1, np.uint64)
    np.cumsum(tb.hashes(low, starts, ends) * up[: len(starts)], out=total[1:])
    h = tb.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    has = b > a
    number = np.arange(len(l_start)) - np.repeat(l_first[:-1], np.diff(l_first))
    kept = np.zeros(len(has) + 1, np.int64)
    np.cumsum(has, out=kept[1:])
    return number[has], h[has], (b - a)[has], kept[l_first]


def windows(h: np.ndarray, n_words: np.ndarray, first: np.ndarray, least: int):
    """Distinct minimal windows as (row, from, to): forward and backward ones, of lines of one row."""
    n = len(h)
    upto = np.concatenate([[0], np.cumsum(n_words)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    i = np.arange(n)
    j = np.searchsorted(upto, upto[:-1] + least)  # the first end whose sum suffices
    ok = j <= first[row + 1]
    back = np.searchsorted(upto, upto[1:] - least, "right") - 1
    ok_back = (upto[1:] >= least) & (back >= first[row])
    pairs = np.unique(np.concatenate([i[ok] * (n + 1) + j[ok], back[ok_back] * (n + 1) + i[ok_back] + 1]))
    a, b = pairs // (n + 1), pairs % (n + 1)
    return row[a], a, b


def _winnowed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for at, buf, offs in tb.slices(batch.column(2)):
                _, h, n_words, first = line_table(buf, offs)
                if not len(h):
                    continue
                row, a, b = windows(h, n_words, first, least)
                if not len(a):
                    continue
                up, down = tb._powers(len(h) + 2)
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * up[: len(h)], out=total[1:])
                content = tb.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
                edges = np.stack([a, b], 1).ravel()
                least_hash = np.minimum.reduceat(np.append(h, np.uint64(2**64 - 1)), edges)[::2]
                # position of the minimum: the first line from a on with that hash
                where = a.copy()
                todo = h[where] != least_hash
                while todo.any():
                    where[todo] += 1
                    todo = h[where] != least_hash
                base = first[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at + row)),
                        marks.take(pa.array(at + row)),
                        pa.array(least_hash.view(np.int64)),
                        pa.array(where - base, pa.int64()),
                        pa.array(content.view(np.int64)),
                        pa.array(a - base, pa.int64()),
                        pa.array(b - base, pa.int64()),
                    ],
                    ["doc_id", "own", "print", "at", "content", "a", "b"],
                )

    return run


def _mark(docs: DataFrame) -> Column:
    """What tells texts under one doc_id apart."""
    return F.xxhash64(docs["text"].cast("string"))


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each window: its document (doc_id, own), its fingerprint (line hash and position), the hash of its
    content, its bounds a and b among the lines with a word."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", _mark(docs).alias("own"), F.col("text").cast("string")).mapInArrow(
        _winnowed(min_words), f"doc_id {kind}, own long, print long, at long, content long, a long, b long"
    )


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The document (doc_id, own) and the bounds (a, b) of its windows that occurred earlier; of those from one line on the longest."""
    found = written(fingerprints(docs, min_words), "winnowed")
    place = F.struct("doc_id", "own", "at")
    # Each side of a join is a table of its own, so that Spark can split the partition of a line that stands everywhere.
    again = written(found.groupBy("print").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("print"), "prints")
    near = written(found.join(again, "print", "left_semi").select("doc_id", "own", "content", "a", "b"), "near")
    dropped(found, again)
    place = F.struct("doc_id", "own", "a")
    firsts = near.groupBy("content").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("content", "lo")
    later = near.join(written(firsts, "firsts"), "content").where(F.struct("doc_id", "own", "a") > F.col("lo"))
    return later.groupBy("doc_id", "own", "a").agg(F.max("b").alias("b"))


def _cut(n: int, k: int):
    """Batches of n columns, column k the text, and the spans behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(k).to_pylist(), []
            counts = np.zeros((3, len(texts)), np.int64)
            for i, (text, spans) in enumerate(zip(texts, batch.column(n).to_pylist(), strict=True)):
                if text is None:
                    out.append(text)
                    continue
                all_lines = text.split("\n")
                counts[0, i] = len(all_lines)
                if not spans:
                    out.append(text)
                    continue
                sizes = [len(x.encode("utf-8", "surrogatepass").split()) for x in all_lines]
                real = [i_line for i_line, size in enumerate(sizes) if size]
                gone = np.zeros(len(real) + 1, np.int64)
                for s in spans:
                    gone[s["a"]] += 1
                    gone[s["b"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                drop = set()
                for m, line in enumerate(real):
                    if gone[m]:
                        drop.add(line)
                        counts[2, i] += sizes[line]
                        if m + 1 < len(real) and gone[m + 1]:  # and what is blank between two deleted lines
                            drop.update(range(line + 1, real[m + 1]))
                left = [x for line, x in enumerate(all_lines) if line not in drop]
                counts[1, i] = len(all_lines) - len(left)
                out.append("\n".join(left))
            arrays = [batch.column(j) for j in range(n)]
            arrays[k] = pa.array(out, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, counts)], [f"c{j}" for j in range(n + 3)])

    return run


NAMES = ("_lines", "_gone", "_words")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs cut out of text; adds _lines, _gone (lines deleted) and _words (words deleted)."""
    spans = repeated(docs, min_words).groupBy("doc_id", "own").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = spans.toDF(*free(docs, "_id", "_own", "_spans"))
    key, own, held = spans.columns
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans[key]) & (_mark(docs) == spans[own]), "left").select(*every(docs), held)
    n = len(docs.columns)
    return in_arrow(joined, _cut(n, docs.columns.index("text")), [(x, LongType()) for x in free(docs, *NAMES)], n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document with what is left of its text."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("lines_deleted"), F.col("_words").alias("words_deleted"), "text"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs; a document of which nothing is left goes, one that was blank before stays."""
    _, gone, words = free(docs, *NAMES)
    out = dedup_lines(docs).where((F.col(words) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, size).otherwise(F.col("n_chars")))
    return out.select(*every(docs))
