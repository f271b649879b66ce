"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Words: ASCII punctuation counts as white space, A-Z as a-z. An item leaks into a document if the document holds at least
``threshold`` (0.8) of the item's distinct five-word shingles.

Search: items are partitioned by their number of shingles, (u/2, u] for powers of two u; for each class a document is
covered by windows of 2u shingles every u, so that an item that stands in a text lies whole in a window of its own size
class, however long the document is: at containment 0.8 their Jaccard similarity is at least 0.19, and ``PERMS``
permutations with one row a band miss that with a probability of 0.81**96, under 2e-9. A window agrees with an item on a
permutation if and only if the item's minimal shingle stands in the window and no shingle of the window ranks lower, so
signatures need not be computed for windows without such a shingle: an inverted index of the items' minimal shingles
finds the windows in question, and only their minima are taken. Candidates are verified against the whole document.

Items are indexed and broadcast, as arrays, in blocks of about ``BLOCK_BYTES`` of text, however many there are; each block
is a pass over the documents, so the broadcast is bounded; texts that repeat within a block are indexed once.

Defined results: items with under five words have no shingle and never leak, nor do null ones; a null or empty text has no
shingle; items or documents that repeat, or that have a null id, give their own rows; ties do not arise, as every leak
counts; a very long text is held by one task, in whole; without items or documents the result is empty, or all documents.
Columns other than doc_id, item_id and text are not read here, and pass ``without_leaks`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import textbuf as tb
from folioscope.llm.store import in_arrow, table, written

SHINGLE, THRESHOLD, PERMS = 5, 0.8, 96
BLOCK_BYTES, AT_ONCE = 16 << 20, 1 << 19

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_SEEDS = tb.mix(np.arange(1, 1025, dtype=np.uint64))


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the index of each row's first."""
    plain = _PLAIN[buf]
    starts, ends, first = tb.words(plain, offs)
    g, at = tb.grams(tb.hashes(plain, starts, ends), first, size)
    return g, np.searchsorted(at, first)


class Index:
    """Signatures of a block of items, and the inverted index of their minimal shingles; equal texts count once here."""

    def __init__(self, texts: list[str], size: int = SHINGLE, perms: int = PERMS):
        self.size = size
        sets: list[np.ndarray] = []
        keys, item, perm = [], [], []
        for at, buf, offs in tb.slices(pa.array(texts, pa.string())):
            g, first = shingles(buf, offs, size)
            row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            g, row = g[new], row[new]
            first = np.searchsorted(row, np.arange(len(offs)))
            sets.append(np.diff(first))
            keys.append(g)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                item.append((at + full, *[_minima(g, first[full], s) for s in _SEEDS[:perms]]))
        #: the distinct shingles of item n, ascending: shingle[first[n] : first[n + 1]]
        self.shingle = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(sets))]).astype(np.int64) if sets else np.zeros(1, np.int64)
        lows = [np.concatenate([x[1 + p] for x in item]) if item else np.zeros(0, np.uint64) for p in range(perms)]
        who = np.concatenate([x[0] for x in item]) if item else np.zeros(0, np.int64)
        keys = np.concatenate(lows)
        perm, item = np.repeat(np.arange(perms, dtype=np.int16), len(who)), np.tile(who, perms).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.perm = keys[order], item[order], perm[order]
        self.bits = max(12, int(np.ceil(np.log2(len(self.keys) + 1))) + 4)
        self.there = np.zeros(1 << self.bits, bool)
        self.there[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        n = np.maximum(np.diff(self.first), 1) - 1
        self.upper = np.array([1 << int(k).bit_length() for k in n], np.int64)

    def candidates(self, own: np.ndarray) -> np.ndarray:
        """Items that agree with a window of their size class on a permutation, ascending.

        Windows are two blocks; a block's minimum is taken once for each permutation, however many items or places ask for
        it. Places are looked at some at a time, and no more for items that are found."""
        found = np.zeros(len(self.first) - 1, bool)
        hit = np.flatnonzero(self.there[(own >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(hit) or not len(self.keys):
            return np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.keys, own[hit], "left"), np.searchsorted(self.keys, own[hit], "right")
        hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        upto = np.cumsum(n)
        at = 0
        while at < len(hit):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            size = n[at:to]
            entry = np.repeat(lo[at:to] - np.cumsum(size) + size, size) + np.arange(size.sum())
            place = np.repeat(hit[at:to], size)
            new = ~found[self.item[entry]]
            self._agreeing(own, place[new], entry[new], found)
            at = to
        return np.flatnonzero(found)

    def _agreeing(self, own: np.ndarray, place: np.ndarray, entry: np.ndarray, found: np.ndarray) -> None:
        """Mark the items of entries whose shingle, at a place, is the least of either window that holds the place."""
        u = self.upper[self.item[entry]]
        key = u * len(_SEEDS) + self.perm[entry]
        order = np.argsort(key, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            k = order[a:b]
            size, seed = int(u[k[0]]), _SEEDS[self.perm[entry[k[0]]]]
            block, which = np.unique(place[k] // size, return_inverse=True)
            wanted = np.unique(np.concatenate([block - 1, block, block + 1]))
            wanted = wanted[wanted >= 0]
            inside = wanted[:, None] * size + np.arange(size)
            low = np.where(inside < len(own), tb.mix(own[np.minimum(inside, len(own) - 1)] ^ seed), np.uint64(2**64 - 1)).min(axis=1)
            of = lambda x: np.where(x >= 0, low[np.searchsorted(wanted, np.maximum(x, 0)).clip(max=len(low) - 1)], np.uint64(0))  # noqa: B023, E731
            least = np.maximum(np.minimum(of(block), of(block + 1)), np.minimum(of(block - 1), of(block)))  # of the two windows the one that asks less
            found[self.item[entry[k[tb.mix(own[place[k]] ^ seed) == least[which]]]]] = True

    def leaks(self, own: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(item, its shingles, those of them that the document has) of all leaks."""
        found = self.candidates(own)
        if not len(found):
            return []
        out, mine = [], np.unique(own)
        for n in found.tolist():
            wanted = self.shingle[self.first[n] : self.first[n + 1]]
            at = np.searchsorted(mine, wanted).clip(max=len(mine) - 1)
            shared = int((mine[at] == wanted).sum())
            if shared >= threshold * len(wanted):
                out.append((n, len(wanted), shared))
        return out

    def search(self, texts: pa.Array, threshold: float) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Row and leak (item, its shingles, those shared) of all leaks into the texts."""
        rows, found = [], []
        for at, buf, offs in tb.slices(texts):
            g, first = shingles(buf, offs, self.size)
            flag = np.zeros(len(g) + 1, np.int64)
            np.cumsum(self.there[(g >> np.uint64(64 - self.bits)).astype(np.int64)], out=flag[1:])
            for i in np.flatnonzero(flag[first[1:]] > flag[first[:-1]]).tolist():
                own = self.leaks(g[first[i] : first[i + 1]], threshold)
                rows += [at + i] * len(own)
                found += own
        return np.array(rows, np.int64), found


def _minima(g: np.ndarray, starts: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The shingle that ranks lowest under a permutation in each run of g from a start to the next."""
    ranks = tb.mix(g ^ seed)
    low = np.minimum.reduceat(ranks, starts)
    size = np.diff(np.append(starts, len(g)))
    at = np.flatnonzero(ranks == np.repeat(low, size))  # the permutation is a bijection and a run's shingles are distinct: one each
    return g[at]


def _found(shared, schema: pa.Schema, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, text_of = shared.value  # ids: item ids by distinct text, a text's from text_of[n] on
        own = pa.array(ids, schema.field(1).type)
        for batch in batches:
            rows, leaks = index.search(batch.column(1), threshold)
            n = np.array([x[0] for x in leaks], np.int64)
            size = text_of[n + 1] - text_of[n]
            each = np.repeat(np.arange(len(n)), size)
            item = np.repeat(text_of[n] - np.cumsum(size) + size, size) + np.arange(size.sum())
            numbers = [pa.array(np.array([x[k] for x in leaks], np.int64)[each]) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[each])), own.take(pa.array(item)), *numbers], schema=schema)

    return run


def _clean(shared, column: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value[0]
        for batch in batches:
            rows, _ = index.search(batch.column(column).cast(pa.string()), threshold)
            keep = np.ones(batch.num_rows, bool)
            keep[rows] = False
            yield batch.filter(pa.array(keep))

    return run


def indexes(items: DataFrame, size: int = SHINGLE, perms: int = PERMS) -> Iterator[tuple]:
    """(index, item ids, where each distinct text's ids begin) of blocks of about BLOCK_BYTES of text, one at a time.

    An index is built once, on the driver, of one block; it is some seven times its text. Rows are dealt by a number of
    their own, so that repeated items spread."""
    items = items.select(F.monotonically_increasing_id().alias("n"), "item_id", F.col("text").cast("string")).where("text is not null")
    items = written(items, "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = -(-int(total) // BLOCK_BYTES)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == k).select("item_id", "text").collect()  # a block, of bounded size
        by_text: dict[str, list] = {}
        for r in own:
            by_text.setdefault(r.text, []).append(r.item_id)
        at = np.concatenate([[0], np.cumsum([len(x) for x in by_text.values()])]).astype(np.int64)
        yield Index(list(by_text), size, perms), [i for x in by_text.values() for i in x], at


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, perms: int = PERMS) -> DataFrame:
    """A row for each item in each document: doc_id, item_id, item_shingles, shared_shingles."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, item_shingles long, shared_shingles long"
    out = spark.createDataFrame([], kinds)
    schema = to_arrow_schema(out.schema)
    ready = docs.select("doc_id", F.col("text").cast("string"))
    for k, index in enumerate(indexes(items, size, perms)):
        found = ready.mapInArrow(_found(spark.sparkContext.broadcast(index), schema, threshold), kinds)
        out = found if k == 0 else out.union(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, perms: int = PERMS) -> DataFrame:
    """The rows of docs that no item leaks into, all their columns unchanged. Each row is judged where it is read: nothing
    is shuffled, and rows with equal or null doc_ids have nothing to do with one another."""
    for index in indexes(items, size, perms):
        docs = in_arrow(docs, _clean(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text"), threshold))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every leak of a benchmark item into a document, with the containment."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))
