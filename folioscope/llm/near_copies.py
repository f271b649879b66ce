"""Near copies by five-word shingles: buckets by MinHash bands, bit-sliced SimHash distances within them, and exact Jaccard
of the whole shingle sets, which alone decides.

Texts with equal shingle sets are one class. At a similarity of 0.8 SimHash fingerprints differ in about ten of 64 bits,
which no split of the bits into blocks reaches; so buckets are formed by ``BANDS`` bands of ``ROWS`` minima, which miss a
pair of that similarity with a probability of 0.59**24, 4e-6. A bucket with more than ``DEEP`` classes is dealt again by
the other bands (a pair then has to agree in two bands: missed with 6e-5). Every member of a bucket is first verified
against the smallest and the greatest class there. Of those that are not connected afterwards, SimHash fingerprints over
the same shingles are compared in bit planes, and pairs that differ in more than ``RADIUS`` bits are left (at 0.8 the
distance is 9.7 with a deviation of 2.9: missed with 1e-6): each class is verified against the closest one, and then all
pairs that are still apart, but for those that cannot have the similarity. Which these are is exact: shingles that no other
class has are left out, the others are counted in ``PARTS`` parts by their hash, and the sum of the lesser counts is more
than two classes can share. So a cluster costs pairs in proportion to its members, not to their square, and texts that only share a bucket or a
passage cost next to none.

Defined results: words are those of SimHash (white space, ASCII case); a text of under five words has one shingle, all
its words; null, empty and blank texts are equal; a document is a doc_id with a text: rows that share both are one, rows
that share a doc_id, or have none, over different texts are not. A null doc_id is the smallest id where nothing else is
reachable. A very long text is hashed by one task, in whole; without documents results are empty; other columns, whatever
their names, pass ``first_copies`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import textbuf as tb
from folioscope.llm.bitslice import close_pairs, majority
from folioscope.llm.graph import components
from folioscope.llm.store import dropped, every, free, keys_of, written

SHINGLE, THRESHOLD, BANDS, ROWS, DEEP, RADIUS, PARTS = 5, 0.8, 24, 4, 1024, 24, 64
_XOR = tb.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_ODD = tb.mix(np.arange(5001, 5001 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, row after row, and the index of each row's first."""
    low = tb.lower(buf)
    starts, ends, first = tb.words(low, offs)
    h, count = tb.hashes(low, starts, ends), np.diff(first)
    g, at = tb.grams(h, first, size)
    values, rows = [g], [np.searchsorted(first, at, "right") - 1]
    for n in range(size):  # short texts: all their words
        own = np.flatnonzero(count == n)
        v = np.full(len(own), n, np.uint64)
        for k in range(n):
            v = tb.mix(v + h[first[own] + k])
        values.append(v)
        rows.append(own)
    v, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((v, row))
    v, row = v[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    v, row = v[new], row[new]
    return v, np.searchsorted(row, np.arange(len(offs)))


def _classes(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number of each row's set."""
    return tb.mix(np.add.reduceat(tb.mix(v ^ _XOR[0]), first[:-1]) + np.diff(first).astype(np.uint64)).view(np.int64)


def _bands(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, BANDS): a key of the minima of each band."""
    out = np.empty((len(first) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(first) - 1, band, np.uint64)
        for p in range(band * ROWS, (band + 1) * ROWS):
            key = tb.mix(key ^ np.minimum.reduceat((v ^ _XOR[p]) * _ODD[p], first[:-1]))
        out[:, band] = key
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, buf, offs in tb.slices(batch.column(3)):
            v, first = shingle_sets(buf, offs)
            keys, n = _bands(v, first), len(offs) - 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            own = [pa.array(_classes(v, first)), pa.array(majority(v, first).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, n) for k in range(3)), *own], ["doc_id", "k1", "k2", "set", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, buf, offs in tb.slices(batch.column(1)):
            v, first = shingle_sets(buf, offs)
            own = pa.array([v[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offs) - 1), own], ["set", "shingles"])


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= threshold * (len(x) + len(y) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return run


def shingles_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, shingles) of the wanted classes, each from a single document of its own."""
    k1, k2 = keys_of(docs)
    first = classes.join(wanted, "set", "left_semi").select("set", "least.k1", "least.k2")
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    texts = texts.join(first, ["k1", "k2"]).select("set", "text", "k1", "k2").dropDuplicates(["k1", "k2"])
    return written(texts.select("set", "text").mapInArrow(_sets, "set long, shingles binary"), "sets")


def verified(sets: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs of classes (a, b) whose shingle sets have at least that Jaccard similarity."""
    pairs = written(pairs.distinct(), "pairs")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(_similar(threshold), "a long, b long"), "similar")


def buckets(classes: DataFrame, deep: int = DEEP) -> DataFrame:
    """(k, k2, set, fp): the classes (set, fp, keys) of each bucket that has more than one."""
    keyed = classes.select("set", "fp", F.explode("keys").alias("k"))
    counts = written(keyed.groupBy("k").count().where("count > 1"), "counts")
    held = written(keyed.join(counts, "k"), "held")
    flat = held.where(F.col("count") <= deep).select("k", F.lit(0).cast("long").alias("k2"), "set", "fp")
    more = held.where(F.col("count") > deep).select("k", "set").join(classes, "set").select("k", F.explode("keys").alias("k2"), "set", "fp").where("k2 != k")
    out = written(flat.union(more), "buckets")
    dropped(counts, held)
    return out


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        if own:
            rows = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(own))], ["set", "s"])


def _room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a class's shingles and those of them that no other class has: how many there are, and of the others how many
    fall into each of PARTS parts by their hash."""
    for batch in batches:
        n, parts = [], []
        for own, alone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            own = np.frombuffer(own.as_buffer(), np.int64)
            n.append(len(own))
            count = np.bincount(own & (PARTS - 1), minlength=PARTS) - np.bincount(np.array(alone or [], np.int64) & (PARTS - 1), minlength=PARTS)
            parts.append(count.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(parts, pa.binary())], ["set", "n", "parts"])


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of packed counts as rows."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint32).reshape(-1, PARTS)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket (k, k2) of sorted rows (k, k2, root, ...) that has more than one root."""
    held: list[np.ndarray] = []

    def whole(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        k, k2, root = cols[:3]
        edge = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (k2[1:] != k2[:-1])) + 1, [len(k)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if root[a] != root[b - 1]:  # sorted by root
                yield [c[a:b] for c in cols[2:]]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_matrix(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield from whole([c[:cut] for c in cols])
    if held and len(held[0]):
        yield from whole(held)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class with a close one of another root in its bucket (root, set, fp): the closest such one."""
    for root, own, fp in _buckets(batches):
        fp = fp.view(np.uint64)
        i, j = close_pairs(fp, RADIUS, lambda i, j, root=root: root[i] != root[j])
        if len(i):
            bits = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
            one, two, bits = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([bits, bits])
            order = np.lexsort((two, bits, one))
            first = order[np.concatenate([[True], one[order][1:] != one[order][:-1]])]
            a, b = own[one[first]], own[two[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _possible(threshold: float, step: int = 1 << 15):
    """Pairs of different roots in a bucket (root, set, fp, n, parts) that can have the similarity: two classes share no more
    than the lesser of their counts in each part, summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, own, fp, n, parts in _buckets(batches):

            def keep(i: np.ndarray, j: np.ndarray, root=root, n=n, parts=parts) -> np.ndarray:
                out = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
                for at in range(0, len(i), step):
                    k = at + np.flatnonzero(out[at : at + step])
                    most = np.minimum(parts[i[k]], parts[j[k]]).sum(axis=1, dtype=np.int64)
                    out[k] = most >= threshold * (n[i[k]] + n[j[k]] - most)
                return out

            i, j = close_pairs(fp.view(np.uint64), RADIUS, keep)
            if len(i):
                a, b = own[i], own[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _rooted(dealt: DataFrame, roots: DataFrame, *more: DataFrame) -> DataFrame:
    """(k, k2, root, set, fp, ...): buckets with what their classes are connected to so far, sorted."""
    rows = dealt.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    for m in more:
        rows = rows.join(m, "set")
    added = [c for m in more for c in m.columns if c != "set"]
    return rows.select("k", "k2", "root", "set", "fp", *added).repartition("k", "k2").sortWithinPartitions("k", "k2", "root", "set")


def linked(dealt: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the classes that are connected over pairs of at least that similarity within buckets.

    Three steps, each with verified pairs in proportion to the buckets' rows but for the last: every class with the two
    ends of its bucket; every class with the closest one that it is not connected with; and all pairs that are still apart
    and cannot be ruled out by counts of their shared shingles."""
    # each side of a join is a table of its own, so that Spark can split the partition of a bucket that most share
    ends = written(dealt.groupBy("k", "k2").agg(F.min("set").alias("lo"), F.max("set").alias("hi")), "ends")
    hubs = dealt.join(ends, ["k", "k2"]).select("set", F.explode(F.array("lo", "hi")).alias("hub")).where("set != hub")
    links = verified(sets, hubs.select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")), threshold)
    roots = components(links)
    near = written(_rooted(dealt, roots).mapInArrow(_nearest, "a long, b long").distinct(), "nearest")
    if near.isEmpty():
        return roots
    more = verified(sets, near, threshold)
    links = written(links.union(more), "links")
    roots = components(links)
    open_ = sets.join(near.select(F.col("a").alias("set")).union(near.select("b")).distinct(), "set", "left_semi")
    shingles = open_.mapInArrow(_exploded, "set long, s long").groupBy("s").agg(F.min("set").alias("set"), F.count(F.lit(1)).alias("n"))
    alone = shingles.where("n = 1").groupBy("set").agg(F.collect_list("s").alias("alone"))  # at most a text's own
    room = open_.join(alone, "set", "left").select("set", "shingles", "alone").mapInArrow(_room, "set long, n long, parts binary")
    pairs = _rooted(dealt, roots, written(room, "room")).mapInArrow(_possible(threshold), "a long, b long")
    last = verified(sets, pairs, threshold)
    return components(links.union(last)) if not last.isEmpty() else roots


def groups(docs: DataFrame, threshold: float = THRESHOLD, deep: int = DEEP) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, set) of all documents, and (set, component, first): a class's smallest reachable doc_id, and
    the document (doc_id, k1, k2) that stands for its group."""
    kind = dict(docs.dtypes)["doc_id"]
    k1, k2 = keys_of(docs)
    signed = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string")).mapInArrow(_signed, f"doc_id {kind}, k1 long, k2 long, set long, fp long, keys array<long>")
    prints = written(signed, "prints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    classes = written(prints.groupBy("set").agg(F.min(place).alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    dealt = buckets(classes.select("set", "fp", "keys"), deep)
    sets = shingles_of(docs, classes, written(dealt.select("set").distinct(), "wanted"))
    roots = linked(dealt, sets, threshold)
    dropped(dealt, sets)
    rooted = written(classes.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("first")), "least")
    named = written(rooted.join(least, "root").select("set", F.col("first.doc_id").alias("component_id"), "first"), "named")
    dropped(classes, roots, rooted, least)
    return prints.select("doc_id", "k1", "k2", "set"), named


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, deep: int = DEEP) -> DataFrame:
    """doc_id, set (long) and component_id, the smallest doc_id reachable over pairs of at least that similarity."""
    rows, named = groups(docs, threshold, deep)
    return rows.join(named, "set").select("doc_id", "set", "component_id")


def first_copies(docs: DataFrame, threshold: float = THRESHOLD, deep: int = DEEP) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id (a null one last; of equal ids one text)."""
    _, named = groups(docs, threshold, deep)
    one, two = free(docs, "_k1", "_k2")
    first = named.select(F.col("first.k1").alias(one), F.col("first.k2").alias(two)).distinct()
    keyed = docs.select(*every(docs), *(k.alias(n) for k, n in zip(keys_of(docs), (one, two), strict=True)))
    return keyed.join(first, [one, two], "left_semi").dropDuplicates([one, two]).select(*every(docs))
