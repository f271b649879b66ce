"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance, exactly.

Fingerprints are compared once each, however many documents have them. Two within ``radius`` of 2 differ in at most two
of four 16-bit blocks, so they agree in two: each fingerprint goes into the six buckets of its block pairs. A bucket with
more than ``DEEP`` members is dealt out again by the same rule over four 8-bit blocks of its free 32 bits; such a bucket
has 48 fixed bits, so 65,536 members at most, by construction and without a cap. Within a bucket the bits are stored in
vertical planes, 64 fingerprints to a machine word; distances of whole words of them to many query fingerprints grow
together in carry-save counters (``bitslice``), and a block of queries is left as soon as all its distances exceed the
radius. A bucket gives a spanning star of each of its groups, not pairs; components of those
edges over all buckets are those of the links.

Defined results: a null text is an empty one; texts without a word have fingerprint zero and link like any other; a null
doc_id takes part and is the smallest id where nothing else is reachable; repeated rows give repeated results; a very long
text is hashed by one task, in whole; without documents the result is empty. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bitslice import close_pairs, listed_pairs
from folioscope.llm.graph import components
from folioscope.llm.near_copies import first_copies
from folioscope.llm.store import dropped, table, written

SHINGLE, SEED, RADIUS = 3, 42, 2
DEEP = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits over the XXH64 of all shingles of a UTF-8 text."""
    line = b" ".join(text.lower().split())  # bytes: ASCII only, both
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    starts, ends = [0, *[x + 1 for x in gaps]], [*gaps, len(line)]
    digest = xxhash.xxh64_intdigest
    if len(starts) <= shingle:
        return digest(line, seed)
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
    counts, step = np.zeros(64, np.int64), 4096
    for i in range(0, len(h), step):
        part = h[i : i + step]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        out = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a long."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_prints, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach over the pairs."""
    root = np.arange(n)
    while len(i):
        lo = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], lo)
        np.minimum.at(new, root[j], lo)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


SMALL = 64


def _edges_of(fps: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of all buckets, which lie one after another with the given sizes."""
    first = np.concatenate([[0], np.cumsum(size)])
    out = []
    i_all, j_all = [], []
    for n in np.unique(size[(size > 1) & (size <= SMALL)]):
        i, j = np.triu_indices(int(n), 1)
        at = first[:-1][size == n]
        i_all.append((at[:, None] + i).ravel())
        j_all.append((at[:, None] + j).ravel())
    if i_all:
        i, j = np.concatenate(i_all), np.concatenate(j_all)
        ok = listed_pairs(fps, i, j, radius)
        out.append((i[ok], j[ok]))
    for k in np.flatnonzero(size > SMALL):
        i, j = close_pairs(fps[first[k] : first[k + 1]], radius)
        root = stars(int(size[k]), i, j)
        i = np.flatnonzero(root != np.arange(len(root)))
        out.append((i + first[k], root[i] + first[k]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    root = stars(len(fps), i, j)
    i = np.flatnonzero(root != np.arange(len(root)))
    return fps[i], fps[root[i]]


def _compare(radius: int):
    def flush(keys: list[np.ndarray], fps: np.ndarray) -> pa.RecordBatch:
        new = np.zeros(len(fps), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(fps)))
        a, b = _edges_of(fps, size, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns: keys, then the fingerprint; the last bucket may go on in the next batch
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            same = np.ones(len(cols[0]), bool)
            for k in cols[:-1]:
                same &= k == k[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield flush([c[:cut] for c in cols[:-1]], cols[-1][:cut].view(np.uint64))
        if held and len(held[0]):
            yield flush(held[:-1], held[-1].view(np.uint64))

    return run


def _blocks(value, width: int) -> list[tuple[int, F.Column]]:
    """The six pairs of four blocks of ``width`` bits, each as (its number, its bits as one long)."""
    part = [F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(4)]
    return [(n, F.shiftleft(part[i], width).bitwiseOR(part[j])) for n, (i, j) in enumerate(combinations(range(4), 2))]


def _rest(value) -> F.Column:
    """By the number t of a block pair: the 32 bits of the other two blocks, in one long."""
    part = [F.shiftrightunsigned(value, k * 16).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    out = None
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        a, b = (k for k in range(4) if k not in (i, j))
        bits = F.shiftleft(part[a], 16).bitwiseOR(part[b])
        out = F.when(F.col("t") == n, bits) if out is None else out.when(F.col("t") == n, bits)
    return out


def links(fps: DataFrame, radius: int = RADIUS, deep: int = DEEP) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (fp) exactly as all links within the radius do.

    The blocks are cut for a radius of at most 2."""
    if not 0 <= radius <= 2:
        raise ValueError("four blocks find distances up to 2")
    bucket = lambda pairs: F.explode(F.array(*[F.struct(F.lit(n).alias("t"), v.alias("k")) for n, v in pairs]))
    keyed = fps.select("fp", bucket(_blocks(F.col("fp"), 16)).alias("x")).select("fp", "x.t", "x.k")
    # a table of its own, so that Spark can split the partition of a block pair that most fingerprints share
    counts = written(keyed.groupBy("t", "k").count().where("count > 1"), "counts")
    held = keyed.join(counts, ["t", "k"])
    flat = held.where(F.col("count") <= deep).select("t", "k", F.lit(0).alias("t2"), F.lit(0).cast("long").alias("k2"), "fp")
    more = held.where(F.col("count") > deep).withColumn("rest", _rest(F.col("fp")))
    more = more.select("t", "k", "fp", bucket(_blocks(F.col("rest"), 8)).alias("y")).select("t", "k", (F.col("y.t") + 1).alias("t2"), F.col("y.k").alias("k2"), "fp")
    keys = ["t", "k", "t2", "k2"]
    dealt = flat.union(more).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "fp").mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over links.

    What joins is written before, so that Spark can split the partition of a fingerprint, or of a component, that a third
    of all rows have."""
    prints = written(fingerprints(docs), "simhash")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = written(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(rooted.join(least, "root").select("fp", "component_id"), "named")
    dropped(classes, roots, rooted, least)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: fingerprint in hexadecimal and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8; ``near_copies``). The parameters
    above bind op4's query only: ``links`` cannot find candidates at the ten bits or so that such copies differ in."""
    return first_copies(docs)
