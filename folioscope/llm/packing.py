"""Lexical retrieval packing: windows of one length, filled with documents that share words.

A document's ids, with its end, are cut into whole windows and a tail shorter than one. Tails are laid in lexical order and
cut into shards of about ``SHARD`` tokens, so that tails with much in common lie in one shard, at any size of the corpus:
the order is by MinHash over the frequent ids (a language, a register), then by minima in which an id counts by its idf
(rare ids in common). Many tails with one key, like the copies of a text, simply fill as many shards as they need.

A shard has an inverted index of its tails - for each id the tails that hold it, with their BM25 weights, ids of over a
quarter of its tails as rows of a matrix; the document frequencies, the number and the mean length of tails are those of
all shards. The next unused tail seeds a window. BM25 scores of the distinct ids of its whole document rank the unused
tails, and the best of those that still fit are taken in turn. When none fits, the best one is cut: it fills the window to
the brim, and what is left of it seeds the next. So every window but the last of a shard is full.

Sizes: shards and the frequencies of the vocabulary's ids are all that a task or the driver holds. Defined results: a null
text is an empty one and has its end alone; each row is packed, also repeated ones or with null doc_ids; of tails with
equal scores, or keys, the one that comes first in the order of (key, row) is first; a very long text is encoded by one
task, in whole, and its whole windows pass unsearched; without documents the result is empty. Columns other than doc_id
and text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.store import table, written
from folioscope.llm.tokens import encoder, vocabulary_path, with_end

VOCABULARY, END, WINDOW, SHARD = "byte_bpe_50k.json", 0, 1024, 1 << 19
K1, B = 1.5, 0.75
FREQUENT, DENSE, IDS = 1 / 16, 1 / 4, 1 << 16


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _distinct(ids: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The distinct ids, ascending; held: a flag for every id, all unset before and after."""
    held[ids] = True
    out = np.flatnonzero(held).astype(np.uint16)
    held[out] = False
    return out


def _tokens(path: str, end: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = encoder(path, True), np.zeros(IDS, bool)
        for batch in batches:
            for at, ids, first in own.encode(batch.column(2)):
                ids, first = with_end(ids, first, end)
                n = len(first) - 1
                crcs, tails, asks = [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    whole = (b - a) // window
                    crcs.append([crc(ids[a + k * window : a + (k + 1) * window]) for k in range(whole)])
                    tails.append(ids[a + whole * window : b].tobytes())
                    asks.append(_distinct(ids[a:b], held).tobytes() if whole and len(tails[-1]) else None)
                columns = [pa.array(np.diff(first)), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(asks, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *columns], ["rid", "doc_id", "doc_tokens", "crcs", "tail", "ask"])

    return run


def _joined(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of blobs in a row, and where each row's begin."""
    wide = blobs.cast(pa.large_binary())
    offs = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], "<u2") if wide.buffers()[2] else np.zeros(0, np.uint16)
    return data[offs[0] // 2 : offs[-1] // 2], (offs - offs[0]) // 2


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(IDS, np.int64)
    for batch in batches:
        if batch.num_rows:
            ids, first = _joined(batch.column(0))
            wide = np.uint32 if batch.num_rows < 1 << 16 else np.uint64
            pairs = np.sort((np.repeat(np.arange(batch.num_rows, dtype=wide), np.diff(first)) << wide(16)) | ids)
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            df += np.bincount((pairs[new] & wide(IDS - 1)).astype(np.int64), minlength=IDS)
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["id", "df"])


class Statistics:
    """idf of every id, and the mean length of tails, over all documents; and the ranks of ids that lay tails in order."""

    def __init__(self, df: np.ndarray, n: int, tokens: int, seed: int = 3):
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = tokens / max(n, 1)
        draw = np.random.default_rng(seed).exponential(size=(4, IDS))
        frequent = df > FREQUENT * n
        draw[0, ~frequent] = np.inf
        draw[1:] /= self.idf  # the least of them is an id with a probability in proportion to its idf
        draw[1:, (df < 2) | frequent] = np.inf
        #: for each key the rank of every id in a random order; ids that don't count are last
        self.rank = np.empty((4, IDS), np.uint16)
        for k in range(4):
            self.rank[k, np.argsort(draw[k], kind="stable")] = np.arange(IDS)
            self.rank[k, np.isinf(draw[k])] = IDS - 1

    def keys(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A number for each row of ids: rows with equal minima get equal ones; blank rows come last."""
        out = np.full(len(first) - 1, 2**64 - 1, np.uint64)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            low = [np.minimum.reduceat(r[ids], first[full]).astype(np.uint64) for r in self.rank]
            out[full] = (low[0] << np.uint64(48)) | (low[1] << np.uint64(32)) | (low[2] << np.uint64(16)) | low[3]
        return out


class Inverted:
    """Postings of a shard: for each id the tails that hold it and their BM25 weights; ids of many tails as a matrix."""

    def __init__(self, tails: list[np.ndarray], stats: Statistics):
        self.n = n = len(tails)
        size = np.array([len(t) for t in tails], np.int64)
        doc, ids = np.repeat(np.arange(n), size), np.concatenate(tails) if n else np.zeros(0, np.uint16)
        wide = np.uint32 if IDS * n < 1 << 32 else np.uint64
        key, tf = np.unique(ids.astype(wide) * wide(n) + doc.astype(wide), return_counts=True) if len(ids) else (np.zeros(0, wide),) * 2
        ids, doc = (x.astype(np.int64) for x in np.divmod(key, wide(max(n, 1))))
        weight = (stats.idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / stats.mean))).astype(np.float32)
        count = np.bincount(ids, minlength=IDS)
        common = np.flatnonzero(count > max(DENSE * n, 8))
        self.row, self.held = np.full(IDS, -1, np.int64), np.zeros(IDS, bool)
        self.row[common] = np.arange(len(common))
        dense = self.row[ids] >= 0
        self.matrix = np.zeros((len(common), n), np.float32)
        self.matrix[self.row[ids[dense]], doc[dense]] = weight[dense]
        self.doc, self.weight = doc[~dense], weight[~dense]
        self.first = np.searchsorted(ids[~dense], np.arange(IDS + 1))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of all tails for a query's distinct ids."""
        q = _distinct(query, self.held).astype(np.int64)
        rows = self.row[q]
        out = self.matrix[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
        q = q[rows < 0]
        a, n = self.first[q], self.first[q + 1] - self.first[q]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(q) else np.zeros(0, np.int64)
        return out + np.bincount(self.doc[at], self.weight[at], self.n)


def _best(score: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` of own with the highest scores, best first, equal ones in order."""
    s = score[own]
    if len(own) > most:
        least = np.partition(s, len(s) - most)[len(s) - most]
        above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
        pick = np.sort(np.concatenate([above, equal[: most - len(above)]]))
        own, s = own[pick], s[pick]
    return own[np.argsort(-s, kind="stable")]


def _taken(score: np.ndarray, size: np.ndarray, left: np.ndarray, room: int) -> tuple[list[int], int]:
    """Tails of left that go into a window with so much room - the best that fits, again and again - and the room then left.

    Room only shrinks, so what does not fit once never will: one walk in order of score, the first ``room`` of it at a
    time, as each tail takes a place at least."""
    out: list[int] = []
    fits = left[size[left] <= room]
    while room and len(fits):
        walk = _best(score, fits, room)
        for k in walk.tolist():
            if size[k] <= room:
                out.append(k)
                room -= int(size[k])
        gone = np.zeros(len(score), bool)
        gone[walk] = True
        fits = fits[~gone[fits] & (size[fits] <= room)]
    return out, room


def fill(tails: list[np.ndarray], stats: Statistics, window: int = WINDOW, asks: list[np.ndarray | None] | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, its first id, length). asks: the ids that search for a tail's neighbours, if not its own."""
    index = Inverted(tails, stats)
    size = np.array([len(t) for t in tails], np.int64)
    unused = size > 0
    left = np.flatnonzero(unused)  # some of these are used; renewed when half are
    out: list[list[tuple[int, int, int]]] = []
    n_left, seed, at, following = len(left), -1, 0, 0
    while True:
        if seed < 0:  # the next unused tail
            while following < len(tails) and not unused[following]:
                following += 1
            if following == len(tails):
                return out
            seed, at = following, 0
            unused[seed] = False
            n_left -= 1
        pieces = [(seed, at, int(size[seed]) - at)]
        room = window - pieces[0][2]
        if room and n_left:
            score = index.scores(tails[seed] if asks is None or asks[seed] is None else asks[seed])
            if 2 * n_left < len(left):
                left = left[unused[left]]
            open_ = left[unused[left]]
            taken, room = _taken(score, size, open_, room)
            pieces += [(k, 0, int(size[k])) for k in taken]
            unused[taken] = False
            n_left -= len(taken)
        seed = -1
        if room and n_left:
            open_ = left[unused[left]]
            seed, at = int(open_[np.argmax(score[open_])]), room
            unused[seed] = False
            n_left -= 1
            pieces.append((seed, 0, room))
        out.append(pieces)


PIECE = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = shared.value.keys(*_joined(batch.column(4)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((key >> np.uint64(1)).astype(np.int64))], [*batch.schema.names, "key"])

    return run


def _packed(shared, schema: pa.Schema, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]  # a partition is a shard
        if not held:
            return
        shard = pa.Table.from_batches(held).combine_chunks().sort_by([("key", "ascending"), ("rid", "ascending")])
        number = TaskContext.get().partitionId() << 32
        ids, asks = ([None if x is None else np.frombuffer(x, "<u2") for x in shard[c].to_pylist()] for c in ("tail", "ask"))
        n = shard["doc_tokens"].to_numpy()
        rows = []  # (row, start, length, crc, sequence, offset)
        for k, crcs in enumerate(shard["crcs"].to_pylist()):
            for j, c in enumerate(crcs):
                rows.append((k, j * window, window, c, number, 0))
                number += 1
        for pieces in fill(ids, shared.value, window, asks):
            offset = 0
            for k, a, length in pieces:
                rows.append((k, int(n[k]) - len(ids[k]) + a, length, crc(ids[k][a : a + length]), number, offset))
                offset += length
            number += 1
        own = np.array(rows, np.int64).reshape(-1, 6)
        cols = [shard["doc_id"].combine_chunks().take(pa.array(own[:, 0])), *(pa.array(own[:, k]) for k in (1, 2, 3)), pa.array(n[own[:, 0]]), pa.array(own[:, 4]), pa.array(own[:, 5])]
        yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = END, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset there."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string"))
    run = _tokens(vocabulary or vocabulary_path(VOCABULARY), end, window)
    shape = f"rid long, doc_id {kind}, doc_tokens long, crcs array<long>, tail binary, ask binary"
    cut = written(rows.mapInArrow(run, shape), "tails")
    df = np.zeros(IDS, np.int64)
    for r in cut.select("tail").mapInArrow(_frequencies, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():  # a row for each id
        df[r.id] = r.df
    total = cut.agg(F.count(F.when(F.octet_length("tail") > 0, 1)).alias("n"), (F.coalesce(F.sum(F.octet_length("tail")), F.lit(0)) / 2).cast("long").alias("tokens")).first()
    shared = spark.sparkContext.broadcast(Statistics(df, total.n, total.tokens))
    keyed = cut.mapInArrow(_keyed(shared), f"{shape}, key long")
    dealt = keyed.repartitionByRange(max(1, -(-total.tokens // shard)), "key", "rid")
    schema = PIECE.format(kind)
    return dealt.mapInArrow(_packed(shared, to_arrow_schema(spark.createDataFrame([], schema).schema), window), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return pack(docs)
