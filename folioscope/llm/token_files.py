"""Token ids as binary files: canonical length-limited Huffman codes from global counts, in blocks that decode alone.

File format (little-endian): magic, header length, header (JSON: part, first block's number, tokens before it within the part, highest id + 1),
the code length of every id (one byte each, Zstandard), the blocks, their table (position, length), its size and the
trailing magic. A block holds whole documents: numbers of documents and ids, document ids and lengths, a checkpoint - the
bit at which an id begins - every ``EVERY`` ids, the CRC-32 of the bits, the bits. Code lengths are at most ``LIMIT`` bits
(package-merge), so one look-up in a table of 2**LIMIT entries decodes an id; all stretches between checkpoints decode
side by side.

Ids are counted over all documents; the lengths of the codes are as many as the vocabulary has ids, whatever the corpus.
Documents are dealt out by range of doc_id and sorted; a part is a range, files follow one another in it. ``start`` is a
running sum over the parts' own token counts, taken in two steps and joined as a table.

Defined results: a null text is an empty one and has the end alone; rows with one doc_id (ties) stand next to each other in
the order in which they are read, null doc_ids first; repeated rows are written each; a very long text is encoded and held
by one task, in whole, in a block of its own length; without documents there is no file and no row. Columns other than
doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.binsink import read_files, write_files
from folioscope.llm.store import place, removed, table, written
from folioscope.llm.tokens import encoder, vocabulary_path, with_end

VOCABULARY, END = "word_bpe_49k.json", 1
LIMIT, EVERY, BLOCK, FILE, PART = 18, 512, 1 << 18, 8 << 20, 8 << 20
MAGIC, TRAILER = b"FSTK0001", b"KTSF"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code whose codes have at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    n = len(used)
    weight, levels = coins, []  # levels: whether each item of a list, in order of weight, is a coin
    for _ in range(limit):
        levels.append(None)
        if len(levels) == 1:
            merged, is_coin = coins, np.ones(n, bool)
        else:
            pairs = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(1)
            merged = np.concatenate([coins, pairs])
            order = np.argsort(merged, kind="stable")
            merged, is_coin = merged[order], order < n
        levels[-1] = is_coin
        weight = merged
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for is_coin in reversed(levels):
        here = int(is_coin[:take].sum())
        length[:here] += 1
        take = 2 * (take - here)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: in order of length, then id."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = order[lengths[order] == n]
        code <<= n - before
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, before = code + len(own), n
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """id and code length by the next ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.left_shift(1, limit - lengths[order].astype(np.int64))
    ids = np.repeat(order, span)
    size = np.repeat(lengths[order], span)
    room = (1 << limit) - len(ids)
    return np.append(ids, np.zeros(room, np.int64)).astype(np.uint16), np.append(size, np.ones(room, np.uint8)).astype(np.uint8)


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """The codes of ids, from the highest bit of each byte on, and the bit at which every ``every``-th begins."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    out = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        word, code = start >> 6, codes[ids]
        over = (start & 63) + size - 64  # bits that go on in the next word
        main = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(main, first)
        cut = np.flatnonzero(over > 0)
        out[word[cut] + 1] |= code[cut] << (64 - over[cut]).astype(np.uint64)
    return out.byteswap().tobytes()[: -(-total // 8)], start[::every].astype(np.uint32 if total < 2**32 else np.uint64)


def unpack_bits(data: bytes | memoryview, marks: np.ndarray, n: int, ids: np.ndarray, size: np.ndarray, limit: int = LIMIT, every: int = EVERY) -> np.ndarray:
    """n ids; all stretches between checkpoints advance together."""
    raw = np.frombuffer(bytes(data) + b"\0" * 8, np.uint8)
    windows = np.zeros(len(raw) - 3, np.uint32)  # the 32 bits from each byte on
    for k in range(4):
        windows = (windows << np.uint32(8)) | raw[k : k + len(windows)]
    at = marks.astype(np.int64)
    out = np.zeros((len(at), every), np.uint16)
    for k in range(every):
        bits = (windows[np.minimum(at >> 3, len(windows) - 1)] >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[:, k] = ids[bits]
        at += size[bits]
    return out.ravel()[:n]


class Writer:
    """A file in the making."""

    def __init__(self, lengths: np.ndarray, codes: np.ndarray, part: int, number: int, before: int):
        head = json.dumps({"part": part, "number": number, "before": before, "ids": len(lengths), "limit": LIMIT, "every": EVERY}).encode()
        lens = zstandard.ZstdCompressor(level=9).compress(lengths.tobytes())
        self.lengths, self.codes = lengths, codes
        self.out = [MAGIC, struct.pack("<II", len(head), len(lens)), head, lens]
        self.at, self.table, self.n_ids = sum(map(len, self.out)), [], 0

    def block(self, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> None:
        bits, marks = pack_bits(ids, self.lengths, self.codes)
        null = np.array([d is None for d in doc_ids], np.uint8)
        docs = np.array([d or 0 for d in doc_ids], np.int64)
        body = b"".join(
            [struct.pack("<IQIB", len(doc_ids), len(ids), zlib.crc32(bits), marks.itemsize), null.tobytes(), docs.tobytes(), np.array(sizes, np.int64).tobytes(), marks.tobytes(), bits]
        )
        self.table.append((self.at, len(body)))
        self.out.append(body)
        self.at += len(body)
        self.n_ids += len(ids)

    def close(self) -> bytes:
        table = b"".join(struct.pack("<QQ", *x) for x in self.table)
        return b"".join([*self.out, table, struct.pack("<IQ", len(self.table), self.n_ids), TRAILER])


class Reader:
    """Blocks of a file, any of them alone."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC or bytes(data[-4:]) != TRAILER:
            raise ValueError("not a token file")
        h, n = struct.unpack("<II", data[8:16])
        self.data, self.head = data, json.loads(bytes(data[16 : 16 + h]))
        self.lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16 + h : 16 + h + n]), np.uint8)
        count, self.n_ids = struct.unpack("<IQ", data[-16:-4])
        self.table = list(struct.iter_unpack("<QQ", data[len(data) - 16 - 16 * count : len(data) - 16]))

    def block(self, k: int, lookup: tuple[np.ndarray, np.ndarray]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Document ids, their lengths and all ids of block k."""
        at, size = self.table[k]
        body = self.data[at : at + size]
        n_docs, n_ids, crc, width = struct.unpack("<IQIB", body[:17])
        null, at = np.frombuffer(body[17 : 17 + n_docs], np.uint8), 17 + n_docs
        docs, sizes = np.frombuffer(body[at : at + 8 * n_docs], np.int64), np.frombuffer(body[at + 8 * n_docs : at + 16 * n_docs], np.int64)
        at += 16 * n_docs
        every = self.head["every"]
        n = -(-n_ids // every)
        marks = np.frombuffer(body[at : at + width * n], np.uint32 if width == 4 else np.uint64)
        bits = body[at + width * n :]
        if zlib.crc32(bits) != crc:
            raise ValueError("a block is damaged")
        return [None if x else d for x, d in zip(null.tolist(), docs.tolist(), strict=True)], sizes, unpack_bits(bits, marks, n_ids, *lookup, self.head["limit"], every)


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, False)
        for batch in batches:
            for at, ids, first in own.encode(batch.column(1)):
                ids, first = with_end(ids, first, end)
                n = len(first) - 1
                blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(2 * first), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), blob], ["doc_id", "ids"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "c"])


def _files(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths, codes = shared.value
        part, number, before, writer = TaskContext.get().partitionId(), 0, 0, None
        docs, sizes, ids, held = [], [], [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], ["file"])

        def flush():
            nonlocal docs, sizes, ids, held
            writer.block(docs, sizes, np.frombuffer(b"".join(ids), "<u2"))
            docs, sizes, ids, held = [], [], [], 0

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or Writer(lengths, codes, part, number, before)
                data = x.as_buffer().to_pybytes()
                docs.append(d)
                sizes.append(len(data) // 2)
                ids.append(data)
                held += len(data) // 2
                if held >= BLOCK:
                    flush()
                    if writer.at >= FILE:
                        number, before = number + 1, before + writer.n_ids
                        yield row()
                        writer = None
        if docs:
            flush()
        if writer:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Token files of all documents, ascending by doc_id, in the folder path."""
    spark = docs.sparkSession
    ready = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids_at = place(spark, "ids")
    ready.mapInArrow(_encoded(vocabulary or vocabulary_path(VOCABULARY), end), "doc_id long, ids binary").write.parquet(ids_at)
    ids = spark.read.schema("doc_id long, ids binary").parquet(ids_at)
    rows = ids.select("ids").mapInArrow(_counts, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()  # a row for each id
    counts = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.c
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))
    parts = max(1, -(-2 * int(counts.sum()) // PART))
    order = [F.col("doc_id").asc_nulls_first(), "n"]  # a number of the row's own, so that many rows with one doc_id fill many parts
    ordered = ids.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("n")
    write_files(ordered.mapInArrow(_files(shared), "file binary"), "file", path, TRAILER)
    removed(spark, ids_at)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lookup, key = None, None
    for batch in batches:
        for content in batch.column(1):
            r = Reader(content.as_buffer())
            if key != r.lengths.tobytes():
                lookup, key = decode_table(r.lengths, r.head["limit"]), r.lengths.tobytes()
            before = r.head["before"]
            for k in range(len(r.table)):
                docs, sizes, ids = r.block(k, lookup)
                wide = ids.astype("<u4")
                first = np.concatenate([[0], np.cumsum(sizes)])
                view = memoryview(wide).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r.head["part"])), pa.array(docs, pa.int64()), pa.array(before + first[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )
                before += int(first[-1])


def offsets(parts: DataFrame, group: int = 4096) -> DataFrame:
    """(part, before): the sum of n of all earlier parts, from the rows (part, n) of files.

    Sums of ``group`` parts first, then within the groups: no task sees more than a few thousand rows, nor does the driver."""
    own = parts.groupBy("part").agg(F.sum("n").alias("n")).withColumn("g", F.expr(f"part div {group}"))
    sums = own.groupBy("g").agg(F.sum("n").alias("n"))
    ahead = sums.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("within", within).join(ahead, "g").select("part", (F.col("ahead") + F.col("within")).alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files."""
    rows = read_files(spark, path).mapInArrow(_rows, "part long, doc_id long, local long, n_tokens long, ids_crc32 long")
    before = written(offsets(read_files(spark, path).mapInArrow(_totals, "part long, n long")), "offsets")
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [Reader(c.as_buffer()) for c in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([r.head["part"] for r in own], pa.int64()), pa.array([r.n_ids for r in own], pa.int64())], ["part", "n"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents, written and read back."""
    path = place(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
