from __future__ import annotations

import heapq
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import token_files as op
from folioscope.llm import tokens
from folioscope.llm.binsink import read_files
from folioscope.llm.store import place
from tests.llm.common import AWKWARD, documents, with_clashes

PLAIN = Tokenizer.from_file(tokens.vocabulary_path(op.VOCABULARY))


def brute(rows):
    out, at = {}, 0
    for d, t in sorted(rows):
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 1]
        out[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_sf_round_trip(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: tuple(r)[1:] for r in op.query(spark, sf).collect()} == want
    for name, value in (("BLOCK", 500), ("FILE", 1000), ("PART", 20_000)):
        monkeypatch.setattr(op, name, value)
    path = place(spark, "tokens")
    op.write_tokens(docs.repartition(7), path)
    assert read_files(spark, path).count() > 10
    assert {r.doc_id: tuple(r)[1:] for r in op.read_tokens(spark, path).collect()} == want


def optimal(counts):
    heap = [(c, i, (i,)) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    size = [0] * len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            size[i] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    return sum(c * s for c, s in zip(counts, size, strict=True))


def test_codes():
    rnd = np.random.default_rng(0)
    counts = rnd.zipf(1.4, 300) * (rnd.random(300) < 0.9)
    free = op.code_lengths(counts, 40)
    assert (free * counts).sum() == optimal(counts.tolist())
    for limit in (9, 10, 12):
        size = op.code_lengths(counts, limit)
        assert size.max() <= limit and (size > 0).tolist() == (counts > 0).tolist()
        assert (2.0 ** -size[size > 0].astype(float)).sum() == 1
        assert (size * counts).sum() >= (free * counts).sum()
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    # the best with at most four bits, found by trying all length profiles of a full code
    best = min(
        sum(c * s for c, s in zip(sorted(fib, reverse=True), p, strict=True)) for p in profiles(10, 4)
    )
    assert (op.code_lengths(fib, 4) * fib).sum() == best
    assert op.code_lengths(np.array([0, 5, 0]), 4).tolist() == [0, 1, 0]


def profiles(n, limit):
    def go(left, room, least):
        if left == 0:
            if room == 0:
                yield ()
            return
        for s in range(least, limit + 1):
            cost = 1 << (limit - s)
            if cost <= room:
                for rest in go(left - 1, room - cost, s):
                    yield (s, *rest)

    return go(n, 1 << limit, 1)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_bits(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.3, n), 4000).astype(np.int64)
    size = op.code_lengths(np.bincount(np.append(ids, [1, 2]), minlength=4001))
    bits, marks = op.pack_bits(ids, size, op.canonical(size))
    assert len(marks) == -(-n // op.EVERY)
    assert op.unpack_bits(bits, marks, n, *op.decode_table(size)).tolist() == ids.tolist()
    plain = "".join(format(int(op.canonical(size)[i]), f"0{size[i]}b") for i in ids)
    assert bits == bytes(int(plain[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(plain), 8))


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    path = place(spark, "tokens")
    op.write_tokens(with_clashes(documents(spark, texts)), path)
    got = {r.doc_id: tuple(r)[1:] for r in op.read_tokens(spark, path).collect()}
    assert got == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(3, "b"), (None, "a b c"), (3, "b"), (4, None)], "doc_id long, text string")
    path = place(spark, "tokens")
    op.write_tokens(df, path)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in op.read_tokens(spark, path).collect())
    assert [x[1] for x in got] == [None, 3, 3, 4]
    assert [x[0] for x in got] == np.cumsum([0, *[x[2] for x in got[:-1]]]).tolist()


def test_damage_is_seen(spark):
    size = op.code_lengths(np.arange(50))
    w = op.Writer(size, op.canonical(size), 0, 0, 0)
    w.block([1], [100], np.arange(100) % 49 + 1)
    data = bytearray(w.close())
    lookup = op.decode_table(size)
    assert op.Reader(data).block(0, lookup)[2].tolist() == (np.arange(100) % 49 + 1).tolist()
    at, n = op.Reader(data).table[0]
    data[at + n - 1] ^= 16
    with pytest.raises(ValueError):
        op.Reader(data).block(0, lookup)


def test_offsets_are_running_sums(spark):
    import random

    rnd = random.Random(4)
    parts = [(p, rnd.randint(0, 9)) for p in range(0, 900, 3) for _ in range(rnd.randint(1, 3))]
    want, total = {}, 0
    for p in sorted({p for p, _ in parts}):
        want[p] = total
        total += sum(n for q, n in parts if q == p)
    frame = spark.createDataFrame(parts, "part long, n long")
    for group in (4096, 7):
        assert {r.part: r.before for r in op.offsets(frame, group).collect()} == want


def test_files_keep_every_byte(spark):
    """What the files' sink relies on: rows of any bytes are written and read unchanged."""
    from folioscope.llm import binsink, store

    rows = [bytes(range(256)) * k + b"\xff\xfe\n\r\nEND!" for k in (1, 3, 40)] + [b"END!"]
    path = store.place(spark, "bytes")
    binsink.write_files(spark.createDataFrame([(r,) for r in rows], "file binary"), "file", path, b"END!")
    got = sorted(bytes(r.content) for r in binsink.read_files(spark, path).collect())
    assert got == sorted(rows)
