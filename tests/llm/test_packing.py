from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing as op
from folioscope.llm import tokens
from tests.llm.common import AWKWARD, documents, with_clashes

PLAIN = Tokenizer.from_file(tokens.vocabulary_path(op.VOCABULARY))


def check(rows, texts, window=1024):
    """Every id lies in one piece, sequences have no gap, and the numbers are right."""
    ids = {d: np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    sizes = []
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("shard", [1 << 19, 20_000])
def test_sf(spark, sf, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = op.pack(docs, shard=shard).collect()
    sizes = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(x < 1024 for x in sizes) <= len({r.sequence_id >> 32 for r in rows}) <= -(-sum(sizes) // shard)


def plain_scores(tails, q, stats_of):
    """BM25 by its formula."""
    n, mean = len(stats_of), sum(map(len, stats_of)) / len(stats_of)
    df = Counter(t for d in stats_of for t in set(d))
    out = []
    for d in tails:
        tf = Counter(d)
        out.append(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in set(q) if tf[t]))
    return out


def test_scores_and_greedy_choice():
    rnd = np.random.default_rng(1)
    tails = [np.minimum(rnd.zipf(1.3, rnd.integers(1, 60)), 500).astype(np.uint16) for _ in range(80)]
    lists = [t.tolist() for t in tails]
    df = np.zeros(1 << 16, np.int64)
    for t in lists:
        df[list(set(t))] += 1
    stats = op.Statistics(df, len(tails), sum(map(len, lists)))
    index = op.Inverted(tails, stats)
    for k in range(5):
        assert np.allclose(index.scores(tails[k]), plain_scores(lists, lists[k], lists), rtol=1e-4)
    # the same windows as a plain greedy walk
    used, want, seed, at = set(), [], None, 0
    while True:
        if seed is None:
            seed = next((k for k in range(80) if k not in used), None)
            if seed is None:
                break
            at = 0
        used.add(seed)
        score, pieces = index.scores(tails[seed]), [(seed, at, len(lists[seed]) - at)]
        room, seed = 100 - pieces[0][2], None
        while room and len(used) < 80:
            left = [k for k in range(80) if k not in used]
            fit = [k for k in left if len(lists[k]) <= room]
            best = max(fit or left, key=lambda k: (score[k], -k))
            used.add(best)
            take = min(room, len(lists[best]))
            pieces.append((best, 0, take))
            room -= take
            if not fit:
                seed, at = best, take
        want.append(pieces)
    assert op.fill(tails, stats, 100) == want


def test_asks_are_of_whole_documents():
    """A tail whose document speaks of something else finds that document's neighbours."""
    tails = [np.array(x, np.uint16) for x in ([1, 2], [1, 2, 3], [7, 8, 9], [5, 6])]
    df = np.bincount(np.concatenate(tails), minlength=1 << 16)
    stats = op.Statistics(df, 4, 10)
    assert op.fill(tails, stats, 5)[0] == [(0, 0, 2), (1, 0, 3)]
    assert op.fill(tails, stats, 5, [np.array([7, 8, 9], np.uint16), None, None, None])[0] == [(0, 0, 2), (2, 0, 3)]


@pytest.mark.parametrize("shard", [1 << 19, 1500])
def test_neighbours_share_words(spark, shard):
    """Two kinds of documents, in one shard or in many: windows don't mix them but where one kind ends."""
    texts = [" ".join((f"alpha{k % 7}" if d % 2 else f"omega{k % 5}") for k in range(40 + d % 11)) for d in range(120)]
    kinds = defaultdict(set)
    rows = op.pack(documents(spark, texts), shard=shard).collect()
    for r in rows:
        kinds[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(k) == 2 for k in kinds.values()) <= 2
    assert (len({r.sequence_id >> 32 for r in rows}) > 5) == (shard == 1500)


def test_copies_meet_over_many_shards(spark):
    """Each text has a copy, far away in the table: both come into one shard, whose number grows with the table."""
    rnd = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 5000, 60)) for _ in range(300)]
    where = {r.doc_id: r.sequence_id >> 32 for r in op.pack(documents(spark, texts + texts), shard=4096).collect()}
    assert len(set(where.values())) > 20
    assert sum(where[d] == where[d + 300] for d in range(300)) > 270


def test_a_shard_of_the_smallest_tails():
    """Blank texts have their end alone: a full shard of them is no quadratic task."""
    import time

    n = op.SHARD
    began = time.time()
    tails = [np.zeros(1, np.uint16)] * n
    out = op.fill(tails, op.Statistics(np.bincount([0], [n], 1 << 16), n, n))
    assert [len(p) for p in out] == [1024] * (n // 1024)
    assert out[1][0] == (1024, 0, 1)
    assert time.time() - began < 30


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    check(op.pack(with_clashes(documents(spark, texts))).collect(), list(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(3, "b"), (None, "a b c"), (3, "b"), (4, None)], "doc_id long, text string")
    rows = op.pack(df).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("3", 2), ("3", 2), ("4", 1), ("None", 4)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
