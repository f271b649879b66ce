"""Searches that ask with every row whose id is divisible by 50, against brute force."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.functions import terms as tm
from folioscope.operators import retrieval as rt
from folioscope.plans import catalogue


def plain_nearest(spark, sf, k):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    out = {}
    for i, r in enumerate(rows):
        if r.vec_id % 50 == 0:
            order = sorted((-round(float(s), 9), x.vec_id) for s, x in zip(v @ v[i], rows, strict=True))
            out[r.vec_id] = [x for _, x in order[:k]]
    return out


def ranked(rows, key, rank):
    out = defaultdict(dict)
    for r in rows:
        if r[rank] is not None:
            out[r.query_id][r[rank]] = r[key]
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_dense(spark, sf, block):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ranked(rt.dense_top_blocks(vectors, "vec_id", "embedding", catalogue._every(spark, sf), "query_id", 10, block).collect(), "vec_id", "rank")
    want = plain_nearest(spark, sf, 10)
    assert len(want) == vectors.where("vec_id % 50 = 0").count() > 0
    assert {q: [x[i] for i in range(1, 11)] for q, x in got.items()} == want


def test_hybrid_asks_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text")
    words = {r.doc_id: r.t for r in docs.select("doc_id", tm.tokens(docs["text"]).alias("t")).collect()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for t in words.values() for w in set(t))
    tf = {d: Counter(t) for d, t in words.items()}
    got = catalogue.queries()["hybrid_retrieve"](spark, sf).collect()
    asked = [d for d in words if d % 50 == 0]
    assert {r.query_id for r in got} >= {d for d in asked if words[d]}
    near = plain_nearest(spark, sf, rt.CANDIDATES)
    for q in sorted({*asked, *near}):
        score = {d: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(words[d]) / mean)) for w in set(words.get(q, [])) if w in c) for d, c in tf.items()}
        keyword = sorted((d for d in score if score[d] > 0), key=lambda d: (-round(score[d], 9), d))[: rt.CANDIDATES] if q in asked else []
        fused = {d: sum(1 / (rt.FUSION + x.index(d) + 1) for x in (near.get(q, []), keyword) if d in x) for d in {*near.get(q, []), *keyword}}
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.pos)
        assert [round(r.score, 8) for r in own] == [round(x, 8) for x in sorted(fused.values(), reverse=True)[: rt.FINAL]]
        assert all(math.isclose(r.score, fused[r.doc_id], abs_tol=1e-8) for r in own)
    blocks = catalogue.queries()["context_block"](spark, sf)
    assert {r.query_id for r in blocks.collect()} == {r.query_id for r in got if r.doc_id in words}
