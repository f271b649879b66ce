from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import quality as op
from tests.llm.common import AWKWARD, documents, with_clashes


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    good = y.sum()
    return (rank[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = op.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    y, s = np.array([r.quality for r in held]), np.array([r.score for r in held])
    assert auc(y, s) > 0.95
    assert np.mean((s >= 0.3) == (y == 1)) > 0.95
    assert np.mean(s[y == 1] >= 0.3) > 0.99


def test_interactions_are_learned():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert auc(y, op.fit(x, y).logits(x)) > 0.97


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    df = with_clashes(documents(spark, texts))
    labels = spark.createDataFrame([(0, 1, None), (1, None, 1), (99, 0, 0), (None, 1, 1), (6, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        out = op.scored(df, op.train(df, lab)).collect()
        assert len(out) == len(texts)
        assert all(0 <= r._score <= 1 for r in out)
    assert op.Model().score(np.zeros((2, len(op.FEATURES)))).tolist() == [0.5, 0.5]


def test_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = op.stage(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in op.query(spark, sf).where("predicted = 1").collect()}


def plain_features(text):
    """The features of one text, word by word."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    w, total = max(len(words), 1), max(len(data), 1)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    digit = lambda b: 48 <= b <= 57
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in data.split(b"\n")]
    real = [x for x in lines if re.search(rb"[^\x20\x09-\x0D]", x)]
    n_lines = max(len(real), 1)
    marks = [b"!?", b".,;:", b"|<>", b"#*$%&@~^_=+", b"\"'()[]{}/\\"]
    ends = sum(x[-1] in b".!?" for x in words)
    return [
        math.log1p(len(words)),
        sum(len(x.decode()) for x in words) / w,
        sum(len(x) > 18 for x in words) / w,
        sum(65 <= b <= 90 for b in data) / total,
        sum(65 <= x[0] <= 90 for x in words) / w,
        sum(map(digit, data)) / total,
        *(sum(b in m for b in data) / w for m in marks),
        sum(map(letter, data)) / total,
        sum(b >= 128 for b in data) / total,
        len(set(words)) / w,
        len(inside) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        (len(real) - len(set(real))) / n_lines,
        math.log1p(len(words) / n_lines),
        math.log1p(len(words) / (1 + ends)),
        sum(not letter(x[-1]) and not digit(x[-1]) for x in words) / w,
    ]


def test_scores_equal_look_ups_row_by_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = op.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.single and model.pairs
    rows = [tuple(r) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate(AWKWARD)]
    got = {r.doc_id: r._score for r in op.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, t in rows:
        x = plain_features(t)
        at = [bisect_right(c.tolist(), v) for c, v in zip(model.cuts, x, strict=True)]
        logit = model.base + sum(t[k] for t, k in zip(model.single, at, strict=True)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert abs(got[d] - 1 / (1 + math.exp(-logit))) < 1e-9, d


def test_repeated_ids_keep_the_bound(spark, monkeypatch):
    """A doc_id that stands often in documents does not make the sample larger than its bound."""
    monkeypatch.setattr(op, "SAMPLE", 5)
    seen = []
    monkeypatch.setattr(op, "fit", lambda x, y: seen.append(len(y)) or op.Model())
    docs = spark.createDataFrame([(d, f"text {k}") for d in (1, 2, 3) for k in range(30)], "doc_id long, text string")
    op.train(docs, spark.createDataFrame([(d, 1, 0) for d in (1, 2, 3)], "doc_id long, quality int, toxic int"))
    assert seen and seen[0] <= 5
