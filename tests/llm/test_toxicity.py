from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import toxicity as op
from tests.llm.common import AWKWARD, documents, with_clashes
from tests.llm.test_quality import auc


def joined(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = op.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    y, s = np.array([r.toxic for r in held]), np.array([r.score for r in held])
    assert auc(y, s) > 0.9
    assert np.mean(s[y == 1] >= 0.7) > 0.7  # from 288 toxic documents
    assert np.mean(s[y == 0] >= 0.7) < 0.03


def test_gradients_equal_differences():
    rnd = np.random.default_rng(0)
    words = op.Words(*joined(["one two three two one four", "five six", ""]), window=4, stride=2)
    p = {k: v.astype(np.float64) for k, v in op.new_parameters(3).items()}
    y, w = np.array([1.0, 0, 1, 0][: len(words.windows)]), rnd.random(len(words.windows))
    op.np.float32, keep = np.float64, np.float32  # exact enough for differences
    try:
        _, g = op.gradients(p, words, words.windows, y, w)
        for name in op.NAMES:
            flat = np.flatnonzero(g[name].ravel())
            for at in rnd.choice(flat, min(4, len(flat)), replace=False) if len(flat) else []:
                sides = []
                for eps in (1e-5, -1e-5):
                    q = {k: v.copy() for k, v in p.items()}
                    q[name].ravel()[at] += eps
                    sides.append(op.gradients(q, words, words.windows, y, w)[0])
                assert abs((sides[0] - sides[1]) / 2e-5 - g[name].ravel()[at]) < 1e-5, name
    finally:
        op.np.float32 = keep


def test_windows_cover_all_words():
    texts = ["", "a", " ".join(f"w{i}" for i in range(24)), " ".join(f"w{i}" for i in range(25)), " ".join(f"w{i}" for i in range(301))]
    words = op.Words(*joined(texts))
    for i, t in enumerate(texts):
        own = words.windows[words.first[i] : words.first[i + 1]]
        assert len(own) == 1 + max(0, -(-(len(t.split()) - 24) // 12))
        assert len(set(own.ravel().tolist()) - {0}) == len(set(t.split()))
        if i == 4:  # every place stands in two windows but for the ends
            assert np.bincount(own.ravel())[own[3]].min() >= 2


def test_a_part_scores_as_it_does_alone():
    model = op.Model(op.new_parameters(1), 1.0, 0.0)
    texts = ["one two three", "", "four " * 100, "é ñ"]
    whole = model.score(*joined(texts))
    assert np.allclose(whole, [model.score(*joined([t]))[0] for t in texts], atol=1e-6)


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    df = with_clashes(documents(spark, texts))
    labels = spark.createDataFrame([(0, 1, None), (1, None, 1), (99, 0, 0), (None, 1, 1), (6, 0, 0), (6, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        out = op.scored(df, op.train(df, lab)).collect()
        assert len(out) == len(texts)
        assert all(0 <= r.score <= 1 for r in out)


def test_joined_words_are_those_of_all_texts():
    texts = ["one two three " * 20, "", "two five", "one six " * 30, "é"]
    whole, parts = op.Words(*joined(texts)), op.Words.joined([op.Words(*joined(texts[:2])), op.Words(*joined(texts[2:]))])
    for name in ("keys", "bucket", "n", "split", "tri", "windows", "text", "first"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name


def plain_logit(p, text):
    """The worst window's logit, one window and one step at a time, from the text's words."""
    import re

    from folioscope.llm import textbuf as tb

    sig = lambda x: 1 / (1 + np.exp(-x))
    plain = re.sub(rb"[!-/:-@\[-`{-~]", b" ", (text or "").encode().lower())
    words = re.findall(rb"[^\x20\x09-\x0D]+", plain)
    vector = {}
    for w in set(words):
        h = tb.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        padded = b" " + w + b" " * 4
        runs = []
        for k in range(len(w)):
            for size, mark in ((3, 0), (5, 1 << 40)):
                key = sum(padded[k + i] << 8 * i for i in range(size)) + mark
                runs.append(int(tb.mix(np.array([key], np.uint64))[0]) >> 30 & (op.CHARS - 1))
        vector[w] = p["char"][runs].mean(0) + p["word"][(int(h) >> 20) % op.WORDS]
    best = -np.inf
    for at in range(0, max(1, len(words) - op.WINDOW + op.STRIDE), op.STRIDE):
        own = words[at : at + op.WINDOW]
        states = {}
        for wn, un, bn, order in (("wf", "uf", "bf", range(len(own))), ("wb", "ub", "bb", range(len(own) - 1, -1, -1))):
            h = np.zeros(op.HIDDEN)
            for k in order:
                x, g = vector[own[k]] @ p[wn] + p[bn], h @ p[un]
                n = op.HIDDEN
                z, r = sig(x[:n] + g[:n]), sig(x[n : 2 * n] + g[n : 2 * n])
                c = np.tanh(x[2 * n :] + r * g[2 * n :])
                h = (1 - z) * c + z * h
                states.setdefault(k, []).append(h)
        if not own:
            return float(p["out_b"][0])
        rows = np.array([np.concatenate(states[k]) for k in range(len(own))])
        e = np.tanh(rows @ p["att"] + p["att_b"]) @ p["query"]
        e = np.exp(e - e.max())
        best = max(best, float((e / e.sum()) @ rows @ p["out"] + p["out_b"][0]))
    return best


def test_scores_equal_one_window_at_a_time(spark, sf):
    p = op.new_parameters(5)
    p = {k: (v + 0.2 * np.random.default_rng(1).standard_normal(v.shape)).astype(np.float32) for k, v in p.items()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 2500][:40]
    rows += [(1000, None), (1001, ""), (1002, "Word, WORD; word"), (1003, "é " * 25), (1004, "a " * 24), (1005, "--- !!")]
    got = {r.doc_id: r.score for r in op.scored(spark.createDataFrame(rows, "doc_id long, text string"), op.Model(p, 1.3, -0.2)).collect()}
    exact = {k: v.astype(float) for k, v in p.items()}
    for d, t in rows:
        if d != 1001 and d != 1000 and d != 1005:
            assert abs(got[d] - 1 / (1 + np.exp(-(1.3 * plain_logit(exact, t) - 0.2)))) < 1e-4, d
    assert got[1000] == got[1001] == got[1005]


def test_sample_is_bounded_by_windows():
    rows = [(5, 10, 0), (1, 90, 1), (2, 30, 2), (3, 8, 3), (4, 2, 4)]
    assert op.chosen(rows, 9, 100) == [1, 3, 4]  # the second would be too many, later ones fit
    assert op.chosen(rows, 2, 1000) == [1, 2]


def test_driver_gets_windows_not_texts(spark, sf):
    """Texts that travel as words and windows are those that the texts give."""
    texts = ["one two three " * 20, "", "two, five", "é x"]
    own = [op.Words(*joined([t])) for t in texts]
    table = op.Words._runs(own)
    whole = op.Words(*joined(texts))
    back = op.Words.joined([op.Words.unpacked(*w.packed(), table) for w in own])
    for name in ("keys", "bucket", "n", "split", "tri", "windows", "text", "first"):
        assert np.array_equal(getattr(whole, name), getattr(back, name)), name


def test_a_repeated_id_sends_no_more_to_the_driver(spark):
    docs = documents(spark, [f"word{k} and more" for k in range(40)]).unionByName(spark.range(900).selectExpr("7L AS doc_id", "concat('again ', id) AS text"), allowMissingColumns=True)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    held = op.labelled(docs, labels, "toxic", op.remainder(3) != 1, 30).select("label", "h", F.lit(1).alias("size"), F.monotonically_increasing_id().alias("n"))
    held = op.written(held, "held")
    assert held.count() > 900
    got = op.candidates(held, 5).collect()
    assert sorted(r.label for r in got) == [0] * 5 + [1] * 5
    for k in (0, 1):
        assert sorted((r.h, r.n) for r in got if r.label == k) == sorted((r.h, r.n) for r in held.where(F.col("label") == k).collect())[:5]
    assert op.train(docs, labels, most=5).score is not None
