from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import language_model as op
from tests.llm.common import AWKWARD, documents, with_clashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, out):
    """Counts and base score by a dictionary."""
    toks = {d: [*WORD.findall((t or "").encode().lower()), None] for d, t in rows}
    c = Counter(w for d, ws in toks.items() if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {
        d: (out(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in toks.items()
    }


def held(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))


@pytest.mark.parametrize("head", [1 << 19, 900])
def test_sf_equals_brute_force(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op.scored(docs, op.remainder(7) == 2, head).collect()
    same(got, brute([(r.doc_id, r.text) for r in docs.collect()], held))


def test_held_out_texts_are_likelier_than_by_counts(spark):
    got = [r for r in op.query(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.1


def test_probabilities_add_up():
    """Over all classes in any context; over known words and the unknown one within groups."""
    rnd, size = np.random.default_rng(0), 512
    p = op.start_parameters(rnd.integers(0, 100, size).astype(float))
    p["q"] += rnd.standard_normal(p["q"].shape).astype(np.float32)
    t = op.Tables(p)
    for two, one in ((3, 4), (size, size), (500, 1)):
        w = np.arange(size)
        assert abs((10.0 ** t.logs(np.full_like(w, two), np.full_like(w, one), w)).sum() - 1) < 1e-4
    keys, shapes, counts = np.arange(1, 2001), np.arange(2000) % op.SHAPES, rnd.integers(1, 50, 2000)
    keys, shapes, counts = (np.append(a, x).astype(np.int64) for a, x in ((keys, op.END), (shapes, -1), (counts, 7)))
    stats = {int(b): (int(counts[shapes == b].sum()), int((shapes == b).sum())) for b in np.unique(shapes)}
    vocab = op.Vocabulary(keys, shapes, counts, stats, 1)
    at = vocab.find(keys)
    assert (vocab.keys[at].view(np.int64) == keys).all() and vocab.find(np.array([5000]))[0] == -1
    assert vocab.class_tokens.sum() == counts.sum()
    for b in (0, 17):
        k = int(vocab.group(np.array(b)))
        logs = vocab.logs[(vocab.kind == k)]
        assert abs((10 ** (logs - vocab.inside[k])).sum() + 10 ** -vocab.inside[k] - 1) < 1e-9


def test_classes_grow_with_the_corpus():
    sizes = [op.classes_for(n) for n in (0, 10**6, 10**8, 5 * 10**8, 10**13)]
    assert sizes == [1024, 1024, 1024, 2048, 4096]


def test_score_equals_token_by_token(spark, sf, monkeypatch):
    """The whole score from its definition: classes by dictionaries, a softmax for each token, a share within its group."""
    held_p = {}

    def parameters(prepared, vocab):
        rnd = np.random.default_rng(7)
        p = op.start_parameters(vocab.class_tokens)
        held_p.update({k: v + rnd.standard_normal(v.shape).astype(np.float32) * 0.3 for k, v in p.items()})
        return held_p

    monkeypatch.setattr(op, "train", parameters)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(d, t if d % 3 else " ".join((t or "").split()[:40])) for d, t in rows if len(t or "") < 3000] + [(10_000, None), (10_001, "")]
    got = {r.doc_id: r.score for r in op.scored(spark.createDataFrame(rows, "doc_id long, text string"), op.remainder(7) == 2).collect()}
    toks = {d: WORD.findall((t or "").encode().lower()) for d, t in rows}
    c = Counter(w for d, ws in toks.items() if not held(d) for w in ws)
    ends, words = sum(not held(d) for d in toks), sorted({w for ws in toks.values() for w in ws})
    line = np.frombuffer(b" ".join(words), np.uint8)
    keys, shapes, _ = op.tokens(line, np.array([0, len(line)]))
    key, shape = dict(zip(words, keys.tolist(), strict=True)), dict(zip(words, shapes.tolist(), strict=True))
    size = op.classes_for(sum(c.values()) + ends)
    top = sorted(c, key=lambda w: (-c[w], key[w]))[: size - size // 4 - 1]
    own = {w: 1 + k for k, w in enumerate(top)}
    group = lambda w: own.get(w, size - size // 4 + shape[w] % (size // 4))
    n, v = Counter(), Counter()
    for w in c:
        if w not in own:
            n[group(w)] += c[w]
            v[group(w)] += 1
    p = {k: x.astype(float) for k, x in held_p.items()}
    for d, ws in list(toks.items())[::7] + [(k, toks[k]) for k in (10_000, 10_001)]:
        total, two, one = 0.0, size, size
        for w in [*ws, None]:
            k = 0 if w is None else group(w)
            z = p["q"] @ (p["r"][one] @ p["c1"] + p["r"][two] @ p["c2"]) + p["b"]
            total += z[k] / math.log(10) - math.log10(np.exp(z).sum())
            if w is not None and w not in own:
                total += math.log10((c[w] + 1) / (n[k] + v[k] + 1))
            two, one = one, k
        assert abs(got[d] - total) < 1e-4 * max(1, abs(total))


def test_scores_do_not_hang_on_the_layout(spark, sf, monkeypatch):
    """The same documents in one partition and in eight, in another order and batch size: equal scores, of several learners."""
    monkeypatch.setattr(op.train, "__defaults__", (4000,))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r.score for r in op.scored(docs.coalesce(1), op.remainder(7) == 2).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = {r.doc_id: r.score for r in op.scored(docs.repartition(8), op.remainder(7) == 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one.keys() == many.keys()
    assert all(math.isclose(one[d], many[d], rel_tol=1e-9) for d in one)  # but for the rounding of sums


def test_noise_contrastive_learning_finds_structure():
    rnd = np.random.default_rng(2)
    w = np.zeros(120_000, np.int64)
    for i in range(1, len(w)):
        w[i] = (w[i - 1] * 7 + 3 + rnd.integers(0, 3)) % 50
    n = np.bincount(w, minlength=512).astype(float)
    learner = op.Learner(op.start_parameters(n), n, 0)
    for _ in range(4):
        learner.learn(w[:-2], w[1:-1], w[2:])
    t = op.Tables(learner.p)
    assert t.logs(w[:-2], w[1:-1], w[2:]).mean() > -1.0 > np.log10(1 / 50)


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    df = with_clashes(documents(spark, texts))
    got = op.scored(df, op.remainder(7) == 2).collect()
    same(got, brute(list(enumerate(texts)), held))
    assert all(math.isfinite(r.score) for r in got)
    all_out = op.scored(df, F.lit(True)).collect()
    assert len(all_out) == len(texts) and all(r.base_score == 0 and r.n_known == 0 for r in all_out)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (4, None)], "doc_id long, text string")
    got = op.scored(df, op.remainder(7) == 2).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3, 3]
