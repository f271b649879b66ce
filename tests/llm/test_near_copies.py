from __future__ import annotations

import random

import pytest

from folioscope.llm import near_copies as op
from folioscope.llm import simhash
from tests.llm.common import AWKWARD, documents, with_clashes


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_groups(texts: dict):
    """The smallest id that each reaches over pairs of similarity 0.8."""
    sets, root = {d: plain_set(t) for d, t in texts.items()}, {d: d for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if root[a] != root[b] and jaccard(sets[a], sets[b]) >= 0.8:
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    return root


def edited(rnd, words, n):
    out = list(words)
    for k in rnd.sample(range(len(out)), n):
        out[k] = f"new{rnd.randrange(10**9)}"
    return out


def planted():
    """Texts of 100 to 1500 words, each followed by copies with a few words replaced."""
    rnd, out = random.Random(5), []
    for _ in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(100, 1500))]
        out += [" ".join(edited(rnd, base, n)) for n in (0, 1, 2, 3, 5, 20)]
    return out


@pytest.mark.parametrize("deep", [1024, 2])
def test_planted_copies_equal_brute_force(spark, deep):
    """Also where every bucket is dealt again."""
    texts = planted()
    want = plain_groups(dict(enumerate(texts)))
    assert len(set(want.values())) < len(texts) // 2
    got = {r.doc_id: r.component_id for r in op.near_copies(documents(spark, texts), deep=deep).collect()}
    assert got == want


def test_stage_removes_edited_copies(spark):
    """The stage reaches what two bits of SimHash do not."""
    texts = planted()
    want = set(plain_groups(dict(enumerate(texts))).values())
    assert {r.doc_id for r in simhash.stage(spark, documents(spark, texts), "").collect()} == want


def test_sf_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in op.near_copies(docs).collect()} == want


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    got = {r.doc_id: r.component_id for r in op.near_copies(with_clashes(documents(spark, texts))).collect()}
    assert got == plain_groups(dict(enumerate(texts)))
