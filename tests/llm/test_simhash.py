from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from folioscope.llm import graph
from folioscope.llm import simhash as op
from tests.llm.common import AWKWARD, CLASHES, documents, other_texts, with_clashes
from tests.llm.test_near_copies import plain_groups


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints: dict, radius=2):
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_sf_equals_brute_force(spark, sf):
    want = {r.doc_id: plain_print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    roots = plain_components(want)
    got = op.query(spark, sf).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == roots
    assert len(set(roots.values())) < len(roots)


def clouds(seed, n):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 40])):
            x = base
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            out.add(x)
            base = x if rnd.random() < 0.2 else base
    return sorted(out)


@pytest.mark.parametrize("deep", [2048, 8])
def test_links_equal_brute_force(spark, deep):
    """With a small bound the deeper buckets do the work."""
    fps = clouds(3, 500)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = op.links(spark.createDataFrame([(x,) for x in signed], "fp long"), deep=deep)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    groups, want = {}, {}
    for x, y in plain_components(dict(enumerate(fps))).items():
        want.setdefault(y, set()).add(signed[x])
    for x in signed:
        groups.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_bit_planes_equal_popcounts():
    rnd = np.random.default_rng(0)
    fps = rnd.integers(0, 2**63, 700, dtype=np.uint64) & np.uint64(0xF00000000000F00F)
    near = {(i, j) for i in range(700) for j in range(i + 1, 700) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert set(zip(*(x.tolist() for x in op.close_pairs(fps, 2)), strict=True)) == near
    i, j = np.triu_indices(200, 1)
    for radius in (0, 1, 2, 3, 5):
        got = op.listed_pairs(fps, i, j, radius)
        assert got.tolist() == [int(fps[a] ^ fps[b]).bit_count() <= radius for a, b in zip(i, j, strict=True)]


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    df = with_clashes(documents(spark, texts))
    got = {r.doc_id: r for r in op.near_duplicates(df).collect()}
    assert len(got) == len(texts)
    if texts:
        assert [got[i].fp for i in range(3)] == [0, 0, 0]
        assert {got[i].component_id for i in range(3)} == {0}
        assert all(got[i].fp % 2**64 == plain_print(t) for i, t in enumerate(texts))
    kept = op.stage(spark, df, "")
    assert kept.columns == df.columns
    assert kept.count() == len(set(plain_groups(dict(enumerate(texts))).values()))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "q w e r t y")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in op.stage(spark, df, "").collect()) == ["3", "9"]


def test_stage_keeps_distinct_texts_under_one_id(spark):
    """Equal and null ids over different texts: no distinct text is lost, whatever the columns' names."""
    df = other_texts(spark)
    kept = op.stage(spark, df, "")
    assert kept.columns == df.columns and set(CLASHES) <= set(df.columns)
    assert sorted(r.text for r in kept.collect()) == sorted({r.text for r in df.collect()})
    again = op.stage(spark, df.union(df), "")
    assert sorted(r.text for r in again.collect()) == sorted({r.text for r in df.collect()})


def test_links_of_a_hot_fingerprint(spark):
    """A third of all rows with one fingerprint, and a bucket that all share."""
    texts = ["the same few words here"] * 200 + [f"w{k} " * 4 + "tail" for k in range(200)] + [""] * 200
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in op.near_duplicates(documents(spark, texts)).collect()}
    prints = {d: plain_print(t) for d, t in enumerate(texts)}
    roots = plain_components(prints)
    assert got == {d: (prints[d], roots[d]) for d in prints}
