from __future__ import annotations

import re
from collections import Counter

import pytest
import zstandard

from folioscope.llm import compression as op
from tests.llm.common import AWKWARD, documents, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    data, good, ratio = text.encode(), False, None
    if data:
        size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
        ratio = len(data) / size(data)
        low, high = op.limits([len(data)])
        n = len(data) // 1024
        parts = [data[1024 * i : 1024 * (i + 1) if i < n - 1 else len(data)] for i in range(n)]  # the last one takes the rest
        outside = lambda b: not op.limits([len(b)])[0][0] - 0.15 <= len(b) / size(b) <= op.limits([len(b)])[1][0] + 0.025
        good = low[0] <= ratio <= high[0] and sum(map(outside, parts)) <= 0.2 * n
    return (*counts, failed, good and not failed, ratio)


@pytest.mark.parametrize("texts", [AWKWARD, [], ["a b c a b c\n\na b c a b c\r\n a"] * 3])
def test_awkward(spark, texts):
    got = {r.doc_id: tuple(r)[1:9] for r in op.bands(with_clashes(documents(spark, texts))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_sf_equals_brute_force(spark, sf):
    want = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:9] for r in op.query(spark, sf).collect()} == want


def test_bands_tell_good_from_bad(spark):
    sf = "/root/testdata/sf0.1"
    rows = op.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    long = [r.kept for r in rows if r.quality == 0 and r.word_chars > 2000]
    assert sum(good) > 0.99 * len(good)
    assert sum(bad) < 0.35 * len(bad)  # short texts of either kind compress alike
    assert sum(long) < 0.1 * len(long)


def test_the_end_of_a_text_counts():
    """A repeated end shorter than a chunk is held against the limits of its own length."""
    import random

    rnd, press = random.Random(3), zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(190)).encode()[:1024]
    whole = op.ratios(prose, press)
    assert whole[1:] == (1, 0)
    assert op.ratios(prose + b"spam " * 150, press)[1:] == (1, 1)
    assert op.ratios(prose + prose[::-1] + b"spam " * 150, press)[1:] == (2, 1)
