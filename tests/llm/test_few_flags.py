"""Marks in words and ids of questions are found without a sum over all bytes or a sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from folioscope.llm import packing, tokens
from folioscope.llm import textbuf as tb


def test_any_in_is_a_sum_above_zero():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50):
        flags, ends = rng.random(n) < 0.1, np.sort(rng.integers(0, n + 1, 20))
        starts = np.maximum(ends - rng.integers(0, 5, 20), 0)
        assert tb.any_in(flags, starts, ends).tolist() == [bool(flags[a:b].any()) for a, b in zip(starts, ends, strict=True)]


def test_words_are_learned_without_sums_over_the_buffer(monkeypatch):
    monkeypatch.setattr(tb, "per_row", lambda *args: 1 / 0)
    texts = ["one ~two\nthree", "a~b  c", "", "plain words only"]
    own = tokens.Encoder(tokens.vocabulary_path(packing.VOCABULARY), True)
    got = [ids[a:b].tolist() for _, ids, first in own.encode(pa.array(texts)) for a, b in zip(first, first[1:], strict=False)]
    assert got == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_distinct_ids_leave_no_flag():
    held = np.zeros(packing.IDS, bool)
    for ids in ([], [5], [9, 3, 9, 0, 65535, 3]):
        got = packing._distinct(np.array(ids, np.uint16), held)
        assert got.dtype == np.uint16 and got.tolist() == sorted(set(ids)) and not held.any()
