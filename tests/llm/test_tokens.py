from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import tokens as op
from tests.llm.common import AWKWARD

NAMES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
PLAIN = {n: Tokenizer.from_file(op.vocabulary_path(n)) for n in NAMES}
OWN = {n: op.Encoder(op.vocabulary_path(n), g) for n, g in NAMES.items()}


def agree(name, texts, own=None):
    want = [e.ids for e in PLAIN[name].encode_batch(texts, add_special_tokens=False)]
    got = []
    for _, ids, first in (own or OWN[name]).encode(pa.array(texts, pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
    assert got == want


@pytest.mark.parametrize("name", NAMES)
def test_sf(spark, sf, name):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    agree(name, texts)
    agree(name, [t or "" for t in AWKWARD])
    agree(name, texts[:40], op.Encoder(op.vocabulary_path(name), NAMES[name], slots=64))


ODD = st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​　'́aZéñ1.!<|>s"), st.characters()), max_size=40)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.one_of(ODD, st.just("a <|endoftext|> b <|startoftext|>c"), st.just("it's we'll 'x 12 3"), st.just("a~b ~ ~~ c|d x.~ y"), st.just("one\ntwo~ three\n~")), max_size=4))
def test_any_text(name, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    agree(name, texts)
