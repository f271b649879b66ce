from __future__ import annotations

import random

import pytest

from folioscope.llm import line_dedup as op
from tests.llm.common import AWKWARD, clashing, documents, other_texts, with_clashes


def brute(texts: list[tuple[int, str | None]], least: int) -> dict[int, str | None]:
    """Every run of lines with at least `least` words that occurred earlier goes, tried run by run."""
    real = {}
    for d, t in texts:
        all_lines = (t or "").split("\n")
        real[d] = [(n, b" ".join(x.encode().lower().split())) for n, x in enumerate(all_lines) if x.encode().split()]
    first = {}
    order = sorted(real)
    for d in order:
        for i in range(len(real[d])):
            for j in range(i + 1, len(real[d]) + 1):
                run = tuple(x for _, x in real[d][i:j])
                if sum(len(x.split()) for x in run) >= least:
                    first.setdefault(run, (d, i))
    out = {}
    for d, t in texts:
        gone = set()
        for i in range(len(real[d])):
            for j in range(i + 1, len(real[d]) + 1):
                run = tuple(x for _, x in real[d][i:j])
                if sum(len(x.split()) for x in run) >= least and first[run] < (d, i):
                    gone.update(range(real[d][i][0], real[d][j - 1][0] + 1))
        # blank lines go only between two deleted lines that follow one another
        keep = [x for n, x in enumerate((t or "").split("\n")) if n not in gone]
        out[d] = None if t is None else "\n".join(keep)
    return out


def test_equals_every_run_tried(spark):
    rnd = random.Random(5)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(12)]
    texts = []
    for _ in range(60):
        lines = [rnd.choice(pool) if rnd.random() < 0.6 else " ".join(str(rnd.random()) for _ in range(3)) for _ in range(rnd.randint(1, 9))]
        if rnd.random() < 0.3:
            lines.insert(rnd.randrange(len(lines)), "")
        texts.append("\n".join(lines))
    texts += texts[:5] + [pool[0] + "\n" + pool[1] + "\n" + pool[0] + "\n" + pool[1]]
    got = {r.doc_id: r.text for r in op.dedup_lines(documents(spark, texts), 6).select("doc_id", "text").collect()}
    assert got == brute(list(enumerate(texts)), 6)


def test_sf_equals_every_run_tried(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in op.dedup_lines(docs).collect()}
    assert got == brute(rows, op.MIN_WORDS)
    assert any(got[d] != t for d, t in rows)


def test_a_hot_passage_costs_no_pairs(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [f"own {i} start\n{passage}\nown {i} end" for i in range(400)]
    out = op.dedup_lines(documents(spark, texts)).collect()
    assert sum(r._words for r in out) == 60 * 399
    assert next(r.text for r in out if r.doc_id == 0) == texts[0]
    assert all("own" in r.text for r in out)


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, texts):
    df = with_clashes(documents(spark, texts))
    out = op.dedup_lines(df)
    assert out.columns[: len(df.columns)] == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    if texts:
        assert got[1].text is None and got[0].text == ""
        assert got[7]._gone > 0 and got[7].text.startswith("dup line here")
    assert op.stage(spark, df, "").count() == len(texts)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (4, text)], "doc_id long, text string")
    out = sorted((str(r.doc_id), r.text) for r in op.dedup_lines(df).collect())
    assert out == [("3", ""), ("3", ""), ("4", ""), ("None", text)]
    assert op.stage(spark, df, "").count() == 1


def test_different_texts_under_one_id(spark):
    """Rows that share a doc_id, or have none, lose only what occurred earlier, whatever the columns' names."""
    df = other_texts(spark)
    kept = op.stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.text for r in kept.collect()) == sorted(r.text for r in df.collect())
    words = lambda seed: " ".join(f"w{seed}x{i}" for i in range(60))
    more = clashing(spark.createDataFrame([(5, f"{words(9)}\n{words(1)}\nend"), (7, f"short\n{words(3)}"), (7, f"{words(8)}")], "doc_id long, text string"))
    got = op.dedup_lines(df.union(more))
    assert got.columns == [*df.columns, "_lines_", "_gone_", "_words_"]
    texts = sorted(r.text for r in got.collect())
    assert texts == sorted([*(r.text for r in df.collect()), f"{words(9)}\nend", "short", words(8)])
    assert sum(r._words_ for r in got.collect()) == 120


def test_a_passage_within_lines_stays(spark):
    """What the method cannot see: a repeated passage that fills no line."""
    passage = " ".join(f"w{i}" for i in range(60))
    out = op.dedup_lines(documents(spark, [f"a {passage} b", f"c {passage} d"])).collect()
    assert sum(r._words for r in out) == 0
