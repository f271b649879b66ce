from __future__ import annotations

import corpus_pipeline
from folioscope.llm import decontaminate, quality, simhash
from folioscope.llm.line_dedup import MIN_WORDS
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.common import other_texts
from tests.llm.test_line_dedup import brute as cut
from tests.llm.test_near_copies import plain_groups
from tests.llm.test_packing import check


def test_all_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = quality.stage(spark, docs, sf).collect()
    assert 0 < len(good) <= docs.count()
    small = [r for r in good if r.n_chars < 4000]
    texts = cut([(r.doc_id, r.text) for r in small], MIN_WORDS)
    frame = spark.createDataFrame(small, docs.schema)
    lines = corpus_pipeline.STAGES[1][1](spark, frame, sf)
    assert lines.columns == docs.columns
    got = {r.doc_id: r.text for r in lines.collect()}
    before = {r.doc_id: r.text for r in small}
    assert got == {d: t for d, t in texts.items() if t == before[d] or t.split()}
    groups = set(plain_groups(got).values())  # five-word shingles, similarity 0.8
    once = simhash.stage(spark, spark.createDataFrame(lines.collect(), docs.schema), sf)
    assert {r.doc_id for r in once.collect()} == groups
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, *_ in leaks([(d, got[d]) for d in groups], items)}
    clean = decontaminate.stage(spark, spark.createDataFrame(once.collect(), docs.schema), sf)
    assert {r.doc_id for r in clean.collect()} == groups - bad
    assert bad


def test_run_is_the_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns, k
    rows = corpus_pipeline.run(spark, sf).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_through_all_stages(spark, sf):
    """Equal and null ids over different texts, clashing columns; and no rows at all."""
    docs = other_texts(spark)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            after = stage(spark, frame, sf)
            assert after.columns == frame.columns, name
            assert sorted(r.text for r in after.collect()) == sorted(r.text for r in frame.collect()), name
        pieces = corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect()
        assert len(pieces) >= frame.count()
        scored = quality.scored(frame, quality.Model(0.5))
        assert scored.columns == [*frame.columns, "_score_"] and quality.stage(spark, frame, sf).columns == frame.columns
