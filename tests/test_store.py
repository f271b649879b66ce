"""The shared folder, and content that a third of all rows share."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from folioscope.sources import store as st


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        st.shared_dir(SimpleNamespace(sparkContext=context))


def test_written_tables_can_be_removed(spark):
    path = st.place(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and path.startswith(st.shared_dir(spark))
    st.removed(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_first_of_content(spark):
    rows = [(k, "same ") for k in range(0, 60, 2)] + [(k, f"own {k}") for k in range(1, 60, 2)] + [(100, None), (101, " ")]
    got = {r.doc_id: (r.first_doc_id, r.reused) for r in st.first_of_content(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (0 if k % 2 == 0 else k, k % 2 == 0 and k > 0) for k in range(60)} | {100: (100, False), 101: (100, True)}


def test_malformed_records_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id": 1, "text": "a"}\n{"doc_id": \nnot json\n{"doc_id": 2, "text": "b"}\n')
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    assert sorted(r.doc_id for r in st.read_json(spark, str(tmp_path), schema).collect()) == [1, 2]
