from __future__ import annotations

import hashlib
import io
from collections import defaultdict

import zstandard

from folioscope.llm import warc as op
from folioscope.llm.binsink import read_files
from folioscope.llm.store import place
from tests.llm.common import AWKWARD


def brute(rows):
    groups = defaultdict(list)
    for p, h in rows:
        if len((h or "").encode()) >= 1000:
            groups[(h or "").encode()].append(p)
    out = {}
    for p, h in rows:
        data = (h or "").encode()
        top = max(groups[data]) if data in groups else p
        out[p] = (len(data), hashlib.sha1(data).hexdigest(), "response" if top == p else "revisit", None if top == p else top)
    return out


def test_sf_round_trip(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op.query(spark, sf).collect()}
    assert got == brute(rows)


def test_equal_payloads_and_awkward_ones(spark):
    texts = [*AWKWARD, *["same é " * 300] * 50, *["short"] * 5, *["y" * 999] * 3, *["y" * 1000] * 3]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(p, None if p % 3 else "http://a/\r\nb c", h, "x", "x") for p, h in rows], "page_id long, url string, html string, rid string, digest string").repartition(5)
    path = place(spark, "warc")
    op.write_archives(df, path)
    got = op.read_archives(spark, path).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows)
    assert len(got) == len(rows)
    for f in read_files(spark, path).collect():  # any record by its identifier, from one frame; and the plain WARC file
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.content), read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == len(op.record_index(f.content))
        for name, *_ in op.record_index(f.content):
            fields, block = op.parse(op.fetch(f.content, name))
            page = op.page_of(name)
            if fields["WARC-Type"] == "response":
                assert block.partition(b"\r\n\r\n")[2] == (texts[page] or "").encode()


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(None, "u", "z" * 2000), (None, "u", "z" * 2000), (5, "u", "q" * 2000), (5, "u", "q" * 2000)], "page_id long, url string, html string")
    path = place(spark, "warc")
    op.write_archives(df, path)
    assert sorted(r.record_type for r in op.read_archives(spark, path).collect()) == ["response", "response", "revisit", "revisit"]
    path = place(spark, "warc")
    op.write_archives(df.limit(0), path)
    assert op.read_archives(spark, path).count() == 0
    assert op.seek_table(op.Bundle().close()) == []


def test_many_frames_and_bundles(spark, monkeypatch):
    bundle = op.Bundle(frame=1000)
    for i in range(300):
        bundle.add(f"urn:page:{i}:{i}", op.record(i, i, "u", b"p%d" % i, None, hashlib.sha1(b"p%d" % i).digest(), len(b"p%d" % i)))
    data = bundle.close()
    assert len(op.seek_table(data)) > 50
    assert op.fetch(data, "urn:page:250:250").endswith(b"p250\r\n\r\n")
