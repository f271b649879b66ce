from __future__ import annotations

import duckdb
import pytest

from folioscope.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_names():
    names = list(catalogue.queries())
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == []
    assert "pipeline" in names
