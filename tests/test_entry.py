"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def _plain(value):
    if value is None or value != value:
        return "null"
    if hasattr(value, "tolist"):
        value = value.tolist()
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def _rows(frame, columns):
    return sorted(tuple(map(_plain, row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)


def test_plain_evidence_of_unmeasured_items(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        kept = "where l_partkey % 5 <> 0" if t == "lineitem" else ""
        con.sql(f"copy (select * from '{SF}/{t}.parquet' {kept}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()["plain_evidence"])
    got = entry.queries()["plain_evidence"](spark, str(tmp_path)).select(*want.columns)
    want = want.fetchall()
    assert any("unmeasured" in row for row in want) and any("planned" in row for row in want)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
