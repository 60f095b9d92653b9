"""Every registered query runs, and equals its SQL statement where it has one."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import normalized

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = normalized(df.columns, df.collect())
    assert got[1]
    if name in entry.oracle_sql():
        result = sql.execute(entry.oracle_sql()[name])
        assert got == normalized([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "nats", "n_bytes", "bpb"]
