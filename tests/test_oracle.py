"""Every query that has SQL gives the same rows as DuckDB on the same tables; the others give rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return ""
        if isinstance(v, bool) or str(type(v)).endswith("bool'>") or str(type(v)).endswith("bool_'>"):
            return str(bool(v))
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_same_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    floats = [c for c in got.columns if want[c].dtype.kind == "f" or got[c].dtype.kind == "f"]
    for c in floats:  # integers with nulls come as floats from one side
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
