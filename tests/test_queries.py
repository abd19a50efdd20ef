"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from seriesloom.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf{}"
#: Queries whose values lie close to where rounding turns, or whose rows are many for a day: on more rows too.
LARGER = ("asofr", "blocked_asofr", "ft_wkurt", "ft_wmean", "ft_wmoments", "ft_wskew", "ft_wstd", "mapr", "rolling_zscore", "zscore")
CASES = [("0.001", n) for n in sorted(QUERIES)] + [("0.01", n) for n in LARGER]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF.format("0.001")), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    out = {}
    for size in {size for size, _ in CASES}:
        out[size] = duckdb.connect()
        for p in Path(SF.format(size)).glob("*.parquet"):
            out[size].sql(f"create view {p.stem} as select * from '{p}'")
    return out


def plain(v):
    return "null" if v is None or v != v else repr(v)


@pytest.mark.parametrize("size, name", CASES)
def test_query(spark, duck, size, name):
    df = QUERIES[name](spark, SF.format(size))
    expected = duck[size].sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(expected.columns)
    at, to = [df.columns.index(c) for c in names], [expected.columns.index(c) for c in names]
    ours = sorted(tuple(plain(r[i]) for i in at) for r in df.collect())
    assert ours and ours == sorted(tuple(plain(r[i]) for i in to) for r in expected.fetchall())


def exact(v):
    return "null" if v is None else repr(v)


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Events with zeros alone, after each other and around gaps: log returns of minus infinity, infinity and NaN."""
    at = tmp_path_factory.mktemp("zeros")
    values = [0.0, 0.0, 0.0, 3.5, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 4.0, 12.5, 0.0]
    rows = ", ".join(f"({i}, {values[i % 14]}::double, '{'ab'[i // 7 % 2]}')" for i in range(56))
    duckdb.execute(f"copy (select i::bigint as event_id, timestamp '2024-01-01' + to_hours((i // 2)::int) as ts, k as event_type, v as value from (values {rows}) as r(i, v, k)) to '{at}/events.parquet'")
    return str(at)


LOGS = ("blocked_dlog", "dlog", "dlog_edges", "dlog_ofs", "form_dlog_col", "form_dlog_cols", "log")


@pytest.mark.parametrize("name", LOGS)
def test_logarithms_of_zeros_cell_by_cell(spark, zeros, name):
    """NaN is no NULL here; infinities have their sign."""
    df = QUERIES[name](spark, zeros)
    with duckdb.connect() as duck:
        duck.execute(f"create view events as select * from '{zeros}/events.parquet'")
        expected = duck.execute(SQL[name]).fetchall()
        names = [c[0] for c in duck.description]
    ours = sorted(tuple(exact(r[c]) for c in names) for r in df.collect())
    assert ours == sorted(tuple(map(exact, r)) for r in expected)
    assert any("inf" in r[-1] for r in ours)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
