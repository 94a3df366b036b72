"""Every query that has SQL gives the same rows as that SQL, and some; all others run and give some."""

import collections
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()

#: Queries that find nothing in the smallest tables (at ten times their size they do).
MAY_BE_EMPTY = {
    "alpha_errors", "walk_forward_errors", "walk_forward_persistence", "training_rows", "shared_hot_days", "day_ahead_forecast", "day_ahead_recommended", "day_ahead_matched", "event_window_energy", "event_savings",
    "event_flag_windows", "padded_event_readings", "evening_lookback", "local_usual_evening", "p5_found", "stream_half_hours", "ridge_forecast", "frozen_runs", "p9_found", "p8_found", "peak_classifier",
}


def plain(x):
    return ("nan" if x != x else float(f"{x:.9g}") + 0.0) if isinstance(x, float) else x


def rows(result, columns):
    return collections.Counter(tuple(plain(v) for v in r) for r in result.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


@pytest.fixture(scope="module")
def db(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, db, tmp_path, name):
    out = str(tmp_path / "out")
    QUERIES[name](spark, folder).write.parquet(out)
    got = db.sql(f"SELECT * FROM read_parquet('{out}/*.parquet')")
    assert name in MAY_BE_EMPTY or len(got) > 0
    if name in SQL:
        want = db.sql(SQL[name])
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert rows(want, columns) == rows(got, columns)
    else:
        assert len(got.columns) > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert [n for n in ("p2", "p3", "p4", "p6", "p7") if f"{n}_found" not in QUERIES] == []
