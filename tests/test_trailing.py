"""Trailing totals against brute force, and the defined cases."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltloom.operators.trailing import trailing_totals

SCHEMA = "c string, t timestamp_ntz, v double, day string, total int, entity string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "e") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), datetime(2025, 1, 1) + timedelta(days=r.choice([0, 1, 2, 5, 9, 40, 41, 80]), hours=r.randrange(24)), r.choice([None, float("nan"), 0.0, 1.5, 2.0])) for _ in range(60)]
    rows += rows[:5] + [(None, datetime(2025, 1, 1), 1.0), ("a", None, 1.0)]
    got = {(x.entity, x.day): x for x in trailing_totals(frame(spark, rows), F.col("c"), "t", F.col("v")).collect()}
    ok = [(c, t.date(), v) for c, t, v in rows if c and t and v is not None and v == v]
    want = set()
    for c in {k for k, _, _ in ok}:
        days = [d for k, d, _ in ok if k == c]
        d = min(days)
        while d <= max(days):
            want.add((c, d))
            x = got[c, d]
            for n in (7, 30):
                near = [v for k, e, v in ok if k == c and d - timedelta(days=n - 1) <= e <= d]
                assert getattr(x, f"total_{n}d") == pytest.approx(sum(near))
                assert getattr(x, f"readings_{n}d") == len(near)
                assert getattr(x, f"avg_{n}d") == pytest.approx(sum(near) / n)
                assert getattr(x, f"avg_reading_{n}d") == (pytest.approx(sum(near) / len(near)) if near else None)
            d += timedelta(days=1)
    assert set(got) == want


def test_empty_and_unmeasured(spark):
    assert trailing_totals(frame(spark, []), F.col("c"), "t", F.col("v")).count() == 0
    assert trailing_totals(frame(spark, [("a", datetime(2025, 1, 1), None)]), F.col("c"), "t", F.col("v")).count() == 0
    one = trailing_totals(frame(spark, [("a", datetime(2025, 1, 1), 0.0)]), F.col("c"), "t", F.col("v")).collect()
    assert [(x.day, x.readings) for x in one] == [(date(2025, 1, 1), 1)]
