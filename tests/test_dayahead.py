"""Issue time, matrices, windows and walk-forward evaluation against plain Python."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators import dayahead

DAY0 = datetime(2025, 1, 6)  # a Monday


@pytest.fixture(scope="module")
def values():
    r = np.random.default_rng(2)
    v = {DAY0 + timedelta(minutes=30 * i): float(10 + 5 * math.sin(i / 48 * 6.28) + r.random()) for i in range(48 * 24)}
    del v[DAY0 + timedelta(days=12, hours=3)]
    return v


@pytest.fixture(scope="module")
def days(spark, values):
    rows = [("k", t, v, 1 if t.date() == date(2025, 1, 20) else 0, "x") for t, v in values.items()] + [("k", None, 1.0, 0, "x"), (None, DAY0, 1.0, 0, "x")]
    df = spark.createDataFrame(rows, "key string, slot timestamp_ntz, value double, is_holiday int, v string")
    return dayahead.daily_vectors(df, "key", "slot", "value", ["is_holiday"]).cache()


def test_forecasts_use_nothing_after_their_issue_time(spark, values):
    df = spark.createDataFrame([("k", t, v) for t, v in values.items()], "key string, slot timestamp_ntz, value double")
    for x in dayahead.issued_persistence(df, ["key"], "slot", ["value"]).collect():
        back = 1 if x.slot.hour < 14 else 2
        assert x.forecast_value == values.get(x.slot - timedelta(days=back))
        assert x.slot - timedelta(days=back) + timedelta(minutes=30) <= datetime.combine(x.slot.date(), datetime.min.time()) - timedelta(hours=10)


def test_matrix(spark, days, values):
    got = {x.day: x for x in dayahead.training_matrix(days, "key", ["is_holiday"]).collect()}
    want = {}
    for n in range(8, 24):
        start = DAY0 + timedelta(days=n)
        at = lambda days_back: [values.get(start - timedelta(days=days_back) + timedelta(minutes=30 * i)) for i in range(48)]
        recent = [values.get(start - timedelta(hours=34) + timedelta(minutes=30 * i)) for i in range(48)]
        history = [at(k) for k in range(2, 9)]
        flat = recent + at(2) + at(7) + [v for h in history for v in h] + at(0)
        if None in flat:
            continue
        mean = np.mean(history, axis=0)
        dow = [float(i == start.weekday()) for i in range(7)]
        want[start.date()] = ([*recent, *at(2), *at(7), *mean, *dow, math.sin(0), math.cos(0), float(start.date() == date(2025, 1, 20))], at(0))
    assert set(got) == set(want) and len(want) > 3
    for d, (features, target) in want.items():
        assert len(got[d].features) == 202 and np.allclose(got[d].features, features) and np.allclose(got[d].target, target)
    skipped = spark.createDataFrame([(date(2025, 1, 28),)], "day date")
    assert date(2025, 1, 28) not in {x.day for x in dayahead.training_matrix(days, "key", excluded=skipped).collect()}
    assert dayahead.training_matrix(days.limit(0), "key").count() == 0


def test_windows(days, values):
    got = {x.day: x for x in dayahead.forecast_windows(days, "key").collect()}
    assert min(got) == date(2025, 1, 13) and len(got) == 17
    gap = date(2025, 1, 18)
    for d, x in got.items():
        assert x.target_complete == (d != gap) and x.context_complete == (not gap < d <= gap + timedelta(days=7)) and len(x.context) == 336
    start = datetime(2025, 1, 14)
    assert got[date(2025, 1, 14)].context == [values[start - timedelta(days=7) + timedelta(minutes=30 * i)] for i in range(336)]


def test_ridge_is_the_closed_form(spark):
    r = np.random.default_rng(5)
    x, noise = r.normal(size=(60, 4)) * [1, 5, 0.1, 0] + [0, 3, 1, 7], r.normal(size=(60, 2))
    y = x @ r.normal(size=(4, 2)) + noise
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, target array<double>").repartition(3)
    for alpha, (beta, intercept) in dayahead.ridge_path(df, [0.5, 20.0]).items():
        std = x.std(axis=0)
        std[std < 1e-12] = 1
        z = (x - x.mean(axis=0)) / std
        want = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean(axis=0)))
        assert np.allclose(x @ beta + intercept, z @ want + y.mean(axis=0))
    with pytest.raises(ValueError):
        dayahead.ridge_path(df.limit(0), [1.0])


def test_walk_forward(spark, days):
    m = dayahead.training_matrix(days, "key", ["is_holiday"]).cache()
    alpha, errors = dayahead.select_alpha(m, F.lit("2025-01-27").cast("date"), F.lit("2025-01-29").cast("date"), [1.0, 100.0])
    assert alpha in (1.0, 100.0) and errors.count() == 2
    walked = dayahead.walk_forward(m, "key", ["2025-01-27", "2025-01-28"], alpha=alpha)
    assert walked.groupBy("method").count().where("count = 3").count() == 2 and walked.where("day < origin").count() == 0
    x = walked.where("method = 'persistence'").orderBy("day").first()
    f = m.where(F.col("day") == x.day).first().features
    assert x.prediction == f[20:48] + f[:20]
    assert dayahead.vector_errors(walked, ["method"]).where("rmse >= mae and days = 3").count() == 2
    empty = m.limit(0)
    assert dayahead.walk_forward(empty, "key", ["2025-01-27"], alpha=1.0).count() == 0
    alpha, errors = dayahead.select_alpha(empty, F.lit("2025-01-27").cast("date"), F.lit("2025-01-29").cast("date"), [1.0, 100.0])
    assert alpha == 100.0 and errors.count() == 0
    assert [x.method for x in dayahead.walk_forward(m, "key", ["2025-01-01"], alpha=1.0).select("method").distinct().collect()] == ["persistence"]
