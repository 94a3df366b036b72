"""Mixture imputation: held-out accuracy, masks, and the defined cases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators.imputation import fill_power, fill_snapshots, fill_temperature
from voltloom.operators.mixture import fill_gaps, fit_mixture

SCHEMA = "x double, y double, c int, m0 string, w string, x_filled string"


def table(spark, n=2000, seed=1):
    r = np.random.default_rng(seed)
    k = r.integers(0, 2, n)
    x = np.where(k == 0, r.normal(0, 1, n), r.normal(8, 1, n))
    y = np.where(k == 0, 2 * x + 1, 20 - x) + r.normal(0, 0.2, n)
    return k, x, y


def test_fills_numbers_and_categories(spark):
    k, x, y = table(spark)
    r = random.Random(3)
    hide = [r.random() for _ in k]
    rows = [(float(a), None if h < 0.15 else float(b), None if 0.1 < h < 0.25 else int(c), "e", "e", "old") for a, b, c, h in zip(x, y, k, hide)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_mixture(df, ["x", "y"], [0.25, 0.5], ["c"], [2], components=2, iterations=15)
    got = fill_gaps(df.coalesce(1), model, ["x", "y"], ["c"]).collect()
    assert len(got) == len(rows)
    by = {g.x: g for g in got}
    err, base, right, n = [], [], 0, 0
    for a, b, c, h in zip(x, y, k, hide):
        g = by[float(a)]
        assert g.y_filled == (h < 0.15) and g.x_filled is False and g.c_filled == (0.1 < h < 0.25) and g.m0 == "e"
        if h < 0.15:
            err.append((g.y - b) ** 2)
            base.append((b - y.mean()) ** 2)
        else:
            assert g.y == float(b)
        if 0.1 < h < 0.25:
            right, n = right + (g.c == c), n + 1
    assert np.mean(err) < 0.1 * np.mean(base)
    assert right / n > 0.95


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None)] * 3, [(5.0, 5.0, 1, "a", "b", "c")] * 20 + [(None, float("nan"), None, "a", "b", "c"), (float("inf"), 5.0, 1, "a", "b", "c")]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_mixture(df, ["x", "y"], [0.5, 0.5], ["c"], [2], components=3, iterations=3)
    got = fill_gaps(df, model, ["x", "y"], ["c"]).collect()
    assert len(got) == len(rows)
    assert all(g.x is not None and np.isfinite(g.x) and g.c in (0, 1) for g in got)
    if len(rows) > 5:
        assert all(abs(g.x - 5) < 0.5 for g in got)


def test_power_cases(spark):
    t = datetime(2025, 1, 1)
    m = lambda i: t + timedelta(minutes=i)
    rows = [("s", m(i), 100.0 + i, [0.0, 10.0, 0.0], 1) for i in range(50)] + [("n", m(i), 200.0, None, 1) for i in range(50)]
    rows += [
        ("s", m(60), None, [1.0, None, float("nan")], 1), ("s", m(61), 5.0, None, 1), ("s", m(62), None, None, 1), ("s", m(62), 7.0, [1.0, -999.0, 2.0], 1),
        ("n", m(60), -1.0, None, 1), ("n", m(61), float("inf"), None, 1), ("n", m(62), 65535.0, [None, None, None], 1), (None, m(1), None, None, 1), ("n", None, None, None, 1), ("u", m(1), float("nan"), [], 1),
    ]
    df = spark.createDataFrame(rows, "client_id string, timestamp timestamp_ntz, aggregate_w double, targets_w array<double>, level int")
    homes = spark.createDataFrame([("s", True), ("s", True), ("n", False), (None, True), ("x", None)], "client_id string, has_submeter boolean")
    got = {(g.source_key, (g.ts - t).seconds // 60, g.field): g.value for g in fill_power(df, homes, components=2).collect()}
    ac, wh, wm = "ac_power_w", "water_heater_power_w", "washing_machine_power_w"
    assert set(got) == {("s", 60, "aggregate_w"), ("s", 60, wh), ("s", 60, wm), ("s", 61, ac), ("s", 61, wh), ("s", 61, wm), ("s", 62, wh), ("n", 60, "aggregate_w"), ("n", 62, "aggregate_w"), ("u", 1, "aggregate_w")}
    assert all(np.isfinite(v) and v >= 0 for v in got.values())
    assert 100 < got["n", 60, "aggregate_w"] < 300
    assert fill_power(df.limit(0), homes.limit(0), components=2).count() == 0


def test_temperature_follows_its_region_and_day(spark):
    rows = []
    r = random.Random(1)
    for d in range(20):
        for i in range(40):
            rows.append(("r", datetime(2025, 1, 1 + d, i % 24, i), 10.0 + d + r.random(), 5.0, 1.0))
    lost = [("r", datetime(2025, 1, 5, 3, 59), v, 5.0, 1.0) for v in (None, -127.0)] + [("r", datetime(2025, 1, 18, 3, 59), 85.0, None, float("nan"))]
    df = spark.createDataFrame(rows + lost, "region_id string, timestamp timestamp_ntz, temperature_c double, households_consumption_kw double, pv_production_kw double")
    got = {g.ts.day: g.value for g in fill_temperature(df, components=2).collect()}
    assert set(got) == {5, 18}
    assert abs(got[5] - 14.5) < 1.5 and abs(got[18] - 27.5) < 1.5
    assert fill_temperature(df.limit(0), components=2).count() == 0


def test_snapshots_get_their_likely_segment(spark):
    schema = "snapshot_id long, segment string, usual_evening_kwh double, annual_kwh double, peak_kw double, base_load_kw double, evening_share double, code int"
    r = random.Random(2)
    rows = []
    for i in range(600):
        big = i % 2
        size = r.uniform(0.9, 1.1) * (40 if big else 2)
        rows.append((i, "big" if big else "small", size, size * 900, size / 2, 0.1, 0.3, 1))
    lost = [(1000, None, 40.0, 36000.0, 20.0, 0.1, 0.3, 1), (1001, "small", None, 1800.0, 1.0, 0.1, 0.3, 1), (1002, None, float("nan"), 1800.0, 1.0, None, 0.3, 1)]
    df = spark.createDataFrame(rows + rows[:5] + lost + lost[:1], schema)
    got = {x.snapshot_id: x for x in fill_snapshots(df, components=2).collect()}
    assert len(got) == 603
    assert (got[1000].segment, got[1000].segment_imputed, got[1000].evening_imputed) == ("big", True, False)
    assert got[1001].evening_imputed and 1.5 < got[1001].usual_evening_kwh < 3
    assert (got[1002].segment, got[1002].segment_imputed) == ("small", True) and not got[0].segment_imputed
    assert fill_snapshots(df.limit(0), components=2).count() == 0
    assert fill_snapshots(df.withColumn("segment", F.lit(None).cast("string")), components=2).where("segment is not null").count() == 0


def test_cells_kept_apart_merge_to_the_same_cells(spark):
    from voltloom.operators.mixture import cells, with_level

    r = random.Random(8)
    rows = [(f"h{i % 7}", None if r.random() < 0.2 else r.gauss(5, 2), r.choice([None, 0, 1]), float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x double, c int, level double")
    parts = cells(df, ["x"], [0.5], ["c"], by=["k"])
    levels = df.select("k", "level").distinct()
    got = with_level(parts.join(levels, "k"), "level", 1, 0.5, 1)
    want = cells(df, ["x", "level"], [0.5, 0.5], ["c"])
    key = lambda t: {(x.b0, x.b1, x.c0): (x.w, *(None if v is None else round(v, 6) for v in (x.m0, x.m1, x.q0, x.q1))) for x in t.collect()}
    assert key(got) == key(want)
