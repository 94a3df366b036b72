"""Runs, fills, intervals, metrics and small models on hand-made frames."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.functions.columns import canonical_id, floor_to, split_name
from voltloom.functions.text import find_keyword, format_number, format_time, normalised_text
from voltloom.operators import models
from voltloom.operators.fill import backward_fill, forward_fill, interpolate
from voltloom.operators.intervals import best_overlap, mark
from voltloom.operators.islands import equal_runs, risk_windows
from voltloom.operators.joins import lookup_join, spread_join
from voltloom.operators.metrics import adjusted_rand, confusion, forecast_errors
from voltloom.operators.ordering import bucket_of, hash_bucket, running_totals
from voltloom.operators.profile import savings, usual_window
from voltloom.operators.recommend import spaced_top, window_around_peak
from voltloom.operators.series import history_median, history_percentile, rank_quartile
from voltloom.operators.timegrid import resample

T = datetime(2025, 1, 1)
half = lambda i: T + timedelta(minutes=30 * i)


def test_resample_means_not_sums(spark):
    df = spark.createDataFrame([("a", T + timedelta(minutes=i), 2.0) for i in range(60)] + [("a", T + timedelta(hours=2), 0.0)], "k string, t timestamp_ntz, p_kw double")
    got = resample(df, ["k"], "t", ["p_kw"]).orderBy("slot").collect()
    assert [(x.p_kw, x.p_energy_kwh) for x in got] == [(2.0, 1.0), (2.0, 1.0), (None, None), (None, None), (0.0, 0.0)]


def test_risk_windows(spark):
    df = spark.createDataFrame([("a", half(i), m) for i, m in enumerate([2.0, -2.0, -3.0, 1.0, -1.0, -1.0, -1.0, 2.0, None])], "k string, t timestamp_ntz, m double")
    got = risk_windows(df, ["k"], "t", "m").orderBy("start").collect()
    assert [(x.duration_minutes, x.max_deficit, x.shortage_energy, x.deepest) for x in got] == [(60, 3.0, 2.5, half(2)), (90, 1.0, 1.5, half(4))]


def test_equal_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0] * 3 + [2.0] + [None] * 4 + [5.0] * 4)], "k int, t int, v double")
    assert equal_runs(df, ["k"], "t", "v", 3).where("frozen").count() == 7


def test_fills(spark):
    v = [None, 1.0, None, None, None, 5.0, None, 7.0, None]
    df = spark.createDataFrame([(1, half(i), x) for i, x in enumerate(v)], "k int, t timestamp_ntz, v double")
    x = interpolate(df, ["k"], "t", "v", limit=2).withColumn("f", forward_fill(F.col("v"), ["k"], "t")).withColumn("b", backward_fill(F.col("v"), ["k"], "t")).orderBy("t").collect()
    assert [r.filled for r in x] == [None, 1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, None]
    assert [r.f for r in x] == [None, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 7.0, 7.0]
    assert [r.b for r in x] == [1.0, 1.0, 5.0, 5.0, 5.0, 5.0, 7.0, 7.0, None]
    whole = interpolate(df, ["k"], "t", "v", limit=2, whole_gap_only=True, edges=True).orderBy("t").collect()
    assert [r.filled for r in whole] == [1.0, 1.0, None, None, None, 5.0, 6.0, 7.0, 7.0]


def test_intervals(spark):
    span = lambda rows: spark.createDataFrame(rows, "id string, start timestamp_ntz, end timestamp_ntz")
    actual, said = span([("a", half(0), half(4)), ("b", half(100), half(101))]), span([("p", half(1), half(2)), ("q", half(2), half(9))])
    got = {x.actual_id: (x.predicted_id, x.overlap_minutes) for x in best_overlap(actual, said).collect()}
    assert got == {"a": ("q", 60.0), "b": (None, 0.0)}
    points = spark.createDataFrame([(half(i),) for i in (0, 3, 4, 100)], "t timestamp_ntz")
    assert [x.inside for x in mark(points, "t", actual).orderBy("t").collect()] == [True, True, False, True]


def test_confusion_and_forecast_errors(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 0, 1), (1, 0, 0)], "k int, a int, p int")
    x = confusion(df, ["k"], F.col("a") == 1, F.col("p") == 1).first()
    assert (x.tp, x.fp, x.fn, x.precision, x.f1) == (1, 1, 1, 0.5, 0.5)
    e = spark.createDataFrame([("z", i, 0.0, 1.0) for i in range(48)] + [("p", i, a, b) for i, (a, b) in enumerate([(0.0, 0.0), (0.0, 3.0), (2.0, 0.0), (0.0, 0.0)])], "k string, i int, a double, b double")
    got = {x.k: x for x in forecast_errors(e, ["k"], "i", "a", "b").collect()}
    assert (got["z"].mae, got["z"].wape, got["z"].energy_error) == (1.0, None, 24.0)
    assert (got["p"].peak_timing_error_minutes, got["p"].peak_timing_bias_minutes, got["p"].peak_bias) == (30, -30, 1.0)


def test_recommendations_keep_their_distance(spark):
    df = spark.createDataFrame([(1, half(0), half(2), 1.0), (1, half(3), half(4), 5.0), (1, half(8), half(9), 2.0), (1, half(20), half(22), 1.5)], "d int, s timestamp_ntz, e timestamp_ntz, z double")
    assert [x.size for x in spaced_top(df, "d", "s", "e", "z").orderBy("rank").collect()] == [5.0, 2.0]
    flat = spark.createDataFrame([(1, half(i), v) for i, v in enumerate([3.0, 3.0, 9.0, 9.0, 1.0, 1.0])], "k int, t timestamp_ntz, v double")
    assert [x.v for x in window_around_peak(flat, ["k"], "t", "v", 4).orderBy("t").collect()] == [3.0, 3.0, 9.0, 9.0]


def test_history_uses_the_past_only(spark):
    rows = [("a", T.date() + timedelta(days=i), 1, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, d date, s int, v double")
    before = {x.d: x.history_median for x in history_median(df, ["k"], "d", "s", "v").collect()}
    changed = spark.createDataFrame([(k, d, s, v if i < 6 else 1e6) for i, (k, d, s, v) in enumerate(rows)], "k string, d date, s int, v double")
    after = {x.d: x.history_median for x in history_median(changed, ["k"], "d", "s", "v").collect()}
    assert [before[r[1]] for r in rows[:7]] == [after[r[1]] for r in rows[:7]] == [None, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5]


def test_quartiles_cut_between_ranks(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(150)], "k int, i int, v double")
    got = rank_quartile(df, ["k"], "v", "i", ["a", "b", "c", "d"]).groupBy("band").count().collect()
    assert {x.band: x["count"] for x in got} == {"a": 38, "b": 37, "c": 37, "d": 38}


def test_usual_window_passes_midnight(spark):
    slots = spark.createDataFrame([("a", T + timedelta(minutes=30 * i), 1.0) for i in range(96)], "c string, t timestamp_ntz, kw double")
    asks = spark.createDataFrame([(1, "a", T + timedelta(days=2), 44, 4)], "ask_id int, c string, as_of timestamp_ntz, from_slot int, to_slot int")
    assert usual_window(slots, asks, "c", "t", "kw").first().usual_kwh == 4.0


def test_savings_fall_back_to_the_event(spark):
    rows = [(1, "x", "a", "accept", 10.0, 6.0), (1, "x", "b", "decline", 10.0, 9.0), (1, "y", "c", "accept", 4.0, 1.0), (1, "z", "d", None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "event_id int, segment string, client_id string, response string, pre_kwh double, actual_kwh double")
    got = {x.segment: (x.source, round(x.saved_kwh, 6)) for x in savings(df).collect()}
    assert got == {"x": ("segment", 3.0), "y": ("event_fallback", round(4 * 14 / 15 - 1, 6))}


def test_ridge_equals_the_normal_equations(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -2.0, 3.0] + 4 + r.normal(size=60)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    m = models.ridge_fit(df, ["a", "b", "c"], ["y"], 2.0)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert m["coef"][:, 0] == pytest.approx(beta)
    assert float(m["intercept"][0]) == pytest.approx(y.mean() - x.mean(0) @ beta)


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b")], "x int, y string")
    assert adjusted_rand(df, "x", "y").first().ari == 1.0


def test_spread_join(spark):
    a = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 1), (None, 3)], "k int, v int")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "k int, w string")
    assert spread_join(a, b, ["k"]).count() == 20
    assert spread_join(a, b, ["k"], "left").where("w is null").count() == 2
    assert spread_join(a, b, ["k"], "left_anti").count() == 2


def test_ids_splits_and_text(spark):
    df = spark.createDataFrame([("c-0001", " VAL "), ("..", ""), (None, None)], "i string, s string")
    assert [tuple(r) for r in df.select(canonical_id("i"), split_name("s")).collect()] == [("C0001", "validation"), (None, None), (None, None)]
    assert spark.range(1).select(floor_to(F.lit(-1).cast("bigint"), 60)).first()[0] == -60
    t = spark.createDataFrame([("How’s my BILL?", "fr", datetime(2025, 1, 1, 18, 5), 3.14159)], "t string, l string, d timestamp_ntz, v double")
    got = t.select(normalised_text(F.col("t")), find_keyword(F.col("t"), {"tariff": ["tar"], "bill": ["bill"]}, "other"), format_time(F.col("d"), F.col("l")), format_number(F.col("v"), 2, F.col("l"))).first()
    assert tuple(got) == (" how's my bill ", "bill", "18h05", "3,14")


def test_buckets_rise_with_the_value(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 37) % 1000 / 10).alias("v"))
    for points, leaves in (([], 256), ([5.0], 256), ([10.0, 20.0, 80.0], 256), ([10.0, 20.0, 80.0], 1), ([10.0, 20.0, 30.0, 31.0, 80.0], 2)):
        got = [(r.v, r.b) for r in df.withColumn("b", bucket_of(F.col("v"), points, leaves)).collect()]
        assert all(b == sum(p <= v for p in points) for v, b in got)


def test_running_totals_equal_a_plain_sum(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), (F.col("id") % 7).alias("w"), F.lit(0).alias("m"))
    x = df.withColumn("b", hash_bucket(df, "h", F.col("m")))
    rows = running_totals(x, "g", "b", ["h"], "w").orderBy("g", "h").collect()
    seen = {}
    for r in rows:
        seen[r.g] = seen.get(r.g, 0) + r.w
        assert r.upto == seen[r.g]
    assert all(r.whole == seen[r.g] for r in rows)


def test_lookups_beyond_the_bound_give_the_same(spark):
    a = spark.createDataFrame([(i % 4, i) for i in range(40)] + [(None, 1)], "k int, v int")
    b = spark.createDataFrame([(0, "x"), (1, "y"), (9, "z")], "k int, w string")
    few, many = (sorted(map(str, lookup_join(a, b, ["k"], most_bytes=n).select("k", "v", "w").collect())) for n in (1 << 20, 0))
    assert few == many and len(few) == 41


def test_history_percentile_keeps_everything_older(spark):
    rows = [(T + timedelta(days=i), float(v)) for i, v in [(0, 1), (0, 2), (0, 9), (1, 4), (400, 100), (1200, 5), (1200, 6)]]
    x = spark.createDataFrame(rows, "t timestamp_ntz, v double").select(F.to_date("t").alias("day"), "v")
    got = {(r["day"] - T.date()).days: (r["threshold"], r["values"]) for r in history_percentile(x, "day", "v", 0.5).collect()}
    assert got == {1: (2.0, 3), 400: (3.0, 4), 1200: (4.0, 5)}
