"""Truth evaluation, classes, appliance buckets, clusters, chunked inference and degraded data."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators import evaluation as ev

T0 = datetime(2025, 7, 1, 10)


def test_estimates_against_truth(spark):
    guess = spark.createDataFrame([(1, "a", 10.0), (2, "a", 30.0), (3, "b", 5.0), (9, "b", 1.0)], "id int, seg string, est double")
    truth = spark.createDataFrame([(1, 20.0), (2, 20.0), (3, 10.0)], "id int, true double")
    groups = ev.estimate_errors(ev.truth_join(guess, truth, ["id"]), ["seg"], "est", "true").cache()
    assert {x.seg: (x.rows, x.error_pct) for x in groups.collect()} == {"a": (2, 0.0), "b": (1, -50.0)}
    x = ev.overall_errors(groups).first()
    assert x.error_pct == pytest.approx(-10.0) and x.mean_abs_error_pct == pytest.approx(10.0)
    assert ev.estimate_errors(guess.limit(0).withColumn("true", F.lit(1.0)), ["seg"], "est", "true").count() == 0


def test_values_and_classes(spark):
    df = spark.createDataFrame([("a", "accept", 2.0), ("a", None, 9.0), ("b", "decline", None)], "seg string, r string, v double")
    got = {x.seg: tuple(x)[1:] for x in ev.targeting_value(df, "seg", F.col("r") == "accept", "v").collect()}
    assert got == {"a": (2, 0.5, 2.0, 2.0), "b": (1, 0.0, None, 0.0)}
    one = spark.createDataFrame([(9.0,), (10.0,), (11.0,), (None,)], "v double").select(ev.load_class(F.col("v"), F.lit(10.0)).alias("c"))
    assert [x.c for x in one.collect()] == ["Normal", "Warning", "Critical", None]
    days = spark.createDataFrame([(date(2025, 1, d),) for d in (1, 2, 3, 4)], "d date")
    assert [x.p for x in days.select(ev.provenance(F.col("d"), "2025-01-02/2025-01-03").alias("p")).collect()] == ["retrospective", "held_out", "held_out", "retrospective"]
    assert days.where(ev.provenance(F.col("d"), None) == "held_out").count() == 0
    c = spark.createDataFrame([(1.0, 1.0), (1.0, 0.9), (None, 1.0)], "a double, b double").select(ev.fully_covered("a", "b").alias("ok"))
    assert [x.ok for x in c.collect()] == [True, False, False]
    assert days.select(ev.one_hot(F.weekday("d"), 7).alias("h")).first().h == [0, 0, 1, 0, 0, 0, 0]
    long = spark.createDataFrame([(1, "x", 5.0), (1, "y", 6.0), (2, "y", 7.0), (2, "z", 8.0)], "t int, n string, v double")
    assert sorted(tuple(r) for r in ev.side_by_side(long, ["t"], "n", "v", ["x", "y"]).collect()) == [(1, 5.0, 6.0), (2, None, 7.0)]
    ev.verify_columns(long, {"t": "int", "n": "string"})
    with pytest.raises(ValueError, match="v is double, not int; w is missing"):
        ev.verify_columns(long, {"v": "int", "w": "string"})


def test_buckets_add_up(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), T0 + timedelta(minutes=7 * i), r.choice(["ac", "heat"]), r.choice([None, 0.0, 80.0, 200.0]), r.choice([None, 10.0, 90.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "home string, ts timestamp_ntz, app string, a double, p double")
    make = lambda x: ev.appliance_buckets(x, "home", "ts", "app", "a", "p", {"late": F.hour("ts") >= 18})
    whole = make(df)
    parts = make(df.where("home = 'a'")).unionByName(make(df.where("home = 'b'")))
    assert ev.merge_buckets(parts).exceptAll(whole.select(*ev.merge_buckets(parts).columns)).count() == 0
    m = {(x.appliance, x.home, x.stratum): x for x in ev.bucket_metrics(whole).collect()}
    known = [(h, t, a, p) for h, t, app, a, p in rows if app == "ac" and a is not None and p is not None]
    x = m["ac", "ALL", "overall"]
    assert x["count"] == len(known) and x.mae == pytest.approx(np.mean([abs(p - a) for *_, a, p in known]))
    tp, fp, fn = (sum((a >= 50) == u and (p >= 50) == w for *_, a, p in known) for u, w in ((True, True), (False, True), (True, False)))
    assert x.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn)) and x.precision == pytest.approx(tp / (tp + fp))
    hours = {}
    for h, t, a, p in known:
        hours.setdefault((h, t.replace(minute=0)), []).append(p - a)
    assert x.hours == len(hours) and x.hourly_mae == pytest.approx(np.mean([abs(np.mean(e)) for e in hours.values()]))
    diff = ev.metric_differences(ev.bucket_metrics(whole).where("home = 'ALL'"), ["appliance"], "stratum", "overall", "late", ["mae"])
    assert diff.count() == 2


def test_look_back(spark):
    slots = spark.createDataFrame([("h", datetime(2025, 5, d, 19), float(d)) for d in range(1, 31)] + [("h", datetime(2025, 5, 30, 3), 99.0)], "client_id string, slot timestamp_ntz, kw double")
    asks = spark.createDataFrame([(1, "h", datetime(2025, 5, 31), 36, 44)], "ask_id int, client_id string, as_of timestamp_ntz, from_slot int, to_slot int")
    touched = spark.createDataFrame([(date(2025, 5, 30),)], "date date")
    x = ev.local_usual_window(slots, asks, "client_id", "slot", "kw", touched, most=3).first()
    assert (x.usual_kwh, x.days) == ((29 + 28 + 27) / 3 * 0.5, 3)
    daily = spark.createDataFrame([("h", datetime(2025, 5, d, 22), float(d)) for d in (1, 25, 28, 31)], "client_id string, ended timestamp_ntz, kwh double")
    x = ev.window_lookback(daily, asks.select("ask_id", "client_id", "as_of"), "client_id").first()
    assert (x.kwh, x.windows) == (26.5, 2)
    hot = spark.createDataFrame([("a", 1, True, 30.0), ("b", 1, True, 30.0), ("a", 2, True, 30.0), ("b", 2, False, 30.0), ("a", 3, True, 20.0), ("b", 3, True, 20.0)], "c string, d int, ok boolean, t double")
    assert [r.d for r in ev.hot_days(hot, "c", "d", F.col("ok"), "t").collect()] == [1]


def test_asks_are_not_broadcast(spark):
    r = random.Random(4)
    slots = [(c, datetime(2025, 1, 1, 17) + timedelta(days=r.randrange(200), minutes=30 * r.randrange(12)), r.random()) for c in ("a", "b", "c") for _ in range(400)]
    slots = list({(c, t): (c, t, v) for c, t, v in slots}.values())
    asks = [(i, c, datetime(2025, 1, 1) + timedelta(days=i * 7), 36, 44) for i in range(30) for c in ("a", "b", "d")] + [(99, "a", None, 36, 44)]
    gone = {date(2025, 1, 1) + timedelta(days=d) for d in range(0, 200, 3)}
    of = spark.createDataFrame(asks, "ask_id int, client_id string, as_of timestamp_ntz, from_slot int, to_slot int").distinct()
    x = ev.local_usual_window(spark.createDataFrame(slots, "client_id string, slot timestamp_ntz, kw double"), of, "client_id", "slot", "kw", spark.createDataFrame([(d,) for d in gone], "date date"), most=5, days=40)
    got = {(i.ask_id, i.client_id): (pytest.approx(i.usual_kwh), i.days) for i in x.collect()}
    plan = x._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastExchange") == 1  # the days of events
    want = {}
    for i, c, at, a, b in asks[:-1]:
        days = {}
        for k, t, v in slots:
            if k == c and at - timedelta(days=40) <= t < at and a <= t.hour * 2 + t.minute // 30 < b and t.date() not in gone:
                days.setdefault(t.date(), []).append(v / 2)
        if days:
            last = [sum(days[d]) for d in sorted(days)[-5:]]
            want[i, c] = (sum(last) / len(last), len(last))
    assert got == want


def test_clusters(spark):
    means = spark.createDataFrame([(0, 5.0, 0.2), (1, 1.0, 0.9), (2, 9.0, 0.1), (3, 2.0, 0.3)], "cluster int, usage double, evening double")
    rules = [("low", "usage", False), ("large", "usage", True), ("evening", "evening", True)]
    assert ev.name_clusters(means, rules) == {1: "low", 2: "large", 3: "evening", 0: "medium"}
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(size=(12, 2)), r.normal(size=(9, 2)) + 3, [[50.0, 50.0]]])
    k = [0] * 12 + [1] * 9 + [2]
    df = spark.createDataFrame([(c, v.tolist()) for c, v in zip(k, x)], "k int, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = []
    for i, c in enumerate(k):
        own = [d[i, j] for j in range(len(k)) if k[j] == c and j != i]
        near = min(np.mean([d[i, j] for j in range(len(k)) if k[j] == o]) for o in set(k) - {c})
        want.append((near - np.mean(own)) / max(near, np.mean(own)) if own else 0.0)
    assert ev.silhouette(df, "v", "k").first().silhouette == pytest.approx(np.mean(want))


def test_chunks_give_what_the_whole_series_gives(spark):
    r = random.Random(2)
    t, rows = T0, []
    for i in range(300):
        t += timedelta(minutes=r.choice([10, 30, 60]))
        rows.append(("k", t, None if r.random() < 0.02 else r.random(), "x"))
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz, v double, ts string").drop("ts")
    model = lambda v: np.convolve(v, np.ones(5))[: len(v)]
    got = {x.ts: x.prediction for x in ev.chunked_inference(df, "key", "at", "v", model, context=5).collect()}
    assert set(got) == {t for _, t, *_ in rows}
    for i, (_, t, *_) in enumerate(rows):
        last = [v for _, _, v, _ in rows[max(i - 4, 0) : i + 1]]
        assert got[t] == (pytest.approx(sum(last)) if len(last) == 5 and None not in last else None)


def test_degraded_data_are_the_same_every_time(spark):
    df = spark.range(4000).select("id", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), F.lit(10.0).alias("v"), F.lit("k").alias("k"))
    a, b = ev.degrade(df, ["k"], "v", ts="ts"), ev.degrade(df.repartition(5), ["k"], "v", ts="ts")
    assert a.exceptAll(b).count() == 0
    assert 40 < a.where("v is null").count() < 130 and 5 < a.where("v >= 50 and v <= 150").count() < 45 and a.where("v > 10 and v < 50").count() == 0
    held = ev.degrade(df.withColumn("v", F.col("id").cast("double")), ["k"], "v", gap_every=10**9, spike_every=10**9, frozen_minutes=60, ts="ts")
    assert held.where("hour(ts) = 23").groupBy(F.to_date("ts")).agg(F.count_distinct("v").alias("n")).where("n > 1").count() == 0
