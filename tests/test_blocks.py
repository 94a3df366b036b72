"""Windows over blocked series against the same windows over whole ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltloom.operators.runs import as_of, equal_run_lengths, previous_values, trailing_status
from voltloom.operators.series import rank_quartile

T0 = datetime(2025, 1, 1, 22)


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(4)
    rows = []
    for k in ("hot", "b", None):
        t = T0
        for _ in range(300 if k == "hot" else 40):
            t += timedelta(minutes=r.choice([1, 60, 500, 3000]))
            rows.append((k, t, r.choice([None, 1.0, 1.0, 1.0, 2.0]), r.random() < 0.05, "x"))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, bad boolean, _i string").cache()


def test_previous_values(spark, series):
    w = Window.partitionBy("k").orderBy("ts")
    want = series.select("k", "ts", F.lag("v").over(w).alias("prev_v"), F.lag("ts").over(w).alias("prev_ts"), F.lag("ts").over(w).isNotNull().alias("has_prev"))
    got = previous_values(series.drop("_i"), ["k"], "ts", ["v", "ts"]).select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert previous_values(series.limit(0), ["k"], "ts", ["v"]).count() == 0


def test_equal_runs_cross_blocks(spark, series):
    w = Window.partitionBy("k").orderBy("ts")
    x = series.withColumn("new", (~F.lag("v").over(w).eqNullSafe(F.col("v")) | (F.row_number().over(w) == 1)).cast("int"))
    want = x.withColumn("run", F.sum("new").over(w)).groupBy("k", "run").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("run_length")).drop("run")
    got = equal_run_lengths(series.drop("_i"), ["k"], "ts", "v").select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_trailing_status(spark, series):
    some = series.where("k is not null").drop("_i")
    w = Window.partitionBy("k").orderBy("ts")
    last = w.rowsBetween(-7, 0)
    lost = F.max(F.col("v").isNull().cast("int")).over(last) == 1
    bad = F.max(F.col("bad").cast("int")).over(last) == 1
    want = some.select("k", "ts", F.when(F.row_number().over(w) < 8, "short").when(bad, "bad").when(lost, "lost").otherwise("valid").alias("context_status"))
    got = trailing_status(some, ["k"], "ts", [("bad", F.col("bad")), ("lost", F.col("v").isNull())], 8).select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_as_of(spark, series):
    r = random.Random(9)
    states = [(r.choice(["hot", "b", "z"]), r.choice([None, T0 + timedelta(hours=r.randrange(9000))]), i) for i in range(120)]
    states += [("hot", T0 + timedelta(minutes=1), 500), ("hot", T0 + timedelta(minutes=1), 501)]
    s = spark.createDataFrame(states, "k string, since timestamp_ntz, n int")
    rows = series.select("k", "ts", "v", F.monotonically_increasing_id().alias("id")).cache()
    got = {x.id: x.n for x in as_of(rows, s, "k", "ts", "since", ["n"]).collect()}
    for x in rows.collect():
        past = [(since, n) for k, since, n in states if k == x.k and k is not None and since is not None and since <= x.ts]
        assert got[x.id] == (max(past)[1] if past else None)
    assert as_of(rows, s.limit(0), "k", "ts", "since", ["n"]).where("n is null").count() == rows.count()


def test_quartiles_of_all_rows(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, r.choice([None, float(r.randrange(20)), r.gauss(0, 5)])) for i in range(500)], "i int, v double")
    names = ["a", "b", "c", "d"]
    want = rank_quartile(df.withColumn("all", F.lit(1)), ["all"], "v", "i", names).select("i", "band")
    got = rank_quartile(df, [], "v", "i", names, "typical").select("i", "band")
    assert got.exceptAll(want).count() == 0 and got.count() == 500
    few = rank_quartile(df.withColumn("v", F.col("i") % 3), [], "v", "i", names, "typical")
    assert [x.band for x in few.select("band").distinct().collect()] == ["typical"]
