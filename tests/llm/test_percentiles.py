"""Percentiles against numpy, merged and rounded forms, and the defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.llm.percentiles import merge_counts, percentiles, value_counts

QS = (0.0, 0.1, 0.5, 0.9, 1.0)
SCHEMA = "g string, v double, c int, part0 string, whole int, upto string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, f"p{i % 3}", 1, "x") for i, r in enumerate(rows)], SCHEMA)


def rows_(seed, n=400):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "b", None]), r.choice([None, float("nan"), 5.0, 5.0, float(r.randrange(50)), r.gauss(0, 100)])) for _ in range(n)] + [("one", 3.0), ("none", None), ("b", -0.0)]


def want(rows):
    out = {}
    for g in {g for g, _ in rows}:
        v = [x for k, x in rows if k == g and x is not None and x == x]
        if v:
            out |= {(g, q): (float(np.quantile(v, q)), len(v)) for q in QS}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exact_and_merged(spark, seed):
    rows = rows_(seed)
    df = frame(spark, rows)
    parts = value_counts(df, F.col("g"), F.col("v"), F.col("part0"))
    for counts in (value_counts(df, F.col("g"), F.col("v")), merge_counts(parts)):
        got = {(x.k, x.percent): (x.value, x["values"]) for x in percentiles(counts, QS, name="k", pieces=5 + 2000 * (seed == 1)).collect()}
        expected = want(rows)
        assert set(got) == set(expected)
        for key, (v, n) in expected.items():
            assert got[key] == (pytest.approx(v, abs=1e-8), n)


def test_rounded_is_within_its_error(spark):
    r = random.Random(1)
    rows = [("a", r.lognormvariate(3, 2)) for _ in range(3000)]
    got = {x.percent: x.value for x in percentiles(value_counts(frame(spark, rows), F.col("g"), F.col("v"), relative_error=0.01), QS, name="k").collect()}
    v = [x for _, x in rows]
    assert all(abs(got[q] / np.quantile(v, q) - 1) < 0.01 for q in QS)
    assert value_counts(frame(spark, rows), F.col("g"), F.col("v"), relative_error=0.05).count() < 400


def test_infinite_values_and_empty(spark):
    inf = float("inf")
    got = {x.percent: x.value for x in percentiles(value_counts(frame(spark, [("a", inf), ("a", inf), ("a", -inf), ("a", 1.0), ("a", 2.0)]), F.col("g"), F.col("v")), (0.0, 0.5, 1.0), name="k").collect()}
    assert got == {0.0: -inf, 0.5: 2.0, 1.0: inf}
    assert percentiles(value_counts(frame(spark, []), F.col("g"), F.col("v")), QS).count() == 0


def test_many_cut_points_are_an_equal_number_of_values_each(spark):
    from voltloom.operators.ordering import bucket_of

    points = [float(i * i) for i in range(1000)]
    df = spark.createDataFrame([(float(v),) for v in range(-5, 1_100_000, 997)], "v double")
    got = {x.v: x.b for x in df.select("v", bucket_of(F.col("v"), points).alias("b")).collect()}
    assert got == {v: sum(p <= v for p in points) for v in got}
