"""Joins of half-open time intervals, bucketed by day so that they are equi-joins first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _days(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day the interval touches."""
    last = F.greatest(F.to_date(start), F.to_date(F.col(end) - F.expr("INTERVAL '0.000001' SECOND")))
    return df.withColumn("_day", F.explode(F.sequence(F.to_date(start), last)))


def points_in(df: DataFrame, ts: str, spans: DataFrame, on: Sequence[str] = (), start: str = "start", end: str = "end", how: str = "inner") -> DataFrame:
    """Rows joined to the intervals that contain their time (start <= ts < end)."""
    x = df.withColumn("_day", F.to_date(ts)).alias("x")
    y = _days(spans, start, end)
    y = y.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in y.columns if c != "_day"], F.col("_day").alias("_sday"))
    cond = (F.col("_day") == F.col("_sday")) & (F.col(start) <= F.col(ts)) & (F.col(ts) < F.col(end))
    for c in on:
        cond = cond & (F.col(f"x.{c}") == F.col(f"_{c}"))
    return x.join(y, cond, how).drop("_day", "_sday", *[f"_{c}" for c in on])


def mark(df: DataFrame, ts: str, spans: DataFrame, on: Sequence[str] = (), name: str = "inside") -> DataFrame:
    """Adds ``name``: whether any interval contains the row's time. Intervals are cut into days, merged per day, and joined once."""
    y = _days(spans, "start", "end").groupBy(*on, "_day").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    x = df.withColumn("_day", F.to_date(ts)).join(y, [*on, "_day"], "left")
    hit = F.exists("_spans", lambda s: (s["start"] <= F.col(ts)) & (F.col(ts) < s["end"]))
    return x.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_day", "_spans")


def overlap_minutes(a: str, b: str, c: str, d: str) -> Column:
    """Minutes that [a, b) and [c, d) share."""
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    return F.greatest(F.least(us(b), us(d)) - F.greatest(us(a), us(c)), F.lit(0)) / 6e7


def best_overlap(actual: DataFrame, predicted: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """For every actual interval its predicted interval with the longest overlap (ties: the earliest); left join.

    Both have id, start, end. Result: actual_id, predicted_id, overlap_minutes, lead columns.
    """
    p = predicted.select(*on, F.col("id").alias("predicted_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    a = actual.select(*on, F.col("id").alias("actual_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    x = _days(a, "a_start", "a_end").join(_days(p, "p_start", "p_end"), [*on, "_day"]).where((F.col("a_start") < F.col("p_end")) & (F.col("p_start") < F.col("a_end")))
    x = x.drop("_day").distinct().withColumn("overlap_minutes", overlap_minutes("a_start", "a_end", "p_start", "p_end"))
    w = Window.partitionBy(*on, "actual_id").orderBy(F.desc("overlap_minutes"), "p_start", "predicted_id")
    best = x.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*on, "actual_id", "predicted_id", "overlap_minutes")
    return a.join(best, [*on, "actual_id"], "left").withColumn("overlap_minutes", F.coalesce("overlap_minutes", F.lit(0.0)))
