"""Runs of rows that satisfy a condition (gaps and islands), in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def true_runs(df: DataFrame, keys: Sequence[str], order: str, condition: Column) -> DataFrame:
    """The rows for which the condition holds, with ``run``: the number of the run within its key."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("_c", F.coalesce(condition, F.lit(False)))
    x = x.withColumn("_s", (F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False))).cast("int"))
    return x.withColumn("run", F.sum("_s").over(w)).where("_c").drop("_c", "_s")


def run_windows(df: DataFrame, keys: Sequence[str], order: str, condition: Column, minutes: int = 30) -> DataFrame:
    """start, end (one slot after the last row), slots of every run."""
    runs = true_runs(df, keys, order, condition)
    return runs.groupBy(*keys, "run").agg(F.min(order).alias("start"), (F.max(order) + F.expr(f"INTERVAL '{minutes}' MINUTE")).alias("end"), F.count(F.lit(1)).alias("slots"))


def risk_windows(df: DataFrame, keys: Sequence[str], order: str, margin: str, *, minutes: int = 30, safety: float = 0.0) -> DataFrame:
    """Runs of shortfall: start, end, duration, deepest deficit with its first time, shortage energy."""
    short = F.greatest(-F.col(margin) - safety, F.lit(0.0))
    x = true_runs(df.withColumn("deficit", F.when(F.col(margin).isNotNull(), short)), keys, order, F.col("deficit") > 0)
    seq = Window.partitionBy(*keys, "run").orderBy(order)
    x = x.withColumn("_i", F.row_number().over(seq))
    y = x.groupBy(*keys, "run").agg(
        F.min(order).alias("start"), F.max(order).alias("_last"), F.count(F.lit(1)).alias("slots"), F.max(F.struct("deficit", -F.col("_i"), F.col(order))).alias("_m"),
        F.avg("deficit").alias("mean_deficit"), (F.sum("deficit") * (minutes / 60)).alias("shortage_energy"),
    )
    return y.select(*keys, "run", "start", (F.col("_last") + F.expr(f"INTERVAL '{minutes}' MINUTE")).alias("end"), "slots", (F.col("slots") * minutes).alias("duration_minutes"), F.col("_m.deficit").alias("max_deficit"), F.col(f"_m.{order}").alias("deepest"), "mean_deficit", "shortage_energy")


def equal_runs(df: DataFrame, keys: Sequence[str], order: str, value: str, least: int = 20) -> DataFrame:
    """Adds ``run_length`` and ``frozen``: whether the row lies in at least ``least`` successive equal values."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("_s", (~F.coalesce(F.lag(value).over(w) == F.col(value), F.lit(False))).cast("int"))
    x = x.withColumn("_r", F.sum("_s").over(w)).withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_r")))
    return x.withColumn("frozen", (F.col("run_length") >= least) & F.col(value).isNotNull()).drop("_s", "_r")
