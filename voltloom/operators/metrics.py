"""Errors of forecasts, confusion of labels, and their rollups; all are plain mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def forecast_errors(df: DataFrame, by: Sequence[str], slot: str, actual: str, predicted: str, *, minutes: int = 30) -> DataFrame:
    """One row per forecast: mae, rmse, wape, energy_bias, energy_error, energy_error_pct, peak magnitude error and bias, peak timing error and bias (minutes).

    Pairs with a value that is not finite are dropped; positions are counted among the
    remaining pairs, and the first of equal peaks is taken. wape and the percentage are
    null where there is no actual energy.
    """
    a, p = _finite(F.col(actual)), _finite(F.col(predicted))
    x = df.withColumn("_a", a).withColumn("_p", p).where("_a is not null and _p is not null")
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(slot)) - 1)
    e = F.col("_p") - F.col("_a")
    h = minutes / 60
    y = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("slots"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(F.abs(e)).alias("_ae"), F.sum(F.abs("_a")).alias("_aa"),
        (F.sum(e) * h).alias("energy_bias"), (F.sum("_a") * h).alias("_ea"),
        F.max(F.struct("_a", (-F.col("_i")).alias("j"))).alias("_pa"), F.max(F.struct("_p", (-F.col("_i")).alias("j"))).alias("_pp"),
    )
    shift = (F.col("_pa.j") - F.col("_pp.j")) * minutes
    return y.select(
        *by, "slots", "mae", "rmse", F.when(F.col("_aa") > 0, F.col("_ae") / F.col("_aa") * 100).alias("wape"), "energy_bias", F.abs("energy_bias").alias("energy_error"),
        F.when(F.col("_ea") != 0, F.col("energy_bias") / F.col("_ea") * 100).alias("energy_error_pct"), F.abs(F.col("_pp._p") - F.col("_pa._a")).alias("peak_error"), (F.col("_pp._p") - F.col("_pa._a")).alias("peak_bias"),
        F.abs(shift).alias("peak_timing_error_minutes"), shift.alias("peak_timing_bias_minutes"),
    )


def forecast_kpis(df: DataFrame, by: Sequence[str], slot: str, value: str, *, minutes: int = 30) -> DataFrame:
    """energy, peak, its first time, mean."""
    first = F.min(F.when(F.col(value) == F.col("_peak"), F.col(slot)))
    x = df.withColumn("_peak", F.max(value).over(Window.partitionBy(*by)))
    return x.groupBy(*by).agg((F.sum(value) * (minutes / 60)).alias("energy"), F.max("_peak").alias("peak"), first.alias("peak_slot"), F.avg(value).alias("mean"))


def confusion(df: DataFrame, by: Sequence[str], actual: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; an empty denominator gives 0."""
    n = lambda c: F.count(F.when(c, 1))
    x = df.groupBy(*by).agg(n(actual & predicted).alias("tp"), n(~actual & predicted).alias("fp"), n(actual & ~predicted).alias("fn"), n(~actual & ~predicted).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    x = x.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def regression(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """mae, rmse, mape over nonzero actuals, r2 = 1 - sse/sst."""
    x = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e, a = F.col(predicted) - F.col(actual), F.col(actual)
    n = F.count(F.lit(1))
    return x.groupBy(*by).agg(
        n.alias("pairs"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.when(a != 0, F.abs(e / F.nullif(a, F.lit(0.0))))) * 100).alias("mape"), (1 - F.sum(e * e) / F.nullif(F.var_pop(a) * n, F.lit(0.0))).alias("r2")
    )


def top_slots_error(df: DataFrame, by: Sequence[str], slot: str, actual: str, predicted: str, top: int = 6) -> DataFrame:
    """mae and rmse on the ``top`` largest actual slots (ties: the earliest)."""
    w = Window.partitionBy(*by).orderBy(F.desc(actual), slot)
    x = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    e = F.col(predicted) - F.col(actual)
    return x.groupBy(*by).agg(F.avg(F.abs(e)).alias("peak_mae"), F.sqrt(F.avg(e * e)).alias("peak_rmse"))


def rollups(df: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[str]) -> DataFrame:
    """Means of the measures for several groupings in one pass (grouping sets)."""
    every = sorted({c for s in sets for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("rows"))


def stratified(df: DataFrame, strata: Sequence[Column], actual: str, predicted: str, threshold: float) -> DataFrame:
    """Per stratum: count, mae, energies, activity tp/fp/fn and f1. Every row counts in each of its strata; all parts are sums."""
    x = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumn("stratum", F.explode(F.array_compact(F.array(*strata))))
    a, p = F.col(actual), F.col(predicted)
    on, said = a >= threshold, p >= threshold
    n = lambda c: F.count(F.when(c, 1))
    y = x.groupBy("stratum").agg(F.count(F.lit(1)).alias("count"), F.avg(F.abs(p - a)).alias("mae"), F.sum(a).alias("actual_sum"), F.sum(p).alias("predicted_sum"), n(on & said).alias("tp"), n(~on & said).alias("fp"), n(on & ~said).alias("fn"))
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return y.withColumn("f1", F.when(d > 0, 2 * F.col("tp") / d).otherwise(F.lit(0.0)))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """ari: agreement of two labelings, from their contingency table."""
    pairs = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    r = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("r"))
    c = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("c"))
    x = s.join(F.broadcast(r), F.lit(True)).join(F.broadcast(c), F.lit(True))  # one row each
    chance = F.col("r") * F.col("c") / pairs(F.col("t"))
    top = (F.col("r") + F.col("c")) / 2
    return x.select(F.when(top == chance, F.lit(1.0)).otherwise((F.col("s") - chance) / (top - chance)).alias("ari"))
