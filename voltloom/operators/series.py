"""Features along a series: lags, rolling frames, quality of trailing contexts, causal baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.columns import micros
from voltloom.operators.ordering import bucket_of, running_totals, split_points


def _w(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def lags(df: DataFrame, keys: Sequence[str], order: str, value: str, steps: Sequence[int]) -> DataFrame:
    return df.select("*", *[F.lag(value, k).over(_w(keys, order)).alias(f"lag_{k}") for k in steps])


def rolling_before(df: DataFrame, keys: Sequence[str], order: str, value: str, widths: Sequence[int]) -> DataFrame:
    """Mean and sample deviation of the ``k`` rows before the current one; null unless all k are known."""
    out = []
    for k in widths:
        w = _w(keys, order).rowsBetween(-k, -1)
        full = F.count(value).over(w) == k
        out += [F.when(full, F.avg(value).over(w)).alias(f"mean_{k}"), F.when(full, F.stddev_samp(value).over(w)).alias(f"std_{k}")]
    return df.select("*", *out)


def centered_mean(value: str, keys: Sequence[str], order: str, back: int, ahead: int) -> Column:
    """Mean over a centred frame, shorter at the ends."""
    return F.avg(value).over(_w(keys, order).rowsBetween(-back, ahead))


def clipped_difference(value: str, keys: Sequence[str], order: str, cap: float, scale: float = 1.0) -> Column:
    """Change since the row before (0 for the first), clipped to +-cap and divided by scale."""
    x = F.least(F.col(value), F.lit(cap))
    d = F.coalesce(x - F.lag(x).over(_w(keys, order)), F.lit(0.0))
    return F.greatest(F.least(d, F.lit(cap)), F.lit(-cap)) / scale


def forward_hours(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Adds ``hours`` to the next row; the key's median where there is none or it is not positive."""
    step = (F.lead(micros(ts)).over(_w(keys, ts)) - micros(ts)) / 3.6e9
    x = df.withColumn("_h", F.when(step > 0, step))
    mid = x.groupBy(*keys).agg(F.percentile("_h", F.lit(0.5)).alias("_mid")) if keys else None
    x = x.join(mid, list(keys)) if keys else x.join(F.broadcast(x.agg(F.percentile("_h", F.lit(0.5)).alias("_mid"))))
    return x.withColumn("hours", F.coalesce("_h", "_mid")).drop("_h", "_mid")


def standardise_context(df: DataFrame, keys: Sequence[str], order: str, value: str, length: int, least_variance: float = 1e-8) -> DataFrame:
    """context_mean, context_std (population) and z over the last ``length`` rows; null unless all are known and vary."""
    w = _w(keys, order).rowsBetween(-(length - 1), 0)
    full = (F.count(value).over(w) == length) & (F.var_pop(value).over(w) >= least_variance)
    mean, std = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return df.select("*", F.when(full, mean).alias("context_mean"), F.when(full, std).alias("context_std"), F.when(full, (F.col(value) - mean) / std).alias("z"))


def seasonal_persistence(df: DataFrame, keys: Sequence[str], ts: str, value: str, days: int = 7) -> DataFrame:
    """Adds ``predicted``: the value the given number of days earlier, by an equi-join on time."""
    old = df.select(*keys, (F.col(ts) + F.expr(f"INTERVAL '{days}' DAY")).alias(ts), F.col(value).alias("predicted"))
    return df.join(old, [*keys, ts], "left")


def history_median(df: DataFrame, keys: Sequence[str], day: str, slot: str, value: str, kind: str | None = None) -> DataFrame:
    """Adds ``history_median``: the median of the same slot over all days before (of the same kind of day).

    One growing frame per key and slot, which holds a value a day.
    """
    w = Window.partitionBy(*keys, slot, *([kind] if kind else [])).orderBy(F.datediff(day, F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("history_median", F.percentile(value, F.lit(0.5)).over(w))


def dynamic_threshold(df: DataFrame, keys: Sequence[str], order: str, value: str, length: int = 168, factor: float = 2.0) -> DataFrame:
    """Adds ``threshold`` = mean + factor * sample deviation of the last ``length`` rows before, and ``above``."""
    w = _w(keys, order).rowsBetween(-length, -1)
    t = F.when(F.count(value).over(w) == length, F.avg(value).over(w) + factor * F.stddev_samp(value).over(w))
    return df.withColumn("threshold", t).withColumn("above", F.col(value) > F.col("threshold"))


def history_percentile(df: DataFrame, day: str, value: str, q: float) -> DataFrame:
    """day, threshold: the percentile of all values of the days before it, of a table with a bounded number of values a day."""
    w = Window.orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("_d", F.datediff(day, F.lit("1970-01-01")))
    x = x.select(day, F.percentile(value, F.lit(q)).over(w).alias("threshold"), F.count(value).over(w).alias("values"), F.count(F.lit(1)).over(w).alias("_n"))
    return x.where("_n > 0").select(day, "threshold", "values").distinct()


def keep_last(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key occurs once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def rank_quartile(df: DataFrame, keys: Sequence[str], value: str, tie: str, labels: Sequence[str], plain: str | None = None) -> DataFrame:
    """Adds ``band``: quantile bands of the ranks (cut points between ranks, so not ntile).

    keys: few enough rows a key for one task; without keys all rows are ranked together, by
    a distributed sort. plain: the label of all where there are fewer distinct values than labels.
    """
    n = len(labels)
    if keys:
        w = Window.partitionBy(*keys).orderBy(value, tie)
        x = df.withColumn("_r", F.row_number().over(w)).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    else:
        pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        v = F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))
        x = df.withColumn("_v", v).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
        points = [p for p in split_points(x, "_v", pieces) if math.isfinite(p)]
        x = running_totals(x.withColumn("_bucket", bucket_of(F.col("_v"), points)), "_all", "_bucket", ["_v", tie], "_one")
        x = x.withColumnsRenamed({"upto": "_r", "whole": "_c"}).drop("_v", "_all", "_one", "_bucket")
    k = F.greatest(F.ceil((F.col("_r") - 1) * n / F.greatest(F.col("_c") - 1, F.lit(1))), F.lit(1)).cast("int")
    band = F.element_at(F.array(*[F.lit(x) for x in labels]), k)
    if plain is not None:
        few = df.groupBy(*keys).agg((F.count_distinct(value) < n).alias("_few"))
        x = x.join(few, list(keys)) if keys else x.join(F.broadcast(few), F.lit(True))  # one row
        band = F.when(F.col("_few"), F.lit(plain)).otherwise(band)
    return x.withColumn("band", band).drop("_r", "_c", "_few")
