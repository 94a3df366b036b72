"""Small reports over long tables: energy with coverage, latest values, picks, splits, transforms, ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordering import order_statistics, value_counts
from voltloom.session import cut


def hourly_energy(df: DataFrame, keys: Sequence[str], ts: str, watts: str, minutes: int = 60) -> DataFrame:
    """valid minutes, coverage and energy of the valid ones per key and hour; energy is null where none is valid."""
    n = F.count(watts)
    return df.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(n.alias("valid"), (n / minutes).alias("coverage"), (F.sum(watts) / 60000).alias("energy_kwh"))


def latest_values(df: DataFrame, keys: Sequence[str], ts: str, channels: Sequence[str]) -> DataFrame:
    """The last known value of each channel with its time (null where it never was known), one row per key."""
    out = []
    for c in channels:
        out += [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v")))).alias(f"_{c}")]
    x = df.groupBy(*keys).agg(*out)
    return x.select(*keys, *[a for c in channels for a in (F.col(f"_{c}.v").alias(f"last_{c}"), F.col(f"_{c}.t").alias(f"last_{c}_at"))])


def chronological_split(day: Column, train_end: str, validation_end: str) -> Column:
    """train before the first date, validation before the second, test from there on."""
    return F.when(day < F.to_date(F.lit(train_end)), "train").when(day < F.to_date(F.lit(validation_end)), "validation").otherwise("test")


def even_subset(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """At most ``size`` rows per key at evenly spaced positions, the first and the last included."""
    w = Window.partitionBy(*keys).orderBy(*order)
    i, n = F.col("_i"), F.col("_n")
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # position i is taken if some k of 0..size-1 rounds down to it: floor(k (n - 1) / (size - 1)) = i
    k = F.ceil(i * (size - 1) / F.greatest(n - 1, F.lit(1)))
    hit = (n <= size) | (F.floor(k * (n - 1) / max(size - 1, 1)) == i)
    return x.where(hit).drop("_i", "_n")


def ranked_picks(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """The best (least), the median and the worst row of each key, named in ``pick``."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    last, mid = F.col("_n") - 1, F.floor(F.col("_n") / 2)
    picks = F.array(*[F.when(F.col("_i") == p, F.lit(n)) for n, p in (("best", F.lit(0)), ("median", mid), ("worst", last))])
    return x.withColumn("pick", F.explode(F.array_compact(picks))).drop("_i", "_n")


def channel_transforms(df: DataFrame, channels: Mapping[str, Column], cap: float = 0.999, threshold: float = 50.0) -> DataFrame:
    """Per channel: cap (quantile), mean, population deviation and active share of its known values."""
    parts = [F.struct(F.lit(n).alias("channel"), c.cast("double").alias("v")) for n, c in channels.items()]
    x = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where("v is not null and abs(v) < 1e300")
    caps = order_statistics(cut(value_counts(x, ["channel"], F.col("v"))), "channel", [cap]).select("channel", F.col("value").alias("cap"))
    y = x.groupBy("channel").agg(F.count("v").alias("known"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg((F.col("v") >= threshold).cast("double")).alias("active"))
    return y.join(F.broadcast(caps), "channel")  # a row a channel


def zscores(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``z``: the value standardised within its key (population deviation; null where it does not vary)."""
    w = Window.partitionBy(*keys)
    s = F.stddev_pop(value).over(w)
    return df.withColumn("z", F.when(s > 0, (F.col(value) - F.avg(value).over(w)) / s))


def ensemble(weights: Mapping[str, float]) -> Column:
    """Weighted sum of forecast columns; null where one is missing."""
    total = sum(weights.values())
    return sum((F.col(c) * (w / total) for c, w in weights.items()), F.lit(0.0))


def select_candidate(metrics: DataFrame, method: str, current: str, least_gain: float = 0.02) -> DataFrame:
    """Methods against the current one: better by ``least_gain`` in rmse and mae and no worse in wape."""
    base = metrics.where(F.col(method) == current).select(F.col("rmse").alias("b_rmse"), F.col("mae").alias("b_mae"), F.col("wape").alias("b_wape"))
    x = metrics.where(F.col(method) != current).join(F.broadcast(base), F.lit(True))  # base is one row
    ok = (F.col("rmse") <= (1 - least_gain) * F.col("b_rmse")) & (F.col("mae") <= (1 - least_gain) * F.col("b_mae")) & (F.col("wape") <= F.col("b_wape"))
    return x.select(method, "rmse", "mae", "wape", F.coalesce(ok, F.lit(False)).alias("selected"))


def append_missing(ranked: DataFrame, every: DataFrame, key: str, rank: str) -> DataFrame:
    """The ranked rows and, after them, keys that are not ranked (rank null)."""
    lost = every.select(key).distinct().join(ranked.select(key), key, "left_anti")
    return ranked.select(key, rank, F.lit(True).alias("ranked")).unionByName(lost.select(key, F.lit(None).cast("int").alias(rank), F.lit(False).alias("ranked")))


def weekly_counts(df: DataFrame, keys: Sequence[str], ts: str, what: str) -> DataFrame:
    """Distinct ``what`` per key and ISO week (its Monday)."""
    return df.groupBy(*keys, F.date_trunc("week", ts).cast("date").alias("week")).agg(F.count_distinct(what).alias("distinct"))
