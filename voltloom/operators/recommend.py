"""Choosing few, spaced windows among many: a fold over each day's sorted candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spaced_top(df: DataFrame, day: str, start: str, end: str, size: str, *, most: int = 2, gap_minutes: int = 60) -> DataFrame:
    """Per day the largest candidates, each accepted only if it keeps the gap to those accepted before; at most ``most``.

    A day has a few candidates (at most one a slot), so the fold runs inside one row.
    Ties go to the earlier start.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = gap_minutes * 60_000_000
    item = F.struct((-F.col(size)).alias("k"), us(start).alias("a"), us(end).alias("b"), F.col(start).alias("start"), F.col(end).alias("end"), F.col(size).alias("size"))
    x = df.groupBy(day).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    none = F.slice("_items", 1, 0)

    def step(acc, c):
        near = F.exists(acc, lambda o: (c["a"] < o["b"] + F.lit(gap)) & (o["a"] < c["b"] + F.lit(gap)))
        return F.when((F.size(acc) < most) & ~near, F.concat(acc, F.array(c))).otherwise(acc)

    y = x.select(day, F.posexplode(F.aggregate("_items", none, step)).alias("_n", "w"))
    return y.select(day, (F.col("_n") + 1).alias("rank"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.size").alias("size"))


def window_around_peak(df: DataFrame, keys: list[str], order: str, value: str, slots: int) -> DataFrame:
    """The rows of each run within at most ``slots`` rows around its first maximum, kept inside the run."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    x = x.withColumn("_p", -F.max(F.struct(F.col(value), (-F.col("_i")).alias("j"))).over(whole)["j"])
    first = F.greatest(F.least(F.col("_p") - slots // 2, F.col("_n") - slots), F.lit(0))
    return x.where((F.col("_i") >= first) & (F.col("_i") < first + slots)).drop("_i", "_n", "_p")
