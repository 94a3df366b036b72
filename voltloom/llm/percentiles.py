"""Percentiles of very large numeric columns.

A full distributed sort with counts per partition: the values are cut into ranges,
each range of each group is sorted by itself, the counts of the ranges give every
range its offset within its group, the target positions are located in the ranges
and the neighbouring order statistics interpolated exactly.

Before the sort, equal values of a group are counted together on the map side. The
tables of counts are the mergeable form: those of months, days or files are added
and give the same result as one pass. The stated error is zero; with
``relative_error`` values are rounded to a grid of that relative width first, so
that the counts of any number of rows stay small, and results are within it.

Scale: a group with a third of all rows is sorted in as many tasks as there are
ranges, which hold about equal numbers of distinct values; nothing but the cut points
and no group as a whole reaches one task. The table is scanned once: the counts are
written to the shared folder, where the cut points and the sort read them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.operators.ordering import order_statistics
from voltloom.session import cut

_NONE = "\u0000"


def value_counts(df: DataFrame, group: Column, value: Column, *parts: Column, relative_error: float = 0.0) -> DataFrame:
    """part columns, g, v, c: how often each group holds each value. Null and NaN values are not counted."""
    v = value.cast("double")
    if relative_error > 0:
        step = math.log1p(relative_error)
        v = F.when((v == 0) | (F.abs(v) == float("inf")), v).otherwise(F.signum(v) * F.exp(F.round(F.log(F.abs(v)) / step) * step))
    x = df.select(*[p.alias(f"part{i}") for i, p in enumerate(parts)], F.coalesce(group.cast("string"), F.lit(_NONE)).alias("g"), v.alias("v"))
    x = x.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v")))
    return x.groupBy(*[f"part{i}" for i in range(len(parts))], "g", "v").agg(F.count(F.lit(1)).alias("c"))


def merge_counts(counts: DataFrame) -> DataFrame:
    """The counts of several parts as one."""
    return counts.groupBy("g", "v").agg(F.sum("c").alias("c"))


def percentiles(counts: DataFrame, percents: Sequence[float] = (0.5,), *, name: str = "group_key", pieces: int | None = None) -> DataFrame:
    """``name``, ``values`` (measured values in the group), ``percent``, ``value``: linear interpolation between order statistics.

    counts: from value_counts or merge_counts. Defined cases: a null group is a group of
    its own with a null key; a group without measured values has no row; with one value
    every percentile is that value; ties are counted; between two infinite neighbours of
    one sign the result is infinite; an empty table gives an empty result.
    """
    y = order_statistics(cut(counts), "g", percents, pieces)
    return y.select(F.when(F.col("g") != _NONE, F.col("g")).alias(name), F.col("n").alias("values"), F.col("q").alias("percent"), F.round("value", 9).alias("value"))
