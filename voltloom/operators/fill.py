"""Filling of gaps along a series: forward, backward, and linear in time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.columns import micros


def _before(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _after(keys: Sequence[str], order: str):
    """The rows from here on, nearest last: a frame that grows, as one that shrinks is summed up anew for every row."""
    return Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(value: Column, keys: Sequence[str], order: str) -> Column:
    """The last known value so far: uses the past only."""
    return F.last(value, ignorenulls=True).over(_before(keys, order))


def backward_fill(value: Column, keys: Sequence[str], order: str) -> Column:
    return F.last(value, ignorenulls=True).over(_after(keys, order))


def interpolations(df: DataFrame, keys: Sequence[str], order: str, value: str, outs: Mapping[str, tuple[int | None, bool]], *, edges: bool = False) -> DataFrame:
    """Adds one column per entry of ``outs`` (name: limit, whole_gap_only), all from the same two passes over the series; see ``interpolate``."""
    t = micros(order).cast("double")
    x = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    known = F.when(F.col(value).isNotNull(), F.struct(t.alias("t"), F.col(value).alias("v"), F.col("_i").alias("i")))
    x = x.withColumn("_p", F.last(known, ignorenulls=True).over(_before(keys, order))).withColumn("_n", F.last(known, ignorenulls=True).over(_after(keys, order)))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (t - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    inside = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    cols = []
    for name, (limit, whole_gap_only) in outs.items():
        place = F.col("_n.i") - F.col("_p.i") - 1 if whole_gap_only else F.col("_i") - F.col("_p.i")
        can = inside if limit is None else inside & (place <= limit)
        filled = F.coalesce(F.col(value), F.when(can, line))
        if edges:
            filled = F.coalesce(filled, F.when(F.col("_p").isNull(), F.col("_n.v")), F.when(F.col("_n").isNull(), F.col("_p.v")))
        cols.append(filled.alias(name))
    return x.select(*df.columns, *cols)


def interpolate(df: DataFrame, keys: Sequence[str], order: str, value: str, *, limit: int | None = None, whole_gap_only: bool = False, edges: bool = False, out: str = "filled") -> DataFrame:
    """Adds ``out``: nulls between two known values filled linearly in time.

    limit: at most so many successive nulls are filled, also the first ones of a longer
    gap, unless whole_gap_only. edges: leading and trailing nulls take the nearest value.
    """
    return interpolations(df, keys, order, value, {out: (limit, whole_gap_only)}, edges=edges)
