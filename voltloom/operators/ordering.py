"""Running totals over groups of any size: a distributed sort with counts per partition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_points(df: DataFrame, value: str, pieces: int) -> list[float]:
    """At most ``pieces - 1`` increasing values that cut ``value`` into about equal parts (from a mergeable sketch)."""
    if pieces < 2:
        return []
    found = df.approxQuantile(value, [i / pieces for i in range(1, pieces)], 0.25 / pieces)
    return sorted({x for x in found if x is not None})


def bucket_of(c: Column, points: Sequence[float], most_leaves: int = 256) -> Column:
    """A bucket that rises with the value: the number of points at or below it.

    A balanced tree of comparisons; beyond ``most_leaves`` points the tree, which must stay
    small to be compiled, finds a stretch of points, and those of the stretch are counted.
    """

    def tree(points: Sequence[float], lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(points[mid]), tree(points, lo, mid)).otherwise(tree(points, mid + 1, hi))

    if len(points) <= most_leaves:
        return tree(points, 0, len(points))
    each = -(-len(points) // most_leaves)
    coarse = points[each - 1 :: each]
    at = tree(coarse, 0, len(coarse))
    stretches = [list(points[i : i + each - 1]) for i in range(0, len(points) + 1, each)]
    fine = F.get(F.array(*[F.array(*[F.lit(float(p)) for p in s]).cast("array<double>") for s in stretches]), at)
    return at * each + F.size(F.filter(fine, lambda p: p <= c))


def hash_bucket(df: DataFrame, h: str, major: Column, most_bits: int = 20) -> Column:
    """A bucket that rises with ``major`` (an int) and, within it, with the hash ``h``: at least 64 pieces, more where the session has more shuffle partitions."""
    bits = min(most_bits, max(6, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()))
    return major.cast("bigint") * (1 << bits) + F.shiftright(h, 64 - bits)


def running_totals(df: DataFrame, group: str, bucket: str, order: Sequence[str], weight: str) -> DataFrame:
    """Adds ``upto`` (the group's sum of ``weight`` up to and with the row) and ``whole`` (the group's sum).

    ``bucket`` must rise with ``order``: it cuts a group into pieces that are sorted apart;
    a table of sums per group and bucket gives each piece its offset. Group and bucket must
    not be null; the order must be unique within a group for the result to be defined.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(weight).alias("_sum"))
    w = Window.partitionBy(group).orderBy(bucket)
    offsets = sums.select(group, bucket, (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(group)).alias("whole"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(offsets, [group, bucket]).withColumn("upto", F.col("_before") + F.sum(weight).over(inside)).drop("_before")


def value_counts(df: DataFrame, groups: Sequence[str], value: Column) -> DataFrame:
    """groups, v, c: how often each group holds each value. Null and NaN values are not counted."""
    x = df.select(*groups, value.cast("double").alias("v"))
    x = x.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v")))
    return x.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("c"))


def order_statistics(counts: DataFrame, group: str, percents: Sequence[float], pieces: int | None = None) -> DataFrame:
    """group, q, n, value: percentiles of counted values (group, v, c), by linear interpolation between order statistics.

    The values are cut into ranges of about equal numbers of distinct values, each range of
    each group is sorted by itself, sums per range give the offsets, and the neighbours of
    every target position are read off. ``counts`` are read twice, so they should be a
    written table. The group must not be null; a group without values has no row.
    """
    pieces = pieces or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = [p for p in split_points(counts, "v", pieces) if math.isfinite(p)]
    x = counts.withColumn("_bucket", bucket_of(F.col("v"), points))
    x = running_totals(x, group, "_bucket", ["v"], "c")
    at = F.array(*[F.struct(F.lit(float(q)).alias("q"), ((F.col("whole") - 1) * F.lit(float(q))).alias("h")) for q in percents])
    inside = lambda p: (F.col("upto") - F.col("c") <= p) & (p < F.col("upto"))
    x = x.select(group, "v", "c", "upto", "whole", F.explode(F.filter(at, lambda s: inside(F.floor(s["h"])) | inside(F.ceil(s["h"])))).alias("s"))
    low, high = F.floor("s.h"), F.ceil("s.h")
    y = x.groupBy(group, "s.q").agg(
        F.max("whole").alias("n"), F.max("s.h").alias("h"),
        F.max(F.when(inside(low), F.col("v"))).alias("lo"), F.max(F.when(inside(high), F.col("v"))).alias("hi"),
    )
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h")))
    return y.select(group, "q", F.col("n").cast("bigint").alias("n"), value.alias("value"))
