"""Windows over blocked series: what a row needs of the blocks before its own travels in a table with one row a block.

A window partitioned by source alone puts a source with a third of all rows into one task.
Here rows are hashed by source and time block, so that no task sorts more than a block,
and the blocks' ends, some hundred rows a source and year, are what is sorted by source.
Times must be unique per source; rows with a null key or time make blocks of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.columns import DAY_US, floor_to, micros


def merge_runs(parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: str) -> DataFrame:
    """Adds ``run_length``: the length of the whole run each part belongs to.

    A part says of a stretch of equal values how long it is and whether it touches its
    block's start (``touch_start``) or end (``touch_end``); ``value`` tells runs apart.
    Every block with a reading must have a part, so that parts of blocks further apart
    are never joined. A source has a few parts a block, however many readings it has.
    """
    x = _merged(parts, keys, order, value)
    return x.withColumn("run_length", F.sum(length).over(Window.partitionBy(*keys, "_island"))).drop("_island")


def _merged(parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """parts with ``_island``, the number of the run each belongs to."""
    w = Window.partitionBy(*keys).orderBy(*order)
    on = F.col("touch_start") & F.lag("touch_end").over(w) & F.lag(value).over(w).eqNullSafe(F.col(value))
    x = parts.withColumn("_new", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1))
    return x.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def in_blocks(df: DataFrame, keys: Sequence[str], ts: str, days: int = 1) -> DataFrame:
    """Adds ``_b``, the block of whole days, and hashes the rows by keys and block."""
    return df.withColumn("_b", floor_to(micros(ts), days * DAY_US)).repartition(*keys, "_b")


def _inside(keys: Sequence[str], ts: str):
    return Window.partitionBy(*keys, "_b").orderBy(ts)


def _carried(df: DataFrame, keys: Sequence[str], ends: Sequence[Column], carried: Sequence[Column]) -> DataFrame:
    """df joined to ``carried``: windows (over the source's blocks in order) of the blocks' ``ends``."""
    table = df.groupBy(*keys, "_b").agg(*ends).select(*keys, "_b", *carried)
    on = df["_b"].eqNullSafe(table["_b"])
    for c in keys:
        on = on & df[c].eqNullSafe(table[c])
    return df.join(table, on).drop(*[table[c] for c in (*keys, "_b")])


def previous_values(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``prev_<column>`` of the row before in the source's time order (null for the first) and ``has_prev``."""
    x = in_blocks(df, keys, ts)
    across = Window.partitionBy(*keys).orderBy("_b")
    item = F.struct(*columns)
    x = _carried(x, keys, [F.max_by(item, ts).alias("_last")], [F.lag("_last").over(across).alias("_before")])
    x = x.withColumn("_p", F.coalesce(F.lag(item).over(_inside(keys, ts)), F.col("_before")))
    return x.select(*df.columns, *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in columns], F.col("_p").isNotNull().alias("has_prev"))


def equal_run_lengths(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """keys, value, run_length: one row per run of successive equal values in time order, over block ends too. Nulls equal nulls."""
    x = in_blocks(df, keys, ts)
    w = _inside(keys, ts)
    i = F.row_number().over(w)
    new = (i == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    x = x.select(*keys, "_b", value, i.alias("_i"), new.cast("int").alias("_new"), F.count(F.lit(1)).over(Window.partitionBy(*keys, "_b")).alias("_n"))
    x = x.withColumn("_run", F.sum("_new").over(Window.partitionBy(*keys, "_b").orderBy("_i")))
    parts = x.groupBy(*keys, "_b", "_run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("_c"), (F.min("_i") == 1).alias("touch_start"), (F.max("_i") == F.max("_n")).alias("touch_end"))
    merged = _merged(parts, keys, ["_b", "_run"], value)
    return merged.groupBy(*keys, "_island").agg(F.first(value).alias(value), F.sum("_c").alias("run_length")).drop("_island")


def trailing_status(df: DataFrame, keys: Sequence[str], ts: str, reasons: Sequence[tuple[str, Column]], length: int = 256) -> DataFrame:
    """Adds ``context_status``: 'valid', 'short' for too few rows before, or the first reason (in order) that holds anywhere in the last ``length`` rows.

    A reason holds there if the position of the last row with it is less than ``length`` back.
    """
    names = [f"_r{i}" for i in range(len(reasons))]
    x = in_blocks(df.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, (_, c) in zip(names, reasons, strict=True)]), keys, ts)
    x = x.withColumn("_i", F.row_number().over(_inside(keys, ts)))
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col(n), F.col("_i"))).alias(f"{n}_last") for n in names]]
    table = x.groupBy(*keys, "_b").agg(*ends).withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0)))
    table = table.select(*keys, "_b", "_before", *[F.max(F.col("_before") + F.col(f"{n}_last")).over(across).alias(f"{n}_far") for n in names])
    x = x.join(table, [*keys, "_b"]).withColumn("_at", F.col("_before") + F.col("_i"))
    so_far = _inside(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    status = F.when(F.col("_at") < length, "short")
    for n, (name, _) in zip(names, reasons, strict=True):
        last = F.coalesce(F.max(F.when(F.col(n), F.col("_at"))).over(so_far), F.col(f"{n}_far"))
        status = status.when(F.col("_at") - last < length, name)
    return x.withColumn("context_status", status.otherwise("valid")).select(*df.columns, "context_status")


def as_of(rows: DataFrame, states: DataFrame, key: str, at: str, since: str, columns: Sequence[str], days: int = 30) -> DataFrame:
    """rows with the ``columns`` of the key's latest state at or before their time (null without one): a union sorted by time, not a join of all pairs.

    Of states of one time the largest in the order of ``columns`` is taken. Neither table may
    have a column named like one of ``columns`` in the other.
    """
    item = F.struct(F.col(since).alias("_t"), *[F.col(c) for c in columns])
    a = rows.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    b = states.where(F.col(since).isNotNull()).select(key, F.col(since).alias("_at"), F.lit(0).alias("_kind"), item.alias("_state"))
    x = in_blocks(a.unionByName(b, allowMissingColumns=True), [key], "_at", days)
    across = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    table = x.where("_b is not null").groupBy(key, "_b").agg(F.max("_state").alias("_top")).select(key, "_b", F.max("_top").over(across).alias("_before"))
    so_far = Window.partitionBy(key, "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_own", F.max("_state").over(so_far)).where("_kind = 1").join(table, [key, "_b"], "left")
    best = F.coalesce("_own", "_before")
    return x.select("_row.*", *[best[c].alias(c) for c in columns])
