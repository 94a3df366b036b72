"""Rolling totals over trailing periods.

Every daily total is exploded onto each output date it influences and summed by
entity and date. Each also brings the calendar rows from its day to the entity's
next one, which join the same groups, so that days without activity come out as
zeros and dates after the last day, which have no calendar row, not at all.

Scale: readings are scanned once and shrink to one row per entity and day on the
map side. Those daily rows are hashed by entity, where an entity has at most one
row a calendar day, so a hot entity is as small as any other; the exploded rows
are summed in the same partition and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(df: DataFrame, entity: Column, ts: str, value: Column, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and calendar day from its first to its last day with a measurement.

    Result: ``entity``, ``day``, ``readings``, ``total`` (of that day) and for each
    period n ``total_nd``, ``readings_nd``, ``active_days_nd``, ``avg_nd`` (mean a
    day, days without activity counting as zero) and ``avg_reading_nd`` (null where
    the period has no reading). A period is the day itself and the n - 1 before it.

    value: null where nothing was measured; NaN counts as null, zero as a measurement.
    Defined cases: rows with a null entity or time are ignored; repeated rows each
    count (drop them before where they must not); an entity without any measurement
    has no row; an empty table gives an empty result. Infinite values give infinite
    totals. Other columns are ignored.
    """
    longest = max(periods)
    x = df.select(entity.alias("entity"), F.to_date(F.col(ts)).alias("day"), value.cast("double").alias("v"))
    x = x.where(F.col("entity").isNotNull() & F.col("day").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    daily = x.groupBy("entity", "day").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("readings")).repartition("entity")

    following = F.lead("day").over(Window.partitionBy("entity").orderBy("day"))
    daily = daily.withColumn("until", F.coalesce(F.date_sub(following, 1), F.col("day")))
    reach = F.transform(F.sequence(F.col("day"), F.date_add("day", longest - 1)), lambda on: F.struct(on.alias("on"), F.datediff(on, "day").alias("age")))
    calendar = F.transform(F.sequence("day", "until"), lambda on: F.struct(on.alias("on"), F.lit(None).cast("int").alias("age")))
    spread = daily.select("entity", "total", "readings", F.explode(F.concat(reach, calendar)).alias("s")).select("entity", "total", "readings", "s.*")
    sums = []
    for n in periods:
        near = F.col("age") < n
        sums += [F.sum(F.when(near, F.col("total"))).alias(f"total_{n}d"), F.sum(F.when(near, F.col("readings"))).alias(f"readings_{n}d"), F.count(F.when(near, 1)).alias(f"active_days_{n}d")]
    own = F.col("age") == 0
    sums += [F.sum(F.when(own, F.col("total"))).alias("total"), F.sum(F.when(own, F.col("readings"))).alias("readings")]
    y = spread.groupBy("entity", F.col("on").alias("day")).agg(F.count_if(F.col("age").isNull()).alias("listed"), *sums).where("listed > 0")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind)
    out = ["entity", "day", zero("readings", "bigint").alias("readings"), zero("total", "double").alias("total")]
    for n in periods:
        out += [
            zero(f"total_{n}d", "double").alias(f"total_{n}d"),
            zero(f"readings_{n}d", "bigint").alias(f"readings_{n}d"),
            zero(f"active_days_{n}d", "bigint").alias(f"active_days_{n}d"),
            (zero(f"total_{n}d", "double") / n).alias(f"avg_{n}d"),
            F.when(F.col(f"readings_{n}d") > 0, F.col(f"total_{n}d") / F.col(f"readings_{n}d")).alias(f"avg_reading_{n}d"),
        ]
    return y.select(*out)
