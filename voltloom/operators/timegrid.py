"""Resampling of power series to regular slots: means, energy, coverage and dense spines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions.columns import MICROS, floor_to, from_micros, micros


def slot_start(ts: str | Column, minutes: int = 30) -> Column:
    """Start of the slot that contains the time."""
    return from_micros(floor_to(micros(ts), minutes * 60 * MICROS))


def kilowatts(df: DataFrame, channels: Mapping[str, str]) -> DataFrame:
    """Watt channels as kilowatts under new names; what is no number becomes null."""
    out = df
    for source, name in channels.items():
        v = F.col(source).try_cast("double")
        out = out.withColumn(name, F.nanvl(v, F.lit(None).cast("double")) / 1000)
    return out


def spine(df: DataFrame, keys: Sequence[str], slot: str, minutes: int) -> DataFrame:
    """Every slot of each key between its first and its last."""
    ends = df.groupBy(*keys).agg(F.min(slot).alias("_a"), F.max(slot).alias("_b"))
    step = F.expr(f"INTERVAL '{minutes}' MINUTE")
    return ends.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias(slot))


def densify(df: DataFrame, keys: Sequence[str], slot: str, minutes: int) -> DataFrame:
    """The table aligned to its spine: slots without a row get nulls."""
    return spine(df, keys, slot, minutes).join(df, [*keys, slot], "left")


def resample(
    df: DataFrame, keys: Sequence[str], ts: str, mean: Sequence[str] = (), most: Sequence[str] = (), *, minutes: int = 30, dense: bool = True, energy: bool = True
) -> DataFrame:
    """Mean power (and energy = mean times hours; power is never summed) and the largest flag per key and slot."""
    x = df.withColumn("slot", slot_start(ts, minutes))
    aggs = [F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in mean] + [F.max(c).alias(c) for c in most]
    y = x.groupBy(*keys, "slot").agg(*aggs)
    y = densify(y, keys, "slot", minutes) if dense else y
    if energy:
        y = y.select("*", *[(F.col(c) * (minutes / 60)).alias(f"{c.removesuffix('_kw')}_energy_kwh") for c in mean])
    return y


def resample_covered(df: DataFrame, keys: Sequence[str], ts: str, mean: Sequence[str], most: Sequence[str] = (), *, minutes: int = 30, least: float = 0.8) -> DataFrame:
    """Means kept only where at least ``least`` of the slot's minutes are measured; ``<c>_coverage`` beside each channel."""
    x = df.withColumn("slot", slot_start(ts, minutes))
    values = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in mean}
    aggs = [a for c, v in values.items() for a in (F.avg(v).alias(f"_m_{c}"), F.count(v).alias(f"_n_{c}"))]
    aggs += [a for c in most for a in (F.max(c).alias(c), F.count(c).alias(f"_n_{c}"))]
    y = densify(x.groupBy(*keys, "slot").agg(*aggs), keys, "slot", minutes)
    share = lambda c: F.coalesce(F.col(f"_n_{c}"), F.lit(0)) / minutes
    cols = [a for c in mean for a in (F.when(share(c) >= least, F.col(f"_m_{c}")).alias(c), share(c).alias(f"{c}_coverage"))]
    cols += [a for c in most for a in (F.col(c), share(c).alias(f"{c}_coverage"))]
    return y.select(*keys, "slot", *cols)


def supply_margin(df: DataFrame, demand: str, *supplies: str) -> DataFrame:
    """available_supply_kw and margin_kw; null where any part is null."""
    supply = sum((F.col(c) for c in supplies[1:]), F.col(supplies[0]))
    return df.withColumn("available_supply_kw", supply).withColumn("margin_kw", F.col("available_supply_kw") - F.col(demand))


def deficit(margin: Column, safety: float = 0.0) -> Column:
    """Shortfall below the safety margin, at least zero; null where the margin is null."""
    return F.when(margin.isNotNull(), F.greatest(-margin - safety, F.lit(0.0)))


def slot_index(ts: Column) -> Column:
    """0..47: the half hour of the day."""
    return F.hour(ts) * 2 + F.floor(F.minute(ts) / 30).cast("int")


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")


def day_type(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """date, hour, month, day_of_week (Monday 0), day_of_year, is_weekend, slot_index, season, day_type, cyclic month."""
    t = F.col(ts)
    angle = 2 * 3.141592653589793 * (F.month(t) - 1) / 12
    return df.select(
        "*", F.to_date(t).alias("date"), F.hour(t).alias("hour"), F.month(t).alias("month"), F.weekday(t).alias("day_of_week"), F.dayofyear(t).alias("day_of_year"),
        (F.weekday(t) >= 5).cast("int").alias("is_weekend"), slot_index(t).alias("slot_index"), season(t).alias("season"), day_type(t).alias("day_type"),
        F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"),
    )


def heatmap(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per date and hour, the hours as columns h00..h23."""
    hour = F.hour(ts)
    aggs = [F.avg(F.when(hour == h, F.col(value))).alias(f"h{h:02d}") for h in range(24)]
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*aggs)

