"""Unmeasured meter and weather values, filled from comparable records and marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.functions.columns import CONNECTION_LIMIT_W, POWER_STAND_INS, TEMPERATURE_STAND_INS, measured
from voltloom.operators.joins import lookup_join
from voltloom.operators.mixture import cells, fill_gaps, fit_cells, fit_mixture, with_level
from voltloom.session import cut

POWER_FIELDS = ("aggregate_w", "ac_power_w", "water_heater_power_w", "washing_machine_power_w")


def power_columns() -> list:
    """The four power fields of a partition row."""
    return [F.col("aggregate_w"), *[F.get("targets_w", F.lit(i)) for i in range(3)]]


def _usable(c):
    """The measured value where a household could have it, on the scale of the mixture."""
    return F.when((c >= 0) & (c <= CONNECTION_LIMIT_W), F.log1p(c))


def fill_power(readings: DataFrame, homes: DataFrame, *, components: int = 6) -> DataFrame:
    """source_key, ts, field, value: every value of ``readings`` that was not measured, with what it is filled with.

    Rows of one household and time are one record; it lacks a field if none of its rows
    holds a measured value of it. Appliance fields count for homes with a submeter only.
    The mixture sees the four powers (log scale), the household's usual level and the
    hour band. Defined cases: rows with a null id or time are ignored; a missing array
    lacks all three appliances; impossible readings are measured but lend nothing to the
    fit; a household unknown to ``homes`` has no submeter; empty tables give an empty result.
    """
    sub = homes.where("has_submeter and client_id is not null").select("client_id").distinct().withColumn("_sub", F.lit(True))
    cols = [measured(c, POWER_STAND_INS) for c in power_columns()]
    x = readings.select("client_id", F.col("timestamp").alias("ts"), *[c.alias(f"v{i}") for i, c in enumerate(cols)]).where("client_id is not null and ts is not null")
    numbers, widths = ["x0", "x1", "x2", "x3", "level"], [0.75, 1.5, 1.5, 1.5, 0.5]
    band = F.floor(F.hour("ts") / 4).cast("int")
    # one scan gives cells per household, which hold its level as well as the records of the fit
    usable = x.select("client_id", *[_usable(F.col(f"v{i}")).alias(f"x{i}") for i in range(4)], band.alias("band"))
    parts = cut(cells(usable, numbers[:4], widths[:4], ["band"], by=["client_id"]))
    level = cut(parts.groupBy("client_id").agg((F.sum(F.col("m0") * F.col("w")) / F.sum(F.when(F.col("m0").isNotNull(), F.col("w")))).alias("level")))
    model = fit_cells(with_level(lookup_join(parts, level, ["client_id"]), "level", 4, widths[4], 1), widths, [6], components=components)

    x = lookup_join(x, sub, ["client_id"]).withColumn("_sub", F.coalesce("_sub", F.lit(False)))
    bits = sum((F.when(F.col(f"v{i}").isNotNull(), 1 << i).otherwise(0) for i in range(4)), F.lit(0))
    need = F.when(F.col("_sub"), 15).otherwise(1)
    x = x.withColumn("have", bits.bitwiseAND(need)).withColumn("_open", F.col("have") != need)
    held = [F.when(F.col("_open"), F.col(f"v{i}")).alias(f"v{i}") for i in range(4)]
    rec = x.select("client_id", "ts", "have", need.alias("need"), *held).groupBy("client_id", "ts").agg(F.bit_or("have").alias("have"), F.max("need").alias("need"), *[F.max(f"v{i}").alias(f"v{i}") for i in range(4)])
    gaps = lookup_join(rec.where("have != need"), level, ["client_id"])
    gaps = gaps.select("client_id", "ts", F.col("need").bitwiseAND(F.bitwise_not("have")).alias("lost"), *[_usable(F.col(f"v{i}")).alias(f"x{i}") for i in range(4)], "level", band.alias("band"))
    filled = fill_gaps(gaps, model, numbers, ["band"])
    values = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(n).alias("field"), F.greatest(F.expm1(f"x{i}"), F.lit(0.0)).alias("value"), F.col(f"x{i}_filled").alias("filled")) for i, n in enumerate(POWER_FIELDS)])
    out = filled.select("client_id", "ts", "lost", F.explode(values).alias("f")).where(F.col("f.filled") & (F.col("lost").bitwiseAND(F.col("f.bit")) != 0))
    return out.select(F.col("client_id").alias("source_key"), "ts", "f.field", "f.value")


def fill_temperature(grid: DataFrame, *, components: int = 5) -> DataFrame:
    """source_key, ts, field, value: temperatures that were not measured, with what they are filled with.

    The mixture sees the temperature, the mean temperature of the same region and day,
    the feeder's load and sun power (log scale) and the hour band. Rows of one region and
    time are one record; the same cases are defined as for ``fill_power``.
    """
    t = measured(F.col("temperature_c"), TEMPERATURE_STAND_INS)
    loads = [measured(F.col(c)) for c in ("households_consumption_kw", "pv_production_kw")]
    x = grid.select("region_id", F.col("timestamp").alias("ts"), t.alias("v"), *[F.when((c >= 0) & (c < 1e9), F.log1p(c)).alias(n) for n, c in zip(("load", "sun"), loads, strict=True)])
    x = x.where("region_id is not null and ts is not null").withColumn("day", F.to_date("ts")).withColumn("band", F.floor(F.hour("ts") / 3).cast("int")).withColumn("temp", F.when(F.abs("v") < 100, F.col("v")))
    level = cut(x.groupBy("region_id", "day").agg(F.avg("temp").alias("level")))
    numbers, widths = ["temp", "level", "load", "sun"], [1.0, 1.0, 0.5, 1.0]
    model = fit_mixture(lookup_join(x, level, ["region_id", "day"]), numbers, widths, ["band"], [8], components=components)
    rec = x.groupBy("region_id", "ts").agg(F.max(F.col("v").isNotNull()).alias("known"), F.max("load").alias("load"), F.max("sun").alias("sun"), F.first("day").alias("day"), F.first("band").alias("band"))
    gaps = lookup_join(rec.where("not known"), level, ["region_id", "day"]).select("region_id", "ts", F.lit(None).cast("double").alias("temp"), "level", "load", "sun", "band")
    filled = fill_gaps(gaps, model, numbers, ["band"])
    return filled.select(F.col("region_id").alias("source_key"), "ts", F.lit("temperature_c").alias("field"), F.col("temp").alias("value"))


def fill_snapshots(snapshots: DataFrame, *, components: int = 6) -> DataFrame:
    """snapshot_id, segment, segment_imputed, usual_evening_kwh, evening_imputed: unknown segments and evening usage filled from similar snapshots.

    Similar by usage, peak, base load and evening share (log scale) and by segment. The
    segment, a category, is filled with its most likely name. Defined cases: repeated rows
    count once; without any named segment the segments stay null; NaN and infinite values
    are unknown; an empty table gives an empty result.
    """
    names = [r[0] for r in snapshots.where("segment is not null").select("segment").distinct().orderBy("segment").collect()]  # a row a segment
    known = lambda c: F.when(~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < 1e12), F.log1p(c))
    numbers = ["evening", "annual", "peak", "base", "share"]
    columns = ["usual_evening_kwh", "annual_kwh", "peak_kw", "base_load_kw", "evening_share"]
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("segment")) - 1 if names else F.lit(None)
    x = snapshots.select("snapshot_id", *[known(c).alias(n) for n, c in zip(numbers, columns, strict=True)], code.cast("int").alias("code")).distinct()
    cats, sizes = (["code"], [len(names)]) if names else ([], [])
    model = fit_mixture(x, numbers, [0.25, 0.25, 0.25, 0.05, 0.05], cats, sizes, components=components)
    open_ = F.col("evening").isNull() | (F.col("code").isNull() if names else F.lit(False))
    marks = [F.lit(False).alias(f"{c}_filled") for c in ("evening", *cats)]
    whole = x.where(~open_).select("snapshot_id", "evening", "code", *marks)
    filled = fill_gaps(x.where(open_), model, numbers, cats).select("snapshot_id", "evening", "code", *[f"{c}_filled" for c in ("evening", *cats)])
    y = whole.unionByName(filled)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("code") + 1) if names else F.lit(None).cast("string")
    return y.select(
        "snapshot_id", name.alias("segment"), (F.col("code_filled") if names else F.lit(False)).alias("segment_imputed"), F.greatest(F.expm1("evening"), F.lit(0.0)).alias("usual_evening_kwh"), F.col("evening_filled").alias("evening_imputed")
    )
