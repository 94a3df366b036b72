"""Resampled layers and the aggregates read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import CONNECTION_LIMIT_W, POWER_STAND_INS, measured
from voltloom.operators.fill import forward_fill
from voltloom.operators.timegrid import calendar, deficit, densify, heatmap, kilowatts, resample, resample_covered, slot_start, supply_margin
from voltloom.queries.common import FLAGS, GRID, HALF, METERS, POWERS, grid, half_hours, meters, rounded
from voltloom.sources.tables import read


def half_hour_power(spark: SparkSession, d: str) -> DataFrame:
    x = half_hours(spark, d)
    return rounded(x.select("client_id", "slot", F.col("kw").alias("mean_kw"), (F.col("kw") * 0.5).alias("energy_kwh")))


def event_half_hours(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as meter readings: mean and energy per user and half hour."""
    x = read(spark, d, "events").groupBy(F.col("user_id").alias("client_id"), slot_start("ts").alias("slot")).agg((F.avg("value") / 1000).alias("mean_kw"))
    return rounded(x.withColumn("energy_kwh", F.col("mean_kw") * 0.5))


def operational_grid(spark: SparkSession, d: str) -> DataFrame:
    x = resample(grid(spark, d), ["region_id"], "ts", [*POWERS, "temperature_c"], FLAGS)
    return rounded(supply_margin(x.drop("temperature_c_energy_kwh"), "households_consumption_kw", "steg_production_kw", "pv_production_kw"))


def operational_household(spark: SparkSession, d: str) -> DataFrame:
    names = {"aggregate_power_w": "aggregate_kw", "ac_power_w": "ac_kw", "water_heater_power_w": "water_heater_kw", "washing_machine_power_w": "washing_machine_kw"}
    x = kilowatts(read(spark, d, "households_1min_c001_c025"), names)
    return rounded(resample(x, ["client_id"], "timestamp", list(names.values()), dense=False))


def causal_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample_covered(grid(spark, d), ["region_id"], "ts", [*POWERS, "temperature_c"], FLAGS))


def causal_household(spark: SparkSession, d: str) -> DataFrame:
    """Hourly household means kept where at least two of the sixty minutes are measured, as the export is thinned, then filled from the past."""
    x = resample_covered(meters(spark, d), ["client_id"], "ts", ["kw"], minutes=60, least=0.02)
    return rounded(x.withColumn("filled_kw", forward_fill(F.col("kw"), ["client_id"], "slot")))


def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    x = grid(spark, d).groupBy("region_id", slot_start("ts", 5).alias("slot")).agg(F.count(F.lit(1)).alias("readings"))
    return densify(x, ["region_id"], "slot", 5)


def community_summary(spark: SparkSession, d: str) -> DataFrame:
    x = supply_margin(grid(spark, d), "households_consumption_kw", "steg_production_kw", "pv_production_kw")
    return rounded(x.groupBy("region_id").agg((F.sum("households_consumption_kw") / 60).alias("energy_kwh"), F.avg("households_consumption_kw").alias("mean_kw"), F.max("households_consumption_kw").alias("peak_kw"), F.avg("margin_kw").alias("mean_margin_kw"), F.sum(deficit(F.col("margin_kw")) / 60).alias("shortage_kwh")))


def demand_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(heatmap(grid(spark, d), "ts", "households_consumption_kw"))


def usage_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(heatmap(meters(spark, d), "ts", "kw", ["client_id"]))


def peak_frequency(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).groupBy(F.hour("ts").alias("hour")).agg(F.sum("is_dr_peak").alias("peaks"), F.count("is_dr_peak").alias("labelled"))


def household_summary(spark: SparkSession, d: str) -> DataFrame:
    x = half_hours(spark, d).groupBy("client_id").agg((F.sum("kw") * 0.5).alias("energy_kwh"), F.avg("kw").alias("mean_kw"), F.max("kw").alias("peak_kw"))
    return rounded(x.withColumn("load_factor", F.when(F.col("peak_kw") > 0, F.col("mean_kw") / F.col("peak_kw")).otherwise(0.0)))


def daily_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(half_hours(spark, d).groupBy("client_id", F.to_date("slot").alias("day")).agg(F.coalesce(F.sum("kw") * 0.5, F.lit(0.0)).alias("energy_kwh")))


def monthly_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(half_hours(spark, d).groupBy("client_id", F.trunc("slot", "MM").alias("month")).agg((F.sum("kw") * 0.5).alias("energy_kwh"), F.count(F.lit(1)).alias("slots")))


def hourly_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mean and exact 95th percentile by hour of day."""
    return rounded(half_hours(spark, d).groupBy("client_id", F.hour("slot").alias("hour")).agg(F.avg("kw").alias("mean_kw"), F.percentile("kw", F.lit(0.95)).alias("p95_kw")))


def portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every household: energy, mean and peak of its possible readings, how many those are, and all its rows. Without any, the three values are null."""
    m = measured(F.col("aggregate_w"), POWER_STAND_INS)
    w = F.when((m >= 0) & (m <= CONNECTION_LIMIT_W), m)
    x = read(spark, d, "partition_data").select("client_id", w.alias("w"))
    return rounded(x.groupBy("client_id").agg((F.sum("w") / 60000).alias("energy_kwh"), (F.avg("w") / 1000).alias("mean_kw"), (F.max("w") / 1000).alias("peak_kw"), F.count("w").alias("valid"), F.count(F.lit(1)).alias("rows")))


def seasonal_energy(spark: SparkSession, d: str) -> DataFrame:
    x = calendar(half_hours(spark, d), "slot")
    return rounded(x.groupBy("season", "day_type", "slot_index").agg(F.avg("kw").alias("mean_kw"), F.avg("is_weekend").alias("weekend"), F.avg("month_sin").alias("month_sin"), F.count_distinct("date").alias("days")))


def flag_extent(spark: SparkSession, d: str) -> DataFrame:
    """Per region and day: whether any peak or event was flagged, and complete hours."""
    x = grid(spark, d).groupBy("region_id", F.to_date("ts").alias("day")).agg(F.max("is_dr_peak").alias("any_peak"), F.max("is_dr_event").alias("any_event"), F.count_distinct(F.when(F.col("households_consumption_kw").isNotNull(), F.hour("ts"))).alias("hours"))
    return x.withColumn("complete", F.col("hours") == 24)


def event_peak_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Readings by event and peak flag, all four cells present."""
    a = spark.createDataFrame([(e, p) for e in (0, 1) for p in (0, 1)], "is_dr_event int, is_dr_peak int")
    x = grid(spark, d).where("is_dr_event is not null and is_dr_peak is not null").groupBy("is_dr_event", "is_dr_peak").agg(F.count(F.lit(1)).alias("n"))
    return a.join(x, ["is_dr_event", "is_dr_peak"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def hourly_risk_rate(spark: SparkSession, d: str) -> DataFrame:
    x = grid(spark, d).groupBy(F.hour("ts").alias("hour")).agg(F.avg("households_consumption_kw").alias("mean_kw"), F.avg("is_dr_peak").alias("peak_rate"), F.avg("is_dr_event").alias("event_rate"))
    cut_off = x.agg(F.percentile("event_rate", F.lit(0.75)).alias("c"))
    return rounded(x.join(F.broadcast(cut_off), F.lit(True)).withColumn("risky", F.col("event_rate") >= F.col("c")).drop("c"))


QUERIES = {
    f.__name__: f
    for f in (
        half_hour_power, event_half_hours, operational_grid, operational_household, causal_grid, causal_household, dense_grid, community_summary, demand_heatmap, usage_heatmap, peak_frequency,
        household_summary, daily_energy, monthly_energy, hourly_profile, portfolio_summary, seasonal_energy, flag_extent, event_peak_crosstab, hourly_risk_rate,
    )
}

_SPINE = "s AS (SELECT region_id, unnest(generate_series(min(slot), max(slot), INTERVAL {n} MINUTE)) AS slot FROM a GROUP BY 1)"
_HEAT = ", ".join(f"round(avg(CASE WHEN hour(ts) = {h} THEN {{v}} END), 9) AS h{h:02d}" for h in range(24))
_MEANS = ", ".join(f"avg({c}) AS {c}" for c in (*POWERS, "temperature_c"))
_COVER = ", ".join(f"avg({c}) AS m_{c}, count({c}) AS n_{c}" for c in (*POWERS, "temperature_c")) + ", " + ", ".join(f"max({c}) AS {c}, count({c}) AS n_{c}" for c in FLAGS)
_COVERED = ", ".join(f"round(CASE WHEN n_{c} / 30 >= 0.8 THEN m_{c} END, 9) AS {c}, round(coalesce(n_{c}, 0) / 30, 9) AS {c}_coverage" for c in (*POWERS, "temperature_c")) + ", " + ", ".join(f"{c}, round(coalesce(n_{c}, 0) / 30, 9) AS {c}_coverage" for c in FLAGS)
_SEASON = "CASE WHEN month(slot) IN (12, 1, 2) THEN 'winter' WHEN month(slot) IN (3, 4, 5) THEN 'spring' WHEN month(slot) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"
_W = {"aggregate_power_w": "aggregate", "ac_power_w": "ac", "water_heater_power_w": "water_heater", "washing_machine_power_w": "washing_machine"}
_WMEAN = ", ".join(f"round(avg(CASE WHEN NOT isnan({w}) THEN {w} / 1000 END), 9) AS {n}_kw, round(avg(CASE WHEN NOT isnan({w}) THEN {w} / 1000 END) * 0.5, 9) AS {n}_energy_kwh" for w, n in _W.items())

SQL = {
    "half_hour_power": f"WITH {HALF} SELECT client_id, slot, round(kw, 9) AS mean_kw, round(kw * 0.5, 9) AS energy_kwh FROM h",
    "event_half_hours": "SELECT user_id AS client_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, round(avg(value) / 1000, 9) AS mean_kw, round(avg(value) / 1000 * 0.5, 9) AS energy_kwh FROM events GROUP BY 1, 2",
    "operational_grid": f"""WITH {GRID}, a AS (SELECT region_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, {_MEANS}, {", ".join(f"max({c}) AS {c}" for c in FLAGS)} FROM g GROUP BY 1, 2), {_SPINE.format(n=30)}
SELECT region_id, slot, {", ".join(f"round({c}, 9) AS {c}" for c in (*POWERS, "temperature_c"))}, {", ".join(FLAGS)}, {", ".join(f"round({c} * 0.5, 9) AS {c.removesuffix('_kw')}_energy_kwh" for c in POWERS)},
  round(steg_production_kw + pv_production_kw, 9) AS available_supply_kw, round(steg_production_kw + pv_production_kw - households_consumption_kw, 9) AS margin_kw FROM s LEFT JOIN a USING (region_id, slot)""",
    "operational_household": f'SELECT client_id, time_bucket(INTERVAL 30 MINUTE, "timestamp") AS slot, {_WMEAN} FROM households_1min_c001_c025 GROUP BY 1, 2',
    "causal_grid": f"WITH {GRID}, a AS (SELECT region_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, {_COVER} FROM g GROUP BY 1, 2), {_SPINE.format(n=30)} SELECT region_id, slot, {_COVERED} FROM s LEFT JOIN a USING (region_id, slot)",
    "causal_household": f"""WITH {METERS}, a AS (SELECT client_id AS region_id, date_trunc('hour', ts) AS slot, avg(kw) AS k, count(kw) AS n FROM m GROUP BY 1, 2), {_SPINE.format(n=60)},
x AS (SELECT region_id AS client_id, slot, CASE WHEN n / 60 >= 0.02 THEN k END AS kw, coalesce(n, 0) / 60 AS c FROM s LEFT JOIN a USING (region_id, slot))
SELECT client_id, slot, round(kw, 9) AS kw, round(c, 9) AS kw_coverage, round(last_value(kw IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY slot ROWS UNBOUNDED PRECEDING), 9) AS filled_kw FROM x""",
    "dense_grid": f"WITH {GRID}, a AS (SELECT region_id, time_bucket(INTERVAL 5 MINUTE, ts) AS slot, count(*) AS readings FROM g GROUP BY 1, 2), {_SPINE.format(n=5)} SELECT region_id, slot, readings FROM s LEFT JOIN a USING (region_id, slot)",
    "community_summary": f"""WITH {GRID}, x AS (SELECT *, steg_production_kw + pv_production_kw - households_consumption_kw AS margin FROM g)
SELECT region_id, round(sum(households_consumption_kw) / 60, 9) AS energy_kwh, round(avg(households_consumption_kw), 9) AS mean_kw, round(max(households_consumption_kw), 9) AS peak_kw, round(avg(margin), 9) AS mean_margin_kw,
  round(sum(CASE WHEN margin IS NOT NULL THEN greatest(-margin, 0) / 60 END), 9) AS shortage_kwh FROM x GROUP BY 1""",
    "demand_heatmap": f"WITH {GRID} SELECT CAST(ts AS DATE) AS date, {_HEAT.format(v='households_consumption_kw')} FROM g GROUP BY 1",
    "usage_heatmap": f"WITH {METERS} SELECT client_id, CAST(ts AS DATE) AS date, {_HEAT.format(v='kw')} FROM m GROUP BY 1, 2",
    "peak_frequency": "SELECT CAST(hour(\"timestamp\") AS INTEGER) AS hour, CAST(sum(is_dr_peak) AS BIGINT) AS peaks, count(is_dr_peak) AS labelled FROM grid_1min GROUP BY 1",
    "household_summary": f"WITH {HALF} SELECT client_id, round(sum(kw) * 0.5, 9) AS energy_kwh, round(avg(kw), 9) AS mean_kw, round(max(kw), 9) AS peak_kw, round(CASE WHEN max(kw) > 0 THEN avg(kw) / max(kw) ELSE 0 END, 9) AS load_factor FROM h GROUP BY 1",
    "daily_energy": f"WITH {HALF} SELECT client_id, CAST(slot AS DATE) AS day, round(coalesce(sum(kw) * 0.5, 0), 9) AS energy_kwh FROM h GROUP BY 1, 2",
    "monthly_energy": f"WITH {HALF} SELECT client_id, CAST(date_trunc('month', slot) AS DATE) AS month, round(sum(kw) * 0.5, 9) AS energy_kwh, count(*) AS slots FROM h GROUP BY 1, 2",
    "hourly_profile": f"WITH {HALF} SELECT client_id, CAST(hour(slot) AS INTEGER) AS hour, round(avg(kw), 9) AS mean_kw, round(quantile_cont(kw, 0.95), 9) AS p95_kw FROM h GROUP BY 1, 2",
    "portfolio_summary": """WITH x AS (SELECT client_id, CASE WHEN aggregate_w BETWEEN 0 AND 100000 AND aggregate_w NOT IN (-1.0, -999.0, 65535.0, 999999.0) THEN aggregate_w END AS w FROM partition_data)
SELECT client_id, round(sum(w) / 60000, 9) AS energy_kwh, round(avg(w) / 1000, 9) AS mean_kw, round(max(w) / 1000, 9) AS peak_kw, count(w) AS valid, count(*) AS "rows" FROM x GROUP BY 1""",
    "seasonal_energy": f"""WITH {HALF} SELECT {_SEASON} AS season, CASE WHEN isodow(slot) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, CAST(hour(slot) * 2 + minute(slot) // 30 AS INTEGER) AS slot_index,
  round(avg(kw), 9) AS mean_kw, round(avg(CASE WHEN isodow(slot) >= 6 THEN 1 ELSE 0 END), 9) AS weekend, round(avg(sin(2 * pi() * (month(slot) - 1) / 12)), 9) AS month_sin, count(DISTINCT CAST(slot AS DATE)) AS days FROM h GROUP BY 1, 2, 3""",
    "flag_extent": """SELECT region_id, CAST("timestamp" AS DATE) AS day, max(is_dr_peak) AS any_peak, max(is_dr_event) AS any_event, count(DISTINCT CASE WHEN households_consumption_kw IS NOT NULL THEN hour("timestamp") END) AS hours,
  count(DISTINCT CASE WHEN households_consumption_kw IS NOT NULL THEN hour("timestamp") END) = 24 AS complete FROM grid_1min GROUP BY 1, 2""",
    "event_peak_crosstab": "SELECT CAST(e AS INTEGER) AS is_dr_event, CAST(p AS INTEGER) AS is_dr_peak, (SELECT count(*) FROM grid_1min WHERE is_dr_event = e AND is_dr_peak = p) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(e, p)",
    "hourly_risk_rate": """WITH x AS (SELECT CAST(hour("timestamp") AS INTEGER) AS hour, avg(households_consumption_kw) AS mean_kw, avg(is_dr_peak) AS peak_rate, avg(is_dr_event) AS event_rate FROM grid_1min GROUP BY 1)
SELECT hour, round(mean_kw, 9) AS mean_kw, round(peak_rate, 9) AS peak_rate, round(event_rate, 9) AS event_rate, event_rate >= (SELECT quantile_cont(event_rate, 0.75) FROM x) AS risky FROM x""",
}
