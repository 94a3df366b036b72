"""Runs, fills, lags, rolling frames and quality masks along series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import POWER_STAND_INS, measured, micros
from voltloom.operators.fill import backward_fill, forward_fill, interpolations
from voltloom.operators.islands import risk_windows, run_windows, true_runs
from voltloom.operators.runs import equal_run_lengths, previous_values, trailing_status
from voltloom.operators.series import (
    centered_mean,
    clipped_difference,
    drop_repeated,
    dynamic_threshold,
    forward_hours,
    history_median,
    history_percentile,
    keep_last,
    lags,
    rank_quartile,
    rolling_before,
    seasonal_persistence,
    standardise_context,
)
from voltloom.operators.timegrid import day_type, densify, resample, slot_index, supply_margin
from voltloom.queries.common import DAILY, FEEDER, GRID, HALF, METERS, POWERS, daily, feeder, grid, half_hours, meters, one, rounded
from voltloom.sources.tables import read


def _partition(spark: SparkSession, d: str) -> DataFrame:
    """client_id, ts, w: one measured reading per household and time."""
    w = measured(F.col("aggregate_w"), POWER_STAND_INS)
    return read(spark, d, "partition_data").select("client_id", F.col("timestamp").alias("ts"), w.alias("w")).groupBy("client_id", "ts").agg(F.max("w").alias("w"))


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    """client_id, slot, kw: hourly means on a dense spine, nulls where nothing was read."""
    x = resample(meters(spark, d), ["client_id"], "ts", ["kw"], minutes=60, dense=False, energy=False)
    return densify(x, ["client_id"], "slot", 60)


def negative_margin_runs(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d).withColumn("all", F.lit(1))
    return rounded(risk_windows(x, ["all"], "day", "margin", minutes=1440).drop("all", "run"), 6)


def region_risk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Half-hour runs of shortfall per region."""
    x = resample(grid(spark, d), ["region_id"], "ts", list(POWERS), energy=False)
    x = supply_margin(x, "households_consumption_kw", "steg_production_kw", "pv_production_kw").withColumn("margin_kw", F.round(F.col("margin_kw") - 10, 6))
    return rounded(risk_windows(x, ["region_id"], "slot", "margin_kw").drop("run"))


def event_flag_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the event flag per household: half hours with any flagged reading."""
    x = read(spark, d, "partition_data").select("client_id", F.col("timestamp").alias("ts"), F.col("dr_event").cast("int").alias("dr_event")).where("client_id is not null")
    x = resample(x, ["client_id"], "ts", [], ["dr_event"], energy=False)
    return run_windows(x, ["client_id"], "slot", F.col("dr_event") == 1).drop("run")


def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    return run_windows(_hourly(spark, d), ["client_id"], "slot", F.col("kw").isNull(), 60).drop("run")


def frozen_runs(spark: SparkSession, d: str) -> DataFrame:
    """Readings in runs of at least 20 equal ones, and the longest run, per household."""
    x = equal_run_lengths(_partition(spark, d).where("w is not null"), ["client_id"], "ts", "w").where("run_length >= 20")
    return x.groupBy("client_id").agg(F.sum("run_length").alias("frozen_readings"), F.max("run_length").alias("longest"))


def time_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Readings that do not follow their predecessor by a minute, per household."""
    x = previous_values(_partition(spark, d).select("client_id", "ts"), ["client_id"], "ts", ["ts"])
    gap = F.col("has_prev") & (micros("ts") - micros("prev_ts") != 60_000_000)
    return x.groupBy("client_id").agg(F.count_if(gap).alias("gaps"), F.count(F.lit(1)).alias("readings"))


def clipped_diff(spark: SparkSession, d: str) -> DataFrame:
    x = half_hours(spark, d)
    return rounded(x.select("client_id", "slot", clipped_difference("kw", ["client_id"], "slot", 2.0, 2.0).alias("change")))


def quality_context(spark: SparkSession, d: str) -> DataFrame:
    """Readings per household and status of their trailing context of 64 readings."""
    x = read(spark, d, "partition_data").groupBy("client_id", F.col("timestamp").alias("ts")).agg(F.max(measured(F.col("aggregate_w"), POWER_STAND_INS)).alias("w"), F.max(F.coalesce("aggregate_imputed", F.lit(False))).alias("imputed"), F.max(F.coalesce("aggregate_spike", F.lit(False))).alias("spike"))
    y = trailing_status(x, ["client_id"], "ts", [("missing", F.col("w").isNull()), ("imputed", F.col("imputed")), ("spike", F.col("spike"))], 64)
    return y.groupBy("client_id", "context_status").agg(F.count(F.lit(1)).alias("readings"))


def lag_features(spark: SparkSession, d: str) -> DataFrame:
    return lags(feeder(spark, d).withColumn("all", F.lit(1)), ["all"], "ts", "value", [1, 24, 48, 168]).drop("all")


def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rolling_before(feeder(spark, d).withColumn("all", F.lit(1)), ["all"], "ts", "value", [24, 168]).drop("all"))


def centered_peak_label(spark: SparkSession, d: str) -> DataFrame:
    """Centred 15-reading means of demand and supply per region, and whether demand exceeds nine tenths of supply."""
    x = grid(spark, d).groupBy("region_id", "ts").agg(F.max("households_consumption_kw").alias("demand"), F.max(F.col("steg_production_kw") + F.col("pv_production_kw")).alias("supply"))
    x = x.select("region_id", "ts", F.round(centered_mean("demand", ["region_id"], "ts", 7, 7), 6).alias("demand"), F.round(centered_mean("supply", ["region_id"], "ts", 7, 7), 6).alias("supply"))
    return x.withColumn("peak", F.col("demand") > 0.9 * F.col("supply"))


def smoothed_daily(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d).select(one(), "day", "demand")
    return rounded(x.select("day", centered_mean("demand", ["all"], "day", 7, 6).alias("smooth")), 6)


def filled_series(spark: SparkSession, d: str) -> DataFrame:
    """Hourly household means filled forward, backward, linearly, and linearly for at most three hours."""
    x = _hourly(spark, d)
    x = x.withColumn("forward", forward_fill(F.col("kw"), ["client_id"], "slot")).withColumn("backward", backward_fill(F.col("kw"), ["client_id"], "slot"))
    return rounded(interpolations(x, ["client_id"], "slot", "kw", {"linear": (None, False), "linear_3": (3, False), "linear_short": (3, True)}))


def forward_durations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forward_hours(half_hours(spark, d).select("client_id", "slot"), ["client_id"], "slot"))


def persistence_7d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seasonal_persistence(half_hours(spark, d), ["client_id"], "slot", "kw", 7).where("predicted is not null"))


def history_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median of the same half hour over all days before, and over those of the same kind."""
    x = half_hours(spark, d).select("client_id", F.to_date("slot").alias("day"), slot_index(F.col("slot")).alias("slot_index"), day_type(F.col("slot")).alias("kind"), "kw")
    x = history_median(x, ["client_id"], "day", "slot_index", "kw").withColumnRenamed("history_median", "median_all")
    x = history_median(x, ["client_id"], "day", "slot_index", "kw", "kind").withColumnRenamed("history_median", "median_kind")
    return rounded(x.where("median_all is not null"))


def zscore_context(spark: SparkSession, d: str) -> DataFrame:
    x = standardise_context(feeder(spark, d).withColumn("all", F.lit(1)), ["all"], "ts", "value", 48)
    return rounded(x.where("z is not null").drop("all"))


def expanding_threshold(spark: SparkSession, d: str) -> DataFrame:
    x = feeder(spark, d).select(F.to_date("ts").alias("day"), "value")
    return rounded(history_percentile(x, "day", "value", 0.95))


def moving_threshold(spark: SparkSession, d: str) -> DataFrame:
    x = dynamic_threshold(feeder(spark, d).withColumn("all", F.lit(1)), ["all"], "ts", "value", 72, 1.5).drop("all")
    return rounded(x.where("threshold is not null"))


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Grid readings left per region: all, the last received of each time, and those whose time occurs once."""
    x = read(spark, d, "grid_1min").select("region_id", "timestamp", "received_at", "households_consumption_kw", "temperature_c")
    last = keep_last(x, ["region_id", "timestamp"], F.col("received_at"), F.col("households_consumption_kw"), F.col("temperature_c"))
    single = drop_repeated(x, ["region_id", "timestamp"])
    n = lambda y, c: y.groupBy("region_id").agg(F.count(F.lit(1)).alias(c))
    return n(x, "readings").join(n(last, "last"), "region_id").join(n(single, "single"), "region_id", "left").withColumn("single", F.coalesce("single", F.lit(0)))


def usage_quartiles(spark: SparkSession, d: str) -> DataFrame:
    x = half_hours(spark, d).groupBy("client_id").agg(F.round(F.sum("kw") * 0.5, 6).alias("energy_kwh"))
    return rank_quartile(x, [], "energy_kwh", "client_id", ["low", "medium", "high", "very high"], "typical")


def activity_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Appliance readings at or above 50 W, and changes between on and off, per household."""
    w = measured(F.get("targets_w", F.lit(0)), POWER_STAND_INS)
    x = read(spark, d, "partition_data").select("client_id", F.col("timestamp").alias("ts"), w.alias("w")).where("w is not null").groupBy("client_id", "ts").agg(F.max("w").alias("w"))
    x = x.withColumn("on", F.col("w") >= 50)
    x = previous_values(x, ["client_id"], "ts", ["on"]).withColumn("change", F.col("has_prev") & (F.col("on") != F.col("prev_on")))
    return x.groupBy("client_id").agg(F.count_if("on").alias("active"), F.count_if("change").alias("transitions"), F.count(F.lit(1)).alias("readings"))


def condition_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of half hours above 2 kW in row order."""
    x = true_runs(half_hours(spark, d), ["client_id"], "slot", F.col("kw") > 2)
    return rounded(x.groupBy("client_id", "run").agg(F.count(F.lit(1)).alias("slots"), F.min("slot").alias("start"), F.max("kw").alias("peak")))


QUERIES = {
    f.__name__: f
    for f in (
        negative_margin_runs, region_risk_windows, event_flag_windows, missing_runs, frozen_runs, time_gaps, clipped_diff, quality_context, lag_features, rolling_features, centered_peak_label, smoothed_daily,
        filled_series, forward_durations, persistence_7d, history_medians, zscore_context, expanding_threshold, moving_threshold, deduplicated, usage_quartiles, activity_transitions, condition_runs,
    )
}

_STAND = "(-1.0, -999.0, 65535.0, 999999.0)"
_P = f"p AS (SELECT client_id, \"timestamp\" AS ts, max(CASE WHEN NOT isnan(aggregate_w) AND aggregate_w NOT IN {_STAND} THEN aggregate_w END) AS w FROM partition_data GROUP BY 1, 2)"
_HOURLY = METERS + """, a AS (SELECT client_id, date_trunc('hour', ts) AS slot, avg(kw) AS kw FROM m GROUP BY 1, 2),
s AS (SELECT client_id, unnest(generate_series(min(slot), max(slot), INTERVAL 1 HOUR)) AS slot FROM a GROUP BY 1), h AS (SELECT client_id, slot, kw FROM s LEFT JOIN a USING (client_id, slot))"""
_RISK = """n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM v), o AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY t) AS run FROM n WHERE def > 0),
r AS (SELECT k, run, min(t) AS start, max(t) AS last, count(*) AS slots, max(def) AS mx, avg(def) AS mean_deficit, sum(def) AS sm FROM o GROUP BY 1, 2)
SELECT {key}start, last + INTERVAL {m} MINUTE AS "end", slots, slots * {m} AS duration_minutes, round(mx, {r}) AS max_deficit, (SELECT min(t) FROM o WHERE o.k = r.k AND o.run = r.run AND o.def = r.mx) AS deepest,
  round(mean_deficit, {r}) AS mean_deficit, round(sm * {h}, {r}) AS shortage_energy FROM r"""
_GRID30 = GRID + """, a AS (SELECT region_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, avg(households_consumption_kw) AS c, avg(steg_production_kw) AS s, avg(pv_production_kw) AS p, max(is_dr_event) AS e FROM g GROUP BY 1, 2),
sp AS (SELECT region_id, unnest(generate_series(min(slot), max(slot), INTERVAL 30 MINUTE)) AS slot FROM a GROUP BY 1), q AS (SELECT * FROM sp LEFT JOIN a USING (region_id, slot))"""
_RUNS = "n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM v), o AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY t) AS run FROM n WHERE c) SELECT k AS {key}, min(t) AS start, max(t) + INTERVAL {m} MINUTE AS \"end\", count(*) AS slots FROM o GROUP BY k, run"
_FULL = "CASE WHEN count(value) OVER {w} = {n} THEN {x} END"


def _roll(x: str, w: str, n: int) -> str:
    return f"round(CASE WHEN count(value) OVER {w} = {n} THEN {x} OVER {w} END, 9)"


SQL = {
    "negative_margin_runs": f"WITH {DAILY}, v AS (SELECT 1 AS k, day AS t, greatest(-margin, 0) AS def FROM d), {_RISK.format(key='', m=1440, h=24, r=6)}",
    "region_risk_windows": f"WITH {_GRID30}, v AS (SELECT region_id AS k, slot AS t, CASE WHEN s + p - c IS NOT NULL THEN greatest(-round(s + p - c - 10, 6), 0) END AS def FROM q), {_RISK.format(key='k AS region_id, ', m=30, h=0.5, r=9)}",
    "event_flag_windows": f"""WITH a AS (SELECT client_id, time_bucket(INTERVAL 30 MINUTE, "timestamp") AS slot, max(CAST(dr_event AS INT)) AS e FROM partition_data WHERE client_id IS NOT NULL GROUP BY 1, 2),
sp AS (SELECT client_id, unnest(generate_series(min(slot), max(slot), INTERVAL 30 MINUTE)) AS slot FROM a GROUP BY 1), q AS (SELECT * FROM sp LEFT JOIN a USING (client_id, slot)),
v AS (SELECT client_id AS k, slot AS t, coalesce(e = 1, false) AS c FROM q), {_RUNS.format(key='client_id', m=30)}""",
    "missing_runs": f"WITH {_HOURLY}, v AS (SELECT client_id AS k, slot AS t, kw IS NULL AS c FROM h), {_RUNS.format(key='client_id', m=60)}",
    "frozen_runs": f"""WITH {_P}, o AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts) - row_number() OVER (PARTITION BY client_id, w ORDER BY ts) AS g FROM p WHERE w IS NOT NULL),
c AS (SELECT client_id, count(*) OVER (PARTITION BY client_id, w, g) AS n FROM o) SELECT client_id, count(*) AS frozen_readings, max(n) AS longest FROM c WHERE n >= 20 GROUP BY 1""",
    "time_gaps": f"WITH {_P}, q AS (SELECT client_id, ts - lag(ts) OVER (PARTITION BY client_id ORDER BY ts) AS s FROM p) SELECT client_id, count(*) FILTER (WHERE s <> INTERVAL 60 SECOND) AS gaps, count(*) AS readings FROM q GROUP BY 1",
    "clipped_diff": f"WITH {HALF}, c AS (SELECT client_id, slot, least(kw, 2) AS x FROM h) SELECT client_id, slot, round(greatest(least(coalesce(x - lag(x) OVER (PARTITION BY client_id ORDER BY slot), 0), 2), -2) / 2, 9) AS change FROM c",
    "quality_context": f"""WITH x AS (SELECT client_id, "timestamp" AS ts, max(CASE WHEN NOT isnan(aggregate_w) AND aggregate_w NOT IN {_STAND} THEN aggregate_w END) AS w, max(CAST(coalesce(aggregate_imputed, false) AS INT)) AS imp, max(CAST(coalesce(aggregate_spike, false) AS INT)) AS spi FROM partition_data GROUP BY 1, 2),
y AS (SELECT client_id, CASE WHEN row_number() OVER (PARTITION BY client_id ORDER BY ts) < 64 THEN 'short' WHEN sum(CASE WHEN w IS NULL THEN 1 ELSE 0 END) OVER f > 0 THEN 'missing' WHEN sum(imp) OVER f > 0 THEN 'imputed' WHEN sum(spi) OVER f > 0 THEN 'spike' ELSE 'valid' END AS context_status
  FROM x WINDOW f AS (PARTITION BY client_id ORDER BY ts ROWS 63 PRECEDING)) SELECT client_id, context_status, count(*) AS readings FROM y GROUP BY 1, 2""",
    "lag_features": f"WITH {FEEDER} SELECT ts, value, {', '.join(f'lag(value, {k}) OVER (ORDER BY ts) AS lag_{k}' for k in (1, 24, 48, 168))} FROM f",
    "rolling_features": f"WITH {FEEDER} SELECT ts, value, {_roll('avg(value)', 'a', 24)} AS mean_24, {_roll('stddev_samp(value)', 'a', 24)} AS std_24, {_roll('avg(value)', 'b', 168)} AS mean_168, {_roll('stddev_samp(value)', 'b', 168)} AS std_168 FROM f WINDOW a AS (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), b AS (ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)",
    "centered_peak_label": """WITH x AS (SELECT region_id, "timestamp" AS ts, max(households_consumption_kw) AS dm, max(steg_production_kw + pv_production_kw) AS su FROM grid_1min GROUP BY 1, 2),
y AS (SELECT region_id, ts, round(avg(dm) OVER w, 6) AS demand, round(avg(su) OVER w, 6) AS supply FROM x WINDOW w AS (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) SELECT *, demand > 0.9 * supply AS peak FROM y""",
    "smoothed_daily": f"WITH {DAILY} SELECT day, round(avg(demand) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING), 6) AS smooth FROM d",
    "filled_series": f"""WITH {_HOURLY}, x AS (SELECT *, epoch(slot) AS t FROM h),
y AS (SELECT *, last_value(kw IGNORE NULLS) OVER b AS pv, first_value(kw IGNORE NULLS) OVER f AS nv, last_value(CASE WHEN kw IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, first_value(CASE WHEN kw IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt
  FROM x WINDOW b AS (PARTITION BY client_id ORDER BY slot ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY client_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (SELECT *, CASE WHEN kw IS NULL AND pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) END AS lin, (t - pt) / 3600 AS i, (nt - pt) / 3600 - 1 AS n FROM y)
SELECT client_id, slot, round(kw, 9) AS kw, round(pv, 9) AS forward, round(nv, 9) AS backward, round(coalesce(kw, lin), 9) AS linear, round(coalesce(kw, CASE WHEN i <= 3 THEN lin END), 9) AS linear_3, round(coalesce(kw, CASE WHEN n <= 3 THEN lin END), 9) AS linear_short FROM z""",
    "forward_durations": f"""WITH {HALF}, x AS (SELECT client_id, slot, epoch(lead(slot) OVER (PARTITION BY client_id ORDER BY slot) - slot) / 3600 AS s FROM h), md AS (SELECT client_id, quantile_cont(s, 0.5) AS mid FROM x GROUP BY 1)
SELECT client_id, slot, round(coalesce(s, mid), 9) AS hours FROM x JOIN md USING (client_id)""",
    "persistence_7d": f"WITH {HALF} SELECT a.client_id, a.slot, round(a.kw, 9) AS kw, round(b.kw, 9) AS predicted FROM h a JOIN h b ON a.client_id = b.client_id AND b.slot = a.slot - INTERVAL 7 DAY",
    "history_medians": f"""WITH {HALF}, x AS (SELECT client_id, CAST(slot AS DATE) AS day, CAST(hour(slot) * 2 + minute(slot) // 30 AS INTEGER) AS slot_index, CASE WHEN isodow(slot) >= 6 THEN 'weekend' ELSE 'weekday' END AS kind, kw FROM h),
y AS (SELECT a.client_id, a.day, a.slot_index, a.kind, any_value(a.kw) AS kw, quantile_cont(b.kw, 0.5) AS median_all, quantile_cont(b.kw, 0.5) FILTER (WHERE b.kind = a.kind) AS median_kind
  FROM x a JOIN x b ON a.client_id = b.client_id AND a.slot_index = b.slot_index AND b.day < a.day GROUP BY 1, 2, 3, 4)
SELECT client_id, day, slot_index, kind, round(kw, 9) AS kw, round(median_all, 9) AS median_all, round(median_kind, 9) AS median_kind FROM y""",
    "zscore_context": f"""WITH {FEEDER}, x AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS n FROM f WINDOW w AS (ORDER BY ts ROWS 47 PRECEDING))
SELECT ts, value, round(m, 9) AS context_mean, round(s, 9) AS context_std, round((value - m) / s, 9) AS z FROM x WHERE n = 48 AND s * s >= 1e-8""",
    "expanding_threshold": f"WITH {FEEDER}, x AS (SELECT CAST(ts AS DATE) AS day, value FROM f), y AS (SELECT DISTINCT day FROM x) SELECT y.day, round(quantile_cont(x.value, 0.95), 9) AS threshold, count(*) AS \"values\" FROM y JOIN x ON x.day < y.day GROUP BY 1",
    "moving_threshold": f"""WITH {FEEDER}, x AS (SELECT *, avg(value) OVER w + 1.5 * stddev_samp(value) OVER w AS t, count(value) OVER w AS n FROM f WINDOW w AS (ORDER BY ts ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING))
SELECT ts, value, round(t, 9) AS threshold, value > t AS above FROM x WHERE n = 72""",
    "deduplicated": """WITH c AS (SELECT region_id, "timestamp", count(*) AS n FROM grid_1min GROUP BY 1, 2) SELECT region_id, CAST(sum(n) AS BIGINT) AS readings, count(*) AS last, count(*) FILTER (WHERE n = 1) AS single FROM c GROUP BY 1""",
    "usage_quartiles": f"""WITH {HALF}, e AS (SELECT client_id, round(sum(kw) * 0.5, 6) AS energy_kwh FROM h GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY energy_kwh, client_id) AS r, count(*) OVER () AS c FROM e)
SELECT client_id, energy_kwh, ['low', 'medium', 'high', 'very high'][CAST(greatest(ceil((r - 1) * 4 / greatest(c - 1, 1)), 1) AS INT)] AS band FROM r""",
    "activity_transitions": f"""WITH x AS (SELECT client_id, "timestamp" AS ts, max(targets_w[1]) AS w FROM partition_data WHERE targets_w[1] IS NOT NULL AND NOT isnan(targets_w[1]) AND targets_w[1] NOT IN {_STAND} GROUP BY 1, 2),
y AS (SELECT client_id, w >= 50 AS o, lag(w >= 50) OVER (PARTITION BY client_id ORDER BY ts) AS p FROM x) SELECT client_id, count(*) FILTER (WHERE o) AS active, count(*) FILTER (WHERE o <> p) AS transitions, count(*) AS readings FROM y GROUP BY 1""",
    "condition_runs": f"""WITH {HALF}, n AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY slot) AS i FROM h), o AS (SELECT *, i - row_number() OVER (PARTITION BY client_id ORDER BY slot) AS g FROM n WHERE kw > 2),
r AS (SELECT client_id, g, count(*) AS slots, min(slot) AS start, max(kw) AS peak FROM o GROUP BY 1, 2) SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY start) AS run, slots, start, round(peak, 9) AS peak FROM r""",
}
