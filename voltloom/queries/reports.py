"""Reports: energy with coverage, latest values, picks, splits, transforms, ensembles, cross-table joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import POWER_STAND_INS, canonical_id, measured
from voltloom.operators.metrics import regression
from voltloom.operators.reports import append_missing, channel_transforms, chronological_split, ensemble, even_subset, hourly_energy, latest_values, ranked_picks, select_candidate, weekly_counts, zscores
from voltloom.operators.runs import as_of
from voltloom.operators.series import keep_last, seasonal_persistence
from voltloom.operators.timegrid import resample, supply_margin
from voltloom.queries.common import DAILY, GRID, HALF, POWERS, daily, grid, half_hours, meters, rounded
from voltloom.queries.joins import ANSWERS, EVENTS, HOMES, SNAPS, _answers, _homes, _one_event
from voltloom.queries.scoring import _STAND
from voltloom.sources.tables import read


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """client_id, ts, w, a0..a2: measured possible readings of the partition table."""
    ok = lambda c: F.when((c >= 0) & (c <= 100000), c)
    w = [ok(measured(c, POWER_STAND_INS)) for c in (F.col("aggregate_w"), *[F.get("targets_w", F.lit(i)) for i in range(3)])]
    return read(spark, d, "partition_data").select("client_id", F.col("timestamp").alias("ts"), *[c.alias(n) for c, n in zip(w, ("w", "a0", "a1", "a2"), strict=True)])


def hourly_energy_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hourly_energy(_readings(spark, d), ["client_id"], "ts", "w"))


def latest_readings(spark: SparkSession, d: str) -> DataFrame:
    """The last known value of the household and of each appliance."""
    x = _readings(spark, d).groupBy("client_id", "ts").agg(*[F.max(c).alias(c) for c in ("w", "a0", "a1", "a2")])
    return latest_values(x, ["client_id"], "ts", ["w", "a0", "a1", "a2"])


def readings_per_period(spark: SparkSession, d: str) -> DataFrame:
    """Exported readings by chronological split."""
    x = meters(spark, d).withColumn("part", chronological_split(F.to_date("ts"), "2025-06-16", "2025-09-01"))
    return rounded(x.groupBy("part").agg(F.count(F.lit(1)).alias("readings"), F.count_distinct("client_id").alias("households"), F.avg("kw").alias("mean_kw")))


def evenly_spaced_slots(spark: SparkSession, d: str) -> DataFrame:
    """Five half hours per household, evenly spaced over its series."""
    return even_subset(half_hours(spark, d).select("client_id", "slot"), ["client_id"], ["slot"], 5)


def best_and_worst_days(spark: SparkSession, d: str) -> DataFrame:
    """Each household's days of least, median and most energy."""
    x = half_hours(spark, d).groupBy("client_id", F.to_date("slot").alias("day")).agg(F.round(F.sum("kw") * 0.5, 6).alias("kwh"))
    return ranked_picks(x, ["client_id"], "kwh", "day")


def power_transforms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(channel_transforms(_readings(spark, d), {n: F.col(n) for n in ("w", "a0", "a1", "a2")}))


def standardised_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily demand and supply, each standardised within its year."""
    x = daily(spark, d).withColumn("year", F.year("day"))
    y = zscores(x, ["year"], "demand").withColumnRenamed("z", "demand_z")
    return rounded(zscores(y, ["year"], "supply").select("day", "demand_z", F.col("z").alias("supply_z")))


def ensemble_errors(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts from 7 and 14 days before and their weighted mean, with errors per method."""
    x = half_hours(spark, d)
    a = seasonal_persistence(x, ["client_id"], "slot", "kw", 7).withColumnRenamed("predicted", "p7")
    b = seasonal_persistence(x, ["client_id"], "slot", "kw", 14).select("client_id", "slot", F.col("predicted").alias("p14"))
    y = a.join(b, ["client_id", "slot"]).where("p7 is not null and p14 is not null").withColumn("mean", ensemble({"p7": 0.6, "p14": 0.4}))
    long = y.select("client_id", "kw", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("p")) for m in ("p7", "p14", "mean")])).alias("s")).select("client_id", "kw", "s.*")
    return rounded(regression(long, ["method"], "kw", "p"), 6)


def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    """Which of the other methods replaces the seven-day persistence."""
    x = ensemble_errors(spark, d).select("method", "rmse", "mae", F.col("mape").alias("wape"))
    return select_candidate(x, "method", "p7")


def weekly_events(spark: SparkSession, d: str) -> DataFrame:
    """Events each household answered per ISO week of their start."""
    x = _answers(spark, d).where("client_id is not null").join(_one_event(spark, d).select("event_id", "start_ts"), "event_id")
    return weekly_counts(x, ["client_id"], "start_ts", "event_id")


def targets_with_unlisted(spark: SparkSession, d: str) -> DataFrame:
    """Households of the latest snapshots by priority, those without a snapshot last."""
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "dr_priority").where("client_id is not null")
    x = keep_last(s, ["client_id"], F.col("as_of"), F.col("snapshot_id"))
    return append_missing(x.select("client_id", "dr_priority"), _homes(spark, d), "client_id", "dr_priority")


def appliance_event_readings(spark: SparkSession, d: str) -> DataFrame:
    """Three-table join: readings, their household and the region's minute, averaged per household."""
    r = _readings(spark, d).where("w is not null").withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    g = grid(spark, d).groupBy("region_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.avg("households_consumption_kw").alias("load"))
    x = r.join(_homes(spark, d).select("client_id", "region_id", "has_ac"), "client_id").join(g, ["region_id", "minute"], "left")
    return rounded(x.groupBy("client_id", "has_ac").agg(F.count(F.lit(1)).alias("readings"), F.count("load").alias("with_grid"), F.avg("w").alias("mean_w"), F.avg("load").alias("mean_load")))


def operator_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Per region: peak demand and its first slot, least margin, slots of shortfall and shortage energy."""
    x = supply_margin(resample(grid(spark, d), ["region_id"], "ts", list(POWERS), energy=False), *POWERS).withColumn("kw", F.round("households_consumption_kw", 6)).withColumn("m", F.round("margin_kw", 6))
    peak = x.groupBy("region_id").agg(F.max("kw").alias("peak_kw"))
    y = x.join(peak, "region_id")
    return rounded(y.groupBy("region_id", "peak_kw").agg(F.min(F.when(F.col("kw") == F.col("peak_kw"), F.col("slot"))).alias("peak_slot"), F.min("m").alias("least_margin"), F.count_if(F.col("m") < 0).alias("risk_slots"), F.coalesce(F.sum(F.when(F.col("m") < 0, -F.col("m"))) * 0.5, F.lit(0.0)).alias("shortage_kwh")))


def segment_response_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the segment the household had when it answered."""
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "segment").where("client_id is not null").distinct()
    a = _answers(spark, d).where("client_id is not null")
    x = as_of(a, s, "client_id", "recorded_at", "as_of", ["snapshot_id", "segment"]).where("snapshot_id is not null")
    return x.groupBy("segment").agg(*[F.count_if(F.col("response") == r).alias(r) for r in ("accept", "decline", "no_response")])


def peak_share_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """Share of evening energy by segment of the latest snapshot."""
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "segment").where("client_id is not null and segment is not null")
    seg = keep_last(s, ["client_id"], F.col("as_of"), F.col("snapshot_id")).select("client_id", "segment")
    x = half_hours(spark, d).where(F.hour("slot").between(18, 21)).join(seg, "client_id").groupBy("segment").agg(F.sum("kw").alias("kw"))
    total = x.agg(F.sum("kw").alias("t"))
    return rounded(x.join(F.broadcast(total), F.lit(True)).select("segment", (F.col("kw") / F.col("t")).alias("share")))


def completion_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Missing values of each grid channel per region, and half hours and days they touch."""
    x = grid(spark, d).withColumn("slot", F.date_trunc("hour", "ts")).withColumn("day", F.to_date("ts"))
    out = []
    for c in ("temperature_c", "households_consumption_kw", "pv_production_kw"):
        lost = F.col(c).isNull()
        out += [F.count_if(lost).alias(f"{c}_minutes"), F.count_distinct(F.when(lost, F.col("slot"))).alias(f"{c}_hours"), F.count_distinct(F.when(lost, F.col("day"))).alias(f"{c}_days")]
    return x.groupBy("region_id").agg(*out)


def largest_changes(spark: SparkSession, d: str) -> DataFrame:
    """The eight largest day-to-day changes of demand (a top-k report)."""
    from pyspark.sql import Window

    x = daily(spark, d).withColumn("all", F.lit(1))
    x = x.withColumn("change", F.round(F.abs(F.col("demand") - F.lag("demand").over(Window.partitionBy("all").orderBy("day"))), 2))
    return x.where("change is not null").orderBy(F.desc("change"), "day").limit(8).select("day", "change")


QUERIES = {
    f.__name__: f
    for f in (
        hourly_energy_rows, latest_readings, readings_per_period, evenly_spaced_slots, best_and_worst_days, power_transforms, standardised_daily, ensemble_errors, candidate_selection, weekly_events,
        targets_with_unlisted, appliance_event_readings, operator_kpis, segment_response_matrix, peak_share_by_segment, completion_evidence, largest_changes,
    )
}

_OK = lambda c: f"CASE WHEN NOT isnan({c}) AND {c} NOT IN {_STAND} AND {c} BETWEEN 0 AND 100000 THEN {c} END"
_READ = f'r AS (SELECT client_id, "timestamp" AS ts, {_OK("aggregate_w")} AS w, {_OK("targets_w[1]")} AS a0, {_OK("targets_w[2]")} AS a1, {_OK("targets_w[3]")} AS a2 FROM partition_data)'
_ENS = HALF + """, y AS (SELECT a.kw, b.kw AS p7, c.kw AS p14, b.kw * 0.6 + c.kw * 0.4 AS mean FROM h a JOIN h b ON a.client_id = b.client_id AND b.slot = a.slot - INTERVAL 7 DAY JOIN h c ON a.client_id = c.client_id AND c.slot = a.slot - INTERVAL 14 DAY),
l AS (SELECT 'p7' AS method, kw, p7 AS p FROM y UNION ALL SELECT 'p14', kw, p14 FROM y UNION ALL SELECT 'mean', kw, mean FROM y),
e AS (SELECT method, count(*) AS pairs, round(avg(abs(p - kw)), 6) AS mae, round(sqrt(avg((p - kw) * (p - kw))), 6) AS rmse, round(avg(CASE WHEN kw <> 0 THEN abs((p - kw) / kw) END) * 100, 6) AS mape, round(1 - sum((p - kw) * (p - kw)) / nullif(var_pop(kw) * count(*), 0), 6) AS r2 FROM l GROUP BY 1)"""
_SEG = "sg AS (SELECT nullif(upper(regexp_replace(client_id, '[^\\p{L}\\p{Nd}]', '', 'g')), '') AS client_id, as_of, snapshot_id, segment, dr_priority FROM household_segments{w} QUALIFY row_number() OVER (PARTITION BY nullif(upper(regexp_replace(client_id, '[^\\p{L}\\p{Nd}]', '', 'g')), '') ORDER BY as_of DESC, snapshot_id DESC) = 1)"
_LOST = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_minutes, count(DISTINCT CASE WHEN {c} IS NULL THEN date_trunc('hour', ts) END) AS {c}_hours, count(DISTINCT CASE WHEN {c} IS NULL THEN CAST(ts AS DATE) END) AS {c}_days" for c in ("temperature_c", "households_consumption_kw", "pv_production_kw"))
_METERS_ONLY = HALF.split(", h AS")[0]

SQL = {
    "hourly_energy_rows": f"WITH {_READ} SELECT client_id, date_trunc('hour', ts) AS hour, count(w) AS valid, round(count(w) / 60, 9) AS coverage, round(sum(w) / 60000, 9) AS energy_kwh FROM r GROUP BY 1, 2",
    "latest_readings": f"WITH {_READ}, x AS (SELECT client_id, ts, max(w) AS w, max(a0) AS a0, max(a1) AS a1, max(a2) AS a2 FROM r GROUP BY 1, 2) SELECT client_id, " + ", ".join(f"arg_max({c}, ts) AS last_{c}, max(ts) FILTER (WHERE {c} IS NOT NULL) AS last_{c}_at" for c in ("w", "a0", "a1", "a2")) + " FROM x GROUP BY 1",
    "readings_per_period": f"WITH {_METERS_ONLY} SELECT CASE WHEN CAST(ts AS DATE) < DATE '2025-06-16' THEN 'train' WHEN CAST(ts AS DATE) < DATE '2025-09-01' THEN 'validation' ELSE 'test' END AS part, count(*) AS readings, count(DISTINCT client_id) AS households, round(avg(kw), 9) AS mean_kw FROM m GROUP BY 1",
    "evenly_spaced_slots": f"""WITH {HALF}, x AS (SELECT client_id, slot, row_number() OVER (PARTITION BY client_id ORDER BY slot) - 1 AS i, count(*) OVER (PARTITION BY client_id) AS n FROM h)
SELECT client_id, slot FROM x WHERE n <= 5 OR i IN (0, (n - 1) // 4, (n - 1) * 2 // 4, (n - 1) * 3 // 4, n - 1)""",
    "best_and_worst_days": f"""WITH {HALF}, e AS (SELECT client_id, CAST(slot AS DATE) AS day, round(sum(kw) * 0.5, 6) AS kwh FROM h GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY kwh, day) - 1 AS i, count(*) OVER (PARTITION BY client_id) AS n FROM e)
SELECT client_id, day, kwh, 'best' AS pick FROM x WHERE i = 0 UNION ALL SELECT client_id, day, kwh, 'median' FROM x WHERE i = n // 2 UNION ALL SELECT client_id, day, kwh, 'worst' FROM x WHERE i = n - 1""",
    "power_transforms": f"WITH {_READ} " + " UNION ALL ".join(f"SELECT '{c}' AS channel, count({c}) AS known, round(quantile_cont({c}, 0.999), 9) AS cap, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS std, round(avg(CASE WHEN {c} >= 50 THEN 1 WHEN {c} < 50 THEN 0 END), 9) AS active FROM r" for c in ("w", "a0", "a1", "a2")),
    "standardised_daily": f"WITH {DAILY} SELECT day, round((demand - avg(demand) OVER y) / stddev_pop(demand) OVER y, 9) AS demand_z, round((supply - avg(supply) OVER y) / stddev_pop(supply) OVER y, 9) AS supply_z FROM d WINDOW y AS (PARTITION BY year(day))",
    "ensemble_errors": f"WITH {_ENS} SELECT * FROM e",
    "candidate_selection": f"WITH {_ENS} SELECT e.method, e.rmse, e.mae, e.mape AS wape, e.rmse <= 0.98 * b.rmse AND e.mae <= 0.98 * b.mae AND e.mape <= b.mape AS selected FROM e, (SELECT * FROM e WHERE method = 'p7') b WHERE e.method <> 'p7'",
    "weekly_events": f"WITH {EVENTS}, {ANSWERS} SELECT client_id, CAST(date_trunc('week', start_ts) AS DATE) AS week, count(DISTINCT a.event_id) AS \"distinct\" FROM a JOIN e ON a.event_id = e.event_id WHERE client_id IS NOT NULL GROUP BY 1, 2",
    "targets_with_unlisted": f"WITH {_SEG.replace('{w}', '')} SELECT client_id, dr_priority, true AS ranked FROM sg WHERE client_id IS NOT NULL UNION ALL SELECT DISTINCT client_id, CAST(NULL AS INTEGER), false FROM households_info WHERE client_id NOT IN (SELECT client_id FROM sg WHERE client_id IS NOT NULL)",
    "appliance_event_readings": f"""WITH {_READ}, {HOMES}, {GRID}, gm AS (SELECT region_id, date_trunc('minute', ts) AS minute, avg(households_consumption_kw) AS load FROM g GROUP BY 1, 2)
SELECT r.client_id, has_ac, count(*) AS readings, count(load) AS with_grid, round(avg(w), 9) AS mean_w, round(avg(load), 9) AS mean_load FROM r JOIN hi ON r.client_id = hi.client_id LEFT JOIN gm ON gm.region_id = hi.region_id AND gm.minute = date_trunc('minute', ts) WHERE w IS NOT NULL GROUP BY 1, 2""",
    "operator_kpis": f"""WITH {GRID}, x AS (SELECT region_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, round(avg(households_consumption_kw), 6) AS kw, round(avg(steg_production_kw) + avg(pv_production_kw) - avg(households_consumption_kw), 6) AS m FROM g GROUP BY 1, 2), p AS (SELECT region_id, max(kw) AS peak_kw FROM x GROUP BY 1)
SELECT region_id, peak_kw, min(slot) FILTER (WHERE kw = peak_kw) AS peak_slot, min(m) AS least_margin, count(*) FILTER (WHERE m < 0) AS risk_slots, round(coalesce(sum(-m) FILTER (WHERE m < 0) * 0.5, 0), 9) AS shortage_kwh FROM x JOIN p USING (region_id) GROUP BY 1, 2""",
    "segment_response_matrix": f"""WITH {ANSWERS}, {SNAPS}, x AS (SELECT a.response_id, response, segment FROM a JOIN (SELECT DISTINCT client_id, as_of, snapshot_id, segment FROM sn) s ON a.client_id = s.client_id WHERE as_of <= recorded_at
  QUALIFY row_number() OVER (PARTITION BY a.response_id ORDER BY as_of DESC, snapshot_id DESC, segment DESC NULLS LAST) = 1)
SELECT segment, count(*) FILTER (WHERE response = 'accept') AS accept, count(*) FILTER (WHERE response = 'decline') AS decline, count(*) FILTER (WHERE response = 'no_response') AS no_response FROM x GROUP BY 1""",
    "peak_share_by_segment": f"WITH {HALF}, {_SEG.replace('{w}', ' WHERE segment IS NOT NULL')}, x AS (SELECT segment, sum(kw) AS kw FROM h JOIN sg USING (client_id) WHERE hour(slot) BETWEEN 18 AND 21 GROUP BY 1) SELECT segment, round(kw / (SELECT sum(kw) FROM x), 9) AS share FROM x",
    "completion_evidence": f"WITH {GRID} SELECT region_id, {_LOST} FROM g GROUP BY 1",
    "largest_changes": f"WITH {DAILY}, x AS (SELECT day, round(abs(demand - lag(demand) OVER (ORDER BY day)), 2) AS change FROM d) SELECT day, change FROM x WHERE change IS NOT NULL ORDER BY change DESC, day LIMIT 8",
}
