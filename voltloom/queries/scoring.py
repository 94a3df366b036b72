"""Forecast errors, labels, household profiles, savings, recommendations and small models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import POWER_STAND_INS, canonical_id, measured
from voltloom.functions.text import find_keyword
from voltloom.operators import models
from voltloom.operators.intervals import points_in
from voltloom.operators.metrics import adjusted_rand, confusion, forecast_errors, forecast_kpis, regression, rollups, stratified, top_slots_error
from voltloom.operators.profile import acceptance, comparison_text, group_median, household_features, month_position, ranked_reduction, savings, segment_profiles, top_share_capture, usual_window
from voltloom.operators.recommend import spaced_top, window_around_peak
from voltloom.operators.series import keep_last, lags, rolling_before, seasonal_persistence
from voltloom.operators.timegrid import resample, slot_index
from voltloom.queries.common import DAILY, FEEDER, GRID, HALF, METERS, daily, feeder, grid, half_hours, meters, rounded
from voltloom.queries.joins import ANSWERS, EVENTS, HOMES, SNAPS, _answers, _homes, _one_event, region_meters
from voltloom.sources.tables import read

# Fixed value: kilowatts above which an exported reading is a spike.
SPIKE_KW = 15.0


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """client_id, day, slot, kw, predicted: half hours with a reading seven days earlier."""
    x = seasonal_persistence(half_hours(spark, d), ["client_id"], "slot", "kw", 7).where("predicted is not null")
    return x.select("client_id", F.to_date("slot").alias("day"), "slot", F.round("kw", 9).alias("kw"), F.round("predicted", 9).alias("predicted"))


def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Seven-day persistence against the readings, one row per household."""
    return rounded(forecast_errors(_pairs(spark, d), ["client_id"], "slot", "kw", "predicted"), 6)


def forecast_daily_kpis(spark: SparkSession, d: str) -> DataFrame:
    x = half_hours(spark, d).withColumn("day", F.to_date("slot"))
    return rounded(forecast_kpis(x, ["client_id", "day"], "slot", "kw"))


def peak_label_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The peak flag against an evening rule, per region."""
    x = grid(spark, d).where("is_dr_peak is not null")
    return rounded(confusion(x, ["region_id"], F.col("is_dr_peak") == 1, F.hour("ts").between(18, 21)))


def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regression(_pairs(spark, d).withColumn("all", F.lit(1)), ["all"], "kw", "predicted").drop("all"), 6)


def peak_slot_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(top_slots_error(_pairs(spark, d), ["client_id"], "slot", "kw", "predicted", 6))


def metric_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Means by method, by household and method, by month and method, in one pass."""
    x = _pairs(spark, d)
    last = x.select("client_id", "day", F.lit("persistence").alias("method"), F.abs(F.col("predicted") - F.col("kw")).alias("error"))
    none = x.select("client_id", "day", F.lit("zero").alias("method"), F.abs("kw").alias("error"))
    y = last.unionByName(none).withColumn("month", F.month("day"))
    return rounded(rollups(y, [["method"], ["client_id", "method"], ["month", "method"]], ["error"]))


def stratified_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Air conditioner power against half of the household's power, by overlapping strata."""
    ac = measured(F.get("targets_w", F.lit(0)), POWER_STAND_INS)
    x = read(spark, d, "partition_data").select("client_id", F.col("timestamp").alias("ts"), ac.alias("ac"), (measured(F.col("aggregate_w"), POWER_STAND_INS) / 2).alias("guess"), "dr_event")
    x = x.where("abs(ac) < 1e300 and abs(guess) < 1e300")
    strata = [F.lit("all"), F.when(F.col("dr_event"), "event"), F.when(F.month("ts").between(6, 8), "summer"), F.when(F.hour("ts").between(18, 21), "evening")]
    return rounded(stratified(x, strata, "ac", "guess", 50.0), 6)


def profile_features(spark: SparkSession, d: str) -> DataFrame:
    """Yearly energy, peak, base load, load factor and evening share; cooling slope over days above 15 degrees.

    The export is thinned, so a day counts as full from 8 of its 48 half hours, and the slope needs 5 such days.
    """
    heat = grid(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("temperature_c"), 6).alias("t"))
    x = half_hours(spark, d).withColumn("day", F.to_date("slot")).join(heat, "day", "left")
    return rounded(household_features(x, "client_id", "slot", "kw", "t", least_slots=8, hot=15.0, least_days=5))


def acceptance_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(acceptance(_one_event(spark, d), _answers(spark, d).where("client_id is not null"), F.lit("2025-07-01 00:00:00").cast("timestamp_ntz")))


def usual_evening(spark: SparkSession, d: str) -> DataFrame:
    """Usual evening energy (18 to 22) and, past midnight, night energy (22 to 6) before two dates."""
    who = half_hours(spark, d).select("client_id").distinct()
    asks = who.select("client_id", F.explode(F.array(*[F.struct(F.lit(n).alias("ask_id"), F.lit(t).cast("timestamp_ntz").alias("as_of"), F.lit(a).alias("from_slot"), F.lit(b).alias("to_slot")) for n, t, a, b in ((1, "2025-05-01", 36, 44), (2, "2025-07-01", 36, 44), (3, "2025-07-01", 44, 12))])).alias("s")).select("client_id", "s.*")
    return rounded(usual_window(half_hours(spark, d), asks, "client_id", "slot", "kw").where("days is not null"))


def month_projection(spark: SparkSession, d: str) -> DataFrame:
    x = half_hours(spark, d).groupBy("client_id", F.to_date("slot").alias("day")).agg((F.sum("kw") * 0.5).alias("kwh"))
    parts = [month_position(x, "client_id", "day", "kwh", F.to_date(F.lit(t))).withColumn("as_of", F.to_date(F.lit(t))) for t in ("2025-05-02", "2025-06-16")]
    return rounded(parts[0].unionByName(parts[1]))


def evening_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Latest snapshot per household against the median of its segment."""
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "segment", "usual_evening_kwh").where("client_id is not null and segment is not null")
    x = keep_last(s, ["client_id"], F.col("as_of"), F.col("snapshot_id"))
    y = group_median(x, "segment", "usual_evening_kwh").select("client_id", "segment", "group_median", F.round("vs_group_pct", 6).alias("vs_group_pct"))
    return rounded(y.withColumn("compared", F.when(F.col("vs_group_pct").isNull(), "unknown").when(F.col("vs_group_pct") > 5, "above").when(F.col("vs_group_pct") < -5, "below").otherwise("same")).withColumn("empty", comparison_text(F.col("vs_group_pct")) == "").withColumn("says", F.regexp_replace(comparison_text(F.col("vs_group_pct")), "[0-9]+", "n")))


def segment_load_profiles(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "segment").where("client_id is not null and segment is not null")
    seg = keep_last(s, ["client_id"], F.col("as_of"), F.col("snapshot_id")).select("client_id", "segment")
    return rounded(segment_profiles(half_hours(spark, d), seg, "client_id", "slot", "kw"))


def event_savings(spark: SparkSession, d: str) -> DataFrame:
    """Ratio estimate of what accepters saved: the week from an event's day on against the week before it."""
    e = _one_event(spark, d).select("event_id", F.to_date("start_ts").alias("start"))
    daily = meters(spark, d).groupBy("client_id", F.to_date("ts").alias("day")).agg(F.avg("kw").alias("kwh"))
    seg = _homes(spark, d).select("client_id", F.when(F.col("has_ac"), "cooled").otherwise("other").alias("segment"))
    a = _answers(spark, d).where("client_id is not null and event_id is not null").groupBy("event_id", "client_id").agg(F.max("response").alias("response"))
    asked = a.join(e, "event_id").withColumn("day", F.explode(F.sequence(F.date_sub("start", 7), F.date_add("start", 6))))
    y = asked.join(daily, ["client_id", "day"]).groupBy("event_id", "client_id", "response").agg(F.avg(F.when(F.col("day") < F.col("start"), F.col("kwh"))).alias("pre_kwh"), F.avg(F.when(F.col("day") >= F.col("start"), F.col("kwh"))).alias("actual_kwh"))
    return rounded(savings(y.join(seg, "client_id")), 6)


def targeting_rank(spark: SparkSession, d: str) -> DataFrame:
    """Households of the latest month by priority and usage, with their cumulative expected reduction."""
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "dr_priority", "peak_kw").where("client_id is not null")
    x = keep_last(s, ["client_id"], F.col("as_of"), F.col("snapshot_id")).join(_homes(spark, d).select("client_id", "region_id"), "client_id")
    x = x.withColumn("expected", F.round(F.col("peak_kw") * 0.1, 6)).withColumn("need", F.lit(5.0))
    return rounded(ranked_reduction(x, ["region_id"], "dr_priority", "peak_kw", "expected", "need").select("region_id", "client_id", "rank", "cumulative"), 6)


def priority_capture(spark: SparkSession, d: str) -> DataFrame:
    """Share of peak power that the first half of each region's list holds."""
    x = targeting_rank(spark, d).join(keep_last(read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "peak_kw").where("client_id is not null"), ["client_id"], F.col("as_of"), F.col("snapshot_id")).select("client_id", "peak_kw"), "client_id")
    return rounded(top_share_capture(x, "region_id", "rank", "peak_kw"))


def recommended_windows(spark: SparkSession, d: str) -> DataFrame:
    """Up to two spaced days of shortfall per month, the largest first."""
    x = daily(spark, d).where("margin < 0").select(F.trunc("day", "MM").alias("month"), F.col("day").alias("start"), (F.col("day") + F.expr("INTERVAL '1' DAY")).alias("end"), F.round(-F.col("margin"), 2).alias("size"))
    return spaced_top(x, "month", "start", "end", "size", most=2, gap_minutes=1440)


def peak_windows(spark: SparkSession, d: str) -> DataFrame:
    """The seven days around each month's highest demand."""
    x = daily(spark, d).select(F.trunc("day", "MM").alias("month"), "day", "demand")
    return window_around_peak(x, ["month"], "day", "demand", 7)


def ridge_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Ridge on the lags of the hourly series, scored on itself."""
    x = lags(feeder(spark, d).withColumn("all", F.lit(1)), ["all"], "ts", "value", [1, 24, 168]).where("lag_168 is not null")
    model = models.ridge_fit(x, ["lag_1", "lag_24", "lag_168"], ["value"], 1.0)
    y = x.select("*", *models.ridge_predict(model))
    return rounded(regression(y, ["all"], "value", "predicted_value").drop("all"), 6)


def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by the nearest of ten label centroids."""
    x = read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    mean = x.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    rows = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).orderBy("label").collect()  # a row a label
    y = models.nearest_centroid(x, "v", [r["c"] for r in rows])
    return y.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("vectors"))


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of the snapshots' clusters and segments."""
    x = read(spark, d, "household_segments").where("segment is not null").select("snapshot_id", "cluster", "segment").distinct()
    return rounded(adjusted_rand(x, "cluster", "segment"))


def cluster_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """K-means over the latest snapshots' features: sizes and mean features per cluster."""
    features = ["annual_kwh", "peak_kw", "base_load_kw", "load_factor", "evening_share", "cooling_kwh_per_deg"]
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", *features).where("client_id is not null")
    _, y = models.kmeans(keep_last(s, ["client_id"], F.col("as_of"), F.col("snapshot_id")), features, 4)
    return y.groupBy("cluster").agg(F.count(F.lit(1)).alias("households"), *[F.avg(c).alias(c) for c in features])


def peak_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Random forest for the peak flag on a chronological split: areas under the ROC and precision-recall curves."""
    x = resample(grid(spark, d), ["region_id"], "ts", ["households_consumption_kw", "steg_production_kw", "pv_production_kw"], ["is_dr_peak"], energy=False).select("*", F.hour("slot").alias("hour"), F.month("slot").alias("month"))
    _, scores = models.random_forest(x, ["households_consumption_kw", "steg_production_kw", "pv_production_kw", "hour", "month"], "is_dr_peak", "slot", trees=10)
    return spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "measure string, value double")


def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hours above their moving level, scored by how many simple conditions hold."""
    x = rolling_before(feeder(spark, d).withColumn("all", F.lit(1)), ["all"], "ts", "value", [24]).where("mean_24 is not null")
    n = lambda c: F.when(c, 1).otherwise(0)
    s = n(F.col("value") > F.round("mean_24", 6)) * 2 + n(F.hour("ts").between(17, 21)) + n(F.weekday("ts") < 5)
    return x.select("ts", s.alias("score"), (s >= 3).alias("candidate"))


def event_window_energy(spark: SparkSession, d: str) -> DataFrame:
    """Household readings of the event's region inside each event: count, households and energy of the minutes read."""
    e = _one_event(spark, d).select("event_id", "region_id", F.col("start_ts").alias("start"), F.col("end_ts").alias("end"))
    x = points_in(region_meters(spark, d), "ts", e, ["region_id"])
    return rounded(x.groupBy("event_id").agg(F.count(F.lit(1)).alias("readings"), F.count_distinct("client_id").alias("households"), (F.sum("kw") / 60).alias("energy_kwh")))


def eligible_days(spark: SparkSession, d: str) -> DataFrame:
    """Region-days with at least 40 of 48 half hours measured, on a dense calendar."""
    x = resample(grid(spark, d), ["region_id"], "ts", ["households_consumption_kw"], energy=False)
    return x.groupBy("region_id", F.to_date("slot").alias("day")).agg(F.count("households_consumption_kw").alias("slots")).withColumn("eligible", F.col("slots") >= 40)


def daily_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The half hours of each region-day as one array, and its first and last measured position."""
    x = resample(grid(spark, d), ["region_id"], "ts", ["households_consumption_kw"], energy=False).where("households_consumption_kw is not null")
    v = F.sort_array(F.collect_list(F.struct(slot_index(F.col("slot")).alias("i"), F.round("households_consumption_kw", 6).alias("v"))))
    y = x.groupBy("region_id", F.to_date("slot").alias("day")).agg(v.alias("a"))
    return y.select("region_id", "day", F.size("a").alias("slots"), F.element_at("a", 1)["i"].alias("first_slot"), F.element_at("a", -1)["i"].alias("last_slot"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x["v"]), 9).alias("total"))


def text_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose normalised text mentions the meter, the bill or the tariff as whole words."""
    topic = find_keyword(F.col("text"), {t: [f" {t} "] for t in ("meter", "bill", "tariff")}, "other")
    return read(spark, d, "documents").groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("posts"))


def quarter_hours(spark: SparkSession, d: str) -> DataFrame:
    """Quarter-hour means per household, null where any of its readings is implausible or unmeasured."""
    w = measured(F.col("aggregate_w"), POWER_STAND_INS)
    x = read(spark, d, "partition_data").select("client_id", "timestamp", F.when((w >= 0) & (w <= 15000), w).alias("w"))
    from voltloom.operators.timegrid import slot_start

    y = x.groupBy("client_id", slot_start("timestamp", 15).alias("slot")).agg(F.avg("w").alias("m"), F.bool_and(F.col("w").isNotNull()).alias("ok"), F.count(F.lit(1)).alias("readings"))
    return rounded(y.select("client_id", "slot", "readings", F.when(F.col("ok"), F.col("m") / 1000).alias("mean_kw")))


def spike_mask(spark: SparkSession, d: str) -> DataFrame:
    """Readings above 15 kW removed and counted, mean of the rest."""
    kw = F.col("kw")
    return rounded(meters(spark, d).groupBy("client_id").agg(F.count_if(kw > SPIKE_KW).alias("removed"), F.avg(F.when(kw <= SPIKE_KW, kw)).alias("mean_kw")))


QUERIES = {
    f.__name__: f
    for f in (
        forecast_metrics, forecast_daily_kpis, peak_label_confusion, regression_metrics, peak_slot_error, metric_rollups, stratified_metrics, profile_features, acceptance_rates, usual_evening, month_projection,
        evening_comparison, segment_load_profiles, event_savings, targeting_rank, priority_capture, recommended_windows, peak_windows, ridge_forecast, nearest_label, label_agreement, cluster_snapshots,
        peak_classifier, risk_scores, event_window_energy, eligible_days, daily_vectors, text_lookup, quarter_hours, spike_mask,
    )
}

PAIRS = HALF + ", pr AS (SELECT a.client_id, CAST(a.slot AS DATE) AS day, a.slot, round(a.kw, 9) AS kw, round(b.kw, 9) AS predicted FROM h a JOIN h b ON a.client_id = b.client_id AND b.slot = a.slot - INTERVAL 7 DAY)"
_STAND = "(-1.0, -999.0, 65535.0, 999999.0)"
_LATEST = SNAPS.replace("SELECT DISTINCT", "SELECT") + ""
_SN = "sn AS (SELECT nullif(upper(regexp_replace(client_id, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')), '') AS client_id, as_of, snapshot_id, {c} FROM household_segments{w} QUALIFY row_number() OVER (PARTITION BY nullif(upper(regexp_replace(client_id, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')), '') ORDER BY as_of DESC, snapshot_id DESC) = 1)"
_SEASON = "CASE WHEN month({t}) IN (12, 1, 2) THEN 'winter' WHEN month({t}) IN (3, 4, 5) THEN 'spring' WHEN month({t}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"
_RANKED = f"""{HOMES}, {_SN.format(c="dr_priority, peak_kw", w="")}, x AS (SELECT region_id, client_id, dr_priority, peak_kw, round(peak_kw * 0.1, 6) AS expected FROM sn JOIN hi USING (client_id)),
rk AS (SELECT region_id, client_id, peak_kw, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(expected) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM x WINDOW w AS (PARTITION BY region_id ORDER BY dr_priority, peak_kw DESC, client_id))"""
_G30 = GRID + """, ga AS (SELECT region_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, avg(households_consumption_kw) AS kw FROM g GROUP BY 1, 2),
sp AS (SELECT region_id, unnest(generate_series(min(slot), max(slot), INTERVAL 30 MINUTE)) AS slot FROM ga GROUP BY 1), q AS (SELECT * FROM sp LEFT JOIN ga USING (region_id, slot))"""

SQL = {
    "recommended_windows": f"""WITH {DAILY}, x AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, day AS s, round(-margin, 2) AS size FROM d WHERE margin < 0), a AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY month ORDER BY size DESC, s) = 1),
b AS (SELECT x.* FROM x JOIN a ON x.month = a.month AND abs(date_diff('day', x.s, a.s)) >= 2 QUALIFY row_number() OVER (PARTITION BY x.month ORDER BY x.size DESC, x.s) = 1)
SELECT month, CAST(1 AS INTEGER) AS rank, s AS start, s + INTERVAL 1 DAY AS "end", size FROM a UNION ALL SELECT month, CAST(2 AS INTEGER), s, s + INTERVAL 1 DAY, size FROM b""",
    "nearest_label": """WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT label, i, avg(v[i]) AS c FROM x, range(1, 65) r(i) GROUP BY 1, 2), k AS (SELECT list(c ORDER BY i) AS c, row_number() OVER (ORDER BY label) - 1 AS cluster FROM m GROUP BY label),
d AS (SELECT vec_id, label, cluster FROM x, k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), cluster) = 1) SELECT label, CAST(cluster AS INTEGER) AS cluster, count(*) AS vectors FROM d GROUP BY 1, 2""",
    "text_lookup": """WITH x AS (SELECT ' ' || trim(regexp_replace(translate(lower(coalesce(text, '')), '’‘´`', repeat(chr(39), 4)), '[^\\p{L}\\p{M}\\p{Nd}'']+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT CASE WHEN contains(t, ' meter ') THEN 'meter' WHEN contains(t, ' bill ') THEN 'bill' WHEN contains(t, ' tariff ') THEN 'tariff' ELSE 'other' END AS topic, count(*) AS posts FROM x GROUP BY 1""",
    "forecast_metrics": f"""WITH {PAIRS}, i AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY slot) AS j FROM pr),
x AS (SELECT client_id, count(*) AS slots, avg(abs(predicted - kw)) AS mae, sqrt(avg((predicted - kw) * (predicted - kw))) AS rmse, sum(abs(predicted - kw)) AS ae, sum(abs(kw)) AS aa, sum(predicted - kw) * 0.5 AS eb, sum(kw) * 0.5 AS ea, max(kw) AS pa, max(predicted) AS pp FROM i GROUP BY 1),
t AS (SELECT i.client_id, min(j) FILTER (WHERE kw = pa) AS ja, min(j) FILTER (WHERE predicted = pp) AS jp FROM i JOIN x ON i.client_id = x.client_id GROUP BY 1)
SELECT client_id, slots, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(CASE WHEN aa > 0 THEN ae / aa * 100 END, 6) AS wape, round(eb, 6) AS energy_bias, round(abs(eb), 6) AS energy_error, round(CASE WHEN ea <> 0 THEN eb / ea * 100 END, 6) AS energy_error_pct,
  round(abs(pp - pa), 6) AS peak_error, round(pp - pa, 6) AS peak_bias, CAST(abs(jp - ja) * 30 AS INTEGER) AS peak_timing_error_minutes, CAST((jp - ja) * 30 AS INTEGER) AS peak_timing_bias_minutes FROM x JOIN t USING (client_id)""",
    "forecast_daily_kpis": f"""WITH {HALF}, x AS (SELECT client_id, CAST(slot AS DATE) AS day, slot, kw FROM h), p AS (SELECT client_id, day, round(sum(kw) * 0.5, 9) AS energy, max(kw) AS peak, round(avg(kw), 9) AS mean FROM x GROUP BY 1, 2)
SELECT client_id, day, energy, round(peak, 9) AS peak, (SELECT min(slot) FROM x WHERE x.client_id = p.client_id AND x.day = p.day AND x.kw = p.peak) AS peak_slot, mean FROM p""",
    "peak_label_confusion": """WITH x AS (SELECT region_id, is_dr_peak = 1 AS a, hour("timestamp") BETWEEN 18 AND 21 AS p FROM grid_1min WHERE is_dr_peak IS NOT NULL),
y AS (SELECT region_id, count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn, count(*) FILTER (WHERE NOT a AND NOT p) AS tn FROM x GROUP BY 1),
z AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM y)
SELECT region_id, tp, fp, fn, tn, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 9) AS f1 FROM z""",
    "regression_metrics": f"""WITH {PAIRS} SELECT count(*) AS pairs, round(avg(abs(predicted - kw)), 6) AS mae, round(sqrt(avg((predicted - kw) * (predicted - kw))), 6) AS rmse, round(avg(CASE WHEN kw <> 0 THEN abs((predicted - kw) / kw) END) * 100, 6) AS mape,
  round(1 - sum((predicted - kw) * (predicted - kw)) / nullif(var_pop(kw) * count(*), 0), 6) AS r2 FROM pr""",
    "peak_slot_error": f"WITH {PAIRS}, x AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY kw DESC, slot) <= 6) SELECT client_id, round(avg(abs(predicted - kw)), 9) AS peak_mae, round(sqrt(avg((predicted - kw) * (predicted - kw))), 9) AS peak_rmse FROM x GROUP BY 1",
    "metric_rollups": f"""WITH {PAIRS}, x AS (SELECT client_id, CAST(month(day) AS INTEGER) AS month, 'persistence' AS method, abs(predicted - kw) AS error FROM pr UNION ALL SELECT client_id, CAST(month(day) AS INTEGER), 'zero', abs(kw) FROM pr)
SELECT client_id, method, month, round(avg(error), 9) AS error, count(*) AS "rows" FROM x GROUP BY GROUPING SETS ((method), (client_id, method), (month, method))""",
    "stratified_metrics": f"""WITH x AS (SELECT "timestamp" AS ts, dr_event, CASE WHEN NOT isnan(targets_w[1]) AND targets_w[1] NOT IN {_STAND} THEN targets_w[1] END AS a, CASE WHEN NOT isnan(aggregate_w) AND aggregate_w NOT IN {_STAND} THEN aggregate_w / 2 END AS p FROM partition_data),
y AS (SELECT unnest(list_filter(['all', CASE WHEN dr_event THEN 'event' END, CASE WHEN month(ts) BETWEEN 6 AND 8 THEN 'summer' END, CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' END], lambda s: s IS NOT NULL)) AS stratum, a, p FROM x WHERE abs(a) < 1e300 AND abs(p) < 1e300),
z AS (SELECT stratum, count(*) AS "count", round(avg(abs(p - a)), 6) AS mae, round(sum(a), 6) AS actual_sum, round(sum(p), 6) AS predicted_sum, count(*) FILTER (WHERE a >= 50 AND p >= 50) AS tp, count(*) FILTER (WHERE a < 50 AND p >= 50) AS fp, count(*) FILTER (WHERE a >= 50 AND p < 50) AS fn FROM y GROUP BY 1)
SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM z""",
    "profile_features": f"""WITH {HALF}, {GRID}, t AS (SELECT CAST(ts AS DATE) AS day, round(avg(temperature_c), 6) AS t FROM g GROUP BY 1), x AS (SELECT h.*, CAST(slot AS DATE) AS day, t FROM h LEFT JOIN t ON t.day = CAST(slot AS DATE)),
dy AS (SELECT client_id, day, sum(kw) * 0.5 AS kwh, count(kw) AS n, avg(t) AS t FROM x GROUP BY 1, 2),
yr AS (SELECT client_id, avg(kwh) * 365 AS annual_kwh, count(*) AS days, CASE WHEN count(*) FILTER (WHERE t > 15) >= 5 THEN regr_slope(kwh, t) FILTER (WHERE t > 15) END AS cool, count(*) FILTER (WHERE t > 15) AS hot_days FROM dy WHERE n >= 8 GROUP BY 1),
sh AS (SELECT client_id, quantile_cont(kw, 0.99) AS peak_kw, quantile_cont(kw, 0.05) AS base_load_kw, avg(kw) AS m, sum(CASE WHEN hour(slot) BETWEEN 18 AND 21 THEN kw ELSE 0 END) / nullif(sum(kw), 0) AS evening_share FROM x GROUP BY 1)
SELECT client_id, round(peak_kw, 9) AS peak_kw, round(base_load_kw, 9) AS base_load_kw, round(evening_share, 9) AS evening_share, round(annual_kwh, 9) AS annual_kwh, days, round(cool, 9) AS cooling_kwh_per_deg, hot_days, round(CASE WHEN peak_kw > 0 THEN m / peak_kw END, 9) AS load_factor FROM sh LEFT JOIN yr USING (client_id)""",
    "acceptance_rates": f"WITH {EVENTS}, {ANSWERS} SELECT client_id, count(*) AS n_invitations, round(avg(CASE WHEN response = 'accept' THEN 1.0 ELSE 0.0 END), 9) AS acceptance_rate FROM a WHERE client_id IS NOT NULL AND event_id IN (SELECT event_id FROM e WHERE end_ts <= TIMESTAMP '2025-07-01') GROUP BY 1",
    "usual_evening": f"""WITH {HALF}, q(ask_id, as_of, f, t) AS (VALUES (1, DATE '2025-05-01', 36, 44), (2, DATE '2025-07-01', 36, 44), (3, DATE '2025-07-01', 44, 12)), x AS (SELECT client_id, CAST(slot AS DATE) AS day, hour(slot) * 2 + minute(slot) // 30 AS s, kw FROM h)
SELECT ask_id, client_id, round(sum(CASE WHEN (f <= t AND s >= f AND s < t) OR (f > t AND (s >= f OR s < t)) THEN kw ELSE 0 END) * 0.5 / count(DISTINCT day), 9) AS usual_kwh, count(DISTINCT day) AS days FROM x JOIN q ON day < as_of AND day >= as_of - 28 GROUP BY 1, 2""",
    "month_projection": f"""WITH {HALF}, x AS (SELECT client_id, CAST(slot AS DATE) AS day, sum(kw) * 0.5 AS kwh FROM h GROUP BY 1, 2), q AS (SELECT t AS as_of, CAST(date_trunc('month', t) AS DATE) AS f, t - CAST(date_trunc('month', t) AS DATE) AS el, day(last_day(t)) AS n FROM (VALUES (DATE '2025-05-02'), (DATE '2025-06-16')) v(t)),
y AS (SELECT client_id, as_of, el, n, coalesce(sum(kwh) FILTER (WHERE day >= f), 0) AS mtd, sum(kwh) FILTER (WHERE day >= as_of - 30) / 30 AS r FROM x JOIN q ON day < as_of AND day >= f - 30 GROUP BY 1, 2, 3, 4)
SELECT client_id, as_of, round(mtd, 9) AS month_to_date_kwh, round(CASE WHEN el < 3 THEN r * n ELSE mtd + mtd / el * (n - el) END, 9) AS projected_month_kwh FROM y""",
    "evening_comparison": f"""WITH {_SN.format(c="segment, CASE WHEN NOT isnan(usual_evening_kwh) THEN usual_evening_kwh END AS v", w=" WHERE segment IS NOT NULL")}, md AS (SELECT segment, quantile_cont(v, 0.5) AS m FROM sn WHERE client_id IS NOT NULL GROUP BY 1),
x AS (SELECT client_id, segment, m, round(CASE WHEN m > 0 THEN (v / m - 1) * 100 END, 6) AS p FROM sn JOIN md USING (segment) WHERE client_id IS NOT NULL)
SELECT client_id, segment, round(m, 9) AS group_median, p AS vs_group_pct, CASE WHEN p IS NULL THEN 'unknown' WHEN p > 5 THEN 'above' WHEN p < -5 THEN 'below' ELSE 'same' END AS compared, p IS NULL AS empty,
  CASE WHEN p IS NULL THEN '' WHEN abs(p) <= 5 THEN 'about the same as similar households' WHEN p > 0 THEN 'n% above similar households' ELSE 'n% below similar households' END AS says FROM x""",
    "segment_load_profiles": f"""WITH {HALF}, {_SN.format(c="segment", w=" WHERE segment IS NOT NULL")}, x AS (SELECT segment, slot, avg(kw) AS kw FROM h JOIN sn USING (client_id) GROUP BY 1, 2)
SELECT segment, {_SEASON.format(t="slot")} AS season, CASE WHEN isodow(slot) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, CAST(hour(slot) * 2 + minute(slot) // 30 AS INTEGER) AS slot_index, round(avg(kw), 9) AS mean_kw, count(*) AS slots FROM x GROUP BY 1, 2, 3, 4""",
    "event_savings": f"""WITH {EVENTS}, {ANSWERS}, {HOMES}, {METERS}, dy AS (SELECT client_id, CAST(ts AS DATE) AS day, avg(kw) AS kwh FROM m GROUP BY 1, 2),
r AS (SELECT event_id, client_id, max(response) AS response FROM a WHERE client_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT r.event_id, r.client_id, r.response, avg(kwh) FILTER (WHERE day < CAST(e.start_ts AS DATE)) AS pre, avg(kwh) FILTER (WHERE day >= CAST(e.start_ts AS DATE)) AS act
  FROM r JOIN e ON r.event_id = e.event_id JOIN dy ON dy.client_id = r.client_id AND day BETWEEN CAST(e.start_ts AS DATE) - 7 AND CAST(e.start_ts AS DATE) + 6 GROUP BY 1, 2, 3),
x AS (SELECT event_id, CASE WHEN has_ac THEN 'cooled' ELSE 'other' END AS segment, coalesce(response = 'accept', false) AS took, pre, act FROM w JOIN hi USING (client_id) WHERE pre IS NOT NULL AND act IS NOT NULL),
s AS (SELECT event_id, segment, count(*) FILTER (WHERE took) AS accepters, count(*) FILTER (WHERE NOT took) AS peers, sum(pre) FILTER (WHERE took) AS ap, sum(act) FILTER (WHERE took) AS aa, sum(pre) FILTER (WHERE NOT took) AS pp, sum(act) FILTER (WHERE NOT took) AS pa FROM x GROUP BY 1, 2),
v AS (SELECT event_id, sum(act) / nullif(sum(pre), 0) AS er FROM x WHERE NOT took GROUP BY 1)
SELECT s.event_id, segment, accepters, peers, CASE WHEN peers > 0 THEN 'segment' ELSE 'event_fallback' END AS source, round(coalesce(CASE WHEN peers > 0 THEN pa / nullif(pp, 0) END, er) * ap, 6) AS baseline_kwh, round(aa, 6) AS actual_kwh,
  round(coalesce(CASE WHEN peers > 0 THEN pa / nullif(pp, 0) END, er) * ap - aa, 6) AS saved_kwh FROM s LEFT JOIN v USING (event_id) WHERE accepters > 0""",
    "targeting_rank": f"WITH {_RANKED} SELECT region_id, client_id, rank, cumulative FROM rk",
    "priority_capture": f"WITH {_RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY region_id) AS c FROM rk) SELECT region_id, round(sum(peak_kw) FILTER (WHERE rank <= round_even(c * 0.5, 0)) / sum(peak_kw), 9) AS captured FROM n GROUP BY 1 HAVING sum(peak_kw) > 0",
    "peak_windows": f"""WITH {DAILY}, x AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, day, demand, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY date_trunc('month', day)) AS n FROM d WINDOW w AS (PARTITION BY date_trunc('month', day) ORDER BY day)),
p AS (SELECT month, i AS p FROM x QUALIFY row_number() OVER (PARTITION BY month ORDER BY demand DESC, i) = 1), y AS (SELECT x.*, greatest(least(p - 3, n - 7), 0) AS f FROM x JOIN p USING (month)) SELECT month, day, demand FROM y WHERE i >= f AND i < f + 7""",
    "label_agreement": """WITH x AS (SELECT DISTINCT snapshot_id, cluster, segment FROM household_segments WHERE segment IS NOT NULL), n AS (SELECT cluster, segment, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1, 2),
s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM n), r AS (SELECT sum(k * (k - 1) / 2) AS r FROM (SELECT sum(n) AS k FROM n GROUP BY cluster)), c AS (SELECT sum(k * (k - 1) / 2) AS c FROM (SELECT sum(n) AS k FROM n GROUP BY segment))
SELECT round((s - r * c / t) / ((r + c) / 2 - r * c / t), 9) AS ari FROM s, r, c""",
    "risk_scores": f"""WITH {FEEDER}, x AS (SELECT *, avg(value) OVER w AS m, count(value) OVER w AS n FROM f WINDOW w AS (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
y AS (SELECT ts, CAST(CASE WHEN value > round(m, 6) THEN 2 ELSE 0 END + CASE WHEN hour(ts) BETWEEN 17 AND 21 THEN 1 ELSE 0 END + CASE WHEN isodow(ts) <= 5 THEN 1 ELSE 0 END AS INTEGER) AS score FROM x WHERE n = 24) SELECT ts, score, score >= 3 AS candidate FROM y""",
    "event_window_energy": f"WITH {EVENTS}, {METERS}, {HOMES} SELECT event_id, count(*) AS readings, count(DISTINCT client_id) AS households, round(sum(kw) / 60, 9) AS energy_kwh FROM m JOIN hi USING (client_id) JOIN e ON hi.region_id = e.region_id AND ts >= start_ts AND ts < end_ts GROUP BY 1",
    "eligible_days": f"WITH {_G30} SELECT region_id, CAST(slot AS DATE) AS day, count(kw) AS slots, count(kw) >= 40 AS eligible FROM q GROUP BY 1, 2",
    "daily_vectors": f"WITH {_G30} SELECT region_id, CAST(slot AS DATE) AS day, CAST(count(*) AS INTEGER) AS slots, CAST(min(hour(slot) * 2 + minute(slot) // 30) AS INTEGER) AS first_slot, CAST(max(hour(slot) * 2 + minute(slot) // 30) AS INTEGER) AS last_slot, round(sum(round(kw, 6)), 9) AS total FROM q WHERE kw IS NOT NULL GROUP BY 1, 2",
    "quarter_hours": f"""WITH x AS (SELECT client_id, time_bucket(INTERVAL 15 MINUTE, "timestamp") AS slot, CASE WHEN NOT isnan(aggregate_w) AND aggregate_w NOT IN {_STAND} AND aggregate_w BETWEEN 0 AND 15000 THEN aggregate_w END AS w FROM partition_data)
SELECT client_id, slot, count(*) AS readings, round(CASE WHEN count(w) = count(*) THEN avg(w) / 1000 END, 9) AS mean_kw FROM x GROUP BY 1, 2""",
    "spike_mask": f"WITH {METERS} SELECT client_id, count(*) FILTER (WHERE kw > 15) AS removed, round(avg(CASE WHEN kw <= 15 THEN kw END), 9) AS mean_kw FROM m GROUP BY 1",
}
