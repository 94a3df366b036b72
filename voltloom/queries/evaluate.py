"""Day-ahead forecasts under an issue time, their evaluation, estimates against the truth, and appliance metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import CONNECTION_LIMIT_W, POWER_STAND_INS, canonical_id, measured
from voltloom.operators import dayahead, evaluation
from voltloom.operators.profile import event_days
from voltloom.operators.series import keep_last
from voltloom.operators.timegrid import resample_covered, slot_start
from voltloom.queries.common import GRID, HALF, POWERS, feeder, grid, half_hours, rounded
from voltloom.sources.tables import read


def _half_hours(spark: SparkSession, d: str) -> DataFrame:
    """feeder, slot, value, is_weekend: half-hour means of the event stream."""
    x = read(spark, d, "events").groupBy(slot_start("ts").alias("slot")).agg(F.avg("value").alias("value"))
    return x.select(F.lit("all").alias("feeder"), "slot", "value", (F.weekday("slot") >= 5).cast("int").alias("is_weekend"))


def _days(spark: SparkSession, d: str) -> DataFrame:
    return dayahead.daily_vectors(_half_hours(spark, d), "feeder", "slot", "value", ["is_weekend"])


def _sum(c):
    return F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)


def issued_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Half hours and what was known of them at 14:00 of the day before."""
    x = dayahead.issued_persistence(_half_hours(spark, d), ["feeder"], "slot", ["value"])
    return rounded(x.select("slot", "value", "forecast_value", dayahead.issue_time(F.to_date("slot")).alias("issued")))


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """The training matrix, one row a complete day: its size and the sums of its parts."""
    x = dayahead.training_matrix(_days(spark, d), "feeder", ["is_weekend"])
    part = lambda a: F.slice("features", a, 48)
    return x.select("day", F.size("features").alias("features"), _sum(part(1)).alias("recent"), _sum(part(49)).alias("lag2"), _sum(part(97)).alias("lag7"), _sum(part(145)).alias("mean"), (F.array_position(F.slice("features", 193, 7), 1.0) - 1).cast("int").alias("weekday"), F.element_at("features", -1).cast("int").alias("is_weekend"), _sum("target").alias("target"))


def eligible_windows(spark: SparkSession, d: str) -> DataFrame:
    """Days with seven days before them: half hours known in the context of 336 and the target of 48, and whether both are complete."""
    x = dayahead.forecast_windows(_days(spark, d), "feeder")
    known = lambda c: F.size(F.filter(c, lambda v: v.isNotNull()))
    return x.select("day", known("context").alias("context"), known("target").alias("target"), (F.col("context_complete") & F.col("target_complete")).alias("eligible"))


def alpha_errors(spark: SparkSession, d: str) -> DataFrame:
    """Validation error of ridge per alpha on a chronological split."""
    m = dayahead.training_matrix(_days(spark, d), "feeder", ["is_weekend"])
    _, errors = dayahead.select_alpha(m, F.lit("2024-01-19").cast("date"), F.lit("2024-01-24").cast("date"))
    return rounded(errors, 6)


def _walked(spark: SparkSession, d: str) -> DataFrame:
    m = dayahead.training_matrix(_days(spark, d), "feeder", ["is_weekend"])
    return dayahead.walk_forward(m, "feeder", ["2024-01-20", "2024-01-24", "2024-01-28"], alpha=100.0)


def walk_forward_errors(spark: SparkSession, d: str) -> DataFrame:
    """Ridge against persistence, refitted at each origin: errors per origin and method."""
    return rounded(dayahead.vector_errors(_walked(spark, d), ["origin", "method"]), 6)


def walk_forward_persistence(spark: SparkSession, d: str) -> DataFrame:
    """The persistence part of the walk-forward evaluation."""
    return walk_forward_errors(spark, d).where("method = 'persistence'").drop("method")


def held_out_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of the stream by whether a model's declared test range holds them."""
    x = read(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return x.select("day", evaluation.provenance(F.col("day"), "2024-01-20/2024-01-25").alias("provenance"))


def load_classes(spark: SparkSession, d: str) -> DataFrame:
    """Hours of the stream per class of load."""
    x = feeder(spark, d).select(evaluation.load_class(F.col("value"), F.lit(50.0)).alias("class"))
    return x.groupBy("class").agg(F.count(F.lit(1)).alias("hours"))


def covered_slots(spark: SparkSession, d: str) -> DataFrame:
    """Half hours per region in which every minute of all three powers was measured."""
    x = resample_covered(grid(spark, d), ["region_id"], "ts", POWERS)
    return x.groupBy("region_id").agg(F.count(F.lit(1)).alias("slots"), F.count_if(evaluation.fully_covered(*[f"{p}_coverage" for p in POWERS])).alias("covered"))


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots' stored segment medians as estimates of the households' own evening usage, which is the truth."""
    s = read(spark, d, "household_segments").where("snapshot_id is not null")
    known = F.col("usual_evening_kwh").between(0, 1e6)
    truth = s.where(known).select("snapshot_id", F.col("usual_evening_kwh").alias("true_kwh")).distinct()
    guess = s.select("snapshot_id", "segment", "as_of", "acceptance_rate", F.col("segment_median_evening_kwh").alias("estimated_kwh")).distinct()
    return evaluation.truth_join(guess, truth, ["snapshot_id"])


def estimate_errors_monthly(spark: SparkSession, d: str) -> DataFrame:
    x = _estimates(spark, d).withColumn("month", F.date_format("as_of", "yyyy-MM"))
    return rounded(evaluation.estimate_errors(x, ["month"], "estimated_kwh", "true_kwh"), 6)


def estimate_errors_overall(spark: SparkSession, d: str) -> DataFrame:
    x = _estimates(spark, d).withColumn("month", F.date_format("as_of", "yyyy-MM"))
    return rounded(evaluation.overall_errors(evaluation.estimate_errors(x, ["month"], "estimated_kwh", "true_kwh")), 6)


def segment_estimate_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.estimate_errors(_estimates(spark, d), ["segment"], "estimated_kwh", "true_kwh"), 6)


def segment_targeting_value(spark: SparkSession, d: str) -> DataFrame:
    """Evening usage of the snapshots of each segment whose household accepts at least half of its invitations."""
    return rounded(evaluation.targeting_value(_estimates(spark, d), "segment", F.nanvl("acceptance_rate", F.lit(None).cast("double")) >= 0.5, "true_kwh"), 6)


def counterfactual_half_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.counterfactual_totals(_estimates(spark, d), "as_of", "2025-03-01", "2025-09-01", "estimated_kwh", "true_kwh"), 6)


def segment_roster(spark: SparkSession, d: str) -> DataFrame:
    """Households of the latest snapshots per segment: how many, the most urgent priority, mean usage and load."""
    s = read(spark, d, "household_segments").withColumn("client_id", canonical_id("client_id")).where("client_id is not null and segment is not null")
    x = keep_last(s, ["client_id"], F.col("as_of"), F.col("snapshot_id"))
    return rounded(x.groupBy("segment").agg(F.count(F.lit(1)).alias("households"), F.min("dr_priority").alias("first_priority"), F.avg("annual_kwh").alias("annual_kwh"), F.avg("load_factor").alias("load_factor")), 6)


def appliance_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each appliance against fixed shares of the household's power: errors per appliance, home and stratum, from mergeable sums."""
    ok = lambda c: F.when((measured(c, POWER_STAND_INS) >= 0) & (c <= CONNECTION_LIMIT_W), c)
    shares = (("ac", 0.5), ("water_heater", 0.3), ("washing_machine", 0.2))
    parts = F.array(*[F.struct(F.lit(n).alias("appliance"), ok(F.get("targets_w", F.lit(i))).alias("actual"), (ok(F.col("aggregate_w")) * s).alias("guess")) for i, (n, s) in enumerate(shares)])
    x = read(spark, d, "partition_data").select("client_id", "timestamp", "dr_event", F.explode(parts).alias("p")).select("client_id", "timestamp", "dr_event", "p.*")
    strata = {"event": F.col("dr_event"), "summer": F.month("timestamp").between(6, 8), "evening": F.hour("timestamp").between(18, 21)}
    return rounded(evaluation.bucket_metrics(evaluation.appliance_buckets(x, "client_id", "timestamp", "appliance", "actual", "guess", strata)), 6)


def appliance_differences(spark: SparkSession, d: str) -> DataFrame:
    """How much better or worse the errors over all homes are in the evening than overall."""
    x = appliance_metrics(spark, d).where("home = 'ALL'")
    return rounded(evaluation.metric_differences(x, ["appliance"], "stratum", "overall", "evening", ["mae", "f1"]), 6)


def _asks(spark: SparkSession, d: str) -> DataFrame:
    who = half_hours(spark, d).select("client_id").distinct()
    dates = [F.struct(F.lit(i).alias("ask_id"), F.lit(t).cast("timestamp_ntz").alias("as_of"), F.lit(36).alias("from_slot"), F.lit(44).alias("to_slot")) for i, t in ((1, "2025-05-01"), (2, "2025-07-01"), (3, "2025-09-01"))]
    return who.select("client_id", F.explode(F.array(*dates)).alias("s")).select("client_id", "s.*")


def local_usual_evening(spark: SparkSession, d: str) -> DataFrame:
    """Evening energy over the latest 14 days with evening readings, at most 60 days back, event days left out."""
    touched = event_days(read(spark, d, "dr_events"), "start_ts", "end_ts")
    return rounded(evaluation.local_usual_window(half_hours(spark, d), _asks(spark, d), "client_id", "slot", "kw", touched))


def evening_lookback(spark: SparkSession, d: str) -> DataFrame:
    """Evening energy over the latest three evenings, at most ten days back."""
    x = half_hours(spark, d).where(F.hour("slot").between(18, 21)).groupBy("client_id", F.to_date("slot").alias("day")).agg((F.sum("kw") * 0.5).alias("kwh"))
    x = x.select("client_id", (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL '22' HOUR")).alias("ended"), "kwh")
    return rounded(evaluation.window_lookback(x, _asks(spark, d).select("client_id", "ask_id", "as_of"), "client_id"))


def shared_hot_days(spark: SparkSession, d: str) -> DataFrame:
    """Days on which every kind of event occurs at least twice and whose mean value is above 50."""
    x = read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("t"))
    return rounded(evaluation.hot_days(x, "event_type", "day", F.col("n") >= 2, "t", hot=50.0))


def chunked_means(spark: SparkSession, d: str) -> DataFrame:
    """A sequence model (the mean of eight readings) over each kind of event's series, in daily chunks that overlap."""
    import numpy as np

    def mean_of_eight(v):
        return np.convolve(v, np.ones(8) / 8)[: len(v)]

    x = evaluation.chunked_inference(read(spark, d, "events").withColumn("value", F.when(~F.isnan("value"), F.col("value"))), "event_type", "ts", "value", mean_of_eight, context=8)
    y = x.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("prediction").alias("answers"), F.round(F.sum("prediction"), 5).alias("total"))
    return y


def values_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means of three kinds of event side by side."""
    x = read(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("value").alias("value"))
    return rounded(evaluation.side_by_side(x, ["hour"], "event_type", "value", ["view", "click", "purchase"]))


QUERIES = {
    f.__name__: f
    for f in (
        issued_forecast, training_rows, eligible_windows, alpha_errors, walk_forward_errors, walk_forward_persistence, held_out_days, load_classes, covered_slots, estimate_errors_monthly, estimate_errors_overall,
        segment_estimate_errors, segment_targeting_value, counterfactual_half_year, segment_roster, appliance_metrics, appliance_differences, local_usual_evening, evening_lookback, shared_hot_days, chunked_means, values_side_by_side,
    )
}

_HH = "hh AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS slot, avg(value) AS v FROM events GROUP BY 1)"
_EARLY = "extract(hour FROM {t}) < 14"
_MATRIX = _HH + f""", h AS (SELECT *, CAST(slot AS DATE) AS day, {_EARLY.format(t="slot")} AS early FROM hh),
dy AS (SELECT day, count(*) AS n, sum(v) AS s, count(*) FILTER (WHERE early) AS ne, sum(v) FILTER (WHERE early) AS se FROM h GROUP BY 1),
m AS (SELECT t.day, t.n AS tn, t.s AS target, a.ne AS an, a.se AS ase, b.n AS bn, b.s AS lag2, b.n - b.ne AS bl, b.s - b.se AS bs, g.n AS gn, g.s AS lag7,
  (SELECT sum(n) FROM dy p WHERE p.day BETWEEN t.day - 8 AND t.day - 2) AS pn, (SELECT sum(s) FROM dy p WHERE p.day BETWEEN t.day - 8 AND t.day - 2) AS ps
  FROM dy t JOIN dy a ON a.day = t.day - 1 JOIN dy b ON b.day = t.day - 2 JOIN dy g ON g.day = t.day - 7),
tr AS (SELECT * FROM m WHERE tn = 48 AND an = 28 AND bn = 48 AND gn = 48 AND pn = 336)"""
_EST = """x AS (SELECT g.*, t.true_kwh FROM (SELECT DISTINCT snapshot_id, segment, as_of, acceptance_rate, segment_median_evening_kwh AS estimated_kwh FROM household_segments WHERE snapshot_id IS NOT NULL) g
JOIN (SELECT DISTINCT snapshot_id, usual_evening_kwh AS true_kwh FROM household_segments WHERE NOT isnan(usual_evening_kwh) AND usual_evening_kwh BETWEEN 0 AND 1e6) t USING (snapshot_id))"""
_ERR = "count(*) AS rows, round(sum(estimated_kwh), 6) AS estimated, round(sum(true_kwh), 6) AS true, round((sum(estimated_kwh) / nullif(sum(true_kwh), 0) - 1) * 100, 6) AS error_pct"
_OK = "CASE WHEN {c} BETWEEN 0 AND 100000 AND {c} NOT IN (-1.0, -999.0, 65535.0, 999999.0) THEN {c} END"
_LONG = " UNION ALL ".join(f"SELECT client_id, \"timestamp\" AS ts, dr_event, '{n}' AS appliance, {_OK.format(c=f'targets_w[{i + 1}]')} AS a, {_OK.format(c='aggregate_w')} * {s} AS p FROM partition_data" for i, (n, s) in enumerate((("ac", 0.5), ("water_heater", 0.3), ("washing_machine", 0.2))))
_BUCKETS = f"""l AS ({_LONG}),
s AS (SELECT client_id, date_trunc('hour', ts) AS h, appliance, a, p, unnest(list_filter(['overall', CASE WHEN dr_event THEN 'event' END, CASE WHEN month(ts) BETWEEN 6 AND 8 THEN 'summer' END, CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' END], lambda v: v IS NOT NULL)) AS stratum FROM l WHERE a IS NOT NULL AND p IS NOT NULL),
ho AS (SELECT appliance, client_id, stratum, h, count(*) AS n, sum(abs(p - a)) AS ae, sum(a) AS sa, sum(p) AS sp, count(*) FILTER (WHERE a >= 50 AND p >= 50) AS tp, count(*) FILTER (WHERE a < 50 AND p >= 50) AS fp, count(*) FILTER (WHERE a >= 50 AND p < 50) AS fn FROM s GROUP BY 1, 2, 3, 4),
b AS (SELECT appliance, unnest([client_id, 'ALL']) AS home, stratum, n, ae, sa, sp, tp, fp, fn, abs(sp - sa) / n AS hae FROM ho),
g AS (SELECT appliance, home, stratum, CAST(sum(n) AS BIGINT) AS "count", count(*) AS hours, round(sum(ae) / sum(n), 6) AS mae, round(abs(sum(sp) - sum(sa)) / nullif(sum(sa), 0) * 100, 6) AS energy_error_pct,
  round(CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0 END, 6) AS "precision", round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0 END, 6) AS f1, round(sum(hae) / count(*), 6) AS hourly_mae FROM b GROUP BY 1, 2, 3)"""
_ASKS = "asks AS (SELECT client_id, ask_id, as_of FROM (SELECT DISTINCT client_id FROM h), (VALUES (1, TIMESTAMP '2025-05-01'), (2, TIMESTAMP '2025-07-01'), (3, TIMESTAMP '2025-09-01')) v(ask_id, as_of))"
_CID = "upper(regexp_replace(client_id, '[^\\p{L}\\p{Nd}]', '', 'g'))"

SQL = {
    "issued_forecast": f"""WITH {_HH} SELECT a.slot, round(a.v, 9) AS value, round(b.v, 9) AS forecast_value, date_trunc('day', a.slot) - INTERVAL 10 HOUR AS issued
FROM hh a LEFT JOIN hh b ON b.slot = a.slot - CASE WHEN {_EARLY.format(t="a.slot")} THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END""",
    "training_rows": f"""WITH {_MATRIX} SELECT day, 202 AS features, round(ase + bs, 6) AS recent, round(lag2, 6) AS lag2, round(lag7, 6) AS lag7, round(ps / 7, 6) AS mean, CAST(isodow(day) - 1 AS INTEGER) AS weekday, CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend, round(target, 6) AS target FROM tr""",
    "eligible_windows": f"""WITH {_HH}, dy AS (SELECT CAST(slot AS DATE) AS day, count(*) AS n FROM hh GROUP BY 1), sp AS (SELECT CAST(unnest(generate_series(min(day) + 7, max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dy),
c AS (SELECT sp.day, CAST(coalesce((SELECT sum(n) FROM dy WHERE dy.day BETWEEN sp.day - 7 AND sp.day - 1), 0) AS INTEGER) AS context, CAST(coalesce((SELECT n FROM dy WHERE dy.day = sp.day), 0) AS INTEGER) AS target FROM sp)
SELECT day, context, target, context = 336 AND target = 48 AS eligible FROM c""",
    "walk_forward_persistence": f"""WITH {_MATRIX}, q AS (SELECT tr.day, CASE WHEN tr.day >= DATE '2024-01-28' THEN DATE '2024-01-28' WHEN tr.day >= DATE '2024-01-24' THEN DATE '2024-01-24' ELSE DATE '2024-01-20' END AS origin, a.v - b.v AS e
  FROM tr JOIN h a ON a.day = tr.day JOIN hh b ON b.slot = a.slot - CASE WHEN a.early THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END WHERE tr.day >= DATE '2024-01-20')
SELECT origin, count(DISTINCT day) AS days, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM q GROUP BY 1""",
    "held_out_days": "SELECT DISTINCT CAST(ts AS DATE) AS day, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-25' THEN 'held_out' ELSE 'retrospective' END AS provenance FROM events",
    "load_classes": "WITH f AS (SELECT date_trunc('hour', ts) AS h, round(avg(value), 6) AS v FROM events GROUP BY 1) SELECT CASE WHEN v < 50 THEN 'Normal' WHEN v < 55 THEN 'Warning' WHEN v IS NOT NULL THEN 'Critical' END AS class, count(*) AS hours FROM f GROUP BY 1",
    "covered_slots": f"""WITH {GRID}, a AS (SELECT region_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, least(count(households_consumption_kw), count(steg_production_kw), count(pv_production_kw)) AS n FROM g GROUP BY 1, 2),
sp AS (SELECT region_id, unnest(generate_series(min(slot), max(slot), INTERVAL 30 MINUTE)) AS slot FROM a GROUP BY 1) SELECT region_id, count(*) AS slots, count(*) FILTER (WHERE n >= 30) AS covered FROM sp LEFT JOIN a USING (region_id, slot) GROUP BY 1""",
    "estimate_errors_monthly": f"WITH {_EST} SELECT strftime(as_of, '%Y-%m') AS month, {_ERR} FROM x GROUP BY 1",
    "estimate_errors_overall": f"""WITH {_EST}, g AS (SELECT strftime(as_of, '%Y-%m') AS m, sum(estimated_kwh) AS e, sum(true_kwh) AS t FROM x GROUP BY 1)
SELECT count(*) AS groups, round(sum(e), 6) AS estimated, round(sum(t), 6) AS true, round((sum(e) / nullif(sum(t), 0) - 1) * 100, 6) AS error_pct, round(avg(abs(e - t)) / nullif(avg(abs(t)), 0) * 100, 6) AS mean_abs_error_pct FROM g""",
    "segment_estimate_errors": f"WITH {_EST} SELECT segment, {_ERR} FROM x GROUP BY 1",
    "segment_targeting_value": f"""WITH {_EST}, y AS (SELECT *, coalesce(NOT isnan(acceptance_rate) AND acceptance_rate >= 0.5, false) AS took FROM x)
SELECT segment, count(*) AS size, round(avg(CAST(took AS DOUBLE)), 6) AS acceptance, round(avg(true_kwh) FILTER (WHERE took), 6) AS mean_value, round(coalesce(sum(true_kwh) FILTER (WHERE took), 0), 6) AS total_value FROM y GROUP BY 1""",
    "counterfactual_half_year": f"WITH {_EST} SELECT count(*) AS rows, round(sum(estimated_kwh), 6) AS baseline, round(sum(true_kwh), 6) AS actual, round(sum(estimated_kwh - true_kwh), 6) AS saved FROM x WHERE as_of >= TIMESTAMP '2025-03-01' AND as_of < TIMESTAMP '2025-09-01'",
    "segment_roster": f"""WITH s AS (SELECT {_CID} AS c, * FROM household_segments WHERE segment IS NOT NULL), l AS (SELECT * FROM s WHERE c <> '' QUALIFY row_number() OVER (PARTITION BY c ORDER BY as_of DESC, snapshot_id DESC) = 1)
SELECT segment, count(*) AS households, min(dr_priority) AS first_priority, round(avg(annual_kwh), 6) AS annual_kwh, round(avg(load_factor), 6) AS load_factor FROM l GROUP BY 1""",
    "appliance_metrics": f"WITH {_BUCKETS} SELECT * FROM g",
    "appliance_differences": f"WITH {_BUCKETS} SELECT a.appliance, round(b.mae - a.mae, 6) AS mae_difference, round(b.f1 - a.f1, 6) AS f1_difference FROM g a JOIN g b ON a.appliance = b.appliance AND a.home = 'ALL' AND b.home = 'ALL' AND a.stratum = 'overall' AND b.stratum = 'evening'",
    "local_usual_evening": f"""WITH {HALF}, {_ASKS}, ev AS (SELECT DISTINCT CAST(unnest(generate_series(date_trunc('day', start_ts), date_trunc('day', end_ts), INTERVAL 1 DAY)) AS DATE) AS date FROM dr_events),
e AS (SELECT client_id, CAST(slot AS DATE) AS date, sum(kw) * 0.5 AS e FROM h WHERE hour(slot) BETWEEN 18 AND 21 AND CAST(slot AS DATE) NOT IN (SELECT date FROM ev) GROUP BY 1, 2),
n AS (SELECT ask_id, client_id, e.e, row_number() OVER (PARTITION BY ask_id, client_id ORDER BY date DESC) AS n FROM asks JOIN e USING (client_id) WHERE date >= CAST(as_of AS DATE) - 60 AND date < CAST(as_of AS DATE))
SELECT ask_id, client_id, round(avg(e), 9) AS usual_kwh, count(*) AS days FROM n WHERE n <= 14 GROUP BY 1, 2""",
    "evening_lookback": f"""WITH {HALF}, {_ASKS}, e AS (SELECT client_id, CAST(slot AS DATE) AS date, sum(kw) * 0.5 AS e FROM h WHERE hour(slot) BETWEEN 18 AND 21 GROUP BY 1, 2),
n AS (SELECT ask_id, client_id, e.e, row_number() OVER (PARTITION BY ask_id, client_id ORDER BY date DESC) AS n FROM asks JOIN e USING (client_id) WHERE date >= CAST(as_of AS DATE) - 10 AND date + INTERVAL 22 HOUR <= as_of)
SELECT ask_id, client_id, round(avg(e), 9) AS kwh, count(*) AS windows FROM n WHERE n <= 3 GROUP BY 1, 2""",
    "shared_hot_days": """WITH x AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS t FROM events GROUP BY 1, 2)
SELECT day, round(avg(t), 9) AS temperature FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE n >= 2) = (SELECT count(DISTINCT event_type) FROM events) AND avg(t) > 50""",
    "chunked_means": """WITH x AS (SELECT event_type, ts, avg(value) OVER w AS m, count(value) OVER w AS n, min(ts) OVER w AS first FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS 7 PRECEDING)),
y AS (SELECT event_type, CAST(ts AS DATE) AS day, CASE WHEN n = 8 AND first >= date_trunc('day', ts) - INTERVAL 1 DAY THEN m END AS p FROM x) SELECT event_type, day, count(p) AS answers, round(sum(p), 5) AS total FROM y GROUP BY 1, 2""",
    "values_side_by_side": """WITH x AS (SELECT date_trunc('hour', ts) AS hour, event_type, avg(value) AS v FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)
SELECT hour, round(max(v) FILTER (WHERE event_type = 'view'), 9) AS view, round(max(v) FILTER (WHERE event_type = 'click'), 9) AS click, round(max(v) FILTER (WHERE event_type = 'purchase'), 9) AS purchase FROM x GROUP BY 1""",
}
