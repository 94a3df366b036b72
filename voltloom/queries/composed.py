"""Composite plans and streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import canonical_id
from voltloom.operators.islands import risk_windows
from voltloom.operators.series import keep_last
from voltloom.plans.replay import compare_windows, day_ahead, household_profiles
from voltloom.queries.common import GRID, HALF, grid, half_hours, rounded
from voltloom.queries.scoring import _SN
from voltloom.session import prepare
from voltloom.sources.tables import read
from voltloom.streaming.power import drain, streaming_distinct, streaming_means

#: Kilowatts of margin that should remain.
RESERVE_KW = 60.0


def day_ahead_forecast(spark: SparkSession, d: str) -> DataFrame:
    y, _, _ = day_ahead(grid(spark, d))
    return rounded(y.where("forecast_margin_kw is not null").select("region_id", "slot", "actual_margin_kw", "forecast_margin_kw"), 6)


def day_ahead_recommended(spark: SparkSession, d: str) -> DataFrame:
    """At most two spaced windows a region and day in which the forecast margin is below the reserve."""
    return rounded(day_ahead(grid(spark, d), safety=-RESERVE_KW)[2], 6)


def day_ahead_matched(spark: SparkSession, d: str) -> DataFrame:
    """Measured shortfall windows and how much of each the forecast saw."""
    y, windows, _ = day_ahead(grid(spark, d), safety=-RESERVE_KW)
    actual = risk_windows(y, ["region_id", "day"], "slot", "actual_margin_kw", safety=-RESERVE_KW)
    return rounded(compare_windows(windows, actual).select("region_id", "actual_id", F.col("predicted_id").isNotNull().alias("seen"), "overlap_minutes"))


def profiles_by_segment(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "segment").where("client_id is not null and segment is not null")
    seg = keep_last(s, ["client_id"], F.col("as_of"), F.col("snapshot_id")).select("client_id", "segment")
    x = household_profiles(half_hours(spark, d), seg)
    return rounded(x.select("client_id", "segment", "annual_kwh", "group_median", "vs_group_pct"))


def stream_half_hours(spark: SparkSession, d: str) -> DataFrame:
    """Half-hour means of the event stream whose slots the watermark has closed."""
    path = f"{d}/events.parquet"
    prepare(spark)
    x = drain(spark, path, lambda s: streaming_means(s, "user_id", "ts", "value"))
    return rounded(x)


def stream_distinct_events(spark: SparkSession, d: str) -> DataFrame:
    """Events without repeats, from the stream."""
    path = f"{d}/events.parquet"
    prepare(spark)
    x = drain(spark, path, lambda s: streaming_distinct(s, ["event_id"], "ts", "60 days"))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


QUERIES = {f.__name__: f for f in (day_ahead_forecast, day_ahead_recommended, day_ahead_matched, profiles_by_segment, stream_half_hours, stream_distinct_events)}

_C = ("households_consumption_kw", "steg_production_kw", "pv_production_kw")
_COV = GRID + ", a AS (SELECT region_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, " + ", ".join(f"CASE WHEN count({c}) / 30 >= 0.8 THEN avg({c}) END AS {n}" for c, n in zip(_C, "csp", strict=True)) + " FROM g GROUP BY 1, 2)"
_DAY = _COV + """, z AS (SELECT region_id, unnest(generate_series(min(slot), max(slot), INTERVAL 30 MINUTE)) AS slot FROM a GROUP BY 1),
f AS (SELECT z.region_id, z.slot, CAST(z.slot AS DATE) AS day, x.s + x.p - x.c AS am, y.s + y.p - y.c AS fm FROM z LEFT JOIN a x USING (region_id, slot)
  LEFT JOIN a y ON y.region_id = z.region_id AND y.slot = z.slot - CASE WHEN hour(z.slot) < 14 THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END)"""


def _runs(margin: str, name: str) -> str:
    """Runs per region and day of half hours in which the margin is below the reserve: a, b, size."""
    return f"""{name}_n AS (SELECT region_id, slot, day, greatest(-{margin} + {RESERVE_KW}, 0) AS short, row_number() OVER (PARTITION BY region_id, day ORDER BY slot) AS i FROM f),
{name}_o AS (SELECT *, i - row_number() OVER (PARTITION BY region_id, day ORDER BY slot) AS run FROM {name}_n WHERE short > 0),
{name} AS (SELECT region_id, day, min(slot) AS a, max(slot) + INTERVAL 30 MINUTE AS b, sum(short) * 0.5 AS size FROM {name}_o GROUP BY region_id, day, run)"""


SQL = {
    "day_ahead_forecast": f"""WITH {_DAY} SELECT region_id, slot, round(am, 6) AS actual_margin_kw, round(fm, 6) AS forecast_margin_kw FROM f WHERE fm IS NOT NULL""",
    "day_ahead_recommended": f"""WITH {_DAY}, {_runs("fm", "fr")}, p AS (SELECT *, row_number() OVER (PARTITION BY region_id, day ORDER BY size DESC, a) AS n FROM fr),
q AS (SELECT *, 1 AS rank FROM p WHERE n = 1 UNION ALL SELECT * FROM (SELECT s.*, 2 AS rank FROM p s JOIN p o ON o.region_id = s.region_id AND o.day = s.day AND o.n = 1 AND s.n > 1 AND (s.a >= o.b + INTERVAL 1 HOUR OR o.a >= s.b + INTERVAL 1 HOUR) QUALIFY row_number() OVER (PARTITION BY s.region_id, s.day ORDER BY s.n) = 1))
SELECT region_id, day, rank, a AS start, b AS "end", round(size, 6) AS size FROM q""",
    "day_ahead_matched": f"""WITH {_DAY}, {_runs("fm", "fr")}, {_runs("am", "ar")}, o AS (SELECT x.region_id, x.a, max(epoch(least(x.b, y.b) - greatest(x.a, y.a)) / 60) AS mins FROM ar x JOIN fr y ON x.region_id = y.region_id AND x.a < y.b AND y.a < x.b GROUP BY 1, 2)
SELECT region_id, region_id || '|' || strftime(a, '%Y-%m-%d %H:%M:%S') AS actual_id, mins IS NOT NULL AS seen, round(coalesce(mins, 0), 6) AS overlap_minutes FROM ar LEFT JOIN o USING (region_id, a)""",
    "profiles_by_segment": f"""WITH {HALF}, {_SN.format(c="segment", w=" WHERE segment IS NOT NULL")}, dy AS (SELECT client_id, CAST(slot AS DATE) AS day, sum(kw) * 0.5 AS kwh, count(kw) AS n FROM h GROUP BY 1, 2),
yr AS (SELECT client_id, avg(kwh) * 365 AS annual_kwh FROM dy WHERE n >= 8 GROUP BY 1), x AS (SELECT client_id, segment, annual_kwh FROM sn JOIN (SELECT DISTINCT client_id FROM h) USING (client_id) LEFT JOIN yr USING (client_id)),
md AS (SELECT segment, quantile_cont(annual_kwh, 0.5) AS m FROM x GROUP BY 1)
SELECT client_id, segment, round(annual_kwh, 9) AS annual_kwh, round(m, 9) AS group_median, round(CASE WHEN m > 0 THEN (annual_kwh / m - 1) * 100 END, 9) AS vs_group_pct FROM x JOIN md USING (segment)""",
    "stream_half_hours": """WITH x AS (SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT user_id, slot, round(m, 9) AS mean, round(m * 0.5, 9) AS energy FROM x WHERE slot + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    "stream_distinct_events": "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1",
}
