"""Joins of events, answers, households and intervals; set operations and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import POWER_STAND_INS, canonical_id, measured, split_name
from voltloom.operators.intervals import best_overlap, mark, points_in
from voltloom.operators.islands import run_windows
from voltloom.operators.profile import event_days, natural_days
from voltloom.operators.runs import as_of
from voltloom.operators.series import keep_last
from voltloom.operators.timegrid import resample
from voltloom.queries.common import GRID, METERS, grid, meters, rounded
from voltloom.sources.tables import read

RESPONSES = ("accept", "decline", "no_response")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """One row per event and life span, repeats removed."""
    return read(spark, d, "dr_events").distinct()


def _one_event(spark: SparkSession, d: str) -> DataFrame:
    """The latest listing of each event."""
    return keep_last(read(spark, d, "dr_events"), ["event_id"], F.col("loaded_at"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct answers: response_id, event_id, client_id (usual form), response, recorded_at."""
    x = read(spark, d, "dr_participation").select("response_id", "event_id", canonical_id("client_id").alias("client_id"), "response", "recorded_at")
    return keep_last(x, ["response_id"], F.col("recorded_at"))


def _homes(spark: SparkSession, d: str) -> DataFrame:
    """The latest listing of each household."""
    return keep_last(read(spark, d, "households_info"), ["client_id"], F.col("registered_at"), F.col("closed_at"))


def response_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _answers(spark, d)
    return x.agg(*[F.count_if(F.col("response") == r).alias(r) for r in RESPONSES], F.count(F.lit(1)).alias("answers"))


def event_table(spark: SparkSession, d: str) -> DataFrame:
    """Events with their answers counted, zero where nobody was asked."""
    n = _answers(spark, d).where("event_id is not null").groupBy("event_id").agg(*[F.count_if(F.col("response") == r).alias(r) for r in RESPONSES], F.count(F.lit(1)).alias("invited"))
    x = _one_event(spark, d).join(n, "event_id", "left").na.fill(0, [*RESPONSES, "invited"])
    minutes = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 6e7
    return rounded(x.select("event_id", "region_id", "start_ts", minutes.alias("minutes"), *RESPONSES, "invited", (F.col("accept") * 100 / F.nullif(F.col("invited"), F.lit(0))).alias("accept_pct")))


def participation_history(spark: SparkSession, d: str) -> DataFrame:
    x = _answers(spark, d).where("client_id is not null").join(_one_event(spark, d).select("event_id", "start_ts", "surcharge_level"), "event_id", "left")
    return x.select("client_id", "event_id", "response", "start_ts", "surcharge_level")


def region_meters(spark: SparkSession, d: str) -> DataFrame:
    """Exported readings with the region of their household."""
    return meters(spark, d).join(_homes(spark, d).select("client_id", "region_id"), "client_id")


def padded_event_readings(spark: SparkSession, d: str) -> DataFrame:
    """Household readings of the event's region from two days before to two days after each event, both ends included."""
    pad = F.expr("INTERVAL '2' DAY")
    e = _one_event(spark, d).select("event_id", "region_id", (F.col("start_ts") - pad).alias("start"), (F.col("end_ts") + pad + F.expr("INTERVAL '0.000001' SECOND")).alias("end"))
    x = points_in(region_meters(spark, d), "ts", e, ["region_id"])
    return rounded(x.groupBy("event_id").agg(F.count(F.lit(1)).alias("readings"), F.avg("kw").alias("mean_kw")))


def household_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Households with their latest snapshot's segment, acceptance and defaults where unknown."""
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "segment", "acceptance_rate")
    last = keep_last(s.where("client_id is not null"), ["client_id"], F.col("as_of"), F.col("snapshot_id"))
    x = _homes(spark, d).select("client_id", "region_id", "has_ac").join(last.select("client_id", "segment", "acceptance_rate"), "client_id", "left")
    return rounded(x.withColumn("segment", F.coalesce("segment", F.lit("Unknown"))).withColumn("acceptance_rate", F.coalesce(F.nanvl("acceptance_rate", F.lit(None).cast("double")), F.lit(0.5))))


def as_of_latest(spark: SparkSession, d: str) -> DataFrame:
    """For each answer the household's latest snapshot at or before it."""
    s = read(spark, d, "household_segments").select(canonical_id("client_id").alias("client_id"), "as_of", "snapshot_id", "segment").where("client_id is not null").distinct()
    a = _answers(spark, d).where("client_id is not null").select("response_id", "client_id", "recorded_at")
    x = as_of(a, s, "client_id", "recorded_at", "as_of", ["snapshot_id", "segment"])
    return x.where("snapshot_id is not null").select("response_id", "snapshot_id", "segment")


def segment_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Share of households with each device, per segment."""
    x = household_enrichment(spark, d).select("client_id", "segment").join(_homes(spark, d), "client_id")
    flags = ("has_ac", "has_second_ac", "has_electric_water_heater", "has_washing_machine", "occupied_daytime", "has_submeter")
    return rounded(x.groupBy("segment").agg(F.count(F.lit(1)).alias("households"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags], F.avg("n_occupants").alias("occupants")))


def submeter_panel(spark: SparkSession, d: str) -> DataFrame:
    """Homes with a submeter and at least one reading of every appliance."""
    x = read(spark, d, "partition_data")
    v = [measured(F.get("targets_w", F.lit(i)), POWER_STAND_INS) for i in range(3)]
    n = x.groupBy("client_id").agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(v)]).where("n0 > 0 and n1 > 0 and n2 > 0")
    homes = read(spark, d, "households_info").where("has_submeter").select("client_id").distinct()
    return n.join(homes, "client_id", "left_semi")


def natural_day_energy(spark: SparkSession, d: str) -> DataFrame:
    """Region-days without any event of their own region, and their mean load."""
    days = _events(spark, d)
    x = grid(spark, d).withColumn("date", F.to_date("ts"))
    touched = event_days(days, "start_ts", "end_ts", keys=["region_id"])
    return rounded(natural_days(x, "date", touched, ["region_id"]).groupBy("region_id", "date").agg(F.avg("households_consumption_kw").alias("mean_kw")))


def intervention_days(spark: SparkSession, d: str) -> DataFrame:
    return event_days(_events(spark, d), "start_ts", "end_ts")


def marked_windows(spark: SparkSession, d: str) -> DataFrame:
    """Half-hour slots of the grid by whether an event of the region covers them."""
    x = resample(grid(spark, d), ["region_id"], "ts", ["households_consumption_kw"], energy=False)
    y = mark(x, "slot", _events(spark, d).select("region_id", F.col("start_ts").alias("start"), F.col("end_ts").alias("end")), ["region_id"])
    return rounded(y.groupBy("region_id", "inside").agg(F.count(F.lit(1)).alias("slots"), F.avg("households_consumption_kw").alias("mean_kw")))


def overlap_match(spark: SparkSession, d: str) -> DataFrame:
    """Listed events against the windows in which the grid flags one: best overlap per event."""
    x = resample(grid(spark, d), ["region_id"], "ts", [], ["is_dr_event"], energy=False)
    w = run_windows(x, ["region_id"], "slot", F.col("is_dr_event") == 1)
    w = w.select("region_id", F.concat_ws("-", "region_id", "run").alias("id"), "start", "end")
    e = _one_event(spark, d).select("region_id", F.col("event_id").alias("id"), F.col("start_ts").alias("start"), F.col("end_ts").alias("end"))
    y = best_overlap(e, w, ["region_id"])
    return rounded(y.select("region_id", "actual_id", F.col("predicted_id").isNotNull().alias("matched"), "overlap_minutes"))


def pair_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Per event: households of its region that were never asked, by arithmetic and anti-join."""
    homes = _homes(spark, d).groupBy("region_id").agg(F.count(F.lit(1)).alias("homes"))
    asked = _answers(spark, d).join(_homes(spark, d).select("client_id", "region_id"), "client_id").join(_one_event(spark, d).select("event_id", "region_id"), ["event_id", "region_id"], "left_semi")
    n = asked.groupBy("event_id").agg(F.count_distinct("client_id").alias("asked"))
    x = _one_event(spark, d).select("event_id", "region_id").join(homes, "region_id").join(n, "event_id", "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
    return x.select("event_id", "homes", "asked", (F.col("homes") - F.col("asked")).alias("missing"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Households by where they occur: readings, answers, both, neither."""
    a = read(spark, d, "partition_data").select("client_id").distinct()
    b = _answers(spark, d).select("client_id").where("client_id is not null").distinct()
    every = _homes(spark, d).select("client_id")
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "readings_only": a.exceptAll(b), "unlisted": a.union(b).distinct().subtract(every), "neither": every.subtract(a.union(b))}
    out = None
    for name, x in parts.items():
        y = x.agg(F.count(F.lit(1)).alias("households")).select(F.lit(name).alias("part"), "households")
        out = y if out is None else out.unionByName(y)
    return out


def table_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, time range, repeated keys and missing values of the readings per region."""
    x = read(spark, d, "grid_1min")
    return x.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), (F.count(F.lit(1)) - F.count_distinct("timestamp")).alias("repeated"),
        *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"missing_{c}") for c in ("temperature_c", "households_consumption_kw", "pv_production_kw")],
    )


def split_quality(spark: SparkSession, d: str) -> DataFrame:
    """Rows and quality flags per split."""
    x = read(spark, d, "partition_data").withColumn("split", split_name("split"))
    flags = ("aggregate_imputed", "aggregate_spike", "frozen", "timestamp_gap", "dr_event")
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("client_id").alias("households"), *[F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in flags])


def channel_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Scope, channel and kind of every column of the two reading tables."""
    kinds = {"string": "text", "timestamp_ntz": "time", "double": "number", "int": "number", "bigint": "number", "boolean": "flag"}
    rows = [(scope, c, kinds.get(t, "list")) for scope, table in (("grid", "grid_1min"), ("meter", "households_1min_c001_c025")) for c, t in read(spark, d, table).dtypes]
    return spark.createDataFrame(rows, "scope string, channel string, kind string")


def column_parse_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of each text column's values that parse as a number, to find load columns in files without a schema."""
    x = read(spark, d, "orders").select([F.col(c).cast("string").alias(c) for c in ("o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey")])
    rates = x.agg(*[(F.count(F.col(c).try_cast("double")) / F.count(c)).alias(c) for c in x.columns])
    y = rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rate")) for c in x.columns])).alias("s")).select("s.*")
    return y.select("column_name", "rate", (F.col("rate") >= 0.8).alias("numeric"))


def participation_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances by region and nation over the star schema."""
    x = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


QUERIES = {
    f.__name__: f
    for f in (
        response_counts, event_table, participation_history, padded_event_readings, household_enrichment, as_of_latest, segment_ownership, submeter_panel, natural_day_energy, intervention_days,
        marked_windows, overlap_match, pair_completeness, set_operations, table_profile, split_quality, channel_catalog, column_parse_rates, participation_by_dimension,
    )
}

_ID = "upper(regexp_replace(client_id, '[^\\p{L}\\p{Nd}]', '', 'g'))"
EVENTS = "e AS (SELECT * FROM dr_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) = 1)"
ANSWERS = f"a AS (SELECT response_id, event_id, nullif({_ID}, '') AS client_id, response, recorded_at FROM dr_participation QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY recorded_at DESC) = 1)"
HOMES = "hi AS (SELECT * FROM households_info QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY registered_at DESC, closed_at DESC NULLS LAST) = 1)"
SNAPS = f"sn AS (SELECT DISTINCT nullif({_ID}, '') AS client_id, as_of, snapshot_id, segment, acceptance_rate FROM household_segments)"
_LAST = SNAPS + ", l AS (SELECT * FROM sn WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY as_of DESC, snapshot_id DESC) = 1)"
_R = ", ".join(f"count(*) FILTER (WHERE response = '{r}') AS {r}" for r in RESPONSES)
_DAYS = "SELECT DISTINCT CAST(unnest(generate_series(date_trunc('day', start_ts), date_trunc('day', end_ts), INTERVAL 1 DAY)) AS DATE) AS date FROM dr_events"
_SPLIT = "CASE WHEN lower(trim(split)) LIKE 'tr%' THEN 'train' WHEN lower(trim(split)) LIKE 'va%' THEN 'validation' WHEN lower(trim(split)) LIKE 'te%' THEN 'test' END"
_OWN = ("has_ac", "has_second_ac", "has_electric_water_heater", "has_washing_machine", "occupied_daytime", "has_submeter")
_SUB = [f"count(CASE WHEN NOT isnan(targets_w[{i + 1}]) AND targets_w[{i + 1}] NOT IN (-1.0, -999.0, 65535.0, 999999.0) THEN 1 END) AS n{i}" for i in range(3)]
_G30 = GRID + """, ga AS (SELECT region_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, avg(households_consumption_kw) AS kw, max(is_dr_event) AS ev FROM g GROUP BY 1, 2),
sp AS (SELECT region_id, unnest(generate_series(min(slot), max(slot), INTERVAL 30 MINUTE)) AS slot FROM ga GROUP BY 1), q AS (SELECT * FROM sp LEFT JOIN ga USING (region_id, slot))"""

SQL = {
    "response_counts": f"WITH {ANSWERS} SELECT {_R}, count(*) AS answers FROM a",
    "event_table": f"""WITH {EVENTS}, {ANSWERS}, n AS (SELECT event_id, {_R}, count(*) AS invited FROM a WHERE event_id IS NOT NULL GROUP BY 1)
SELECT event_id, region_id, start_ts, epoch(end_ts - start_ts) / 60 AS minutes, {", ".join(f"coalesce({r}, 0) AS {r}" for r in RESPONSES)}, coalesce(invited, 0) AS invited, round(accept * 100 / nullif(invited, 0), 9) AS accept_pct FROM e LEFT JOIN n USING (event_id)""",
    "participation_history": f"WITH {EVENTS}, {ANSWERS} SELECT a.client_id, a.event_id, a.response, e.start_ts, e.surcharge_level FROM a LEFT JOIN e ON a.event_id = e.event_id WHERE a.client_id IS NOT NULL",
    "padded_event_readings": f"""WITH {EVENTS}, {METERS}, {HOMES} SELECT event_id, count(*) AS readings, round(avg(kw), 9) AS mean_kw FROM m JOIN hi USING (client_id) JOIN e ON hi.region_id = e.region_id AND ts >= start_ts - INTERVAL 2 DAY AND ts <= end_ts + INTERVAL 2 DAY GROUP BY 1""",
    "household_enrichment": f"WITH {HOMES}, {_LAST} SELECT client_id, region_id, has_ac, coalesce(segment, 'Unknown') AS segment, round(coalesce(CASE WHEN NOT isnan(acceptance_rate) THEN acceptance_rate END, 0.5), 9) AS acceptance_rate FROM hi LEFT JOIN l USING (client_id)",
    "as_of_latest": f"""WITH {ANSWERS}, {SNAPS} SELECT response_id, snapshot_id, segment FROM a JOIN (SELECT DISTINCT client_id, as_of, snapshot_id, segment FROM sn) sn USING (client_id) WHERE as_of <= recorded_at
QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY as_of DESC, snapshot_id DESC, segment DESC NULLS LAST) = 1""",
    "segment_ownership": f"WITH {HOMES}, {_LAST} SELECT coalesce(segment, 'Unknown') AS segment, count(*) AS households, {', '.join(f'round(avg(CAST({c} AS INT)), 9) AS {c}' for c in _OWN)}, round(avg(n_occupants), 9) AS occupants FROM hi LEFT JOIN l USING (client_id) GROUP BY 1",
    "submeter_panel": f"SELECT client_id, {', '.join(_SUB)} FROM partition_data WHERE client_id IN (SELECT client_id FROM households_info WHERE has_submeter) GROUP BY 1 HAVING n0 > 0 AND n1 > 0 AND n2 > 0",
    "natural_day_energy": f"WITH {GRID} SELECT region_id, CAST(ts AS DATE) AS date, round(avg(households_consumption_kw), 9) AS mean_kw FROM g WHERE CAST(ts AS DATE) NOT IN ({_DAYS}) GROUP BY 1, 2",
    "intervention_days": _DAYS,
    "marked_windows": f"""WITH {_G30}, x AS (SELECT q.*, EXISTS (SELECT 1 FROM dr_events e WHERE e.region_id = q.region_id AND e.start_ts <= q.slot AND q.slot < e.end_ts) AS inside FROM q)
SELECT region_id, inside, count(*) AS slots, round(avg(kw), 9) AS mean_kw FROM x GROUP BY 1, 2""",
    "overlap_match": f"""WITH {EVENTS}, {_G30}, n AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY slot) AS i FROM q), o AS (SELECT *, i - row_number() OVER (PARTITION BY region_id ORDER BY slot) AS run FROM n WHERE ev = 1),
w AS (SELECT region_id, min(slot) AS s, max(slot) + INTERVAL 30 MINUTE AS t FROM o GROUP BY region_id, run)
SELECT e.region_id, event_id AS actual_id, count(s) > 0 AS matched, round(coalesce(max(CASE WHEN s IS NOT NULL THEN epoch(least(end_ts, t) - greatest(start_ts, s)) / 60 END), 0), 9) AS overlap_minutes
FROM e LEFT JOIN w ON e.region_id = w.region_id AND start_ts < t AND s < end_ts GROUP BY 1, 2""",
    "pair_completeness": f"""WITH {EVENTS}, {ANSWERS}, {HOMES}, h AS (SELECT region_id, count(*) AS homes FROM hi GROUP BY 1),
k AS (SELECT a.event_id, count(DISTINCT a.client_id) AS asked FROM a JOIN hi USING (client_id) JOIN e ON e.event_id = a.event_id AND e.region_id = hi.region_id GROUP BY 1)
SELECT event_id, homes, coalesce(asked, 0) AS asked, homes - coalesce(asked, 0) AS missing FROM e JOIN h USING (region_id) LEFT JOIN k USING (event_id)""",
    "set_operations": f"""WITH {ANSWERS}, x AS (SELECT DISTINCT client_id FROM partition_data), y AS (SELECT DISTINCT client_id FROM a WHERE client_id IS NOT NULL), z AS (SELECT DISTINCT client_id FROM households_info), u AS (SELECT * FROM x UNION SELECT * FROM y)
SELECT 'union' AS part, count(*) AS households FROM u UNION ALL SELECT 'both', count(*) FROM x WHERE client_id IN (FROM y) UNION ALL SELECT 'readings_only', count(*) FROM x WHERE client_id NOT IN (FROM y)
UNION ALL SELECT 'unlisted', count(*) FROM u WHERE client_id NOT IN (FROM z) UNION ALL SELECT 'neither', count(*) FROM z WHERE client_id NOT IN (FROM u)""",
    "table_profile": """SELECT region_id, count(*) AS "rows", min("timestamp") AS first, max("timestamp") AS last, count(*) - count(DISTINCT "timestamp") AS repeated,
  count(*) FILTER (WHERE temperature_c IS NULL OR isnan(temperature_c)) AS missing_temperature_c, count(*) FILTER (WHERE households_consumption_kw IS NULL OR isnan(households_consumption_kw)) AS missing_households_consumption_kw, count(*) FILTER (WHERE pv_production_kw IS NULL OR isnan(pv_production_kw)) AS missing_pv_production_kw FROM grid_1min GROUP BY 1""",
    "split_quality": f"""SELECT {_SPLIT} AS split, count(*) AS "rows", count(DISTINCT client_id) AS households, {", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in ("aggregate_imputed", "aggregate_spike", "frozen", "timestamp_gap", "dr_event"))} FROM partition_data GROUP BY 1""",
    "channel_catalog": """SELECT scope, column_name AS channel, CASE WHEN column_type = 'VARCHAR' THEN 'text' WHEN column_type LIKE 'TIMESTAMP%' THEN 'time' WHEN column_type IN ('DOUBLE', 'INTEGER', 'BIGINT') THEN 'number' WHEN column_type = 'BOOLEAN' THEN 'flag' ELSE 'list' END AS kind
FROM (SELECT 'grid' AS scope, column_name, column_type FROM (DESCRIBE grid_1min) UNION ALL SELECT 'meter', column_name, column_type FROM (DESCRIBE households_1min_c001_c025))""",
    "column_parse_rates": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) / count({c}) AS rate, count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) / count({c}) >= 0.8 AS \"numeric\" FROM orders" for c in ("o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey")),
    "participation_by_dimension": "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
