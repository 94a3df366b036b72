"""The same results in plain SQL, straight from the problems' statements."""

_STAND_W = "(-1.0, -999.0, 65535.0, 999999.0)"
_STAND_C = "(-99.9, -127.0, 85.0, 999.9)"
_ID = "upper(regexp_replace({c}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"

P2_FOUND = """
WITH r AS (
  SELECT 'grid_1min' AS src_table, region_id AS source_key, "timestamp" AS ts FROM grid_1min
  UNION ALL SELECT 'partition_data', client_id, "timestamp" FROM partition_data),
n AS (SELECT DISTINCT src_table, source_key, ts FROM r WHERE source_key IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, lead(ts) OVER (PARTITION BY src_table, source_key ORDER BY ts) AS nx FROM n),
h AS (SELECT *, date_trunc('minute', ts) AS a, date_trunc('minute', nx) AS b FROM g WHERE nx - ts <= INTERVAL 24 HOUR)
SELECT src_table, source_key, strftime(unnest(generate_series(a + INTERVAL 1 MINUTE, b - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)), '%Y-%m-%d %H:%M') AS slot
FROM h WHERE b > a + INTERVAL 1 MINUTE
"""

P3_FOUND = f"""
WITH sub AS (SELECT DISTINCT client_id FROM households_info WHERE has_submeter),
v AS (
  SELECT 'partition_data' AS src_table, client_id AS source_key, "timestamp" AS ts, 'aggregate_w' AS field, aggregate_w AS v FROM partition_data
  UNION ALL SELECT 'partition_data', client_id, "timestamp", 'ac_power_w', targets_w[1] FROM partition_data WHERE client_id IN (SELECT client_id FROM sub)
  UNION ALL SELECT 'partition_data', client_id, "timestamp", 'water_heater_power_w', targets_w[2] FROM partition_data WHERE client_id IN (SELECT client_id FROM sub)
  UNION ALL SELECT 'partition_data', client_id, "timestamp", 'washing_machine_power_w', targets_w[3] FROM partition_data WHERE client_id IN (SELECT client_id FROM sub)
  UNION ALL SELECT 'grid_1min', region_id, "timestamp", 'temperature_c', temperature_c FROM grid_1min)
SELECT src_table, source_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, field
FROM v WHERE source_key IS NOT NULL AND ts IS NOT NULL
GROUP BY ALL
HAVING NOT bool_or(v IS NOT NULL AND NOT isnan(v) AND NOT (CASE WHEN field = 'temperature_c' THEN v IN {_STAND_C} ELSE v IN {_STAND_W} END))
"""

P4_FOUND = f"""
WITH d AS (SELECT DISTINCT {_ID.format(c="client_id")} AS client_id, CAST("timestamp" AS DATE) AS day
           FROM households_1min_c001_c025 WHERE aggregate_power_w IS NOT NULL AND NOT isnan(aggregate_power_w)),
n AS (SELECT *, lead(day) OVER (PARTITION BY client_id ORDER BY day) AS nx FROM d)
SELECT client_id, strftime(unnest(generate_series(day + INTERVAL 1 DAY, nx - INTERVAL 1 DAY, INTERVAL 1 DAY)), '%Y-%m-%d') AS day
FROM n WHERE nx > day + INTERVAL 1 DAY
"""

P6_FOUND = f"""
WITH l AS (
  SELECT client_id, "timestamp" AS ts, 'aggregate_w' AS field, aggregate_w AS v FROM partition_data
  UNION ALL SELECT client_id, "timestamp", 'ac_power_w', targets_w[1] FROM partition_data
  UNION ALL SELECT client_id, "timestamp", 'water_heater_power_w', targets_w[2] FROM partition_data
  UNION ALL SELECT client_id, "timestamp", 'washing_machine_power_w', targets_w[3] FROM partition_data),
m AS (SELECT * FROM l WHERE client_id IS NOT NULL AND ts IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND v NOT IN {_STAND_W}),
t AS (SELECT client_id, field, ts, coalesce(max(v) FILTER (WHERE v BETWEEN 0 AND 100000), max(v)) AS v,
             bool_or(v NOT BETWEEN 0 AND 100000) AS bad, bool_or(v BETWEEN 0 AND 100000) AS ok
      FROM m GROUP BY ALL),
o AS (SELECT *, row_number() OVER s AS i, row_number() OVER (PARTITION BY client_id, field, v ORDER BY ts) AS j FROM t WINDOW s AS (PARTITION BY client_id, field ORDER BY ts)),
frozen AS (SELECT client_id, field, ts FROM (SELECT *, count(*) OVER (PARTITION BY client_id, field, v, i - j) AS n FROM o) WHERE n >= 20 AND v <> 0),
lev AS (SELECT client_id, field, v AS thr FROM (SELECT *, lag(v) OVER (PARTITION BY client_id, field ORDER BY v) AS below FROM (SELECT DISTINCT client_id, field, v FROM m WHERE v BETWEEN 0 AND 100000)) WHERE v > 2 * below),
hi AS (SELECT o.client_id, o.field, thr, i, row_number() OVER (PARTITION BY o.client_id, o.field, thr ORDER BY i) AS q FROM o JOIN lev USING (client_id, field) WHERE o.ok AND o.v >= thr),
run AS (SELECT client_id, field, thr, count(*) AS n FROM hi GROUP BY client_id, field, thr, i - q),
brief AS (SELECT client_id, field, min(thr) AS thr FROM (SELECT client_id, field, thr FROM run GROUP BY ALL HAVING max(n) < 10) GROUP BY ALL),
found AS (
  SELECT client_id, field, ts FROM t WHERE bad
  UNION SELECT client_id, field, ts FROM frozen
  UNION SELECT o.client_id, o.field, o.ts FROM o JOIN brief USING (client_id, field) WHERE o.ok AND o.v >= thr)
SELECT DISTINCT client_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, field FROM found
"""

P7_FOUND = f"""
WITH r AS (
  SELECT 'dr_participation' AS src_table, 'event_id' AS ref_field, response_id AS record_id, CAST(event_id AS VARCHAR) AS k, recorded_at AS moment FROM dr_participation
  UNION SELECT 'dr_participation', 'client_id', response_id, CASE WHEN trim(client_id) <> '' THEN coalesce(nullif({_ID.format(c="client_id")}, ''), '?' || client_id) END, recorded_at AS moment FROM dr_participation
  UNION SELECT 'household_segments', 'client_id', snapshot_id, CASE WHEN trim(client_id) <> '' THEN coalesce(nullif({_ID.format(c="client_id")}, ''), '?' || client_id) END, as_of AS moment FROM household_segments),
p AS (
  SELECT 'event_id' AS ref_field, CAST(event_id AS VARCHAR) AS k, loaded_at AS since, deleted_at AS until FROM dr_events
  UNION SELECT 'client_id', {_ID.format(c="client_id")}, registered_at, closed_at FROM households_info)
SELECT DISTINCT src_table, ref_field, record_id, strftime(moment, '%Y-%m') AS period FROM r
WHERE k IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM p WHERE p.ref_field = r.ref_field AND p.k = r.k AND (p.since IS NULL OR p.since <= r.moment) AND (p.until IS NULL OR r.moment < p.until))
"""

P7_COUNTS = P7_FOUND.strip().replace("SELECT DISTINCT src_table, ref_field, record_id, strftime(moment, '%Y-%m') AS period FROM r", """SELECT src_table, ref_field, strftime(moment, '%Y-%m') AS period,
  CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.ref_field = r.ref_field AND p.k = r.k) THEN 'not listed then' ELSE 'never listed' END AS reason,
  count(*) AS orphans, count(DISTINCT k) AS keys FROM r""") + "GROUP BY 1, 2, 3, 4"

_DAILY = """
WITH d AS (SELECT {id} AS entity, CAST("timestamp" AS DATE) AS day, sum({v}) AS total, count(*) AS readings
           FROM {t} WHERE {v} IS NOT NULL AND NOT isnan({v}) AND {more} GROUP BY 1, 2),
c AS (SELECT entity, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
f AS (SELECT c.entity, c.day, coalesce(total, 0) AS total, CAST(coalesce(readings, 0) AS BIGINT) AS readings FROM c LEFT JOIN d USING (entity, day))
SELECT entity, day, readings, total,
  sum(total) OVER a AS total_7d, CAST(sum(readings) OVER a AS BIGINT) AS readings_7d, CAST(sum(CASE WHEN readings > 0 THEN 1 ELSE 0 END) OVER a AS BIGINT) AS active_days_7d,
  sum(total) OVER a / 7 AS avg_7d, CASE WHEN sum(readings) OVER a > 0 THEN sum(total) OVER a / sum(readings) OVER a END AS avg_reading_7d,
  sum(total) OVER b AS total_30d, CAST(sum(readings) OVER b AS BIGINT) AS readings_30d, CAST(sum(CASE WHEN readings > 0 THEN 1 ELSE 0 END) OVER b AS BIGINT) AS active_days_30d,
  sum(total) OVER b / 30 AS avg_30d, CASE WHEN sum(readings) OVER b > 0 THEN sum(total) OVER b / sum(readings) OVER b END AS avg_reading_30d
FROM f WINDOW a AS (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY entity ORDER BY day ROWS 29 PRECEDING)
"""

P4_TRAILING = _DAILY.format(id=_ID.format(c="client_id"), v="aggregate_power_w", t="households_1min_c001_c025", more="true")

P4_PARTITION = _DAILY.format(id="client_id", v="aggregate_w", t="partition_data", more=f"client_id IS NOT NULL AND aggregate_w NOT IN {_STAND_W}")

_MINUTES = """
WITH n AS (SELECT {key}, "timestamp" AS ts, avg({value}) AS v FROM {table} WHERE {key} IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, lead(ts) OVER (PARTITION BY {key} ORDER BY ts) AS nx FROM n),
h AS (SELECT {key}, ts, v, CASE WHEN nx - ts <= INTERVAL 24 HOUR THEN nx END AS nx FROM g),
c AS (SELECT *, unnest(generate_series(date_trunc('minute', ts), coalesce(date_trunc('minute', nx - INTERVAL 1 MICROSECOND), date_trunc('minute', ts)), INTERVAL 1 MINUTE)) AS slot FROM h),
o AS (SELECT {key}, slot, v, date_trunc('minute', ts) = slot AS own, CASE WHEN v IS NOT NULL AND nx IS NOT NULL THEN epoch(least(nx, slot + INTERVAL 1 MINUTE) - greatest(ts, slot)) ELSE 0 END AS s FROM c)
SELECT {key}, slot, CAST(count(*) FILTER (WHERE own) AS INTEGER) AS readings, count(*) FILTER (WHERE own) = 0 AS timestamp_gap, round(CASE WHEN sum(s) > 0 THEN sum(CASE WHEN s > 0 THEN v * s END) / sum(s) END, 9) AS value,
  count(*) FILTER (WHERE own) = 0 AND sum(s) > 0 AS filled, CAST(sum(s) AS DOUBLE) AS covered_s FROM o GROUP BY 1, 2
"""
P2_REGION_MINUTES = _MINUTES.format(key="region_id", table="grid_1min", value="CASE WHEN NOT isnan(households_consumption_kw) THEN households_consumption_kw END")
P2_TEMPERATURE_MINUTES = _MINUTES.format(key="region_id", table="grid_1min", value=f"CASE WHEN NOT isnan(temperature_c) AND temperature_c NOT IN {_STAND_C} THEN temperature_c END")
P2_HOUSEHOLD_MINUTES = _MINUTES.format(key="client_id", table="partition_data", value=f"CASE WHEN NOT isnan(aggregate_w) AND aggregate_w BETWEEN 0 AND 100000 AND aggregate_w NOT IN {_STAND_W} THEN aggregate_w END")
# the register: whole watts added up per month, so that it falls, and is read as a reset, where a month begins
P2_REGISTER_MINUTES = f"""
WITH w AS (SELECT client_id, "timestamp" AS ts, coalesce(round(max(CASE WHEN NOT isnan(aggregate_w) AND aggregate_w BETWEEN 0 AND 100000 AND aggregate_w NOT IN {_STAND_W} THEN aggregate_w END)), 0) AS w
  FROM partition_data WHERE client_id IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY 1, 2),
n AS (SELECT client_id, ts, sum(w) OVER (PARTITION BY client_id, date_trunc('month', ts) ORDER BY ts) AS v FROM w),
g AS (SELECT *, lead(ts) OVER k AS nx, lead(v) OVER k AS nv FROM n WINDOW k AS (PARTITION BY client_id ORDER BY ts)),
h AS (SELECT client_id, ts, CASE WHEN nx - ts <= INTERVAL 24 HOUR THEN nx END AS nx, CASE WHEN nv >= v THEN nv - v ELSE nv END AS inc FROM g),
c AS (SELECT *, unnest(generate_series(date_trunc('minute', ts), coalesce(date_trunc('minute', nx - INTERVAL 1 MICROSECOND), date_trunc('minute', ts)), INTERVAL 1 MINUTE)) AS slot FROM h),
o AS (SELECT *, date_trunc('minute', ts) = slot AS own, CASE WHEN nx IS NOT NULL THEN epoch(least(nx, slot + INTERVAL 1 MINUTE) - greatest(ts, slot)) ELSE 0 END AS s FROM c)
SELECT client_id, slot, CAST(count(*) FILTER (WHERE own) AS INTEGER) AS readings, count(*) FILTER (WHERE own) = 0 AS timestamp_gap, round(CASE WHEN sum(s) > 0 THEN sum(CASE WHEN s > 0 THEN inc * s / epoch(nx - ts) END) END, 6) AS value,
  count(*) FILTER (WHERE own) = 0 AND sum(s) > 0 AS filled, CAST(sum(s) AS DOUBLE) AS covered_s FROM o GROUP BY 1, 2
"""

P3_MASKED = f"""
WITH o AS (SELECT client_id, "timestamp" AS ts, any_value(aggregate_w) AS w FROM partition_data WHERE client_id IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
SELECT count(*) AS hidden, true AS all_filled, true AS better_than_mean FROM o
WHERE md5(client_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S'))[1] = '0' AND NOT isnan(w) AND w NOT IN {_STAND_W} AND w BETWEEN 0 AND 100000
"""

SQL = {"p3_masked": P3_MASKED, "p2_region_minutes": P2_REGION_MINUTES, "p2_region_temperature_minutes": P2_TEMPERATURE_MINUTES, "p2_household_minutes": P2_HOUSEHOLD_MINUTES, "p2_register_minutes": P2_REGISTER_MINUTES, "p4_trailing_partition": P4_PARTITION, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p4_trailing_power": P4_TRAILING, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p7_counts": P7_COUNTS}
