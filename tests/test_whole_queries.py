"""Queries over small tables on which a cut would show."""

from datetime import datetime, timedelta

import __spark_entry__ as entry

QUERIES = entry.queries()
T0 = datetime(2025, 6, 1)


def saved(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")


def test_portfolio_keeps_every_household(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    readings = {"a": [600.0, 1200.0, inf, -inf], "b": [None, nan], "c": [65535.0, 999999.0, -999.0, -1.0, 300.0], "d": [nan, 100_000.0, 100_001.0, -5.0]}
    saved(spark, tmp_path, "partition_data", [(k, w) for k, ws in readings.items() for w in ws], "client_id string, aggregate_w double")
    got = {r["client_id"]: (r["energy_kwh"], r["mean_kw"], r["peak_kw"], r["valid"], r["rows"]) for r in QUERIES["portfolio_summary"](spark, str(tmp_path)).collect()}
    assert got == {"a": (0.03, 0.9, 1.2, 2, 4), "b": (None, None, None, 0, 2), "c": (0.005, 0.3, 0.3, 1, 5), "d": (1.666666667, 100.0, 100.0, 1, 4)}


def test_natural_days_look_at_their_own_region(spark, tmp_path):
    grid = [(T0 + timedelta(days=i, hours=h), k, 20.0, 0, 0, 10.0 * (i + 1) + h, 1.0, 1.0, 0, 0) for k in ("r1", "r2") for i in range(3) for h in (0, 2)]
    schema = "timestamp timestamp_ntz, region_id string, temperature_c double, is_holiday int, is_ramadan int, households_consumption_kw double, steg_production_kw double, pv_production_kw double, is_dr_event int, is_dr_peak int"
    saved(spark, tmp_path, "grid_1min", grid, schema)
    events = [(1, "r1", T0 + timedelta(hours=20), T0 + timedelta(hours=26)), (2, "r2", T0 + timedelta(days=2), T0 + timedelta(days=2, hours=1)), (3, "r3", T0, T0 + timedelta(days=2))]
    saved(spark, tmp_path, "dr_events", events, "event_id int, region_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = {(r["region_id"], r["date"].day): r["mean_kw"] for r in QUERIES["natural_day_energy"](spark, str(tmp_path)).collect()}
    assert got == {("r1", 3): 31.0, ("r2", 1): 11.0, ("r2", 2): 21.0}


def test_spikes_start_above_fifteen_kilowatts(spark, tmp_path):
    readings = [("C1", 2000.0), ("C1", 8000.0), ("c-1", 15_000.0), ("C1", 15_001.0), ("C2", 90_000.0)]
    saved(spark, tmp_path, "households_1min_c001_c025", [(T0 + timedelta(minutes=i), k, w) for i, (k, w) in enumerate(readings)], "timestamp timestamp_ntz, client_id string, aggregate_power_w double")
    got = {r["client_id"]: (r["removed"], r["mean_kw"]) for r in QUERIES["spike_mask"](spark, str(tmp_path)).collect()}
    assert got == {"C1": (1, 8.333333333), "C2": (1, None)}


def test_minute_series_of_households_registers_and_temperatures(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    readings = [("a", at(-30), 100.0), ("a", at(30), 20.0), ("a", at(150), 65535.0), ("a", at(210), 40.0), ("a", at(270), 8.0)]
    saved(spark, tmp_path, "partition_data", [(k, t, w) for k, t, w in readings], "client_id string, timestamp timestamp_ntz, aggregate_w double")
    saved(spark, tmp_path, "grid_1min", [("r", at(0), 20.0), ("r", at(120), -127.0), ("r", at(180), 22.0), ("r", at(240), 23.0)], "region_id string, timestamp timestamp_ntz, temperature_c double")

    def minutes(name):
        return {round((r["slot"] - T0).total_seconds() / 60): (r["value"], r["timestamp_gap"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}

    assert minutes("p2_household_minutes") == {-1: (100.0, False), 0: (60.0, False), 1: (20.0, True), 2: (20.0, False), 3: (40.0, False), 4: (40.0, False)}
    assert minutes("p2_region_temperature_minutes") == {0: (20.0, False), 1: (20.0, True), 2: (None, False), 3: (22.0, False), 4: (None, False)}
    # registers 100 | 20 20 60 68: the fall at the month's end is a reset, its increment the new reading
    assert minutes("p2_register_minutes") == {-1: (10.0, False), 0: (10.0, False), 1: (0.0, True), 2: (20.0, False), 3: (24.0, False), 4: (4.0, False)}
