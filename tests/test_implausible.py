"""Implausible readings against the plain SQL of the problem's statement, and the defined cases."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators.implausible import GAIN, follow, implausible_readings, steady_innovations
from voltloom.operators.imputation import POWER_FIELDS, power_columns
from voltloom.queries.problems_sql import P6_FOUND

SCHEMA = "client_id string, timestamp timestamp_ntz, aggregate_w double, targets_w array<double>, k string, t int, b int, v0 string, head string"


def find(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA)
    return implausible_readings(df, "client_id", "timestamp", dict(zip(POWER_FIELDS, power_columns())), **kw)


def brute(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE partition_data (client_id VARCHAR, \"timestamp\" TIMESTAMP, aggregate_w DOUBLE, targets_w DOUBLE[])")
    if rows:
        c.executemany("INSERT INTO partition_data VALUES (?, ?, ?, ?)", rows)
    return set(c.sql(P6_FOUND).fetchall())


def series(r, client, n):
    t, out, level = datetime(2025, 1, 1, 22) + timedelta(minutes=r.randrange(60)), [], 100.0
    mode = 0
    for _ in range(n):
        t += timedelta(seconds=r.choice([60, 60, 60, 600, 3000]))
        mode = r.choice([0, 1, 2, 3, 4, 5]) if r.random() < 0.08 else mode
        if mode == 1:
            v = level  # stuck
        elif mode == 2:
            v = level * 10 + r.random()
        elif mode == 3:
            v = r.choice([float("inf"), -5.0, 2e5, -1.0, -999.0])
        elif mode == 4:
            v = 0.0
        else:
            v = level = float(r.randrange(80, 400))
        if r.random() < 0.05:
            v = r.choice([None, float("nan"), 65535.0])
        targets = r.choice([None, [v, None, 3.0], [None, None, float("nan")]])
        out.append((client, t, v, targets))
        if r.random() < 0.05:
            out.append((client, t, r.choice([v, 120.0]), targets))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matches_the_statement(spark, seed):
    r = random.Random(seed)
    rows = [x for c in ("a", "b", "c") for x in series(r, c, r.choice([3, 40, 400]))] + [(None, datetime(2025, 1, 1), 5.0, None), ("a", None, 5.0, None)]
    r.shuffle(rows)
    got = {(x.client_id, x.ts.strftime("%Y-%m-%d %H:%M:%S"), x.field) for x in find(spark, rows).collect()}
    assert got == brute(rows)


def test_a_run_over_many_days_is_one(spark):
    rows = [("a", datetime(2025, 1, 1) + timedelta(hours=10 * i), 55.0 if 3 <= i < 25 else float(i), None) for i in range(40)]
    assert find(spark, rows).where("reason = 'stuck'").count() == 22


def test_lasting_load_is_no_spike_and_a_brief_one_is(spark):
    base = [("a", datetime(2025, 1, 1) + timedelta(minutes=i), 100.0 + i % 7, None) for i in range(60)]
    lasting = [(c, t, 5000.0 + i if 20 <= i < 30 else v, x) for i, (c, t, v, x) in enumerate(base)]
    brief = [(c, t, 5000.0 + i if 20 <= i < 29 else v, x) for i, (c, t, v, x) in enumerate(base)]
    assert find(spark, lasting).count() == 0
    found = find(spark, brief).collect()
    assert len(found) == 9 and all(x.reason == "spike" and x.z > 2 for x in found)


def test_excursions_on_both_sides_of_an_impossible_reading_are_two(spark):
    base = [("a", datetime(2025, 1, 1) + timedelta(minutes=i), 100.0 + i % 7, None) for i in range(60)]
    rows = [(c, t, -5.0 if i == 26 else 5000.0 + i if 20 <= i < 33 else v, x) for i, (c, t, v, x) in enumerate(base)]
    found = find(spark, rows).collect()
    assert sorted(x.reason for x in found) == ["impossible"] + ["spike"] * 12
    assert {(x.client_id, x.ts.strftime("%Y-%m-%d %H:%M:%S"), x.field) for x in found} == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_spikes_among_impossible_readings(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(60):
        t, n, i = datetime(2025, 1, 1, 23), r.choice([40, 90]), 0
        while i < n:
            high = r.choice([0, 0, 3, 6, 9, 12])
            for j in range(high + r.randrange(1, 12)):
                v = r.choice([-5.0, float("inf"), 2e5]) if r.random() < 0.12 else 3000.0 + r.random() if j < high else float(r.randrange(80, 900))
                rows.append((f"h{k}", t, v, None))
                t, i = t + timedelta(seconds=60), i + 1
    r.shuffle(rows)
    assert {(x.client_id, x.ts.strftime("%Y-%m-%d %H:%M:%S"), x.field) for x in find(spark, rows).collect()} == brute(rows)


def test_steady_filter_is_the_recursion():
    r = np.random.default_rng(3)
    y, new = r.random(400) * 1000, r.random(400) < 0.03
    new[0] = True
    level, want = 0.0, []
    for v, first in zip(y, new):
        level = v if first else level
        want.append(v - level)
        level += GAIN * (v - level)
    assert np.allclose(steady_innovations(y, new), want, rtol=0, atol=1e-9)


def test_the_state_goes_on_over_days_and_blocks(spark):
    r = random.Random(8)
    at = [datetime(2025, 1, 1) + timedelta(minutes=5 * i) for i in range(288 * 4)]
    v, level = [], 300.0
    for i in range(len(at)):
        level = min(max(level + r.uniform(-40, 40), 100.0), 800.0)
        v.append(level)
    v[280:310] = [v[280]] * 30  # stuck over midnight
    for i in (100, 289 + 288, 290 + 288, 865, 1000):
        v[i] = 5000.0 + i
    v[866], v[400] = -7.0, float("inf")
    found = {}
    for block in (20_000, 50):
        x = find(spark, [("a", t, y, None) for t, y in zip(at, v)], block=block).collect()
        found[block] = {(x.ts, x.reason): x.z for x in x}
    usual = [y for y in v if 0 <= y < 1000]
    level, var, want = float(np.mean(usual)), float(np.var(usual)), {}
    p = 0.95 * var
    for i, (t, y) in enumerate(zip(at, v)):  # one filter from the first reading to the last
        p = min(p + 0.25 * var, 0.95 * var)
        s = p + 0.05 * var
        z = (y - level) / s**0.5
        want[t] = z
        if 0 <= y <= 100_000 and z <= 2:
            k = p / s
            level, p = level + k * (y - level), (1 - k) * p
    assert sorted(x for _, x in found[50]) == ["impossible"] * 2 + ["spike"] * 5 + ["stuck"] * 30
    for got in found.values():
        assert got == {(t, x): pytest.approx(want[t], rel=1e-9, abs=1e-9) for t, x in found[50]}


@pytest.mark.parametrize("block", [1, 60, 300])
def test_hot_sources_in_blocks_match_the_statement(spark, block):
    r = random.Random(block)
    rows = [x for c in ("a", "b") for x in series(r, c, 600)]
    got = {(x.client_id, x.ts.strftime("%Y-%m-%d %H:%M:%S"), x.field) for x in find(spark, rows, block=block).collect()}
    assert got == brute(rows)


def test_gains_settle_where_nothing_is_flagged():
    r = np.random.default_rng(5)
    y = 500 + r.random(200)
    levels, _, gains, flagged = follow(y.tolist(), 500.0, 1e6, 2.0, 10)
    assert not flagged and gains[-1] == pytest.approx(GAIN)
    assert np.allclose((y - levels)[60:], steady_innovations(y, np.arange(200) == 0)[60:], rtol=0, atol=1e-9)


def test_every_case_below_a_gap_is_followed(spark):
    rows = [("a", datetime(2025, 1, 1) + timedelta(minutes=i), v, None) for i, v in enumerate([0.0] * 30 + [500.0] + [0.0] * 30)]
    assert [x.value for x in find(spark, rows).collect()] == [500.0]


def test_an_appliance_that_is_mostly_off_has_a_variance(spark):
    rows = [("a", datetime(2025, 1, 1) + timedelta(minutes=i), v, None) for i, v in enumerate([0.0] * 30 + [400.0] * 25 + [0.0] * 30 + [900.0] + [0.0] * 5)]
    found = find(spark, rows).collect()
    assert {(x.client_id, x.ts.strftime("%Y-%m-%d %H:%M:%S"), x.field) for x in found} == brute(rows)
    assert sorted(x.reason for x in found) == ["spike"] + ["stuck"] * 25
    assert all(2 < x.z < 20 for x in found if x.reason == "spike") and max(abs(x.z) for x in found) < 20


def test_empty(spark):
    assert find(spark, []).count() == 0
    assert find(spark, [("a", datetime(2025, 1, 1), None, None)]).count() == 0
    assert find(spark, [("a", datetime(2025, 1, 1), 5.0, None)]).count() == 0
