"""Regular grid: brute force, counters, gauges, and the defined cases."""

import random
from datetime import datetime, timedelta

import pytest

from voltloom.operators.regular_grid import regular_grid

T0 = datetime(2025, 3, 1, 23, 50)
SCHEMA = "k string, t timestamp_ntz, v double, slot string, _t int, value string, _b string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, v, "x", 1, "y", None) for k, t, v in rows], SCHEMA)


def brute_gaps(rows, limit=timedelta(hours=24)):
    out = set()
    for k in {r[0] for r in rows if r[0]}:
        ts = sorted({t for kk, t, _ in rows if kk == k and t})
        have = {t.replace(second=0, microsecond=0) for t in ts}
        for a, b in zip(ts, ts[1:]):
            if b - a > limit:
                continue
            m = a.replace(second=0, microsecond=0) + timedelta(minutes=1)
            while m < b.replace(second=0, microsecond=0):
                if m not in have:
                    out.add((k, m))
                m += timedelta(minutes=1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_gaps_match_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in ("a", "b", None):
        t = T0
        for _ in range(60):
            t += timedelta(seconds=r.choice([1, 20, 60, 61, 300, 3600, 20 * 3600, 86400, 86401, 90000]))
            rows.append((k, t, r.choice([None, float("nan"), 1.0, 2.0])))
            if r.random() < 0.2:
                rows.append(rows[-1])
    rows.append(("a", None, 1.0))
    r.shuffle(rows)
    g = regular_grid(frame(spark, rows), ["k"], "t", "v").collect()
    assert {(x.k, x.slot) for x in g if x.timestamp_gap} == brute_gaps(rows)
    assert len(g) == len({(x.k, x.slot) for x in g})
    present = {(k, t.replace(second=0)) for k, t, _ in rows if k and t}
    assert {(x.k, x.slot) for x in g if not x.timestamp_gap} == present


def test_gauge_is_held_and_time_weighted(spark):
    rows = [("a", datetime(2025, 1, 1, 0, 0, 0), 10.0), ("a", datetime(2025, 1, 1, 0, 0, 30), 20.0), ("a", datetime(2025, 1, 1, 0, 3, 0), 5.0)]
    g = {x.slot.minute: x for x in regular_grid(frame(spark, rows), ["k"], "t", "v").collect()}
    assert g[0].value == pytest.approx(15.0) and g[0].covered_s == 60
    assert g[1].value == pytest.approx(20.0) and g[1].filled and g[1].timestamp_gap
    assert g[3].value is None and not g[3].timestamp_gap


def test_gauge_over_midnight(spark):
    rows = [("a", datetime(2025, 1, 1, 23, 59, 30), 6.0), ("a", datetime(2025, 1, 2, 0, 1, 30), 1.0)]
    g = {(x.slot.day, x.slot.minute): x for x in regular_grid(frame(spark, rows), ["k"], "t", "v").collect()}
    assert [g[1, 59].covered_s, g[2, 0].covered_s, g[2, 1].covered_s] == [30, 60, 30]
    assert all(x.value == pytest.approx(6.0) for x in g.values())
    assert [g[2, 0].timestamp_gap, g[2, 1].timestamp_gap] == [True, False]


def test_counter_resets_and_distributes(spark):
    rows = [("a", datetime(2025, 1, 1, 0, 0, 30), 100.0), ("a", datetime(2025, 1, 1, 0, 2, 30), 112.0), ("a", datetime(2025, 1, 1, 0, 3, 30), 4.0)]
    g = {x.slot.minute: x for x in regular_grid(frame(spark, rows), ["k"], "t", "v", kind="counter").collect()}
    assert [g[m].value for m in range(4)] == pytest.approx([3.0, 6.0, 3.0 + 2.0, 2.0])
    total = sum(x.value for x in g.values())
    assert total == pytest.approx(12.0 + 4.0)  # a fall means a reset: the new reading is the increment


def test_unmeasured_and_single(spark):
    rows = [("a", datetime(2025, 1, 1), float("nan")), ("a", datetime(2025, 1, 1, 0, 2), 1.0), ("b", datetime(2025, 1, 1), 3.0)]
    g = regular_grid(frame(spark, rows), ["k"], "t", "v").collect()
    assert [x.value for x in g if x.k == "b"] == [None]
    assert [(x.value, x.covered_s) for x in sorted((x for x in g if x.k == "a"), key=lambda x: x.slot)] == [(None, 0), (None, 0), (None, 0)]


def test_empty_and_bad_kind(spark):
    assert regular_grid(frame(spark, []), ["k"], "t", "v").count() == 0
    with pytest.raises(ValueError):
        regular_grid(frame(spark, []), ["k"], "t", "v", kind="sum")
