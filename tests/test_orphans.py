"""Orphan references against brute force, and the defined cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltloom.functions import bloom
from voltloom.operators import joins
from voltloom.functions.columns import canonical_id
from voltloom.operators.orphans import count_orphans, life_spans, orphan_references

PARENT = "id string, a timestamp_ntz, b timestamp_ntz, key string, spans int"
REF = "n long, id string, t timestamp_ntz, key int, at string, _s string"
T = datetime(2025, 1, 1)


def run(spark, parents, refs):
    p = life_spans(spark.createDataFrame([(*x, "k", 1) for x in parents], PARENT), canonical_id("id"), "a", "b")
    r = spark.createDataFrame([(*x, 1, "x", "y") for x in refs], REF)
    return orphan_references(r, "n", canonical_id("id"), "t", p, blank=F.trim("id") == "")


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    r = random.Random(seed)
    day = lambda: T + timedelta(days=r.randrange(30))
    parents = []
    for i in range(30):
        a = day()
        parents += [(f"C{i:03d}", a, r.choice([None, a + timedelta(days=5)]))] * r.choice([1, 2])
    hot = ["C001"] * 40
    refs = [(n, i, day()) for n, i in enumerate(hot + [r.choice([f"C{r.randrange(40):03d}", f"c-{r.randrange(40):03d}", None, "", "  ", "CO01"]) for _ in range(100)])]
    refs += refs[:7]
    norm = lambda s: "".join(c for c in s if c.isalnum()).upper()
    want = {n for n, i, t in refs if i and i.strip() and not any(norm(p) == norm(i) and a <= t and (b is None or t < b) for p, a, b in parents)}
    got = run(spark, parents, refs).collect()
    assert {g.record_id for g in got} == want
    assert len(got) == len({(g.record_id, g.key, g.at) for g in got})
    known = {norm(p) for p, _, _ in parents}
    assert all((g.reason == "never listed") == (g.key not in known) for g in got)


def test_bounds_and_open_times(spark):
    parents = [("A", T, T + timedelta(days=1)), ("B", None, None), ("N", None, T)]
    refs = [(1, "A", T), (2, "A", T + timedelta(days=1)), (3, "a", T - timedelta(seconds=1)), (4, "B", T), (5, "A", None), (6, "Z", None), (7, "N", T)]
    assert {g.record_id for g in run(spark, parents, refs).collect()} == {2, 3, 6, 7}


def test_empty(spark):
    assert {g.record_id for g in run(spark, [], [(1, "A", T)]).collect()} == {1}
    assert run(spark, [("A", T, None)], []).count() == 0
    assert count_orphans(run(spark, [], [(1, "A", T), (2, "B", T)])).collect()[0].orphans == 2


@pytest.mark.parametrize("routed", [False, True])
def test_bloom_filter_has_no_misses(spark, routed, monkeypatch):
    if routed:  # as if the shards were too large to broadcast
        monkeypatch.setattr(bloom, "MOST_BYTES", 0)
    keys = spark.range(9000).select(F.concat(F.lit("k"), "id").alias("key"))
    f = bloom.bloom_filter(keys, "key", 9000)
    assert f.count() == 5
    other = spark.range(9000).select(F.concat(F.lit("z"), "id").alias("key"))
    assert bloom.might_contain(keys, "key", f, 9000).where("not _maybe").count() == 0
    assert bloom.might_contain(other, "key", f, 9000).where("_maybe").count() < 200
    assert bloom.might_contain(other.limit(3), "key", f.limit(0), 0).where("_maybe").count() == 0


def test_hot_keys_are_spread(spark, monkeypatch):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    look = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "key string, v int")
    assert {(h.key, h._pieces) for h in joins.hot_keys(rows, ["key"]).collect()} == {("hot", 2)}
    want = rows.join(look, "key", "left")
    for how in ("left", "inner"):
        got = joins.spread_join(rows, look, ["key"], how)
        assert got.exceptAll(want).count() == 0 and got.count() == (4000 if how == "left" else want.where("v is not null").count())
    assert joins.spread_join(rows, look, ["key"], "left_anti").count() == want.where("v is null").count()
    assert joins.lookup_join(rows, look, ["key"], most_bytes=0).exceptAll(want).count() == 0
