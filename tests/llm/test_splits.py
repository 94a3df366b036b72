"""Components against union-find, the forest's size, and the dealing of homes."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from voltloom.llm.splits import components, deal, homes_of, spanning_forest

LINK = "x string, y string, d date, ra string, e int, src string"


def forest(spark, links):
    df = spark.createDataFrame([(a, b, d, "r", 1, "s") for a, b, d in links], LINK)
    return spanning_forest(df, F.col("x"), F.col("y"), F.col("d"))


def roots(links):
    up = {}

    def find(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b, _ in links:
        if a and b and a != b:
            up[find(a)] = find(b)
    groups = {}
    for a in up:
        groups.setdefault(find(a), set()).add(a)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", range(2))
def test_components_and_forest(spark, seed):
    r = random.Random(seed)
    day = lambda: r.choice([None, date(2025, 1, r.randrange(1, 4))])
    links = [(f"c{i}", f"c{i + 1}", day()) for i in range(12)]  # a chain
    links += [("hub", f"s{i}", day()) for i in range(20)]
    links += [(f"n{r.randrange(40)}", f"n{r.randrange(40)}", day()) for _ in range(25)]
    links += [(b, a, d) for a, b, d in links[:5]] + links[:5] + [(None, "c1", None), ("z", "z", None), ("z", None, None)]
    folder = forest(spark, links)
    got = {}
    for x in components(spark, folder).collect():
        got.setdefault(x.root, set()).add(x.node)
    want = roots(links)
    assert {frozenset(g) for g in got.values()} == want
    assert all(root in g for root, g in got.items())
    written = spark.read.parquet(folder).collect()
    assert len(written) == len({x.child for x in written}) == sum(len(g) for g in want)
    edges = {(x.a, x.b) for x in written if x.parent}
    assert len(edges) == sum(len(g) - 1 for g in want)
    assert roots([(a, b, None) for a, b in edges]) == want


def test_no_links(spark):
    assert components(spark, forest(spark, [])).count() == 0
    links = spark.createDataFrame([("a", "b", None, "r", 1, "s")], LINK)
    ends = (F.col("x"), F.col("y"), F.col("d"))
    some = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "client_id string, n int")
    got = {x.client_id: x.home for x in homes_of(some, links, *ends).collect()}
    assert got["c"] == "c" and got["a"] == got["b"] and got["a"] in "ab"
    assert {x.client_id: x.home for x in homes_of(some, links.limit(0), *ends).collect()} == {"a": "a", "b": "b", "c": "c"}


def test_shares_are_met_by_records(spark):
    r = random.Random(5)
    rows = [(f"h{i}", 1 + int(r.paretovariate(1.2))) for i in range(3000)] + [("hot", 3000), (None, 5)]
    df = spark.createDataFrame(rows, "home string, records int")
    got = {x.home: x.split for x in deal(df, {"train": 0.7, "validation": 0.15, "test": 0.15}).collect()}
    size = {h: n for h, n in rows if h}
    assert set(got) == set(size)
    total = sum(size.values())
    for s, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
        assert abs(sum(n for h, n in size.items() if got[h] == s) / total - share) < 0.03
    assert {x.home: x.split for x in deal(df, {"train": 0.7, "validation": 0.15, "test": 0.15}).collect()} == got
    homes = len(size)
    for s, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
        assert abs(sum(got[h] == s for h in size) / homes - share) < 0.03
    few = spark.createDataFrame([("a", 50), ("b", None), ("c", 0), ("d", 49)], "home string, records int")
    dealt = {x.home: x.split for x in deal(few, {"x": 0.5, "y": 0.5}).collect()}
    assert set(dealt) == set("abcd") and dealt["a"] != dealt["d"]
    assert deal(df.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        deal(df, {"a": -1.0})
