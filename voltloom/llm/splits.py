"""Splits that keep related records together.

Boruvka rounds contract the links between entities: every component takes its least
link, and the chosen links hook the components together. What hooks to what, and by
which link, is appended to the shared checkpoint folder: parent pointers over the
entities, the spanning forest. Pointer jumping relabels the links that are left, links
inside a component are dropped, and the next round begins. In the end the forest is read
back and pointer jumping finds every entity's root. The homes, one a root, are ordered by
size band and dealt systematically to the splits.

Scale: components at least halve each round, pointer jumping takes a logarithmic number
of steps, and each step is a join of tables that are checkpointed, never collected. A
hub's links are spread by salted joins and reduced on the map side. Dealing needs only
positions, from a distributed sort, and a table of at most 64 bands by 1,000 steps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.operators.joins import MOST_BYTES, row_bytes, spread_join
from voltloom.operators.ordering import hash_bucket, running_totals
from voltloom.session import checkpoint_folder, cut, drop_folder

#: Steps into which a band is cut when it is dealt.
STEPS = 1000


def _join(rows: DataFrame, lookup: DataFrame, on: str, how: str, small: bool) -> DataFrame:
    """The join with a lookup of one row a key, which is broadcast only where its counted size allows it."""
    return rows.join(F.broadcast(lookup), [on], how) if small else spread_join(rows, lookup, [on], how)


def _small(rows: int, df: DataFrame) -> bool:
    return rows * row_bytes(df) <= MOST_BYTES


def _resolved(parents: DataFrame, small: bool) -> DataFrame:
    """src, up with ``up`` moved on to the root; roots point to themselves. Two jumps between checkpoints."""
    x = cut(parents)
    while True:
        y = x.withColumnRenamed("up", "mid")
        for last in (False, True):
            step = x.select(F.col("src").alias("mid"), "up")
            y = _join(y, step, "mid", "inner", small)
            if not last:
                y = y.select("src", F.col("up").alias("mid"))
        y = cut(y.select("src", "up", (F.col("mid") != F.col("up")).alias("moved")))
        x = y.select("src", "up")
        if y.where("moved").isEmpty():
            return x


def spanning_forest(links: DataFrame, a: Column, b: Column, weight: Column) -> str:
    """The folder of the written forest: child, parent (null: a root), and the link a, b that joins them.

    Defined cases: null ends, loops, repeated and reversed links are ignored; without
    links the forest is empty; equal weights are told apart by the link's ends.
    """
    spark = links.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/voltloom-forest-{uuid.uuid4().hex}"
    raw = links.select(F.least(a, b).cast("string").alias("a"), F.greatest(a, b).cast("string").alias("b"), weight.cast("string").alias("w"), (a.isNotNull() & b.isNotNull() & (a != b)).alias("ok"))
    raw = raw.where("ok").groupBy("a", "b").agg(F.min("w").alias("w"))
    edges = cut(raw.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.struct(F.coalesce("w", F.lit("")).alias("w"), "a", "b").alias("e")))
    none = F.lit(None).cast("string")
    edges.limit(0).select(F.col("ra").alias("child"), F.col("ra").alias("parent"), "e.a", "e.b").write.mode("overwrite").parquet(folder)
    while n := edges.count():
        both = edges.select(F.col("ra").alias("src"), F.col("rb").alias("dst"), "e").unionByName(edges.select(F.col("rb").alias("src"), F.col("ra").alias("dst"), "e"))
        best = cut(both.groupBy("src").agg(F.min(F.struct("e", "dst")).alias("m")).select("src", "m.dst", "m.e"))
        back = best.select(F.col("src").alias("dst"), F.col("dst").alias("over"))
        small = _small(2 * n, back)  # two ends a link at most
        mutual = F.coalesce(F.col("over") == F.col("src"), F.lit(False)) & (F.col("src") < F.col("dst"))  # of two that chose each other one stays
        hook = cut(_join(best, back, "dst", "left", small).select("src", F.when(mutual, F.col("src")).otherwise(F.col("dst")).alias("up"), "e"))
        hook.where("src <> up").select(F.col("src").alias("child"), F.col("up").alias("parent"), "e.a", "e.b").write.mode("append").parquet(folder)
        top = _resolved(hook.select("src", "up"), small)
        for end in ("ra", "rb"):
            edges = _join(edges, top.select(F.col("src").alias(end), "up"), end, "inner", small).drop(end).withColumnRenamed("up", end)
        edges = edges.where("ra <> rb").select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), "e")
        edges = cut(edges.groupBy("ra", "rb").agg(F.min("e").alias("e")))
        live = edges.select(F.explode(F.array("ra", "rb")).alias("src")).distinct()
        done = top.where("src = up").join(live, "src", "left_anti")  # without a link left: roots of the forest
        done.select(F.col("src").alias("child"), none.alias("parent"), none.alias("a"), none.alias("b")).write.mode("append").parquet(folder)
    return folder


def components(spark: SparkSession, folder: str) -> DataFrame:
    """node, root of every node of a written forest."""
    forest = spark.read.parquet(folder).select(F.col("child").alias("src"), F.coalesce("parent", "child").alias("up"))
    return _resolved(forest, _small(forest.count(), forest)).select(F.col("src").alias("node"), F.col("up").alias("root"))


def homes_of(entities: DataFrame, links: DataFrame, a: Column, b: Column, weight: Column) -> DataFrame:
    """entities (a column ``client_id``) with ``home``: the root of its tree, or itself. The forest is removed once read."""
    folder = spanning_forest(links, a, b, weight)
    comp = components(entities.sparkSession, folder)
    drop_folder(entities.sparkSession, folder)
    return entities.join(comp.withColumnRenamed("node", "client_id"), "client_id", "left").withColumn("home", F.coalesce("root", "client_id")).drop("root")


def deal(homes: DataFrame, targets: dict[str, float]) -> DataFrame:
    """home, split for a table (home, records): whole homes dealt so that records follow the target shares.

    Homes stand in size bands (powers of two), the largest first, in an order shuffled by
    their hash. A home's position times the golden ratio, less its whole part, is its place
    in [0, 1), which spreads any stretch of homes evenly. Each band is cut there into a part
    for every split, in the proportion of what the splits still lack: what one large home
    puts too much into a split is taken back from the next bands, whose homes are few, so
    that the many small homes stay near the shares, too.

    Defined cases: shares are scaled to sum to one, negative or null shares are errors;
    homes with a null id are ignored; records null or below one count as one home in the
    lowest band; an empty table gives an empty result.
    """
    if not targets or any(s is None or s < 0 for s in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError("targets must be shares of at least zero, not all zero")
    names = sorted(targets, key=lambda n: (-targets[n], n))
    scale = sum(targets.values())
    share = [targets[n] / scale for n in names]
    x = homes.where("home is not null").select("home", F.greatest(F.coalesce(F.col("records").cast("bigint"), F.lit(0)), F.lit(0)).alias("records"))
    x = x.withColumn("h", F.xxhash64("home")).withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    x = x.withColumn("band", F.floor(F.log2(F.greatest(F.col("records"), F.lit(1)))).cast("int"))
    x = x.withColumn("bucket", hash_bucket(x, "h", -F.col("band")))
    ranked = running_totals(x, "all", "bucket", ["h", "home"], "one")
    u = F.col("upto") * F.lit(0.6180339887498949)
    step = F.least(F.floor((u - F.floor(u)) * STEPS), F.lit(STEPS - 1)).cast("int")
    ranked = cut(ranked.select("home", "records", "band", step.alias("step")))
    table: dict[int, list[int]] = {}
    for r in ranked.groupBy("band", "step").agg(F.sum("records").alias("s")).collect():  # at most 64 bands by STEPS
        table.setdefault(r["band"], [0] * STEPS)[r["step"]] = r["s"]
    lack, edges = [0.0] * len(names), []
    for band in sorted(table, reverse=True):
        sizes = table[band]
        lack = [d + s * sum(sizes) for d, s in zip(lack, share, strict=True)]
        want = [max(d, 0.0) for d in lack]
        if sum(want) <= 0:
            want = share
        at, seen = [], 0.0
        for w in want[:-1]:
            seen += w
            at.append(round(seen / sum(want) * STEPS))
        at.append(STEPS)
        edges.append((band, at))
        for i, (lo, hi) in enumerate(zip([0, *at[:-1]], at, strict=True)):
            lack[i] -= sum(sizes[lo:hi])
    if not edges:
        return ranked.select("home", F.lit(names[0]).alias("split"))
    cuts = homes.sparkSession.createDataFrame(edges, "band int, at array<int>")
    place = F.size(F.filter("at", lambda e: e <= F.col("step")))
    return ranked.join(F.broadcast(cuts), "band").select("home", F.element_at(F.array(*[F.lit(n) for n in names]), place + 1).alias("split"))
