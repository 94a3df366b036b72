"""Filling fixed-capacity containers with whole items, to target proportions of their sources.

Deficit round-robin over source queues: each container (window) credits every source
with its share of the capacity; the source with the largest credit sends its largest
item that still fits, and pays its size. Credits are carried from window to window and
from partition to partition: as every partition packs all of its items, the credit a
partition starts with is known beforehand from the sums per partition and source.

Scale: items are hashed into partitions of bounded size, so a source with a third of
all items is spread evenly. The only tables that grow with the number of partitions are
sums per partition and source; their running sums are sorted in ranges, too. The last,
partly filled container of each partition is opened again and packed together with
those of other partitions, with the credits that all closed containers have left.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordering import running_totals
from voltloom.session import cut

_OUT = "row long, item string, piece int, pieces int, size int, source string, part long, window int, kind string"
#: Partitions whose running sums are taken in one task.
_RANGE = 4096


def _drr(items: pd.DataFrame, credit: dict[str, float], share: dict[str, float], capacity: int) -> list[tuple[int, int]]:
    """(position of the item, window) for every item."""
    queues: dict[str, tuple[list[int], list[int]]] = {}
    for source, rows in items.sort_values(["size", "row"]).groupby("source", sort=True):
        queues[source] = (rows["size"].tolist(), rows.index.tolist())
    credit = {s: credit.get(s, 0.0) for s in queues}
    out, window = [], 0
    while queues:
        room, used = capacity, False
        for s in credit:
            credit[s] += share.get(s, 0.0) * capacity
        open_ = set(queues)
        while open_:
            s = max(open_, key=lambda q: (credit[q], q))
            sizes, rows = queues[s]
            i = bisect_right(sizes, room) - 1
            if i < 0:
                open_.discard(s)
                continue
            size, row = sizes.pop(i), rows.pop(i)
            out.append((row, window))
            room, used = room - size, True
            credit[s] -= size
            if not sizes:
                del queues[s]
                open_.discard(s)
        window += used
        if not used:  # nothing fits an empty container: cannot happen for sizes up to the capacity
            raise ValueError("an item is larger than the container")
    return out


def _carried(rest: DataFrame, aims: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """part, source, aim, credit: what each source is owed when each partition of ``rest`` (part, source, size) begins.

    Owed is the source's share of all that the partitions before it hold, less what they
    hold of the source. base: source, owed before the first partition.
    """
    sums = rest.groupBy("part", "source").agg(F.sum("size").alias("s"))
    sizes = sums.groupBy("part").agg(F.sum("s").alias("s")).withColumn("all", F.lit(0)).withColumn("range", F.floor(F.col("part") / _RANGE))
    sizes = running_totals(sizes, "all", "range", ["part"], "s").select("part", (F.col("upto") - F.col("s")).alias("sent"))
    own = running_totals(sums.withColumn("range", F.floor(F.col("part") / _RANGE)), "source", "range", ["part"], "s").select("part", "source", (F.col("upto") - F.col("s")).alias("had"))
    x = own.join(sizes, "part").join(aims, "source")
    owed = F.col("aim") * F.col("sent") - F.col("had")
    if base is not None:
        x = x.join(base, "source", "left")
        owed = owed + F.coalesce("owed", F.lit(0.0))
    return x.select("part", "source", "aim", owed.alias("credit"))


def pack(items: DataFrame, item: Column, source: Column, size: Column, capacity: int, *, shares: dict[str, float] | None = None, part_size: int = 1 << 22, merge: int = 64) -> DataFrame:
    """One row per piece: item, piece, pieces, size, source, container, filled (of the container).

    shares: target proportions of the sources within a container, scaled to sum to one
    (None: their shares of all tokens). An item larger than the capacity is cut by the
    packer into full pieces, each a container of its own, and a rest that is packed; no
    other item is cut.

    Defined cases: items of size null or below zero count as zero; items of size zero are
    packed too; a null item is ignored; a null source is a source of its own; repeated items
    are packed as often as they occur, each for itself; an empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    x = items.select(item.cast("string").alias("item"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), F.greatest(F.coalesce(size.cast("int"), F.lit(0)), F.lit(0)).alias("size")).where("item is not null")
    x = cut(x.withColumn("row", F.monotonically_increasing_id()))  # a key of its own for every row, fixed by the written table
    left_over = F.when(F.col("size") <= capacity, F.col("size")).otherwise(F.col("size") % capacity)

    load = x.agg(F.sum(left_over + 1)).first()[0] or 0
    parts = max(1, -(-load // part_size))
    x = x.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    each = x.groupBy("source").agg(F.sum(left_over).cast("double").alias("t"))
    if shares is None:
        total = F.broadcast(each.agg(F.greatest(F.sum("t"), F.lit(1.0)).alias("all")))  # one row
        aims = each.join(total, F.lit(True)).select("source", (F.col("t") / F.col("all")).alias("aim"))
    else:
        scale = sum(shares.values()) or 1.0
        table = F.create_map(*[F.lit(v) for s, w in shares.items() for v in (s, w / scale)])
        aims = each.select("source", F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0)).alias("aim"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _OUT.split(", ")]
        if left.empty:
            return pd.DataFrame({c: [] for c in names})
        left = left.reset_index(drop=True)
        whole = []
        if "pieces" not in left:  # first pass: cut what alone exceeds a container
            n = left["size"].to_numpy()
            left["pieces"] = (-(-n // capacity)).clip(min=1)
            left["piece"] = left["pieces"] - 1
            big = left[n > capacity]
            full = big["size"] // capacity
            whole = big.loc[big.index.repeat(full)].copy()
            whole["piece"] = whole.groupby("row").cumcount()
            whole["size"], whole["window"], whole["kind"] = capacity, whole["piece"], "c"
            left["size"] = [s if s <= capacity else s % capacity for s in n.tolist()]
            left = left[(n <= capacity) | (left["size"] > 0)].reset_index(drop=True)
        out = left.iloc[:0].assign(window=0, kind="")
        if len(left):
            found = _drr(left, dict(zip(right["c_source"], right["c_credit"], strict=True)), dict(zip(right["c_source"], right["c_aim"], strict=True)), capacity)
            out = left.iloc[[r for r, _ in found]].copy()
            out["window"] = [w for _, w in found]
            out["kind"] = ["closed" if w < found[-1][1] else "open" for _, w in found]
        return pd.concat([out, whole])[names] if len(whole) else out[names]

    def packed(rows: DataFrame, credit: DataFrame) -> DataFrame:
        # both sides come from the same items: aliases give the credits columns of their own
        own = credit.select(*[F.col(c).alias(f"c_{c}") for c in ("part", "source", "aim", "credit")])
        return rows.groupBy("part").cogroup(own.groupBy("c_part")).applyInPandas(run, _OUT)

    first = packed(x.select("row", "item", "size", "source", "part"), _carried(x.select("part", "source", left_over.alias("size")), aims))
    out = ["item", "piece", "pieces", "size", "source"]
    label = lambda kind: F.concat_ws("-", F.lit(kind), "part", "window")
    cut_off = lambda df: df.where("kind = 'c'").select(*out, F.concat_ws("-", F.lit("c"), "row", "piece").alias("container"))
    first = cut(first)
    if parts > 1:
        closed = first.where("kind = 'closed'")
        open_ = first.where("kind = 'open'").withColumn("part", F.floor(F.col("part") / merge))
        held = closed.groupBy("source").agg(F.sum("size").alias("had"))
        sent = F.broadcast(closed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("sent")))  # one row
        base = aims.join(held, "source", "left").join(sent, F.lit(True)).select("source", (F.col("aim") * F.col("sent") - F.coalesce("had", F.lit(0))).alias("owed"))
        again = packed(open_.drop("window", "kind"), _carried(open_, aims, base))
        done = closed.select(*out, label("a").alias("container")).unionByName(again.select(*out, label("b").alias("container"))).unionByName(cut_off(first))
    else:
        done = first.where("kind <> 'c'").select(*out, label("a").alias("container")).unionByName(cut_off(first))
    return done.withColumn("filled", F.sum("size").over(Window.partitionBy("container")).cast("int"))
