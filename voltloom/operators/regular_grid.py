"""Irregular readings onto a regular grid.

The value between two successive readings is an increment of a cumulative
quantity: for a counter the difference of the readings (after a reset, which
shows as a fall, the new reading itself), for a gauge the earlier reading held
until the later one. Each increment is distributed over the grid cells it
overlaps, in proportion to the overlap; cells no reading falls in are marked.

Scale: readings are hashed by (source, time block) once. A block is at least as
long as the longest gap that may be bridged, so a block needs no more of its
neighbours than their nearest reading, which comes from a table with one row a
block. No task ever holds more than one block of one source, however long or
hot the source is, and the cells are summed where the block already lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.columns import DAY_US, MICROS, floor_to, from_micros, micros


def regular_grid(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str | None = None,
    *,
    cell_s: int = 60,
    kind: str = "gauge",
    max_gap_s: int = 86_400,
    hold_s: int | None = None,
) -> DataFrame:
    """One row per source and cell between the source's first and last reading.

    Result: keys, ``slot`` (start of the cell), ``readings`` (distinct times of
    rows in the cell), ``timestamp_gap`` (true where no row falls in the cell),
    ``value`` (gauge: time-weighted mean; counter: increment within the cell),
    ``filled`` (the value is taken from readings outside the cell) and
    ``covered_s`` (measured seconds of the cell).

    kind: 'gauge' or 'counter'. max_gap_s: where two successive rows lie further
    apart, one series ended and another began; no cell between them is returned.
    hold_s: an increment over a longer interval counts as unmeasured (None: no
    bound but max_gap_s).

    Defined cases: rows with a null key or time are no readings; a null or NaN
    value is a reading without measurement, so it marks its cell as present and
    its interval as not covered. Repeated times count once: gauges take the mean
    of their values, counters the largest. One reading gives one cell with a null
    value. An empty table gives an empty grid. Other columns are ignored.
    """
    if kind not in ("gauge", "counter"):
        raise ValueError(f"kind must be gauge or counter, not {kind}")
    cell, gap = cell_s * MICROS, max_gap_s * MICROS
    block = math.lcm(DAY_US * -(-max(DAY_US, gap) // DAY_US), cell)  # whole days and whole cells
    k = [f"_k{i}" for i in range(len(keys))]
    v = F.lit(None).cast("double") if value is None else F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], micros(ts).alias("_t"), v.alias("_v"))
    rows = rows.where(" and ".join(f"{c} is not null" for c in [*k, "_t"])).withColumn("_b", floor_to(F.col("_t"), block)).where("_b is not null")

    spread = rows.repartition(*k, "_b")
    once = spread.groupBy(*k, "_b", "_t").agg((F.avg if kind == "gauge" else F.max)("_v").alias("_v"))
    inside = Window.partitionBy(*k, "_b").orderBy("_t")
    near = once.select(
        *k, "_b", "_t", "_v",
        F.lag("_t").over(inside).alias("_pt"), F.lead("_t").over(inside).alias("_nt"), F.lead("_v").over(inside).alias("_nv"),
    )
    # both branches read the same columns of ``once`` under the same filters (the join below would
    # add the one on the block to one of them only), so that they share one exchange
    ends = once.groupBy(*k, "_b").agg(F.min("_t").alias("_ft"), F.min_by("_v", "_t").alias("_fv"), F.max("_t").alias("_lt"), F.max_by("_v", "_t").alias("_lv"))
    across = Window.partitionBy(*k).orderBy("_b")
    ends = ends.select(*k, "_b", *[F.lag(c).over(across).alias(n) for c, n in (("_lt", "_before_t"), ("_lv", "_before_v"))], *[F.lead(c).over(across).alias(n) for c, n in (("_ft", "_after_t"), ("_fv", "_after_v"))])
    x = near.join(ends, [*k, "_b"])

    end = F.col("_b") + F.lit(block)
    last = F.col("_nt").isNull()
    nt, nv = F.when(last, F.col("_after_t")).otherwise(F.col("_nt")), F.when(last, F.col("_after_v")).otherwise(F.col("_nv"))
    head = F.col("_pt").isNull()
    x = x.select(
        *k, "_b", "_t", "_v", nt.alias("_n"), nv.alias("_w"),
        F.when(head, F.col("_before_t")).alias("_p"), F.when(head, F.col("_before_v")).alias("_u"),
    )
    x = x.withColumn("_n", F.when(F.col("_n") - F.col("_t") <= gap, F.col("_n"))).withColumn("_p", F.when(F.col("_t") - F.col("_p") <= gap, F.col("_p")))

    def rate(a: str, b: str, from_t: str, to_t: str):  # the increment a microsecond between two readings
        inc = F.col(a) if kind == "gauge" else F.when(F.col(b) >= F.col(a), F.col(b) - F.col(a)).otherwise(F.col(b)) / (F.col(to_t) - F.col(from_t))
        known = F.col(a).isNotNull() & (F.lit(kind == "gauge") | F.col(b).isNotNull())
        return F.when(known & (F.col(to_t) - F.col(from_t) <= (hold_s or max_gap_s) * MICROS), inc)

    x = x.select(
        *k, "_b", "_t",
        F.greatest("_p", "_b").alias("_lo"), F.when(F.col("_p").isNotNull(), rate("_u", "_v", "_p", "_t")).alias("_back"), F.col("_p").isNotNull().alias("_has_p"),
        F.least("_n", end).alias("_hi"), F.when(F.col("_n").isNotNull(), rate("_v", "_w", "_t", "_n")).alias("_ahead"), F.col("_n").isNotNull().alias("_has_n"),
    )
    start = floor_to(F.when(F.col("_has_p"), F.col("_lo")).otherwise(F.col("_t")), cell)
    stop = floor_to(F.when(F.col("_has_n"), F.col("_hi") - 1).otherwise(F.col("_t")), cell)
    x = x.withColumn("_c", F.explode(F.sequence(start, F.greatest(stop, floor_to(F.col("_t"), cell)), F.lit(cell).cast("bigint"))))

    def overlap(a: str, b: str):
        return F.greatest(F.least(F.col(b), F.col("_c") + cell) - F.greatest(F.col(a), F.col("_c")), F.lit(0))

    back = F.when(F.col("_back").isNotNull(), overlap("_lo", "_t")).otherwise(0)
    ahead = F.when(F.col("_ahead").isNotNull(), overlap("_t", "_hi")).otherwise(0)
    x = x.select(
        *k, "_b", "_c", (F.col("_c") == floor_to(F.col("_t"), cell)).cast("int").alias("_own"), (back + ahead).alias("_cov"),
        (F.coalesce(F.col("_back") * back, F.lit(0.0)) + F.coalesce(F.col("_ahead") * ahead, F.lit(0.0))).alias("_inc"),
    )
    g = x.groupBy(*k, "_b", "_c").agg(F.sum("_own").alias("readings"), F.sum("_cov").alias("_cov"), F.sum("_inc").alias("_inc"))
    amount = F.col("_inc") / F.col("_cov") if kind == "gauge" else F.col("_inc")
    return g.select(
        *[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)],
        from_micros(F.col("_c")).alias("slot"),
        F.col("readings").cast("int").alias("readings"),
        (F.col("readings") == 0).alias("timestamp_gap"),
        F.when(F.col("_cov") > 0, amount).alias("value"),
        ((F.col("readings") == 0) & (F.col("_cov") > 0)).alias("filled"),
        (F.col("_cov") / MICROS).alias("covered_s"),
    )
