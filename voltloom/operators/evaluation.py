"""Estimates against the truth, classes of values and days, appliance metrics by strata, and degraded data to test with."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.functions.columns import DAY_US, MICROS, floor_to, micros


def truth_join(estimates: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """Only what both tables know: truth is read here and nowhere else, so that no feature can see it."""
    return estimates.join(truth, list(on))


def estimate_errors(joined: DataFrame, by: Sequence[str], estimated: str, true: str) -> DataFrame:
    """rows, estimated and true totals, and the error of the total in percent (null where the truth sums to zero)."""
    g = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(estimated).alias("estimated"), F.sum(true).alias("true"))
    return g.withColumn("error_pct", (F.col("estimated") / F.nullif(F.col("true"), F.lit(0.0)) - 1) * 100)


def overall_errors(groups: DataFrame) -> DataFrame:
    """One row from the groups of estimate_errors: the totals' error and the mean absolute error of the groups, both in percent of the truth."""
    e = F.abs(F.col("estimated") - F.col("true"))
    x = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("estimated").alias("estimated"), F.sum("true").alias("true"), F.avg(e).alias("_mae"), F.avg(F.abs("true")).alias("_mean"))
    whole = F.nullif(F.col("true"), F.lit(0.0))
    return x.select("groups", "estimated", "true", ((F.col("estimated") / whole - 1) * 100).alias("error_pct"), (F.col("_mae") / F.nullif(F.col("_mean"), F.lit(0.0)) * 100).alias("mean_abs_error_pct"))


def targeting_value(df: DataFrame, by: str, accepted: Column, value: str) -> DataFrame:
    """Per group: size, share that accepted, and mean and sum of the value over those that did."""
    took = F.coalesce(accepted, F.lit(False))
    v = F.when(took, F.col(value))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.avg(took.cast("double")).alias("acceptance"), F.avg(v).alias("mean_value"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total_value"))


def counterfactual_totals(df: DataFrame, ts: str, start: str, end: str, baseline: str, actual: str) -> DataFrame:
    """rows, baseline, actual and saved totals in the half-open range."""
    x = df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
    return x.agg(F.count(F.lit(1)).alias("rows"), F.sum(baseline).alias("baseline"), F.sum(actual).alias("actual"), F.sum(F.col(baseline) - F.col(actual)).alias("saved"))


def load_class(value: Column, threshold: Column, near: float = 1.1) -> Column:
    """Normal below the threshold, Warning up to ``near`` times it, Critical from there on; null where either is unknown."""
    return F.when(value < threshold, "Normal").when(value < threshold * near, "Warning").when(value.isNotNull() & threshold.isNotNull(), "Critical")


def provenance(day: Column, test: str | None) -> Column:
    """held_out for days inside a model's declared test range 'start/end' (both included), retrospective for all others and without a range."""
    if not test:
        return F.lit("retrospective")
    start, end = test.split("/", 1)
    return F.when(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))), "held_out").otherwise("retrospective")


def fully_covered(*coverages: str) -> Column:
    """Whether every coverage is one."""
    return F.forall(F.array(*coverages), lambda c: F.coalesce(c >= 1, F.lit(False)))


def one_hot(value: Column, size: int) -> Column:
    """An array of zeros with a one at ``value`` (from 0)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == value).cast("int"))


def side_by_side(df: DataFrame, keys: Sequence[str], column: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per listed name (a bounded list), rows aligned by the keys."""
    return df.where(F.col(column).isin(*names)).groupBy(*keys).agg(*[F.max(F.when(F.col(column) == n, F.col(value))).alias(n) for n in names])


def verify_columns(df: DataFrame, required: Mapping[str, str]) -> None:
    """An error that names every column which is missing or of another type; the data are not read."""
    have = dict(df.dtypes)
    wrong = [f"{c} is {have.get(c, 'missing')}, not {t}" for c, t in required.items() if have.get(c) != t]
    if wrong:
        raise ValueError("; ".join(wrong))


def degrade(df: DataFrame, key: Sequence[str], value: str, *, gap_every: int = 50, spike_every: int = 200, frozen_minutes: int = 0, ts: str | None = None) -> DataFrame:
    """Data made worse to test with, the same at every run: a value in ``gap_every`` lost, one in ``spike_every`` five- to fifteenfold, and, with ``frozen_minutes``, each key's values held over the last such stretch of every day."""
    h = F.xxhash64(*key, *([ts] if ts else []))
    v = F.col(value)
    if frozen_minutes and ts:
        day = floor_to(micros(ts), DAY_US)
        late = micros(ts) - day >= DAY_US - frozen_minutes * 60 * MICROS
        start = Window.partitionBy(*key, day, late).orderBy(ts)
        v = F.when(late, F.first(value).over(start)).otherwise(v)
    spike = v * (5 + F.pmod(F.shiftright(h, 20), F.lit(11)))
    return df.withColumn(value, F.when(F.pmod(h, F.lit(gap_every)) == 0, F.lit(None)).when(F.pmod(F.shiftright(h, 8), F.lit(spike_every)) == 0, spike).otherwise(v))


def appliance_buckets(df: DataFrame, home: str, ts: str, appliance: str, actual: str, predicted: str, strata: Mapping[str, Column], threshold: float = 50.0) -> DataFrame:
    """Sums per appliance, home ('ALL' for all together) and stratum, from which every metric follows; those of several parts add up (merge_buckets).

    count, abs_error, actual_sum, predicted_sum, tp, fp, fn; hour_abs_error and hours: the
    error of each hour's energy (of the mean over its readings), and covered: readings in
    those hours. strata: name and condition; 'overall' always counts.
    """
    x = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    names = F.array_compact(F.array(F.lit("overall"), *[F.when(c, F.lit(n)) for n, c in strata.items()]))
    x = x.select(F.col(appliance).alias("appliance"), F.col(home).alias("_home"), F.date_trunc("hour", ts).alias("_hour"), F.col(actual).cast("double").alias("_a"), F.col(predicted).cast("double").alias("_p"), names.alias("_s"))
    on, said = F.col("_a") >= threshold, F.col("_p") >= threshold
    x = x.withColumn("stratum", F.explode("_s"))
    n = lambda c: F.count(F.when(c, 1))
    hourly = x.groupBy("appliance", "_home", "stratum", "_hour").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.abs(F.col("_p") - F.col("_a"))).alias("abs_error"), F.sum("_a").alias("actual_sum"), F.sum("_p").alias("predicted_sum"), n(on & said).alias("tp"), n(~on & said).alias("fp"), n(on & ~said).alias("fn")
    )
    hourly = hourly.withColumn("hour_abs_error", F.abs(F.col("predicted_sum") - F.col("actual_sum")) / F.col("count")).withColumn("hours", F.lit(1))
    both = F.explode(F.array(F.col("_home"), F.lit("ALL"))).alias("home")
    sums = ["count", "abs_error", "actual_sum", "predicted_sum", "tp", "fp", "fn", "hour_abs_error", "hours"]
    own = hourly.groupBy("appliance", "_home", "stratum").agg(*[F.sum(c).alias(c) for c in sums])
    return own.select("appliance", both, "stratum", *sums).groupBy("appliance", "home", "stratum").agg(*[F.sum(c).alias(c) for c in sums])


def merge_buckets(parts: DataFrame) -> DataFrame:
    """Buckets of several parts (other homes or other hours) as one."""
    return parts.groupBy("appliance", "home", "stratum").agg(*[F.sum(c).alias(c) for c in parts.columns if c not in ("appliance", "home", "stratum")])


def bucket_metrics(buckets: DataFrame) -> DataFrame:
    """mae, energy error in percent, precision, recall, f1, hourly mae."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return buckets.select(
        "appliance", "home", "stratum", "count", "hours", (F.col("abs_error") / F.col("count")).alias("mae"), (F.abs(F.col("predicted_sum") - F.col("actual_sum")) / F.nullif(F.col("actual_sum"), F.lit(0.0)) * 100).alias("energy_error_pct"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (F.col("hour_abs_error") / F.col("hours")).alias("hourly_mae"),
    )


def metric_differences(metrics: DataFrame, on: Sequence[str], method: str, first: str, second: str, measures: Sequence[str]) -> DataFrame:
    """Each measure of the second method less that of the first, row by row of ``on``."""
    a = metrics.where(F.col(method) == first).select(*on, *[F.col(m).alias(f"_{m}") for m in measures])
    b = metrics.where(F.col(method) == second).select(*on, *measures)
    return b.join(a, list(on)).select(*on, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_difference") for m in measures])


def local_usual_window(slots: DataFrame, asks: DataFrame, client: str, ts: str, kw: str, event_days: DataFrame, *, most: int = 14, days: int = 60, hours: float = 0.5) -> DataFrame:
    """For each ask (ask_id, client, as_of, from_slot, to_slot): mean energy in the window over at most ``most`` latest days with readings there, up to ``days`` back, days with an event left out.

    The days of an ask lie in two blocks of ``days`` days, so that it is repeated twice and not
    once a day. Asks are as many as households: they are never broadcast, whatever their
    size is reckoned at before they are repeated.
    """
    index = F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)
    x = slots.select(client, F.to_date(ts).alias("date"), index.alias("_s"), F.col(kw).alias("_v")).where("_v is not null").join(F.broadcast(event_days.select("date").distinct()), "date", "left_anti")
    block = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    near = asks.withColumn("_to", F.to_date("as_of")).withColumn("_from", F.date_sub("_to", days))
    near = near.withColumn("_b", F.explode(F.sequence(block(F.col("_from")), block(F.date_sub("_to", 1)))))
    y = near.hint("merge").join(x.withColumn("_b", block(F.col("date"))), [client, "_b"])
    y = y.where((F.col("date") >= F.col("_from")) & (F.col("date") < F.col("_to")) & (F.col("_s") >= F.col("from_slot")) & (F.col("_s") < F.col("to_slot")))
    daily = y.groupBy("ask_id", client, "_b", "date").agg((F.sum("_v") * hours).alias("_e"))
    daily = daily.withColumn("_n", F.row_number().over(Window.partitionBy("ask_id", client).orderBy(F.desc("date")))).where(F.col("_n") <= most)
    return daily.groupBy("ask_id", client).agg(F.avg("_e").alias("usual_kwh"), F.count(F.lit(1)).alias("days"))


def window_lookback(daily: DataFrame, asks: DataFrame, client: str, *, most: int = 3, days: int = 10) -> DataFrame:
    """For each ask (ask_id, client, as_of): mean of ``kwh`` over at most ``most`` latest rows of ``daily`` (client, ended, kwh) whose window ended at or before as_of, up to ``days`` back."""
    near = asks.withColumn("_day", F.explode(F.sequence(F.date_sub(F.to_date("as_of"), days), F.to_date("as_of"))))
    x = near.join(daily.withColumn("_day", F.to_date("ended")), [client, "_day"]).where(F.col("ended") <= F.col("as_of"))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("ask_id", client).orderBy(F.desc("ended")))).where(F.col("_n") <= most)
    return x.groupBy("ask_id", client).agg(F.avg("kwh").alias("kwh"), F.count(F.lit(1)).alias("windows"))


def hot_days(daily: DataFrame, client: str, day: str, valid: Column, temperature: str, hot: float = 24.0) -> DataFrame:
    """The days warmer than ``hot`` on which every client of the table has a valid row."""
    clients = F.broadcast(daily.agg(F.count_distinct(client).alias("_all")))  # one row
    g = daily.groupBy(day).agg(F.count_distinct(F.when(valid, F.col(client))).alias("_n"), F.avg(temperature).alias("temperature"))
    return g.join(clients, F.lit(True)).where((F.col("_n") == F.col("_all")) & (F.col("temperature") > hot)).select(day, "temperature")


def name_clusters(means: DataFrame, rules: Sequence[tuple[str, str, bool]], rest: str = "medium") -> dict[int, str]:
    """cluster: name, from a table of cluster means (a row a cluster): each rule (name, measure, largest) takes the cluster that is most so among those left."""
    rows = {r["cluster"]: r for r in means.collect()}
    out = {}
    for name, measure, largest in rules:
        if rows:
            k = min(rows, key=lambda c: ((-1 if largest else 1) * rows[c][measure], c))
            out[k] = name
            del rows[k]
    return out | {k: rest if len(rows) == 1 else f"{rest} {i + 1}" for i, k in enumerate(sorted(rows))}


def silhouette(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """silhouette: mean over all rows, with squared Euclidean distances, from each cluster's count, sum and sum of squares: linear in the rows."""
    d = F.posexplode(vector).alias("_i", "_x")
    x = df.select(cluster, d)
    parts = x.groupBy(cluster, "_i").agg(F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"), F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy(cluster).agg(F.max("n").alias("n"), F.sum("q").alias("q"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "s"))), lambda e: e["s"]).alias("s"))
    rows = [(r[cluster], r["n"], r["q"], r["s"]) for r in parts.collect()]  # a row a cluster
    own, others = F.lit(None).cast("double"), []
    square = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v)
    for k, n, q, s in rows:
        dot = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in s]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        total = square * n + F.lit(float(q)) - dot * 2
        own = F.when(F.col(cluster) == k, F.when(F.lit(n > 1), total / max(n - 1, 1))).otherwise(own)
        others.append(F.when(F.col(cluster) != k, total / n))
    near = F.array_min(F.array(*others)) if others else F.lit(None).cast("double")
    value = F.when(own.isNull(), F.lit(0.0)).otherwise((near - own) / F.greatest(near, own, F.lit(1e-300)))
    return df.agg(F.avg(value).alias("silhouette"))


def chunked_inference(df: DataFrame, key: str, ts: str, value: str, model, *, context: int = 256, chunk_s: int = 86_400, name: str = "prediction") -> DataFrame:
    """key, ts, ``name``: a sequence model over series of any length, in time chunks that carry ``context - 1`` readings of the chunk before.

    model: values (n,) to answers (n,), where answer i may look back ``context - 1`` values.
    Readings with fewer readings or an unknown value in their context get null. A reading is
    sent to its own chunk and to the next one, so the readings of a chunk and of the one
    before must hold the context: contexts reaching further back get null, too.
    """
    width = chunk_s * MICROS
    x = df.select(key, F.col(ts).alias("ts"), F.col(value).cast("double").alias("v"), micros(ts).alias("_t")).where(f"{key} is not null and ts is not null")
    own = floor_to(F.col("_t"), width)
    x = x.withColumn("_c", F.explode(F.array(own, own + width))).withColumn("_own", F.col("_c") == own)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", kind="stable")
        mine = pdf["_own"].to_numpy()
        if not mine.any():
            return pdf.iloc[:0][[key, "ts"]].assign(**{name: pd.Series(dtype="float64")})
        v = pdf["v"].to_numpy("float64")
        first = max(int(np.flatnonzero(mine)[0]) - (context - 1), 0)
        pdf, v, mine = pdf.iloc[first:], v[first:], mine[first:]
        known = np.isfinite(v)
        full = np.convolve(known, np.ones(context, int))[: len(v)] == context
        y = np.where(full, np.asarray(model(np.where(known, v, 0.0)), dtype="float64"), np.nan)
        out = pdf.loc[mine, [key, "ts"]].copy()
        out[name] = pd.array(y[mine], dtype="Float64")
        out.loc[np.isnan(y[mine]), name] = pd.NA
        return out

    schema = T.StructType([df.schema[key], T.StructField("ts", df.schema[ts].dataType), T.StructField(name, T.DoubleType())])
    return x.groupBy(key, "_c").applyInPandas(run, schema)
