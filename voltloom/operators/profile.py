"""Household profiles from half-hour series: habits, responses, comparison with similar households, savings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.joins import lookup_join
from voltloom.operators.ordering import order_statistics, value_counts
from voltloom.session import cut


def natural_days(df: DataFrame, day: str, event_days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Without the days that an event (of the same keys) touches (anti-join on keys and date)."""
    return df.join(event_days.select(*keys, F.col(day)).distinct(), [*keys, day], "left_anti")


def event_days(events: DataFrame, start: str, end: str, name: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Every date touched by an event (per keys)."""
    return events.select(*keys, F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias(name)).distinct()


def household_features(slots: DataFrame, client: str, ts: str, kw: str, temperature: str | None = None, *, hours: float = 0.5, least_slots: int = 40, hot: float = 24.0, least_days: int = 10) -> DataFrame:
    """Per household: annual_kwh (mean daily energy of full days times 365), peak (P99), base (P05), load_factor, evening_share, cooling slope on hot days."""
    x = slots.where(F.col(kw).isNotNull()).withColumn("_d", F.to_date(ts)).withColumn("_h", F.hour(ts))
    daily = x.groupBy(client, "_d").agg(F.sum(kw).alias("s"), F.count(kw).alias("n"), *([F.avg(temperature).alias("t")] if temperature else []))
    full = daily.where(F.col("n") >= least_slots).withColumn("kwh", F.col("s") * hours)
    slope = F.when((F.count(F.when(F.col("t") > hot, 1)) >= least_days), F.regr_slope(F.when(F.col("t") > hot, F.col("kwh")), F.when(F.col("t") > hot, F.col("t")))) if temperature else F.lit(None).cast("double")
    year = full.groupBy(client).agg((F.avg("kwh") * 365).alias("annual_kwh"), F.count(F.lit(1)).alias("days"), *([slope.alias("cooling_kwh_per_deg"), F.count(F.when(F.col("t") > hot, 1)).alias("hot_days")] if temperature else []))
    shape = x.groupBy(client).agg(F.percentile(kw, F.lit(0.99)).alias("peak_kw"), F.percentile(kw, F.lit(0.05)).alias("base_load_kw"), F.avg(kw).alias("_m"), (F.sum(F.when(F.col("_h").between(18, 21), F.col(kw)).otherwise(0.0)) / F.nullif(F.sum(kw), F.lit(0.0))).alias("evening_share"))
    y = shape.join(year, client, "left").withColumn("load_factor", F.when(F.col("peak_kw") > 0, F.col("_m") / F.col("peak_kw")))
    return y.drop("_m")


def usual_window(slots: DataFrame, asks: DataFrame, client: str, ts: str, kw: str, *, days: int = 28, hours: float = 0.5) -> DataFrame:
    """For each ask (ask_id, client, as_of, from_slot, to_slot): usual energy in the time-of-day window over the days before as_of.

    The window may pass midnight. The sum is divided by all distinct days of the look-back
    on which the household has readings, also days without readings in the window.
    """
    x = slots.select(client, F.to_date(ts).alias("_d"), (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).alias("_s"), F.col(kw).alias("_v")).where("_v is not null")
    y = asks.withColumn("_d", F.explode(F.sequence(F.date_sub(F.to_date("as_of"), days), F.date_sub(F.to_date("as_of"), 1))))
    z = y.join(x, [client, "_d"])
    s = F.col("_s")
    inside = F.when(F.col("from_slot") <= F.col("to_slot"), (s >= F.col("from_slot")) & (s < F.col("to_slot"))).otherwise((s >= F.col("from_slot")) | (s < F.col("to_slot")))
    g = z.groupBy("ask_id", client).agg((F.sum(F.when(inside, F.col("_v")).otherwise(0.0)) * hours / F.count_distinct("_d")).alias("usual_kwh"), F.count_distinct("_d").alias("days"))
    return asks.select("ask_id", client).join(g, ["ask_id", client], "left")


def acceptance(events: DataFrame, answers: DataFrame, as_of: Column) -> DataFrame:
    """Per household: invitations and acceptance rate over the events that ended by as_of."""
    past = events.where(F.col("end_ts") <= as_of).select("event_id").distinct()
    x = answers.join(past, "event_id", "left_semi")
    return x.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_invitations"), F.avg(F.coalesce(F.col("response") == "accept", F.lit(False)).cast("double")).alias("acceptance_rate"))


def month_position(daily: DataFrame, client: str, day: str, kwh: str, as_of: Column) -> DataFrame:
    """month_to_date_kwh and the month's projection: its daily rate so far, or that of the last 30 days if fewer than three days have passed."""
    first = F.trunc(as_of, "MM")
    elapsed = F.datediff(as_of, first)
    length = F.dayofmonth(F.last_day(as_of))
    d = F.col(day)
    g = daily.where((d < as_of) & (d >= F.date_sub(first, 30))).groupBy(client).agg(
        F.coalesce(F.sum(F.when(d >= first, F.col(kwh))), F.lit(0.0)).alias("month_to_date_kwh"), (F.sum(F.when(d >= F.date_sub(as_of, 30), F.col(kwh))) / 30).alias("_rate")
    )
    return g.withColumn("projected_month_kwh", F.when(elapsed < 3, F.col("_rate") * length).otherwise(F.col("month_to_date_kwh") + F.col("month_to_date_kwh") / elapsed * (length - elapsed))).drop("_rate")


def group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds the group's median and the row's difference from it in percent; NaN counts as missing, a null group has no median.

    Medians come from counted values sorted in ranges, so a group may hold any share of the rows.
    """
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    counts = cut(value_counts(df.where(F.col(group).isNotNull()), [group], v))
    mid = order_statistics(counts, group, [0.5]).select(group, F.col("value").alias("group_median"))
    x = lookup_join(df, mid, [group])
    return x.withColumn("vs_group_pct", F.when(F.col("group_median") > 0, (v / F.col("group_median") - 1) * 100))


def comparison_text(pct: Column, band: float = 5.0) -> Column:
    """A sentence for the difference; empty where it is unknown."""
    n = F.format_string("%.0f", F.abs(pct))
    return F.when(pct.isNull(), "").when(F.abs(pct) <= band, "about the same as similar households").when(pct > 0, F.concat(n, F.lit("% above similar households"))).otherwise(F.concat(n, F.lit("% below similar households")))


def segment_profiles(slots: DataFrame, segments: DataFrame, client: str, ts: str, kw: str) -> DataFrame:
    """Mean of means: first over the households of a segment per slot, then by season, kind of day and half hour."""
    from voltloom.operators.timegrid import day_type, season, slot_index

    x = slots.join(segments, client).groupBy("segment", ts).agg(F.avg(kw).alias("kw"))
    return x.groupBy("segment", season(F.col(ts)).alias("season"), day_type(F.col(ts)).alias("day_type"), slot_index(F.col(ts)).alias("slot_index")).agg(F.avg("kw").alias("mean_kw"), F.count("kw").alias("slots"))


def savings(windows: DataFrame, by: Sequence[str] = ("event_id", "segment")) -> DataFrame:
    """Ratio estimator of what accepters saved in an event.

    windows: event_id, segment, client_id, response, pre_kwh (before), actual_kwh (during).
    Peers are the non-accepters of the same event and segment; their ratio of event to
    earlier energy times the accepters' earlier energy is the baseline. Without peers, or
    where their earlier energy is zero, the event's ratio over all segments is used.
    """
    ok = windows.where(F.col("pre_kwh").isNotNull() & F.col("actual_kwh").isNotNull())
    took = F.coalesce(F.col("response") == "accept", F.lit(False))
    s = lambda c, v: F.sum(F.when(c, F.col(v)))
    n = lambda c: F.count(F.when(c, 1))
    g = ok.groupBy(*by).agg(n(took).alias("accepters"), n(~took).alias("peers"), s(took, "pre_kwh").alias("a_pre"), s(took, "actual_kwh").alias("actual_kwh"), s(~took, "pre_kwh").alias("p_pre"), s(~took, "actual_kwh").alias("p_act"))
    e = ok.where(~took).groupBy("event_id").agg((F.sum("actual_kwh") / F.nullif(F.sum("pre_kwh"), F.lit(0.0))).alias("event_ratio"))
    own = F.when(F.col("peers") > 0, F.col("p_act") / F.nullif(F.col("p_pre"), F.lit(0.0)))
    x = g.where("accepters > 0").join(e, "event_id", "left").withColumn("ratio", F.coalesce(own, "event_ratio"))
    x = x.withColumn("baseline_kwh", F.col("ratio") * F.col("a_pre")).withColumn("saved_kwh", F.col("baseline_kwh") - F.col("actual_kwh"))
    return x.select(*by, "accepters", "peers", F.when(F.col("peers") > 0, "segment").otherwise("event_fallback").alias("source"), "baseline_kwh", "actual_kwh", "saved_kwh")


def ranked_reduction(df: DataFrame, by: Sequence[str], priority: str, usage: str, expected: str, need: str | None = None) -> DataFrame:
    """rank (priority up, usage down, client_id), cumulative expected reduction and whether the need is covered at the rank."""
    w = Window.partitionBy(*by).orderBy(F.col(priority).asc_nulls_last(), F.col(usage).desc_nulls_last(), "client_id")
    x = df.withColumn("rank", F.row_number().over(w)).withColumn("cumulative", F.sum(F.coalesce(F.col(expected), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("covers", F.col("cumulative") >= F.col(need)) if need else x


def top_share_capture(df: DataFrame, by: str, rank: str, truth: str, share: float = 0.5) -> DataFrame:
    """How much of the truth the first ``share`` of each ranked list holds."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    x = df.withColumn("_top", F.col(rank) <= F.bround(n * share))
    g = x.groupBy(by).agg(F.sum(truth).alias("_all"), F.sum(F.when(F.col("_top"), F.col(truth))).alias("_got"))
    return g.where("_all > 0").select(by, (F.col("_got") / F.col("_all")).alias("captured"))
