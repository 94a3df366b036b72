"""Composite plans: the day-ahead replay over all days and regions at once, and household profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.operators.dayahead import issued_persistence
from voltloom.operators.intervals import best_overlap
from voltloom.operators.islands import risk_windows
from voltloom.operators.profile import group_median, household_features
from voltloom.operators.recommend import spaced_top
from voltloom.operators.timegrid import resample_covered, supply_margin


def day_ahead(grid: DataFrame, *, issue_hour: int = 14, safety: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forecast, windows, recommended) per region and target day.

    forecast: region_id, slot, each power as measured and as forecast, and both margins. A
    forecast is issued at ``issue_hour`` of the day before: half hours that had ended by then
    come from the day before, all others from two days before (only from half hours at least
    80 percent measured). safety: kilowatts of shortfall that do not count; below zero it is
    a reserve that must stay. windows: runs of forecast shortfall;
    recommended: at most two spaced windows a region and day.
    """
    powers = ["households_consumption_kw", "steg_production_kw", "pv_production_kw"]
    x = resample_covered(grid, ["region_id"], "ts", powers).select("region_id", "slot", *powers)
    y = issued_persistence(x, ["region_id"], "slot", powers, issue_hour=issue_hour)
    y = supply_margin(y, *powers).drop("available_supply_kw").withColumnRenamed("margin_kw", "actual_margin_kw")
    y = supply_margin(y, *[f"forecast_{p}" for p in powers]).drop("available_supply_kw").withColumnRenamed("margin_kw", "forecast_margin_kw")
    y = y.withColumn("day", F.to_date("slot"))
    windows = risk_windows(y, ["region_id", "day"], "slot", "forecast_margin_kw", safety=safety)
    key = F.struct("region_id", "day").alias("key")
    best = spaced_top(windows.select(key, "start", "end", F.col("shortage_energy").alias("size")), "key", "start", "end", "size")
    return y, windows, best.select("key.region_id", "key.day", "rank", "start", "end", "size")


def compare_windows(windows: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast windows against those of the measured margin: best overlap per measured window."""
    name = lambda df: df.select("region_id", F.concat_ws("|", "region_id", F.col("start").cast("string")).alias("id"), "start", "end")
    return best_overlap(name(actual), name(windows), ["region_id"])


def household_profiles(slots: DataFrame, segments: DataFrame) -> DataFrame:
    """Profile features of every household beside its segment's median yearly energy."""
    x = household_features(slots, "client_id", "slot", "kw", least_slots=8).join(segments, "client_id")
    return group_median(x, "segment", "annual_kwh")
