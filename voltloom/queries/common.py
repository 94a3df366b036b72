"""Views of the tables that the queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import TEMPERATURE_STAND_INS, canonical_id, measured
from voltloom.sources.tables import read

POWERS = ("households_consumption_kw", "steg_production_kw", "pv_production_kw")
FLAGS = ("is_holiday", "is_ramadan", "is_dr_event", "is_dr_peak")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to nine digits, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def grid(spark: SparkSession, d: str) -> DataFrame:
    """ts, region_id, temperature_c (measured), flags, powers."""
    t = measured(F.col("temperature_c"), TEMPERATURE_STAND_INS).alias("temperature_c")
    return read(spark, d, "grid_1min").select(F.col("timestamp").alias("ts"), "region_id", t, *FLAGS, *POWERS)


def meters(spark: SparkSession, d: str) -> DataFrame:
    """ts, client_id, kw: the exported household readings in kilowatts, measured ones only."""
    kw = (measured(F.col("aggregate_power_w")) / 1000).alias("kw")
    return read(spark, d, "households_1min_c001_c025").select(F.col("timestamp").alias("ts"), canonical_id("client_id").alias("client_id"), kw).where("kw is not null")


def half_hours(spark: SparkSession, d: str) -> DataFrame:
    """client_id, slot, kw: mean power per household and half hour with readings."""
    from voltloom.operators.timegrid import resample

    return resample(meters(spark, d), ["client_id"], "ts", ["kw"], dense=False, energy=False)


def daily(spark: SparkSession, d: str) -> DataFrame:
    """day, demand, supply, margin: a dense daily series from orders and line items."""
    a = read(spark, d, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("demand"))
    b = read(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("supply"))
    return a.join(b, "day").select("day", F.round("demand", 2).alias("demand"), F.round("supply", 2).alias("supply"), F.round(F.col("supply") - F.col("demand"), 2).alias("margin"))


def feeder(spark: SparkSession, d: str) -> DataFrame:
    """ts, value: hourly mean of the event stream."""
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.avg("value"), 6).alias("value"))


def one(c: str = "all") -> Column:
    """A constant key, for a series of one source."""
    return F.lit(1).alias(c)


_T = "CASE WHEN temperature_c IS NOT NULL AND NOT isnan(temperature_c) AND temperature_c NOT IN (-99.9, -127.0, 85.0, 999.9) THEN temperature_c END"
GRID = f'g AS (SELECT "timestamp" AS ts, region_id, {_T} AS temperature_c, is_holiday, is_ramadan, is_dr_event, is_dr_peak, households_consumption_kw, steg_production_kw, pv_production_kw FROM grid_1min)'
METERS = "m AS (SELECT \"timestamp\" AS ts, upper(regexp_replace(client_id, '[^\\p{L}\\p{Nd}]', '', 'g')) AS client_id, aggregate_power_w / 1000 AS kw FROM households_1min_c001_c025 WHERE aggregate_power_w IS NOT NULL AND NOT isnan(aggregate_power_w))"
HALF = METERS + ", h AS (SELECT client_id, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, avg(kw) AS kw FROM m GROUP BY 1, 2)"
DAILY = """d AS (SELECT day, round(demand, 2) AS demand, round(supply, 2) AS supply, round(supply - demand, 2) AS margin
  FROM (SELECT o_orderdate AS day, sum(o_totalprice) AS demand FROM orders GROUP BY 1) JOIN (SELECT l_shipdate AS day, sum(l_extendedprice) AS supply FROM lineitem GROUP BY 1) USING (day))"""
FEEDER = "f AS (SELECT date_trunc('hour', ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY 1)"
