"""Queries of the data problems solved in the core, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import CONNECTION_LIMIT_W, POWER_STAND_INS, TEMPERATURE_STAND_INS, canonical_id, measured
from voltloom.operators.implausible import implausible_readings
from voltloom.operators.imputation import POWER_FIELDS, fill_power, fill_snapshots, fill_temperature, power_columns
from voltloom.operators.ordering import running_totals
from voltloom.operators.orphans import count_orphans, life_spans, orphan_references
from voltloom.operators.regular_grid import regular_grid
from voltloom.operators.trailing import trailing_totals
from voltloom.queries.problems_sql import SQL  # noqa: F401
from voltloom.sources.tables import read


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Silent minutes of both sources."""
    grids = [
        ("grid_1min", regular_grid(read(spark, d, "grid_1min"), ["region_id"], "timestamp", "households_consumption_kw"), "region_id"),
        ("partition_data", regular_grid(read(spark, d, "partition_data"), ["client_id"], "timestamp", "aggregate_w"), "client_id"),
    ]
    parts = [g.where("timestamp_gap").select(F.lit(t).alias("src_table"), F.col(k).alias("source_key"), F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot")) for t, g, k in grids]
    return parts[0].unionByName(parts[1])


def p2_region_minutes(spark: SparkSession, d: str) -> DataFrame:
    """One row per region and minute: load held between readings, silent minutes filled and marked."""
    x = regular_grid(read(spark, d, "grid_1min"), ["region_id"], "timestamp", "households_consumption_kw")
    return x.withColumn("value", F.round("value", 9))


def p2_region_temperature_minutes(spark: SparkSession, d: str) -> DataFrame:
    """One row per region and minute: measured temperature held between readings, silent minutes filled and marked."""
    x = read(spark, d, "grid_1min").withColumn("temperature_c", measured(F.col("temperature_c"), TEMPERATURE_STAND_INS))
    return regular_grid(x, ["region_id"], "timestamp", "temperature_c").withColumn("value", F.round("value", 9))


def _possible_watts(spark: SparkSession, d: str) -> DataFrame:
    """client_id, timestamp, aggregate_w: every row; null where the reading is unmeasured or impossible."""
    w = measured(F.col("aggregate_w"), POWER_STAND_INS)
    return read(spark, d, "partition_data").select("client_id", "timestamp", F.when((w >= 0) & (w <= CONNECTION_LIMIT_W), w).alias("aggregate_w"))


def p2_household_minutes(spark: SparkSession, d: str) -> DataFrame:
    """One row per household and minute: possible power held between readings, silent minutes filled and marked."""
    return regular_grid(_possible_watts(spark, d), ["client_id"], "timestamp", "aggregate_w").withColumn("value", F.round("value", 9))


def p2_register_minutes(spark: SparkSession, d: str) -> DataFrame:
    """One row per household and minute: increments of its register, the cumulative total of its readings in whole watts, which restarts every month."""
    x = _possible_watts(spark, d).where("client_id is not null and timestamp is not null").groupBy("client_id", "timestamp").agg(F.coalesce(F.round(F.max("aggregate_w")).cast("bigint"), F.lit(0)).alias("w"))
    x = x.withColumn("month", F.concat_ws(" ", "client_id", F.date_format("timestamp", "yyyy-MM"))).withColumn("day", F.to_date("timestamp"))
    x = running_totals(x, "month", "day", ["timestamp"], "w")
    return regular_grid(x, ["client_id"], "timestamp", "upto", kind="counter").withColumn("value", F.round("value", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that were not measured, as the imputation fills them."""
    x = p3_filled(spark, d)
    return x.select("src_table", "source_key", _ts("ts").alias("ts"), "field")


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    """The filled values themselves."""
    power = fill_power(read(spark, d, "partition_data"), read(spark, d, "households_info")).select(F.lit("partition_data").alias("src_table"), "*")
    heat = fill_temperature(read(spark, d, "grid_1min")).select(F.lit("grid_1min").alias("src_table"), "*")
    return power.unionByName(heat)


def p3_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots with unknown segments and evening usage filled."""
    return fill_snapshots(read(spark, d, "household_segments"))


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every sixteenth household reading hidden and filled again: how many there are, whether all came back, and whether their mean error (log scale) is below that of the mean of all readings."""
    x = read(spark, d, "partition_data").where("client_id is not null and timestamp is not null")
    once = x.groupBy("client_id", "timestamp").agg(F.count(F.lit(1)).alias("_n"), F.first("aggregate_w").alias("_w")).where("_n = 1")
    w = measured(F.col("_w"), POWER_STAND_INS)
    drawn = F.substring(F.md5(F.concat_ws("|", "client_id", _ts("timestamp"))), 1, 1) == "0"
    hidden = once.where(drawn & (w >= 0) & (w <= CONNECTION_LIMIT_W)).select("client_id", "timestamp", F.log1p("_w").alias("truth"))
    kept = x.join(hidden.withColumn("_hide", F.lit(True)), ["client_id", "timestamp"], "left").withColumn("aggregate_w", F.when(F.col("_hide").isNull(), F.col("aggregate_w")))
    filled = fill_power(kept, read(spark, d, "households_info")).where("field = 'aggregate_w'").select(F.col("source_key").alias("client_id"), F.col("ts").alias("timestamp"), "value")
    y = hidden.join(filled, ["client_id", "timestamp"], "left")
    mean = hidden.agg(F.avg("truth").alias("mean"))  # one row
    e = y.join(F.broadcast(mean), F.lit(True)).agg(F.count(F.lit(1)).alias("hidden"), F.count("value").alias("n"), F.avg(F.abs(F.log1p("value") - F.col("truth"))).alias("error"), F.avg(F.abs(F.col("mean") - F.col("truth"))).alias("plain"))
    return e.select("hidden", (F.col("n") == F.col("hidden")).alias("all_filled"), (F.col("error") < F.col("plain")).alias("better_than_mean"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Days without a measured reading, between the first and the last day with one."""
    return p4_trailing_power(spark, d).where("readings = 0").select(F.col("entity").alias("client_id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p4_trailing_power(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(read(spark, d, "households_1min_c001_c025"), canonical_id("client_id"), "timestamp", F.col("aggregate_power_w"))


def p4_trailing_partition(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(read(spark, d, "partition_data"), F.col("client_id"), "timestamp", measured(F.col("aggregate_w"), POWER_STAND_INS))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings the household's meter cannot truly have seen."""
    x = p6_flagged(spark, d)
    return x.select("client_id", _ts("ts").alias("ts"), "field").distinct()


def p6_flagged(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(read(spark, d, "partition_data"), "client_id", "timestamp", dict(zip(POWER_FIELDS, power_columns(), strict=True)))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    homes = life_spans(read(spark, d, "households_info"), canonical_id("client_id"), "registered_at", "closed_at")
    events = life_spans(read(spark, d, "dr_events"), F.col("event_id"), "loaded_at", "deleted_at")
    part, seg = read(spark, d, "dr_participation"), read(spark, d, "household_segments")

    def of_home(refs: DataFrame, record: str, at: str) -> DataFrame:
        own = F.coalesce(canonical_id("client_id"), F.when(F.col("client_id").isNotNull(), F.concat(F.lit("?"), F.col("client_id"))))
        return orphan_references(refs, record, own, at, homes, blank=F.trim("client_id") == "")

    found = [
        ("dr_participation", "event_id", orphan_references(part, "response_id", F.col("event_id"), "recorded_at", events)),
        ("dr_participation", "client_id", of_home(part, "response_id", "recorded_at")),
        ("household_segments", "client_id", of_home(seg, "snapshot_id", "as_of")),
    ]
    parts = [x.select(F.lit(t).alias("src_table"), F.lit(f).alias("ref_field"), "*") for t, f, x in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a live listing at their record's time."""
    return _p7(spark, d).select("src_table", "ref_field", "record_id", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field and month."""
    return count_orphans(_p7(spark, d), "src_table", "ref_field")


QUERIES = {f.__name__: f for f in (p2_found, p2_region_minutes, p2_region_temperature_minutes, p2_household_minutes, p2_register_minutes, p3_found, p3_filled, p3_snapshots, p3_masked, p4_found, p4_trailing_power, p4_trailing_partition, p6_found, p6_flagged, p7_found, p7_counts)}
