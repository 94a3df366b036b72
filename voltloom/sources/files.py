"""Readers of delimited and parquet files, column detection, inventories."""

from __future__ import annotations

import hashlib
import os
import re
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID_SCHEMA = "timestamp timestamp_ntz, region_id string, temperature_c double, is_holiday int, is_ramadan int, households_consumption_kw double, steg_production_kw double, pv_production_kw double, is_dr_event int, is_dr_peak int"
METER_SCHEMA = "timestamp timestamp_ntz, client_id string, aggregate_power_w double, ac_power_w double, water_heater_power_w double, washing_machine_power_w double"
HOUSEHOLD_SCHEMA = "client_id string, region_id string, n_occupants int, has_ac boolean, has_second_ac boolean, has_electric_water_heater boolean, water_heater_kw double, has_washing_machine boolean, occupied_daytime boolean, has_submeter boolean"
EVENT_SCHEMA = "event_id int, region_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, surcharge_level int, reduction_target_pct int"
PARTICIPATION_SCHEMA = "event_id int, client_id string, response string"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A delimited file with a header, read with its schema; cells that do not parse become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_meters(spark: SparkSession, paths: Sequence[str], *, client: str | None = None, start: str | None = None, end: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Household readings of one or all clients in a half-open time range; filter and columns reach the scan."""
    df = spark.read.parquet(*paths)
    if client is not None:
        if not re.fullmatch(r"[A-Z]\d+", client):
            raise ValueError(f"not a household id: {client!r}")
        df = df.where(F.col("client_id") == client)
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("timestamp") < F.lit(end).cast("timestamp_ntz"))
    return df.select(*columns) if columns else df


def detect_columns(df: DataFrame, time_names: Sequence[str] = ("timestamp", "datetime", "date", "time", "ts"), least: float = 0.8) -> tuple[str | None, list[str]]:
    """(time column, numeric columns): by name first, then by the share of values that parse, in one pass."""
    plain = {c: c.strip().lower().replace("-", "_").replace(" ", "_") for c in df.columns}
    text = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    rates = text.agg(*[F.coalesce(F.count(F.col(f"`{c}`").try_cast(t)) / F.nullif(F.count(f"`{c}`"), F.lit(0)), F.lit(0.0)).alias(f"{t}:{c}") for c in df.columns for t in ("timestamp", "double")]).first()
    numeric = [c for c in df.columns if rates[f"double:{c}"] >= least]
    times = [c for c in df.columns if c not in numeric and rates[f"timestamp:{c}"] >= least]
    named = [c for n in time_names for c in df.columns if plain[c] == n and c in times]
    return (named or times or [None])[0], numeric


def extract_member(archive: str, member: str, folder: str) -> str:
    """The path of a member written out of a zip file; names that would leave the folder are refused."""
    target = os.path.realpath(os.path.join(folder, member))
    if not target.startswith(os.path.realpath(folder) + os.sep):
        raise ValueError(f"unsafe member name: {member!r}")
    with zipfile.ZipFile(archive) as z:
        return z.extract(member, folder)


def _size(spark: SparkSession, path: str) -> int | None:
    """Bytes under a path on any file system; None where there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def require_files(spark: SparkSession, paths: Sequence[str]) -> None:
    missing = [p for p in paths if _size(spark, p) is None]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def file_inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, exists, megabytes."""
    sizes = [(p, _size(spark, p)) for p in paths]
    return spark.createDataFrame([(p, n is not None, None if n is None else n / 1e6) for p, n in sizes], "path string, exists boolean, megabytes double")


def parquet_inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, rows, row_groups, columns from the footers, without reading data."""
    import pyarrow.parquet as pq

    rows = []
    for p in paths:
        for f in [p] if os.path.isfile(p) else sorted(os.path.join(p, x) for x in os.listdir(p) if x.endswith(".parquet")):
            m = pq.read_metadata(f)
            rows.append((f, m.num_rows, m.num_row_groups, m.schema.to_arrow_schema().names))
    return spark.createDataFrame(rows, "path string, rows long, row_groups int, columns array<string>")


def digest(path: str, length: int = 64) -> str:
    """SHA-256 of a file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()[:length]
