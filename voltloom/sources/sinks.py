"""Writers: parquet with tuned layout, CSV, JSON-safe rows, and replacement of a table as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *, by: Sequence[str] = (), order: Sequence[str] = (), row_group_bytes: int = 64 << 20, level: int = 9) -> None:
    """zstd parquet with dictionaries; sorted inside files so that row-group statistics prune."""
    x = df.sortWithinPartitions(*order) if order else df
    w = x.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("parquet.block.size", str(row_group_bytes)).option("parquet.enable.dictionary", "true")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> None:
    """CSV with a header and blanks for nulls; ``single`` is for small reports only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def json_safe(df: DataFrame, offset: str = "+01:00") -> DataFrame:
    """One column ``json``: NaN and infinities as null, times with their offset."""
    cols = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            v = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
        elif t.startswith("timestamp"):
            v = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))
        else:
            v = F.col(c)
        cols.append(v.alias(c))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_delta_times(df: DataFrame, path: str, times: Sequence[str], order: Sequence[str] = ()) -> None:
    """Parquet of the second format version, with the listed time columns as differences (DELTA_BINARY_PACKED) instead of dictionaries; sorted files make the differences small."""
    x = df.sortWithinPartitions(*order) if order else df
    w = x.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for c in times:
        w = w.option(f"parquet.enable.dictionary#{c}", "false")
    w.parquet(path)


def append_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Rows added to a table of files; the columns must be those it has."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def table_checksum(df: DataFrame) -> DataFrame:
    """rows, checksum: a sum of row hashes, the same in any order and any layout of files."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum"))


def _files(spark: SparkSession, path: str):
    """(the Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, *, keep_backup: bool = False) -> DataFrame:
    """Writes beside the table, verifies what was written, and renames, so that readers see the old or the new one. Returns the manifest.

    manifest: path, rows, checksum, backup (the path of the old table, kept until the new one
    stands, and after that only with ``keep_backup``; null without an old table). What was
    written must have the rows and checksum of ``df``, else nothing is replaced. Works on any
    file system whose rename moves a folder.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fresh, backup = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.parquet(fresh)
    want, got = df.transform(table_checksum).first(), spark.read.parquet(fresh).select(*df.columns).transform(table_checksum).first()
    (fresh_path, fs), (at, _), (old, _) = _files(spark, fresh), _files(spark, path), _files(spark, backup)
    if tuple(want) != tuple(got):
        fs.delete(fresh_path, True)
        raise RuntimeError(f"{path}: wrote {tuple(got)}, not {tuple(want)}; the table stays as it was")
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise RuntimeError(f"{path}: the old table could not be moved")
    if not fs.rename(fresh_path, at):
        if had:
            fs.rename(old, at)
        raise RuntimeError(f"{path}: the new table could not be moved; the old one is back")
    if had and not keep_backup:
        fs.delete(old, True)
    return spark.createDataFrame([(path, got["rows"], got["checksum"], backup if had and keep_backup else None)], "path string, rows long, checksum decimal(38,0), backup string")
