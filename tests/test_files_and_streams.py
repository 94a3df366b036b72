"""Readers, writers and streaming forms."""

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltloom.operators.islands import equal_runs
from voltloom.sources.files import detect_columns, digest, extract_member, file_inventory, parquet_inventory, read_csv, read_meters, require_files
from voltloom.sources.sinks import append_table, json_safe, replace_table, table_checksum, write_csv, write_delta_times, write_parquet
from voltloom.streaming.power import drain, streaming_equal_runs


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5, datetime(2025, 1, 1)), (2, None, None, None)], "i int, s string, v double, t timestamp_ntz")
    write_csv(df, str(tmp_path / "x"), single=True)
    got = read_csv(spark, str(tmp_path / "x"), "i int, s string, v double, t timestamp_ntz").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "a", 2.5, datetime(2025, 1, 1)), (2, None, None, None)]
    assert detect_columns(spark.read.option("header", True).csv(str(tmp_path / "x"))) == ("t", ["i", "v"])


def test_meter_scan_pushes_filters(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2025, 1, 1, h), f"C{h % 2}", float(h)) for h in range(10)], "timestamp timestamp_ntz, client_id string, w double")
    path = str(tmp_path / "m")
    write_parquet(df, path, order=["client_id", "timestamp"])
    x = read_meters(spark, [path], client="C1", start="2025-01-01 03:00:00", end="2025-01-01 07:00:00", columns=["timestamp", "w"])
    assert sorted(r.w for r in x.collect()) == [3.0, 5.0]
    plan = x._jdf.queryExecution().toString()
    assert "EqualTo(client_id,C1)" in plan and "GreaterThanOrEqual(timestamp" in plan
    with pytest.raises(ValueError):
        read_meters(spark, [path], client="x' or 1")
    replace_table(df.limit(3), path)
    assert spark.read.parquet(path).count() == 3
    assert sum(r.rows for r in parquet_inventory(spark, [path]).collect()) == 3
    assert file_inventory(spark, [path, path + "?"]).where("not exists").count() == 1
    with pytest.raises(FileNotFoundError):
        require_files(spark, [path, "/nowhere"])


def test_archive_members_stay_inside(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "1")
        z.writestr("../y.csv", "1")
    path = extract_member(str(tmp_path / "a.zip"), "d/x.csv", str(tmp_path / "out"))
    assert len(digest(path)) == 64
    with pytest.raises(ValueError):
        extract_member(str(tmp_path / "a.zip"), "../y.csv", str(tmp_path / "out"))


def test_json_has_no_nan(spark):
    df = spark.createDataFrame([(float("nan"), datetime(2025, 1, 1), "a")], "v double, t timestamp_ntz, s string")
    assert json_safe(df).first().json == '{"v":null,"t":"2025-01-01T00:00:00+01:00","s":"a"}'


def test_streamed_runs_equal_batch_runs(spark, tmp_path):
    v = [1.0] * 5 + [2.0] * 25 + [3.0] + [4.0] * 20 + [5.0] * 3
    rows = [(k, datetime(2025, 1, 1) + timedelta(minutes=i), x) for k in ("a", "b") for i, x in enumerate(v)]
    path = str(tmp_path / "s")
    for i in range(0, len(v), 20):  # files in time order, a few rows of each key in each
        part = [r for r in rows if i <= (r[1] - datetime(2025, 1, 1)).seconds // 60 < i + 20]
        spark.createDataFrame(part, "k string, t timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(path)
    got = drain(spark, path, lambda s: streaming_equal_runs(s, "k", "t", "v", 20), files_per_batch=1)
    assert sorted((r.k, r.value, r.length) for r in got.collect()) == [("a", 2.0, 25), ("a", 4.0, 20), ("b", 2.0, 25), ("b", 4.0, 20)]
    batch = equal_runs(spark.read.parquet(path), ["k"], "t", "v", 20).where("frozen").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    assert sorted((r.k, r.v, r.n) for r in batch.collect()) == sorted((r.k, r.value, r.length) for r in got.collect())


def test_replacing_a_table_verifies_and_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    first, second = spark.range(10), spark.range(5, 30).repartition(3)
    assert replace_table(first, path).first().backup is None
    m = replace_table(second, path, keep_backup=True).first()
    assert (m.path, m.rows) == (path, 25) and spark.read.parquet(m.backup).count() == 10
    assert m.checksum == table_checksum(spark.range(5, 30)).first().checksum == table_checksum(spark.read.parquet(path)).first().checksum
    append_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 28
    assert table_checksum(first.limit(0)).first().rows == 0


def test_times_are_written_as_differences(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "d")
    df = spark.range(5000).selectExpr("cast(timestamp_seconds(1700000000 + id * 60) as timestamp_ntz) as ts", "cast(id % 7 as double) as v")
    write_delta_times(df, path, ["ts"], ["ts"])
    meta = pq.read_metadata(sorted(glob.glob(path + "/*.parquet"))[0]).row_group(0)
    encodings = {meta.column(i).path_in_schema: meta.column(i).encodings for i in range(2)}
    assert "DELTA_BINARY_PACKED" in encodings["ts"] and "DELTA_BINARY_PACKED" not in encodings["v"]
    assert spark.read.parquet(path).exceptAll(df).count() == 0
