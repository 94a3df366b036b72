"""Streaming forms of the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltloom.session import checkpoint_folder


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Naive times cannot carry a watermark: they are read as instants under the session's UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def streaming_means(stream: DataFrame, key: str, ts: str, value: str, *, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """Mean power and energy per key and slot; a slot is final once the watermark has passed its end."""
    x = with_event_time(stream, ts, delay).groupBy(key, F.window(ts, f"{minutes} minutes").alias("w")).agg(F.avg(value).alias("mean"))
    return x.select(key, F.col("w.start").cast("timestamp_ntz").alias("slot"), "mean", (F.col("mean") * (minutes / 60)).alias("energy"))


def streaming_distinct(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first of the rows with equal keys that arrive within the watermark."""
    return with_event_time(stream, ts, delay).dropDuplicatesWithinWatermark(keys)


def streaming_equal_runs(stream: DataFrame, key: str, ts: str, value: str, least: int = 20) -> DataFrame:
    """key, value, start, last, length whenever a run of at least ``least`` equal readings ends.

    Within a micro-batch readings are taken in time order; the state of a key is its open run.
    """
    x = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v")).where("v is not null")

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v, a, b, n = state.get if state.exists else (None, None, None, 0)
        out = []
        for t, y in sorted((r for f in batches for r in zip(f["t"].tolist(), f["v"].tolist(), strict=True)), key=lambda r: r[0]):
            if n and y == v:
                b, n = t, n + 1
                continue
            if n >= least:
                out.append((k[0], v, a, b, n))
            v, a, b, n = y, t, t, 1
        if n:
            state.update((v, a, b, n))
        yield pd.DataFrame(out, columns=["key", "v", "a", "b", "n"])

    y = x.groupBy("key").applyInPandasWithState(run, "key string, v double, a long, b long, n long", "v double, a long, b long, n long", "append", GroupStateTimeout.NoTimeout)
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return y.select(F.col("key").alias(key), F.col("v").alias("value"), time(F.col("a")).alias("start"), time(F.col("b")).alias("last"), F.col("n").alias("length"))


def drain(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], files_per_batch: int = 8) -> DataFrame:
    """Runs a streaming query over everything in ``path`` and returns what it wrote (append mode) from the shared folder."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/voltloom-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        source = reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    else:
        source = reader.parquet(path)
    q = build(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
