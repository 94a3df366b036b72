"""Joins that keep a hot key from filling one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a lookup that is broadcast, from its counted rows and the width of its columns.
MOST_BYTES = 32 << 20
#: Bytes a string, array or struct is reckoned at.
_WIDE = 64


def hot_keys(rows: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """on, _pieces: the keys that hold more than a shuffle partition's share of the rows, and how many such shares; None without one.

    At most as many keys as the session has shuffle partitions can do so.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    found = counts.join(F.broadcast(total), F.col("_c") * parts > F.col("_t"))  # one row
    found = found.select(*on, F.ceil(F.col("_c") * parts / F.col("_t")).cast("int").alias("_pieces")).collect()
    return rows.sparkSession.createDataFrame(found, rows.select(*on, F.lit(1).alias("_pieces")).schema) if found else None


def spread_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to a lookup, each hot key of ``rows`` spread over as many tasks as its measured share asks for.

    how: inner, left, left_semi or left_anti. Only the lookup's rows of hot keys are
    repeated. ``rows`` are counted per key first, so they should be a written table or a
    narrow scan. hot: the hot keys where they are known already.
    """
    hot = hot_keys(rows, on) if hot is None else hot
    if hot is None:
        return rows.join(lookup, list(on), how)
    few = F.broadcast(hot)  # at most a row a shuffle partition
    rest = [c for c in rows.columns if c not in on]
    h = F.xxhash64(*rest) if rest else F.monotonically_increasing_id()
    x = rows.join(few, list(on), "left").withColumn("_salt", F.pmod(h, F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    y = lookup.join(few, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return x.join(y, [*on, "_salt"], how).drop("_salt")


def row_bytes(df: DataFrame) -> int:
    """What a row of the table is reckoned at: 8 bytes a number, more for text and nested columns."""
    return sum(_WIDE if t == "string" or "<" in t else 8 for _, t in df.dtypes) + 16


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` joined to a lookup with one row a key: broadcast where its counted rows take at most ``most_bytes``, else spread. Both give the same rows."""
    most = most_bytes // row_bytes(lookup)
    if lookup.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(lookup), list(on), how)
    return spread_join(rows, lookup, on, how)
