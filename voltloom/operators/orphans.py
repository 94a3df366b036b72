"""References to records that do not exist.

A broadcast Bloom filter of the parents' keys proves most orphans at once: a key
the filter does not hold was never listed. Only the references it lets through
are joined, exactly and with the parents' life spans.

Scale: the filter has 16 bits a key, cut into shards of some 2,000 keys. Up to 32 MB
of shards are broadcast, beyond that references are routed to their shard. The
parents have one row a key, all life spans in an array, written once; up to 32 MB
of them are broadcast, too, else the join is salted by the measured share of each
hot key. References are scanned once: proven orphans go through the join under a
key of their own that matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions.bloom import bloom_filter, might_contain
from voltloom.operators.joins import lookup_join
from voltloom.session import cut


def life_spans(parents: DataFrame, key: Column, since: str | None, until: str | None) -> DataFrame:
    """key, spans: one row per parent key with its distinct (since, until) listings; until null is open."""
    none = F.lit(None).cast("timestamp_ntz")
    rows = parents.select(key.cast("string").alias("key"), (F.col(since) if since else none).alias("since"), (F.col(until) if until else none).alias("until"))
    return cut(rows.where("key is not null").groupBy("key").agg(F.collect_set(F.struct("since", "until")).alias("spans")))


def orphan_references(
    refs: DataFrame, record: str, key: Column, at: str, spans: DataFrame, *, blank: Column | None = None
) -> DataFrame:
    """The references without a live listing of their key at the record's time.

    Result: ``record_id``, ``key``, ``at``, ``reason`` ('never listed', 'not listed
    then'), one row per distinct record, key and time.

    A listing is live from ``since`` (null: always) until before ``until`` (null: for
    ever). Defined cases: a null key, or one for which ``blank`` holds, is no
    reference; a record without time is live if its key has any listing; repeated
    records count once; without parents every reference is an orphan; an empty table
    of references gives an empty result. Other columns are ignored.
    """
    x = refs.select(F.col(record).alias("record_id"), key.cast("string").alias("key"), F.col(at).alias("at"), (F.lit(False) if blank is None else blank).alias("blank"))
    x = x.where("key is not null and not blank").drop("blank")
    n = spans.count()
    maybe = might_contain(x, "key", bloom_filter(spans, "key", n), n)
    nowhere = F.concat(F.lit("\u0000"), F.xxhash64("record_id", "at").cast("string"))
    asked = maybe.withColumn("_key", F.when(F.col("_maybe"), F.col("key")).otherwise(nowhere))
    y = lookup_join(asked, spans.select(F.col("key").alias("_key"), "spans"), ["_key"])
    live = F.exists("spans", lambda s: F.col("at").isNull() | ((s["since"].isNull() | (s["since"] <= F.col("at"))) & (s["until"].isNull() | (F.col("at") < s["until"]))))
    gone = y.where(F.col("spans").isNull() | ~live)
    return gone.select("record_id", "key", "at", F.when(F.col("spans").isNull(), "never listed").otherwise("not listed then").alias("reason")).distinct()


def count_orphans(orphans: DataFrame, *by: str) -> DataFrame:
    """Orphans counted by the given columns and the month (yyyy-MM) of their time."""
    return orphans.groupBy(*by, F.date_format("at", "yyyy-MM").alias("period"), "reason").agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("key").alias("keys"))
