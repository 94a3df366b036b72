"""A Bloom filter over a column's values, cut into shards and made of built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.operators.joins import MOST_BYTES, spread_join

#: Words of 64 bits in a shard, keys a word and bits a key sets in its word: 16 bits of filter a key, at any number of keys.
WORDS, KEYS_A_WORD, SET_BITS = 512, 4, 5
SHARD_BYTES = 8 * WORDS + 32


def _places(c: Column, shards: int) -> tuple[Column, Column, Column]:
    """Shard, word in the shard, and mask of the bits that a value sets in the word."""
    h = F.xxhash64(c)
    shard = F.pmod(h, F.lit(shards)).cast("int")
    g = F.xxhash64(c, F.lit(1))
    word = F.pmod(g, F.lit(WORDS)).cast("int")
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(g, 10 + 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) for i in range(SET_BITS)]
    return shard, word, reduce(lambda x, y: x.bitwiseOR(y), bits)


def bloom_filter(keys: DataFrame, key: str, n: int) -> DataFrame:
    """shard, words: the filter of ``key``'s non-null values, of about ``n`` keys. A shard holds some 2,000 keys."""
    shard, word, mask = _places(F.col(key), shard_count(n))
    x = keys.where(F.col(key).isNotNull()).select(shard.alias("shard"), word.alias("word"), mask.alias("mask"))
    x = x.groupBy("shard", "word").agg(F.bit_or("mask").alias("mask"))
    held = F.map_from_entries(F.collect_list(F.struct("word", "mask")))  # at most WORDS a shard
    x = x.groupBy("shard").agg(held.alias("held"))
    return x.select("shard", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint"))).alias("words"))


def shard_count(n: int) -> int:
    return max(1, -(-n // (WORDS * KEYS_A_WORD)))


def might_contain(rows: DataFrame, key: str, shards: DataFrame, n: int, name: str = "_maybe") -> DataFrame:
    """Adds ``name``: false only if the value is certainly not among the filter's keys.

    The filter is broadcast where its shards take at most 32 MB (some 16 million keys);
    beyond that the rows are routed to their shards.
    """
    shard, word, mask = _places(F.col(key), shard_count(n))
    x = rows.withColumn("shard", shard)
    x = x.join(F.broadcast(shards), "shard", "left") if shard_count(n) * SHARD_BYTES <= MOST_BYTES else spread_join(x, shards, ["shard"], "left")
    hit = F.get("words", word).bitwiseAND(mask) == mask
    return x.withColumn(name, F.coalesce(hit, F.lit(False))).drop("shard", "words")
