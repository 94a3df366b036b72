"""Mixing sources to target weights by weighted fair queueing.

The documents of each source stand in a shuffled queue, the whole queue again for each
allowed repetition. A document's virtual finish time is the source's tokens up to and
with it, divided by the source's target weight. The documents of all sources are
range-sorted by it and cut off where their running total passes the budget: at virtual
time T a source with enough tokens has sent its weight times T, and where a source runs
out the others go on in their proportions until the budget is full.

Scale: the running sums come from distributed sorts with offsets per range, so that a
source with a third of all documents is sorted in many tasks. The final virtual time
follows from the sums of the sources (one row a source of the plan), so that only the
repetitions which can come before it are written out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from voltloom.operators.ordering import hash_bucket, running_totals

#: A plan is a hand-written table; it is collected and broadcast within this bound.
MOST_SOURCES = 10_000


def board(c: Column) -> Column:
    """A source's name without case and surrounding blanks."""
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def final_time(queues: Sequence[tuple[float, float]], budget: float) -> float:
    """The virtual time at which queues of (share, most they can send) have sent the budget, or all they have."""
    ends = sorted((most / share, share) for share, most in queues if share > 0 and most > 0)
    rate, sent, now = sum(share for _, share in ends), 0.0, 0.0
    for end, share in ends:
        if sent + rate * (end - now) >= budget:
            break
        sent, now, rate = sent + rate * (end - now), end, rate - share
    else:
        return now
    return now + (budget - sent) / rate


def mix(docs: DataFrame, doc: Column, source: Column, size: Column, plan: DataFrame, *, budget: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    plan: source, target_share, max_repeats. budget: total size (None: that of all
    documents of the plan's sources, each once).

    mixture: doc_id, source (the plan's name), repeat (1 is the first use), size,
    finish (virtual time), sorted by finish. Its total is within half a document of the
    budget, or all that the repeats allow.
    report: source, target_share (scaled), actual_share (of the mixture), documents,
    size_once, size_used, most_size (each document used max_repeats times), reached (false
    if the mixture took the source's whole queue, repeats included, and it ended before the
    virtual time at which the source would have sent its share of the budget).

    Shares are scaled to sum to one. Defined cases: documents of other sources, or with a null id or source, take no part;
    a document listed twice is used twice as often; sizes null or below zero count as zero;
    null or non-positive shares or repeats give nothing; sources without documents are
    reported with zero; an empty plan, or a budget of zero, gives no mixture. The document
    that passes the budget is kept if that comes nearer to it than leaving it out.
    """
    p = plan.select(F.col("source").alias("name"), board(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("most"))
    p = p.where("source is not null").dropDuplicates(["source"])
    spark = docs.sparkSession
    rows = p.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a plan names at most {MOST_SOURCES} sources")
    scale = sum(r["share"] for r in rows) or 1.0
    rows = [Row(name=r["name"], source=r["source"], share=r["share"] / scale, most=r["most"]) for r in rows]
    p = spark.createDataFrame([tuple(r) for r in rows], "name string, source string, share double, most int")
    x = docs.select(doc.alias("doc_id"), board(source).alias("source"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size")).where("doc_id is not null and source is not null")
    x = x.join(F.broadcast(p), "source")
    once = x.groupBy("source").agg(F.sum("size").alias("once"), F.count(F.lit(1)).alias("documents")).collect()
    sums = {r["source"]: (r["once"], r["documents"]) for r in once}  # one row a source of the plan
    total = float(budget if budget is not None else sum(a for a, _ in sums.values()))
    end = final_time([(r["share"], r["most"] * sums.get(r["source"], (0, 0))[0]) for r in rows], total)
    own = spark.createDataFrame([(s, a, n) for s, (a, n) in sums.items()], "source string, once long, documents long")
    x = x.join(F.broadcast(own.drop("documents")), "source")
    # one pass more than the final time needs, as the document that passes the budget ends after it
    passes = F.when(F.col("once") > 0, F.least(F.col("most"), F.ceil(F.col("share") * end / F.col("once")).cast("int") + 1)).otherwise(1)
    x = x.where("share > 0 and most > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), passes)))
    x = x.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "repeat"))
    x = x.withColumn("bucket", hash_bucket(x, "h", F.col("repeat")))
    x = running_totals(x, "source", "bucket", ["h", "doc_id"], "size").drop("whole", "bucket")
    x = x.withColumn("finish", F.col("upto") / F.col("share")).drop("upto")
    # ranges of equal virtual time hold about equal sizes
    pieces = 4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = x.withColumn("all", F.lit(0)).withColumn("range", F.least(F.floor(F.col("finish") / F.lit(end or 1.0) * pieces), F.lit(pieces)).cast("int"))
    x = running_totals(x, "all", "range", ["finish", "source", "doc_id", "repeat"], "size").where(F.col("upto") - F.col("size") / 2 <= total)
    if total <= 0:
        x = x.limit(0)
    mixture = x.select("doc_id", F.col("name").alias("source"), "repeat", "size", "finish").repartitionByRange("finish").sortWithinPartitions("finish", "doc_id")
    used = x.groupBy("source").agg(F.sum("size").alias("used"), F.max("finish").alias("last"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    r = p.join(own, "source", "left").join(used, "source", "left")
    sent = F.sum(zero("used")).over(Window.partitionBy())  # a row a source
    most = zero("once") * F.col("most")
    ended = (zero("used") == most) & (F.coalesce("last", F.lit(0.0)) < F.lit(total)) & (F.col("share") > 0)
    report = r.select(
        F.col("name").alias("source"), F.col("share").alias("target_share"), F.round(zero("used") / F.greatest(sent, F.lit(1)), 9).alias("actual_share"),
        zero("documents").alias("documents"), zero("once").alias("size_once"), zero("used").alias("size_used"), most.cast("bigint").alias("most_size"), (~ended).alias("reached"),
    )
    return mixture, report
