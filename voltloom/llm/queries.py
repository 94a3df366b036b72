"""Queries of the problems in preparing training data, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.columns import POWER_STAND_INS, canonical_id, measured, split_name
from voltloom.llm.mixing import mix
from voltloom.llm.packing import pack
from voltloom.llm.percentiles import merge_counts, percentiles, value_counts
from voltloom.llm.quality import grade, text_statistics
from voltloom.llm.splits import deal, homes_of
from voltloom.llm.tokens import token_count
from voltloom.session import cut
from voltloom.sources.tables import read

PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _watts():
    return measured(F.col("aggregate_w"), POWER_STAND_INS)


def p1_partition_by_household(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(value_counts(read(spark, d, "partition_data"), F.col("client_id"), _watts()), PERCENTS, name="client_id")


def p1_partition_by_split(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(value_counts(read(spark, d, "partition_data"), split_name("split"), _watts()), PERCENTS, name="split")


def p1_partition_by_split_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same from counts per month, added up."""
    monthly = value_counts(read(spark, d, "partition_data"), split_name("split"), _watts(), F.date_format("timestamp", "yyyy-MM"))
    return percentiles(merge_counts(monthly), PERCENTS, name="split")


def p1_partition_by_split_rounded(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per split from counts of values rounded to within half a percent, and whether they lie within one percent of the exact ones."""
    counts = lambda e: value_counts(read(spark, d, "partition_data"), split_name("split"), _watts(), relative_error=e)
    near = percentiles(counts(0.01), PERCENTS, name="split").withColumnRenamed("value", "near")
    exact = percentiles(counts(0.0), PERCENTS, name="exact_split").withColumnsRenamed({"percent": "exact_percent", "values": "exact_values"})
    both = near.join(exact, F.col("split").eqNullSafe(F.col("exact_split")) & (F.col("percent") == F.col("exact_percent")))
    return both.select("split", "values", "percent", (F.abs(F.col("near") - F.col("value")) <= 0.01 * F.abs("value")).alias("within"))


def p1_segment_evening(spark: SparkSession, d: str) -> DataFrame:
    """Evening usage per segment. A repeated snapshot counts as often as it is listed, so that counts of months or files add up."""
    return percentiles(value_counts(read(spark, d, "household_segments"), F.col("segment"), F.col("usual_evening_kwh")), PERCENTS, name="segment")


def p1_segment_evening_merged(spark: SparkSession, d: str) -> DataFrame:
    monthly = value_counts(read(spark, d, "household_segments"), F.col("segment"), F.col("usual_evening_kwh"), F.date_format("as_of", "yyyy-MM"))
    return percentiles(merge_counts(monthly), PERCENTS, name="segment")


def _homes(spark: SparkSession, d: str) -> DataFrame:
    """client_id, split, records, home of every household with a record."""
    a = read(spark, d, "partition_data").select("client_id", split_name("split").alias("split"))
    b = read(spark, d, "validation_windows").select("client_id", F.lit("validation").alias("split"))
    rows = a.unionByName(b).groupBy("client_id", "split").agg(F.count(F.lit(1)).alias("records"))
    rows = rows.groupBy(canonical_id("client_id").alias("client_id"), "split").agg(F.sum("records").alias("records")).where("client_id is not null")
    swaps = read(spark, d, "meter_swaps")
    return cut(homes_of(rows, swaps, canonical_id("old_client_id"), canonical_id("new_client_id"), F.col("swapped_on")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Households whose home has records in more than one split."""
    rows = _homes(spark, d)
    torn = rows.where("split is not null").groupBy("home").agg(F.count_distinct("split").alias("n")).where("n > 1").select("home")
    return rows.where("split is not null").join(torn, "home", "left_semi").select("client_id").distinct()


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    """One split per household, the same for its whole home."""
    rows = _homes(spark, d)
    homes = rows.groupBy("home").agg(F.sum("records").alias("records"))
    targets = {r["split"]: r["share"] for r in read(spark, d, "split_targets").collect()}  # a row a split
    dealt = deal(homes, targets)
    return rows.groupBy("client_id", "home").agg(F.sum("records").alias("records")).join(dealt, "home").select("client_id", "home", "records", "split")


def p5_whole_homes(spark: SparkSession, d: str) -> DataFrame:
    """Per household: its records, the households of its home, and in how many splits the home's households stand."""
    x = p5_assignment(spark, d)
    homes = x.groupBy("home").agg(F.count(F.lit(1)).alias("households"), F.count_distinct("split").alias("splits"))
    return x.join(homes, "home").select("client_id", "records", "households", "splits")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    x = p5_assignment(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("households"), F.sum("records").alias("records"))
    t = x.agg(F.sum("households").alias("h"), F.sum("records").alias("r"))
    y = read(spark, d, "split_targets").join(x, "split", "left").join(F.broadcast(t), F.lit(True))
    return y.select("split", "share", F.coalesce("households", F.lit(0)).alias("households"), F.coalesce("records", F.lit(0)).alias("records"), F.round(F.col("households") / F.col("h"), 6).alias("household_share"), F.round(F.col("records") / F.col("r"), 6).alias("record_share"))


def p5_shares_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether each split holds its share of the records, to within three percent of all, or to within the largest home, which is never cut."""
    x = p5_assignment(spark, d)
    homes = x.groupBy("home", "split").agg(F.sum("records").alias("records"))
    total = homes.agg(F.sum("records").alias("r"), F.max("records").alias("largest"))  # one row
    y = read(spark, d, "split_targets").join(homes.groupBy("split").agg(F.sum("records").alias("records")), "split", "left").join(F.broadcast(total), F.lit(True))
    off = F.abs(F.coalesce("records", F.lit(0)) / F.col("r") - F.col("share"))
    return y.select("split", "share", (off <= F.greatest(F.col("largest") / F.col("r"), F.lit(0.03))).alias("kept"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every post with its container."""
    capacity = read(spark, d, "pack_capacity").first()["capacity_tokens"]
    docs = read(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), token_count(F.col("text")).alias("tokens"))
    x = pack(docs, F.col("doc_id"), F.col("source"), F.col("tokens"), capacity)
    return x.select(F.col("item").cast("bigint").alias("doc_id"), "piece", "pieces", "size", "source", "container", "filled")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts that the packer had to cut: it put more than their first piece into a container."""
    return p8_packed(spark, d).where("piece > 0").select("doc_id").distinct()


def p8_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing, sizes in code points: per source its posts, size and cut posts, all packed whole, no container too full."""
    capacity = read(spark, d, "pack_capacity").first()["capacity_tokens"]
    docs = read(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "n_chars")
    x = pack(docs, F.col("doc_id"), F.col("source"), F.col("n_chars"), capacity)
    posts = x.groupBy("source", "item").agg(F.sum("size").alias("size"), F.max("pieces").alias("pieces"), F.count(F.lit(1)).alias("packed"), F.max("filled").alias("fullest"))
    return posts.groupBy("source").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("size").alias("size"), F.count_if(F.col("pieces") > 1).alias("cut_posts"),
        F.bool_and(F.col("pieces") == F.col("packed")).alias("whole"), F.bool_and(F.col("fullest") <= capacity).alias("fits"),
    )


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of problem 9 packed to the plan's shares: each source's share over all containers, and how far single containers are from it on average."""
    capacity = read(spark, d, "pack_capacity").first()["capacity_tokens"]
    mixture, report = _mix(spark, d)
    shares = {r["source"]: r["actual_share"] for r in report.collect()}  # a row a source of the plan
    x = pack(mixture, F.col("doc_id"), F.col("source"), F.col("size"), capacity, shares=shares)
    x = x.where("piece = pieces - 1")  # cut posts have containers of their own
    full = x.groupBy("container").agg(F.sum("size").alias("all")).where("all > 0")
    part = x.groupBy("container", "source").agg(F.sum("size").alias("own")).join(full, "container")
    n = full.agg(F.count(F.lit(1)).alias("containers"), F.sum("all").alias("tokens"))
    aim = spark.createDataFrame(list(shares.items()), "source string, target_share double")
    dev = F.abs(F.col("own") / F.col("all") - F.col("target_share"))
    g = part.join(F.broadcast(aim), "source").groupBy("source", "target_share").agg(F.sum("own").alias("own"), F.sum(dev).alias("dev"), F.count(F.lit(1)).alias("among"))
    missing = (F.col("containers") - F.col("among")) * F.col("target_share")  # containers without the source are off by its whole share
    return g.join(F.broadcast(n), F.lit(True)).select("source", F.round("target_share", 6).alias("target_share"), F.round(F.col("own") / F.col("tokens"), 6).alias("share"), F.round((F.col("dev") + missing) / F.col("containers"), 6).alias("mean_deviation"), "containers")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    capacity = read(spark, d, "pack_capacity").first()["capacity_tokens"]
    x = p8_packed(spark, d).groupBy("container").agg(F.sum("size").alias("size"))
    return x.agg(F.count(F.lit(1)).alias("containers"), F.sum("size").alias("tokens"), F.round(F.sum("size") / (F.count(F.lit(1)) * capacity), 6).alias("fill"), F.max("size").alias("fullest"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = cut(read(spark, d, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens")))
    return mix(docs, F.col("doc_id"), F.col("source"), F.col("tokens"), read(spark, d, "mix_plan"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return _mix(spark, d)[1].where("not reached").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mixture, sizes in code points: per source its size and reach, no post repeated too often, the budget kept to within half a post."""
    docs, plan = read(spark, d, "documents"), read(spark, d, "mix_plan")
    mixture, report = mix(docs, F.col("doc_id"), F.col("source"), F.col("n_chars"), plan)
    mixture = cut(mixture)
    uses = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.max("repeat").alias("last"))
    most = uses.groupBy("source").agg(F.max("uses").alias("uses"), F.bool_and(F.col("uses") == F.col("last")).alias("in_turn"))
    total = mixture.agg(F.sum("size").alias("total"), F.max("size").alias("longest"))
    x = report.join(most, "source", "left").join(plan.select("source", "max_repeats"), "source").join(F.broadcast(total), F.lit(True)).join(F.broadcast(report.agg(F.sum("size_once").alias("budget"))), F.lit(True))
    kept = (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")) & F.coalesce("in_turn", F.lit(True))
    return x.select("source", F.round("target_share", 9).alias("target_share"), "documents", "size_once", "most_size", "reached", kept.alias("repeats_kept"), (F.abs(F.col("total") - F.col("budget")) * 2 <= F.col("longest")).alias("budget_kept"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every post with robust z-scores, percentiles and depth."""
    return grade(text_statistics(read(spark, d, "documents"), "doc_id", "text", label=F.col("lang")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts that are not mainly running sentences."""
    return p10_statistics(spark, d).where("not prose").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_partition_by_household, p1_partition_by_split, p1_partition_by_split_merged, p1_partition_by_split_rounded, p1_segment_evening, p1_segment_evening_merged,
        p5_found, p5_assignment, p5_whole_homes, p5_shares, p5_shares_kept, p8_found, p8_packed, p8_by_chars, p8_shares, p8_fill, p9_found, p9_report, p9_mixture, p9_by_chars, p10_found, p10_statistics,
    )
}

_SPLIT = "CASE WHEN lower(trim(split)) LIKE 'tr%' THEN 'train' WHEN lower(trim(split)) LIKE 'va%' THEN 'validation' WHEN lower(trim(split)) LIKE 'te%' THEN 'test' END"
_ID = "upper(regexp_replace({c}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"


def _quantiles(group: str, name: str, value: str, table: str, where: str) -> str:
    parts = [f"SELECT {group} AS {name}, count(*) AS \"values\", CAST({q} AS DOUBLE) AS percent, round(quantile_cont({value}, {q}), 9) AS value FROM {table} WHERE {where} GROUP BY 1" for q in PERCENTS]
    return " UNION ALL ".join(parts)


_RECORDS = f"""r AS (
  SELECT {_ID.format(c="client_id")} AS client_id, {_SPLIT} AS split, count(*) AS records FROM partition_data GROUP BY 1, 2
  UNION ALL SELECT {_ID.format(c="client_id")}, 'validation', count(*) FROM validation_windows GROUP BY 1),
s AS (SELECT {_ID.format(c="old_client_id")} AS a, {_ID.format(c="new_client_id")} AS b FROM meter_swaps),
e AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
reach(x, y) AS (SELECT a, a FROM e UNION SELECT x, e.b FROM reach JOIN e ON reach.y = e.a),
home AS (SELECT x AS client_id, min(y) AS home FROM reach GROUP BY 1),
k AS (SELECT r.client_id, split, records, coalesce(home, r.client_id) AS home FROM r LEFT JOIN home ON r.client_id = home.client_id WHERE r.client_id IS NOT NULL AND r.client_id <> '')"""
_W = "aggregate_w IS NOT NULL AND NOT isnan(aggregate_w) AND aggregate_w NOT IN (-1.0, -999.0, 65535.0, 999999.0)"
_E = "usual_evening_kwh IS NOT NULL AND NOT isnan(usual_evening_kwh)"

SQL = {
    "p1_partition_by_household": _quantiles("client_id", "client_id", "aggregate_w", "partition_data", _W),
    "p1_partition_by_split": _quantiles(_SPLIT, "split", "aggregate_w", "partition_data", _W),
    "p1_partition_by_split_merged": _quantiles(_SPLIT, "split", "aggregate_w", "partition_data", _W),
    "p1_partition_by_split_rounded": "SELECT split, \"values\", percent, true AS within FROM (" + _quantiles(_SPLIT, "split", "aggregate_w", "partition_data", _W) + ")",
    "p1_segment_evening": _quantiles("segment", "segment", "usual_evening_kwh", "household_segments", _E),
    "p1_segment_evening_merged": _quantiles("segment", "segment", "usual_evening_kwh", "household_segments", _E),
    "p5_found": f"""
WITH RECURSIVE {_RECORDS}
SELECT DISTINCT client_id FROM k WHERE split IS NOT NULL AND home IN (SELECT home FROM k WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
""",
    "p5_whole_homes": f"""
WITH RECURSIVE {_RECORDS}, n AS (SELECT home, count(DISTINCT client_id) AS households FROM k GROUP BY 1)
SELECT client_id, CAST(sum(records) AS BIGINT) AS records, any_value(households) AS households, 1 AS splits FROM k JOIN n USING (home) GROUP BY 1
""",
    "p5_shares_kept": "SELECT split, share, true AS kept FROM split_targets",
    "p8_by_chars": f"""
SELECT lower(trim(source)) AS source, count(*) AS posts, CAST(sum(n_chars) AS BIGINT) AS size, count(*) FILTER (WHERE n_chars > capacity_tokens) AS cut_posts, true AS whole, true AS fits
FROM documents, pack_capacity GROUP BY 1
""",
    "p9_by_chars": """
WITH x AS (SELECT p.source, p.target_share, p.max_repeats, count(doc_id) AS documents, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS size_once
  FROM mix_plan p LEFT JOIN documents d ON lower(regexp_replace(d.source, '^\\s+|\\s+$', '', 'g')) = lower(trim(p.source)) GROUP BY ALL)
SELECT source, round(target_share / sum(target_share) OVER (), 9) AS target_share, documents, size_once, size_once * max_repeats AS most_size, size_once * max_repeats >= target_share * sum(size_once) OVER () AS reached, true AS repeats_kept, true AS budget_kept FROM x
""",
}
