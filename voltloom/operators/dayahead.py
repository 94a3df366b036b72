"""Day-ahead forecasts under an issue time: what is known the afternoon before, as baselines, vectors and windows.

A forecast of a day is issued at ``issue_hour`` of the day before. Everything here is
built from daily vectors, one row per series and day with its 48 half hours in an array,
so that lags of days are lags of rows on a dense calendar.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.timegrid import slot_index

SLOTS = 48
#: Matrix rows whose sums of products are formed in one task.
ROWS_A_TASK = 20_000


def issue_time(day: Column, issue_hour: int = 14) -> Column:
    """The moment at which the forecast of ``day`` is issued."""
    return day.cast("timestamp_ntz") - F.expr(f"INTERVAL '{24 - issue_hour}' HOUR")


def issued_persistence(df: DataFrame, keys: Sequence[str], slot: str, values: Sequence[str], *, issue_hour: int = 14) -> DataFrame:
    """Adds ``forecast_<value>``: the same half hour of the day before where it had ended when the forecast was issued, of two days before elsewhere.

    Rows without such a half hour get null. Slots must be unique per key.
    """
    ended = F.hour(slot) * 60 + F.minute(slot) + 30 <= issue_hour * 60
    step = F.when(ended, F.expr("INTERVAL '1' DAY")).otherwise(F.expr("INTERVAL '2' DAY"))
    old = df.select(*keys, (F.col(slot) + step).alias(slot), *[F.col(v).alias(f"forecast_{v}") for v in values])
    return df.join(old, [*keys, slot], "left")


def daily_vectors(df: DataFrame, key: str, slot: str, value: str, flags: Sequence[str] = ()) -> DataFrame:
    """key, day, v (48 values, null where missing; more than one value of a slot counts as missing), and each flag's largest value, on a dense calendar per key."""
    item = F.map_from_entries(F.collect_list(F.struct("_i", "_v")))
    x = df.where(f"{key} is not null and {slot} is not null").groupBy(key, slot).agg(F.when(F.count(F.lit(1)) == 1, F.max(value)).alias("_v"), *[F.max(f).alias(f) for f in flags])
    x = x.withColumn("day", F.to_date(slot)).withColumn("_i", slot_index(F.col(slot)))
    x = x.groupBy(key, "day").agg(item.alias("_m"), *[F.max(f).alias(f) for f in flags])
    ends = x.groupBy(key).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    every = ends.select(key, F.explode(F.sequence("_a", "_b")).alias("day"))
    y = every.join(x, [key, "day"], "left")
    clean = lambda v: F.when(~F.isnan(v) & (F.abs(v) < 1e300), v)
    vector = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: clean(F.try_element_at("_m", i)))
    return y.select(key, "day", F.when(F.col("_m").isNotNull(), vector).otherwise(F.array_repeat(F.lit(None).cast("double"), SLOTS)).alias("v"), *flags)


def _whole(c: str) -> Column:
    return F.forall(c, lambda v: v.isNotNull())


def training_matrix(days: DataFrame, key: str, flags: Sequence[str] = (), *, issue_hour: int = 14, excluded: DataFrame | None = None, need_target: bool = True) -> DataFrame:
    """key, day, features, target of every day whose features (and target) are complete.

    days: from daily_vectors. features: the 48 half hours before the issue time, those of two
    and of seven days before, the mean of the days eight to two before, the day of the week
    one-hot from Monday, the month as sine and cosine, and the flags (a missing flag is 0).
    excluded: a table of ``day`` that are left out.
    """
    w = Window.partitionBy(key).orderBy("day")
    known = 2 * issue_hour
    x = days.select(key, "day", F.col("v").alias("target"), *flags, *[F.lag("v", k).over(w).alias(f"_l{k}") for k in range(1, 9)])
    recent = F.concat(F.slice("_l2", known + 1, SLOTS - known), F.slice("_l1", 1, known))
    total = F.col("_l2")
    for k in range(3, 9):
        total = F.zip_with(total, f"_l{k}", lambda a, b: a + b)
    weekday = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (i == F.weekday("day")).cast("double"))
    angle = F.lit(2 * np.pi) * (F.month("day") - 1) / 12
    rest = F.array(F.sin(angle), F.cos(angle), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in flags])
    x = x.where("_l8 is not null").select(key, "day", F.concat(recent, "_l2", "_l7", F.transform(total, lambda v: v / 7), weekday, rest).alias("features"), "target")
    x = x.where(_whole("features"))
    if need_target:
        x = x.where(_whole("target"))
    return x.join(F.broadcast(excluded.select("day").distinct()), "day", "left_anti") if excluded is not None else x


def forecast_windows(days: DataFrame, key: str, *, context_days: int = 7) -> DataFrame:
    """key, day, context (the half hours of the days before, 336 of them), target (48), and whether each is complete.

    days: from daily_vectors. Where a context may be filled, fill the values before; the
    target stays as measured.
    """
    w = Window.partitionBy(key).orderBy("day")
    x = days.select(key, "day", F.col("v").alias("target"), *[F.lag("v", k).over(w).alias(f"_l{k}") for k in range(context_days, 0, -1)])
    x = x.where(f"_l{context_days} is not null").withColumn("context", F.concat(*[f"_l{k}" for k in range(context_days, 0, -1)]))
    return x.select(key, "day", "context", "target", _whole("context").alias("context_complete"), _whole("target").alias("target_complete"))


def _sums(features: int, targets: int):
    """One row a partition: sums of products of (1, features) with (1, features, targets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 1 + targets))
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), np.array(pdf["features"].tolist(), dtype="float64")])
                total += x.T @ np.column_stack([x, np.array(pdf["target"].tolist(), dtype="float64")])
        yield pd.DataFrame({"s": [total.ravel().tolist()]})

    return run


def ridge_path(matrix: DataFrame, alphas: Sequence[float]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """alpha: (coefficients, intercepts) of ridge on standardised features, all outputs at once, from one pass of sums of products.

    The matrix has a row per series and day; a partition sends one block of sums to the
    driver, so it is first drawn together to partitions of ``ROWS_A_TASK`` rows.
    """
    first = matrix.select(F.size("features").alias("f"), F.size("target").alias("t")).first()
    if first is None:
        raise ValueError("no complete days to fit")
    f, t = first["f"], first["t"]
    n = matrix.count()
    parts = max(1, min(64, -(-n // ROWS_A_TASK)))
    total = sum(np.array(r["s"]) for r in matrix.select("features", "target").repartition(parts).mapInPandas(_sums(f, t), "s array<double>").collect())
    total = total.reshape(f + 1, f + 1 + t)
    mean, ymean = total[0, 1 : f + 1] / n, total[0, f + 1 :] / n
    cov = total[1:, 1 : f + 1] - n * np.outer(mean, mean)
    cross = total[1:, f + 1 :] - n * np.outer(mean, ymean)
    std = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    std[std < 1e-12] = 1.0
    out = {}
    for alpha in alphas:
        beta = np.linalg.solve(cov / np.outer(std, std) + alpha * np.eye(f), cross / std[:, None]) / std[:, None]
        out[alpha] = (beta, ymean - mean @ beta)
    return out


def predict(matrix: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]], floor: float | None = 0.0) -> DataFrame:
    """matrix with one row per model: ``method`` and ``prediction`` (an array, kept at least ``floor``)."""
    names = list(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["features"].tolist(), dtype="float64")
            for name in names:
                beta, intercept = models[name]
                y = x @ beta + intercept
                out = pdf.drop(columns=["features"]).copy()
                out["method"], out["prediction"] = name, (y if floor is None else np.maximum(y, floor)).tolist()
                yield out

    kept = [c for c in matrix.schema.fields if c.name != "features"]
    ddl = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in kept)
    return matrix.mapInPandas(run, f"{ddl}, method string, prediction array<double>")


def vector_errors(df: DataFrame, by: Sequence[str], actual: str = "target", predicted: str = "prediction") -> DataFrame:
    """days, mae, rmse: errors over all half hours of the days."""
    e = F.zip_with(predicted, actual, lambda p, a: p - a)
    s = lambda f: F.sum(F.aggregate(F.transform(e, f), F.lit(0.0), lambda x, y: x + y))
    n = F.sum(F.size(actual))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), (s(F.abs) / n).alias("mae"), F.sqrt(s(lambda v: v * v) / n).alias("rmse"))


def select_alpha(matrix: DataFrame, train_end: Column, validation_end: Column, alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0, 1000.0)) -> tuple[float, DataFrame]:
    """(the alpha with the least rmse on the days from ``train_end`` to before ``validation_end``, the table of errors per alpha).

    Without days to fit or to validate the table is empty and the alpha the largest.
    """
    train = matrix.where(F.col("day") < train_end)
    models = {} if train.isEmpty() else ridge_path(train, alphas)
    valid = matrix.where((F.col("day") >= train_end) & (F.col("day") < validation_end))
    errors = vector_errors(predict(valid, {str(a): m for a, m in models.items()}), ["method"])
    best = errors.orderBy("rmse", "method").first()  # a row an alpha
    return float(best["method"]) if best else max(alphas), errors


def walk_forward(matrix: DataFrame, key: str, origins: Sequence[str], *, alpha: float, issue_hour: int = 14) -> DataFrame:
    """day, method ('ridge', 'persistence'), target, prediction: each origin's model is fitted to the days before it and asked for the days up to the next origin.

    persistence: the 24 hours before the issue time, laid onto the clock of the target day.
    An origin without a day before it has no ridge forecast.
    """
    out = None
    known = 2 * issue_hour
    for start, end in zip(origins, [*origins[1:], None], strict=True):
        past = matrix.where(F.col("day") < F.lit(start).cast("date"))
        model = {} if past.isEmpty() else {"ridge": ridge_path(past, [alpha])[alpha]}
        ahead = matrix.where((F.col("day") >= F.lit(start).cast("date")) & (F.lit(True) if end is None else F.col("day") < F.lit(end).cast("date")))
        x = predict(ahead, model)
        last = ahead.select(*[c for c in ahead.columns if c != "features"], F.lit("persistence").alias("method"), F.concat(F.slice("features", SLOTS - known + 1, known), F.slice("features", 1, SLOTS - known)).alias("prediction"))
        both = x.unionByName(last).withColumn("origin", F.lit(start).cast("date"))
        out = both if out is None else out.unionByName(both)
    return out
