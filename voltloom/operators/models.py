"""Small models fitted from distributed sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.operators.ordering import order_statistics, value_counts
from voltloom.session import cut


def ridge_fit(df: DataFrame, features: Sequence[str], targets: Sequence[str], alpha: float) -> dict:
    """Ridge on standardised features (population deviation), intercept not penalised, from one pass of sums of products."""
    cols = [*features, *targets]
    x = df.where(" and ".join(f"`{c}` is not null" for c in cols))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols)) if i < len(features)]
    row = x.agg(F.count(F.lit(1)), *[F.sum(c) for c in cols], *[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).first()
    n = row[0]
    if not n:
        raise ValueError("no complete rows to fit")
    s = np.array([row[1 + i] for i in range(len(cols))], dtype=float)
    m = np.zeros((len(features), len(cols)))
    for k, (i, j) in enumerate(pairs):
        m[i, j] = row[1 + len(cols) + k]
        if j < len(features):
            m[j, i] = m[i, j]
    f = len(features)
    cov = m - np.outer(s[:f], s) / n
    std = np.sqrt(np.maximum(np.diag(cov[:, :f]) / n, 0))
    std[std == 0] = 1
    beta = np.linalg.solve(cov[:, :f] / np.outer(std, std) + alpha * np.eye(f), cov[:, f:] / std[:, None]) / std[:, None]
    return {"features": list(features), "targets": list(targets), "coef": beta, "intercept": s[f:] / n - s[:f] / n @ beta}


def ridge_predict(model: dict, floor: float | None = 0.0) -> list[Column]:
    """One column expression per target."""
    out = []
    for t, name in enumerate(model["targets"]):
        y = sum((F.col(c) * float(model["coef"][i, t]) for i, c in enumerate(model["features"])), F.lit(float(model["intercept"][t])))
        out.append((F.greatest(y, F.lit(floor)) if floor is not None else y).alias(f"predicted_{name}"))
    return out


def nearest_centroid(df: DataFrame, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``cluster`` and ``distance`` (Euclidean) of the nearest of a few centroids; ties go to the lower number."""
    near = []
    for k, c in enumerate(centroids):
        point = F.array(*[F.lit(float(v)) for v in c])
        d = F.aggregate(F.zip_with(vector, point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        near.append(F.struct(F.sqrt(d).alias("d"), F.lit(k).alias("k")))
    best = F.array_min(F.array(*near))
    return df.withColumn("_b", best).withColumn("cluster", F.col("_b.k")).withColumn("distance", F.col("_b.d")).drop("_b")


def kmeans(df: DataFrame, features: Sequence[str], k: int, seeds: Sequence[int] = (1, 2, 3), iterations: int = 50):
    """The best of several seeded fits by training cost, over median-imputed, population-standardised features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("s")).select("s.*")
    mids = {r["feature"]: r["value"] for r in order_statistics(cut(value_counts(long, ["feature"], F.col("x"))), "feature", [0.5]).collect()}  # a row a feature
    x = df.select("*", *[F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(mids.get(c) or 0.0)).alias(f"_f_{c}") for c in features])
    row = x.agg(*[a for c in features for a in (F.avg(f"_f_{c}"), F.stddev_pop(f"_f_{c}"))]).first()
    for i, c in enumerate(features):
        x = x.withColumn(f"_f_{c}", (F.col(f"_f_{c}") - (row[2 * i] or 0.0)) / (row[2 * i + 1] or 1.0))
    x = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_v").transform(x)
    best = min((KMeans(k=k, seed=s, maxIter=iterations, featuresCol="_v", predictionCol="cluster").fit(x) for s in seeds), key=lambda m: m.summary.trainingCost)
    return best, best.transform(x).drop("_v", *[f"_f_{c}" for c in features])


def random_forest(df: DataFrame, features: Sequence[str], label: str, order: str, share: float = 0.75, trees: int = 50):
    """Chronological split, class weights that balance the training part, ROC and PR area on the rest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = df.dropna(subset=[*features, label]).withColumn("_o", F.unix_micros(F.col(order).cast("timestamp")).cast("double"))
    cutoff = x.approxQuantile("_o", [share], 0.0)[0]
    x = VectorAssembler(inputCols=list(features), outputCol="_v").transform(x)
    train, test = x.where(F.col("_o") <= cutoff), x.where(F.col("_o") > cutoff)
    n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    weight = F.lit(1.0)
    for v, c in n.items():
        weight = F.when(F.col(label) == v, sum(n.values()) / (len(n) * c)).otherwise(weight)
    model = RandomForestClassifier(featuresCol="_v", labelCol=label, weightCol="_w", numTrees=trees, maxDepth=6, seed=7).fit(train.withColumn("_w", weight))
    said = model.transform(test)
    area = lambda kind: BinaryClassificationEvaluator(labelCol=label, metricName=kind).evaluate(said)
    return model, {"roc_auc": area("areaUnderROC"), "pr_auc": area("areaUnderPR")}
