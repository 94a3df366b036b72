"""Filling missing values from similar records by a mixture of Gaussians and categories.

Expectation-maximisation fits K components, each a Gaussian over the continuous
fields times independent categorical distributions. Records with gaps take part:
their likelihood is that of what was observed, their missing parts enter as
conditional moments. A missing number is filled with its conditional expectation,
a missing category with its most likely value, and masks say what was filled.

Scale: the records are reduced once, with map-side combine, to cells (the binned
continuous fields with their categories) holding counts, sums and sums of squares.
The number of cells is bounded by bins and categories, not by the records. Each
iteration is one pass over the cells that returns K rows of sufficient statistics.
Only records with gaps go through Python when filling.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.session import cut

CELLS_A_TASK = 20_000


@dataclass
class Mixture:
    """weights (K), means (K, d), covs (K, d, d), cats: one (K, C) table of probabilities per categorical field."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    cats: list[np.ndarray]

    def given(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple, np.ndarray], np.ndarray]:
        """Responsibilities (n, K), expectations (n, K, d) with x's gaps filled, covariances of the gaps by pattern of gaps, and log likelihoods (n)."""
        n, d = x.shape
        k = len(self.weights)
        score = np.tile(np.log(self.weights), (n, 1))
        for j, table in enumerate(self.cats):
            known = (c[:, j] >= 0) & (c[:, j] < table.shape[1])
            score[known] += np.log(table[:, c[known, j]]).T
        full = np.repeat(x[:, None, :], k, axis=1)
        gaps = np.isnan(x)
        spread = {}
        codes = gaps @ (1 << np.arange(d)) if d else np.zeros(n, int)
        for code in np.unique(codes):
            at = codes == code
            m = gaps[at][0]
            o = ~m
            left = np.zeros((k, d, d))
            for i in range(k):
                mu, cov = self.means[i], self.covs[i]
                if o.any():
                    inv = np.linalg.inv(cov[np.ix_(o, o)])
                    dev = x[np.ix_(at, o)] - mu[o]
                    score[at, i] -= 0.5 * (np.einsum("ij,jk,ik->i", dev, inv, dev) - np.linalg.slogdet(inv)[1] + o.sum() * np.log(2 * np.pi))
                if m.any():
                    if o.any():
                        gain = cov[np.ix_(m, o)] @ inv
                        full[np.ix_(at, [i], m)] = (mu[m] + dev @ gain.T)[:, None, :]
                        left[np.ix_([i], m, m)] = cov[np.ix_(m, m)] - gain @ cov[np.ix_(o, m)]
                    else:
                        full[np.ix_(at, [i], m)] = mu[m]
                        left[np.ix_([i], m, m)] = cov[np.ix_(m, m)]
            spread[int(code)] = left
        top = score.max(axis=1, keepdims=True)
        r = np.exp(score - top)
        all_ = r.sum(axis=1, keepdims=True)
        return r / all_, full, spread, (top + np.log(all_))[:, 0]

    def fill(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and c with NaN and negative codes replaced by conditional expectations and modes."""
        if not len(x):
            return x, c
        r, full, _, _ = self.given(x, c)
        out = np.where(np.isnan(x), np.einsum("nk,nkd->nd", r, full), x)
        codes = c.copy()
        for j, table in enumerate(self.cats):
            lost = c[:, j] < 0
            codes[lost, j] = (r[lost] @ table).argmax(axis=1)
        return out, codes


def _statistics(model: Mixture, d: int, sizes: Sequence[int]):
    """Per batch of cells, the sufficient statistics of every component as one row of doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if pdf.empty:
                continue
            w = pdf["w"].to_numpy("float64")
            x = pdf[[f"m{i}" for i in range(d)]].to_numpy("float64")
            own = np.nan_to_num(pdf[[f"q{i}" for i in range(d)]].to_numpy("float64"))
            c = pdf[[f"c{j}" for j in range(len(sizes))]].fillna(-1).to_numpy("int64") if sizes else np.zeros((len(w), 0), int)
            r, full, spread, likely = model.given(x, c)
            rw = r * w[:, None]
            codes = np.isnan(x) @ (1 << np.arange(d))
            rows = []
            for i in range(len(model.weights)):
                second = np.einsum("n,nd,ne->de", rw[:, i], full[:, i], full[:, i]) + np.diag(r[:, i] @ own)
                for code, left in spread.items():
                    second += rw[codes == code, i].sum() * left[i]
                tables = [np.bincount(c[c[:, j] >= 0, j], rw[c[:, j] >= 0, i], minlength=s)[:s] for j, s in enumerate(sizes)]
                rows.append(np.concatenate([[rw[:, i].sum()], rw[:, i] @ full[:, i], second.ravel(), *tables, [w @ likely]]))
            total = np.array(rows) if total is None else total + np.array(rows)
        if total is not None:
            yield pd.DataFrame({"k": range(len(total)), "s": list(total)})

    return run


def _bin(c: Column, width: float) -> Column:
    return F.round(c / width).cast("int")


def cells(df: DataFrame, numbers: Sequence[str], widths: Sequence[float], categories: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The records reduced to cells: bins b0.., weight w, means m0.. and scatters q0.. of the numbers, codes c0.. of the categories.

    by: columns that keep their own cells apart, such as a source whose level is not known yet.
    """
    clean = [F.when(~F.isnan(F.col(x)) & (F.abs(F.col(x)) < 1e300), F.col(x)).alias(f"x{i}") for i, x in enumerate(numbers)]
    x = df.select(*by, *clean, *[F.col(c).cast("int").alias(f"c{j}") for j, c in enumerate(categories)])
    bins = [_bin(F.col(f"x{i}"), w).alias(f"b{i}") for i, w in enumerate(widths)]
    n = F.count(F.lit(1)).cast("double")
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in range(len(numbers))] + [(F.var_pop(f"x{i}") * n).alias(f"q{i}") for i in range(len(numbers))]
    return x.groupBy(*by, *bins, *[f"c{j}" for j in range(len(categories))]).agg(n.alias("w"), *sums)


def with_level(parts: DataFrame, level: str, numbers: int, width: float, categories: int) -> DataFrame:
    """Cells kept apart by source, merged to cells whose last number is the source's ``level``, one value a source."""
    last = numbers
    x = parts.withColumn(f"b{last}", _bin(F.col(level), width)).withColumn(f"m{last}", F.col(level)).withColumn(f"q{last}", F.when(F.col(level).isNotNull(), F.lit(0.0)))
    w = F.sum("w")
    every = range(numbers + 1)
    means = [(F.sum(F.col(f"m{i}") * F.col("w")) / w).alias(f"m{i}") for i in every]  # within a cell a number is known everywhere or nowhere
    second = [F.sum(F.col(f"q{i}") + F.col("w") * F.col(f"m{i}") * F.col(f"m{i}")).alias(f"s{i}") for i in every]
    y = x.groupBy(*[f"b{i}" for i in every], *[f"c{j}" for j in range(categories)]).agg(w.alias("w"), *means, *second)
    scatter = [F.when(F.col(f"s{i}").isNotNull(), F.greatest(F.col(f"s{i}") - F.col("w") * F.col(f"m{i}") * F.col(f"m{i}"), F.lit(0.0))).alias(f"q{i}") for i in every]
    return y.select(*[f"b{i}" for i in every], *[f"c{j}" for j in range(categories)], "w", *[f"m{i}" for i in every], *scatter)


def fit_mixture(df: DataFrame, numbers: Sequence[str], widths: Sequence[float], categories: Sequence[str] = (), sizes: Sequence[int] = (), **kw) -> Mixture:
    """The mixture fitted to all records of ``df``.

    numbers: columns of doubles (null or NaN: missing); widths: the bin of each, below
    which values count as similar; categories: columns of codes 0..size-1 (null: missing).
    """
    return fit_cells(cells(df, numbers, widths, categories), widths, sizes, **kw)


def fit_cells(cell: DataFrame, widths: Sequence[float], sizes: Sequence[int] = (), *, components: int = 5, iterations: int = 30, tolerance: float = 1e-3) -> Mixture:
    """The mixture fitted to cells by expectation-maximisation.

    It ends when the mean log likelihood of a record grows by less than ``tolerance``, or
    after ``iterations`` rounds. Defined cases: an empty table, or a field without any
    value, gives components of mean zero and width spread; identical records give one
    tight component.
    """
    d, eps = len(widths), np.array([w * w / 12 for w in widths])
    cell = cut(cell)
    cell = cell.coalesce(max(1, -(-cell.count() // CELLS_A_TASK)))
    lead = cell.where("b0 is not null").groupBy("b0").agg(F.sum("w").alias("w"), *[F.avg(f"m{i}").alias(f"m{i}") for i in range(d)]).orderBy("b0").collect()
    means = np.zeros((components, d))
    weighed = [F.try_sum(F.col(f"m{i}") * F.col("w")) / F.try_sum(F.when(F.col(f"m{i}").isNotNull(), F.col("w"))) for i in range(d)]
    spread = [v or 0.0 for v in cell.agg(*weighed).first()] if lead else [0.0] * d
    means[:] = spread
    if lead:
        share = np.cumsum([r["w"] for r in lead]) / sum(r["w"] for r in lead)
        for i in range(components):
            row = lead[int(np.searchsorted(share, (i + 0.5) / components))]
            means[i] = [row[f"m{j}"] if row[f"m{j}"] is not None else spread[j] for j in range(d)]
    covs = np.stack([np.diag(np.array([(4 * w) ** 2 for w in widths]))] * components)
    model = Mixture(np.full(components, 1 / components), means, covs, [np.full((components, s), 1 / s) for s in sizes])
    if not lead:
        return model
    before = -np.inf
    for _ in range(iterations):
        s = np.zeros((components, 2 + d + d * d + sum(sizes)))
        for row in cell.mapInPandas(_statistics(model, d, sizes), "k int, s array<double>").collect():  # K rows a task
            s[row["k"]] += row["s"]
        n = s[:, 0]
        live = n > 1e-6 * n.sum()
        weights = np.where(live, n, 1e-6 * n.sum())
        m = np.where(live[:, None], s[:, 1 : 1 + d] / np.maximum(n, 1e-300)[:, None], model.means)
        second = s[:, 1 + d : 1 + d + d * d].reshape(components, d, d) / np.maximum(n, 1e-300)[:, None, None]
        c = np.where(live[:, None, None], second - np.einsum("kd,ke->kde", m, m), model.covs)
        c = (c + c.transpose(0, 2, 1)) / 2 + np.diag(eps)
        tables, at = [], 1 + d + d * d
        for size in sizes:
            t = s[:, at : at + size] + 0.5
            tables.append(t / t.sum(axis=1, keepdims=True))
            at += size
        model = Mixture(weights / weights.sum(), m, c, tables)
        likely = s[0, -1] / max(n.sum(), 1e-300)  # of the model before this step
        if likely - before < tolerance:
            break
        before = likely
    return model


def fill_gaps(df: DataFrame, model: Mixture, numbers: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """``df`` with the gaps of ``numbers`` and ``categories`` filled, and ``<name>_filled`` saying which were.

    Defined cases: NaN and infinite values count as null; a code outside the fitted range
    stays; older marks are replaced and all other columns pass through unchanged; an empty
    table stays empty.
    """
    marks = [*numbers, *categories]
    df = df.drop(*[f"{m}_filled" for m in marks])
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{m}_filled", T.BooleanType()) for m in marks]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(numbers)].to_numpy("float64", na_value=np.nan)
            x = np.where(np.isfinite(x), x, np.nan)
            c = pdf[list(categories)].astype("float64").fillna(-1).to_numpy().astype("int64") if categories else np.zeros((len(pdf), 0), int)
            fx, fc = model.fill(x, c)
            out = pdf.copy()
            for i, m in enumerate(numbers):
                out[m], out[f"{m}_filled"] = fx[:, i], np.isnan(x[:, i])
            for j, m in enumerate(categories):
                out[m], out[f"{m}_filled"] = fc[:, j], c[:, j] < 0
            yield out

    return df.mapInPandas(run, schema)
