"""Pluggable predictors over long tables, by Arrow batches or per series, and their registry."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contexts(df: DataFrame, keys: Sequence[str], order: str, value: str, length: int) -> DataFrame:
    """Adds ``context``: the last ``length`` values up to and with the row, in order; null unless all are known."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    full = F.count(value).over(w) == length
    return df.withColumn("context", F.when(full, F.collect_list(value).over(w)))


def apply_predictor(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], name: str = "prediction") -> DataFrame:
    """Adds ``name`` (an array): the model's answer to each row's context scaled to mean 0 and deviation 1, scaled back and kept at least zero.

    model: (rows, length) to (rows, horizon). Rows without context get null.
    """
    schema = T.StructType([*df.drop(name).schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.copy()
            ok = pdf["context"].notna().to_numpy()
            said: list = [None] * len(pdf)
            if ok.any():
                x = np.array(pdf.loc[ok, "context"].tolist(), dtype="float64")
                mean, std = x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True)
                std[std < 1e-8] = 1.0
                y = np.maximum(np.asarray(model((x - mean) / std)) * std + mean, 0.0)
                for i, row in zip(np.flatnonzero(ok), y, strict=True):
                    said[i] = row.tolist()
            out[name] = said
            yield out

    return df.drop(name).mapInPandas(run, schema)


def register(folder: str, name: str, metadata: dict) -> str:
    """Writes a model's metadata; context, horizon and resolution are required."""
    missing = [k for k in ("context", "horizon", "resolution_minutes") if k not in metadata]
    if missing:
        raise ValueError("metadata lacks " + ", ".join(missing))
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.json")
    with open(path + ".new", "w") as f:
        json.dump(metadata, f, sort_keys=True)
    os.replace(path + ".new", path)
    return path


def compatible(folder: str, name: str, *, context: int, horizon: int, resolution_minutes: int) -> dict:
    """The metadata, if the model fits; else an error that says what differs."""
    with open(os.path.join(folder, f"{name}.json")) as f:
        m = json.load(f)
    want = {"context": context, "horizon": horizon, "resolution_minutes": resolution_minutes}
    wrong = [f"{k} is {m.get(k)}, not {v}" for k, v in want.items() if m.get(k) != v]
    if wrong:
        raise ValueError(f"{name}: " + "; ".join(wrong))
    return m
