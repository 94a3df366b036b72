"""Predictors over contexts, and the registry."""

import numpy as np
import pytest

from voltloom.operators.predict import apply_predictor, compatible, contexts, register


def test_predictor_sees_scaled_contexts(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(6)] + [("b", 0, None), ("b", 1, 1.0)], "k string, i int, v double")
    x = contexts(df, ["k"], "i", "v", 3)
    got = {(r.k, r.i): r.said for r in apply_predictor(x, lambda c: c[:, -2:], "said").collect()}
    assert got["a", 1] is None and got["b", 1] is None
    assert got["a", 4] == pytest.approx([3.0, 4.0])
    assert apply_predictor(x.limit(0), lambda c: c, "said").count() == 0
    assert min(apply_predictor(x, lambda c: np.full((len(c), 1), -99.0), "said").where("said is not null").first().said) == 0.0


def test_registry_refuses_other_shapes(tmp_path):
    register(str(tmp_path), "m", {"context": 336, "horizon": 48, "resolution_minutes": 30})
    assert compatible(str(tmp_path), "m", context=336, horizon=48, resolution_minutes=30)["horizon"] == 48
    with pytest.raises(ValueError, match="horizon is 48, not 24"):
        compatible(str(tmp_path), "m", context=336, horizon=24, resolution_minutes=30)
    with pytest.raises(ValueError):
        register(str(tmp_path), "x", {"context": 1})
