"""Behaviours of the reference's scoring-service unit tests, re-expressed on DataFrames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import score, shape


def frame(spark, n=5, with_id=True):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        vals = [float(x) for x in rng.random(5)]
        rows.append(([100000 + i] if with_id else []) + vals)
    cols = (["SK_ID_CURR"] if with_id else []) + [f"feat_{c}" for c in "abcde"]
    return spark.createDataFrame(rows, cols)


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["col (a)", "col-b", "col.c"])
    assert shape.sanitize_columns(df).columns == ["col__a_", "col_b", "col_c"]


def test_clean_names_collision(spark):
    df = spark.createDataFrame([(1, 2)], ["a-b", "a.b"])
    with pytest.raises(ValueError):
        shape.sanitize_columns(df)


def test_align_reorders(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["b", "a", "c"])
    assert shape.align(df, ["a", "b", "c"], mode="strict").columns == ["a", "b", "c"]


def test_align_ignores_id(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7)], ["feat_a", "feat_b", "SK_ID_CURR"])
    out = shape.align(df, ["feat_a", "feat_b"], mode="strict")
    assert "SK_ID_CURR" not in out.columns


def test_align_missing_raises(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    with pytest.raises(ValueError, match="missing"):
        shape.align(df, ["a", "b", "c"], mode="strict")


def test_align_fill_adds_nulls(spark):
    df = spark.createDataFrame([(1.0, 9.0)], ["a", "extra"])
    out = shape.align(df, ["a", "b"], mode="fill")
    assert out.columns == ["a", "b"] and out.first()["b"] is None


W = {f"feat_{c}": 0.5 for c in "abcde"}


def test_output_with_and_without_proba(spark):
    df = frame(spark)
    a = score.score(df, W, -1.0, 0.5, id_col="SK_ID_CURR", return_proba=True)
    b = score.score(df, W, -1.0, 0.5, id_col="SK_ID_CURR", return_proba=False)
    assert a.columns[0] == "SK_ID_CURR" and "proba" in a.columns and "predicted_label" in a.columns
    assert "proba" not in b.columns


def test_output_without_id(spark):
    df = frame(spark, with_id=False)
    out = score.score(df, W, -1.0, 0.5, id_col="SK_ID_CURR")
    assert "SK_ID_CURR" not in out.columns and out.count() == 5


def test_label_threshold_inclusive(spark):
    df = spark.createDataFrame([(1, 0.0)], ["id", "x"])
    out = score.score(df, {"x": 1.0}, 0.0, 0.5, id_col="id").first()  # proba exactly 0.5
    assert out["predicted_label"] == 1 and out["proba"] == 0.5


def test_attribution_columns_and_n_top(spark):
    df = frame(spark)
    means = {c: 0.5 for c in W}
    w = {f"feat_{c}": float(i + 1) for i, c in enumerate("abcde")}
    default = score.explain_linear(df, w, means, id_col="SK_ID_CURR")
    assert len([c for c in default.columns if c.startswith("shap_")]) == 5  # n_top=10 > 5 features
    two = score.explain_linear(df, w, means, id_col="SK_ID_CURR", n_top=2)
    assert [c for c in two.columns if c.startswith("shap_")] == ["shap_feat_e", "shap_feat_d"]


def test_attributions_sum_to_margin(spark):
    df = frame(spark)
    means = {r: v for r, v in df.agg(*[F.avg(c).alias(c) for c in W]).first().asDict().items()}
    att = score.explain_linear(df, W, means, id_col="SK_ID_CURR").toPandas().set_index("SK_ID_CURR")
    pdf = df.toPandas().set_index("SK_ID_CURR")
    margin = sum(0.5 * (pdf[c] - means[c]) for c in W)
    assert np.allclose(att.sum(axis=1), margin)
