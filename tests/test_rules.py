"""Hand-computed frames for the pandas/sklearn semantics the operators carry over."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import columns as fc
from quarry.operators import agg, encode, impute, rank, shape, stats


def test_nan_to_null_and_safe_div(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (2.0, 0.0), (4.0, 2.0)], ["a", "b"])
    r = df.select(fc.nan_to_null("a").alias("a"), fc.safe_div("a", "b").alias("q")).collect()
    assert r[0]["a"] is None and r[1]["q"] is None and r[2]["q"] == 2.0


def test_sum_of_missing_is_zero_and_var_singleton_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, x double")
    out = {r["k"]: r for r in agg.agg_features(df, "k", {"x": ["sum", "var"]}, "P").collect()}
    assert out[1]["P_X_SUM"] == 0 and out[2]["P_X_VAR"] is None


def test_filtered_group_without_rows_is_null(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, x double")
    out = {r["k"]: r for r in agg.agg_features(df, "k", {"x": ["sum"]}, "A", where=F.col("s") == "a").collect()}
    assert out[1]["A_X_SUM"] == 1.0 and out[2]["A_X_SUM"] is None


def test_constant_column_corr_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], ["a", "b"])
    assert stats.corr_matrix(df, ["a", "b"]).first()["r"] is None


def test_quantile_linear_interpolation(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], ["x"])
    v = {r["quantile"]: r["value"] for r in agg.quantiles(df, ["x"], [0.25, 0.5]).collect()}
    s = pd.Series([1, 2, 3, 4])
    assert v[0.25] == s.quantile(0.25) and v[0.5] == s.quantile(0.5)


def test_bround_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], ["x"])
    r = df.select(F.bround("x", 2).alias("a"), F.bround("x", 0).alias("b")).collect()
    assert [x["a"] for x in r[:2]] == [0.12, 0.38] and r[2]["b"] == 2.0


def test_population_std_standardise(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], ["x"])
    out = encode.apply_standard(df, encode.fit_standard(df, ["x"]), ["x"]).collect()
    assert [r["x"] for r in out] == [-1.0, 1.0]


def test_cut_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,)], ["x"])
    out = [r["b"] for r in rank.cut(df, "x", [0, 1, 2], ["lo", "hi"], out="b").collect()]
    assert out == [None, "lo", "hi", "hi"]


def test_qcut_ties_share_bin_and_duplicate_edges_raise(spark):
    vals = [1, 1, 2, 2, 2, 3, 4, 4, 5]
    df = spark.createDataFrame([(float(x),) for x in vals], ["x"])
    out = [r["b"] for r in rank.qcut(df, "x", 3, [1, 2, 3], out="b").orderBy("x").collect()]
    assert out == pd.qcut(pd.Series(vals), 3, labels=[1, 2, 3]).astype(int).tolist()
    dup = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3]], ["x"])
    with pytest.raises(Exception, match="duplicate bin edges"):
        rank.qcut(dup, "x", 2, out="b").collect()


def test_label_encoder_nan_level_sorts_by_code_point(spark):
    df = spark.createDataFrame([("b",), (None,), ("Z",), ("a",)], "c string")
    out = encode.apply_codes(df, encode.fit_label_encoder(df, ["c"])).collect()
    # sorted levels: 'NaN' < 'Z' < 'a' < 'b'
    assert [r["c"] for r in out] == [3, 0, 1, 2]


def test_recency_flag_null_is_zero(spark):
    df = spark.createDataFrame([(0.5,), (None,), (3.0,)], "x double")
    assert [r[0] for r in df.select(fc.lt_flag("x", 1)).collect()] == [1, 0, 0]


def test_calendar_months_and_fractional_days(spark):
    df = spark.createDataFrame([("2018-10-17 00:00:00",)], ["s"]).select(F.col("s").cast("timestamp_ntz").alias("t"))
    r = df.select(F.add_months(F.col("t").cast("date"), -3).alias("m"),
                  fc.frac_days(F.col("t") + F.expr("INTERVAL 36 HOURS"), "t").alias("d")).first()
    assert str(r["m"]) == "2018-07-17" and r["d"] == 1.5


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 5, "only")], ["k", "o", "v"])
    out = {r["k"]: r["v"] for r in shape.dedup_first(df, ["k"], ["o"]).collect()}
    assert out == {1: "early", 2: "only"}


def test_group_mean_fill_null_group_stays_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, None), ("b", 3.0)], "g string, x double")
    out = impute.fill_group_mean(df, "x", "g").collect()
    got = sorted((r["g"] or "", r["x"] if r["x"] is not None else -1) for r in out)
    assert got == [("", -1), ("a", 1.0), ("a", 1.0), ("b", 3.0)]


def test_avg_rank_matches_pandas(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 5.0, 3.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], ["i", "x"])
    got = [r["x_rank"] for r in rank.avg_rank(df, "x", n_buckets=3).orderBy("i").collect()]
    assert got == pd.Series(vals).rank(method="average").tolist()


def test_chi2_matches_textbook(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    r = stats.chi2(spark.createDataFrame(rows, ["a", "b"]), "a", "b")
    # expected counts 12, 18, 28, 42
    want = (10 - 12) ** 2 / 12 + (20 - 18) ** 2 / 18 + (30 - 28) ** 2 / 28 + (40 - 42) ** 2 / 42
    assert math.isclose(r["statistic"], want, rel_tol=1e-12) and r["dof"] == 1
    assert 0.0 < r["p_value"] < 1.0


def test_special_functions():
    from quarry.functions import special
    assert math.isclose(special.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(special.t_sf_two_sided(2.228138851986274, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(special.norm_sf(1.959963984540054), 0.025, rel_tol=1e-9)


def test_parse_labels_reference_examples(spark):
    labels = ["POLITICS", "CRIME", "BUSINESS", "ENTERTAINMENT", "COMEDY"]
    texts = ['["POLITICS", "CRIME", "BUSINESS"]', "The article is about POLITICS and CRIME.",
             'Here are my predictions:\n["ENTERTAINMENT", "COMEDY"]', "nothing here", '["politics ", "nope"]',
             "[not json] but CRIME"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], ["i", "t"])
    out = [r["p"] for r in df.select("i", fc.parse_labels(F.col("t"), labels, 3).alias("p")).orderBy("i").collect()]
    assert out == [["POLITICS", "CRIME", "BUSINESS"], ["POLITICS", "CRIME"], ["ENTERTAINMENT", "COMEDY"], [],
                   ["POLITICS"], ["CRIME"]]


def test_reciprocal_rank(spark):
    df = spark.createDataFrame([("a", ["b", "a"]), ("c", ["a"]), ("a", ["a"])], "t string, p array<string>")
    assert [r[0] for r in df.select(fc.reciprocal_rank("t", "p")).collect()] == [0.5, 0.0, 1.0]


def test_cumulative_share_first_reaching_and_never_reached(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 2.0)], "pos int, v double")
    out = {r["pos"]: r for r in rank.cumulative_share(df, "pos", "v", threshold=0.8).collect()}
    assert [round(out[i]["cum_share"], 9) for i in (1, 2, 3)] == [0.5, 0.8, 1.0]
    assert [out[i]["reaches"] for i in (1, 2, 3)] == [False, True, False]
    none = rank.cumulative_share(df, "pos", "v", threshold=1.5).collect()
    assert all(r["reaches"] is None for r in none)


def test_running_best_marks_only_strict_improvements(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 1.0)], "trial int, cost double")
    out = rank.running_best(df, "trial", "cost", higher_is_better=False).orderBy("trial").collect()
    assert [r["prev_best"] for r in out] == [None, 3.0, 2.0, 2.0]
    assert [r["is_new_best"] for r in out] == [True, True, False, True]
