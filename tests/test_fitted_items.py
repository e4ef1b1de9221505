"""Fitted items: linear models against normal equations, PCA against numpy, trees and searches by invariants, save and reload by equality."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quarry.operators import cluster, encode, model, sample, textclf
from quarry.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(11)
    x = r.normal(size=(400, 4)) @ np.diag([1.0, 3.0, 0.5, 2.0]) + np.array([0.0, 5.0, -2.0, 1.0])
    y = x @ np.array([2.0, -1.0, 0.0, 0.5]) + 3 + r.normal(size=400) * 0.3
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    df = spark.createDataFrame([(i, *row, t, i % 3) for i, (row, t) in enumerate(zip(x.tolist(), y.tolist()))], "id int, a double, b double, c double, d double, y double, fold int")
    return model.assemble(df.repartition(4), ["a", "b", "c", "d"]).cache()


def test_plain_linear_regression_solves_the_normal_equations(frame, data):
    x, y = data
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    m = model.fit_regressor(frame, "features", "y", kind="linear", regParam=0.0)
    assert np.allclose([m.intercept, *m.coefficients], want, atol=1e-6)


def test_ridge_shrinks_and_meets_its_stationary_point(frame, data):
    x, y = data
    free = model.fit_regressor(frame, "features", "y", kind="linear", regParam=0.0).coefficients.toArray()
    m = model.fit_regressor(frame, "features", "y", kind="linear", regParam=0.5, elasticNetParam=0.0)
    w, s = m.coefficients.toArray(), x.std(axis=0, ddof=1)
    assert np.linalg.norm(w * s) < np.linalg.norm(free * s)
    residual = y - x @ w - m.intercept
    slope = (x - x.mean(axis=0)).T @ residual / len(y)                # equals the penalty's slope, in proportion to w s^2
    ratio = slope / (w * s * s)
    assert np.allclose(ratio, ratio[0], rtol=1e-3) and ratio[0] > 0


def test_lasso_path_drops_features_one_after_the_other(frame, data):
    path = model.regularisation_path(frame, "features", "y", ["a", "b", "c", "d"], [0.001, 0.1, 1.0, 100.0], l1_ratio=1.0).toPandas().pivot(index="penalty", columns="feature", values="coef")
    alive = (path.abs() > 1e-9).sum(axis=1).tolist()
    assert alive == sorted(alive, reverse=True) and alive[-1] == 0 and alive[0] >= 3
    free = model.fit_regressor(frame, "features", "y", kind="linear", regParam=0.0).coefficients.toArray()
    assert np.allclose(path.loc[0.001].to_numpy(), free, atol=0.02)


def test_tree_regressors_beat_the_mean_and_repeat_themselves(frame, data):
    for kind, kw in (("gbt", {"maxIter": 8, "maxDepth": 3}), ("rf", {"numTrees": 10, "maxDepth": 5})):
        got = [model.regression_metrics(model.fit_regressor(frame, "features", "y", kind=kind, **kw).transform(frame), "y", "prediction").first().r2 for _ in range(2)]
        assert got[0] > 0.8 and got[0] == got[1]


def test_search_reports_every_trial_and_returns_the_best(frame):
    from pyspark.ml.regression import LinearRegression
    est = LinearRegression(featuresCol="features", labelCol="y")
    grid = {"regParam": [0.0, 5.0, 50.0], "elasticNetParam": [0.0]}
    best, runs = model.cv_search(frame, est, grid, RegressionEvaluator(labelCol="y", metricName="rmse"), folds=3, fold_col="fold")
    rows = runs.orderBy("trial").collect()
    assert len(rows) == 3 and min(rows, key=lambda r: r.metric).trial == 0 and best.getRegParam() == 0.0
    x = {f: model.fit_regressor(frame.filter(F.col("fold") != f), "features", "y", kind="linear", regParam=0.0).transform(frame.filter(F.col("fold") == f)) for f in range(3)}
    mean = np.mean([model.regression_metrics(p, "y", "prediction").first().rmse for p in x.values()])
    assert abs(rows[0].metric - mean) < 1e-6
    _, some = model.cv_search(frame, est, grid, RegressionEvaluator(labelCol="y"), folds=2, n_iter=2)
    assert some.count() == 2


def test_weighted_classifier_ranks_the_rare_class_first(spark, frame):
    df, weight = model.class_weights(frame.withColumn("rare", (F.col("y") > 3).cast("int")), "rare", out="w"), "w"
    per = df.groupBy("rare").agg(F.sum(weight).alias("w")).collect()
    assert abs(per[0].w - per[1].w) < 1e-6 * per[0].w                    # both classes weigh the same
    m = model.fit_classifier(df, "features", "rare", kind="gbt", weight=weight, maxIter=5, maxDepth=3)
    scored = m.transform(df).withColumn("p", vector_to_array("probability")[1])
    assert model.auc(scored, "rare", "p").first().auc > 0.9


def test_out_of_fold_predictions_come_from_the_other_folds(frame, data):
    x, y = data
    got = {r.id: r.prediction for r in model.out_of_fold(frame, "fold", lambda d: model.fit_regressor(d, "features", "y", kind="linear", regParam=0.0), 3).collect()}
    fold = np.arange(400) % 3
    for f in range(3):
        beta = np.linalg.lstsq(np.column_stack([np.ones((fold != f).sum()), x[fold != f]]), y[fold != f], rcond=None)[0]
        want = np.column_stack([np.ones((fold == f).sum()), x[fold == f]]) @ beta
        assert np.allclose([got[i] for i in np.flatnonzero(fold == f)], want, atol=1e-6)


def test_elimination_keeps_the_features_that_matter(spark, frame):
    got = {r.feature: r.ranking for r in model.rfe(frame.drop("features"), ["a", "b", "c", "d"], "y", 2, kind="rf", numTrees=10, maxDepth=5).collect()}
    assert got["a"] == got["b"] == 1 and sorted(got.values()) == [1, 1, 2, 3]
    m = model.fit_regressor(frame, "features", "y", kind="rf", numTrees=10, maxDepth=5)
    imp = model.feature_importance(m, ["a", "b", "c", "d"], spark, n=3).collect()
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True) and len(imp) == 3 and {imp[0].feature, imp[1].feature} == {"a", "b"}


def test_components_equal_the_singular_value_decomposition(spark, frame, data):
    x = data[0] - data[0].mean(axis=0)
    m = model.pca(frame, "features", 3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(m.explainedVariance.toArray(), (s ** 2 / (s ** 2).sum())[:3], atol=1e-9)
    assert np.allclose(np.abs(m.pc.toArray()), np.abs(vt[:3].T), atol=1e-8)
    load = model.pca_loadings(m, ["a", "b", "c", "d"], spark).collect()
    assert [abs(r.pc1) for r in load] == sorted((abs(r.pc1) for r in load), reverse=True)
    assert {r.feature: abs(r.pc2) for r in load} == pytest.approx(dict(zip("abcd", np.abs(vt[1]))), abs=1e-8)


def test_elbow_falls_and_divisive_groups_split_what_lies_apart(spark):
    r = np.random.default_rng(12)
    x = np.concatenate([r.normal(size=(50, 2)) + c for c in ([0, 0], [20, 0], [0, 20])])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, v array<double>").repartition(3)
    inner = sum(((x[k:k + 50] - x[k:k + 50].mean(axis=0)) ** 2).sum() for k in (0, 50, 100))
    e = [row.inertia for row in cluster.elbow(df, "v", [2, 3, 6]).orderBy("k").collect()]
    assert e[0] > 3 * e[1] > 3 * e[2] / 3 > 0 and abs(e[1] - inner) < 1e-6 * inner
    m = cluster.bisecting_fit(df, "v", 3)
    pred = {row.id: row.prediction for row in m.transform(df.withColumn("__f", array_to_vector("v"))).collect()}
    groups = [{pred[i] for i in range(k, k + 50)} for k in (0, 50, 100)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_preprocessor_encodes_and_scales_as_fitted(spark):
    train = spark.createDataFrame([("x", "u", 1.0, 0.0), ("y", "u", 3.0, 1.0), ("x", "v", 5.0, 1.0), (None, "v", None, 0.0)], "o string, t string, s double, y double")
    p = encode.Preprocessor(ordinal=["o"], target_encoded=["t"], scaled=["s"]).fit(train, "y")
    new = spark.createDataFrame([(1, "y", "u", 3.0), (2, "z", "w", 1.0), (3, None, None, None)], "i int, o string, t string, s double")
    got = {r.i: r.features for r in p.transform(new).collect()}
    prior, sd = 0.5, np.std([1.0, 3.0, 5.0])
    smooth = 1 / (1 + np.exp(-(2 - 20) / 10))
    assert got[1] == pytest.approx([1.0, prior * (1 - smooth) + 0.5 * smooth, 0.0]) and got[2] == pytest.approx([-1.0, prior, -2.0 / sd])
    assert got[3][:2] == pytest.approx([-1.0, prior]) and got[3][2] is None
    assert p.transform(new).columns == ["i", "o", "t", "s", "features"]


def test_text_classifier_reads_back_and_ranks_classes(spark, tmp_path):
    from pyspark.ml import PipelineModel
    rows = [(i, ("the cat and dog run home", "el gato y perro corren casa", "die katze und hund rennen heim")[i % 3] + f" w{i}", ("en", "es", "de")[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows + [(99, None, "en")], "id int, text string, lang string").repartition(3)
    m = textclf.text_classifier(df.filter("id < 45"), "text", "lang", max_iter=10)
    assert m.stages[0].labels == ["de", "en", "es"]
    test = df.filter("id between 45 and 60")
    top = textclf.top_k_classes(m.transform(test), m.stages[0].labels, 2).collect()
    assert all(r.top_k[0] == r.lang and len(r.top_k) == 2 for r in top)
    m.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(test).select("id", "prediction").collect()
    assert sorted(again) == sorted(m.transform(test).select("id", "prediction").collect())
    for kind in ("count", "tfidf"):
        assert textclf.text_classifier(df.filter("id < 45"), "text", "lang", kind=kind, max_iter=5).transform(test).filter("prediction = __y").count() == 15


def test_report_is_written_and_read_back(spark, tmp_path):
    io.write_report(spark, {"auc": 0.75, "n": 12, "name": "é"}, str(tmp_path / "r"))
    got = spark.read.json(str(tmp_path / "r")).collect()
    assert len(got) == 1 and (got[0].auc, got[0].n, got[0]["name"]) == (0.75, 12, "é")


def test_synthetic_rows_lie_between_minority_neighbours(spark):
    r = np.random.default_rng(13)
    x, y = r.normal(size=(120, 3)), (np.arange(120) % 6 == 0).astype(int)
    df = spark.createDataFrame([(i, v, int(t)) for i, (v, t) in enumerate(zip(x.tolist(), y.tolist()))], "id long, v array<double>, y int")
    out = sample.smote(df, "v", "y", "id", ratio=0.5, k=3).collect()
    new = [row for row in out if row.synthetic]
    assert len(new) == 50 - 20 and all(row.y == 1 and row.id is None for row in new)
    mine = np.flatnonzero(y)
    for row in new:
        src = row.source_key
        near = sorted((j for j in mine if j != src), key=lambda j: (np.linalg.norm(x[j] - x[src]), j))[:3]
        d = np.array(row.v) - x[src]
        fits = [np.linalg.norm(d - (d @ (x[j] - x[src])) / np.dot(x[j] - x[src], x[j] - x[src]) * (x[j] - x[src])) < 1e-9 and -1e-9 <= d @ (x[j] - x[src]) <= np.dot(x[j] - x[src], x[j] - x[src])
                for j in near]
        assert any(fits)


def test_cleaning_pipeline_and_grid_give_whole_results(spark):
    import __spark_entry__ as E
    q = E.queries()
    out = q["o05_cleaning_pipeline"](spark, SF)
    assert out.count() > 0 and out.filter("price is null or size is null or size2 is null").count() == 0
    assert out.filter("p_name not like '%e%' and p_name not like '%E%'").count() == 0 and "empty_col" not in out.columns
    grid = q["q08_comparison_grid"](spark, SF).collect()
    assert len(grid) >= 9
