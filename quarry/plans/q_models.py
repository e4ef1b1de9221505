"""pyspark.ml model wrappers, feature selection, PCA and the cleaning pipeline (M*, N*, O5, T4, W6)."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarry.operators import impute, model, rank, sample, shape
from quarry.plans.registry import null_when, register, t
from quarry.session import cut_lineage

FEATS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def regression_frame(spark, d, folds=0):
    """lineitem joined to part: predict the extended price from item features, with a split and, if asked for, ``folds`` folds.

    Every fit scans its input several times and scoring reads it again, so the
    join runs once and its numbers are written; ``rid`` and the vector are
    derived from them on reading.
    """
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    rid = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("rid")
    j = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", *FEATS, F.col("l_extendedprice").alias("y"), rid)
    j = sample.random_split(j, "rid", [0.8, 0.2])
    j = cut_lineage((sample.kfold(j, folds, "rid") if folds else j).drop("rid"), plain=True)
    return model.assemble(j.select("l_orderkey", "l_linenumber", *FEATS, "y", rid, *j.columns[len(FEATS) + 3:]), FEATS)


@register("m01_m02_m03_regressors")
def m01_m02_m03_regressors(spark, d):
    """Boosted trees, random forest, ridge and lasso fitted on train, scored on test (M1-M3, M9)."""
    df = regression_frame(spark, d)
    train, test = df.filter("split = 0"), df.filter("split = 1")
    rows = []
    for name, kind, params in [("gbt", "gbt", {"maxIter": 10, "maxDepth": 4}),
                               ("rf", "rf", {"numTrees": 20, "maxDepth": 6}),
                               ("ridge", "linear", {"regParam": 0.1, "elasticNetParam": 0.0}),
                               ("lasso", "linear", {"regParam": 0.1, "elasticNetParam": 1.0})]:
        m = model.fit_regressor(train, "features", "y", kind=kind, **params)
        r = model.regression_metrics(m.transform(test), "y", "prediction").first()
        rows.append((name, float(r["r2"]), float(r["rmse"]), float(r["mae"])))
    return spark.createDataFrame(rows, "model string, r2 double, rmse double, mae double")


@register("m04_regularisation_path")
def m04_regularisation_path(spark, d):
    """Lasso coefficients over a penalty grid (M4)."""
    df = regression_frame(spark, d)
    return model.regularisation_path(df, "features", "y", FEATS, [0.01, 0.1, 1.0, 10.0, 100.0], l1_ratio=1.0)


@register("m05_cv_search")
def m05_cv_search(spark, d):
    """Seeded random search over a grid with 3 folds (M5); runs table."""
    from pyspark.ml.regression import RandomForestRegressor
    df = regression_frame(spark, d).filter("split = 0").select("features", "y")  # the folds are cached row by row
    est = RandomForestRegressor(featuresCol="features", labelCol="y", seed=42)
    _, runs = model.cv_search(df, est, {"numTrees": [5, 10], "maxDepth": [3, 5]},
                              RegressionEvaluator(labelCol="y", metricName="rmse"), folds=3, n_iter=3)
    return runs


def classification_frame(spark, d):
    """labels joined to document features: predict quality."""
    lab, doc = t(spark, d, "labels"), t(spark, d, "documents")
    j = lab.join(doc, "doc_id").select("doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"),
                                       F.length("text").cast("double").alias("n_len"),
                                       F.size(F.split("text", "\\s+")).cast("double").alias("n_words"),
                                       (F.col("lang") == "en").cast("double").alias("is_en"))
    return model.assemble(j, ["n_chars", "n_len", "n_words", "is_en"])


@register("m06_gbt_classifier")
def m06_gbt_classifier(spark, d):
    """Two boosted-tree configurations fitted on one split, compared on the other by AUC and business cost."""
    from pyspark.ml.functions import vector_to_array
    both = sample.random_split(classification_frame(spark, d), "doc_id", [0.75, 0.25])
    df, held = model.class_weights(both.filter("split = 0"), "quality"), both.filter("split = 1")
    rows = []
    for name, params in [("shallow", {"maxIter": 10, "maxDepth": 2}), ("deep", {"maxIter": 10, "maxDepth": 4})]:
        m = model.fit_classifier(df, "features", "quality", kind="gbt", weight="weight", **params)
        pred = m.transform(held).withColumn("p1", vector_to_array("probability")[1])
        a = model.auc(pred, "quality", "p1").first()["auc"]
        c = model.business_cost(pred, "quality", "p1", 0.434).first()["cost"]
        rows.append((name, float(a), float(c)))
    runs = spark.createDataFrame(rows, "model string, auc double, cost double")
    return runs.withColumn("best_by_cost", F.col("model") == runs.agg(F.min_by("model", "cost")).scalar())


@register("m17_out_of_fold")
def m17_out_of_fold(spark, d):
    """Out-of-fold predictions from 3 folds."""
    df = regression_frame(spark, d, folds=3)

    def fit(part):
        return model.fit_regressor(part, "features", "y", kind="linear", regParam=0.0)
    oof = model.out_of_fold(df, "fold", fit, 3)
    return oof.select("rid", "fold", "y", "prediction")


@register("n01_select_by_corr")
def n01_select_by_corr(spark, d):
    """Greedy correlation-based selection with a collinearity bound, on the training split."""
    df = regression_frame(spark, d).filter("split = 0").withColumn("qty2", F.col("l_quantity") * 2 + 1)
    kept, removed = model.select_by_corr(df, "y", FEATS + ["qty2"], n=4, tau=0.9)
    rows = [(c, True) for c in kept] + [(c, False) for c in removed]
    return spark.createDataFrame(rows, "feature string, kept boolean")


@register("n02_rfe")
def n02_rfe(spark, d):
    """Recursive feature elimination to 2 features by forest importances."""
    df = regression_frame(spark, d)
    return model.rfe(df, FEATS, "y", 2, kind="rf", numTrees=10, maxDepth=4)


@register("n03_rfe_cv")
def n03_rfe_cv(spark, d):
    """RFE with the number of features chosen by 3-fold CV.

    The elimination runs inside each fold on its training rows; the chosen
    number is then eliminated to on all rows.  The folds do not depend on each
    other, so their fits run side by side.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    df = regression_frame(spark, d, folds=3)
    sizes = range(1, len(FEATS) + 1)

    def fold_scores(f):
        tr, te = df.filter(F.col("fold") != f), df.filter(F.col("fold") == f)
        ranking = model.rfe(tr, FEATS, "y", 1, kind="rf", numTrees=10, maxDepth=4).collect()
        order = [r["feature"] for r in sorted(ranking, key=lambda r: (r["ranking"], r["feature"]))]
        out = []
        for n in sizes:
            m = model.fit_regressor(model.assemble(tr, order[:n], "__f"), "__f", "y", kind="rf", numTrees=10, maxDepth=4)
            r = model.regression_metrics(m.transform(model.assemble(te, order[:n], "__f")), "y", "prediction").first()
            out.append((r["r2"], r["rmse"]))
        return out

    with ThreadPool(3) as pool:
        folds = pool.map(inheritable_thread_target(spark)(fold_scores), range(3))
    mean = {n: tuple(sum(x) / len(x) for x in zip(*(f[n - 1] for f in folds))) for n in sizes}
    best = max(mean, key=lambda n: (mean[n][0], -n))
    kept = model.rfe(df, FEATS, "y", best, kind="rf", numTrees=10, maxDepth=4).filter("ranking = 1")
    names = ",".join(sorted(r["feature"] for r in kept.collect()))
    rows = [(n, float(r2), float(rmse), n == best, names if n == best else None) for n, (r2, rmse) in mean.items()]
    return spark.createDataFrame(rows, "n_features int, cv_r2 double, cv_rmse double, chosen boolean, features string")


@register("n04_feature_importance")
def n04_feature_importance(spark, d):
    """Tree feature importances, top 3."""
    df = regression_frame(spark, d)
    m = model.fit_regressor(df, "features", "y", kind="rf", numTrees=20, maxDepth=5)
    return model.feature_importance(m, FEATS, spark, n=3)


def emb_vectors(spark, d):
    return t(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))


@register("n05_pca_transform")
def n05_pca_transform(spark, d):
    """PCA fit/transform to 5 components."""
    from pyspark.ml.functions import vector_to_array
    e = emb_vectors(spark, d)
    m = model.pca(e, "v", 5)
    return m.transform(e).select("vec_id", vector_to_array("pca").alias("pca"))


@register("n06_pca_variance")
def n06_pca_variance(spark, d):
    """Smallest k reaching 90 % explained variance, with the cumulative share table."""
    e = emb_vectors(spark, d)
    k, m = model.pca_for_variance(e, "v", 0.9)
    ev = [(i + 1, float(x)) for i, x in enumerate(m.explainedVariance.toArray())]
    tab = spark.createDataFrame(ev, "component int, explained double")
    return rank.cumulative_share(tab, "component", "explained", threshold=0.9).withColumn("k_for_90", F.lit(k))


@register("n07_pca_loadings")
def n07_pca_loadings(spark, d):
    """Loadings sorted by |PC1|."""
    c = t(spark, d, "customer").select(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"),
                                       F.col("c_custkey").cast("double"))
    from quarry.operators.encode import apply_standard, fit_standard
    cols = ["c_acctbal", "c_nationkey", "c_custkey"]
    z = model.assemble(apply_standard(c, fit_standard(c, cols), cols), cols, "v")
    return model.pca_loadings(model.pca(z, "v", 2), cols, spark)


@register("t04_seeded_shuffle")
def t04_seeded_shuffle(spark, d):
    """Seeded shuffle, independent of partitioning (T4)."""
    return rank.seeded_shuffle(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7)


@register("o05_cleaning_pipeline")
def o05_cleaning_pipeline(spark, d):
    """Product cleaning end to end: substring filter, sparse-column pruning, key dedup,
    sentinel -> NULL, IQR rows, cascade fill, regression fill, k-NN fill (O5)."""
    p = t(spark, d, "part")
    raw = p.select("p_partkey", "p_name", "p_brand", "p_type",
                   F.when(F.col("p_size") == 50, F.lit("unknown")).otherwise(F.col("p_size").cast("string")).alias("size_txt"),
                   null_when("p_partkey", 3, "p_retailprice").alias("price"),
                   null_when("p_partkey", 5, F.col("p_size").cast("double")).alias("size"),
                   F.lit(None).cast("double").alias("empty_col"))
    x = shape.filter_contains(raw, "p_name", "e")
    x = shape.prune_sparse(x, 0.3, strict=True)
    x = shape.dedup_first(x, ["p_partkey"], ["p_name"])
    x = shape.nullify(x, ["size_txt"], "unknown")
    x = cut_lineage(impute.iqr_filter(x, ["price", "size"], factor=1.5, keep_null=True))     # read by every fill
    x = impute.fill_cascade(x, "price", ["p_brand", "p_type"])
    x = impute.fill_regression(x, "size", "price")
    vec = F.array(F.col("price"), F.col("size"))
    x = x.withColumn("v", vec).withColumn("size2", F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.lit(None))
                                          .otherwise(F.col("size")))
    x = impute.fill_knn(x, "size2", "v", "p_partkey", k=5)
    return x.drop("v")


@register("r02_explain_trees")
def r02_explain_trees(spark, d):
    """Path attributions of a boosted-tree model for every line item, top 3 features (R2, trees)."""
    from quarry.operators import score
    df = regression_frame(spark, d)
    m = model.fit_regressor(df, "features", "y", kind="gbt", maxIter=10, maxDepth=3)
    return score.explain_trees(df, m, FEATS, "rid", combine="sum", n_top=3)
