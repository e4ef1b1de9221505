"""Model fitting (pyspark.ml) and evaluation metrics (M*, N*).

Metrics are single aggregate passes.  The exact ROC AUC uses per-score
counts and bucketed cumulative ranks (no global sort of rows); the threshold
sweep buckets each row once against the literal threshold array and takes
suffix sums over at most n+1 buckets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rank import rank_table
from quarry.operators.shape import q


# ---------------------------------------------------------------- regression metrics

def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """R^2, RMSE and MAE in one pass (M9)."""
    err = q(y) - q(yhat)
    sse = F.sum(err * err)
    sst = F.var_pop(q(y)) * F.count(q(y))
    return df.agg((1 - F.try_divide(sse, sst)).alias("r2"), F.sqrt(F.avg(err * err)).alias("rmse"),
                  F.avg(F.abs(err)).alias("mae"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- classification metrics

def _zdiv(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    pred = (q(p) >= F.lit(threshold))
    pos = q(y) == 1
    return df.agg(F.count(F.when(pos & pred, 1)).alias("tp"), F.count(F.when(~pos & pred, 1)).alias("fp"),
                  F.count(F.when(pos & ~pred, 1)).alias("fn"), F.count(F.when(~pos & ~pred, 1)).alias("tn"))


def binary_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, beta: float = 2.0) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and F-beta; 0/0 -> 0."""
    c = confusion_counts(df, y, p, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _zdiv(tp, tp + fp), _zdiv(tp, tp + fn)
    b2 = beta * beta
    return c.select("tp", "fp", "fn", "tn",
                    _zdiv(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    _zdiv(2 * prec * rec, prec + rec).alias("f1"),
                    _zdiv((1 + b2) * prec * rec, b2 * prec + rec).alias("fbeta"))


def auc(df: DataFrame, y: str, p: str, n_buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC with tied scores counted one half.

    Mann-Whitney form: (sum of positive ranks - P(P+1)/2) / (P N) with
    average-tie ranks of the score.
    """
    rt = rank_table(df.filter(q(y).isNotNull()), p, weights={"pos": (q(y) == 1).cast("long")},
                    n_buckets=n_buckets)
    s = rt.agg(F.sum(F.col("pos") * F.col("rank")).alias("rs"), F.sum("pos").alias("P"),
               (F.sum("cnt") - F.sum("pos")).alias("N"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    return s.select(F.try_divide(F.col("rs") - P * (P + 1) / 2, P * N).alias("auc"),
                    F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """Mean binary cross-entropy with clipped probabilities."""
    pc = F.least(F.greatest(q(p).cast("double"), F.lit(eps)), F.lit(1 - eps))
    ll = -(q(y) * F.ln(pc) + (1 - q(y)) * F.ln(1 - pc))
    return df.agg(F.avg(ll).alias("log_loss"))


def business_cost(df: DataFrame, y: str, p: str, threshold: float, cost_fn: float = 6, cost_fp: float = 2,
                  reward_tp: float = 5, reward_tn: float = 2) -> DataFrame:
    """Net cost = losses (FN, FP) minus gains (TP, TN) at a threshold."""
    c = confusion_counts(df, y, p, threshold)
    cost = (F.col("fn") * cost_fn + F.col("fp") * cost_fp) - (F.col("tp") * reward_tp + F.col("tn") * reward_tn)
    return c.withColumn("cost", cost.cast("double"))


def thresholds(n: int = 200, lo: float = 0.01, hi: float = 0.99) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, n)]


def threshold_sweep(df: DataFrame, y: str, p: str, n: int = 200, lo: float = 0.01, hi: float = 0.99,
                    cost_fn: float = 6, cost_fp: float = 2, reward_tp: float = 5,
                    reward_tn: float = 2) -> DataFrame:
    """Confusion counts and net cost at each of n thresholds, in one pass.

    Each row's bucket = number of thresholds <= its probability, so it is
    predicted positive exactly for the thresholds below that index.  Rows
    without a probability count nowhere, as in the confusion counts.
    """
    ts = thresholds(n, lo, hi)
    arr = F.array(*[F.lit(t) for t in ts])
    b = F.size(F.filter(arr, lambda t: t <= q(p)))
    pos = (q(y) == 1)
    counts = df.filter(q(p).isNotNull()).groupBy(b.alias("b")).agg(F.count(F.when(pos, 1)).alias("pos"),
                                          F.count(F.when(~pos, 1)).alias("neg"))
    grid = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("b"))
    c = grid.join(counts, "b", "left").fillna(0, subset=["pos", "neg"])
    w = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)  # <= n+1 rows
    c = c.withColumn("pos_ge", F.sum("pos").over(w)).withColumn("neg_ge", F.sum("neg").over(w))
    everything = Window.partitionBy()  # over the <= n+1 bucket rows only
    c = c.withColumn("__P", F.sum("pos").over(everything)).withColumn("__N", F.sum("neg").over(everything))
    P, Nn = F.col("__P"), F.col("__N")
    out = c.filter(F.col("b") >= 1).select(
        (F.col("b") - 1).alias("idx"), F.col("pos_ge").alias("tp"), F.col("neg_ge").alias("fp"), "__P", "__N")
    out = out.withColumn("fn", P - F.col("tp")).withColumn("tn", Nn - F.col("fp"))
    out = out.withColumn("threshold", arr[F.col("idx")])
    cost = (F.col("fn") * cost_fn + F.col("fp") * cost_fp) - (F.col("tp") * reward_tp + F.col("tn") * reward_tn)
    return out.withColumn("cost", cost.cast("double")).select("idx", "threshold", "tp", "fp", "fn", "tn", "cost")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Lowest cost; ties go to the lowest threshold index."""
    return sweep.agg(F.min_by(F.struct("idx", "threshold", "cost"), F.struct("cost", "idx")).alias("b")).select("b.*")


def class_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per-class precision, recall, F1 and support."""
    cells = df.groupBy(q(y).alias("true"), q(yhat).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    tp = cells.filter(F.col("true") == F.col("pred")).select(F.col("true").alias("cls"), F.col("n").alias("tp"))
    sup = cells.groupBy(F.col("true").alias("cls")).agg(F.sum("n").alias("support"))
    prd = cells.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = sup.join(prd, "cls", "full_outer").join(tp, "cls", "left").fillna(0, subset=["tp", "support", "predicted"])
    prec, rec = _zdiv(F.col("tp"), F.col("predicted")), _zdiv(F.col("tp"), F.col("support"))
    return j.select("cls", prec.alias("precision"), rec.alias("recall"),
                    _zdiv(2 * prec * rec, prec + rec).alias("f1"), F.col("support").cast("long").alias("support"))


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(q(y).alias("true"), q(yhat).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Balanced class weights n / (k * n_c) as a column (M7)."""
    counts = df.groupBy(q(y).alias("__c")).agg(F.count(F.lit(1)).alias("__nc"))
    everything = Window.partitionBy()  # one row per class
    n, k = F.sum("__nc").over(everything), F.count(F.lit(1)).over(everything)
    w = counts.select("__c", (n / (k * F.col("__nc"))).alias(out))
    return df.join(w, q(y) == F.col("__c"), "left").drop("__c")


# ---------------------------------------------------------------- model fitting

def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def fit_regressor(df: DataFrame, features: str, label: str, kind: str = "gbt", seed: int = 42, **params):
    """Boosted trees, random forest or (ridge/lasso) linear regression (M1-M3)."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    cls = {"gbt": GBTRegressor, "rf": RandomForestRegressor, "linear": LinearRegression}[kind]
    kw = dict(featuresCol=features, labelCol=label, **params)
    if kind != "linear":
        kw["seed"] = seed
    return cls(**kw).fit(df)


def regularisation_path(df: DataFrame, features: str, label: str, names: list[str], penalties: list[float],
                        l1_ratio: float = 0.0) -> DataFrame:
    """Coefficients over a grid of penalties, long form (M4), one fitMultiple pass."""
    from pyspark.ml.regression import LinearRegression
    lr = LinearRegression(featuresCol=features, labelCol=label, elasticNetParam=l1_ratio, standardization=True)
    maps = [{lr.regParam: float(a)} for a in penalties]
    rows = []
    for i, m in lr.fitMultiple(df, maps):
        for nm, c in zip(names, m.coefficients):
            rows.append((float(penalties[i]), nm, float(c)))
    return df.sparkSession.createDataFrame(rows, "penalty double, feature string, coef double")


def cv_search(df: DataFrame, estimator, grid: dict, evaluator, folds: int = 3, n_iter: int | None = None,
              seed: int = 42, fold_col: str | None = None, parallelism: int = 4):
    """Grid or seeded random search with k folds (M5).  Returns (best model, runs frame)."""
    import random

    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    b = ParamGridBuilder()
    for p, vals in grid.items():
        b = b.addGrid(getattr(estimator, p), vals)
    maps = b.build()
    if n_iter is not None and n_iter < len(maps):
        maps = random.Random(seed).sample(maps, n_iter)
    kw = dict(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, seed=seed,
              parallelism=parallelism)
    if fold_col:
        kw["foldCol"] = fold_col
    cvm = CrossValidator(**kw).fit(df)
    rows = []
    for i, (pm, metric) in enumerate(zip(maps, cvm.avgMetrics)):
        rows.append((i, ", ".join(f"{k.name}={v}" for k, v in pm.items()), float(metric)))
    runs = df.sparkSession.createDataFrame(rows, "trial int, params string, metric double")
    return cvm.bestModel, runs


def fit_classifier(df: DataFrame, features: str, label: str, kind: str = "gbt", seed: int = 42,
                   weight: str | None = None, **params):
    """Boosted-tree or logistic classifier (M6, M8)."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    cls = {"gbt": GBTClassifier, "logistic": LogisticRegression}[kind]
    kw = dict(featuresCol=features, labelCol=label, **params)
    if kind == "gbt":
        kw["seed"] = seed
    if weight:
        kw["weightCol"] = weight
    return cls(**kw).fit(df)


def feature_importance(model, names: list[str], spark, n: int | None = None) -> DataFrame:
    """Importances as a sorted table, optional top n."""
    imp = model.featureImportances.toArray()
    rows = sorted(((nm, float(v)) for nm, v in zip(names, imp)), key=lambda r: (-r[1], r[0]))
    rows = rows[:n] if n else rows
    return spark.createDataFrame(rows, "feature string, importance double")


def out_of_fold(df: DataFrame, fold_col: str, fit_fn, k: int) -> DataFrame:
    """Predictions of models fitted without the row's fold, unioned."""
    parts = []
    for f in range(k):
        m = fit_fn(df.filter(F.col(fold_col) != f))
        parts.append(m.transform(df.filter(F.col(fold_col) == f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rfe(df: DataFrame, cols: list[str], label: str, n: int, kind: str = "rf", seed: int = 42,
        step: int = 1, **params) -> DataFrame:
    """Recursive feature elimination by tree importances down to n features.

    Returns (feature, ranking) with ranking 1 for the kept features.
    """
    remaining = list(cols)
    ranking = {}
    rank_no = len(cols) - n + 1
    while len(remaining) > n:
        m = fit_regressor(assemble(df, remaining, "__f"), "__f", label, kind=kind, seed=seed, **params)
        imp = list(zip(remaining, m.featureImportances.toArray()))
        imp.sort(key=lambda r: (r[1], r[0]))
        drop = [nm for nm, _ in imp[:min(step, len(remaining) - n)]]
        for d in drop:
            ranking[d] = rank_no
        rank_no -= 1
        remaining = [c for c in remaining if c not in drop]
    for c in remaining:
        ranking[c] = 1
    return df.sparkSession.createDataFrame(sorted(ranking.items(), key=lambda r: (r[1], r[0])),
                                           "feature string, ranking int")


def select_by_corr(df: DataFrame, target: str, cols: list[str], n: int = 100, tau: float = 0.9):
    """Rank features by |corr with target|, greedily keep those with |corr| <= tau to every kept one.

    The (d+1) x (d+1) matrix is computed in one Spark pass (block sums); the
    greedy loop runs on that matrix.  Returns (kept, removed) name lists.
    """
    from quarry.operators.gram import named, pair_moments, pearson
    allc = cols + [target]
    got = {(r.a, r.b): r.r for r in named(pair_moments(df, allc), allc).select("a", "b", pearson().alias("r")).collect()}  # one row a pair

    def corr(a, b):
        v = got.get((a, b), got.get((b, a)))
        return 0.0 if v is None else float(v)
    order = sorted(cols, key=lambda c: (-abs(corr(c, target)), c))
    kept, removed = [], []
    for c in order:
        if len(kept) >= n:
            removed.append(c)
            continue
        if all(abs(corr(c, k)) <= tau for k in kept):
            kept.append(c)
        else:
            removed.append(c)
    return kept, removed


def pca(df: DataFrame, vec: str, k: int):
    """PCA fit (N5); returns the model (explainedVariance, pc)."""
    from pyspark.ml.feature import PCA
    return PCA(k=k, inputCol=vec, outputCol="pca").fit(df)


def pca_for_variance(df: DataFrame, vec: str, share: float):
    """(smallest k whose cumulative explained variance reaches ``share``, model with all components)."""
    m = pca(df, vec, len(df.select(vec).first()[0]))
    cum = np.cumsum(m.explainedVariance.toArray())
    hit = np.nonzero(cum >= share - 1e-9)[0]
    if not len(hit):
        raise ValueError(f"all components explain {cum[-1]:.4f}, less than {share}")
    return int(hit[0]) + 1, m


def pca_loadings(model, names: list[str], spark) -> DataFrame:
    """Loadings table sorted by |PC1|."""
    pc = model.pc.toArray()
    rows = [(nm, *[float(x) for x in pc[i]]) for i, nm in enumerate(names)]
    cols = ", ".join(f"pc{j + 1} double" for j in range(pc.shape[1]))
    out = spark.createDataFrame(rows, f"feature string, {cols}")
    return out.orderBy(F.desc(F.abs("pc1")), "feature")
