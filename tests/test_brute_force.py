"""Distributed operators against brute force on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import model, rank
from quarry.operators.joins import knn_join


def brute_knn(X, keys, Q, qkeys, k, exclude_self):
    out = {}
    for qi, q in zip(qkeys, Q):
        d = np.sqrt(((X - q) ** 2).sum(1))
        cand = [(d[j], keys[j]) for j in range(len(keys)) if not (exclude_self and keys[j] == qi)]
        out[qi] = [kk for _, kk in sorted(cand)[:k]]
    return out


def test_knn_exact_clustered_and_uniform(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(4, 6)) * 5
    X = np.vstack([centers[i % 4] + rng.normal(size=6) for i in range(300)])
    X[10] = X[11]  # exact tie
    keys = list(range(300))
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in zip(keys, X)], "id bigint, v array<double>")
    want = brute_knn(X, keys, X, keys, 4, True)
    for n_regions in (None, 1, 40):
        got = knn_join(df, df, "v", 4, "id", "id", exclude_self=True, block=50, n_regions=n_regions).toPandas()
        got = got.sort_values(["id", "rank"]).groupby("id")["nn_key"].apply(list).to_dict()
        assert got == want


def test_knn_fewer_right_rows_than_k(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "id bigint, v array<double>")
    right = spark.createDataFrame([(7, [1.0, 0.0]), (8, [4.0, 4.0])], "id bigint, v array<double>")
    for n_regions in (None, 1, 9):
        got = knn_join(left, right, "v", 3, "id", "id", n_regions=n_regions).orderBy("id", "rank").collect()
        assert [(r["id"], r["nn_key"]) for r in got] == [(1, 7), (1, 8), (2, 8), (2, 7)]


def test_auc_with_ties_matches_pairwise(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400), 1)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], ["y", "p"])
    got = model.auc(df, "y", "p", n_buckets=4).first()["auc"]
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_threshold_sweep_matches_loop(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = rng.random(300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], ["y", "p"])
    sw = model.threshold_sweep(df, "y", "p").orderBy("idx").toPandas()
    for i, t in enumerate(np.linspace(0.01, 0.99, 200)):
        pred = p >= t
        tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
        fn, tn = int((~pred & (y == 1)).sum()), int((~pred & (y == 0)).sum())
        assert (sw.tp[i], sw.fp[i], sw.fn[i], sw.tn[i]) == (tp, fp, fn, tn)
        assert sw.cost[i] == fn * 6 + fp * 2 - tp * 5 - tn * 2
    best = model.best_threshold(model.threshold_sweep(df, "y", "p")).first()
    assert best["idx"] == int(np.argmin(sw.cost.to_numpy()))


def test_avg_rank_by_group_many_buckets(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, 500)
    x = rng.integers(0, 40, 500).astype(float)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(g, x))], ["i", "g", "x"])
    got = rank.avg_rank(df, "x", by="g", n_buckets=7).orderBy("i").toPandas()
    import pandas as pd
    want = pd.DataFrame({"g": g, "x": x}).groupby("g")["x"].rank(method="average")
    assert np.allclose(got["x_rank"].to_numpy(), want.to_numpy())


def test_knn_nan_euclidean_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(120, 5))
    X[rng.random(X.shape) < 0.2] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in x]) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = knn_join(df, df, "v", 3, "id", "id", exclude_self=True, metric="nan_euclidean", block=40).toPandas()
    got = got.sort_values(["id", "rank"]).groupby("id")["nn_key"].apply(list).to_dict()
    want = {}
    for i in range(len(X)):
        cand = []
        for j in range(len(X)):
            if i == j:
                continue
            m = ~np.isnan(X[i]) & ~np.isnan(X[j])
            if m.sum() == 0:
                continue
            d = np.sqrt(((X[i][m] - X[j][m]) ** 2).sum() * X.shape[1] / m.sum())
            cand.append((d, j))
        want[i] = [j for _, j in sorted(cand)[:3]]
    assert got == want


def test_tree_attributions_add_up_to_prediction(spark):
    from pyspark.sql import functions as F

    from quarry.operators import model, score
    rng = np.random.default_rng(6)
    X = rng.normal(size=(300, 3))
    y = 2 * X[:, 0] - X[:, 1] + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, x), float(v)) for i, (x, v) in enumerate(zip(X, y))],
                               ["id", "a", "b", "c", "y"])
    df = model.assemble(df, ["a", "b", "c"])
    for kind, combine in (("gbt", "sum"), ("rf", "mean")):
        m = model.fit_regressor(df, "features", "y", kind=kind, maxDepth=3, **({"maxIter": 5} if kind == "gbt" else {"numTrees": 5}))
        att = score.explain_trees(df, m, ["a", "b", "c"], "id", combine=combine)
        pred = m.transform(df).select("id", "prediction")
        j = att.join(pred, "id").withColumn(
            "recon", F.col("bias") + sum(F.col(c) for c in att.columns if c.startswith("shap_")))
        worst = j.select(F.max(F.abs(F.col("recon") - F.col("prediction")))).first()[0]
        assert worst < 1e-9
        top = [c for c in att.columns if c.startswith("shap_")]
        assert top[0] == "shap_a"


def test_ks_two_sample_matches_numpy(spark):
    from quarry.operators import stats
    rng = np.random.default_rng(7)
    a = np.round(rng.normal(size=400), 1)
    b = np.round(rng.normal(0.3, 1.2, size=300), 1)
    A = spark.createDataFrame([(float(x),) for x in a], ["x"])
    B = spark.createDataFrame([(float(x),) for x in b], ["x"])
    got = stats.ks_two_sample(A, B, "x", n_buckets=5).first()["score"]
    grid = np.union1d(a, b)
    want = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a)
                         - np.searchsorted(np.sort(b), grid, "right") / len(b)))
    assert abs(got - want) < 1e-12


def test_exact_percentiles_match_numpy_with_ties_and_groups(spark):
    from quarry.operators.agg import exact_percentiles
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=400) * 3)  # many ties
    rows = [(int(i % 3), float(v) if i % 17 else None) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for n_buckets in (3, None):
        got = {(r["g"], r["pos"]): r["value"] for r in exact_percentiles(df, "x", qs, "g", n_buckets).collect()}
        for g in range(3):
            xs = np.array([x for k, x in rows if k == g and x is not None])
            want = np.quantile(xs, qs)
            assert all(abs(got[(g, i)] - w) < 1e-9 for i, w in enumerate(want))
