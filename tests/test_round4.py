"""Inputs written once for many passes, neighbours with gaps by matrix products, window rows that are not shuffled, shared term tables."""

import glob
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster, joins, model, textclf
from quarry.plans import catalog, q_models
from quarry.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """Tables that the operators write on the way."""
    seen = []

    def keep(module):
        real = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, *a, **k: (seen.append(df), real(df, *a, **k))[1])
    return keep, seen


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_regression_frame_is_joined_once(spark):
    for folds, last in ((0, "split"), (3, "fold")):
        df = q_models.regression_frame(spark, SF, folds)
        assert "Join" not in plan(df) and df.columns[-2:] == [last, "features"] and df.filter("rid is null or split is null").count() == 0


def test_plain_tables_bound_the_rows_of_a_split_by_its_bytes(spark):
    df = spark.range(200_000).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(3).cast("double").alias("c"))
    path = cut_lineage(df, plain=True).inputFiles()[0].removeprefix("file:")
    assert sum(os.path.getsize(f) for f in glob.glob(os.path.dirname(path) + "/*.parquet")) >= 200_000 * 3 * 8


def test_rfe_folds_run_side_by_side(spark, monkeypatch):
    real, threads = model.rfe, set()
    monkeypatch.setattr(model, "rfe", lambda *a, **k: (threads.add(threading.get_ident()), real(*a, **k))[1])
    rows = catalog.QUERIES["n03_rfe_cv"](spark, SF).collect()
    assert [r["n_features"] for r in rows] == [1, 2, 3, 4, 5] and sum(r["chosen"] for r in rows) == 1
    assert len(threads) > 2


def test_search_holds_only_what_it_reads(spark, monkeypatch):
    got = []
    monkeypatch.setattr(model, "cv_search", lambda df, *a, **k: (got.append(df.columns), (None, df))[1])
    catalog.QUERIES["m05_cv_search"](spark, SF)
    assert got == [["features", "y"]]


@pytest.mark.parametrize("odd", [None, np.inf, 1e200])
def test_nan_aware_neighbours_by_product_equal_all_pairs(odd):
    r = np.random.default_rng(3)
    X, Q = r.normal(size=(300, 6)).round(1), r.normal(size=(40, 6)).round(1)
    X[r.random(X.shape) < 0.4], Q[r.random(Q.shape) < 0.4] = np.nan, np.nan
    X[5], Q[7] = np.nan, np.nan
    if odd is not None:
        X[9, 2] = odd
    row, col, dist = joins._nan_distances(Q, X)
    near = joins._nan_nearest(Q, X, joins._nan_side(X, False), 5)
    for i in range(len(Q)):
        want = sorted(zip(dist[row == i], col[row == i]))[:5]
        got = sorted((d, c) for d, c in zip(near[2][near[0] == i], near[1][near[0] == i]) if np.isfinite(d))[:5]
        assert [c for _, c in got] == [c for _, c in want] and np.allclose([d for d, _ in got], [d for d, _ in want], rtol=1e-14)
    if odd is None:
        assert len(near[0]) < len(row) / 5     # ties and rounding only, not all pairs


def test_neighbour_searches_write_a_vector_once_and_as_it_came(spark, written):
    keep, seen = written
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(600, 4)))], "id long, v array<float>")
    keep(joins)
    exact = {(x.id, x.rank): x.nn_key for x in joins.knn_join(df, df, "v", 3, "id", "id", exclude_self=True, n_regions=12, block=64).collect()}
    joins.knn_lsh(df, df, "v", 3, "id", "id", exclude_self=True, bucket_rows=50).collect()
    vectors = [t for t in seen if {"__lv", "__rv"} & set(t.columns)]
    assert vectors and all(dict(t.dtypes)[c] == "array<float>" for t in vectors for c in t.columns if c in ("__lv", "__rv"))
    assert all(t.count() <= 600 for t in vectors)
    x = np.array([row.v for row in df.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert all(exact[i, k + 1] == j for i in range(600) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3]))


def test_stability_repeats_rows_after_every_shuffle(spark, written):
    keep, seen = written
    keep(cluster)
    rows = [(c, f"2024-01-{day:02d} 00:00:00", float(day * (c or 5))) for c in (1, 2, 3, None) for day in range(1 + (c or 0), 31, 1 + (c or 6))]
    df = spark.createDataFrame(rows, "c int, at string, x double").withColumn("at", F.to_timestamp_ntz("at"))
    scaler, cents = {"x": (10.0, 5.0), "recency": (2.0, 3.0)}, [[-1.0, 0.0], [0.0, 0.0], [1.0, 1.0]]
    out = cluster.cluster_stability(df, "c", "at", {"x": (F.col("x"), "mean")}, "2024-01-01 00:00:00", 9, 2, scaler, cents).collect()
    text = plan(seen[-1])
    assert "Join" not in text and text.index("Generate") < text.index("Window")

    def label(c, end):                      # by definition, from all orders of the window
        own = [(int(a[8:10]), x) for k, a, x in rows if k == c and c is not None and int(a[8:10]) - 1 <= end]
        if not own:
            return 0
        z = [(np.mean([x for _, x in own]) - 10) / 5, (end - (max(a for a, _ in own) - 1) - 2) / 3]
        return int(np.argmin([sum((p - q) ** 2 for p, q in zip(z, ce)) for ce in cents]))

    from collections import Counter
    pairs2 = lambda m: sum(v * (v - 1) / 2 for v in m.values())
    steps = [s for s in range(1, 12) if 9 + 2 * s <= max(int(a[8:10]) for _, a, _ in rows) - 1]
    assert sorted(r.step for r in out) == steps
    for r in out:
        ab = [(label(c, 9), label(c, 9 + 2 * r.step)) for c in (1, 2, 3, None)]
        ij, a, b, n = pairs2(Counter(ab)), pairs2(Counter(x for x, _ in ab)), pairs2(Counter(y for _, y in ab)), 6.0
        top = 0.5 * (a + b) - a * b / n
        assert r.n == 4 and abs(r.ari - ((ij - a * b / n) / top if top else 1.0)) < 1e-12


def test_classifiers_of_one_field_share_tokens_and_terms(spark, written):
    keep, seen = written
    keep(textclf)
    df = spark.createDataFrame([(t, y) for t, y in (("red apple pie", "a"), ("blue sea boat", "b")) for _ in range(8)], "text string, y string")
    kinds = [k for k, _ in textclf.text_classifiers(df, "text", "y", ["binary", "count", "tfidf"], max_iter=3)]
    assert kinds == ["binary", "count", "tfidf"]
    assert sum("__tok" in t.columns for t in seen) == 1 and sum("df" in t.columns for t in seen) == 1 and sum("__tf" in t.columns for t in seen) == 2


def test_texts_are_tokenised_once_for_term_weights(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, "two three")], "id int, text string")
    for out in (textclf.tfidf(df, "id", "text"), textclf.term_features(df, "id", "text")):
        assert "Generate" not in plan(out)
    assert {(r.doc, r.term): r.value for r in textclf.term_features(df, "id", "text", "count", 1.0).collect()} == {
        (1, "one"): 1, (1, "two"): 2, (2, "two"): 1, (2, "three"): 1}


def test_binary_tree_has_many_folders_of_a_label(spark, monkeypatch):
    from quarry.sources import io
    real, roots = io.read_binary_tree, []
    monkeypatch.setattr(io, "read_binary_tree", lambda s, root, **k: (roots.append(root), real(s, root, **k))[1])
    n = sum(r.n_files for r in catalog.QUERIES["s07_binary_tree"](spark, SF).collect())
    root = roots[0].removeprefix("file:")
    assert n == spark.read.parquet(SF + "/pages.parquet").count() == len(glob.glob(root + "/**/*.txt", recursive=True))
    assert len(glob.glob(root + "/**/label=*", recursive=True)) > 32
