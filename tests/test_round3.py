"""Range-partitioned ranks and percentiles, block sums, pattern fills, neighbours by hashing, runs, progress, samples."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import agg, cluster, gram, impute, joins, model, rank, runs, sample, shape, stats
from quarry.sources import io
from quarry.streaming import stream


def rows_with_gaps(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, float("nan"), float(r.randint(0, 12)), r.random()])) for i in range(n)]
    return spark.createDataFrame(rows, "i int, g string, x double").repartition(5)


@pytest.mark.parametrize("parts", ["3", "2000"])
def test_percentiles_do_not_depend_on_shuffle_partitions(spark, parts):
    df = rows_with_gaps(spark).unionByName(spark.createDataFrame([(-1, "empty", None)], "i int, g string, x double"))
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.g, r.pos): r.value for r in agg.exact_percentiles(df, "x", qs, "g").collect()}
        ranks = {r.i: r.x_rank for r in rank.avg_rank(df, "x", by="g").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    pdf = df.toPandas()
    for g in ("a", "b", None, "empty"):
        v = pdf[pdf.g.isna() if g is None else pdf.g == g].x.dropna()
        for k, q_ in enumerate(qs):
            assert got[g, k] is None if not len(v) else math.isclose(got[g, k], np.quantile(v, q_), rel_tol=1e-12)
    want = pdf.groupby("g", dropna=False).x.rank(method="average")
    assert all(ranks[i] == w if w == w else ranks[i] is None for i, w in zip(pdf.i.tolist(), want.tolist()))


def test_percentile_plan_has_no_edge_array(spark):
    plan = agg.percentiles_long(rows_with_gaps(spark), ["x"], [0.5], "g")._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan


def test_best_row_does_not_depend_on_the_order_of_ties(spark):
    rows = [(2, 1.0), (1, 1.0), (3, 5.0), (4, 5.0), (0, None), (9, float("nan"))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k int, m double").coalesce(1)
        assert rank.arg_best(df, "m", ["k", "m"]).first().k == 1
        assert rank.arg_best(df, "m", ["k", "m"], minimize=False).first().k == 3


def test_block_correlations_equal_pairwise_complete_ones(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK", 3)
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 8)) @ r.normal(size=(8, 8)) + 1e6
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 7.25                                               # constant
    x[:, 6] = np.nan                                             # empty
    cols = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([[None if v != v and k % 2 else v for k, v in enumerate(row)] for row in x.tolist()], ", ".join(f"{c} double" for c in cols)).repartition(7)
    got = {(r_.a, r_.b): r_.r for r_ in stats.corr_matrix(df, cols).collect()}
    assert len(got) == 28
    for i in range(8):
        for j in range(i + 1, 8):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r_ = got[cols[i], cols[j]]
            if {i, j} & {5, 6}:
                assert r_ is None
            else:
                assert math.isclose(r_, np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs_tol=1e-9)
    n = {(p.a, p.b): p.n for p in stats.pairwise_pearson(df, cols[:3]).collect()}
    assert n["c0", "c1"] == (~np.isnan(x[:, 0]) & ~np.isnan(x[:, 1])).sum()
    assert stats.corr_matrix(df.limit(0), cols[:2]).count() == 0


def test_correlation_selection(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=300), r.normal(size=300)
    rows = [(float(p), float(p + 0.01 * e), float(q_), float(2 * p + q_)) for p, q_, e in zip(a, b, r.normal(size=300))]
    kept, removed = model.select_by_corr(spark.createDataFrame(rows, "a double, a2 double, b double, y double"), "y", ["a", "a2", "b"], n=2, tau=0.9)
    assert sorted(kept)[-1] == "b" and len(kept) == 2 and len(removed) == 1


def plain_iterative(x, rounds, ridge, tol):
    gone = np.isnan(x)
    x = np.where(gone, np.nanmean(x, axis=0), x)
    last = {}
    for _ in range(rounds):
        change = 0.0
        for c in range(x.shape[1]):
            if not gone[:, c].any():
                continue
            rest = [k for k in range(x.shape[1]) if k != c]
            f = np.column_stack([np.ones(len(x)), x[:, rest]])
            seen = ~gone[:, c]
            beta = np.linalg.solve(f[seen].T @ f[seen] + ridge * np.eye(f.shape[1]), f[seen].T @ x[seen, c])
            change = max(change, np.max(np.abs(beta - last[c])) if c in last else np.inf)
            last[c] = beta
            x[gone[:, c], c] = f[gone[:, c]] @ beta
        if change < tol:
            break
    return x


@pytest.mark.parametrize("rounds", [1, 3, 20])
def test_iterative_fill_equals_row_by_row_rounds(spark, rounds):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4)) @ r.normal(size=(4, 4)) + np.array([1.0, 5.0, -3.0, 0.0])
    x[:, :3][r.random((300, 3)) < 0.25] = np.nan
    df = spark.createDataFrame([(i, *[None if v != v else v for v in row]) for i, row in enumerate(x.tolist())], "i int, a double, b double, c double, d double").repartition(6)
    got = impute.fill_iterative(df, ["a", "b", "c", "d"], rounds=rounds).orderBy("i").select("a", "b", "c", "d").collect()
    assert np.allclose(np.array([list(g) for g in got]), plain_iterative(x.copy(), rounds, 1e-6, 1e-3), atol=1e-6)


def test_iterative_fill_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0)], "i int, a double, b double")
    assert [tuple(r) for r in impute.fill_iterative(df, ["a", "b"]).orderBy("i").collect()] == [(1, None, 2.0), (2, None, 3.0)]   # nothing to learn from
    full = spark.createDataFrame([(1, 4.0, 2.0), (2, float("nan"), 3.0)], "i int, a double, b double")
    assert all(math.isfinite(r.a) for r in impute.fill_iterative(full, ["a", "b"]).collect())
    assert impute.fill_iterative(df.limit(0), ["a", "b"]).count() == 0


def test_distinct_counts_of_any_type_without_expand(spark):
    rows = [(1, 0.0, "a", [1, 2], None), (1, -0.0, "a", [1, 2], None), (2, float("nan"), None, [2], None), (2, float("nan"), "", None, None), (None, 1.5, "b", [], None)]
    df = spark.createDataFrame(rows, "i int, d double, s string, l array<int>, n string")
    out = agg.distinct_counts(df, df.columns)
    assert {r.column_name: r.n_distinct for r in out.collect()} == {"i": 2, "d": 3, "s": 3, "l": 3, "n": 0}
    assert "Expand" not in out._jdf.queryExecution().toString()
    c = {r.column_name: (r.left_distinct, r.right_distinct) for r in shape.compare_tables(df, df.drop("l")).collect()}
    assert c["s"] == (3, 3) and c["l"] == (3, None)


def test_sample_per_class_takes_the_smallest_hashes_and_ranks_few_rows(spark):
    df = spark.range(6000).selectExpr("id as k", "case when id % 50 = 0 then null when id % 3 = 0 then 'a' else 'b' end as c", "cast(id as string) as payload").repartition(9)
    got = sample.sample_per_class(df, "c", 40, "k", 5)
    want = sample.hash_rank(df, "k", 5, by="c").filter("hash_rank <= 40").drop("hash_rank")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 120
    assert sample.sample_per_class(df.filter("k < 20"), "c", 40, "k", 5).count() == 20


def clustered(spark, n, seed=6, d=16):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(20, d)) * 3
    x = centers[r.integers(0, 20, n)] + r.normal(size=(n, d))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(6)


def test_lsh_neighbours_reach_the_recall(spark):
    df = clustered(spark, 6000)
    same = dict(vec="v", k=5, left_key="id", right_key="id", exclude_self=True)
    exact, found = joins.knn_join(df, df, **same), joins.knn_lsh(df, df, bucket_rows=300, **same)
    r = joins.knn_recall(exact, found, "id").first()
    assert r.n == 30_000 and r.recall >= 0.9
    per = found.groupBy("id").agg(F.count("*").alias("n"), F.max("rank").alias("m")).agg(F.max("n"), F.max("m")).first()
    assert tuple(per) == (5, 5)
    true = {(x.id, x.nn_key): x.dist for x in exact.collect()}
    assert all(abs(true[x.id, x.nn_key] - x.dist) < 1e-9 for x in found.collect() if (x.id, x.nn_key) in true)


def test_lsh_on_small_and_equal_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id long, v array<double>")
    got = joins.knn_lsh(same, same, "v", 2, "id", "id", exclude_self=True, bucket_rows=8).collect()
    assert len(got) == 60 and {r.dist for r in got} == {0.0}
    assert joins.knn_lsh(same, same.limit(0), "v", 2, "id", "id").count() == 0


def test_sampled_silhouette_equals_the_definition(spark):
    r = np.random.default_rng(7)
    x, c = r.normal(size=(90, 3)), r.integers(0, 3, 90)
    c[0] = 3                                                       # a cluster of one
    df = spark.createDataFrame([(i, v, str(k)) for i, (v, k) in enumerate(zip(x.tolist(), c.tolist()))], "id int, v array<double>, c string")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(90):
        own = (c == c[i]) & (np.arange(90) != i)
        a = d[i, own].mean() if own.any() else None
        b = min(d[i, c == k].mean() for k in set(c.tolist()) if k != c[i])
        s.append(0.0 if a is None else (b - a) / max(a, b))
    got = cluster.silhouette_sample(df, "v", "c", "id", 1.0, block=17).first()
    assert got.n == 90 and abs(got.silhouette - np.mean(s)) < 1e-9
    assert cluster.silhouette_sample(df, "v", "c", F.col("id") < 40).first().n == 40


def test_runs_are_logged_once_and_compared(spark, tmp_path):
    path = str(tmp_path / "runs")
    log = lambda rows: runs.log_runs(spark.createDataFrame(rows, runs.RUNS), path)
    log([("a", {"k": "1"}, {"auc": 0.7}), ("b", {"k": "2"}, {"auc": 0.9, "loss": 1.0})])
    log([("b", {"k": "2"}, {"auc": 0.8}), ("c", {}, {"loss": 2.0})])
    log([("b", {"k": "2"}, {"auc": 0.8})])
    got = {r.trial: (r.k, r.auc, r.place, r.is_best) for r in runs.compare_runs(runs.read_runs(spark, path), "auc", ["k"]).collect()}
    assert got == {"b": ("2", 0.8, 1, True), "a": ("1", 0.7, 2, False), "c": (None, None, 3, False)}


def test_progress_is_reported_while_the_stream_runs_and_after_a_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(src)
    during = []

    def scorer(df):
        p = out + ".progress"
        during.append([r.processed for r in stream.read_progress(spark, p).orderBy("batch").collect()] if os.path.isdir(p) else [])
        return df.withColumn("score", F.col("id") * 2)

    _, progress = stream.score_stream(spark, src, "id long", scorer, out, ck, max_files=1, total=60)
    last = progress.orderBy("batch").collect()
    assert [len(x) for x in during] == [0, 1, 2] and last[-1].processed == 60 and last[-1].percent == 100.0
    assert [r.rows for r in last] and sum(r.rows for r in last) == 60 and during[2] == [r.processed for r in last[:2]]
    spark.range(5).coalesce(1).write.mode("append").parquet(src)
    _, progress = stream.score_stream(spark, src, "id long", lambda d: d, out, ck, max_files=1, total=65)
    assert [r.processed for r in progress.orderBy("batch").collect()][-1] == 65


def test_payloads_flatten_with_their_keys(spark):
    df = spark.createDataFrame([(1, [("x", None), (None, "y")]), (2, [])], "u int, hits array<struct<a:string,b:string>>")
    assert sorted(map(tuple, io.flatten_hits(df, "hits", ["a", "b"], keep=["u"]).collect())) == [(1, "", "y"), (1, "x", "")]
    assert io.flatten_hits(df, "hits", ["b"], default="-").columns == ["b"]


def test_binned_mean_uses_the_listed_edges(spark):
    xs = [0.1 * k for k in range(11)]                                # edges and values coincide up to rounding
    df = spark.createDataFrame([(x, float(i)) for i, x in enumerate(xs)], "x double, y double")
    edges = np.linspace(0.0, 1.0, 11)
    got = {r.bin: r.n for r in agg.binned_mean(df, "x", "y", 10).collect()}
    want = {}
    for x in xs[1:]:
        b = int((edges < x).sum()) - 1
        want[b] = want.get(b, 0) + 1
    assert got == want and agg.binned_mean(df.limit(0), "x", "y", 10).count() == 0
