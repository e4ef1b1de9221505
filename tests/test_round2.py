"""Cases that earlier versions got wrong: overflow, NULL and NaN rules, caps, duplicates, shared state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import agg, cluster, encode, impute, joins, model, rank, sample, score, stats, textclf
from quarry.sources import io


def test_counts_of_billions_do_not_overflow(spark, monkeypatch):
    """chi2 and the Rand index on cells of 5e9: the group counts are swapped for large ones."""
    real = F.count
    monkeypatch.setattr(stats.F, "count", lambda c: (real(c) * 5_000_000_000).cast("bigint"))
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "y")], "a string, b string")
    got = stats.chi2(df, "a", "b")
    assert got["n"] == 25_000_000_000 and abs(got["statistic"] / 5e9 - 5 * (1 * 2 - 1 * 1) ** 2 / (2 * 3 * 2 * 3)) < 1e-6
    ari = cluster.adjusted_rand(df, "a", "b").first()["ari"]
    assert -1 <= ari <= 1


def test_percentiles_of_null_and_hot_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 10 else "cold", float(v)) for i, v in enumerate(np.round(rng.normal(size=900), 1))]
    rows += [("cold", float("nan")), ("empty", None), (None, None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    qs = [0.0, 0.3, 0.5, 0.99, 1.0]
    got = {(r.g, r.pos): r.value for r in agg.exact_percentiles(df, "x", qs, "g").collect()}
    for g in (None, "hot", "cold"):
        want = np.quantile([v for k, v in rows if k == g and v is not None and v == v], qs)
        assert np.allclose([got[(g, i)] for i in range(len(qs))], want)
    assert [got[("empty", i)] for i in range(len(qs))] == [None] * len(qs)


def test_no_row_of_a_null_class_is_lost(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(40)], "k int, y int")
    assert sample.stratified_split(df, "y", "k").count() == 40
    assert sample.kfold(df, 5, "k", stratify="y").count() == 40
    und = sample.undersample(df, "y", "k", 1.0)
    assert und.where("y is null").count() == 10 and und.where("y = 1").count() == df.where("y = 1").count()
    ranks = rank.avg_rank(df, "k", by="y").where("y is null").select("k_rank").collect()
    assert sorted(r[0] for r in ranks) == [float(i) for i in range(1, 11)]
    hist = {r.bin: r.n for r in agg.histogram(df, "k", 4, by="y").where("y is null").collect()}
    assert sum(hist.values()) == 10


def test_nan_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0)], "i int, x double")
    path = str(tmp_path / "p")
    df.write.parquet(path)
    assert io.read_parquet(spark, path).where("x is null").count() == 1
    csv = str(tmp_path / "c")
    df.write.option("header", True).csv(csv)
    assert io.read_csv(spark, csv, "i int, x double").agg(F.avg("x")).first()[0] == 2.0
    assert {r.i: r.x_rank for r in rank.avg_rank(df, "x").collect()} == {1: 1.0, 2: None, 3: 2.0}
    assert agg.exact_percentile_values(df, "x", [0.5]) == [2.0]


def test_encoders_take_any_number_of_levels(spark):
    df = spark.range(120_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"), (F.col("id") % 2).cast("double").alias("y"))
    out = encode.apply_codes(df, encode.fit_label_encoder(df, ["c"]))
    assert out.agg(F.count_distinct("c"), F.min("c"), F.max("c")).first()[:] == (120_000, 0, 119_999)
    small = df.limit(100).withColumn("plain", F.substring("c", 2, 6).cast("int"))
    lv = encode.fit_label_encoder(df, ["c"])
    assert encode.apply_codes(small, lv).where("c <> plain").count() == 0
    assert encode.apply_target_encoder(df, encode.fit_target_encoder(df, ["c"], "y")).where("c is null").count() == 0


def test_preprocessor_scales_by_the_population(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "ab"[i % 2], "xyz"[i % 3], float(v)) for i, v in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(rows, "i int, o string, t string, x double")
    out = encode.Preprocessor(["o"], ["t"], ["x"], ["i"]).fit(df, "x").transform(df).collect()
    z = np.array([r.features[2] for r in out])
    assert abs(z.std() - 1) < 1e-9 and abs(z.mean()) < 1e-9
    assert all(r.features[0] == "ab".index(r.o) and r.features[3] == r.i for r in out)
    new = spark.createDataFrame([(1, "q", "q", 0.0)], df.schema)
    f = encode.Preprocessor(["o"], ["t"], ["x"]).fit(df, "x").transform(new).first().features
    assert f[0] == -1.0 and abs(f[1] - np.mean([r[3] for r in rows])) < 1e-9


def test_text_classifier_holds_every_term(spark):
    df = spark.createDataFrame([(f"every{'aa' if i % 2 else 'bb'} common {' '.join(f'w{i}x{k}' for k in range(50))}", "ab"[i % 2]) for i in range(60)],
                               "text string, y string")
    assert textclf.common_terms(df, "text", 0.95) == ["common"]
    m = textclf.text_classifier(df, "text", "y", kind="count", max_iter=5, n_features=1 << 12)
    x = m.transform(df).first()
    assert sum(x["__tf"].values) == 51 and x["__y"] == x["prediction"]


def test_call_model_leaves_the_schema_alone(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    out = textclf.call_model(df, "t", str.upper)
    assert df.columns == ["t"] and out.columns == ["t", "response"]
    assert sorted(r.response for r in out.collect()) == ["", "A"]


def test_projection_keeps_the_session_settings(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "i int, v array<double>")
    out = score.project_vectors(df, "v", np.array([[1.0], [2.0]]), batch_size=3)
    assert {r.i: r.projection[0] for r in out.collect()} == {i: i + 2.0 for i in range(10)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_batches_count_rows_not_ranks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in score.batches(df, "k", 2).orderBy("batch").collect()] == [(0, 2, 2, 200 / 3), (1, 1, 3, 100.0)]
    assert score.batches(df.limit(0), "k", 2).count() == 0


def test_missing_labels_and_scores(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.9), (None, 0.5), (1, None)], "y int, p double")
    assert [r[0] for r in df.select(score.verdict(F.col("y"))).collect()] == ["accepted", "refused", None, "refused"]
    sweep = model.threshold_sweep(df, "y", "p", n=3, lo=0.1, hi=0.9).orderBy("idx").collect()
    for s in sweep:
        c = model.confusion_counts(df, "y", "p", s.threshold).first()
        assert (s.tp, s.fp, s.fn, s.tn) == (c.tp, c.fp, c.fn, c.tn)
    seg = spark.createDataFrame([(None,), (15,)], "s int").select(cluster.segment(F.col("s"))).collect()
    assert seg[0][0] is None and seg[1][0] is not None


def test_feature_tables_must_have_one_row_a_key(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    ok = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, f string")
    assert joins.join_features(base, [ok], "k").count() == 2
    with pytest.raises(Exception, match="repeated k: 1"):
        joins.join_features(base, [spark.createDataFrame([(1, "a"), (1, "b")], "k int, f string")], "k").collect()


def test_all_null_columns_pass_the_outlier_filter(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    assert impute.iqr_filter(df, ["b"]).count() == 2
    assert impute.outlier_counts(df, ["b"]).first()["n_outliers"] == 0
    assert impute.fill_mean(df, ["b"], "median").where("b is null").count() == 2


def test_cascade_fill_follows_the_levels(spark):
    rows = [(1, "a", "x", 1.0), (2, "a", "x", 3.0), (3, "a", "x", None), (4, "b", "x", None), (5, "b", "y", None), (6, None, "x", None), (7, None, None, None)]
    df = spark.createDataFrame(rows, "i int, g string, h string, v double")
    got = {r.i: r.v for r in impute.fill_cascade(df, "v", ["g", "h"]).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 2.0, 4: 2.0, 5: None, 6: 2.0, 7: None}


def test_variance_share_is_of_all_components(spark):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(Vectors.dense(rng.normal(size=6) * [5, 3, 1, 1, 1, 1]),) for _ in range(200)], ["v"])
    k, m = model.pca_for_variance(df, "v", 0.9)
    cum = np.cumsum(m.explainedVariance.toArray())
    assert abs(cum[-1] - 1) < 1e-9 and cum[k - 1] >= 0.9 > (cum[k - 2] if k > 1 else 0)


def test_nan_aware_neighbours_refuse_more_pairs_than_asked(spark):
    df = spark.createDataFrame([(i, [float(i), None]) for i in range(10)], "id int, v array<double>")
    with pytest.raises(ValueError, match="100 pairs"):
        joins.knn_join(df, df, "v", 1, "id", "id", metric="nan_euclidean", max_pairs=99)


def test_lineage_tables_can_be_released(spark):
    from quarry import session
    df = session.cut_lineage(spark.range(3))
    path = session._TABLES[-1][1]
    assert df.count() == 3 and spark.read.parquet(path).count() == 3
    kept = session._TABLES[:]
    session._TABLES[:] = kept[-1:]
    session.release_tables()
    session._TABLES[:] = kept[:-1]
    with pytest.raises(Exception):
        spark.read.parquet(path)
