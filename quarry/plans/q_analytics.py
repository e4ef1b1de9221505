"""Imputation, outliers, encoding, sampling, statistics and metrics on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import agg, encode, impute, model, sample, stats
from quarry.plans.registry import null_when, register, rounded, t

# Fixed linear score standing in for a model probability (documents.n_chars).
PROBA_SQL = "least(d.n_chars / 8000.0, 1.0)"


def proba_col():
    return F.least(F.col("n_chars") / 8000.0, F.lit(1.0))


def scored_labels(spark, d):
    """labels (quality, toxic) joined to a fixed linear probability on documents.n_chars."""
    lab, doc = t(spark, d, "labels"), t(spark, d, "documents")
    return lab.join(doc.select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic",
                                                                      proba_col().alias("p"))


SCORED_SQL = f"SELECT l.doc_id, l.quality, l.toxic, {PROBA_SQL} AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


# ------------------------------------------------------------------ imputation

_CUST_NULLS = """
  SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS seg,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal, c_nationkey FROM customer
"""


def _cust_nulls(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", null_when("c_custkey", 11, "c_mktsegment").alias("seg"),
                    null_when("c_custkey", 7, "c_acctbal").alias("bal"), "c_nationkey")


@register("i01_group_mean_fill", f"""
WITH b AS ({_CUST_NULLS}), m AS (SELECT seg, avg(bal) AS mb FROM b WHERE seg IS NOT NULL GROUP BY seg)
SELECT b.c_custkey, b.seg, ROUND(coalesce(b.bal, m.mb), 6) AS bal, b.c_nationkey FROM b LEFT JOIN m ON b.seg = m.seg
""")
def i01_group_mean_fill(spark, d):
    """Group-mean fill; a NULL group stays NULL."""
    return rounded(impute.fill_group_mean(_cust_nulls(spark, d), "bal", "seg"), 6, ["bal"])


@register("i02_cascade_fill", """
WITH b AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price,
                  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand2 FROM part),
m1 AS (SELECT brand2, avg(price) AS m FROM b WHERE brand2 IS NOT NULL GROUP BY 1),
s1 AS (SELECT b.p_partkey, b.p_type, b.brand2, coalesce(b.price, m1.m) AS price FROM b LEFT JOIN m1 ON b.brand2 = m1.brand2),
m2 AS (SELECT p_type, avg(price) AS m FROM s1 GROUP BY 1)
SELECT s1.p_partkey, s1.p_type, s1.brand2, ROUND(coalesce(s1.price, m2.m), 6) AS price FROM s1 LEFT JOIN m2 ON s1.p_type = m2.p_type
""")
def i02_cascade_fill(spark, d):
    """Cascade of group-mean fills; each level averages the already filled column."""
    p = t(spark, d, "part").select("p_partkey", "p_type", null_when("p_partkey", 4, "p_brand").alias("brand2"),
                                   null_when("p_partkey", 3, "p_retailprice").alias("price"))
    return rounded(impute.fill_cascade(p, "price", ["brand2", "p_type"]), 6, ["price"])


@register("i03_median_fill", f"""
WITH b AS ({_CUST_NULLS})
SELECT c_custkey, ROUND(coalesce(bal, (SELECT median(bal) FROM b)), 6) AS bal FROM b
""")
def i03_median_fill(spark, d):
    """Median fill."""
    b = _cust_nulls(spark, d).select("c_custkey", "bal")
    return rounded(impute.fill_mean(b, ["bal"], strategy="median"))


@register("i04_regression_fill", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity,
                  CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_extendedprice END AS price FROM lineitem),
f AS (SELECT regr_slope(price, l_quantity) AS s, regr_intercept(price, l_quantity) AS i FROM b)
SELECT l_orderkey, l_linenumber, l_quantity, ROUND(coalesce(price, i + s * l_quantity), 4) AS price FROM b, f
""")
def i04_regression_fill(spark, d):
    """Least-squares line fill of y from x (I4)."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                        null_when("l_orderkey", 6, "l_extendedprice").alias("price"))
    return rounded(impute.fill_regression(li, "price", "l_quantity"), 4, ["price"])


_KNN_DIST = """
  sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
       lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))
"""


@register("i05_knn_fill", f"""
WITH b AS (SELECT vec_id, embedding, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(label AS DOUBLE) END AS y FROM embeddings),
pairs AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_KNN_DIST}, b.vec_id) AS rk
          FROM b a JOIN b b ON a.y IS NULL AND b.y IS NOT NULL),
f AS (SELECT vec_id, avg(y) AS fill FROM pairs WHERE rk <= 5 GROUP BY vec_id)
SELECT b.vec_id, ROUND(coalesce(b.y, f.fill), 6) AS y FROM b LEFT JOIN f ON b.vec_id = f.vec_id
""")
def i05_knn_fill(spark, d):
    """k-NN fill with exact neighbours (I5, J8); the oracle brute-forces all pairs."""
    e = t(spark, d, "embeddings").select("vec_id", "embedding",
                                         null_when("vec_id", 5, F.col("label").cast("double")).alias("y"))
    return rounded(impute.fill_knn(e, "y", "embedding", "vec_id", k=5).select("vec_id", "y"))


_NAN_DIST = """
  sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce((z[1] - z[2]) * (z[1] - z[2]), 0.0)))
       * len(a.v) / nullif(list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN z[1] IS NULL OR z[2] IS NULL THEN 0 ELSE 1 END)), 0))
"""


@register("i05_knn_fill_nan_aware", f"""
WITH b AS (SELECT vec_id,
             list_transform(generate_series(1, len(embedding)),
               lambda i: CASE WHEN (vec_id + i) % 9 = 0 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) END) AS v,
             CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(label AS DOUBLE) END AS y FROM embeddings),
pairs AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {{_NAN_DIST}}, b.vec_id) AS rk
          FROM b a JOIN b b ON a.y IS NULL AND b.y IS NOT NULL),
f AS (SELECT vec_id, avg(y) AS fill FROM pairs WHERE rk <= 5 GROUP BY vec_id)
SELECT b.vec_id, ROUND(coalesce(b.y, f.fill), 6) AS y FROM b LEFT JOIN f ON b.vec_id = f.vec_id
""".replace("{_NAN_DIST}", _NAN_DIST))
def i05_knn_fill_nan_aware(spark, d):
    """k-NN fill with partly missing features and the NaN-aware distance."""
    e = t(spark, d, "embeddings")
    v = F.transform(F.col("embedding").cast("array<double>"),
                    lambda x, i: F.when(F.pmod(F.col("vec_id") + i + 1, F.lit(9)) == 0, F.lit(None)).otherwise(x))
    b = e.select("vec_id", v.alias("v"), null_when("vec_id", 5, F.col("label").cast("double")).alias("y"))
    return rounded(impute.fill_knn(b, "y", "v", "vec_id", k=5, nan_aware=True).select("vec_id", "y"))


@register("j08_knn_join", f"""
WITH pairs AS (SELECT a.vec_id, b.vec_id AS nn_key, {_KNN_DIST} AS dist,
                      row_number() OVER (PARTITION BY a.vec_id ORDER BY {_KNN_DIST}, b.vec_id) AS rank
               FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, nn_key, ROUND(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM pairs WHERE rank <= 3
""")
def j08_knn_join(spark, d):
    """Exact 3 nearest neighbours of every vector, self excluded."""
    from quarry.operators.joins import knn_join
    e = t(spark, d, "embeddings")
    return rounded(knn_join(e, e, "embedding", 3, "vec_id", "vec_id", exclude_self=True), 6, ["dist"])


@register("i06_knn_rmse_curve", f"""
WITH tr AS (SELECT * FROM embeddings WHERE vec_id % 4 <> 0), te AS (SELECT * FROM embeddings WHERE vec_id % 4 = 0),
pairs AS (SELECT a.vec_id, a.label AS truth, b.label AS y,
                 row_number() OVER (PARTITION BY a.vec_id ORDER BY {_KNN_DIST}, b.vec_id) AS rk
          FROM te a JOIN tr b ON true),
pred AS (SELECT vec_id, truth, rk, avg(y) OVER (PARTITION BY vec_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
         FROM pairs WHERE rk <= 10)
SELECT CAST(rk AS INTEGER) AS k, ROUND(sqrt(avg((p - truth) * (p - truth))), 6) AS rmse, count(*) AS n FROM pred GROUP BY rk
""")
def i06_knn_rmse_curve(spark, d):
    """Hold-out RMSE for k = 1..10 from one neighbour search."""
    e = t(spark, d, "embeddings").withColumn("label", F.col("label").cast("double"))
    tr = e.filter(F.pmod("vec_id", F.lit(4)) != 0)
    te = e.filter(F.pmod("vec_id", F.lit(4)) == 0)
    return rounded(impute.knn_rmse_curve(tr, te, "label", "embedding", "vec_id", max_k=10))


@register("i07_iterative_fill")
def i07_iterative_fill(spark, d):
    """Round-robin regression fill, at most 10 rounds."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                        null_when("l_orderkey", 5, "l_quantity").alias("q"),
                                        null_when("l_orderkey", 7, "l_extendedprice").alias("price"),
                                        "l_discount")
    return impute.fill_iterative(li, ["q", "price", "l_discount"], rounds=10)


_LI_NULLS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS q,
  l_extendedprice AS price FROM lineitem"""


def _li_nulls(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                          null_when("l_orderkey", 9, "l_quantity").alias("q"),
                                          F.col("l_extendedprice").alias("price"))


@register("o01_iqr_filter", f"""
WITH b AS ({_LI_NULLS}),
s AS (SELECT quantile_cont(q, 0.25) q1, quantile_cont(q, 0.75) q3, quantile_cont(price, 0.25) p1,
             quantile_cont(price, 0.75) p3 FROM b)
SELECT b.* FROM b, s WHERE (q IS NULL OR q BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1))
  AND (price IS NULL OR price BETWEEN p1 - 0.5 * (p3 - p1) AND p3 + 0.5 * (p3 - p1))
""")
def o01_iqr_filter(spark, d):
    """IQR row filter on several columns, bounds from the input, NULLs kept (O1)."""
    return impute.iqr_filter(_li_nulls(spark, d), ["q", "price"], factor=0.5)


@register("o02_iqr_sequential", f"""
WITH b AS ({_LI_NULLS}),
s1 AS (SELECT quantile_cont(q, 0.25) a, quantile_cont(q, 0.75) z FROM b),
f1 AS (SELECT b.* FROM b, s1 WHERE q BETWEEN a - 0.5 * (z - a) AND z + 0.5 * (z - a)),
s2 AS (SELECT quantile_cont(price, 0.25) a, quantile_cont(price, 0.75) z FROM f1)
SELECT f1.* FROM f1, s2 WHERE price BETWEEN a - 0.5 * (z - a) AND z + 0.5 * (z - a)
""")
def o02_iqr_sequential(spark, d):
    """IQR filters applied column after column, NULLs dropped (O2)."""
    return impute.iqr_filter_sequential(_li_nulls(spark, d), ["q", "price"], factor=0.5)


@register("o03_quantile_filter", """
WITH s AS (SELECT quantile_cont(o_totalprice, 0.05) lo, quantile_cont(o_totalprice, 0.95) hi FROM orders)
SELECT o.* FROM orders o, s WHERE o_totalprice BETWEEN lo AND hi
""")
def o03_quantile_filter(spark, d):
    """Keep rows between the 5 % and 95 % quantiles (O3)."""
    return impute.quantile_filter(t(spark, d, "orders"), "o_totalprice", 0.05, 0.95)


@register("o04_outlier_counts", """
WITH s AS (SELECT quantile_cont(l_quantity, 0.25) a1, quantile_cont(l_quantity, 0.75) z1,
                  quantile_cont(l_extendedprice, 0.25) a2, quantile_cont(l_extendedprice, 0.75) z2 FROM lineitem)
SELECT 'l_quantity' AS column_name, count(CASE WHEN NOT (l_quantity BETWEEN a1 - 0.5 * (z1 - a1) AND z1 + 0.5 * (z1 - a1)) THEN 1 END) AS n_outliers FROM lineitem, s
UNION ALL SELECT 'l_extendedprice', count(CASE WHEN NOT (l_extendedprice BETWEEN a2 - 0.5 * (z2 - a2) AND z2 + 0.5 * (z2 - a2)) THEN 1 END) FROM lineitem, s
""")
def o04_outlier_counts(spark, d):
    """Outliers per column under the IQR rule."""
    return impute.outlier_counts(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], factor=0.5)


# ------------------------------------------------------------------ encoding

@register("e01_label_encode", f"""
WITH b AS ({_CUST_NULLS}), lv AS (SELECT DISTINCT coalesce(seg, 'NaN') AS level FROM b),
c AS (SELECT level, CAST(dense_rank() OVER (ORDER BY level) - 1 AS INTEGER) AS code FROM lv)
SELECT b.c_custkey, c.code AS seg FROM b JOIN c ON coalesce(b.seg, 'NaN') = c.level
""")
def e01_label_encode(spark, d):
    """Label codes over sorted levels, missing as the level 'NaN' (E1, D11)."""
    b = _cust_nulls(spark, d).select("c_custkey", "seg")
    lv = encode.fit_label_encoder(b, ["seg"])
    return encode.apply_codes(b, lv)


@register("e02_one_hot", """
WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS p_type FROM part)
SELECT p_partkey, coalesce((p_type = 'ECONOMY')::INT, 0) AS p_type_ECONOMY, coalesce((p_type = 'LARGE')::INT, 0) AS p_type_LARGE,
  coalesce((p_type = 'MEDIUM')::INT, 0) AS p_type_MEDIUM, coalesce((p_type = 'PROMO')::INT, 0) AS p_type_PROMO,
  coalesce((p_type = 'SMALL')::INT, 0) AS p_type_SMALL, coalesce((p_type = 'STANDARD')::INT, 0) AS p_type_STANDARD,
  (p_type IS NULL)::INT AS p_type_nan FROM b
""")
def e02_one_hot(spark, d):
    """One-hot columns COL_level plus a missing indicator."""
    p = t(spark, d, "part").select("p_partkey", null_when("p_partkey", 13, "p_type").alias("p_type"))
    return encode.apply_one_hot(p, encode.fit_one_hot(p, ["p_type"]))


@register("e03_ordinal", f"""
WITH b AS ({_CUST_NULLS}), lv AS (SELECT DISTINCT seg AS level FROM b WHERE seg IS NOT NULL),
c AS (SELECT level, CAST(dense_rank() OVER (ORDER BY level) - 1 AS INTEGER) AS code FROM lv)
SELECT b.c_custkey, c.code AS seg FROM b LEFT JOIN c ON b.seg = c.level
""")
def e03_ordinal(spark, d):
    """Ordinal codes; NULL stays NULL."""
    b = _cust_nulls(spark, d).select("c_custkey", "seg")
    return encode.apply_codes(b, encode.fit_ordinal_encoder(b, ["seg"]), missing_as=None)


@register("e04_target_encode", """
WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nat,
                  CAST(c_acctbal > 5000 AS INTEGER) AS y FROM customer),
pr AS (SELECT avg(y) AS prior FROM b),
s AS (SELECT nat, count(*) AS n, avg(y) AS m FROM b WHERE nat IS NOT NULL GROUP BY nat),
e AS (SELECT nat, CASE WHEN n = 1 THEN prior ELSE prior * (1 - 1 / (1 + exp(-(n - 20) / 10.0)))
                       + m * (1 / (1 + exp(-(n - 20) / 10.0))) END AS enc FROM s, pr)
SELECT b.c_custkey, ROUND(coalesce(e.enc, pr.prior), 6) AS nat FROM b LEFT JOIN e ON b.nat = e.nat, pr
""")
def e04_target_encode(spark, d):
    """Smoothed target encoding, min_samples_leaf 20, smoothing 10."""
    c = t(spark, d, "customer").select("c_custkey", null_when("c_custkey", 11, "c_nationkey").alias("nat"),
                                       (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    st = encode.fit_target_encoder(c, ["nat"], "y")
    return rounded(encode.apply_target_encoder(c, st).select("c_custkey", F.col("nat").cast("double")))


@register("e05_standardize", """
WITH s AS (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) sd, avg(c_nationkey) m2, stddev_pop(c_nationkey) sd2 FROM customer)
SELECT c_custkey, ROUND((c_acctbal - m) / sd, 6) AS c_acctbal, ROUND((c_nationkey - m2) / sd2, 6) AS c_nationkey FROM customer, s
""")
def e05_standardize(spark, d):
    """Standardise with the population std, fit then apply."""
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    st = encode.fit_standard(c, ["c_acctbal", "c_nationkey"])
    return rounded(encode.apply_standard(c, st, ["c_acctbal", "c_nationkey"]))


@register("e06_minmax", """
WITH s AS (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part)
SELECT p_partkey, ROUND((p_retailprice - lo) / (hi - lo), 6) AS p_retailprice FROM part, s
""")
def e06_minmax(spark, d):
    """Min-max scaling."""
    p = t(spark, d, "part").select("p_partkey", "p_retailprice")
    return rounded(encode.apply_minmax(p, encode.fit_minmax(p, ["p_retailprice"]), ["p_retailprice"]))


@register("e08_preprocessing_pipeline")
def e08_preprocessing_pipeline(spark, d):
    """Ordinal, target-encoded, standardised and pass-through columns fitted on one split, applied to the other."""
    p = t(spark, d, "part")
    split = sample.random_split(p, "p_partkey", [0.8, 0.2])  # seeded hash split
    train, test = split.filter("split = 0").drop("split"), split.filter("split = 1").drop("split")
    pipe = encode.Preprocessor(ordinal=["p_type"], target_encoded=["p_brand"], scaled=["p_retailprice"], passthrough=["p_size"])
    return pipe.fit(train, "p_retailprice").transform(test).select("p_partkey", "features")


# ------------------------------------------------------------------ sampling

@register("p01_fraction_sample")
def p01_fraction_sample(spark, d):
    """10 % hash sample with a row cap."""
    return sample.sample_fraction(t(spark, d, "lineitem"), 0.1, ["l_orderkey", "l_linenumber"], cap=1000)


@register("p02_sample_n")
def p02_sample_n(spark, d):
    """Exactly 200 rows by seeded hash order."""
    return sample.sample_n(t(spark, d, "orders"), 200, "o_orderkey")


@register("p03_per_class_counts", """
SELECT o_orderstatus, least(count(*), 300) AS n FROM orders GROUP BY 1
""")
def p03_per_class_counts(spark, d):
    """Equal-n sample per class; class counts of the sample."""
    s = sample.sample_per_class(t(spark, d, "orders"), "o_orderstatus", 300, "o_orderkey")
    return s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("p03_per_class_sample")
def p03_per_class_sample(spark, d):
    """The per-class sample rows themselves."""
    return sample.sample_per_class(t(spark, d, "orders"), "o_orderstatus", 300, "o_orderkey")


@register("p04_undersample_counts", """
WITH b AS (SELECT CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y FROM orders),
m AS (SELECT count(*) AS n1 FROM b WHERE y = 1)
SELECT 1 AS y, n1 AS n FROM m UNION ALL SELECT 0, least(CAST(round(n1 * 2.0) AS BIGINT), (SELECT count(*) FROM b WHERE y = 0)) FROM m
""")
def p04_undersample_counts(spark, d):
    """Majority undersampled to 2:1 (P4): class counts."""
    o = t(spark, d, "orders").withColumn("y", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    u = sample.undersample(o, "y", "o_orderkey", ratio=2.0, minority=1)
    return u.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register("p05_p08_random_split")
def p05_p08_random_split(spark, d):
    """Train/val/test 70/15/15 by hash threshold (P5, P8); rows-only check."""
    return sample.random_split(t(spark, d, "orders"), "o_orderkey", [0.7, 0.15, 0.15])


@register("p06_stratified_split_counts", """
SELECT o_orderstatus, is_train, n FROM (
  SELECT o_orderstatus, true AS is_train, CAST(round(count(*) * 0.8) AS BIGINT) AS n FROM orders GROUP BY 1
  UNION ALL SELECT o_orderstatus, false, count(*) - CAST(round(count(*) * 0.8) AS BIGINT) FROM orders GROUP BY 1)
""")
def p06_stratified_split_counts(spark, d):
    """Stratified 80/20 split: per class train/test counts."""
    s = sample.stratified_split(t(spark, d, "orders"), "o_orderstatus", "o_orderkey", 0.8)
    return s.groupBy("o_orderstatus", "is_train").agg(F.count(F.lit(1)).alias("n"))


@register("p07_stratified_kfold_counts", """
WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT range AS fold FROM range(5))
SELECT o_orderstatus, CAST(fold AS INTEGER) AS fold, CAST((n - fold + 4) // 5 AS BIGINT) AS n FROM c, f
""")
def p07_stratified_kfold_counts(spark, d):
    """Stratified 5-fold assignment: per class and fold counts."""
    k = sample.kfold(t(spark, d, "orders"), 5, "o_orderkey", stratify="o_orderstatus")
    return k.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("p07_kfold")
def p07_kfold(spark, d):
    """Plain 5-fold ids by hash."""
    return sample.kfold(t(spark, d, "orders"), 5, "o_orderkey")


@register("p09_smote_counts", """
WITH b AS (SELECT CAST(label = 0 AS INTEGER) AS y FROM embeddings),
c AS (SELECT sum(y) AS n1, count(*) - sum(y) AS n0 FROM b)
SELECT 1 AS y, CAST(greatest(round(0.5 * n0), n1) AS BIGINT) AS n FROM c UNION ALL SELECT 0, CAST(n0 AS BIGINT) FROM c
""")
def p09_smote_counts(spark, d):
    """Synthetic minority oversampling to 0.5 of the majority: class counts."""
    e = t(spark, d, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    out = sample.smote(e, "embedding", "y", "vec_id", minority=1, ratio=0.5, k=5)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register("p09_smote_rows")
def p09_smote_rows(spark, d):
    """The synthetic rows."""
    e = t(spark, d, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    return sample.smote(e, "embedding", "y", "vec_id", minority=1, ratio=0.5, k=5).filter("synthetic")


# ------------------------------------------------------------------ statistics

@register("h01_chi2_statistic", """
WITH c AS (SELECT l_returnflag a, l_linestatus b, count(*) o FROM lineitem GROUP BY 1, 2),
r AS (SELECT a, sum(o) ra FROM c GROUP BY a), k AS (SELECT b, sum(o) cb FROM c GROUP BY b), n AS (SELECT sum(o) n FROM c)
SELECT ROUND(sum(o * o / (ra * cb / n)) - n, 6) AS statistic,
       CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n
FROM c JOIN r USING (a) JOIN k USING (b), n GROUP BY n
""")
def h01_chi2_statistic(spark, d):
    """Chi-square independence statistic, dof and n (H1)."""
    return rounded(stats.chi2_frame(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus").drop("p_value"))


@register("h01_chi2_test")
def h01_chi2_test(spark, d):
    """Chi-square test with p-value (H1)."""
    return stats.chi2_frame(t(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@register("h02_kruskal_h", """
WITH r AS (SELECT c_mktsegment g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rk,
                  c_acctbal FROM customer),
t AS (SELECT sum(cnt * cnt * cnt - cnt) AS ties FROM (SELECT count(*) AS cnt FROM customer GROUP BY c_acctbal)),
n AS (SELECT count(*) AS n FROM customer),
s AS (SELECT g, sum(rk) AS R, count(*) AS ng FROM r GROUP BY g)
SELECT ROUND((12.0 / (n * (n + 1)) * sum(R * R / ng) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS H,
       count(*) AS k, n FROM s, n, t GROUP BY n, ties
""")
def h02_kruskal_h(spark, d):
    """Kruskal-Wallis H with tie correction (H2)."""
    return rounded(stats.kruskal_stats(t(spark, d, "customer"), "c_acctbal", "c_mktsegment"))


@register("h02_kruskal_tests")
def h02_kruskal_tests(spark, d):
    """H, dof and p for several variables, sorted by p (H2)."""
    return stats.kruskal(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")


@register("h03_pearson_r_n", """
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, ROUND(corr(l_quantity, l_extendedprice), 6) AS r,
       count(*) AS n FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', ROUND(corr(l_quantity, l_discount), 6), count(*) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', ROUND(corr(l_extendedprice, l_discount), 6), count(*) FROM lineitem
""")
def h03_pearson_r_n(spark, d):
    """Pairwise Pearson r and n (H3)."""
    return rounded(stats.pairwise_pearson(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
                   .drop("p"))


@register("h03_pearson_tests")
def h03_pearson_tests(spark, d):
    """Pairwise Pearson with two-sided p-values (H3)."""
    return stats.pairwise_pearson(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@register("h04_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
                  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb
           FROM lineitem)
SELECT ROUND(corr(ra, rb), 6) AS rho, count(*) AS n FROM r
""")
def h04_spearman(spark, d):
    """Spearman correlation from average-tie ranks (H4)."""
    return rounded(stats.spearman(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@register("h05_jarque_bera", """
WITH m AS (SELECT avg(o_totalprice) mu, count(*) n FROM orders),
c AS (SELECT n, avg(power(o_totalprice - mu, 2)) m2, avg(power(o_totalprice - mu, 3)) m3, avg(power(o_totalprice - mu, 4)) m4
      FROM orders, m GROUP BY n)
SELECT 'o_totalprice' AS variable, n, ROUND(m3 / power(m2, 1.5), 6) AS skewness, ROUND(m4 / (m2 * m2) - 3, 6) AS excess_kurtosis,
       ROUND(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 6) AS jb FROM c
""")
def h05_jarque_bera(spark, d):
    """Jarque-Bera normality statistic (H5)."""
    return rounded(stats.jarque_bera(t(spark, d, "orders"), ["o_totalprice"]).drop("p_value"))


@register("h05_normality_tests")
def h05_normality_tests(spark, d):
    """Jarque-Bera p-values and a Kolmogorov-Smirnov test (H5)."""
    o = t(spark, d, "orders")
    jb = stats.jarque_bera(o, ["o_totalprice"]).select("variable", F.lit("jarque_bera").alias("test"),
                                                       F.col("jb").alias("statistic"), "p_value")
    ks = stats.ks_normal(o, "o_totalprice").select("variable", F.lit("ks").alias("test"), "statistic", "p_value")
    return jb.unionByName(ks)


@register("h06_ols_simple", """
SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 6) AS slope, ROUND(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       ROUND(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem
""")
def h06_ols_simple(spark, d):
    """One-variable OLS slope, intercept and R^2 (H6)."""
    return rounded(stats.simple_ols(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
                   .withColumn("n", F.col("n").cast("bigint")))


@register("h06_ols_multi")
def h06_ols_multi(spark, d):
    """Multiple OLS with standard errors and p-values (H6)."""
    return stats.ols(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@register("h07_drift", """
WITH ref AS (SELECT * FROM orders WHERE year(o_orderdate) <= 1997), cur AS (SELECT * FROM orders WHERE year(o_orderdate) > 1997),
e AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS q FROM ref),
br AS (SELECT len(list_filter(q, lambda x: x < o_totalprice)) AS bin, count(*) AS nr FROM ref, e GROUP BY 1),
bc AS (SELECT len(list_filter(q, lambda x: x < o_totalprice)) AS bin, count(*) AS nc FROM cur, e GROUP BY 1),
p AS (SELECT greatest(coalesce(nr, 0) / (SELECT count(*) FROM ref), 1e-4) AS pr,
             greatest(coalesce(nc, 0) / (SELECT count(*) FROM cur), 1e-4) AS pc FROM br FULL JOIN bc USING (bin)),
cr AS (SELECT o_orderpriority v, count(*) / (SELECT count(*) FROM ref) pr FROM ref GROUP BY 1),
cc AS (SELECT o_orderpriority v, count(*) / (SELECT count(*) FROM cur) pc FROM cur GROUP BY 1)
SELECT 'o_totalprice' AS column_name, ROUND(sum((pc - pr) * ln(pc / pr)), 6) AS score, 'psi' AS method,
       sum((pc - pr) * ln(pc / pr)) > 0.2 AS drifted FROM p
UNION ALL
SELECT 'o_orderpriority', ROUND(0.5 * sum(abs(coalesce(pr, 0) - coalesce(pc, 0))), 6), 'tvd',
       0.5 * sum(abs(coalesce(pr, 0) - coalesce(pc, 0))) > 0.1 FROM cr FULL JOIN cc USING (v)
""")
def h07_drift(spark, d):
    """Drift report: PSI on reference-quantile bins and TVD on categories (H7)."""
    o = t(spark, d, "orders")
    ref = o.filter(F.year("o_orderdate") <= 1997)
    cur = o.filter(F.year("o_orderdate") > 1997)
    return rounded(stats.drift(ref, cur, ["o_totalprice"], ["o_orderpriority"]), 6, ["score"])


@register("h07_ks_two_sample", """
WITH ref AS (SELECT o_totalprice AS x FROM orders WHERE year(o_orderdate) <= 1997),
cur AS (SELECT o_totalprice AS x FROM orders WHERE year(o_orderdate) > 1997),
v AS (SELECT x, count(*) FILTER (WHERE s = 1) AS r, count(*) FILTER (WHERE s = 2) AS c
      FROM (SELECT x, 1 AS s FROM ref UNION ALL SELECT x, 2 FROM cur) GROUP BY x),
cum AS (SELECT sum(r) OVER (ORDER BY x) AS cr, sum(c) OVER (ORDER BY x) AS cc FROM v)
SELECT 'o_totalprice' AS column_name,
       ROUND(max(abs(cr / (SELECT count(*) FROM ref) - cc / (SELECT count(*) FROM cur))), 9) AS score FROM cum
""")
def h07_ks_two_sample(spark, d):
    """Two-sample KS statistic between an early and a late period (H7)."""
    o = t(spark, d, "orders")
    ref = o.filter(F.year("o_orderdate") <= 1997)
    cur = o.filter(F.year("o_orderdate") > 1997)
    return rounded(stats.ks_two_sample(ref, cur, "o_totalprice"), 9)


# ------------------------------------------------------------------ metrics

@register("m09_regression_metrics", """
SELECT ROUND(1 - sum(power(l_extendedprice - l_quantity * 1500, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
       ROUND(sqrt(avg(power(l_extendedprice - l_quantity * 1500, 2))), 6) AS rmse,
       ROUND(avg(abs(l_extendedprice - l_quantity * 1500)), 6) AS mae, count(*) AS n FROM lineitem
""")
def m09_regression_metrics(spark, d):
    """R^2, RMSE, MAE of a fixed predictor (M9, B7: plain RMSE)."""
    li = t(spark, d, "lineitem").withColumn("yhat", F.col("l_quantity") * 1500)
    return rounded(model.regression_metrics(li, "l_extendedprice", "yhat"))


@register("m10_binary_metrics", f"""
WITH s AS ({SCORED_SQL}),
c AS (SELECT count(CASE WHEN quality = 1 AND p >= 0.3 THEN 1 END) tp, count(CASE WHEN quality <> 1 AND p >= 0.3 THEN 1 END) fp,
             count(CASE WHEN quality = 1 AND p < 0.3 THEN 1 END) fn, count(CASE WHEN quality <> 1 AND p < 0.3 THEN 1 END) tn FROM s),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT tp, fp, fn, tn, ROUND(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy,
       ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1,
       ROUND(coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0), 6) AS fbeta FROM m
""")
def m10_binary_metrics(spark, d):
    """Confusion counts, precision, recall, F1, F2 at a threshold."""
    return rounded(model.binary_metrics(scored_labels(spark, d), "quality", "p", 0.3, beta=2.0))


@register("m11_auc", f"""
WITH s AS ({SCORED_SQL}),
r AS (SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s),
a AS (SELECT sum(CASE WHEN quality = 1 THEN rk END) rs, count(CASE WHEN quality = 1 THEN 1 END) P,
             count(CASE WHEN quality <> 1 THEN 1 END) N FROM r)
SELECT ROUND((rs - P * (P + 1) / 2.0) / (P * N), 6) AS auc, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg FROM a
""")
def m11_auc(spark, d):
    """Exact ROC AUC with ties averaged."""
    return rounded(model.auc(scored_labels(spark, d), "quality", "p"))


@register("m12_log_loss", f"""
WITH s AS ({SCORED_SQL})
SELECT ROUND(avg(-(quality * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - quality) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 6)
  AS log_loss FROM s
""")
def m12_log_loss(spark, d):
    """Log loss with clipping."""
    return rounded(model.log_loss(scored_labels(spark, d), "quality", "p"))


@register("m13_business_cost", f"""
WITH s AS ({SCORED_SQL}),
c AS (SELECT count(CASE WHEN quality = 1 AND p >= 0.434 THEN 1 END) tp, count(CASE WHEN quality <> 1 AND p >= 0.434 THEN 1 END) fp,
             count(CASE WHEN quality = 1 AND p < 0.434 THEN 1 END) fn, count(CASE WHEN quality <> 1 AND p < 0.434 THEN 1 END) tn FROM s)
SELECT tp, fp, fn, tn, CAST(fn * 6 + fp * 2 - (tp * 5 + tn * 2) AS DOUBLE) AS cost FROM c
""")
def m13_business_cost(spark, d):
    """Net business cost at the deployed threshold 0.434."""
    return model.business_cost(scored_labels(spark, d), "quality", "p", 0.434)


_SWEEP_SQL = f"""
WITH s AS ({SCORED_SQL}),
th AS (SELECT CAST(range AS INTEGER) AS idx, CASE WHEN range = 199 THEN 0.99::DOUBLE
              ELSE range * ((0.99::DOUBLE - 0.01::DOUBLE) / 199) + 0.01::DOUBLE END AS threshold FROM range(200)),
c AS (SELECT idx, threshold, count(CASE WHEN quality = 1 AND p >= threshold THEN 1 END) tp,
             count(CASE WHEN quality <> 1 AND p >= threshold THEN 1 END) fp,
             count(CASE WHEN quality = 1 AND p < threshold THEN 1 END) fn,
             count(CASE WHEN quality <> 1 AND p < threshold THEN 1 END) tn FROM th, s GROUP BY idx, threshold)
SELECT idx, threshold, tp, fp, fn, tn, CAST(fn * 6 + fp * 2 - (tp * 5 + tn * 2) AS DOUBLE) AS cost FROM c
"""


@register("m14_threshold_sweep", _SWEEP_SQL)
def m14_threshold_sweep(spark, d):
    """Confusion counts and cost at 200 thresholds in one pass."""
    return model.threshold_sweep(scored_labels(spark, d), "quality", "p")


@register("m14_best_threshold", f"""
WITH sw AS ({_SWEEP_SQL}) SELECT idx, threshold, cost FROM sw ORDER BY cost, idx LIMIT 1
""")
def m14_best_threshold(spark, d):
    """Threshold with the lowest cost, lowest index on ties."""
    return model.best_threshold(model.threshold_sweep(scored_labels(spark, d), "quality", "p"))


@register("m15_class_report", f"""
WITH s AS (SELECT quality AS y, CAST(p >= 0.3 AS INTEGER) AS yhat FROM ({SCORED_SQL})),
k AS (SELECT y AS cls FROM s UNION SELECT yhat FROM s)
SELECT cls, ROUND(coalesce(count(CASE WHEN y = cls AND yhat = cls THEN 1 END) / nullif(count(CASE WHEN yhat = cls THEN 1 END), 0), 0), 6) AS precision,
  ROUND(coalesce(count(CASE WHEN y = cls AND yhat = cls THEN 1 END) / nullif(count(CASE WHEN y = cls THEN 1 END), 0), 0), 6) AS recall,
  ROUND(coalesce(2 * (count(CASE WHEN y = cls AND yhat = cls THEN 1 END) / nullif(count(CASE WHEN yhat = cls THEN 1 END), 0))
     * (count(CASE WHEN y = cls AND yhat = cls THEN 1 END) / nullif(count(CASE WHEN y = cls THEN 1 END), 0))
     / nullif(count(CASE WHEN y = cls AND yhat = cls THEN 1 END) / nullif(count(CASE WHEN yhat = cls THEN 1 END), 0)
            + count(CASE WHEN y = cls AND yhat = cls THEN 1 END) / nullif(count(CASE WHEN y = cls THEN 1 END), 0), 0), 0), 6) AS f1,
  count(CASE WHEN y = cls THEN 1 END) AS support
FROM k, s GROUP BY cls
""")
def m15_class_report(spark, d):
    """Per-class precision, recall, F1, support."""
    s = scored_labels(spark, d).withColumn("yhat", (F.col("p") >= 0.3).cast("int"))
    return rounded(model.class_report(s, "quality", "yhat"))


@register("m15_confusion_matrix", f"""
SELECT quality AS "true", CAST(p >= 0.3 AS INTEGER) AS pred, count(*) AS n FROM ({SCORED_SQL}) GROUP BY 1, 2
""")
def m15_confusion_matrix(spark, d):
    """Confusion matrix in long form."""
    s = scored_labels(spark, d).withColumn("yhat", (F.col("p") >= 0.3).cast("int"))
    return model.confusion_matrix(s, "quality", "yhat")


@register("m07_class_weights", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT l.doc_id, l.quality, ROUND((SELECT count(*) FROM labels) / ((SELECT count(*) FROM c) * c.n), 6) AS weight
FROM labels l JOIN c ON l.quality = c.quality
""")
def m07_class_weights(spark, d):
    """Balanced class weights as a column (M7)."""
    lab = t(spark, d, "labels").select("doc_id", "quality")
    return rounded(model.class_weights(lab, "quality"))


@register("m18_class_distribution", """
SELECT quality, count(*) AS n, ROUND(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1
""")
def m18_class_distribution(spark, d):
    """Class distribution with shares."""
    return rounded(agg.value_counts(t(spark, d, "labels"), "quality", normalize=True))


@register("m16_runs_best", f"""
WITH sw AS ({_SWEEP_SQL}),
r AS (SELECT idx AS trial, threshold, cost, min(cost) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM sw)
SELECT trial, threshold, cost, prev_best, prev_best IS NULL OR cost < prev_best AS is_new_best FROM r
""")
def m16_runs_best(spark, d):
    """Runs table (one trial per threshold) with the running best marker."""
    from quarry.operators.rank import running_best
    sw = model.threshold_sweep(scored_labels(spark, d), "quality", "p")
    runs = sw.select(F.col("idx").alias("trial"), "threshold", "cost")
    return running_best(runs, "trial", "cost", higher_is_better=False)


@register("m16_runs_store", f"""
WITH sw AS ({_SWEEP_SQL})
SELECT CAST(idx AS VARCHAR) AS trial, CAST(threshold AS DOUBLE) AS threshold, CAST(cost AS DOUBLE) AS cost,
       rank() OVER (ORDER BY cost) AS place, cost = min(cost) OVER () AS is_best FROM sw
""")
def m16_runs_store(spark, d):
    """Each threshold of a sweep logged as a run (parameters and metrics), some of them twice; the runs compared by cost."""
    from quarry.operators import runs
    from quarry.streaming.stream import scratch
    sw = model.threshold_sweep(scored_labels(spark, d), "quality", "p")
    logged = sw.select(F.col("idx").cast("string").alias("trial"), F.create_map(F.lit("threshold"), F.col("threshold").cast("string")).alias("params"),
                       F.create_map(F.lit("cost"), F.col("cost").cast("double")).alias("metrics"))
    path = scratch(spark, "m16")
    runs.log_runs(logged, path)
    runs.log_runs(logged.filter(F.col("trial").cast("int") < 20), path)         # a job that runs again
    out = runs.compare_runs(runs.read_runs(spark, path), "cost", ["threshold"], higher_is_better=False)
    return out.withColumn("threshold", F.col("threshold").cast("double"))


@register("j08_lsh")
def j08_lsh(spark, d):
    """Approximate 3 nearest neighbours of every vector by bucketed random projections."""
    from quarry.operators.joins import knn_lsh
    e = t(spark, d, "embeddings")
    return knn_lsh(e, e, "embedding", 3, "vec_id", "vec_id", exclude_self=True)


@register("j08_lsh_recall")
def j08_lsh_recall(spark, d):
    """Share of the exact 3 nearest neighbours that the approximate search finds, over all vectors."""
    from quarry.operators.joins import knn_join, knn_lsh, knn_recall
    e = t(spark, d, "embeddings")
    same = dict(vec="embedding", k=3, left_key="vec_id", right_key="vec_id", exclude_self=True)
    return knn_recall(knn_join(e, e, **same), knn_lsh(e, e, **same), "vec_id")
