"""Hard cases bound to the test tables: NULL classes, one group holding most rows, whole-table checks of seeded operators.

Seeded choices cannot be repeated in SQL, so their twins check what does not
depend on the hash: row counts, disjointness and content.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import agg, encode, rank, sample
from quarry.plans.registry import register, rounded, t

# Nine orders in ten are in one group, every twentieth has none.
GROUP_SQL = "CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN o_orderpriority ELSE 'hot' END"


def grouped_orders(spark, d):
    o = t(spark, d, "orders")
    g = F.when(F.pmod("o_orderkey", F.lit(20)) == 0, F.lit(None)).when(F.pmod("o_orderkey", F.lit(10)) == 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", "o_totalprice", g.otherwise(F.lit("hot")).alias("g"))


QS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@register("a14_quantiles_by_group", " UNION ALL ".join(
    f"SELECT {GROUP_SQL} AS g, {x}::DOUBLE AS quantile, ROUND(quantile_cont(o_totalprice, {x}), 6) AS value FROM orders GROUP BY 1" for x in QS))
def a14_quantiles_by_group(spark, d):
    """Exact quantiles per group with a NULL group and one group of nine tenths of the rows."""
    out = agg.quantiles(grouped_orders(spark, d), ["o_totalprice"], QS, by="g")
    return rounded(out.select("g", "quantile", "value"), 6, ["value"])


@register("a15_box_stats_null_group", f"""
WITH o AS (SELECT {GROUP_SQL} AS g, o_totalprice AS x FROM orders),
s AS (SELECT g, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM o GROUP BY g)
SELECT s.g, n, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
       min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
       max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (WHERE x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM o JOIN s ON o.g IS NOT DISTINCT FROM s.g GROUP BY ALL
""")
def a15_box_stats_null_group(spark, d):
    """Box-plot summary with a NULL group."""
    return rounded(agg.box_stats(grouped_orders(spark, d), "g", "o_totalprice"), 6, ["q1", "median", "q3"])


@register("a16_histogram_null_label", f"""
WITH o AS (SELECT {GROUP_SQL} AS g, o_totalprice AS x FROM orders),
m AS (SELECT min(x) AS lo, max(x) AS hi FROM o),
b AS (SELECT g, CAST(least(floor((x - lo) / ((hi - lo) / 5)), 4) AS INTEGER) AS bin FROM o, m),
grid AS (SELECT g, CAST(r.range AS INTEGER) AS bin FROM (SELECT DISTINCT g FROM o), range(5) r)
SELECT grid.g, grid.bin, count(b.bin) AS n FROM grid LEFT JOIN b ON grid.g IS NOT DISTINCT FROM b.g AND grid.bin = b.bin GROUP BY ALL
""")
def a16_histogram_null_label(spark, d):
    """Histogram per label, the NULL label included."""
    return agg.histogram(grouped_orders(spark, d), "o_totalprice", 5, by="g").select("g", "bin", "n")


@register("w03_avg_rank_null_group", f"""
WITH o AS (SELECT o_orderkey, {GROUP_SQL} AS g, round(o_totalprice / 1000) AS x FROM orders)
SELECT o_orderkey, g, x, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS x_rank FROM o
""")
def w03_avg_rank_null_group(spark, d):
    """Average-tie ranks within groups, the NULL group and a group of nine tenths of the rows included."""
    o = grouped_orders(spark, d).select("o_orderkey", "g", F.round(F.col("o_totalprice") / 1000).alias("x"))
    return rank.avg_rank(o, "x", by="g")


TARGET_SQL = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 9 = 0 AS INTEGER) END"


def targets(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    y = F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.lit(None)).otherwise((F.pmod("o_orderkey", F.lit(9)) == 0).cast("int"))
    return o.withColumn("y", y)


@register("p04_undersample_null_target", f"""
WITH o AS (SELECT {TARGET_SQL} AS y FROM orders), m AS (SELECT count(*) FILTER (WHERE y = 1) AS k FROM o)
SELECT y, CAST(CASE WHEN y = 0 THEN least(count(*), round(2.0 * any_value(k))) ELSE count(*) END AS BIGINT) AS n FROM o, m GROUP BY y
""")
def p04_undersample_null_target(spark, d):
    """Rows per class after undersampling 2:1; rows without a target stay."""
    return sample.undersample(targets(spark, d), "y", "o_orderkey", 2.0).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register("p06_stratified_null_class", f"""
WITH c AS (SELECT {TARGET_SQL} AS y, count(*) AS n FROM orders GROUP BY 1)
SELECT y, n, CAST(round(0.8 * n) AS BIGINT) AS n_train FROM c
""")
def p06_stratified_null_class(spark, d):
    """Stratified split per class, NULL class included, nothing lost."""
    s = sample.stratified_split(targets(spark, d), "y", "o_orderkey", 0.8)
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_train"), 1)).alias("n_train"))


@register("p07_kfold_null_class", f"""
WITH c AS (SELECT {TARGET_SQL} AS y, count(*) AS n FROM orders GROUP BY 1)
SELECT y, CAST(f.range AS INTEGER) AS fold, CAST((n + 4 - f.range) // 5 AS BIGINT) AS n FROM c, range(5) f
""")
def p07_kfold_null_class(spark, d):
    """Stratified folds, NULL class included, sizes within one row."""
    return sample.kfold(targets(spark, d), 5, "o_orderkey", stratify="y").groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("p03_per_class_null", f"""
SELECT {TARGET_SQL} AS y, least(count(*), 50) AS n FROM orders GROUP BY 1
""")
def p03_per_class_null(spark, d):
    """Fifty rows per class, NULL class included."""
    return sample.sample_per_class(targets(spark, d), "y", 50, "o_orderkey").groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register("p02_sample_n_check", "SELECT CAST(least(200, count(*)) AS BIGINT) AS n, CAST(least(200, count(*)) AS BIGINT) AS n_keys FROM orders")
def p02_sample_n_check(spark, d):
    """An exact-n sample has n rows with different keys of the table."""
    o = t(spark, d, "orders")
    s = sample.sample_n(o, 200, "o_orderkey").select("o_orderkey").join(o.select("o_orderkey"), "o_orderkey", "left_semi")
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@register("p05_p08_split_check", """
SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, TRUE AS near_shares FROM orders
""")
def p05_p08_split_check(spark, d):
    """The parts of a 70/15/15 split are disjoint, cover the table and are near their shares."""
    s = sample.random_split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", [0.7, 0.15, 0.15])
    share = [F.avg((F.col("split") == i).cast("double")) for i in range(3)]
    near = (F.abs(share[0] - 0.7) < 0.05) & (F.abs(share[1] - 0.15) < 0.05) & (F.abs(share[2] - 0.15) < 0.05)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"),
                 F.sum("o_orderkey").alias("key_sum"), near.alias("near_shares"))


@register("t04_shuffle_content", "SELECT o_orderkey, o_totalprice FROM orders")
def t04_shuffle_content(spark, d):
    """A seeded shuffle holds the same rows (T4)."""
    return rank.seeded_shuffle(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7)


@register("w04_one_per_category_check", "SELECT lang, CAST(1 AS BIGINT) AS n, TRUE AS from_table FROM documents GROUP BY lang")
def w04_one_per_category_check(spark, d):
    """One row per category, taken whole from the table."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    one = rank.one_per_category(docs, "lang", "doc_id")
    real = docs.withColumn("from_table", F.lit(True))
    return one.join(real, ["doc_id", "lang", "n_chars"], "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce("from_table", F.lit(False))).alias("from_table"))


@register("p01_fraction_check", "SELECT TRUE AS near_share, TRUE AS splits_orders FROM lineitem LIMIT 1")
def p01_fraction_check(spark, d):
    """A 10 % sample of order lines is near its share and cuts through orders."""
    li = t(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    s = sample.sample_fraction(li, 0.1, keys).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    j = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(s, "l_orderkey", "left").fillna(0, subset=["k"])
    share = F.sum("k") / F.sum("n")
    return j.agg((F.abs(share - 0.1) < 0.03).alias("near_share"), F.max((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("splits_orders"))


@register("e01_label_encode_names", """
WITH l AS (SELECT c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer))
SELECT c_custkey, CAST(code AS INTEGER) AS c_name FROM customer JOIN l USING (c_name)
""")
def e01_label_encode_names(spark, d):
    """Label codes of a column with one level per row: the join on the level has no cap."""
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    return encode.apply_codes(c, encode.fit_label_encoder(c, ["c_name"]))


@register("n06_cumulative_variance", "SELECT CAST(64 AS BIGINT) AS n, TRUE AS whole, TRUE AS first_to_reach FROM embeddings LIMIT 1")
def n06_cumulative_variance(spark, d):
    """The cumulative share covers all components, and k is the first to reach 90 %."""
    from quarry.plans.q_models import n06_pca_variance
    x = n06_pca_variance(spark, d)
    k = F.min(F.when(F.col("cum_share") >= 0.9, F.col("component")))
    return x.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.max("cum_share") - 1) < 1e-9).alias("whole"), (k == F.max("k_for_90")).alias("first_to_reach"))
