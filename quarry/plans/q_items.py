"""Inventory items that larger plans also use, each bound on its own.

A5, A18, F27, F31, J1, J2, M8, S4, S9, T2, V2, V3, W6, W7, X10: every one
reads the whole test tables; the relational ones have a DuckDB twin.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import columns as fc
from quarry.operators import rank, sample, score, shape, textclf
from quarry.plans.registry import register, rnd, t
from quarry.sources import io


def _round_array(c, n: int = 6):
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: F.round(x, n))


# ------------------------------------------------------------------ S4, S9

S04_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_quantity >= 45 AND l_shipdate >= TIMESTAMP '2000-01-01'
"""


@register("s04_parquet_scan", S04_SQL)
def s04_parquet_scan(spark, d):
    """Parquet scan reading 4 of 11 columns, both predicates pushed into the reader."""
    li = io.read_parquet(spark, os.path.join(d, "lineitem.parquet"),
                         columns=["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])
    return li.filter((F.col("l_quantity") >= 45) & (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")))


S09_SQL = """
SELECT l_returnflag, l_linestatus,
       sum(l_quantity) AS sum_qty,
       ROUND(sum(l_extendedprice), 2) AS sum_base_price,
       ROUND(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       ROUND(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       ROUND(avg(l_quantity), 6) AS avg_qty,
       ROUND(avg(l_extendedprice), 6) AS avg_price,
       ROUND(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2001-09-02'
GROUP BY l_returnflag, l_linestatus
ORDER BY l_returnflag, l_linestatus
"""


@register("s09_sql_over_views", S09_SQL)
def s09_sql_over_views(spark, d):
    """A SQL report over a registered view (S9): pricing summary per return flag and status."""
    return io.sql(spark, S09_SQL, {"lineitem": t(spark, d, "lineitem")})


# ------------------------------------------------------------------ A5, A18

A05_SQL = """
SELECT o_custkey, count(*) AS n_orders, ROUND(sum(o_totalprice), 2) AS total_spent
FROM orders GROUP BY o_custkey HAVING count(*) > 12
"""


@register("a05_having_alias", A05_SQL)
def a05_having_alias(spark, d):
    """HAVING on an aggregate alias (A5): customers with more than 12 orders."""
    return io.sql(spark, """
        SELECT o_custkey, count(*) AS n_orders, ROUND(sum(o_totalprice), 2) AS total_spent
        FROM orders GROUP BY o_custkey HAVING n_orders > 12""", {"orders": t(spark, d, "orders")})


A18_SQL = """
WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM x GROUP BY label, i)
SELECT label, max(n) AS n, list(ROUND(m, 6) ORDER BY i) AS centroid FROM m GROUP BY label
"""


@register("a18_group_centroid", A18_SQL)
def a18_group_centroid(spark, d):
    """Per-group mean of coordinate vectors (A18) with the ml Summarizer: one partial aggregate, no explode."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    e = t(spark, d, "embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    g = e.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("c"), F.count(F.lit(1)).alias("n"))
    return g.select("label", "n", _round_array(vector_to_array("c")).alias("centroid"))


# ------------------------------------------------------------------ F27, F31

F27_SQL = """
WITH s AS (SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, o.o_orderdate, s.delivered,
       ROUND((epoch_us(s.delivered) - epoch_us(o.o_orderdate)) / 86400e6, 6) AS delay_days
FROM orders o JOIN s ON s.l_orderkey = o.o_orderkey
"""


@register("f27_delay_days", F27_SQL)
def f27_delay_days(spark, d):
    """Delay in fractional days from order to last shipment (F27); lineitem is reduced before the join."""
    s = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("delivered"))
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = o.join(s, o.o_orderkey == s.l_orderkey)
    return j.select("o_orderkey", "o_orderdate", "delivered",
                    rnd(fc.frac_days("delivered", "o_orderdate")).alias("delay_days"))


@register("f31_id_first", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def f31_id_first(spark, d):
    """Id column moved to the front."""
    return shape.id_first(t(spark, d, "orders"), "o_custkey")


# ------------------------------------------------------------------ J1, J2

J01_SQL = """
SELECT s.s_nationkey, o.o_orderstatus, count(*) AS n_lines,
       ROUND(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY s.s_nationkey, o.o_orderstatus
"""


@register("j01_three_table_join", J01_SQL)
def j01_three_table_join(spark, d):
    """lineitem x orders x supplier inner equi-joins, then an aggregate."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.groupBy("s_nationkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"),
        rnd(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


J02_SQL = """
WITH ord AS (SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey),
ret AS (SELECT o.o_custkey, count(*) AS n_returned_lines
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        WHERE l.l_returnflag = 'R' GROUP BY o.o_custkey)
SELECT c.c_custkey, n.n_name, COALESCE(ord.n_orders, 0) AS n_orders, ord.last_order,
       COALESCE(ret.n_returned_lines, 0) AS n_returned_lines
FROM customer c
LEFT JOIN ord ON c.c_custkey = ord.o_custkey
LEFT JOIN ret ON c.c_custkey = ret.o_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
"""


@register("j02_chained_left_joins", J02_SQL)
def j02_chained_left_joins(spark, d):
    """Customer table left-joined to two pre-aggregated child tables and a dimension."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ord_ = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    li = t(spark, d, "lineitem").filter(F.col("l_returnflag") == "R").select("l_orderkey")
    ret = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("r_custkey"))
           .agg(F.count(F.lit(1)).alias("n_returned_lines")))
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    j = (c.join(ord_, c.c_custkey == ord_.o_custkey, "left")
         .join(ret, c.c_custkey == ret.r_custkey, "left")
         .join(n, c.c_nationkey == n.n_nationkey, "left"))
    return j.select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "last_order",
                    F.coalesce("n_returned_lines", F.lit(0)).alias("n_returned_lines"))


# ------------------------------------------------------------------ T2, V2, V3

T02_SQL = """
(SELECT 'top' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
UNION ALL
(SELECT 'bottom' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC, c_custkey LIMIT 5)
"""


@register("t02_top_bottom_n", T02_SQL)
def t02_top_bottom_n(spark, d):
    """Top-5 and bottom-5 customers by balance (T2): each a TakeOrderedAndProject, 5 rows per task."""
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    top = rank.top_n(c, [F.desc("c_acctbal"), F.asc("c_custkey")], 5).select(F.lit("top").alias("side"), "*")
    bottom = rank.top_n(c, [F.asc("c_acctbal"), F.asc("c_custkey")], 5).select(F.lit("bottom").alias("side"), "*")
    return top.unionByName(bottom)


V02_SQL = """
SELECT l_orderkey, l_linenumber,
       ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
       CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'mid' ELSE 'low' END AS discount_band
FROM lineitem
"""


@register("v02_row_expression", V02_SQL)
def v02_row_expression(spark, d):
    """A per-row function written as native expressions, not a Python lambda (V2)."""
    li = t(spark, d, "lineitem")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    band = (F.when(F.col("l_discount") >= 0.08, "high").when(F.col("l_discount") >= 0.04, "mid")
            .otherwise("low"))
    return li.select("l_orderkey", "l_linenumber", rnd(charge, 6).alias("charge"), band.alias("discount_band"))


V03_GROUPS = 3

V03_SQL = f"""
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
g AS (SELECT vec_id, (i - 1) % {V03_GROUPS} AS j, sum(v) AS s FROM x GROUP BY vec_id, j)
SELECT vec_id, list(ROUND(s, 6) ORDER BY j) AS projection FROM g GROUP BY vec_id
"""


@register("v03_arrow_batches", V03_SQL)
def v03_arrow_batches(spark, d):
    """A vectorised UDF with a bounded Arrow batch size after a key-hashed repartition (V3).

    The matrix sums coordinates by index modulo 3; the repartition count
    follows the session's shuffle partitions (sized for the cluster).
    """
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    dim = len(e.select("embedding").first()[0])
    w = np.zeros((dim, V03_GROUPS))
    w[np.arange(dim), np.arange(dim) % V03_GROUPS] = 1.0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = score.project_vectors(e.repartition(parts, "vec_id"), "embedding", w, batch_size=2048)
    return out.select("vec_id", _round_array("projection").alias("projection"))


# ------------------------------------------------------------------ W6, W7

W06_SQL = """
WITH g AS (SELECT c.c_nationkey AS nation, sum(o.o_totalprice) AS revenue
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey),
r AS (SELECT nation, revenue, CAST(row_number() OVER (ORDER BY revenue DESC, nation) AS INTEGER) AS pos FROM g),
s AS (SELECT nation, revenue, pos,
             sum(revenue) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(revenue) OVER () AS cum_share
      FROM r)
SELECT nation, ROUND(revenue, 2) AS revenue, pos, ROUND(cum_share, 6) AS cum_share,
       pos = (SELECT min(pos) FROM s WHERE cum_share >= 0.8) AS reaches
FROM s
"""


@register("w06_cumulative_share", W06_SQL)
def w06_cumulative_share(spark, d):
    """Pareto table: cumulative revenue share by nation and the first one reaching 80 %."""
    o = t(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    g = (o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"))
         .agg(F.sum("o_totalprice").alias("revenue")))
    # one row per nation: the ordering window below runs on a table of at most 25 rows
    g = g.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("revenue"), "nation")).cast("int"))
    out = rank.cumulative_share(g, "pos", "revenue", threshold=0.8)
    return out.select("nation", rnd("revenue", 2).alias("revenue"), "pos", rnd("cum_share").alias("cum_share"),
                      "reaches")


W07_SQL = """
WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1),
r AS (SELECT month, revenue, max(revenue) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM m)
SELECT month, ROUND(revenue, 2) AS revenue, ROUND(prev_best, 2) AS prev_best,
       prev_best IS NULL OR revenue > prev_best AS is_new_best
FROM r
"""


@register("w07_running_best", W07_SQL)
def w07_running_best(spark, d):
    """Running best with a new-best marker over the monthly revenue table."""
    m = (t(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"))
         .agg(F.sum("o_totalprice").alias("revenue")))
    out = rank.running_best(m, "month", "revenue", higher_is_better=True)
    return out.select("month", rnd("revenue", 2).alias("revenue"), rnd("prev_best", 2).alias("prev_best"),
                      "is_new_best")


# ------------------------------------------------------------------ X10, M8

X10_SQL = """
WITH tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}') AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_distinct(toks)) AS INTEGER) AS n_distinct,
       toks[1] AS first_token, toks[-1] AS last_token
FROM tk
"""


@register("x10_tokenise", X10_SQL)
def x10_tokenise(spark, d):
    """Lower-cased tokens of two or more word characters over whole texts."""
    docs = t(spark, d, "documents").select("doc_id", fc.tokens("text").alias("toks"))
    return docs.select("doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_distinct"),
                       F.get(F.col("toks"), 0).alias("first_token"),
                       F.get(F.col("toks"), F.size("toks") - 1).alias("last_token"))


@register("m08_multinomial_text")
def m08_multinomial_text(spark, d):
    """Multinomial logistic regression on term counts, predicting the language (M8).

    Fitted on a seeded 75 % hash split of all documents, applied to the rest.
    """
    docs = sample.random_split(t(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", [0.75, 0.25])
    train, test = docs.filter("split = 0"), docs.filter("split = 1")
    m = textclf.text_classifier(train, "text", "lang", max_iter=20)
    labels = m.stages[0].labels
    pred = m.transform(test)
    return pred.select("doc_id", "lang",
                       F.element_at(F.array(*[F.lit(x) for x in labels]),
                                    F.col("prediction").cast("int") + 1).alias("predicted"))
