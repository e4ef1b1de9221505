"""Relational operators bound to the test tables (S, F, J, A, W, T, U, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as fc
from quarry.operators import agg, joins, rank, shape
from quarry.plans.registry import null_when, register, rnd, rounded, t

ANCHOR = "2001-08-01"


# ------------------------------------------------------------------ worked SQL

# Thresholds and spans of the worked questions.
INCOME_OVER = 20_000_000
ITEMS_OVER = 30
SCORES_OVER = 30
WORST_AREAS = 5

A24_SPARK = f"""
SELECT s_suppkey, s_name, s_nationkey, round(sum(gain), 4) AS income
FROM (SELECT l_suppkey, l_orderkey, l_extendedprice * (1 - l_discount) AS gain FROM lineitem) AS sold
     JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AS placed ON o_orderkey = l_orderkey
     JOIN supplier ON s_suppkey = l_suppkey
GROUP BY s_suppkey, s_name, s_nationkey
HAVING income > {INCOME_OVER}
ORDER BY income DESC
"""


@register("a24_seller_revenue", A24_SPARK)
def a24_seller_revenue(spark, d):
    """Which suppliers earned more than the threshold on orders that are not pending? (A24, J1, A5, S9; SQL form)"""
    for n in ("lineitem", "orders", "supplier"):
        t(spark, d, n).createOrReplaceTempView(n)
    return spark.sql(A24_SPARK)


@register("a24_seller_revenue_df", A24_SPARK)
def a24_seller_revenue_df(spark, d):
    """Same question through the DataFrame API: summed per supplier first, named afterwards."""
    placed = t(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    gain = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    income = (t(spark, d, "lineitem").join(placed, "l_orderkey", "left_semi")
              .groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum(gain), 4).alias("income")))
    named = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return income.filter(F.col("income") > INCOME_OVER).join(named, "s_suppkey").select(
        "s_suppkey", "s_name", "s_nationkey", "income").orderBy(F.desc("income"))


# A late delivery took at least 30 days; recent means the last 3 calendar months.
LATE_DAYS, RECENT_MONTHS = 30, 3

A25_SQL = f"""
WITH recent AS (
  SELECT o_orderkey, o_custkey, o_orderdate FROM orders
  WHERE o_orderstatus = 'F' AND o_orderdate >= CAST(DATE '{ANCHOR}' - INTERVAL {RECENT_MONTHS} MONTH AS TIMESTAMP)),
arrival AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_custkey, o_orderdate, delivered, ROUND((epoch_us(delivered) - epoch_us(o_orderdate)) / 86400e6, 6) AS delay_days
FROM recent JOIN arrival USING (o_orderkey)
WHERE delivered >= o_orderdate + INTERVAL {LATE_DAYS} DAY
"""


@register("a25_late_recent_orders", A25_SQL)
def a25_late_recent_orders(spark, d):
    """Which orders of the last calendar months arrived late, latest orders first?

    An order has arrived when its last item has; only items of recent orders are aggregated.
    """
    recent = shape.filter_recent_months(t(spark, d, "orders").filter("o_orderstatus = 'F'"), "o_orderdate", ANCHOR, RECENT_MONTHS)
    recent = recent.select("o_orderkey", "o_custkey", "o_orderdate")
    items = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(recent, "o_orderkey", "left_semi")
    arrival = items.groupBy("o_orderkey").agg(F.max("l_shipdate").alias("delivered"))
    late = recent.join(arrival, "o_orderkey").filter(F.col("delivered") >= F.col("o_orderdate") + F.make_dt_interval(days=F.lit(LATE_DAYS)))
    return late.withColumn("delay_days", rnd(fc.frac_days("delivered", "o_orderdate"))).orderBy(F.desc("o_orderdate"), "o_orderkey")


A26_SQL = f"""
SELECT s_suppkey, s_name, s_nationkey, min(o_orderdate) AS debut, count(*) AS n_items
FROM orders, lineitem, supplier
WHERE l_orderkey = o_orderkey AND s_suppkey = l_suppkey AND o_orderstatus = 'F' AND l_returnflag = 'R'
GROUP BY ALL
HAVING n_items > {ITEMS_OVER} AND debut >= TIMESTAMP '1994-12-15'
"""


@register("a26_new_active_sellers", A26_SQL)
def a26_new_active_sellers(spark, d):
    """Which suppliers made their first sale after the date and have sold more than the threshold since?

    The date is three calendar months and a fortnight's rest after the anchor
    of the question (1995-03-01), computed here and written out in the twin.
    """
    since = F.date_add(F.add_months(F.lit("1995-03-01").cast("date"), -3), 14).cast("timestamp_ntz")
    done = t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    record = (t(spark, d, "lineitem").filter("l_returnflag = 'R'").join(done, "l_orderkey")
              .groupBy(F.col("l_suppkey").alias("s_suppkey"))
              .agg(F.min("o_orderdate").alias("debut"), F.count(F.lit(1)).alias("n_items"))
              .filter((F.col("n_items") > ITEMS_OVER) & (F.col("debut") >= since)))
    named = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return named.join(record, "s_suppkey").orderBy(F.desc("n_items"), "s_suppkey")


A27_SQL = f"""
SELECT c_nationkey AS area, round(100 * sum(l_discount) / count(*), 6) AS mean_score, count(*) AS n_scores,
       min(l_shipdate) AS first_day, max(l_shipdate) AS last_day
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP '2000-08-01' AND l_shipdate <= TIMESTAMP '{ANCHOR}'
GROUP BY area
HAVING n_scores > {SCORES_OVER}
ORDER BY mean_score, area
LIMIT {WORST_AREAS}
"""


@register("a27_worst_areas", A27_SQL)
def a27_worst_areas(spark, d):
    """Which areas scored worst over the year up to the anchor, among those with enough scores?"""
    until = F.lit(ANCHOR).cast("timestamp_ntz")
    since = F.add_months(F.lit(ANCHOR).cast("date"), -12).cast("timestamp_ntz")
    scored = t(spark, d, "lineitem").filter((F.col("l_shipdate") >= since) & (F.col("l_shipdate") <= until))
    buyer = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    home = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("area"))
    areas = scored.join(buyer, "l_orderkey").join(home, "c_custkey").groupBy("area").agg(
        rnd(100 * F.sum("l_discount") / F.count(F.lit(1))).alias("mean_score"), F.count(F.lit(1)).alias("n_scores"),
        F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"))
    return rank.top_n(areas.filter(F.col("n_scores") > SCORES_OVER), [F.col("mean_score"), F.col("area")], WORST_AREAS)


A28_SQL = """
SELECT o_orderkey, o_orderstatus, o_orderdate, round(paid, 4) AS paid, round(rating, 6) AS rating, c_custkey, c_name, c_nationkey
FROM orders
     LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 + l_tax)) AS paid, avg(l_quantity) AS rating
                FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
     LEFT JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus <> 'P'
"""


@register("a28_order_extract", A28_SQL)
def a28_order_extract(spark, d):
    """One row per order with its amount, rating and customer.

    Both measures of the items come from one aggregate per order, so the joins
    cannot fan out and lineitem is read once.
    """
    measures = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        rnd(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))), 4).alias("paid"), rnd(F.avg("l_quantity")).alias("rating"))
    who = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    placed = t(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey")
    return placed.join(measures, "o_orderkey", "left").join(who, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


# ------------------------------------------------------------------ F family

@register("f01_select_rename", """
SELECT p_partkey AS "part-key", p_name AS "name (p)", p_retailprice AS "price.eur" FROM part
""")
def f01_select_rename(spark, d):
    """Select + rename to names with '-', '(' and '.' (F1)."""
    return shape.select_rename(t(spark, d, "part"), {"p_partkey": "part-key", "p_name": "name (p)",
                                                     "p_retailprice": "price.eur"})


@register("f02_filter_in", """
SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'
""")
def f02_filter_in(spark, d):
    """Membership and equality filters (F2)."""
    o = shape.filter_in(t(spark, d, "orders"), "o_orderstatus", ["F", "P"])
    return shape.filter_in(o, "o_orderpriority", "1-URGENT")


@register("f03_filter_contains", """
SELECT * FROM part WHERE coalesce(contains(lower(p_name), 'red'), false)
""")
def f03_filter_contains(spark, d):
    """Case-folded substring filter, NULL -> false."""
    return shape.filter_contains(t(spark, d, "part"), "p_name", "RED")


@register("f04_filter_between", """
SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-30'
""")
def f04_filter_between(spark, d):
    """Closed date range."""
    return shape.filter_between(t(spark, d, "orders"), "o_orderdate",
                                F.lit("1998-01-01").cast("timestamp_ntz"),
                                F.lit("1998-06-30").cast("timestamp_ntz"))


@register("f05_recent_months", f"""
SELECT * FROM orders WHERE o_orderdate >= CAST(DATE '{ANCHOR}' - INTERVAL 12 MONTH AS TIMESTAMP)
""")
def f05_recent_months(spark, d):
    """Calendar-relative filter: last 12 months before the anchor."""
    return shape.filter_recent_months(t(spark, d, "orders"), "o_orderdate", ANCHOR, 12)


@register("f06_drop_nulls", """
SELECT * FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer) WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL
""")
def f06_drop_nulls(spark, d):
    """Drop rows with NULLs in a subset (F6) on injected NULLs."""
    c = t(spark, d, "customer").select(
        "c_custkey", null_when("c_custkey", 7, "c_acctbal").alias("c_acctbal"),
        null_when("c_custkey", 5, "c_mktsegment").alias("c_mktsegment"))
    return shape.drop_nulls(c, ["c_acctbal", "c_mktsegment"])


_F7_BASE = """
  SELECT c_custkey, CAST(c_acctbal > 5000 AS INTEGER) AS target,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS a,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS b,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS s
  FROM customer
"""


def _f7_base(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", (F.col("c_acctbal") > 5000).cast("int").alias("target"),
                    null_when("c_custkey", 7, "c_acctbal").alias("a"),
                    null_when("c_custkey", 5, "c_nationkey").alias("b"),
                    null_when("c_custkey", 3, "c_mktsegment").alias("s"))


@register("f07_class_conditional_complete", f"""
SELECT * FROM ({_F7_BASE}) WHERE target <> 0 OR (a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL)
""")
def f07_class_conditional_complete(spark, d):
    """Only class 0 must be complete."""
    return shape.drop_incomplete(_f7_base(spark, d), "target", 0, ["a", "b", "s"])


@register("f08_missing_count_filter", f"""
SELECT * FROM ({_F7_BASE})
WHERE target <> 0 OR ((a IS NULL)::INT + (b IS NULL)::INT + (s IS NULL)::INT) <= 1
""")
def f08_missing_count_filter(spark, d):
    """Class-0 rows with at most one missing value (F8)."""
    return shape.drop_incomplete(_f7_base(spark, d), "target", 0, ["a", "b", "s"], max_missing=1)


_NULLY = """
  SELECT c_custkey,
    CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS half,
    CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS mostly,
    CASE WHEN c_custkey % 4 <> 0 THEN NULL ELSE c_nationkey END AS quarter,
    CAST(NULL AS DOUBLE) AS empty
  FROM customer
"""


def _nully(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", null_when("c_custkey", 2, "c_acctbal").alias("half"),
                    null_when("c_custkey", 10, "c_name").alias("mostly"),
                    F.when(F.pmod("c_custkey", F.lit(4)) != 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("quarter"),
                    F.lit(None).cast("double").alias("empty"))


_PROFILE_SQL = f"""
WITH b AS ({_NULLY}), s AS (
  SELECT count(*) AS n, count(c_custkey) AS k, count(half) AS h, count(mostly) AS m,
         count(quarter) AS q, count(empty) AS e FROM b)
SELECT * FROM (
  SELECT 'c_custkey' AS column_name, n AS n_rows, k AS non_null FROM s UNION ALL
  SELECT 'half', n, h FROM s UNION ALL SELECT 'mostly', n, m FROM s UNION ALL
  SELECT 'quarter', n, q FROM s UNION ALL SELECT 'empty', n, e FROM s)
"""


@register("a19_profile", f"""
SELECT column_name, n_rows, non_null, n_rows - non_null AS n_null,
       ROUND(non_null / n_rows, 6) AS non_null_ratio FROM ({_PROFILE_SQL})
""")
def a19_profile(spark, d):
    """Completeness profile in one aggregate pass."""
    return rounded(shape.profile(_nully(spark, d)))


@register("f09_sparse_report", f"""
SELECT column_name, n_rows, non_null, n_rows - non_null AS n_null,
       ROUND(non_null / n_rows, 6) AS non_null_ratio, non_null / n_rows >= 0.6 AS keep
FROM ({_PROFILE_SQL})
""")
def f09_sparse_report(spark, d):
    """Sparse-column pruning decisions, ratio >= 60 % kept."""
    return rounded(shape.sparse_report(_nully(spark, d), 0.6), cols=["non_null_ratio"])


@register("f09_prune_sparse", f"""
SELECT c_custkey, mostly FROM ({_NULLY})
""")
def f09_prune_sparse(spark, d):
    """The pruned table itself: columns with non-null ratio > 30 % strict... kept at 0.6."""
    return shape.prune_sparse(_nully(spark, d), 0.6)


@register("f10_all_null_columns", f"""
SELECT column_name FROM ({_PROFILE_SQL}) WHERE non_null = 0
""")
def f10_all_null_columns(spark, d):
    """Columns without a single value."""
    return shape.all_null_columns(_nully(spark, d))


@register("f11_dedup_first", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
""")
def f11_dedup_first(spark, d):
    """First event per user (F11) via min_by aggregation."""
    return shape.dedup_first(t(spark, d, "events"), ["user_id"], ["ts", "event_id"])


@register("f12_sanitize_columns", """
SELECT p_partkey AS part_key, p_name AS name__p_, p_retailprice AS price_eur FROM part
""")
def f12_sanitize_columns(spark, d):
    """Column-name sanitiser [^0-9a-zA-Z_] -> _."""
    p = shape.select_rename(t(spark, d, "part"), {"p_partkey": "part-key", "p_name": "name (p)",
                                                  "p_retailprice": "price.eur"})
    return shape.sanitize_columns(p)


@register("f13_align_fill", """
SELECT c_custkey, c_acctbal, c_name, CAST(NULL AS DOUBLE) AS extra_feature FROM customer
""")
def f13_align_fill(spark, d):
    """Align to expected columns: reorder, drop extra, add missing as NULL, id first."""
    return shape.align(t(spark, d, "customer"), ["c_acctbal", "c_name", "extra_feature"],
                       mode="fill", id_col="c_custkey")


@register("f15_compare_tables", """
WITH l AS (SELECT count(c_custkey) n1, count(DISTINCT c_custkey) d1, count(c_name) n2, count(DISTINCT c_name) d2,
                  count(c_nationkey) n3, count(DISTINCT c_nationkey) d3, count(c_acctbal) n4, count(DISTINCT c_acctbal) d4,
                  count(c_mktsegment) n5, count(DISTINCT c_mktsegment) d5 FROM customer),
     r0 AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
                   c_acctbal * 2 AS c_acctbal, c_custkey % 10 AS bucket FROM customer),
     r AS (SELECT count(c_custkey) n1, count(DISTINCT c_custkey) d1, count(c_nationkey) n3, count(DISTINCT c_nationkey) d3,
                  count(c_acctbal) n4, count(DISTINCT c_acctbal) d4, count(bucket) n6, count(DISTINCT bucket) d6 FROM r0)
SELECT 'c_custkey' AS column_name, true AS in_left, true AS in_right, l.n1 AS left_non_null, l.d1 AS left_distinct, r.n1 AS right_non_null, r.d1 AS right_distinct FROM l, r
UNION ALL SELECT 'c_name', true, false, l.n2, l.d2, NULL, NULL FROM l
UNION ALL SELECT 'c_nationkey', true, true, l.n3, l.d3, r.n3, r.d3 FROM l, r
UNION ALL SELECT 'c_acctbal', true, true, l.n4, l.d4, r.n4, r.d4 FROM l, r
UNION ALL SELECT 'c_mktsegment', true, false, l.n5, l.d5, NULL, NULL FROM l
UNION ALL SELECT 'bucket', false, true, NULL, NULL, r.n6, r.d6 FROM r
""")
def f15_compare_tables(spark, d):
    """Columns only in one table and per shared column non-null/distinct counts."""
    c = t(spark, d, "customer")
    r = c.select("c_custkey", null_when("c_custkey", 3, "c_nationkey").alias("c_nationkey"),
                 (F.col("c_acctbal") * 2).alias("c_acctbal"), F.pmod("c_custkey", F.lit(10)).alias("bucket"))
    return shape.compare_tables(c, r)


@register("f16_nullify", """
SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN NULL ELSE p_type END AS p_type,
       CASE WHEN p_size = 50 THEN NULL ELSE p_size END AS p_size FROM part
""")
def f16_nullify(spark, d):
    """Replace sentinel values by NULL (F16)."""
    p = t(spark, d, "part").select("p_partkey", "p_type", "p_size")
    p = shape.nullify(p, ["p_type"], ["PROMO", "ECONOMY"])
    return shape.nullify(p, ["p_size"], 50)


PRIORITY_RANK = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}


@register("f17_map_values", """
SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
  WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS priority_rank FROM orders
""")
def f17_map_values(spark, d):
    """Dictionary map, unmapped -> NULL."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return shape.map_values(o, "o_orderpriority", PRIORITY_RANK, "priority_rank")


_TYPE_FLAGS = [("ECONOMY", 1, 0, 0), ("LARGE", 0, 1, 0), ("MEDIUM", 0, 1, 0), ("PROMO", 1, 0, 1),
               ("SMALL", 0, 0, 0), ("STANDARD", 0, 0, 0)]


@register("f18_map_flags", """
WITH m(k, is_cheap, is_big, is_promo) AS (VALUES ('ECONOMY', 1, 0, 0), ('LARGE', 0, 1, 0), ('MEDIUM', 0, 1, 0),
  ('PROMO', 1, 0, 1), ('SMALL', 0, 0, 0), ('STANDARD', 0, 0, 0))
SELECT p_partkey, p_type, is_cheap, is_big, is_promo FROM part LEFT JOIN m ON p_type = k
""")
def f18_map_flags(spark, d):
    """One code -> several flag columns through a small mapping table; unmapped raises."""
    m = spark.createDataFrame(_TYPE_FLAGS, "k string, is_cheap int, is_big int, is_promo int")
    return shape.map_flags(t(spark, d, "part").select("p_partkey", "p_type"), "p_type", m, "k")


@register("f19_ratios", """
SELECT l_orderkey, l_linenumber, ROUND(l_tax / nullif(l_discount, 0), 6) AS tax_per_discount,
       ROUND(l_extendedprice / nullif(l_quantity, 0), 6) AS unit_price FROM lineitem
""")
def f19_ratios(spark, d):
    """Null-safe ratio features: x/0 -> NULL."""
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     rnd(fc.safe_div("l_tax", "l_discount")).alias("tax_per_discount"),
                     rnd(fc.safe_div("l_extendedprice", "l_quantity")).alias("unit_price"))


@register("f20_f24_transforms", """
SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL ELSE greatest(c_acctbal, 0) END AS clipped,
       ROUND(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS signed_log,
       ROUND(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log_bal
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)
""")
def f20_f24_transforms(spark, d):
    """Clip at 0 keeping NULL (F20), signed log and log target transforms."""
    c = t(spark, d, "customer").select("c_custkey", null_when("c_custkey", 7, "c_acctbal").alias("c_acctbal"))
    return c.select("c_custkey", fc.clip_lower("c_acctbal", 0.0).alias("clipped"),
                    rnd(fc.signed_log1p("c_acctbal")).alias("signed_log"),
                    rnd(fc.safe_log("c_acctbal")).alias("log_bal"))


@register("f21_row_sum_mean", """
WITH b AS (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS a,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS b,
    CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber,
  ROUND(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) AS fam_sum,
  ROUND((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))
        / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS fam_mean
FROM b
""")
def f21_row_sum_mean(spark, d):
    """Row-wise sum and mean over a column family, skipping NULLs."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                        null_when("l_orderkey", 3, "l_tax").alias("a"),
                                        null_when("l_orderkey", 5, "l_discount").alias("b"),
                                        null_when("l_orderkey", 7, "l_quantity").alias("c"))
    return li.select("l_orderkey", "l_linenumber", rnd(fc.row_sum(["a", "b", "c"])).alias("fam_sum"),
                     rnd(fc.row_mean(["a", "b", "c"])).alias("fam_mean"))


@register("f22_f23_day_counters", f"""
WITH b AS (
  SELECT l.l_orderkey, l.l_linenumber,
         CAST(o.o_orderdate AS DATE) - DATE '{ANCHOR}' AS days_order,
         CAST(l.l_shipdate AS DATE) - DATE '{ANCHOR}' AS days_ship
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT l_orderkey, l_linenumber, -days_order / 365.0 AS years_order,
       -days_ship / 365.0 AS years_ship,
       (-days_ship / 365.0) / nullif(-days_order / 365.0, 0) AS ship_order_ratio,
       coalesce((-days_ship / 365.0 < 1)::INT, 0) AS recent_ship
FROM b
""")
def f22_f23_day_counters(spark, d):
    """Negative day counters -> years, ratio of two (F22); recency flag with NULL -> 0."""
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    a = F.lit(ANCHOR).cast("date")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber",
        F.datediff(F.col("o_orderdate").cast("date"), a).alias("days_order"),
        F.datediff(F.col("l_shipdate").cast("date"), a).alias("days_ship"))
    yo, ys = -F.col("days_order") / 365.0, -F.col("days_ship") / 365.0
    return j.select("l_orderkey", "l_linenumber", yo.alias("years_order"), ys.alias("years_ship"),
                    fc.safe_div(ys, yo).alias("ship_order_ratio"),
                    fc.lt_flag(ys, 1).alias("recent_ship"))


@register("f25_bools_to_int", """
SELECT o_orderkey, (o_orderstatus = 'F')::INT AS is_final, (o_totalprice > 200000)::INT AS is_big FROM orders
""")
def f25_bools_to_int(spark, d):
    """Every boolean column cast to int."""
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_final"),
                                     (F.col("o_totalprice") > 200000).alias("is_big"))
    return shape.bools_to_int(o)


@register("f26_parse_timestamp", """
SELECT event_id, try_strptime(s, '%Y-%m-%d %H:%M:%S') AS parsed FROM (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS s
  FROM events)
""")
def f26_parse_timestamp(spark, d):
    """Text -> timestamp with bad values coerced to NULL."""
    e = t(spark, d, "events")
    s = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit("not a date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", shape.parse_timestamp(s).alias("parsed"))


@register("f28_recency_days", """
WITH last AS (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey),
     ref AS (SELECT max(o_orderdate) + INTERVAL 1 DAY AS today FROM orders)
SELECT o_custkey, CAST(floor((epoch_us(today) - epoch_us(last_order)) / 86400e6) AS BIGINT) AS recency
FROM last, ref
""")
def f28_recency_days(spark, d):
    """Whole days since the last order against max date + 1 day."""
    o = t(spark, d, "orders")
    today = o.select(F.max("o_orderdate") + F.expr("INTERVAL 1 DAY")).scalar()
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    return last.select("o_custkey", F.floor(fc.frac_days(today, "last_order")).cast("bigint").alias("recency"))


@register("f29_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def f29_point_lookup(spark, d):
    """Point lookup by id (F29); pushed into the Parquet scan."""
    return t(spark, d, "customer").filter(F.col("c_custkey") == 42)


@register("f30_round_half_even", """
SELECT o_orderkey, round_even(o_totalprice / 7, 2) AS price_7 FROM orders
""")
def f30_round_half_even(spark, d):
    """Half-even rounding."""
    return t(spark, d, "orders").select("o_orderkey", F.bround(F.col("o_totalprice") / 7, 2).alias("price_7"))


@register("f32_mean_fill", """
WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
SELECT c_custkey, ROUND(coalesce(bal, (SELECT avg(bal) FROM b)), 6) AS bal, 'x' AS const FROM b
""")
def f32_mean_fill(spark, d):
    """Mean fill through a scalar subquery, plus a constant column."""
    c = t(spark, d, "customer").select("c_custkey", null_when("c_custkey", 7, "c_acctbal").alias("bal"))
    return rounded(shape.fill_with_mean(c, ["bal"]).withColumn("const", F.lit("x")))


# ------------------------------------------------------------------ joins

@register("j03_child_agg_left_join", """
SELECT c.c_custkey, c.c_name, a.n_orders, ROUND(a.total, 2) AS total
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total
                           FROM orders GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey
""")
def j03_child_agg_left_join(spark, d):
    """Left join of a child aggregate onto its parent."""
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    a = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    return (c.join(a, c.c_custkey == a.o_custkey, "left")
            .select("c_custkey", "c_name", "n_orders", rnd("total", 2).alias("total")))


@register("j04_fold_feature_tables", """
SELECT c.c_custkey, o.n_orders, l.n_lines, ROUND(l.qty, 2) AS qty, n.region
FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) n_lines, sum(l_quantity) qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l
  ON c.c_custkey = l.o_custkey
LEFT JOIN (SELECT c_custkey AS k, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey) n
  ON c.c_custkey = n.k
""")
def j04_fold_feature_tables(spark, d):
    """Fold of N feature tables onto a base by key, all of them kept."""
    c, o, li, n = (t(spark, d, x) for x in ("customer", "orders", "lineitem", "nation"))
    f1 = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    f2 = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("c_custkey"))
          .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty")))
    f3 = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_regionkey").alias("region"))
    out = joins.join_features(c.select("c_custkey"), [f1, f2, f3], "c_custkey")
    return out.select("c_custkey", "n_orders", "n_lines", rnd("qty", 2).alias("qty"), "region")


@register("j05_semi_join", """
SELECT * FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey
                                     AND c.c_mktsegment = 'BUILDING')
""")
def j05_semi_join(spark, d):
    """Rows whose key is in an id set."""
    c = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi_join(t(spark, d, "orders"), c, "o_custkey")


@register("j06_anti_join", """
SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                                           AND o.o_orderstatus = 'P')
""")
def j06_anti_join(spark, d):
    """Ids not yet processed."""
    done = t(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti_join(t(spark, d, "customer"), done, "c_custkey")


@register("j07_pair_join", """
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
     b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1)
SELECT a.o_custkey, a.n AS n_1, b.n AS n_2 FROM a JOIN b ON a.o_custkey = b.o_custkey
""")
def j07_pair_join(spark, d):
    """Inner pairing of two versions with suffixes."""
    o = t(spark, d, "orders")
    a = o.filter(F.year("o_orderdate") == 1997).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    b = o.filter(F.year("o_orderdate") == 1998).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return joins.pair_join(a, b, "o_custkey")


@register("j09_label_mapping", """
WITH m(k, lbl) AS (VALUES ('BUILDING', 'Construction'), ('MACHINERY', 'Heavy machinery'))
SELECT c_custkey, c_mktsegment, coalesce(lbl, array_to_string(list_transform(string_split(replace(c_mktsegment, '_', ' '), ' '),
   lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')) AS display
FROM customer LEFT JOIN m ON c_mktsegment = k
""")
def j09_label_mapping(spark, d):
    """Small mapping join with an initcap fallback."""
    m = spark.createDataFrame([("BUILDING", "Construction"), ("MACHINERY", "Heavy machinery")], "k string, lbl string")
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return joins.map_labels(c, "c_mktsegment", m, "k", "lbl")


# ------------------------------------------------------------------ aggregates

@register("a01_a03_agg_features", """
SELECT o_custkey,
  min(o_totalprice) AS ORD_O_TOTALPRICE_MIN, max(o_totalprice) AS ORD_O_TOTALPRICE_MAX,
  ROUND(avg(o_totalprice), 6) AS ORD_O_TOTALPRICE_MEAN, ROUND(coalesce(sum(o_totalprice), 0), 2) AS ORD_O_TOTALPRICE_SUM,
  ROUND(var_samp(o_totalprice), 2) AS ORD_O_TOTALPRICE_VAR, count(DISTINCT o_orderstatus) AS ORD_O_ORDERSTATUS_NUNIQUE,
  count(*) AS ORD_COUNT
FROM orders GROUP BY o_custkey
""")
def a01_a03_agg_features(spark, d):
    """Spec-driven group features PREFIX_COL_FN plus group size (A1, A3)."""
    o = t(spark, d, "orders")
    f = agg.agg_features(o, "o_custkey", {"o_totalprice": ["min", "max", "mean", "sum", "var"],
                                          "o_orderstatus": ["nunique"]}, prefix="ORD", count=True)
    f = rounded(f, 6, ["ORD_O_TOTALPRICE_MEAN"])
    return rounded(f, 2, ["ORD_O_TOTALPRICE_SUM", "ORD_O_TOTALPRICE_VAR"])


@register("a02_filtered_aggs", """
SELECT o_custkey,
  CASE WHEN count(CASE WHEN o_orderstatus = 'O' THEN 1 END) > 0
       THEN ROUND(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN p END), 0), 2) END AS OPEN_P_SUM,
  max(CASE WHEN o_orderstatus = 'O' THEN p END) AS OPEN_P_MAX,
  count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS OPEN_COUNT
FROM (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)
GROUP BY o_custkey
""")
def a02_filtered_aggs(spark, d):
    """Aggregates restricted to a subset in the same pass, sum of nothing = 0 / no rows = NULL."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderstatus",
                                     null_when("o_orderkey", 4, "o_totalprice").alias("p"))
    f = agg.agg_features(o, "o_custkey", {"p": ["sum", "max"]}, prefix="OPEN",
                         where=F.col("o_orderstatus") == "O", count=True)
    return rounded(f, 2, ["OPEN_P_SUM"])


@register("a04_two_level_agg", """
WITH per_order AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
SELECT o.o_custkey, ROUND(avg(p.n_lines), 6) AS CUST_N_LINES_MEAN, max(p.qty) AS CUST_QTY_MAX,
       ROUND(coalesce(sum(p.qty), 0), 2) AS CUST_QTY_SUM
FROM per_order p JOIN orders o ON p.l_orderkey = o.o_orderkey GROUP BY o.o_custkey
""")
def a04_two_level_agg(spark, d):
    """Child -> parent -> grandparent aggregation (A4)."""
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    per_order = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey)
    f = agg.agg_features(j, "o_custkey", {"n_lines": ["mean"], "qty": ["max", "sum"]}, prefix="CUST")
    return rounded(rounded(f, 6, ["CUST_N_LINES_MEAN"]), 2, ["CUST_QTY_SUM"])


@register("a06_entity_summary", """
SELECT o_custkey, ROUND(avg(o_totalprice), 6) AS mean_total, ROUND(sum(o_totalprice), 2) AS sum_total,
       max(o_orderdate) AS last_order, count(*) AS n_orders
FROM orders GROUP BY o_custkey
""")
def a06_entity_summary(spark, d):
    """Named aggregates per entity."""
    o = t(spark, d, "orders")
    return o.groupBy("o_custkey").agg(rnd(F.avg("o_totalprice")).alias("mean_total"),
                                      rnd(F.sum("o_totalprice"), 2).alias("sum_total"),
                                      F.max("o_orderdate").alias("last_order"),
                                      F.count(F.lit(1)).alias("n_orders"))


@register("a07_value_counts", """
SELECT o_orderpriority, count(*) AS n, ROUND(count(*) / (SELECT count(*) FROM orders), 6) AS share
FROM orders GROUP BY 1
""")
def a07_value_counts(spark, d):
    """Value counts with shares."""
    return rounded(agg.value_counts(t(spark, d, "orders"), "o_orderpriority", normalize=True))


@register("a07_value_counts_top", """
SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10
""")
def a07_value_counts_top(spark, d):
    """Top-n value counts."""
    return agg.value_counts(t(spark, d, "lineitem"), "l_suppkey", top=10)


@register("a08_distinct_counts", """
SELECT 'l_orderkey' AS column_name, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
""")
def a08_distinct_counts(spark, d):
    """Distinct counts of several columns in one pass."""
    return agg.distinct_counts(t(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"])


@register("a09_a10_group_mean_std", """
SELECT c_mktsegment, ROUND(avg(c_acctbal), 6) AS c_acctbal_mean, ROUND(avg(c_nationkey), 6) AS c_nationkey_mean,
       ROUND(stddev_samp(c_acctbal), 6) AS c_acctbal_std, ROUND(stddev_samp(c_nationkey), 6) AS c_nationkey_std
FROM customer GROUP BY 1
""")
def a09_a10_group_mean_std(spark, d):
    """Group mean and sample std over several columns."""
    return rounded(agg.group_means(t(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"], std=True))


@register("a11_explode_item_stats", """
WITH w AS (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z][a-z]+')) AS item, p_retailprice FROM part)
SELECT item, ROUND(avg(p_retailprice), 6) AS mean_value, count(*) AS n FROM w GROUP BY item HAVING count(*) >= 20
""")
def a11_explode_item_stats(spark, d):
    """Explode a list, mean/count per item, min support, ranked."""
    p = t(spark, d, "part").select(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z][a-z]+"), 0).alias("words"),
                                   "p_retailprice")
    return rounded(agg.explode_stats(p, "words", "p_retailprice", 20))


@register("a12_crosstab", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def a12_crosstab(spark, d):
    """Contingency table, long form."""
    return agg.crosstab_long(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@register("a13_rollup_counts", """
SELECT p_type, p_brand, count(*) AS n, CAST(grouping(p_type, p_brand) AS BIGINT) AS level
FROM part GROUP BY ROLLUP (p_type, p_brand)
""")
def a13_rollup_counts(spark, d):
    """Two-level counts with parent totals and grand total."""
    return agg.hierarchy_counts(t(spark, d, "part"), "p_type", "p_brand")


@register("a14_quantiles", """
WITH qa AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75, 0.9]) AS a,
                   quantile_cont(l_extendedprice, [0.25, 0.5, 0.75, 0.9]) AS b FROM lineitem),
qs AS (SELECT [0.25, 0.5, 0.75, 0.9]::DOUBLE[] AS q)
SELECT 'l_quantity' AS column_name, unnest(q) AS quantile, unnest(a) AS value FROM qa, qs
UNION ALL SELECT 'l_extendedprice', unnest(q), ROUND(unnest(b), 6) FROM qa, qs
""")
def a14_quantiles(spark, d):
    """Exact interpolated quantiles."""
    return rounded(agg.quantiles(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"],
                                 [0.25, 0.5, 0.75, 0.9]))


@register("a15_box_stats", """
WITH q AS (SELECT c_mktsegment, count(c_acctbal) AS n, quantile_cont(c_acctbal, 0.25) AS q1,
                  quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3
           FROM customer GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.c_mktsegment, f.n, ROUND(f.q1, 6) AS q1, ROUND(f.median, 6) AS median, ROUND(f.q3, 6) AS q3,
  min(CASE WHEN c.c_acctbal BETWEEN lo AND hi THEN c.c_acctbal END) AS whisker_lo,
  max(CASE WHEN c.c_acctbal BETWEEN lo AND hi THEN c.c_acctbal END) AS whisker_hi,
  count(CASE WHEN NOT (c.c_acctbal BETWEEN lo AND hi) THEN 1 END) AS n_outliers
FROM f JOIN customer c ON c.c_mktsegment = f.c_mktsegment GROUP BY f.c_mktsegment, f.n, f.q1, f.median, f.q3
""")
def a15_box_stats(spark, d):
    """Box-plot summary per group."""
    return rounded(agg.box_stats(t(spark, d, "customer"), "c_mktsegment", "c_acctbal"), 6,
                   ["q1", "median", "q3"])


@register("a16_histogram", """
WITH mm AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
b AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 12)) AS INTEGER), 11) AS bin FROM orders, mm),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, ROUND(lo + g.bin * (hi - lo) / 12, 4) AS bin_lo, ROUND(lo + (g.bin + 1) * (hi - lo) / 12, 4) AS bin_hi,
       coalesce(c.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(12)) g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin
""")
def a16_histogram(spark, d):
    """Equal-width histogram, last bin closed, empty bins as 0."""
    return rounded(agg.histogram(t(spark, d, "orders"), "o_totalprice", 12), 4, ["bin_lo", "bin_hi"])


@register("a16_histogram_by_label", """
WITH mm AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer),
b AS (SELECT c_mktsegment, least(CAST(floor((c_acctbal - lo) / ((hi - lo) / 8)) AS INTEGER), 7) AS bin FROM customer, mm),
c AS (SELECT c_mktsegment, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT DISTINCT c_mktsegment, CAST(r.range AS INTEGER) AS bin FROM customer, range(8) r)
SELECT g.c_mktsegment, g.bin, ROUND(lo + g.bin * (hi - lo) / 8, 4) AS bin_lo,
       ROUND(lo + (g.bin + 1) * (hi - lo) / 8, 4) AS bin_hi, coalesce(c.n, 0) AS n
FROM g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin AND g.c_mktsegment = c.c_mktsegment
""")
def a16_histogram_by_label(spark, d):
    """Histogram per label."""
    return rounded(agg.histogram(t(spark, d, "customer"), "c_acctbal", 8, by="c_mktsegment"), 4,
                   ["bin_lo", "bin_hi"])


@register("a17_binned_mean", """
WITH e AS (SELECT list_transform(range(0, 21), lambda i: CASE WHEN i = 20 THEN hi ELSE i * ((hi - lo) / 20) + lo END) AS edges
           FROM (SELECT CAST(min(p_retailprice) AS DOUBLE) AS lo, CAST(max(p_retailprice) AS DOUBLE) AS hi FROM part)),
b AS (SELECT len(list_filter(edges, lambda x: x < p_retailprice)) - 1 AS bin, p_size, edges FROM part, e)
SELECT CAST(bin AS INTEGER) AS bin, ROUND((edges[bin + 1] + edges[bin + 2]) / 2, 6) AS center, ROUND(edges[bin + 2] - edges[bin + 1], 6) AS width,
       ROUND(avg(p_size), 6) AS mean_y, count(*) AS n
FROM b WHERE bin >= 0 GROUP BY bin, edges
""")
def a17_binned_mean(spark, d):
    """Mean of y per right-closed equal-width bin of x."""
    return rounded(agg.binned_mean(t(spark, d, "part"), "p_retailprice", "p_size", 20))


@register("a21_corr_matrix", """
SELECT 'l_discount' AS a, 'l_quantity' AS b, ROUND(corr(l_discount, l_quantity), 6) AS r FROM lineitem
UNION ALL SELECT 'l_discount', 'l_tax', ROUND(corr(l_discount, l_tax), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_tax', ROUND(corr(l_quantity, l_tax), 6) FROM lineitem
UNION ALL SELECT 'l_discount', 'l_extendedprice', ROUND(corr(l_discount, l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_extendedprice', ROUND(corr(l_quantity, l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_tax', 'l_extendedprice', ROUND(corr(l_tax, l_extendedprice), 6) FROM lineitem
""")
def a21_corr_matrix(spark, d):
    """Lower-triangle correlation matrix in one pass."""
    from quarry.operators import stats
    return rounded(stats.corr_matrix(t(spark, d, "lineitem"),
                                     ["l_discount", "l_quantity", "l_tax", "l_extendedprice"]))


@register("a22_corr_with_target", """
SELECT feature, r FROM (
  SELECT 'l_discount' AS feature, ROUND(corr(l_discount, l_extendedprice), 6) AS r FROM lineitem
  UNION ALL SELECT 'l_quantity', ROUND(corr(l_quantity, l_extendedprice), 6) FROM lineitem
  UNION ALL SELECT 'l_tax', ROUND(corr(l_tax, l_extendedprice), 6) FROM lineitem)
""")
def a22_corr_with_target(spark, d):
    """Correlation of each feature with a target, sorted by |r|."""
    from quarry.operators import stats
    return rounded(stats.corr_with(t(spark, d, "lineitem"), ["l_discount", "l_quantity", "l_tax"],
                                   "l_extendedprice"))


@register("a23_monthly_counts", """
WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1),
mm AS (SELECT min(month) lo, max(month) hi FROM c),
g AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM mm)
SELECT g.month, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.month = c.month, mm WHERE g.month < mm.hi
""")
def a23_monthly_counts(spark, d):
    """Monthly counts with gaps filled and the incomplete last month dropped."""
    return agg.monthly_counts(t(spark, d, "orders"), "o_orderdate")


@register("a29_minmax_profile", """
WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS c_acctbal_mean FROM customer GROUP BY 1)
SELECT c_mktsegment, ROUND(c_acctbal_mean, 6) AS c_acctbal_mean,
  ROUND((c_acctbal_mean - (SELECT min(c_acctbal_mean) FROM m)) /
        nullif((SELECT max(c_acctbal_mean) FROM m) - (SELECT min(c_acctbal_mean) FROM m), 0), 6) AS c_acctbal_scaled
FROM m
""")
def a29_minmax_profile(spark, d):
    """Group means min-max normalised across groups."""
    return rounded(agg.minmax_profile(t(spark, d, "customer"), "c_mktsegment", ["c_acctbal"]))


@register("a30_conditional_counts", """
SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS accepted,
       count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS rejected FROM orders
""")
def a30_conditional_counts(spark, d):
    """Accepted / rejected counts in one pass."""
    o = t(spark, d, "orders")
    return agg.conditional_counts(o, {"accepted": F.col("o_orderstatus") == "F",
                                      "rejected": F.col("o_orderstatus") != "F"})


@register("a20_nulls_by_class", f"""
SELECT target, count(*) - count(a) AS null_a, count(*) - count(b) AS null_b, count(*) - count(s) AS null_s
FROM ({_F7_BASE}) GROUP BY target
""")
def a20_nulls_by_class(spark, d):
    """Null totals split by class."""
    b = _f7_base(spark, d)
    return b.groupBy("target").agg(*[(F.count(F.lit(1)) - F.count(c)).alias(f"null_{c}") for c in ("a", "b", "s")])


# ------------------------------------------------------------------ ranking / ordering

@register("w02_cut", """
SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 'negative'
  WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN 'low' WHEN c_acctbal > 2500 AND c_acctbal <= 7500 THEN 'mid'
  WHEN c_acctbal > 7500 AND c_acctbal <= 10000 THEN 'high' END AS band FROM customer
""")
def w02_cut(spark, d):
    """Fixed-edge right-closed binning."""
    return rank.cut(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal",
                    [-1000, 0, 2500, 7500, 10000], ["negative", "low", "mid", "high"], out="band")


@register("w01_qcut", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= q[1] THEN 1 WHEN o_totalprice <= q[2] THEN 2
  WHEN o_totalprice <= q[3] THEN 3 WHEN o_totalprice <= q[4] THEN 4 ELSE 5 END AS price_q
FROM orders, e
""")
def w01_qcut(spark, d):
    """Quantile binning into 5 labelled bins with exact edges."""
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rank.qcut(o, "o_totalprice", 5, [1, 2, 3, 4, 5], out="price_q").drop("o_totalprice")


@register("w03_avg_rank", """
SELECT l_orderkey, l_linenumber, CAST(rank() OVER (ORDER BY l_quantity) AS DOUBLE)
  + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS l_quantity_rank FROM lineitem
""")
def w03_avg_rank(spark, d):
    """Average-tie rank without a global window."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rank.avg_rank(li, "l_quantity").drop("l_quantity")


@register("w03_avg_rank_by_group", """
SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS DOUBLE)
  + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS r FROM lineitem
""")
def w03_avg_rank_by_group(spark, d):
    """Average-tie rank within groups."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return rank.avg_rank(li, "l_extendedprice", by="l_returnflag", out="r").select("l_orderkey", "l_linenumber", "r")


@register("w04_one_per_category")
def w04_one_per_category(spark, d):
    """One seeded row per category (W4).  The oracle can't reproduce xxhash64, see tests."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "source")
    return rank.one_per_category(docs, "lang", "doc_id", seed=42)


@register("w05_top_k_entries", """
WITH v AS (SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value, 0 AS i FROM part
  UNION ALL SELECT p_partkey, 'price', p_retailprice / 40, 1 FROM part
  UNION ALL SELECT p_partkey, 'key', CAST(p_partkey % 50 AS DOUBLE), 2 FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY value DESC, i) AS pos FROM v)
SELECT p_partkey, CAST(pos AS INTEGER) AS pos, name, value FROM r WHERE pos <= 2
""")
def w05_top_k_entries(spark, d):
    """Top-k entries of a per-row vector by value, ties to the earlier entry."""
    p = t(spark, d, "part")
    arr = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 40,
                  F.pmod("p_partkey", F.lit(50)).cast("double"))
    top = fc.top_k_entries(arr, ["size", "price", "key"], 2)
    e = p.select("p_partkey", F.posexplode(top).alias("pos", "e"))
    return e.select("p_partkey", (F.col("pos") + 1).cast("int").alias("pos"),
                    F.col("e.name").alias("name"), F.col("e.value").alias("value"))


@register("t03_order_by_abs", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey
""")
def t03_order_by_abs(spark, d):
    """The whole table ordered by absolute value."""
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rank.order_by_abs(c, "c_acctbal", tie="c_custkey")


@register("t05_arg_best", """
SELECT arg_min(o_orderkey, o_totalprice) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders
""")
def t05_arg_best(spark, d):
    """Arg-min row (T5)."""
    return rank.arg_best(t(spark, d, "orders"), "o_totalprice", ["o_orderkey", "o_totalprice"])


@register("t01_order_by_keys", """
SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey
""")
def t01_order_by_keys(spark, d):
    """Multi-key ordering asc/desc."""
    o = t(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return o.orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey")


# ------------------------------------------------------------------ set / shape

@register("u01_union_by_name", """
SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderstatus FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'
""")
def u01_union_by_name(spark, d):
    """Concatenate row sets by name, missing columns NULL."""
    o = t(spark, d, "orders")
    a = o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    b = o.filter("o_orderstatus <> 'F'").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return shape.union_all([a, b])


@register("u02_side_by_side", """
SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN (SELECT c_custkey, n_name FROM customer JOIN nation
  ON c_nationkey = n_nationkey) n ON c.c_custkey = n.c_custkey
""")
def u02_side_by_side(spark, d):
    """Side-by-side concatenation by key, never by position."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    right = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")
    return shape.side_by_side(c.select("c_custkey", "c_name"), right, "c_custkey")


@register("u03_melt", """
SELECT c_custkey, variable, value FROM (
  SELECT c_custkey, 'c_acctbal' AS variable, c_acctbal AS value FROM customer
  UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)
""")
def u03_melt(spark, d):
    """Wide -> long."""
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double"))
    return shape.melt(c, ["c_custkey"], ["c_acctbal", "c_nationkey"])


# ------------------------------------------------------------------ scalar / text functions

@register("x01_list_codes", """
WITH b AS (SELECT p_partkey, concat_ws(',', 'en:e' || p_size || ' - ' || p_name, ' en:b' || p_partkey % 9 || ' - ' || p_type) AS additives
           FROM part)
SELECT p_partkey, pos, code FROM (
  SELECT p_partkey, generate_subscripts(list_transform(string_split(additives, ','), lambda x: trim(string_split(x, ' - ')[1])), 1) AS pos,
         unnest(list_transform(string_split(additives, ','), lambda x: trim(string_split(x, ' - ')[1]))) AS code FROM b)
""")
def x01_list_codes(spark, d):
    """Split a list text and keep the trimmed code before ' - ' (X1)."""
    p = t(spark, d, "part")
    add = F.concat_ws(",", F.concat(F.lit("en:e"), F.col("p_size").cast("string"), F.lit(" - "), F.col("p_name")),
                      F.concat(F.lit(" en:b"), F.pmod("p_partkey", F.lit(9)).cast("string"), F.lit(" - "), F.col("p_type")))
    e = p.select("p_partkey", F.posexplode(fc.list_codes(add)).alias("pos", "code"))
    return e.select("p_partkey", (F.col("pos") + 1).cast("bigint").alias("pos"), "code")


@register("x02_first_tree_level", """
SELECT p_partkey, nullif(regexp_extract(tree, '\\["\\s*([^>]+?)\\s*>>', 1), '') AS main_category FROM (
  SELECT p_partkey, '["' || p_type || ' >> ' || p_brand || ' >> ' || p_name || '"]' AS tree FROM part)
""")
def x02_first_tree_level(spark, d):
    """First category of a tree string via look-around regex."""
    p = t(spark, d, "part")
    tree = F.concat(F.lit('["'), F.col("p_type"), F.lit(" >> "), F.col("p_brand"), F.lit(" >> "), F.col("p_name"), F.lit('"]'))
    return p.select("p_partkey", fc.first_tree_level(tree).alias("main_category"))


@register("x03_url_words", """
SELECT page_id, regexp_replace(replace(url, 'https://', ''), '(\\W|_)+', ' ', 'g') AS words FROM pages
""")
def x03_url_words(spark, d):
    """URL -> words."""
    return t(spark, d, "pages").select("page_id", fc.url_words("url", "https://").alias("words"))


@register("x04_x05_concat_truncate", """
SELECT conv_id, turn, left(concat_ws('. ', coalesce(role, ''), coalesce(text, '')), 200) AS snippet FROM conversations
""")
def x04_x05_concat_truncate(spark, d):
    """Concatenate text fields null-safe (X4) and truncate."""
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", fc.truncate(fc.concat_text(["role", "text"]), 200).alias("snippet"))


@register("x08_x09_impact_labels", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'increases risk' ELSE 'decreases risk' END AS impact,
  array_to_string(list_transform(string_split(replace(regexp_replace('shap_' || lower(c_mktsegment) || '_score', '^shap_', ''),
    '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label
FROM customer
""")
def x08_x09_impact_labels(spark, d):
    """Signed impact label (X8) and display name from a prefixed feature."""
    c = t(spark, d, "customer")
    name = F.concat(F.lit("shap_"), F.lower("c_mktsegment"), F.lit("_score"))
    return c.select("c_custkey", fc.impact_label("c_acctbal").alias("impact"), fc.display_name(name).alias("label"))


@register("x11_vector_norms", """
SELECT vec_id, ROUND(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm
FROM embeddings
""")
def x11_vector_norms(spark, d):
    """L2 norm of a vector column (X11)."""
    return t(spark, d, "embeddings").select("vec_id", rnd(fc.l2_norm(F.col("embedding").cast("array<double>"))).alias("norm"))


@register("x11_mean_pool", """
WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings)
SELECT label, CAST(i - 1 AS INTEGER) AS pos, ROUND(avg(CAST(v AS DOUBLE)), 6) AS mean_value FROM e GROUP BY label, i
""")
def x11_mean_pool(spark, d):
    """Mean-pool of vectors per group, long form (X11)."""
    e = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", F.col("pos").cast("int").alias("pos")).agg(rnd(F.avg(F.col("v").cast("double"))).alias("mean_value"))


@register("e07_l2_normalize", """
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v,
  sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, ROUND(CASE WHEN n > 0 THEN v / n ELSE 0 END, 6) AS value FROM e
""")
def e07_l2_normalize(spark, d):
    """L2 row normalisation."""
    e = t(spark, d, "embeddings").select("vec_id", fc.l2_normalize(F.col("embedding").cast("array<double>")).alias("n"))
    e = e.select("vec_id", F.posexplode("n").alias("pos", "value"))
    return e.select("vec_id", F.col("pos").cast("int").alias("pos"), rnd("value").alias("value"))


@register("a12_crosstab_wide", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
       count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority
""")
def a12_crosstab_wide(spark, d):
    """Order priority against status, one column per status."""
    return agg.crosstab_wide(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
