"""Segmentation, clustering, text, scoring, streaming and source round trips on the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import columns as fc
from quarry.operators import cluster, sample, score, textclf
from quarry.plans.registry import register, rnd, rounded, t
from quarry.sources import io
from quarry.session import cut_lineage, spread
from quarry.streaming import stream

# ------------------------------------------------------------------ RFM (flagship)

F_EDGES = [0, 5, 8, 11, 14, float("inf")]  # the last class is open: the busiest customers belong to it


def rfm_table(spark, d):
    return cluster.rfm(t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", F_EDGES)


RFM_SQL = """
WITH today AS (SELECT max(o_orderdate) + INTERVAL 1 DAY AS t FROM orders),
g AS (SELECT o_custkey, max(o_orderdate) AS last_order_date, count(*) AS Frequency, sum(o_totalprice) AS Monetary
      FROM orders GROUP BY 1),
g2 AS (SELECT g.*, CAST(floor((epoch_us(t) - epoch_us(last_order_date)) / 86400e6) AS BIGINT) AS Recency FROM g, today),
e AS (SELECT quantile_cont(Recency, [0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS qr,
             quantile_cont(Monetary, [0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS qm FROM g2),
s AS (SELECT g2.*,
  CASE WHEN Frequency > 0 AND Frequency <= 5 THEN 1 WHEN Frequency > 5 AND Frequency <= 8 THEN 2
       WHEN Frequency > 8 AND Frequency <= 11 THEN 3 WHEN Frequency > 11 AND Frequency <= 14 THEN 4
       WHEN Frequency > 14 THEN 5 END AS F_score,
  CASE WHEN Recency <= qr[1] THEN 5 WHEN Recency <= qr[2] THEN 4 WHEN Recency <= qr[3] THEN 3
       WHEN Recency <= qr[4] THEN 2 ELSE 1 END AS R_score,
  CASE WHEN Monetary <= qm[1] THEN 1 WHEN Monetary <= qm[2] THEN 2 WHEN Monetary <= qm[3] THEN 3
       WHEN Monetary <= qm[4] THEN 4 ELSE 5 END AS M_score FROM g2, e)
SELECT o_custkey, last_order_date, Frequency, ROUND(Monetary, 2) AS Monetary, Recency, F_score, R_score, M_score,
  R_score + F_score + M_score AS RFM_Score,
  CASE WHEN R_score + F_score + M_score >= 11 THEN 'Très bons clients'
       WHEN R_score + F_score + M_score >= 9 THEN 'Bons clients'
       WHEN R_score + F_score + M_score = 8 THEN 'Clients tièdes'
       WHEN R_score + F_score + M_score = 7 THEN 'Nouveaux clients'
       WHEN R_score + F_score + M_score BETWEEN 4 AND 6 THEN 'À risque' ELSE 'Inactifs' END AS Segment
FROM s
"""


@register("c01_rfm_segments", RFM_SQL)
def c01_rfm_segments(spark, d):
    """RFM scores, total and segment per customer (C1, C2, W1, W2, F28) - the flagship."""
    r = rfm_table(spark, d)
    return r.select("o_custkey", "last_order_date", "Frequency", rnd("Monetary", 2).alias("Monetary"), "Recency",
                    "F_score", "R_score", "M_score", "RFM_Score", "Segment")


@register("c02_segment_counts", f"""
SELECT Segment, count(*) AS n, ROUND(avg(Monetary), 2) AS mean_monetary FROM ({RFM_SQL}) GROUP BY 1
""")
def c02_segment_counts(spark, d):
    """Customers and mean spend per segment."""
    r = c01_rfm_segments(spark, d)
    return r.groupBy("Segment").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("Monetary"), 2).alias("mean_monetary"))


# ------------------------------------------------------------------ clustering

def label_centroids(spark, d):
    """Per-label mean embeddings: k x d numbers, the 'given' centroids of the bindings."""
    e = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    rows = e.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    cents: dict = {}
    for r in rows:
        cents.setdefault(r["label"], {})[r["p"]] = r["m"]
    labels = sorted(cents)
    return labels, [[cents[lb][i] for i in range(len(cents[lb]))] for lb in labels]


_CENT_SQL = """
WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
cent AS (SELECT label AS c, i, avg(v) AS m FROM x GROUP BY label, i),
cidx AS (SELECT c, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS ci FROM (SELECT DISTINCT c FROM cent)),
dist AS (SELECT x.vec_id, cidx.ci, sum((x.v - cent.m) * (x.v - cent.m)) AS d
         FROM x JOIN cent ON x.i = cent.i JOIN cidx ON cent.c = cidx.c GROUP BY x.vec_id, cidx.ci)
"""


@register("c03_assign_given_centroids", _CENT_SQL + """
SELECT vec_id, CAST(arg_min(ci, struct_pack(d := d, ci := ci)) AS INTEGER) AS cluster FROM dist GROUP BY vec_id
""")
def c03_assign_given_centroids(spark, d):
    """k-means predict against given centroids (C3); centroids = per-label means."""
    _, cents = label_centroids(spark, d)
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    return cluster.assign_clusters(e, "embedding", cents).select("vec_id", F.col("cluster").cast("int"))


@register("c03_kmeans_fit")
def c03_kmeans_fit(spark, d):
    """k-means fit and predict, seeded."""
    e = t(spark, d, "embeddings")
    m = cluster.kmeans_fit(e, "embedding", 10, seed=42)
    cents = [list(map(float, c)) for c in m.clusterCenters()]
    return cluster.assign_clusters(e.select("vec_id", "embedding"), "embedding", cents).select("vec_id", "cluster")


@register("c04_elbow")
def c04_elbow(spark, d):
    """Inertia over k = 2..6 (C4)."""
    return cluster.elbow(t(spark, d, "embeddings"), "embedding", [2, 3, 4, 5, 6])


@register("c05_silhouette", """
WITH e AS (SELECT vec_id, label AS c, embedding AS v,
                  list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))) AS n2 FROM embeddings),
st AS (SELECT c, count(*) AS n, avg(n2) AS m2 FROM e GROUP BY c),
x AS (SELECT vec_id, c, generate_subscripts(v, 1) AS i, CAST(unnest(v) AS DOUBLE) AS xv FROM e),
mu AS (SELECT c, i, avg(xv) AS m FROM x GROUP BY c, i),
dots AS (SELECT x.vec_id, mu.c AS cc, sum(x.xv * mu.m) AS dot FROM x JOIN mu ON x.i = mu.i GROUP BY x.vec_id, mu.c),
md AS (SELECT e.vec_id, e.c, st.c AS cc, st.n AS ncc, e.n2 - 2 * dots.dot + st.m2 AS d
       FROM e JOIN dots ON e.vec_id = dots.vec_id JOIN st ON st.c = dots.cc),
ab AS (SELECT vec_id, max(CASE WHEN cc = c THEN d * ncc / greatest(ncc - 1, 1) END) AS a,
              min(CASE WHEN cc <> c THEN d END) AS b, max(CASE WHEN cc = c THEN ncc END) AS nown FROM md GROUP BY vec_id)
SELECT ROUND(avg(CASE WHEN nown <= 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette,
       count(*) AS n FROM ab
""")
def c05_silhouette(spark, d):
    """Mean silhouette (squared Euclidean), exact in O(n k)."""
    return rounded(cluster.silhouette_sq(t(spark, d, "embeddings"), "embedding", "label"))


_C05_SAMPLE_SQL = """
WITH s AS (SELECT vec_id, label AS c, embedding::DOUBLE[] AS v FROM embeddings WHERE md5(CAST(vec_id AS VARCHAR)) < '2'),
d AS (SELECT x.vec_id, x.c, y.c AS other, sum(list_distance(x.v, y.v)) AS total FROM s x, s y GROUP BY ALL),
m AS (SELECT c AS other, count(*) AS m FROM s GROUP BY c),
ab AS (SELECT vec_id, max(CASE WHEN c = d.other AND m > 1 THEN total / (m - 1) END) AS a, min(CASE WHEN c <> d.other THEN total / m END) AS b
       FROM d JOIN m ON m.other = d.other GROUP BY vec_id)
SELECT ROUND(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette, count(*) AS n FROM ab
"""


@register("c05_silhouette_sample", _C05_SAMPLE_SQL)
def c05_silhouette_sample(spark, d):
    """Mean Euclidean silhouette over a sample picked by a hash of the key, an eighth of the rows."""
    picked = F.md5(F.col("vec_id").cast("string").cast("binary")) < "2"
    return rounded(cluster.silhouette_sample(t(spark, d, "embeddings"), "embedding", "label", picked))


@register("c06_bisecting")
def c06_bisecting(spark, d):
    """Divisive hierarchical clustering into 6 groups."""
    e = t(spark, d, "embeddings")
    m = cluster.bisecting_fit(e, "embedding", 6)
    cents = [list(map(float, c)) for c in m.clusterCenters()]
    return cluster.assign_clusters(e.select("vec_id", "embedding"), "embedding", cents)


@register("c07_cluster_profile", """
WITH s AS (SELECT avg(c_acctbal) m1, stddev_pop(c_acctbal) s1, avg(c_nationkey) m2, stddev_pop(c_nationkey) s2 FROM customer),
z AS (SELECT c_mktsegment, (c_acctbal - m1) / s1 AS c_acctbal, (c_nationkey - m2) / s2 AS c_nationkey FROM customer, s),
g AS (SELECT c_mktsegment, count(*) AS size, avg(c_acctbal) AS a, avg(c_nationkey) AS b FROM z GROUP BY 1)
SELECT c_mktsegment, size, 'c_acctbal' AS feature, ROUND(a, 6) AS scaled_mean FROM g
UNION ALL SELECT c_mktsegment, size, 'c_nationkey', ROUND(b, 6) FROM g
""")
def c07_cluster_profile(spark, d):
    """Cluster sizes and standardised means, melted."""
    c = t(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return rounded(cluster.cluster_profile(c, "c_mktsegment", ["c_acctbal", "c_nationkey"]))


@register("c08_adjusted_rand", """
WITH c AS (SELECT c_mktsegment a, c_nationkey % 5 b, count(*) nij FROM customer GROUP BY 1, 2),
s AS (SELECT sum(nij * (nij - 1) / 2.0) sij, sum(nij) n FROM c),
sa AS (SELECT sum(ai * (ai - 1) / 2.0) sa FROM (SELECT sum(nij) ai FROM c GROUP BY a)),
sb AS (SELECT sum(bj * (bj - 1) / 2.0) sb FROM (SELECT sum(nij) bj FROM c GROUP BY b))
SELECT ROUND((sij - sa * sb / (n * (n - 1) / 2.0)) / (0.5 * (sa + sb) - sa * sb / (n * (n - 1) / 2.0)), 6) AS ari,
       CAST(n AS BIGINT) AS n FROM s, sa, sb
""")
def c08_adjusted_rand(spark, d):
    """Adjusted Rand index of two labelings."""
    c = t(spark, d, "customer").withColumn("b", F.pmod("c_nationkey", F.lit(5)))
    return rounded(cluster.adjusted_rand(c, "c_mktsegment", "b").withColumn("n", F.col("n").cast("bigint")))


def order_facts(spark, d):
    """One row per order: customer, date, total, mean quantity (score) and delay in days.

    Orders without items have no score or delay and are dropped, as the
    reference drops incomplete rows before segmenting.
    """
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.avg("l_quantity").alias("review_score"),
                                       F.max("l_shipdate").alias("delivered"))
    j = o.join(per, o.o_orderkey == per.l_orderkey, "inner")
    return j.select("o_custkey", "o_orderdate", "o_totalprice", "review_score",
                    fc.frac_days("delivered", "o_orderdate").alias("delay_days"))


STABILITY_START, STABILITY_BASE, STABILITY_STEP, STABILITY_K = "1995-01-01", 365, 30, 6

C09_SQL = f"""
WITH per AS (SELECT l_orderkey, avg(l_quantity) AS review_score, max(l_shipdate) AS delivered FROM lineitem GROUP BY 1),
facts AS (SELECT o_custkey, o_orderdate, o_totalprice, review_score,
                 (epoch_us(delivered) - epoch_us(o_orderdate)) / 86400e6 AS delay_days
          FROM orders JOIN per ON o_orderkey = l_orderkey),
d AS (SELECT *, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '{STABILITY_START}')) / 86400e6 AS age
      FROM facts WHERE o_orderdate >= TIMESTAMP '{STABILITY_START}'),
span AS (SELECT max(o_orderdate) AS mx, floor((max(age) - {STABILITY_BASE}) / {STABILITY_STEP}) AS steps FROM d),
part AS (SELECT o_custkey, CAST(greatest(0, ceil((age - {STABILITY_BASE}) / {STABILITY_STEP})) AS INTEGER) AS step,
                sum(review_score) AS s_r, count(review_score) AS n_r, sum(o_totalprice) AS s_t, count(o_totalprice) AS n_t,
                sum(delay_days) AS s_d, count(delay_days) AS n_d, max(o_orderdate) AS last
         FROM d GROUP BY 1, 2),
base_clients AS (SELECT o_custkey FROM part WHERE step = 0),
grid AS (SELECT b.o_custkey, CAST(s.range AS INTEGER) AS step FROM base_clients b, span, range(CAST(span.steps AS BIGINT) + 1) s),
g0 AS (SELECT g.o_custkey, g.step,
         sum(s_r) OVER w AS s_r, sum(n_r) OVER w AS n_r, sum(s_t) OVER w AS s_t, sum(n_t) OVER w AS n_t,
         sum(s_d) OVER w AS s_d, sum(n_d) OVER w AS n_d, max(last) OVER w AS last
       FROM grid g LEFT JOIN part p ON g.o_custkey = p.o_custkey AND g.step = p.step
       WINDOW w AS (PARTITION BY g.o_custkey ORDER BY g.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g1 AS (SELECT o_custkey, step, TIMESTAMP '{STABILITY_START}' + to_days(CAST({STABILITY_BASE} + {STABILITY_STEP} * step AS INTEGER)) AS end_date,
         s_r / n_r AS review_score_mean, CASE WHEN n_t > 0 THEN s_t END AS order_total_sum, s_d / n_d AS delay_days_mean, last
       FROM g0),
g AS (SELECT g1.*, CAST(floor((epoch_us(end_date) - epoch_us(last)) / 86400e6) AS DOUBLE) AS recency FROM g1, span
      WHERE end_date <= span.mx),
base AS (SELECT * FROM g WHERE step = 0),
sc AS (SELECT avg(review_score_mean) m1, coalesce(nullif(stddev_pop(review_score_mean), 0), 1) s1,
              avg(order_total_sum) m2, coalesce(nullif(stddev_pop(order_total_sum), 0), 1) s2,
              avg(delay_days_mean) m3, coalesce(nullif(stddev_pop(delay_days_mean), 0), 1) s3,
              avg(recency) m4, coalesce(nullif(stddev_pop(recency), 0), 1) s4 FROM base),
z AS (SELECT o_custkey, step, end_date, (review_score_mean - m1) / s1 AS z1, (order_total_sum - m2) / s2 AS z2,
             (delay_days_mean - m3) / s3 AS z3, (recency - m4) / s4 AS z4 FROM g, sc),
cent AS (SELECT CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS ci, z1, z2, z3, z4 FROM z
         WHERE step = 0 ORDER BY o_custkey LIMIT {STABILITY_K}),
lab AS (SELECT z.o_custkey, z.step, z.end_date,
          arg_min(cent.ci, struct_pack(d := (z.z1 - cent.z1) * (z.z1 - cent.z1) + (z.z2 - cent.z2) * (z.z2 - cent.z2)
                                         + (z.z3 - cent.z3) * (z.z3 - cent.z3) + (z.z4 - cent.z4) * (z.z4 - cent.z4),
                                         ci := cent.ci)) AS cluster
        FROM z, cent GROUP BY z.o_custkey, z.step, z.end_date),
pairs AS (SELECT l.step, l.end_date, b.cluster AS a, l.cluster AS b FROM lab l JOIN lab b ON l.o_custkey = b.o_custkey
          AND b.step = 0 WHERE l.step > 0),
cells AS (SELECT step, end_date, a, b, count(*) AS m FROM pairs GROUP BY ALL),
sums AS (SELECT step, end_date, sum(m * (m - 1) / 2.0) AS sij, sum(m) AS n FROM cells GROUP BY ALL),
sa AS (SELECT step, sum(x * (x - 1) / 2.0) AS sa FROM (SELECT step, a, sum(m) AS x FROM cells GROUP BY ALL) GROUP BY step),
sb AS (SELECT step, sum(x * (x - 1) / 2.0) AS sb FROM (SELECT step, b, sum(m) AS x FROM cells GROUP BY ALL) GROUP BY step)
SELECT CAST(sums.step AS INTEGER) AS step, sums.end_date,
       ROUND(coalesce((sij - sa * sb / (n * (n - 1) / 2.0)) / nullif(0.5 * (sa + sb) - sa * sb / (n * (n - 1) / 2.0), 0), 1.0), 6) AS ari,
       CAST(n AS BIGINT) AS n
FROM sums JOIN sa ON sums.step = sa.step JOIN sb ON sums.step = sb.step
"""


def _stability(spark, d, step, fitted):
    """Stability of a segmentation whose scaler, and centroids if ``fitted``, come from the base window."""
    from quarry.operators import model
    from quarry.session import cut_lineage
    facts = cut_lineage(order_facts(spark, d))  # read by the scaler fit and the stability plan
    feats = {"review_score_mean": (F.col("review_score"), "mean"), "order_total_sum": (F.col("o_totalprice"), "sum"),
             "delay_days_mean": (F.col("delay_days"), "mean")}
    start, base_days = STABILITY_START, STABILITY_BASE
    stt = F.lit(start).cast("timestamp_ntz")
    base = facts.filter((F.col("o_orderdate") >= stt) & (fc.frac_days("o_orderdate", stt) <= base_days))
    end = stt + F.expr(f"INTERVAL {base_days} DAYS")
    g = base.groupBy("o_custkey").agg(F.avg("review_score").alias("review_score_mean"),
                                      F.sum("o_totalprice").alias("order_total_sum"),
                                      F.avg("delay_days").alias("delay_days_mean"),
                                      F.max("o_orderdate").alias("last"))
    g = g.withColumn("recency", F.floor(fc.frac_days(end, "last")).cast("double"))
    names = ["review_score_mean", "order_total_sum", "delay_days_mean", "recency"]
    st = g.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    scaler = {n: (st[f"m_{n}"], st[f"s_{n}"]) for n in names}
    scaled = g.select("o_custkey", *[((F.col(n) - F.lit(scaler[n][0])) / F.lit(scaler[n][1] or 1.0)).alias(n) for n in names])
    if fitted:
        from pyspark.ml.clustering import KMeans
        fit = KMeans(k=STABILITY_K, seed=42, featuresCol="z").fit(model.assemble(scaled.dropna(), names, "z"))
        cents = [[float(x) for x in c] for c in fit.clusterCenters()]  # k rows
    else:
        cents = [[r[n] for n in names] for r in scaled.orderBy("o_custkey").limit(STABILITY_K).collect()]  # k rows
    out = cluster.cluster_stability(facts, "o_custkey", "o_orderdate", feats, start, base_days, step, scaler, cents)
    return rounded(out.withColumn("step", F.col("step").cast("int")).withColumn("n", F.col("n").cast("bigint")),
                   6, ["ari"])


@register("c09_cluster_stability", C09_SQL)
def c09_cluster_stability(spark, d):
    """ARI of the base segmentation against expanding windows, +30 days per step, with given centroids.

    The given centroids, which a SQL twin can follow, are the scaled features
    of the first six base customers by key.
    """
    return _stability(spark, d, STABILITY_STEP, fitted=False)


@register("c09_stability_kmeans_30")
def c09_stability_kmeans_30(spark, d):
    """The same with a k-means fitted on the base window and frozen, +30 days per step."""
    return _stability(spark, d, 30, fitted=True)


@register("c09_stability_kmeans_7")
def c09_stability_kmeans_7(spark, d):
    """The same, +7 days per step."""
    return _stability(spark, d, 7, fitted=True)


_DESC_SQL = """
WITH x AS (SELECT vec_id, CAST(c AS INTEGER) AS chunk,
                  list_transform(list_slice(embedding, c * 8 + 1, c * 8 + 8), lambda z: CAST(z AS DOUBLE)) AS v
           FROM embeddings, range(8) r(c)),
xi AS (SELECT vec_id, chunk, generate_subscripts(v, 1) AS i, unnest(v) AS xv FROM x),
cw AS (SELECT chunk AS w, i, avg(xv) AS m FROM xi GROUP BY chunk, i),
dist AS (SELECT xi.vec_id, xi.chunk, cw.w, sum((xi.xv - cw.m) * (xi.xv - cw.m)) AS d FROM xi JOIN cw ON xi.i = cw.i
         GROUP BY xi.vec_id, xi.chunk, cw.w),
asg AS (SELECT vec_id, chunk, arg_min(w, struct_pack(d := d, w := w)) AS word FROM dist GROUP BY vec_id, chunk)
"""


@register("c10_bag_of_words", _DESC_SQL + """
SELECT vec_id, CAST(word AS INTEGER) AS word, ROUND(count(*) / 8.0, 6) AS share FROM asg GROUP BY vec_id, word
""")
def c10_bag_of_words(spark, d):
    """Nearest codeword per descriptor and normalised histogram per item.

    Descriptors: eight 8-wide slices of each embedding; codewords: the mean
    slice per slice position.
    """
    e = t(spark, d, "embeddings")
    desc = e.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)),
                                                       lambda c: F.slice("embedding", c * 8 + 1, 8))).alias("chunk", "v"))
    desc = desc.withColumn("v", F.col("v").cast("array<double>"))
    rows = desc.select("chunk", F.posexplode("v").alias("i", "x")).groupBy("chunk", "i").agg(
        F.avg("x").alias("m")).collect()  # 8 x 8 numbers
    cw: dict = {}
    for r in rows:
        cw.setdefault(r["chunk"], {})[r["i"]] = r["m"]
    cents = [[cw[c][i] for i in range(8)] for c in sorted(cw)]
    h = cluster.bag_of_words_hist(desc, "vec_id", "v", cents)
    return rounded(h.select("vec_id", F.col("word").cast("int"), "share"))


# ------------------------------------------------------------------ text

ASCII_SQL = "regexp_replace(text, '[^a-zA-Z0-9_ ]', ' ', 'g')"


def lang_docs(spark, d):
    """Whole documents with their language label (classifier input)."""
    return t(spark, d, "documents").select("doc_id", "lang", "text")


_TERMS_SQL = f"""
WITH dt AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) AS term FROM documents),
tf AS (SELECT doc, term, count(*) AS tf FROM dt GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
"""


@register("q01_term_features", _TERMS_SQL + """
SELECT tf.doc, tf.term, CAST(1 AS BIGINT) AS value FROM tf JOIN df ON tf.term = df.term
WHERE df.df <= (SELECT count(*) FROM documents) * 0.95
""")
def q01_term_features(spark, d):
    """Binary term features over whole texts, terms in more than 95 % of documents dropped."""
    return textclf.term_features(t(spark, d, "documents"), "doc_id", "text", "binary", 0.95)


@register("q02_tfidf", _TERMS_SQL + """,
w AS (SELECT tf.doc, tf.term, tf.tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df.df)) + 1) AS w
      FROM tf JOIN df ON tf.term = df.term),
nrm AS (SELECT doc, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc)
SELECT w.doc, w.term, ROUND(w.w / nrm.nrm, 6) AS weight FROM w JOIN nrm ON w.doc = nrm.doc
""")
def q02_tfidf(spark, d):
    """TF-IDF with smoothed idf and L2 rows over whole texts (Q2)."""
    return rounded(textclf.tfidf(t(spark, d, "documents"), "doc_id", "text"))


LANGS = ["de", "en", "es", "fr"]


@register("q03_top_k_classes")
def q03_top_k_classes(spark, d):
    """Logistic regression on terms, top-3 languages per document (M8, Q3)."""
    docs = lang_docs(spark, d)
    split = sample.random_split(docs, "doc_id", [0.75, 0.25])  # seeded hash split
    train, test = split.filter("split = 0").drop("split"), split.filter("split = 1").drop("split")
    m = textclf.text_classifier(train, "text", "lang", max_iter=20)
    labels = m.stages[0].labels
    pred = m.transform(test)
    return textclf.top_k_classes(pred, labels, 3).select("doc_id", "lang", "top_k")


VALID_ROLES = ["USER", "ASSISTANT", "SYSTEM"]
EXAMPLE_CHARS = 200  # few-shot example length of the reference


def responses(spark, d):
    """Model-response strings built from conversations with a planted label array."""
    c = t(spark, d, "conversations")
    planted = F.concat(F.lit('Answer: ["'), F.lower("role"), F.lit('", "other"] '), F.col("text"))
    mention = F.concat(F.lit("I think it is "), F.upper("role"), F.lit(". "), F.col("text"))
    resp = (F.when(F.pmod("turn", F.lit(3)) == 0, planted).when(F.pmod("turn", F.lit(3)) == 1, mention)
            .otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.upper("role").alias("truth"), resp.alias("response"))


_RESP_SQL = """
WITH c AS (SELECT conv_id, turn, upper(role) AS truth,
  CASE WHEN turn % 3 = 0 THEN 'Answer: ["' || lower(role) || '", "other"] ' || text
       WHEN turn % 3 = 1 THEN 'I think it is ' || upper(role) || '. ' || text ELSE text END AS response FROM conversations),
b AS (SELECT *, regexp_extract(response, '(?s)\\[.*?\\]', 0) AS block FROM c),
j AS (SELECT *, CASE WHEN block <> '' AND json_valid(block) THEN from_json(block, '["VARCHAR"]') END AS arr FROM b),
k AS (SELECT *, list_filter(list_transform(arr, lambda x: upper(trim(x))), lambda x: list_contains(['USER', 'ASSISTANT', 'SYSTEM'], x)) AS cleaned,
             list_filter(['USER', 'ASSISTANT', 'SYSTEM'], lambda x: strpos(upper(trim(response)), x) > 0) AS found FROM j),
p AS (SELECT conv_id, turn, truth, CASE WHEN len(cleaned) > 0 THEN cleaned[1:3] WHEN len(found) > 0 THEN found[1:3]
             ELSE []::VARCHAR[] END AS preds FROM k)
"""


def parsed(spark, d):
    r = responses(spark, d)
    return r.select("conv_id", "turn", "truth", fc.parse_labels(F.col("response"), VALID_ROLES, 3).alias("preds"))


@register("x06_parse_labels", _RESP_SQL + """
SELECT conv_id, turn, truth, CAST(generate_subscripts(preds, 1) AS INTEGER) AS pos, unnest(preds) AS label FROM p
""")
def x06_parse_labels(spark, d):
    """Ranked labels from free text: JSON array first, mentions second, else empty."""
    p = parsed(spark, d).select("conv_id", "turn", "truth", F.posexplode("preds").alias("pos", "label"))
    return p.select("conv_id", "turn", "truth", (F.col("pos") + 1).cast("int").alias("pos"), "label")


@register("x07_reciprocal_rank", _RESP_SQL + """
SELECT conv_id, turn, CASE WHEN list_position(preds, truth) > 0 THEN 1.0 / list_position(preds, truth) ELSE 0.0 END AS rr FROM p
""")
def x07_reciprocal_rank(spark, d):
    """Reciprocal rank of the true label."""
    return parsed(spark, d).select("conv_id", "turn", fc.reciprocal_rank("truth", "preds").alias("rr"))


@register("q04_rank_metrics", _RESP_SQL + """
SELECT ROUND(avg(CASE WHEN list_position(preds[1:3], truth) > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k,
       ROUND(avg(CASE WHEN preds[1] = truth THEN 1.0 ELSE 0.0 END), 6) AS top1,
       ROUND(avg(CASE WHEN list_position(preds[1:3], truth) > 0 THEN 1.0 / list_position(preds[1:3], truth) ELSE 0.0 END), 6) AS mrr_at_k,
       ROUND(avg(CASE WHEN len(preds) = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_rate, count(*) AS n FROM p
""")
def q04_rank_metrics(spark, d):
    """Hit@3, top-1, MRR@3, empty rate (Q4)."""
    return rounded(textclf.rank_metrics(parsed(spark, d), "truth", "preds", 3))


@register("q05_accuracy_per_category", _RESP_SQL + """
SELECT truth AS category, ROUND(avg(CASE WHEN list_contains(preds[1:3], truth) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n FROM p GROUP BY truth
""")
def q05_accuracy_per_category(spark, d):
    """Accuracy per true category (Q5)."""
    return rounded(textclf.accuracy_per_category(parsed(spark, d), "truth", "preds", 3))


@register("q05_errors", _RESP_SQL + """
SELECT conv_id, turn, truth, len(preds) AS n_preds FROM p WHERE NOT list_contains(preds[1:3], truth)
""")
def q05_errors(spark, d):
    """Rows whose true label is not among the first three predictions (Q5)."""
    return textclf.errors(parsed(spark, d), "truth", "preds", 3).select("conv_id", "turn", "truth", F.size("preds").cast("bigint").alias("n_preds"))


def _sql_lit(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


def _zero_shot_sql() -> str:
    head, tail = textclf.ZERO_SHOT_TEMPLATE.split("{text}")
    cats = ", ".join(VALID_ROLES)
    head = head.replace("{cats}", cats).replace("{k}", "3")
    tail = tail.replace("{k}", "3")
    return f"SELECT conv_id, turn, {_sql_lit(head)} || coalesce(text, '') || {_sql_lit(tail)} AS prompt FROM conversations"


@register("q06_zero_shot_prompt", _zero_shot_sql())
def q06_zero_shot_prompt(spark, d):
    """Zero-shot prompt per whole text (Q6)."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "text")
    return textclf.build_prompt(c, "text", VALID_ROLES, 3).select("conv_id", "turn", "prompt")


@register("q06_few_shot_prompt")
def q06_few_shot_prompt(spark, d):
    """Few-shot prompt: one seeded example per category, example texts cut to 200 characters
    as the reference does; the text to label is whole (Q6, W4, X5)."""
    from quarry.operators.rank import one_per_category
    c = t(spark, d, "conversations").select("conv_id", "turn", F.upper("role").alias("category"), "text")
    ex = one_per_category(c, "category", ["conv_id", "turn"]).withColumn("text", fc.truncate("text", EXAMPLE_CHARS))
    block = textclf.examples_block(ex, "text", "category")
    return textclf.build_prompt(c, "text", VALID_ROLES, 3, examples=block).select("conv_id", "turn", "prompt")


def _stub_model(text: str) -> str:
    """Deterministic stand-in for an external model: echoes the role as a label array."""
    if text == "system":
        raise RuntimeError("service error")
    return f'["{text.upper()}", "OTHER"]'


@register("q07_call_model", """
SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN '' ELSE '["' || upper(role) || '", "OTHER"]' END AS response
FROM conversations
""")
def q07_call_model(spark, d):
    """External model called per row in Arrow batches; failures give '' (Q7)."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    return textclf.call_model(c, "role", _stub_model)


@register("q08_comparison_grid")
def q08_comparison_grid(spark, d):
    """Text field x representation x k comparison grid into a runs table.

    The fields are the first line, the rest, and both.
    """
    docs = lang_docs(spark, d)
    docs = docs.withColumn("head", F.substring_index("text", "\n", 1)).withColumn("rest", F.expr("substr(text, length(head) + 2)"))
    split = sample.random_split(docs, "doc_id", [0.75, 0.25])  # seeded hash split
    train, test = split.filter("split = 0").drop("split"), split.filter("split = 1").drop("split")
    rows = []
    for field in ("head", "rest", "text"):
        for kind, m in textclf.text_classifiers(train, field, "lang", ["binary", "count", "tfidf"], max_iter=10):
            pred = cut_lineage(textclf.top_k_classes(m.transform(test), m.stages[0].labels, 3).select("lang", "top_k"))
            for k in (1, 3):
                r = textclf.rank_metrics(pred, "lang", "top_k", k).first()
                rows.append((field, kind, k, float(r["hit_at_k"]), float(r["mrr_at_k"])))
    return spark.createDataFrame(rows, "field string, representation string, k int, hit_at_k double, mrr_at_k double")


# ------------------------------------------------------------------ scoring

WEIGHTS = {"c_acctbal": 0.0004, "c_nationkey": -0.05}
BIAS = -1.0
THRESHOLD = 0.434
_Z = "(-1.0 + 0.0004 * c_acctbal + -0.05 * c_nationkey)"


@register("r01_score", f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       CAST(1 / (1 + exp(-{_Z})) >= 0.434 AS INTEGER) AS predicted_label, round_even(1 / (1 + exp(-{_Z})), 4) AS proba
FROM customer
""")
def r01_score(spark, d):
    """Sanitise, align, score, label at the threshold, id first."""
    return score.score(t(spark, d, "customer"), WEIGHTS, BIAS, THRESHOLD, id_col="c_custkey")


@register("r05_verdict", f"""
SELECT c_custkey, CASE WHEN 1 / (1 + exp(-{_Z})) >= 0.434 THEN 'refused' ELSE 'accepted' END AS verdict FROM customer
""")
def r05_verdict(spark, d):
    """Verdict column from the label."""
    s = score.score(t(spark, d, "customer"), WEIGHTS, BIAS, THRESHOLD, id_col="c_custkey")
    return s.select("c_custkey", score.verdict(F.col("predicted_label")).alias("verdict"))


@register("r02_explain_linear", """
WITH m AS (SELECT avg(c_acctbal) a, avg(c_nationkey) b FROM customer)
SELECT c_custkey, ROUND(0.0004 * (c_acctbal - a), 6) AS shap_c_acctbal, ROUND(-0.05 * (c_nationkey - b), 6) AS shap_c_nationkey
FROM customer, m
""")
def r02_explain_linear(spark, d):
    """Per-row attributions, top features chosen over the whole table (R2)."""
    c = t(spark, d, "customer")
    means = c.agg(*[F.avg(k).alias(k) for k in WEIGHTS]).first().asDict()
    return rounded(score.explain_linear(c, WEIGHTS, means, id_col="c_custkey", n_top=2))


@register("r03_recap", """
WITH m AS (SELECT avg(c_acctbal) a, avg(c_nationkey) b FROM customer),
r AS (SELECT c_custkey, 'c_acctbal' AS feature, c_acctbal AS value, 0.0004 * (c_acctbal - a) AS impact FROM customer, m WHERE c_custkey = 42
      UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE), -0.05 * (c_nationkey - b) FROM customer, m WHERE c_custkey = 42)
SELECT c_custkey, feature, round_even(value, 2) AS value, ROUND(impact, 6) AS impact,
       CASE WHEN impact > 0 THEN 'increases risk' ELSE 'decreases risk' END AS effect FROM r
""")
def r03_recap(spark, d):
    """One client's features, values, impacts and effect labels by |impact|."""
    c = t(spark, d, "customer")
    means = c.agg(*[F.avg(k).alias(k) for k in WEIGHTS]).first().asDict()
    attr = score.explain_linear(c, WEIGHTS, means, id_col="c_custkey", n_top=2).filter("c_custkey = 42")
    return rounded(score.recap(c.filter("c_custkey = 42"), "c_custkey", list(WEIGHTS), attr), 6, ["impact"])


@register("r04_position_percentile", """
SELECT ROUND(avg(CASE WHEN c_acctbal <= (SELECT c_acctbal FROM customer WHERE c_custkey = 42) THEN 1.0 ELSE 0.0 END) * 100, 6)
  AS percentile FROM customer
""")
def r04_position_percentile(spark, d):
    """Percentile of one client within the reference distribution."""
    c = t(spark, d, "customer")
    v = c.filter("c_custkey = 42").select("c_acctbal").first()[0]
    return rounded(score.percentile_of(c, "c_acctbal", v))


@register("r04_reference_histogram", """
WITH mm AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer),
b AS (SELECT c_mktsegment, least(CAST(floor((c_acctbal - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin FROM customer, mm),
c AS (SELECT c_mktsegment, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT DISTINCT c_mktsegment, CAST(r.range AS INTEGER) AS bin FROM customer, range(50) r)
SELECT g.c_mktsegment, g.bin, ROUND(lo + g.bin * (hi - lo) / 50, 4) AS bin_lo,
       ROUND(lo + (g.bin + 1) * (hi - lo) / 50, 4) AS bin_hi, coalesce(c.n, 0) AS n
FROM g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin AND g.c_mktsegment = c.c_mktsegment
""")
def r04_reference_histogram(spark, d):
    """50-bin reference histogram by label."""
    from quarry.operators.agg import histogram
    return rounded(histogram(t(spark, d, "customer"), "c_acctbal", 50, by="c_mktsegment"), 4, ["bin_lo", "bin_hi"])


@register("r06_incremental", f"""
SELECT c.c_custkey, round_even(1 / (1 + exp(-{_Z})), 4) AS proba FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM customer s WHERE s.c_custkey = c.c_custkey AND s.c_custkey % 3 = 0)
""")
def r06_incremental(spark, d):
    """Score only ids without a stored result."""
    c = t(spark, d, "customer")
    stored = c.filter(F.pmod("c_custkey", F.lit(3)) == 0).select("c_custkey")
    todo = score.incremental(c, stored, "c_custkey")
    return score.score(todo, WEIGHTS, BIAS, THRESHOLD, id_col="c_custkey").select("c_custkey", "proba")


@register("r07_batches", """
WITH b AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch FROM customer),
p AS (SELECT CAST(batch AS BIGINT) AS batch, count(*) AS rows FROM b GROUP BY 1)
SELECT batch, rows, CAST(sum(rows) OVER (ORDER BY batch) AS BIGINT) AS processed,
       ROUND(sum(rows) OVER (ORDER BY batch) * 100.0 / (SELECT count(*) FROM customer), 6) AS percent FROM p
""")
def r07_batches(spark, d):
    """Fixed-size batches with cumulative progress."""
    return rounded(score.batches(t(spark, d, "customer"), "c_custkey", 100))


def projection_matrix(dim: int = 64, out: int = 4) -> np.ndarray:
    """Fixed projection weights from a rule: ((7i + 3j) mod 11 - 5) / 10."""
    i = np.arange(dim)[:, None]
    j = np.arange(out)[None, :]
    return (((7 * i + 3 * j) % 11) - 5) / 10.0


@register("v01_projection_udf", """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(j AS INTEGER) AS j, ROUND(sum(v * ((((7 * i + 3 * j) % 11) - 5) / 10.0)), 6) AS value
FROM x, range(4) r(j) GROUP BY vec_id, j
""")
def v01_projection_udf(spark, d):
    """Iterator pandas UDF applying broadcast weights once per task (V1, V3)."""
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    p = score.project_vectors(e, "embedding", projection_matrix(), batch_size=256)
    return rounded(p.select("vec_id", F.posexplode("projection").alias("j", "value"))
                   .withColumn("j", F.col("j").cast("int")))


# ------------------------------------------------------------------ streaming

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _scored_stream(spark, d):
    out, ck = stream.scratch(spark, "g01-out"), stream.scratch(spark, "g01-ckpt")
    scorer = stream.linear_scorer({"v": 0.05 * F.col("value")}, -0.5, 0.5)
    total = t(spark, d, "events").count()
    _, progress = stream.score_stream(spark, d, EVENT_SCHEMA, scorer, out, ck, glob="events.parquet", total=total)
    return spark.read.parquet(out), progress


@register("g01_score_stream", """
SELECT event_id, user_id, ROUND(1 / (1 + exp(-(0.05 * value - 0.5))), 6) AS proba,
       CAST(1 / (1 + exp(-(0.05 * value - 0.5))) >= 0.5 AS INTEGER) AS predicted_label FROM events
""")
def g01_score_stream(spark, d):
    """Progressive scoring of the events stream into a Parquet sink (G1)."""
    r, _ = _scored_stream(spark, d)
    return r.select("event_id", "user_id", rnd("proba").alias("proba"), "predicted_label")


@register("g01_progress", "SELECT count(*) AS processed, count(*) AS total, 100.0::DOUBLE AS percent FROM events")
def g01_progress(spark, d):
    """What the scoring stream reported batch by batch while it ran, at its last batch: rows, total and percent (G1)."""
    _, p = _scored_stream(spark, d)
    return p.agg(F.max("processed").alias("processed"), F.max("total").alias("total"), F.max("percent").alias("percent"))


@register("g02_periodic_counts", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period_start, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def g02_periodic_counts(spark, d):
    """Daily counts per event type kept up to date by a windowed stream."""
    out, ck = stream.scratch(spark, "g02-out"), stream.scratch(spark, "g02-ckpt")
    stream.periodic_counts(spark, d, EVENT_SCHEMA, "ts", "1 day", "1 day", out, ck, by=["event_type"],
                           glob="events.parquet")
    return spark.read.parquet(out)


# ------------------------------------------------------------------ sources and sinks

@register("s01_csv_roundtrip", "SELECT * FROM part")
def s01_csv_roundtrip(spark, d):
    """Write part as CSV with a header, read it back with a declared schema."""
    p = t(spark, d, "part")
    path = stream.scratch(spark, "s01")
    p.write.option("header", True).csv(path)
    return io.read_csv(spark, path, p.schema)


@register("s02_tsv_roundtrip", "SELECT * FROM supplier")
def s02_tsv_roundtrip(spark, d):
    """TSV with an explicit line terminator."""
    s = t(spark, d, "supplier")
    path = stream.scratch(spark, "s02")
    s.write.option("header", True).option("sep", "\t").option("lineSep", "\n").csv(path)
    return io.read_csv(spark, path, s.schema, sep="\t", line_sep="\n")


@register("s03_first_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500")
def s03_first_rows(spark, d):
    """Row-limited scan: first 500 rows by key (S3)."""
    return io.read_first_rows(t(spark, d, "orders"), 500, "o_orderkey")


@register("s05_parquet_roundtrip", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s05_parquet_roundtrip(spark, d):
    """Parquet sink (overwrite) and scan with column pruning."""
    path = stream.scratch(spark, "s05")
    io.write_parquet(t(spark, d, "orders"), path)
    return io.read_parquet(spark, path, columns=["o_orderkey", "o_custkey", "o_totalprice"])


@register("s06_json_lines", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def s06_json_lines(spark, d):
    """JSON-lines sink and scan with a declared schema."""
    path = stream.scratch(spark, "s06")
    io.write_json_lines(t(spark, d, "documents"), path)
    return io.read_json_lines(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@register("s07_binary_tree", """
SELECT regexp_extract(url, '/(en|fr|de|es)/', 1) AS label, count(*) AS n_files, CAST(sum(strlen(html)) AS BIGINT) AS total_bytes,
       CAST(sum(length(rtrim(html, chr(10)))) AS BIGINT) AS total_chars
FROM pages GROUP BY 1
""")
def s07_binary_tree(spark, d):
    """Recursive scan of a tree of binary files: path, length and content; label = parent folder."""
    pages = t(spark, d, "pages").withColumn("label", F.regexp_extract("url", "/(en|fr|de|es)/", 1))
    root = stream.scratch(spark, "s07")
    # the tree: one file per page (its html and a line break) in a folder of its label, of which there are
    # several, so that they are listed in parallel; the tasks put their files in place, not the driver one by one
    pages = spread(pages).withColumn("shard", F.pmod(F.xxhash64("url"), F.lit(64)).cast("int"))
    (pages.select("shard", "label", "html").write.option("maxRecordsPerFile", 1)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("shard", "label").text(root))
    files = io.read_binary_tree(spark, root, glob="*.txt")
    html = F.rtrim(F.decode("content", "UTF-8"), F.lit("\n"))
    return files.groupBy(F.regexp_extract("label", "label=(.*)", 1).alias("label")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.col("length") - 1).cast("bigint").alias("total_bytes"),
        F.sum(F.char_length(html)).cast("bigint").alias("total_chars"))


@register("s08_csv_sink", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def s08_csv_sink(spark, d):
    """CSV sink with ';', header, encoding and renamed fields; read back."""
    path = stream.scratch(spark, "s08")
    s = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    io.write_csv(s, path, sep=";", rename={"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"})
    return io.read_csv(spark, path, "id bigint, name string, balance double", sep=";")


@register("s10_flatten_payload", """
SELECT user_id, code, product_name, coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), '') AS k,
       coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM (
  SELECT user_id, CAST(event_id AS VARCHAR) AS code, event_type AS product_name, props FROM events)
""")
def s10_flatten_payload(spark, d):
    """Nested JSON payloads (an array of hits per document) read with a declared schema and flattened, missing keys as '' (S10)."""
    e = t(spark, d, "events")
    # the payloads: JSON lines of at most eight hits of one user
    hit = lambda k: F.struct(*[F.max(F.when(F.col("slot") == k, c)).alias(n) for n, c in (
        ("code", F.col("event_id").cast("string")), ("product_name", F.col("event_type")), ("k", F.get_json_object("props", "$.k")), ("missing", F.lit(None).cast("string")))])
    block = e.withColumns({"slot": F.pmod("event_id", F.lit(8)), "block": F.floor(F.col("event_id") / 8)}).groupBy("user_id", "block")
    docs = block.agg(F.array(*[hit(k) for k in range(8)]).alias("hits")).select("user_id", F.filter("hits", lambda h: h["code"].isNotNull()).alias("hits"))
    path = stream.scratch(spark, "s10")
    io.write_json_lines(docs, path)
    read = io.read_json_lines(spark, path, "user_id bigint, hits array<struct<code:string,product_name:string,k:string,missing:string>>")
    return io.flatten_hits(read, "hits", ["code", "product_name", "k", "missing"], keep=["user_id"])


@register("s11_metrics_report")
def s11_metrics_report(spark, d):
    """Metrics report written as JSON and read back."""
    from quarry.plans.q_analytics import scored_labels
    from quarry.operators import model
    m = model.binary_metrics(scored_labels(spark, d), "quality", "p", 0.3).first().asDict()
    path = stream.scratch(spark, "s11")
    io.write_report(spark, m, path)
    return spark.read.json(path)


@register("s12_model_roundtrip")
def s12_model_roundtrip(spark, d):
    """Save and reload a fitted pipeline; predictions must match."""
    from pyspark.ml import PipelineModel
    docs = lang_docs(spark, d)
    m = textclf.text_classifier(docs, "text", "lang", max_iter=5)
    path = stream.scratch(spark, "s12")
    m.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = m.transform(docs).select("doc_id", F.col("prediction").alias("p1"))
    b = again.transform(docs).select("doc_id", F.col("prediction").alias("p2"))
    return a.join(b, "doc_id").withColumn("same", F.col("p1") == F.col("p2"))


@register("s13_partitioned_layout", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s13_partitioned_layout(spark, d):
    """Label-partitioned layout written and read back with partition discovery."""
    path = stream.scratch(spark, "s13")
    io.write_parquet(t(spark, d, "documents"), path, partition_by=["lang"])
    back = spark.read.parquet(path)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("g02_periodic_counts_append", """
WITH n AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period_start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT period_start, event_type, n FROM n
WHERE period_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def g02_periodic_counts_append(spark, d):
    """Daily counts in append mode: a day is written once the watermark passes it (G2, unbounded form).

    The days that the watermark (latest time less one hour) has not passed stay
    in the state, as append mode promises, and are not in the sink.
    """
    out, ck = stream.scratch(spark, "g02a-out"), stream.scratch(spark, "g02a-ckpt")
    schema = "period_start timestamp_ntz, event_type string, n bigint"
    stream.periodic_counts(spark, d, EVENT_SCHEMA, "ts", "1 day", "1 hour", out, ck, by=["event_type"],
                           glob="events.parquet", mode="append")
    return spark.read.schema(schema).parquet(out)
