"""Segmentation and clustering (C*).

Centroids and scaler statistics are small (k x d, 2 x d) and become literal
arrays; assigning rows to centroids is a JVM expression over k distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import frac_days, sq_dist
from quarry.operators.rank import cut, qcut
from quarry.operators.shape import q
from quarry.session import cut_lineage

# RFM score -> segment rule of the reference (labels as written there).
SEGMENT_RULES = [
    (11, None, "Très bons clients"),
    (9, None, "Bons clients"),
    (8, 8, "Clients tièdes"),
    (7, 7, "Nouveaux clients"),
    (4, 6, "À risque"),
]
SEGMENT_OTHER = "Inactifs"


def segment(score: Column) -> Column:
    """RFM total -> segment label.

    The reference applies a Python row lambda; here it is a native CASE
    expression (V2), evaluated inside generated code.
    """
    e = None
    for lo, hi, label in SEGMENT_RULES:
        cond = (score >= lo) if hi is None else score.between(lo, hi)
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    return F.when(score.isNotNull(), e.otherwise(F.lit(SEGMENT_OTHER)))


def rfm(df: DataFrame, id_col: str, ts: str, amount: str, f_edges: list, r_labels=(5, 4, 3, 2, 1),
        m_labels=(1, 2, 3, 4, 5), extra: dict[str, Column] | None = None) -> DataFrame:
    """Recency / frequency / monetary scores, total and segment per customer.

    Recency = whole days from the last order to (max date + 1 day); F score
    by right-closed fixed edges; R and M scores by exact quintiles.  High
    spend gets the high M label by default (the reference reversed it).
    """
    today = df.select(F.max(q(ts)) + F.expr("INTERVAL 1 DAY")).scalar()
    g = df.groupBy(q(id_col)).agg(F.max(q(ts)).alias("last_order_date"), F.count(F.lit(1)).alias("Frequency"),
                                  F.sum(q(amount)).alias("Monetary"), *[v.alias(k) for k, v in (extra or {}).items()])
    g = g.withColumn("Recency", F.floor(frac_days(today, "last_order_date")).cast("long"))
    g = cut(g, "Frequency", f_edges, list(range(1, len(f_edges))), out="F_score")
    from quarry.operators.agg import percentiles_long
    e = {"Recency": [None] * 6, "Monetary": [None] * 6}
    for r in percentiles_long(g, ["Recency", "Monetary"], [i / 5 for i in range(6)]).collect():  # 12 numbers
        e[r["column_name"]][r["pos"]] = r["value"]
    edges = {c: (v if v[0] is not None else None) for c, v in e.items()}  # no rows: qcut gives NULL bins
    g = qcut(g, "Recency", 5, list(r_labels), out="R_score", edges=edges["Recency"])
    g = qcut(g, "Monetary", 5, list(m_labels), out="M_score", edges=edges["Monetary"])
    g = g.withColumn("RFM_Score", F.col("R_score") + F.col("F_score") + F.col("M_score"))
    return g.withColumn("Segment", segment(F.col("RFM_Score")))


# ---------------------------------------------------------------- centroid assignment

def nearest_centroid(vec: Column | list[Column], centroids: list[list[float]]) -> Column:
    """Index of the nearest centroid (ties -> lowest index) to an array column, or to a list of coordinates."""
    def dist(c):
        if isinstance(vec, list):  # plain arithmetic, for generated code
            return sum(((v - F.lit(float(x))) * (v - F.lit(float(x))) for v, x in zip(vec, c)), F.lit(0.0))
        return sq_dist(vec, F.array(*[F.lit(float(x)) for x in c]))
    dists = F.array(*[F.struct(dist(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
    return F.array_min(dists)["i"]


def assign_clusters(df: DataFrame, vec: str, centroids: list[list[float]], out: str = "cluster") -> DataFrame:
    """k-means predict against given centroids."""
    return df.withColumn(out, nearest_centroid(F.col(vec).cast("array<double>"), centroids))


def kmeans_fit(df: DataFrame, vec: str, k: int, seed: int = 42, max_iter: int = 20):
    """k-means fit (C3, C4): model with ``clusterCenters()`` and ``summary.trainingCost``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    d = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("__f"))
    return KMeans(featuresCol="__f", k=k, seed=seed, maxIter=max_iter).fit(d)


def elbow(df: DataFrame, vec: str, ks: list[int], seed: int = 42) -> DataFrame:
    """Inertia (within-cluster sum of squares) over a k range (C4)."""
    rows = [(k, float(kmeans_fit(df, vec, k, seed).summary.trainingCost)) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def bisecting_fit(df: DataFrame, vec: str, k: int, seed: int = 42):
    """Divisive hierarchical grouping into k clusters (C6, re-aimed agglomerative)."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector
    d = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("__f"))
    return BisectingKMeans(featuresCol="__f", k=k, seed=seed).fit(d)


def silhouette_sq(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact in O(n k).

    For x in cluster A: mean squared distance to the members of C is
    |x|^2 - 2 x.mu_C + mean_C |y|^2 (self excluded for A).  Singleton
    clusters score 0.  Same definition as Spark's ClusteringEvaluator.
    """
    v = F.col(vec).cast("array<double>")
    d = df.select(v.alias("__v"), q(cluster).alias("__c"))
    d = d.withColumn("__n2", F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))
    pos = d.select("__c", F.posexplode("__v").alias("p", "x"))
    mu = pos.groupBy("__c", "p").agg(F.avg("x").alias("m"))
    st = d.groupBy("__c").agg(F.count(F.lit(1)).alias("n"), F.avg("__n2").alias("m2"))
    rows = st.collect()  # k rows
    cents = {r["__c"]: r for r in rows}
    mus = {}
    for r in mu.collect():  # k x d numbers
        mus.setdefault(r["__c"], {})[r["p"]] = r["m"]
    keys = sorted(cents)
    dists = []
    for c in keys:
        m = mus[c]
        mv = F.array(*[F.lit(float(m[i])) for i in range(len(m))])
        md = F.col("__n2") - 2 * F.aggregate(F.zip_with("__v", mv, lambda a, b: a * b), F.lit(0.0),
                                             lambda s, x: s + x) + F.lit(float(cents[c]["m2"]))
        dists.append((c, md, cents[c]["n"]))
    a = None
    b = None
    for c, md, n in dists:
        own = F.col("__c") == F.lit(c)
        a_c = md * F.lit(float(n)) / F.lit(float(max(n - 1, 1)))
        a = F.when(own, a_c) if a is None else a.when(own, a_c)
        other = F.when(~own, md)
        b = other if b is None else F.least(b, other)
    nsize = None
    for c, _, n in dists:
        nsize = F.when(F.col("__c") == F.lit(c), F.lit(n)) if nsize is None else nsize.when(F.col("__c") == F.lit(c), F.lit(n))
    s = F.when(nsize <= 1, F.lit(0.0)).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return d.agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouette_sample(df: DataFrame, vec: str, cluster: str, key, fraction: float = 1.0, seed: int = 42, block: int = 1024) -> DataFrame:
    """Mean Euclidean silhouette of a sample, and the sample's size.

    ``key`` names the rows (or is a boolean column that picks the sample; then
    ``fraction`` is not used).  Each sampled point needs the sum of its
    distances to every cluster of the sample.  Points are dealt into blocks;
    every block meets every other one as one group, in which numpy adds the
    distances up per point and cluster, so what leaves a task is one row per
    point and cluster, never a pair.  Singleton clusters score 0.
    """
    from quarry.operators.sample import unit_hash

    chosen = df.filter(key if not isinstance(key, str) else unit_hash(key, seed) < fraction)
    s = cut_lineage(chosen.select(q(vec).cast("array<double>").alias("v"), q(cluster).cast("string").alias("c"))
                    .withColumn("id", F.monotonically_increasing_id()))
    n_blocks = max(1, -(-s.count() // block))
    dealt = s.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    points = dealt.withColumnRenamed("b", "pb").withColumn("rb", every)
    rows = dealt.withColumnRenamed("b", "rb").withColumn("pb", every)

    def add(key_, left, right):
        x, y = (np.array(t.column("v").to_pylist(), float) for t in (left, right))
        names, which = np.unique(np.array(right.column("c").to_pylist(), dtype=object).astype(str), return_inverse=True)
        sums = np.zeros((len(x), len(names)))
        for a in range(0, len(x), 64):
            d = np.sqrt(np.square(x[a:a + 64, None, :] - y[None, :, :]).sum(axis=2))
            for k in range(len(names)):
                sums[a:a + 64, k] = d[:, which == k].sum(axis=1)
        own = left.column("c").to_pylist()
        return pa.table({"id": pa.array(np.repeat(left.column("id").to_numpy(), len(names))), "c": pa.array(np.repeat(np.array(own, object), len(names)).tolist(), pa.string()),
                         "other": pa.array(names.tolist() * len(x), pa.string()), "total": pa.array(sums.ravel())})

    sums = points.groupBy("pb", "rb").cogroup(rows.groupBy("pb", "rb")).applyInArrow(add, "id bigint, c string, other string, total double")
    size = s.groupBy(F.col("c").alias("other")).agg(F.count(F.lit(1)).alias("m"))
    per = sums.groupBy("id", "c", "other").agg(F.sum("total").alias("total")).join(size, "other")
    own = F.col("c") == F.col("other")
    ab = per.groupBy("id").agg(F.max(F.when(own, F.try_divide(F.col("total"), F.col("m") - 1))).alias("a"),
                               F.min(F.when(~own, F.col("total") / F.col("m"))).alias("b"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return ab.agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str, by: str | None = None, weight: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labelings from contingency counts (C8); ``weight`` counts each row that often.

    Cell, row and column pair counts are stacked into one long table and
    summed in a single aggregate, so the input is scanned once.
    """
    keys = [by] if by else []
    cells = df.groupBy(*keys, q(a).alias("__a"), q(b).alias("__b")).agg((F.sum(q(weight)) if weight else F.count(F.lit(1))).alias("m"))
    ai = cells.groupBy(*keys, "__a").agg(F.sum("m").alias("m"))
    bj = cells.groupBy(*keys, "__b").agg(F.sum("m").alias("m"))
    long = (cells.select(*keys, F.lit("ij").alias("kind"), "m")
            .unionByName(ai.select(*keys, F.lit("a").alias("kind"), "m"))
            .unionByName(bj.select(*keys, F.lit("b").alias("kind"), "m")))
    m = F.col("m").cast("double")  # products of counts leave the range of a long
    c2 = m * (m - 1) / 2.0
    g = long.groupBy(*keys) if keys else long
    s = g.agg(F.sum(F.when(F.col("kind") == "ij", c2)).alias("sij"), F.sum(F.when(F.col("kind") == "a", c2)).alias("sa"),
              F.sum(F.when(F.col("kind") == "b", c2)).alias("sb"),
              F.sum(F.when(F.col("kind") == "ij", F.col("m"))).alias("n"))
    n = F.col("n").cast("double")
    expected = F.col("sa") * F.col("sb") / (n * (n - 1) / 2.0)
    mx = 0.5 * (F.col("sa") + F.col("sb"))
    return s.select(*keys, F.coalesce(F.try_divide(F.col("sij") - expected, mx - expected), F.lit(1.0)).alias("ari"),
                    F.col("n"))


def cluster_profile(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Cluster sizes and standardised feature means per cluster, melted."""
    from quarry.operators.encode import apply_standard, fit_standard
    st = fit_standard(df, cols)
    z = apply_standard(df, st, cols)
    means = z.groupBy(q(cluster)).agg(F.count(F.lit(1)).alias("size"), *[F.avg(q(c)).alias(c) for c in cols])
    return means.unpivot([q(cluster), "size"], [q(c) for c in cols], "feature", "scaled_mean")


def bag_of_words_hist(desc: DataFrame, item: str, vec: str, centroids: list[list[float]]) -> DataFrame:
    """Nearest codeword per descriptor, normalised histogram per item.

    Items without descriptors get no row here; join to the item list with a
    zero fill for the zero vector.
    """
    a = assign_clusters(desc, vec, centroids, "__w")
    cnt = a.groupBy(q(item), "__w").agg(F.count(F.lit(1)).alias("n"))
    tot = a.groupBy(q(item)).agg(F.count(F.lit(1)).alias("tot"))
    return cnt.join(tot, item).select(q(item), F.col("__w").alias("word"), (F.col("n") / F.col("tot")).alias("share"))


def cluster_stability(orders: DataFrame, id_col: str, ts: str, features: dict, start: str,
                      base_days: int, step_days: int, scaler: dict[str, tuple[float, float]],
                      centroids: list[list[float]], recency_name: str = "recency") -> DataFrame:
    """ARI between the base clustering and each expanding window, as one plan.

    Window s covers [start, start + base_days + s * step_days]; each order
    row is tagged with the first window containing it, rows are aggregated
    per (client, first window), and a running sum per client over these few rows
    gives the features from that window until the client's next one.  Only then
    are rows repeated for the windows they hold in, labelled and counted, so a
    (client, window) row is neither shuffled nor sorted.  What is written is the
    contingency table of each window, at most k x k rows, not the clients' labels.
    Only clients of the base window are followed; windows whose end passes
    the last order date are not produced.  ``features`` maps output names to
    (row-level column, "mean" | "sum"); ``scaler`` holds (mean, std) per
    feature in the order of ``centroids``' coordinates, which is
    list(features) + [recency_name].
    """
    from pyspark.sql import Window

    st = F.lit(start).cast("timestamp_ntz")
    d = orders.filter(q(ts) >= st)
    span = d.select(F.max(q(ts)).alias("mx"), F.floor((frac_days(F.max(q(ts)), st) - F.lit(float(base_days)))
                                                     / F.lit(float(step_days))).alias("steps")).first()  # one row
    max_date, n_steps = span["mx"], int(max(span["steps"] or 0, 0))
    age = frac_days(q(ts), st)
    first = F.greatest(F.lit(0), F.ceil((age - F.lit(float(base_days))) / F.lit(float(step_days)))).cast("int")
    end_of = lambda s: st + F.make_dt_interval(days=F.lit(base_days) + s * F.lit(step_days))
    names = list(features)
    aggs = []
    for nm, (c, _) in features.items():
        aggs += [F.sum(c).alias(f"__s_{nm}"), F.count(c).alias(f"__n_{nm}")]
    part = d.groupBy(q(id_col), first.alias("__first")).agg(*aggs, F.max(q(ts)).alias("__last"))
    client = Window.partitionBy(id_col)
    w = client.orderBy("__first").rowsBetween(Window.unboundedPreceding, 0)
    known = q(id_col).isNotNull()  # orders without a client are one client without features
    cols = {}
    for nm in names:
        total = F.sum(f"__s_{nm}").over(w)
        cnt = F.sum(f"__n_{nm}").over(w)
        if features[nm][1] == "sum":
            cols[nm] = F.when(known & (cnt > 0), total)
        else:
            cols[nm] = F.when(known, F.try_divide(total, cnt.cast("double")))
    cols["__last"] = F.when(known, F.max("__last").over(w))
    cols["__next"] = F.coalesce(F.lead("__first").over(client.orderBy("__first")), F.lit(n_steps + 1))
    cols["__base"] = F.min("__first").over(client) == 0
    g = part.filter(F.col("__first") <= n_steps).withColumns(cols).filter("__base")

    def label(step):
        recency = F.floor(frac_days(end_of(step), "__last")).cast("double")
        return nearest_centroid([((recency if f == recency_name else F.col(f)) - F.lit(scaler[f][0])) / F.lit(scaler[f][1] or 1.0)
                                 for f in names + [recency_name]], centroids)

    # every client's base label beside its rows, which then stand for the windows until the client's next row
    base = F.max(F.when(F.col("__first") == 0, label(F.lit(0)))).over(client)
    g = g.withColumn("cluster_base", base).withColumn("step", F.explode(F.sequence(F.col("__first"), F.col("__next") - 1)))
    g = g.filter((F.col("step") > 0) & (end_of(F.col("step")) <= F.lit(max_date).cast("timestamp_ntz")))
    pairs = g.select("step", "cluster_base", label(F.col("step")).alias("cluster"))
    cells = cut_lineage(pairs.groupBy("step", "cluster_base", "cluster").agg(F.count(F.lit(1)).alias("m")))
    ari = adjusted_rand(cells, "cluster_base", "cluster", by="step", weight="m")
    return ari.withColumn("end_date", end_of(F.col("step"))).select("step", "end_date", "ari", "n")
