"""Statistical tests, correlation and drift (H*, A21, A22).

Spark reduces the data to a few numbers (sums, counts, rank sums); p-values
are then evaluated on the driver from those numbers only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import special
from quarry.operators.gram import named, pair_moments, pearson
from quarry.operators.rank import rank_table
from quarry.operators.shape import q


def pair_corr(x: Column, y: Column) -> Column:
    """Pearson r over pairwise-complete rows; constant column -> NULL, never an ANSI error."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Lower-triangle correlation matrix as (a, b, r) in one pass over block sums."""
    return named(pair_moments(df, cols), cols).select("a", "b", pearson().alias("r"))


def corr_with(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, by |r| descending."""
    one = df.agg(*[pair_corr(q(c).cast("double"), q(target).cast("double")).alias(f"r{i}")
                   for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', r{i}" for i, c in enumerate(cols))
    out = one.selectExpr(f"stack({len(cols)}, {stack}) as (feature, r)")
    return out.orderBy(F.desc_nulls_last(F.abs("r")), "feature")


def pairwise_pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r, pairwise n and two-sided p for every pair (H3)."""
    def p_value(r, n):
        if r is None or n <= 2:
            return None
        return 0.0 if abs(r) >= 1.0 else special.t_sf_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    rows = named(pair_moments(df, cols), cols).select("a", "b", pearson().alias("r"), "n", "i", "j").orderBy("i", "j").collect()  # one row a pair
    return df.sparkSession.createDataFrame([(x.a, x.b, x.r, x.n, p_value(x.r, x.n)) for x in rows], "a string, b string, r double, n bigint, p double")


def spearman(df: DataFrame, a: str, b: str, n_buckets: int | None = None) -> DataFrame:
    """Spearman correlation: Pearson r of average-tie ranks on complete pairs (H4)."""
    d = df.filter(q(a).isNotNull() & q(b).isNotNull()).select(q(a).alias("__a"), q(b).alias("__b"))
    ra = rank_table(d, "__a", n_buckets=n_buckets).select("__a", F.col("rank").alias("__ra"))
    rb = rank_table(d, "__b", n_buckets=n_buckets).select("__b", F.col("rank").alias("__rb"))
    j = d.join(ra, "__a").join(rb, "__b")
    return j.agg(pair_corr(F.col("__ra"), F.col("__rb")).alias("rho"), F.count(F.lit(1)).alias("n"))


def chi2(df: DataFrame, a: str, b: str) -> dict:
    """Chi-square test of independence (H1).

    statistic = sum over non-empty cells of o^2/e - n (empty cells add 0),
    so the full level grid is never built.
    """
    cells = df.filter(q(a).isNotNull() & q(b).isNotNull()).groupBy(q(a).alias("__a"), q(b).alias("__b")) \
        .agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy("__a").agg(F.sum("o").alias("ra"))
    cb = cells.groupBy("__b").agg(F.sum("o").alias("cb"))
    n = F.lit(cells.select(F.sum("o")).first()[0])  # one value
    j = cells.join(ra, "__a").join(cb, "__b")
    o = F.col("o").cast("double")  # products of counts leave the range of a long
    e = F.col("ra").cast("double") * F.col("cb").cast("double") / n
    row = j.agg((F.sum(o * o / e) - n).alias("statistic"), n.alias("n"),
                F.count_distinct("__a").alias("r"), F.count_distinct("__b").alias("c")).first()
    dof = (row["r"] - 1) * (row["c"] - 1)
    return {"statistic": row["statistic"], "dof": dof, "n": row["n"],
            "p_value": special.chi2_sf(row["statistic"], dof) if dof > 0 else float("nan")}


def chi2_frame(df: DataFrame, a: str, b: str) -> DataFrame:
    r = chi2(df, a, b)
    return df.sparkSession.createDataFrame([(float(r["statistic"]), int(r["dof"]), int(r["n"]), float(r["p_value"]))],
                                           "statistic double, dof bigint, n bigint, p_value double")


def kruskal_stats(df: DataFrame, col: str, group: str, n_buckets: int | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction for one variable (H2), as a one-row frame.

    Ranks are pooled over groups (average ties); rank sums per group come
    from per-(value, group) counts, never a row-level global sort.
    """
    d = df.filter(q(col).isNotNull() & q(group).isNotNull()).select(q(col).alias("__v"), q(group).alias("__g"))
    rt = rank_table(d, "__v", n_buckets=n_buckets)
    vg = d.groupBy("__v", "__g").agg(F.count(F.lit(1)).alias("m"))
    rs = vg.join(rt.select("__v", "rank"), "__v").groupBy("__g").agg(
        F.sum(F.col("m") * F.col("rank")).alias("R"), F.sum("m").alias("ng"))
    # one aggregate over stacked contributions: rank-sum terms per group, tie terms per value
    cnt = F.col("cnt").cast("double")
    long = (rs.select(F.lit("g").alias("kind"), (F.col("R") * F.col("R") / F.col("ng")).alias("x"))
            .unionByName(rt.select(F.lit("t").alias("kind"), (cnt * cnt * cnt - cnt).alias("x")))
            .unionByName(rt.select(F.lit("n").alias("kind"), cnt.alias("x"))))
    s = long.agg(F.sum(F.when(F.col("kind") == "g", F.col("x"))).alias("rsum"),
                 F.count(F.when(F.col("kind") == "g", 1)).alias("k"),
                 F.sum(F.when(F.col("kind") == "t", F.col("x"))).alias("ties"),
                 F.sum(F.when(F.col("kind") == "n", F.col("x"))).alias("N"))
    Nd = F.col("N")
    h = (12.0 / (Nd * (Nd + 1))) * F.col("rsum") - 3 * (Nd + 1)
    corr = 1 - F.col("ties") / (Nd * Nd * Nd - Nd)
    return s.select(F.try_divide(h, corr).alias("H"), F.col("k"), Nd.cast("long").alias("n"))


def kruskal(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """H, dof and p for several variables, sorted by p (H2)."""
    rows = []
    for c in cols:
        r = kruskal_stats(df, c, group).first()
        dof = r["k"] - 1
        p = special.chi2_sf(r["H"], dof) if r["H"] is not None and dof > 0 else None
        rows.append((c, r["H"], int(dof), p))
    out = df.sparkSession.createDataFrame(rows, "variable string, H double, dof bigint, p_value double")
    return out.orderBy("p_value", "variable")


def jarque_bera(df: DataFrame, cols: list[str]) -> DataFrame:
    """Normality screen: Jarque-Bera from population skewness and excess kurtosis (H5)."""
    rows = []
    one = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.skewness(q(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.kurtosis(q(c)).alias(f"k{i}") for i, c in enumerate(cols)]).first()
    for i, c in enumerate(cols):
        n, s, k = one[f"n{i}"], one[f"s{i}"], one[f"k{i}"]
        jb = None if s is None or k is None else n / 6.0 * (s * s + k * k / 4.0)
        rows.append((c, int(n), s, k, jb, special.chi2_sf(jb, 2) if jb is not None else None))
    return df.sparkSession.createDataFrame(
        rows, "variable string, n bigint, skewness double, excess_kurtosis double, jb double, p_value double")


def ks_normal(df: DataFrame, col: str) -> DataFrame:
    """One-sample Kolmogorov-Smirnov test against a normal with the sample mean/std (H5)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    m = df.agg(F.avg(q(col)).alias("m"), F.stddev_pop(q(col)).alias("s")).first()
    d = df.filter(q(col).isNotNull()).select(q(col).cast("double").alias("x"))
    r = KolmogorovSmirnovTest.test(d, "x", "norm", float(m["m"]), float(m["s"] or 1.0)).first()
    return df.sparkSession.createDataFrame([(col, float(r.statistic), float(r.pValue))],
                                           "variable string, statistic double, p_value double")


def simple_ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept, R^2 and n of y ~ x on complete pairs (H6, one variable)."""
    return df.agg(F.regr_slope(q(y), q(x)).alias("slope"), F.regr_intercept(q(y), q(x)).alias("intercept"),
                  F.regr_r2(q(y), q(x)).alias("r2"), F.regr_count(q(y), q(x)).alias("n"))


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Multiple OLS with standard errors and p-values (H6), via the normal-equation solver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    d = VectorAssembler(inputCols=xs, outputCol="__f", handleInvalid="skip").transform(
        df.select(*[q(c).cast("double").alias(c) for c in xs], q(y).cast("double").alias("__y")).na.drop())
    m = LinearRegression(featuresCol="__f", labelCol="__y", solver="normal", regParam=0.0).fit(d)
    s = m.summary
    names = xs + ["intercept"]
    coefs = list(m.coefficients) + [m.intercept]
    rows = [(n, float(c), float(se), float(tv), float(p), float(s.r2))
            for n, c, se, tv, p in zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, std_err double, t double, p_value double, r2 double")


def psi_numeric(ref: DataFrame, cur: DataFrame, col: str, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index of one numeric column over reference quantile bins (H7)."""
    from quarry.operators.agg import exact_percentile_values
    # bins - 1 edge values (bounded) come back as a literal array
    edges = exact_percentile_values(ref, col, [i / bins for i in range(1, bins)])
    b = F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda e: e < q(col)))
    pr = ref.filter(q(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("nr"))
    pc = cur.filter(q(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("nc"))
    nr = ref.select(F.count(q(col))).scalar()
    nc = cur.select(F.count(q(col))).scalar()
    j = pr.join(pc, "bin", "full_outer").fillna(0, subset=["nr", "nc"])
    p_r = F.greatest(F.col("nr") / nr, F.lit(eps))
    p_c = F.greatest(F.col("nc") / nc, F.lit(eps))
    return j.agg(F.sum((p_c - p_r) * F.ln(p_c / p_r)).alias("score")).select(F.lit(col).alias("column_name"), "score")


def ks_two_sample(ref: DataFrame, cur: DataFrame, col: str, n_buckets: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic max |F_ref - F_cur| (H7).

    Exact: the two samples are stacked, per-value counts of each side are
    accumulated over the ordered distinct values (bucketed, no global sort),
    and the largest gap between the two empirical distributions is taken.
    """
    both = (ref.select(q(col).alias("__x"), F.lit(1).alias("__side"))
            .unionByName(cur.select(q(col).alias("__x"), F.lit(2).alias("__side"))))
    rt = rank_table(both, "__x", weights={"r": (F.col("__side") == 1).cast("long"),
                                          "c": (F.col("__side") == 2).cast("long")},
                    n_buckets=n_buckets, cumulative=True)
    tot = both.filter(F.col("__x").isNotNull()).agg(F.count(F.when(F.col("__side") == 1, 1)).alias("nr"),
                                                    F.count(F.when(F.col("__side") == 2, 1)).alias("nc")).first()
    gap = F.abs(F.col("cum_r") / F.lit(float(tot["nr"])) - F.col("cum_c") / F.lit(float(tot["nc"])))
    return rt.agg(F.max(gap).alias("score")).select(F.lit(col).alias("column_name"), "score")


def tvd_categorical(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Total variation distance between category shares (H7)."""
    nr = ref.select(F.count(q(col))).scalar()
    nc = cur.select(F.count(q(col))).scalar()
    pr = ref.filter(q(col).isNotNull()).groupBy(q(col).alias("v")).agg((F.count(F.lit(1)) / nr).alias("pr"))
    pc = cur.filter(q(col).isNotNull()).groupBy(q(col).alias("v")).agg((F.count(F.lit(1)) / nc).alias("pc"))
    j = pr.join(pc, "v", "full_outer").fillna(0.0, subset=["pr", "pc"])
    return j.agg((0.5 * F.sum(F.abs(F.col("pr") - F.col("pc")))).alias("score")).select(
        F.lit(col).alias("column_name"), "score")


def drift(ref: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str],
          psi_threshold: float = 0.2, tvd_threshold: float = 0.1, bins: int = 10,
          ks_threshold: float | None = None) -> DataFrame:
    """Per-column drift score and flag; the share drifted is the mean of the flag (H7).

    Numeric columns get PSI on reference-quantile bins (and the two-sample
    KS statistic when ``ks_threshold`` is given); categorical columns get the
    total variation distance.
    """
    parts = [psi_numeric(ref, cur, c, bins).withColumn("method", F.lit("psi"))
             .withColumn("drifted", F.col("score") > psi_threshold) for c in numeric]
    if ks_threshold is not None:
        parts += [ks_two_sample(ref, cur, c).withColumn("method", F.lit("ks"))
                  .withColumn("drifted", F.col("score") > ks_threshold) for c in numeric]
    parts += [tvd_categorical(ref, cur, c).withColumn("method", F.lit("tvd"))
              .withColumn("drifted", F.col("score") > tvd_threshold) for c in categorical]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
