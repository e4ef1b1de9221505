"""Aggregations (A*).

All grouped statistics are single ``groupBy().agg`` passes (partial
aggregation map-side, so a hot key is combined before the shuffle).  Totals
used inside a plan are scalar subqueries; bin edges and month grids take one
row of bounds to the driver while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import part_totals, sorted_parts
from quarry.operators.shape import join_keys, q

# pandas-style aggregate names -> Spark aggregate builders (D2 sum of nothing
# is 0 when the group has rows; D7 variance is the sample variance).
_FN = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "sum": F.sum,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "count": F.count,
    "nunique": F.count_distinct,
}


def _agg_expr(fn: str, x: Column, present: Column | None) -> Column:
    if fn == "size":
        return F.count(F.lit(1)) if present is None else F.count(F.when(present, F.lit(1)))
    e = _FN[fn](x)
    if fn == "sum":
        e = F.coalesce(e, F.lit(0))
        if present is not None:
            # a filtered group with no rows gives NULL, like a left join would
            e = F.when(F.count(F.when(present, F.lit(1))) > 0, e)
    return e


def agg_features(df: DataFrame, key, spec: dict[str, list[str]], prefix: str = "",
                 where: Column | None = None, count: bool = False,
                 count_name: str | None = None) -> DataFrame:
    """Per-key features from a {column: [functions]} spec (A1-A3).

    Output names are ``PREFIX_COLUMN_FN`` upper-cased.  ``where`` restricts
    every aggregate to matching rows in the same pass (A2).  ``count`` adds
    the group size (A3).
    """
    keys = [key] if isinstance(key, str) else list(key)
    pre = f"{prefix}_" if prefix else ""
    aggs = []
    for c, fns in spec.items():
        x = q(c) if where is None else F.when(where, q(c))
        for fn in fns:
            aggs.append(_agg_expr(fn, x, where).alias(f"{pre}{c}_{fn}".upper()))
    if count:
        aggs.append(_agg_expr("size", None, where).alias(count_name or f"{pre}COUNT".upper()))
    return df.groupBy(*[q(k) for k in keys]).agg(*aggs)


def value_counts(df: DataFrame, col, normalize: bool = False, top: int | None = None,
                 name: str = "n") -> DataFrame:
    """Counts per value, largest first, optional share and top-n."""
    cols = [col] if isinstance(col, str) else list(col)
    out = df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias(name))
    if normalize:
        total = df.select(F.count(F.lit(1))).scalar()
        out = out.withColumn("share", F.col(name) / total)
    out = out.orderBy(F.desc(name), *[q(c) for c in cols])
    return out.limit(top) if top else out


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null (column_name, value as text) rows of several columns, from one scan.

    Each row becomes one short (column, value) pair per column, and tasks drop
    repeated pairs before the shuffle, so no row is copied whole.  A value's
    text names it: equal values have equal texts (0.0 and -0.0 too).
    """
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return (q(c) + F.lit(0.0).cast(kinds[c])).cast("string")
        if kinds[c] == "binary":
            return F.hex(q(c))
        if kinds[c].startswith(("array", "map", "struct")):
            return F.when(q(c).isNotNull(), F.to_json(F.struct(q(c))))
        return q(c).cast("string")

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in cols])).alias("__e")
    return df.select(pairs).select("__e.*").filter(F.col("value").isNotNull()).distinct()


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False,
                    rsd: float = 0.01) -> DataFrame:
    """Distinct values per column, long form (A8); exact by a two-level aggregate, or by one-pass sketches."""
    if not approx:
        return with_all_columns(distinct_values(df, cols).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct")), df, cols)
    one = df.agg(*[F.approx_count_distinct(q(c), rsd).alias(f"d{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', d{i}" for i, c in enumerate(cols))
    return one.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, n_distinct)")


def with_all_columns(counts: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """``counts``(column_name, n_distinct) with 0 for the columns that have no value."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name"))
    return names.join(counts, "column_name", "left").select("column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def group_means(df: DataFrame, by, cols: list[str], std: bool = False) -> DataFrame:
    """Group mean (and sample std) over several columns."""
    keys = [by] if isinstance(by, str) else list(by)
    aggs = [F.avg(q(c)).alias(f"{c}_mean") for c in cols]
    if std:
        aggs += [F.stddev_samp(q(c)).alias(f"{c}_std") for c in cols]
    return df.groupBy(*[q(k) for k in keys]).agg(*aggs)


def explode_stats(df: DataFrame, list_col: str, value_col: str, min_support: int,
                  item: str = "item") -> DataFrame:
    """Explode a list column, mean/count of a value per item, min support, ranked."""
    e = df.filter(q(list_col).isNotNull()).select(F.explode(q(list_col)).alias(item), q(value_col))
    g = e.groupBy(item).agg(F.avg(q(value_col)).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") >= min_support).orderBy(F.desc("mean_value"), item)


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form."""
    return df.groupBy(q(a), q(b)).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, levels: list) -> DataFrame:
    """Wide contingency table over given column levels (bounded width)."""
    return df.groupBy(q(a)).pivot(b, levels).agg(F.count(F.lit(1))).na.fill(0)


def hierarchy_counts(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Counts per (parent, child) with parent totals and the grand total."""
    return (df.rollup(q(parent), q(child)).agg(F.count(F.lit(1)).alias("n"),
                                               F.grouping_id().alias("level")))


def exact_percentiles(df: DataFrame, col: str, qs: list[float], by=None, n_buckets: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, long form (keys, pos, value)."""
    return percentiles_long(df, [col], qs, by, n_buckets).drop("column_name")


def percentiles_long(df: DataFrame, cols: list[str], qs: list[float], by=None, n_buckets: int | None = None) -> DataFrame:
    """Exact percentiles of several columns, long form (keys, column_name, pos, value).

    The values of ``percentile`` (position (n-1)q, interpolated between the
    values at its floor and ceiling), but no task holds a group's distinct
    values: per-value counts are range-partitioned by (group, column, value),
    the parts' totals tell which part holds a target position, and only those
    parts' values are summed up inside (``ordered``).  NULL and NaN are
    missing, a NULL key is a group, and a group without values gives NULL.
    """
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    gk = [*keys, "column_name"]
    g = [q(k) for k in gk]
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.nullif(q(c).cast("double"), F.lit(float("nan"))).alias("v")) for c in cols]))
    long = df.select(*[q(k) for k in keys], item.alias("__i")).select(
        *[q(k) for k in keys], F.col("__i.c").alias("column_name"), F.col("__i.v").alias("__v"))
    counts = long.groupBy(*g, "__v").agg(F.count(F.lit(1)).alias("__all")).withColumn(
        "__c", F.when(F.col("__v").isNotNull(), F.col("__all")).otherwise(0))
    rows = sorted_parts(counts, gk, "__v", n_buckets)
    parts = part_totals(rows, gk, {"__t": "__c"})
    parts = parts.withColumn("__n", F.sum("__t").over(Window.partitionBy(*g)))
    asked = F.posexplode(F.array(*[F.lit(float(x)) for x in qs])).alias("pos", "__q")
    tg = parts.select(*g, "__p", "__t", "__t__off", "__n", asked).withColumn("__h", (F.col("__n") - 1) * F.col("__q"))
    tg = tg.select(*g, "__p", "__t", "__t__off", "pos", "__h", F.explode(F.array(F.floor("__h"), F.ceil("__h"))).alias("__at"))
    here = tg.filter((F.col("__at") >= F.col("__t__off")) & (F.col("__at") < F.col("__t__off") + F.col("__t")))
    here = here.select(*g, "__p", "pos", "__h", (F.col("__at") - F.col("__t__off")).alias("__r"))
    inside = Window.partitionBy(*g, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    held = join_keys(rows.filter(F.col("__c") > 0), here.select(*g, "__p").distinct(), [*gk, "__p"], "left_semi").withColumn("__cum", F.sum("__c").over(inside))
    j = join_keys(here, held.select(*g, "__p", "__v", "__c", "__cum"), [*gk, "__p"]).filter(
        (F.col("__r") < F.col("__cum")) & (F.col("__r") >= F.col("__cum") - F.col("__c")))
    out = j.groupBy(*g, "pos", "__h").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__up"))
    lo, up = F.floor("__h"), F.ceil("__h")
    val = F.when(lo == up, F.col("__lo")).otherwise((up - F.col("__h")) * F.col("__lo") + (F.col("__h") - lo) * F.col("__up"))
    none = (parts.filter("__n = 0").select(*g).distinct()
            .select(*g, F.explode(F.sequence(F.lit(0), F.lit(len(qs) - 1))).alias("pos"), F.lit(None).cast("double").alias("value")))
    return out.select(*g, F.col("pos").cast("int").alias("pos"), val.alias("value")).unionByName(none)


def exact_percentile_values(df: DataFrame, col: str, qs: list[float]) -> list:
    """Global exact percentiles as a Python list (len(qs) numbers reach the driver)."""
    rows = exact_percentiles(df, col, qs).collect()
    out = [None] * len(qs)
    for r in rows:
        out[r["pos"]] = r["value"]
    return out


def quantiles(df: DataFrame, cols: list[str], qs: list[float], by=None,
              approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """Exact (linear interpolation) or approximate quantiles, long form.

    Exact mode is ``percentiles_long`` (range-partitioned, no group's distinct
    values in one task); ``approx`` gives the one-pass sketch.
    """
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    qarr = F.array(*[F.lit(x) for x in qs])
    if not approx:
        return percentiles_long(df, cols, qs, keys or None).select(
            *[q(k) for k in keys], "column_name", qarr[F.col("pos")].alias("quantile"), "value")
    arr = qarr
    fn = lambda c: F.percentile_approx(q(c), arr, accuracy)
    g = df.groupBy(*[q(k) for k in keys]) if keys else df
    one = g.agg(*[fn(c).alias(f"q{i}") for i, c in enumerate(cols)])
    parts = []
    for i, c in enumerate(cols):
        parts.append(one.select(*[q(k) for k in keys], F.lit(c).alias("column_name"),
                                F.posexplode(f"q{i}").alias("pos", "value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    qarr = F.array(*[F.lit(x) for x in qs])
    return out.select(*[q(k) for k in keys], "column_name", qarr[F.col("pos")].alias("quantile"),
                      F.col("value").cast("double").alias("value"))


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = 1.5, by=None) -> DataFrame:
    """q1, q3, IQR and the factor*IQR fences per column (A14), exact and distributed."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    pc = percentiles_long(df, cols, [0.25, 0.75], keys or None)
    out = pc.groupBy(*[q(k) for k in keys], "column_name").agg(
        F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return out.select("*", iqr.alias("iqr"), (F.col("q1") - factor * iqr).alias("lower"),
                      (F.col("q3") + factor * iqr).alias("upper"))


def box_stats(df: DataFrame, group: str, col: str, factor: float = 1.5) -> DataFrame:
    """Box-plot summary per group.

    Quartiles per group (aggregate), joined back on the group to find the
    whisker ends (extreme values inside the fences) and the outlier count.
    """
    pc = percentiles_long(df, [col], [0.25, 0.5, 0.75], group)
    qs = pc.groupBy(q(group)).agg(*[F.max(F.when(F.col("pos") == i, F.col("value"))).alias(n)
                                    for i, n in enumerate(["q1", "median", "q3"])])
    qs = join_keys(qs, df.groupBy(q(group)).agg(F.count(q(col)).alias("n")), [group])
    iqr = F.col("q3") - F.col("q1")
    qs = qs.withColumn("lo_fence", F.col("q1") - factor * iqr).withColumn("hi_fence", F.col("q3") + factor * iqr)
    x = q(col)
    j = join_keys(df.select(q(group), x.alias("__x")).filter(F.col("__x").isNotNull()), qs, [group])
    inside = (F.col("__x") >= F.col("lo_fence")) & (F.col("__x") <= F.col("hi_fence"))
    return j.groupBy(q(group), "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_hi"),
        F.count(F.when(~inside, F.lit(1))).alias("n_outliers"))


def sturges_bins(n: int) -> int:
    import math
    return int(math.ceil(math.log2(n) + 1)) if n > 0 else 1


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed.

    The bounds (one row) are read first; every bin appears for every label,
    NULL included, empty ones with 0.
    """
    x = q(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()  # one row, used as literals
    lo, hi = F.lit(mm["lo"]).cast("double"), F.lit(mm["hi"]).cast("double")
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    b = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    keys = [q(by)] if by else []
    counts = df.filter(x.isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = (df.select(q(by)).distinct()
                .withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
                .select(q(by), F.col("__g").cast("int").alias("bin")))
    out = join_keys(grid, counts, [by, "bin"] if by else ["bin"], "left").fillna(0, subset=["n"])
    return out.select(*keys, "bin", (lo + F.col("bin") * width).alias("bin_lo"),
                      (lo + (F.col("bin") + 1) * width).alias("bin_hi"), F.col("n"))


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Mean of y per equal-width bin of x, right-closed bins.

    The edges are the listed values min + i * (max - min) / bins, the last one
    being the maximum; a value is in bin i when edge_i < x <= edge_{i+1}; the
    minimum itself falls outside every bin and is dropped, as with a
    right-closed cut.
    """
    import numpy as np

    xc = q(x).cast("double")
    mm = df.agg(F.min(xc).alias("lo"), F.max(xc).alias("hi")).first()  # one row, used as literals
    if mm["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, center double, width double, mean_y double, n bigint")
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(mm["lo"], mm["hi"], bins + 1)])
    b = F.size(F.filter(edges, lambda e: e < F.col("__x"))) - 1        # bins + 1 edges
    d = df.select(xc.alias("__x"), q(y).alias("__y")).filter(F.col("__x").isNotNull()).withColumn("bin", b).filter("bin >= 0")
    g = d.groupBy("bin").agg(F.avg("__y").alias("mean_y"), F.count(F.lit(1)).alias("n"))
    at = lambda i: F.element_at(edges, F.col("bin") + i)
    return g.select("bin", ((at(1) + at(2)) / 2).alias("center"), (at(2) - at(1)).alias("width"), "mean_y", "n")


def minmax_profile(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Group means rescaled to [0, 1] across groups (A29, radar data)."""
    m = group_means(df, group, cols)
    ext = m.agg(*[F.min(f"{c}_mean").alias(f"lo{i}") for i, c in enumerate(cols)],
                *[F.max(f"{c}_mean").alias(f"hi{i}") for i, c in enumerate(cols)]).first()  # one row
    out = m
    for i, c in enumerate(cols):
        lo, hi = F.lit(ext[f"lo{i}"]), F.lit(ext[f"hi{i}"])
        out = out.withColumn(f"{c}_scaled", F.try_divide(F.col(f"{c}_mean") - lo, hi - lo))
    return out


def monthly_counts(df: DataFrame, ts: str, drop_last: bool = True) -> DataFrame:
    """Counts per calendar month with empty months as 0.

    The month grid is generated between the first and last month (one row,
    read first); the last, incomplete month is dropped when asked.
    """
    m = F.date_trunc("month", q(ts)).cast("date")
    counts = df.groupBy(m.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    mm = df.agg(F.min(m).alias("lo"), F.max(m).alias("hi")).first()  # one row
    lo, hi = F.lit(mm["lo"]), F.lit(mm["hi"])
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("month"))
    out = grid.join(counts, "month", "left").fillna(0, subset=["n"])
    if drop_last:
        out = out.filter(F.col("month") < hi)
    return out


def conditional_counts(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """Counts of rows meeting each named condition, one pass."""
    return df.agg(*[F.count(F.when(c, F.lit(1))).alias(n) for n, c in conds.items()])
