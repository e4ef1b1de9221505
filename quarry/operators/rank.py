"""Ranking, binning, ordering and window-shaped operators (W*, T*).

No operator here orders row-level data through a single unpartitioned
window.  Ranks are computed over per-value counts (a hot value collapses to
one row), range-partitioned so each part is sorted in its own task, with the
parts' starts taken from a small table of totals (``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import running, sorted_parts
from quarry.operators.shape import join_keys, q


def _keys(by) -> list[str]:
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def rank_table(df: DataFrame, col: str, by=None, weights: dict[str, Column] | None = None,
               n_buckets: int | None = None, cumulative: bool = False) -> DataFrame:
    """Distinct (by, value) rows with count, summed weights and average-tie rank.

    ``rank`` is 1-based within ``by`` (NULL is a group like any other) and
    averages tied positions.  Only values that are neither NULL nor NaN are
    ranked.  With ``cumulative``, ``cum_<weight>`` holds the running sum of
    each weight over all values <= this one.  ``n_buckets`` fixes the number of
    range partitions; the result does not depend on it.
    """
    keys = _keys(by)
    weights = weights or {}
    v = q(col)
    present = v.isNotNull()
    if dict(df.dtypes).get(col) in ("double", "float"):
        present = present & ~F.isnan(v)
    base = df.filter(present).select(*[q(k) for k in keys], v.alias("__v"), *[w.alias(n) for n, w in weights.items()])
    cnt = base.groupBy(*[q(k) for k in keys], "__v").agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(n).alias(n) for n in weights])
    sums = {"__cum": "cnt"} | ({f"cum_{n}": n for n in weights} if cumulative else {})
    r = running(sorted_parts(cnt, keys, "__v", n_buckets), keys, "__v", sums)
    rank = F.col("__cum") - F.col("cnt") + (F.col("cnt") + 1) / 2.0
    return r.select(*[q(k) for k in keys], F.col("__v").alias(col), "cnt", *weights.keys(), rank.cast("double").alias("rank"),
                    *[c for c in sums if c != "__cum"])


def avg_rank(df: DataFrame, col: str, by=None, out: str | None = None,
             n_buckets: int | None = None) -> DataFrame:
    """Append the average-tie rank of ``col`` (within ``by``) to every row (W3); missing values get NULL."""
    keys = _keys(by)
    rt = rank_table(df, col, by, n_buckets=n_buckets).select(*[q(k) for k in keys], q(col), F.col("rank").alias(out or f"{col}_rank"))
    return join_keys(df, rt, [*keys, col], "left")


def qcut(df: DataFrame, col: str, q_: int, labels: list | None = None, out: str | None = None,
         edges: list | None = None) -> DataFrame:
    """Quantile binning with exact (interpolated) edges, ties share a bin.

    Bins are right-closed, the first includes the minimum; duplicate edges
    raise, as ``pd.qcut`` does.  The q+1 edges are computed in one pass
    (or passed in) and inlined as literals.
    """
    labels = labels if labels is not None else list(range(q_))
    if edges is None:
        from quarry.operators.agg import exact_percentile_values
        vals = exact_percentile_values(df, col, [i / q_ for i in range(q_ + 1)])  # q_ + 1 numbers
        edges = None if vals[0] is None else vals
    if edges is None:
        return df.withColumn(out or f"{col}_bin", F.lit(None))
    if len(set(edges)) != q_ + 1:
        raise ValueError(f"duplicate bin edges: {edges}")
    x = q(col)
    expr = None
    for i in range(q_):
        cond = x <= F.lit(float(edges[i + 1]))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return df.withColumn(out or f"{col}_bin", F.when(x.isNotNull(), expr))


def cut(df: DataFrame, col: str, edges: list, labels: list | None = None, out: str | None = None) -> DataFrame:
    """Fixed-edge binning, right-closed (a, b]; outside values -> NULL."""
    labels = labels if labels is not None else list(range(len(edges) - 1))
    x = q(col)
    expr = None
    for i in range(len(edges) - 1):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return df.withColumn(out or f"{col}_bin", expr)


def seeded_hash(key_cols, seed: int) -> Column:
    cols = [q(k) for k in ([key_cols] if isinstance(key_cols, str) else key_cols)]
    return F.xxhash64(*cols, F.lit(seed))


def one_per_category(df: DataFrame, category: str, key, seed: int = 42) -> DataFrame:
    """One seeded row per category (W4), as an aggregate (hot categories combine map-side).

    ``key`` names the columns that tell rows apart; all columns break what ties remain.
    """
    packed = F.struct(*[q(c) for c in df.columns])
    keys = [key] if isinstance(key, str) else list(key)
    order = F.struct(seeded_hash(keys, seed), *[q(k) for k in keys], F.xxhash64(*[q(c) for c in df.columns]))
    return df.groupBy(q(category)).agg(F.min_by(packed, order).alias("__r")).select("__r.*")


def cumulative_share(df: DataFrame, order_col: str, value_col: str, threshold: float | None = None) -> DataFrame:
    """Cumulative share of a value along an order on a small (k-row) table.

    With a threshold, flags the first row whose cumulative share reaches it
    (NULL everywhere if none does). Lazy: the total and the first index are
    whole-table windows, so the source plan runs once.
    """
    run = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    out = df.withColumn("cum_share", F.sum(value_col).over(run) / F.sum(value_col).over(whole))
    if threshold is not None:
        first = F.min(F.when(F.col("cum_share") >= threshold, F.col(order_col))).over(whole)
        out = out.withColumn("reaches", F.col(order_col) == first)
    return out


def running_best(df: DataFrame, order_col: str, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Previous best and a new-best marker across trials (W7); runs tables are small."""
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    prev = (F.max if higher_is_better else F.min)(metric).over(w)
    better = (F.col(metric) > F.col("prev_best")) if higher_is_better else (F.col(metric) < F.col("prev_best"))
    return (df.withColumn("prev_best", prev)
            .withColumn("is_new_best", F.col("prev_best").isNull() | F.coalesce(better, F.lit(False))))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Top-n by a full ordering (T2): per-partition top-n then a merge of n rows each."""
    return df.orderBy(*order).limit(n)


def order_by_abs(df: DataFrame, col: str, desc: bool = True, tie: str | None = None) -> DataFrame:
    a = F.abs(q(col))
    o = [a.desc() if desc else a.asc()]
    if tie:
        o.append(q(tie))
    return df.orderBy(*o)


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Order by a hash of key and seed: same result for any partitioning (T4)."""
    return df.orderBy(seeded_hash(key, seed), q(key))


def arg_best(df: DataFrame, metric: str, cols: list[str], minimize: bool = True) -> DataFrame:
    """The row with the lowest (or highest) metric (T5); of ties the first by ``cols``.

    A row without a metric (NULL or NaN) is never the best.
    """
    packed = F.struct(*[q(c) for c in cols])
    m = F.nullif(q(metric).cast("double"), F.lit(float("nan")))
    best = df.agg((F.min if minimize else F.max)(m)).first()[0]         # one value
    return df.filter(m == F.lit(best)).agg(F.min(packed).alias("__r")).select("__r.*")
