"""Missing-value imputation and outlier handling (I*, O*).

Group statistics are aggregates joined back on the group key (AQE splits a
hot group's partition on the join), not windows that would put a hot group
into one task.  Global statistics are scalar subqueries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shape import join_keys, q
from quarry.session import cut_lineage


def fill_group_mean(df: DataFrame, col: str, group: str, out: str | None = None) -> DataFrame:
    """Fill NULLs with the mean of the row's group; a NULL group stays unfilled."""
    means = df.filter(q(group).isNotNull()).groupBy(q(group).alias("__g")).agg(F.avg(q(col)).alias("__m"))
    j = df.join(means, q(group) == F.col("__g"), "left")
    return j.withColumn(out or col, F.coalesce(q(col), F.col("__m"))).drop("__g", "__m")


def fill_cascade(df: DataFrame, col: str, groups: list[str]) -> DataFrame:
    """Group-mean fill from the finest to the coarsest group.

    Each level's means are computed on the column as filled by the previous
    levels.
    """
    cell = [f"__g{i}" for i in range(len(groups))]
    cells = df.groupBy(*[q(g).alias(c) for g, c in zip(groups, cell)]).agg(
        F.coalesce(F.sum(q(col)), F.lit(0)).cast("double").alias("__s"), F.count(q(col)).alias("__n"),
        F.count(F.when(q(col).isNull(), 1)).alias("__miss")).withColumn("__fill", F.lit(None).cast("double"))
    # The cells (distinct group combinations) stand for the rows: a level's mean over the
    # column as filled so far is a sum over cells, so the table itself is read twice in all.
    for c in cell:
        level = Window.partitionBy(c)
        mean = F.when(F.col(c).isNotNull(), F.try_divide(F.sum("__s").over(level), F.sum("__n").over(level)))
        cells = cells.withColumn("__m", mean)
        fills = F.col("__fill").isNull() & F.col("__m").isNotNull()
        cells = (cells.withColumn("__s", F.when(fills, F.col("__s") + F.col("__miss") * F.col("__m")).otherwise(F.col("__s")))
                 .withColumn("__n", F.when(fills, F.col("__n") + F.col("__miss")).otherwise(F.col("__n")))
                 .withColumn("__fill", F.coalesce("__fill", "__m")))
    keyed = df.select(*[q(c) for c in df.columns], *[q(g).alias(c) for g, c in zip(groups, cell)])
    j = join_keys(keyed, cells.select(*cell, "__fill"), cell, "left")
    return j.withColumn(col, F.coalesce(q(col), F.col("__fill"))).drop("__fill", *cell)


def fill_mean(df: DataFrame, cols: list[str], strategy: str = "mean") -> DataFrame:
    """Mean or (exact) median fill (I3); the median is the bucketed percentile, no task holds a column's values."""
    if strategy == "mean":
        stats = df.agg(*[F.avg(q(c)).alias(c) for c in cols]).first().asDict()  # one row
    else:
        from quarry.operators.agg import percentiles_long
        stats = {r["column_name"]: r["value"] for r in percentiles_long(df, cols, [0.5]).collect()}  # one number a column
    return df.withColumns({c: F.coalesce(q(c), F.lit(stats[c])) for c in cols})


def fill_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Fill y from a least-squares line on x where y is NULL (I4)."""
    fit = df.agg(F.regr_slope(q(y), q(x)).alias("b"), F.regr_intercept(q(y), q(x)).alias("a")).first()
    return df.withColumn(y, F.coalesce(q(y), F.lit(fit["a"]) + F.lit(fit["b"]) * q(x)))


def fill_knn(df: DataFrame, col: str, vec: str, key: str, k: int = 5, nan_aware: bool = False) -> DataFrame:
    """Fill NULLs of ``col`` with the plain mean of the k nearest donors.

    Donors are rows with a value; distances on the feature vector are exact
    (see ``knn_join``).  With ``nan_aware`` the vector may hold NULLs and the
    NaN-aware Euclidean distance of the reference imputer is used; a receiver
    without any donor at a defined distance falls back to the column mean.
    """
    from quarry.operators.joins import knn_join
    donors = df.filter(q(col).isNotNull())
    recv = df.filter(q(col).isNull())
    nn = knn_join(recv, donors, vec, k, key, key, metric="nan_euclidean" if nan_aware else "euclidean")
    dv = donors.select(F.col(key).alias("nn_key"), q(col).alias("__y"))
    fill = nn.join(dv, "nn_key").groupBy(key).agg(F.avg("__y").alias("__fill"))
    out = df.join(fill, key, "left")
    if nan_aware:
        mean = df.select(F.avg(q(col))).first()[0]  # one value
        out = out.withColumn("__fill", F.coalesce("__fill", F.lit(mean)))
    return out.withColumn(col, F.coalesce(q(col), F.col("__fill"))).drop("__fill")


def knn_rmse_curve(train: DataFrame, test: DataFrame, col: str, vec: str, key: str,
                   max_k: int = 30) -> DataFrame:
    """Hold-out RMSE of k-NN prediction for k = 1..max_k from one neighbour search."""
    from pyspark.sql import Window

    from quarry.operators.joins import knn_join
    nn = knn_join(test, train, vec, max_k, key, key)
    tv = train.select(F.col(key).alias("nn_key"), q(col).alias("__y"))
    j = nn.join(tv, "nn_key")
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("__pred", F.avg("__y").over(w))
    truth = test.select(q(key), q(col).alias("__t"))
    e = j.join(truth, key)
    return e.groupBy(F.col("rank").alias("k")).agg(
        F.sqrt(F.avg(F.pow(F.col("__pred") - F.col("__t"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n"))


MAX_PATTERN_BYTES = 64 << 20


def fill_iterative(df: DataFrame, cols: list[str], rounds: int = 10, ridge: float = 1e-6,
                   tol: float = 1e-3) -> DataFrame:
    """Round-robin linear-regression fill, like an iterative imputer.

    Start from column means; each round regresses every column with missing
    values on the others over the rows where it was observed and refreshes its
    filled values, until the coefficients change by less than ``tol``.

    Two scans of the table, whatever the rounds.  Rows with the same missing
    columns (a pattern) get fills that are one affine function of their observed
    values, so a round needs the patterns' sums of squares and products only,
    not the rows: the first scan adds up one (d+1) x (d+1) matrix per pattern,
    the rounds run on these matrices, and the second scan applies each pattern's
    function.  The matrices' size is checked.  NULL and NaN are missing.
    """
    d = len(cols)
    grams = _pattern_grams(df, cols)
    total = sum(g for g in grams.values())
    if not len(grams):
        return df
    seen = {c: sum(g[0, 0] for p, g in grams.items() if not p[i]) for i, c in enumerate(cols)}
    means = [total[0, i + 1] / seen[c] if seen[c] else 0.0 for i, c in enumerate(cols)]
    # T[p]: the full row (1, x_1 .. x_d) from the observed one, in which missing values are 0
    T = {}
    for p in grams:
        T[p] = np.eye(d + 1)
        for i in np.flatnonzero(p):
            T[p][i + 1] = 0.0
            T[p][i + 1, 0] = means[i]
    todo = [i for i, c in enumerate(cols) if seen[c] < total[0, 0] and seen[c] and d > 1]
    before: dict = {}
    for _ in range(rounds):
        change = 0.0
        for i in todo:
            full = sum(T[p] @ g @ T[p].T for p, g in grams.items() if not p[i])          # rows where column i is observed
            rest = [j for j in range(d + 1) if j != i + 1]
            beta = np.linalg.solve(full[np.ix_(rest, rest)] + ridge * np.eye(d), full[rest, i + 1])
            change = max(change, float(np.max(np.abs(beta - before[i]))) if i in before else np.inf)
            before[i] = beta
            for p in grams:
                if p[i]:
                    T[p][i + 1] = beta @ T[p][rest]
        if change < tol:
            break
    return _apply_patterns(df, cols, [i for i, c in enumerate(cols) if seen[c] < total[0, 0] and seen[c]], T)


def _pattern(cols: list[str]):
    """'1' for a missing value and '0' for another, column by column."""
    return F.concat(*[F.when(q(c).cast("double").isNull() | F.isnan(q(c).cast("double")), "1").otherwise("0") for c in cols])


def _pattern_grams(df: DataFrame, cols: list[str]) -> dict[tuple, np.ndarray]:
    """Per pattern of missing columns the sum of (1, x)(1, x)^T over its rows, missing values as 0."""
    from quarry.operators.gram import matrix, numbers

    d = len(cols)

    def products(batches):
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch)
            gone = np.isnan(x)
            x = np.hstack([np.ones((len(x), 1)), np.where(gone, 0.0, x)])
            kinds, which = np.unique(gone, axis=0, return_inverse=True)
            for k, kind in enumerate(kinds):
                own = x[which.ravel() == k]
                key = kind.tobytes()
                held[key] = held.get(key, 0.0) + own.T @ own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([g.tobytes() for g in held.values()], pa.binary())], names=["pattern", "gram"])

    def add(key, table):
        total = sum(np.frombuffer(g, np.float64) for g in table.column("gram").to_pylist())
        return pa.table({"pattern": pa.array([key[0].as_py()], pa.binary()), "gram": pa.array([total.tobytes()], pa.binary())})

    schema = "pattern binary, gram binary"
    parts = numbers(df, cols).mapInArrow(products, schema)
    salted = parts.groupBy("pattern", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).applyInArrow(add, schema)
    sums = cut_lineage(salted.groupBy("pattern").applyInArrow(add, schema))
    if (size := sums.count() * (d + 1) ** 2 * 8) > MAX_PATTERN_BYTES:
        raise ValueError(f"{size} bytes of pattern sums exceed {MAX_PATTERN_BYTES}; fill fewer columns at a time")
    return {tuple(np.frombuffer(r.pattern, bool).tolist()): np.frombuffer(r.gram, np.float64).reshape(d + 1, d + 1) for r in sums.collect()}  # size checked


def _apply_patterns(df: DataFrame, cols: list[str], filled: list[int], T: dict[tuple, np.ndarray]) -> DataFrame:
    """``df`` with the missing values of the ``filled`` columns from their pattern's row of ``T``."""
    rows = [("".join("01"[m] for m in p), [[float(v) for v in m_[i + 1]] for i in filled]) for p, m_ in T.items() if any(p)]
    if not rows or not filled:
        return df
    table = df.sparkSession.createDataFrame(rows, "__pattern string, __t array<array<double>>")
    present = F.array(F.lit(1.0), *[F.coalesce(F.nanvl(q(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols])
    j = df.withColumns({"__mine": _pattern(cols), "__x": present}).join(F.broadcast(table), F.col("__mine") == F.col("__pattern"), "left")  # size checked
    new = {}
    for k, i in enumerate(filled):
        value = F.aggregate(F.zip_with(F.col("__t")[k], F.col("__x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        missing = F.substring("__mine", i + 1, 1) == "1"
        new[cols[i]] = F.when(missing, value).otherwise(q(cols[i]).cast("double"))
    return j.withColumns(new).drop("__mine", "__x", "__pattern", "__t")


# ---------------------------------------------------------------- outliers

def _iqr_bounds_row(df: DataFrame, cols: list[str], factor: float):
    from quarry.operators.agg import percentiles_long
    got = {(r["column_name"], r["pos"]): r["value"]
           for r in percentiles_long(df, cols, [0.25, 0.75]).collect()}  # two numbers per column
    out = {}
    for c in cols:
        q1, q3 = got[(c, 0)], got[(c, 1)]
        if q1 is None:  # no values: nothing lies outside
            out[c] = (None, None)
            continue
        out[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def iqr_filter(df: DataFrame, cols: list[str], factor: float = 1.5, keep_null: bool = True) -> DataFrame:
    """Drop rows outside [q1 - f*IQR, q3 + f*IQR] on any column; bounds from the input (O1).

    NULLs are kept (``keep_null``) or dropped.
    """
    bounds = _iqr_bounds_row(df, cols, factor)
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        inside = q(c).between(lo, hi)
        cond = cond & ((q(c).isNull() | inside) if keep_null else F.coalesce(inside, F.lit(False)))
    return df.filter(cond)


def iqr_filter_sequential(df: DataFrame, cols: list[str], factor: float = 1.5) -> DataFrame:
    """Column by column: bounds from the already filtered table, NULLs dropped (O2)."""
    for c in cols:
        df = iqr_filter(df, [c], factor, keep_null=False)
    return df


def quantile_filter(df: DataFrame, col: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Keep rows between two quantiles of a column, inclusive (O3)."""
    from quarry.operators.agg import exact_percentile_values
    arr = exact_percentile_values(df, col, [lo, hi])  # two values
    return df.filter(q(col).between(F.lit(arr[0]), F.lit(arr[1])))


def outlier_counts(df: DataFrame, cols: list[str], factor: float = 1.5) -> DataFrame:
    """Outliers per column under the IQR rule, long form."""
    bounds = _iqr_bounds_row(df, cols, factor)
    one = df.agg(*[F.count(F.when(~q(c).between(lo, hi), 1)).alias(f"o{i}")
                   for i, (c, (lo, hi)) in enumerate(bounds.items())])
    pairs = ", ".join(f"'{c}', o{i}" for i, c in enumerate(bounds))
    return one.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, n_outliers)")
