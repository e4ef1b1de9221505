"""Projection, filter, schema and set-shape operators (F*, U*).

Filters are plain predicates so Catalyst pushes them into the Parquet scan;
multi-column statistics are computed in one aggregate pass and only a single
row (or a column-name list) reaches the driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quarry.functions.columns import C, contains_ci, null_count


def q(name: str) -> Column:
    """Column by a name that may contain '-', '(', '.' etc."""
    return F.col(f"`{name}`")


# ---------------------------------------------------------------- F1-F8

def select_rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep the mapped columns, in mapping order, under their new names (F1)."""
    return df.select(*[q(src).alias(dst) for src, dst in mapping.items()])


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """Membership filter (F2); a single value is an equality filter."""
    if isinstance(values, (list, tuple, set)):
        return df.filter(q(col).isin(list(values)))
    return df.filter(q(col) == F.lit(values))


def filter_contains(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Case-folded substring filter, NULL -> false."""
    return df.filter(contains_ci(q(col), pattern))


def filter_between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Closed range filter."""
    return df.filter(q(col).between(F.lit(lo), F.lit(hi)))


def filter_recent_months(df: DataFrame, col: str, anchor: str, months: int) -> DataFrame:
    """Rows on or after anchor minus n calendar months."""
    start = F.add_months(F.to_date(F.lit(anchor)), -months)
    return df.filter(q(col) >= start.cast("timestamp_ntz"))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in subset (or any column)."""
    return df.na.drop(how="any", subset=subset)


def drop_incomplete(df: DataFrame, target: str, cls=0, cols: list[str] | None = None,
                    max_missing: int = 0) -> DataFrame:
    """Class-conditional completeness filter.

    Rows of class ``cls`` are kept only with at most ``max_missing`` NULLs
    among ``cols``; rows of other classes are always kept.
    """
    cols = cols or [c for c in df.columns if c != target]
    return df.filter((q(target) != F.lit(cls)) | (null_count([q(c) for c in cols]) <= max_missing))


# ---------------------------------------------------------------- completeness

def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: rows, non-null, null and non-null ratio, in one pass."""
    cols = cols or df.columns
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(q(c)).alias(f"nn{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', nn{i}" for i, c in enumerate(cols))
    long = one.selectExpr("__n", f"stack({len(cols)}, {pairs}) as (column_name, non_null)")
    return long.select(
        "column_name",
        F.col("__n").alias("n_rows"),
        F.col("non_null"),
        (F.col("__n") - F.col("non_null")).alias("n_null"),
        F.try_divide(F.col("non_null").cast("double"), F.col("__n").cast("double")).alias("non_null_ratio"),
    )


def sparse_report(df: DataFrame, min_ratio: float, strict: bool = False,
                  cols: list[str] | None = None) -> DataFrame:
    """Column keep/drop decisions by non-null ratio."""
    p = profile(df, cols)
    keep = (F.col("non_null_ratio") > min_ratio) if strict else (F.col("non_null_ratio") >= min_ratio)
    return p.withColumn("keep", F.coalesce(keep, F.lit(False)))


def prune_sparse(df: DataFrame, min_ratio: float, strict: bool = False) -> DataFrame:
    """Drop columns whose non-null ratio is under the bound.

    One aggregate pass; the driver receives one small row per column.
    """
    rep = sparse_report(df, min_ratio, strict).filter("keep").select("column_name").collect()
    keep = {r[0] for r in rep}
    return df.select(*[q(c) for c in df.columns if c in keep])


def all_null_columns(df: DataFrame) -> DataFrame:
    """Columns without a single value."""
    return profile(df).filter(F.col("non_null") == 0).select("column_name")


# ---------------------------------------------------------------- F11 dedup

def dedup_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key: the first by ``order_by``.

    Done as an aggregate (min_by over a struct), so a hot key is reduced
    map-side instead of landing whole in one window partition.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[q(c) for c in others])
    order = F.struct(*[q(c) for c in order_by])
    out = df.groupBy(*[q(k) for k in keys]).agg(F.min_by(packed, order).alias("__r"))
    return out.select(*[q(k) for k in keys], "__r.*").select(*[q(c) for c in df.columns])


# ---------------------------------------------------------------- F12/F13

# The characters a cleaned name keeps ([0-9a-zA-Z_], others become '_'),
# and the number of missing columns a strict alignment lists in its error (10).

def clean_name(name: str) -> str:
    return re.sub(r"[^0-9a-zA-Z_]", "_", name)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Replace every character outside [0-9a-zA-Z_] by '_' (F12); error on collision."""
    new = [clean_name(c) for c in df.columns]
    dup = sorted({n for n in new if new.count(n) > 1})
    if dup:
        raise ValueError(f"column names collide after cleaning: {dup}")
    return df.select(*[q(c).alias(n) for c, n in zip(df.columns, new)])


def align(df: DataFrame, expected: list[str], mode: str = "fill", id_col: str | None = None,
          fill_type: str = "double") -> DataFrame:
    """Reorder to ``expected``.

    ``fill``: extra columns dropped, missing ones added as NULL.
    ``strict``: the id column is ignored; missing columns raise, listing up to 10.
    The id column, when present, is kept first.
    """
    have = set(df.columns)
    feats = [c for c in expected if c != id_col]
    missing = [c for c in feats if c not in have]
    if mode == "strict" and missing:
        more = "" if len(missing) <= 10 else f" (+{len(missing) - 10} more)"
        raise ValueError(f"missing columns: {missing[:10]}{more}")
    cols = [q(c) if c in have else F.lit(None).cast(fill_type).alias(c) for c in feats]
    if id_col and id_col in have:
        cols = [q(id_col)] + cols
    return df.select(*cols)


# ---------------------------------------------------------------- F15

def compare_tables(left: DataFrame, right: DataFrame, approx: bool = False) -> DataFrame:
    """Column presence and per-column non-null / distinct counts of two tables.

    Values are counted in one aggregate pass per table, distinct ones by
    ``agg.distinct_counts``; both are long and full-outer joined on the name.
    """
    from quarry.operators.agg import distinct_counts

    def stats(df: DataFrame, side: str) -> DataFrame:
        present = profile(df).select("column_name", F.col("non_null").alias(f"{side}_non_null"))
        distinct = distinct_counts(df, df.columns, approx).select("column_name", F.col("n_distinct").alias(f"{side}_distinct"))
        return present.join(distinct, "column_name").withColumn(f"in_{side}", F.lit(True))

    j = stats(left, "left").join(stats(right, "right"), "column_name", "full_outer")
    return j.select(
        "column_name",
        F.coalesce("in_left", F.lit(False)).alias("in_left"),
        F.coalesce("in_right", F.lit(False)).alias("in_right"),
        "left_non_null", "left_distinct", "right_non_null", "right_distinct",
    )


# ---------------------------------------------------------------- value maps

def nullify(df: DataFrame, cols: list[str], values) -> DataFrame:
    """Replace sentinel values by NULL (F16)."""
    vals = list(values) if isinstance(values, (list, tuple, set)) else [values]
    return df.withColumns({c: F.when(q(c).isin(vals), F.lit(None)).otherwise(q(c)) for c in cols})


def map_values(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Dictionary map; unmapped -> NULL (F17).  The map is a literal (bounded)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out or col, m[q(col)])


def map_flags(df: DataFrame, col: str, mapping: DataFrame, key: str,
              on_missing: str = "error") -> DataFrame:
    """Join a small mapping table that turns one code into several columns.

    The mapping table is caller-supplied and bounded; Spark broadcasts it when
    its measured size is under the broadcast threshold.  Unmapped codes raise
    (``error``) or give NULL flags (``null``).
    """
    flag_cols = [c for c in mapping.columns if c != key]
    m = mapping.withColumn("__hit", F.lit(True))
    j = df.join(m, q(col) == m[key], "left").drop(m[key])
    if on_missing == "error":
        j = j.withColumn("__chk", F.assert_true(q(col).isNull() | F.col("__hit").isNotNull(),
                                               F.concat(F.lit("unmapped value: "), q(col).cast("string"))))
        j = j.filter(F.col("__chk").isNull())
        j = j.drop("__chk")
    return j.drop("__hit").select(*[q(c) for c in df.columns], *[q(c) for c in flag_cols])


def bools_to_int(df: DataFrame) -> DataFrame:
    """Cast every boolean column to int."""
    return df.select(*[q(f.name).cast("int").alias(f.name) if isinstance(f.dataType, BooleanType)
                       else q(f.name) for f in df.schema.fields])


def parse_timestamp(col, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Parse text to TIMESTAMP_NTZ, unparseable -> NULL."""
    return F.try_to_timestamp(C(col), F.lit(fmt)).cast("timestamp_ntz")


def fill_with_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill NULLs with the column mean (F32/I3); the means are one scalar subquery row."""
    means = df.agg(*[F.avg(q(c)).alias(c) for c in cols])
    return df.withColumns({c: F.coalesce(q(c), means.select(q(c)).scalar()) for c in cols})


# ---------------------------------------------------------------- U1-U3

def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Concatenate row sets by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Column-wise concatenation by key, never by position."""
    return left.join(right, key, "inner")


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "variable",
         value: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot([q(i) for i in ids], [q(v) for v in values], var, value)


def id_first(df: DataFrame, id_col: str) -> DataFrame:
    """Move the id column to the front."""
    return df.select(q(id_col), *[q(c) for c in df.columns if c != id_col])


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the keys of ``left`` stay."""
    r = right.select(*[q(c).alias(f"__k{keys.index(c)}") if c in keys else q(c) for c in right.columns])
    cond = None
    for i, k in enumerate(keys):
        one = q(k).eqNullSafe(F.col(f"__k{i}"))
        cond = one if cond is None else cond & one
    return left.join(r, cond, how).drop(*[f"__k{i}" for i in range(len(keys))])


def buckets_for(df: DataFrame) -> int:
    """Number of hash buckets: one per shuffle partition of the session (at least 8)."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
