"""Encoding and scaling fitted on one table and applied to another (E*).

A fit returns a DataFrame of statistics or levels.  Level codes and encodings
are applied by a join on the level, which the runtime broadcasts when the
levels measure small and shuffles otherwise; there is no cap on levels.  Only
one-hot encoding takes its levels to the driver, since they become columns,
and limits them to ``max_levels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shape import q
from quarry.session import cut_lineage

NAN_LEVEL = "NaN"


def _pairs(df: DataFrame, cols: list[str], missing_as: str | None, *more):
    """One (column_name, level, further columns) row per row and column with a level, from one scan."""
    def level(c):
        v = q(c).cast("string")
        return v if missing_as is None else F.coalesce(v, F.lit(missing_as))

    item = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), level(c).alias("level")) for c in cols])).alias("__e")
    wide = df.select(*more, item)
    return wide.select("__e.*", *[c for c in wide.columns if c != "__e"]).filter(F.col("level").isNotNull())


def _levels_long(df: DataFrame, cols: list[str], missing_as: str | None) -> DataFrame:
    return _codes(_pairs(df, cols, missing_as).distinct())


def _codes(levels: DataFrame) -> DataFrame:
    """Append ``code``, the position of each distinct level among its column's levels by code point.

    A range-partitioned sort numbers the rows of each partition; the offsets
    come from one count per partition and column, so no task sorts a whole
    column.
    """
    rows = cut_lineage(levels.orderBy("column_name", "level").withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select("column_name", "level", part.alias("__p"), place.alias("__i"))
    size = rows.groupBy("column_name", "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = Window.partitionBy("column_name").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    return rows.join(size, ["column_name", "__p"]).select("column_name", "level", (F.col("__off") + F.col("__i")).cast("int").alias("code"))


def fit_label_encoder(df: DataFrame, cols: list[str], nan_as_category: bool = True) -> DataFrame:
    """Codes = position of the level among the sorted distinct levels.

    Missing becomes the ordinary level 'NaN' and sorts by code point like any other.
    """
    return _levels_long(df, cols, NAN_LEVEL if nan_as_category else None)


def fit_ordinal_encoder(df: DataFrame, cols: list[str]) -> DataFrame:
    """Like the label encoder without a missing level; NULL stays NULL."""
    return _levels_long(df, cols, None)


def _collect_levels(levels: DataFrame, max_levels: int) -> dict[str, list[tuple[str, int]]]:
    n = levels.count()
    if n > max_levels:
        raise ValueError(f"{n} levels exceed max_levels={max_levels}")
    out: dict[str, list[tuple[str, int]]] = {}
    for r in levels.orderBy("column_name", "code").collect():
        out.setdefault(r["column_name"], []).append((r["level"], r["code"]))
    return out


def _columns(levels: DataFrame) -> list[str]:
    """The encoded columns (their names are bounded by the table's width)."""
    return sorted(r[0] for r in levels.select("column_name").distinct().collect())


def apply_codes(df: DataFrame, levels: DataFrame, missing_as: str | None = NAN_LEVEL) -> DataFrame:
    """Replace each encoded column by its integer code; unseen levels -> NULL."""
    order = df.columns
    for c in _columns(levels):
        v = q(c).cast("string")
        if missing_as is not None:
            v = F.coalesce(v, F.lit(missing_as))
        lv = levels.filter(F.col("column_name") == c).select(F.col("level").alias("__level"), F.col("code").alias("__code"))
        df = df.withColumn("__v", v).join(lv, F.col("__v") == F.col("__level"), "left").withColumn(c, F.col("__code"))
        df = df.drop("__v", "__level", "__code")
    return df.select(*[q(c) for c in order])


def fit_one_hot(df: DataFrame, cols: list[str]) -> DataFrame:
    return _levels_long(df, cols, None)


def apply_one_hot(df: DataFrame, levels: DataFrame, dummy_na: bool = True,
                  max_levels: int = 10000, drop: bool = True) -> DataFrame:
    """One column ``COL_level`` per fitted level (1/0) plus ``COL_nan``."""
    lv = _collect_levels(levels, max_levels)
    new = {}
    for c, pairs in lv.items():
        for lvl, _ in pairs:
            new[f"{c}_{lvl}"] = F.coalesce((q(c).cast("string") == F.lit(lvl)).cast("int"), F.lit(0))
        if dummy_na:
            new[f"{c}_nan"] = q(c).isNull().cast("int")
    out = df.withColumns(new)
    return out.drop(*lv.keys()) if drop else out


def fit_target_encoder(df: DataFrame, cols: list[str], target: str, min_samples_leaf: int = 20,
                       smoothing: float = 10.0) -> DataFrame:
    """Smoothed target mean per level.

    enc = prior * (1 - s) + mean * s with s = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing));
    a level seen once gets the prior.  Unseen or missing levels get the prior.
    """
    prior = F.lit(df.select(F.avg(q(target))).first()[0])  # one value
    out = _pairs(df, cols, None, q(target).alias("__y")).groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"))
    s = 1.0 / (1.0 + F.exp(-(F.col("n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
    enc = F.when(F.col("n") == 1, prior).otherwise(prior * (1 - s) + F.col("mean") * s)
    return out.select("column_name", "level", "n", enc.alias("encoding"), prior.alias("prior"))


def apply_target_encoder(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Replace each encoded column by its level's encoding; unseen or missing levels get the prior."""
    order, first = df.columns, stats.select("prior").first()  # one value
    for c in _columns(stats):
        lv = stats.filter(F.col("column_name") == c).select(F.col("level").alias("__level"), F.col("encoding").alias("__enc"))
        df = df.withColumn("__v", q(c).cast("string")).join(lv, F.col("__v") == F.col("__level"), "left")
        df = df.withColumn(c, F.coalesce("__enc", F.lit(first["prior"]))).drop("__v", "__level", "__enc")
    return df.select(*[q(c) for c in order])


def fit_standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std per column, one row."""
    return df.agg(*[F.avg(q(c)).alias(f"{c}__mean") for c in cols],
                  *[F.stddev_pop(q(c)).alias(f"{c}__std") for c in cols])


def apply_standard(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / std; a zero std scales by 1 (as the reference scaler)."""
    row = stats.first()
    repl = {}
    for c in cols:
        m, s = row[f"{c}__mean"], row[f"{c}__std"]
        s = 1.0 if not s else s
        repl[c] = (q(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(repl)


def fit_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.min(q(c)).alias(f"{c}__min") for c in cols], *[F.max(q(c)).alias(f"{c}__max") for c in cols])


def apply_minmax(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column scales by 1."""
    row = stats.first()
    repl = {}
    for c in cols:
        lo, hi = row[f"{c}__min"], row[f"{c}__max"]
        rng = (hi - lo) if hi is not None and lo is not None and hi != lo else 1.0
        repl[c] = (q(c) - F.lit(lo)) / F.lit(float(rng))
    return df.withColumns(repl)


class Preprocessor:
    """Column-wise preprocessing fitted on one table, applied to another.

    Ordinal columns become codes (unseen or missing: -1), target-encoded ones
    their smoothed target mean, scaled ones (x - mean) / population std; the
    rest passes through.  ``transform`` appends them as one array, in that
    order.
    """

    def __init__(self, ordinal=(), target_encoded=(), scaled=(), passthrough=(), out: str = "features"):
        self.ordinal, self.target_encoded, self.scaled = list(ordinal), list(target_encoded), list(scaled)
        self.passthrough, self.out = list(passthrough), out

    def fit(self, df: DataFrame, target: str | None = None) -> "Preprocessor":
        self.levels = fit_ordinal_encoder(df, self.ordinal) if self.ordinal else None
        self.means = cut_lineage(fit_target_encoder(df, self.target_encoded, target)) if self.target_encoded else None
        self.stats = cut_lineage(fit_standard(df, self.scaled)) if self.scaled else None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        parts = [*self.ordinal, *self.target_encoded, *self.scaled, *self.passthrough]
        x = df.select(*[q(c) for c in df.columns], *[q(c).alias(f"__f_{c}") for c in parts])
        name = {c: f"__f_{c}" for c in parts}
        rename = lambda t: t.withColumn("column_name", F.concat(F.lit("__f_"), "column_name"))
        if self.levels is not None:
            x = apply_codes(x, rename(self.levels), None)
        if self.means is not None:
            x = apply_target_encoder(x, rename(self.means))
        if self.stats is not None:
            x = apply_standard(x, self.stats.toDF(*[f"__f_{c}" for c in self.stats.columns]), [name[c] for c in self.scaled])
        vals = [F.coalesce(q(name[c]).cast("double"), F.lit(-1.0)) if c in self.ordinal else q(name[c]).cast("double") for c in parts]
        return x.withColumn(self.out, F.array(*vals)).drop(*name.values())
