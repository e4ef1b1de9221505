"""Sampling, splitting and rebalancing (P*).

Every random choice is a hash of the row key and a seed, so results do not
depend on partitioning, executor count or retries.  Exact per-class ranks use
hash-range buckets: xxhash64 is uniform, so buckets are balanced even when
one class holds most rows; offsets come from a small (class x bucket) table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shape import buckets_for, join_keys, q
from quarry.operators.rank import seeded_hash

_TWO64 = 18446744073709551616.0


def unit_hash(key, seed: int) -> Column:
    """Uniform value in [0, 1) from the key and seed."""
    return seeded_hash(key, seed).cast("double") / F.lit(_TWO64) + F.lit(0.5)


def hash_rank(df: DataFrame, key: str, seed: int, by=None, n_buckets: int | None = None,
              out: str = "hash_rank") -> DataFrame:
    """1-based rank of each row within ``by`` (NULL is a class) in seeded-hash order, exact."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    n_buckets = n_buckets or buckets_for(df)
    h = seeded_hash(key, seed)
    d = df.withColumn("__h", h).withColumn(
        "__b", F.least(F.floor(unit_hash(key, seed) * n_buckets), F.lit(n_buckets - 1)).cast("int"))
    bt = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    wb = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("__off", F.coalesce(F.sum("__n").over(wb), F.lit(0))).drop("__n")
    wi = Window.partitionBy(*keys, "__b").orderBy("__h", q(key))
    return (join_keys(d, bt, [*keys, "__b"]).withColumn(out, F.col("__off") + F.row_number().over(wi))
            .drop("__h", "__b", "__off"))


def sample_fraction(df: DataFrame, fraction: float, key, seed: int = 42,
                    cap: int | None = None) -> DataFrame:
    """Bernoulli sample by hash threshold, optional row cap in hash order."""
    keys = [key] if isinstance(key, str) else list(key)
    out = df.filter(unit_hash(keys, seed) < fraction)
    return out.orderBy(seeded_hash(keys, seed), *[q(k) for k in keys]).limit(cap) if cap else out


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all when fewer), the n smallest seeded hashes."""
    return df.orderBy(seeded_hash(key, seed), q(key)).limit(n)


HASH_SLICES = 1 << 12


def sample_per_class(df: DataFrame, target: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """The n rows of smallest seeded hash per class, NULL class included.

    Rows are counted by class and slice of the hash range; a class's slices up
    to the one in which it reaches n rows hold its sample.  Only rows of these
    slices (n and part of one slice per class) are ranked, so the table itself
    is neither ranked nor shuffled: its rows meet the classes' last slices in a
    join whose small side has one row per class.
    """
    slice_ = F.least(F.floor(unit_hash(key, seed) * HASH_SLICES), F.lit(HASH_SLICES - 1)).cast("int")
    counts = df.groupBy(q(target).alias("__class"), slice_.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__class").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter(F.col("__before") < n)
    last = needed.groupBy("__class").agg(F.max("__s").alias("__last"))
    near = df.withColumn("__s", slice_).join(last, q(target).eqNullSafe(F.col("__class"))).filter(F.col("__s") <= F.col("__last"))
    rank = F.row_number().over(Window.partitionBy(q(target)).orderBy(seeded_hash(key, seed), q(key)))
    return near.drop("__class", "__s", "__last").withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def undersample(df: DataFrame, target: str, key: str, ratio: float = 2.0, minority=1,
                seed: int = 42) -> DataFrame:
    """Keep every minority row and round(ratio * n_minority) majority rows.

    ``ratio`` is majority:minority (2 -> 2:1).  Rows without a target belong
    to neither side and stay.
    """
    n_min = df.filter(q(target) == F.lit(minority)).select(F.count(F.lit(1))).scalar()
    keep_n = F.round(n_min * F.lit(float(ratio)))
    maj = hash_rank(df.filter(q(target) != F.lit(minority)), key, seed)
    maj = maj.filter(F.col("hash_rank") <= keep_n).drop("hash_rank")
    return df.filter((q(target) == F.lit(minority)) | q(target).isNull()).unionByName(maj)


def random_split(df: DataFrame, key: str, fracs: list[float], seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Assign split indices by hash thresholds (P5, P8): 0..len(fracs)-1."""
    u = unit_hash(key, seed)
    edges, acc = [], 0.0
    for f in fracs[:-1]:
        acc += f
        edges.append(acc)
    expr = F.lit(len(fracs) - 1)
    for i in reversed(range(len(edges))):
        expr = F.when(u < F.lit(edges[i]), F.lit(i)).otherwise(expr)
    return df.withColumn(out, expr.cast("int"))


def stratified_split(df: DataFrame, target: str, key: str, train_frac: float = 0.8,
                     seed: int = 42, out: str = "is_train") -> DataFrame:
    """Per class, the first round(train_frac * n_class) rows in hash order are train."""
    counts = df.groupBy(q(target)).agg(F.count(F.lit(1)).alias("__nc"))
    r = join_keys(hash_rank(df, key, seed, by=target), counts, [target])
    r = r.withColumn(out, F.col("hash_rank") <= F.round(F.col("__nc") * F.lit(train_frac)))
    return r.drop("hash_rank", "__nc")


def kfold(df: DataFrame, k: int, key: str, seed: int = 42, stratify: str | None = None,
          out: str = "fold") -> DataFrame:
    """Fold ids 0..k-1 (P7); stratified folds deal each class round-robin in hash order."""
    if stratify is None:
        return df.withColumn(out, F.pmod(seeded_hash(key, seed), F.lit(k)).cast("int"))
    r = hash_rank(df, key, seed, by=stratify)
    return r.withColumn(out, F.pmod(F.col("hash_rank") - 1, F.lit(k)).cast("int")).drop("hash_rank")


def smote(df: DataFrame, vec: str, target: str, key: str, minority=1, ratio: float = 0.5,
          k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority oversampling.

    Target: n_minority_after = ratio * n_majority.  Each minority row makes
    floor(need / n_min) points, plus one for the first (need mod n_min) rows
    in hash order.  A point is x + u * (nn - x) with nn one of the k exact
    nearest minority neighbours and u in [0, 1), both from hashes.
    Returns the original rows plus the synthetic ones (``synthetic`` flag,
    ``source_key`` = the minority row a point was made from, key NULL).
    """
    from quarry.operators.joins import knn_join

    mino = df.filter(q(target) == F.lit(minority))
    n_min = mino.count()
    n_maj = df.filter(q(target) != F.lit(minority)).count()
    need = max(int(round(ratio * n_maj)) - n_min, 0)
    base = df.withColumn("synthetic", F.lit(False))
    if need == 0 or n_min < 2:
        return base.withColumn("source_key", F.lit(None).cast(dict(df.dtypes)[key]))
    per, extra = divmod(need, n_min)
    nn = knn_join(mino, mino, vec, k, key, key, exclude_self=True)
    ranked = hash_rank(mino.select(key, vec), key, seed)
    reps = ranked.withColumn("__m", F.lit(per) + (F.col("hash_rank") <= extra).cast("int"))
    gen = reps.filter("__m > 0").withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__m"))))
    kk = nn.groupBy(key).agg(F.max("rank").alias("__kk"))
    gen = gen.join(kk, key)
    pick = (F.pmod(F.xxhash64(q(key), F.col("__j"), F.lit(seed)), F.col("__kk")) + 1).cast("int")
    gen = gen.withColumn("rank", pick)
    gen = gen.join(nn.select(key, "rank", "nn_key"), [key, "rank"])
    other = mino.select(F.col(key).alias("nn_key"), F.col(vec).alias("__nv"))
    gen = gen.join(other, "nn_key")
    u = F.xxhash64(q(key), F.col("__j"), F.lit(seed + 1)).cast("double") / F.lit(_TWO64) + F.lit(0.5)
    gen = gen.withColumn("__u", u)
    newv = F.zip_with(F.col(vec).cast("array<double>"), F.col("__nv").cast("array<double>"),
                      lambda a, b: a + F.col("__u") * (b - a))
    synth = gen.select(F.col(key).alias("source_key"), newv.alias(vec),
                       F.lit(minority).cast(dict(df.dtypes)[target]).alias(target), F.lit(True).alias("synthetic"))
    return base.withColumn("source_key", F.lit(None).cast(dict(df.dtypes)[key])) \
        .unionByName(synth, allowMissingColumns=True)
