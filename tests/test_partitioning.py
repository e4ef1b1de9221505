"""Seeded operators give the same rows for 1 and 8 input partitions."""

from pyspark.sql import functions as F

from quarry.operators import rank, sample


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_seeded_ops_partition_invariant(spark):
    base = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"),
                                       (F.col("id") * 7 % 101).alias("v"))
    one, many = base.repartition(1), base.repartition(8)
    for f in [lambda d: sample.sample_n(d, 100, "k", 5),
              lambda d: sample.sample_fraction(d, 0.1, "k", 5),
              lambda d: sample.sample_per_class(d, "c", 50, "k", 5),
              lambda d: sample.stratified_split(d, "c", "k", 0.8, 5),
              lambda d: sample.kfold(d, 5, "k", 5, stratify="c"),
              lambda d: rank.one_per_category(d, "c", "k", 5),
              lambda d: sample.hash_rank(d, "k", 5, by="c", n_buckets=8)]:
        assert rows(f(one)) == rows(f(many))


def test_per_class_sample_and_split_sizes(spark):
    base = spark.range(0, 1000).select(F.col("id").alias("k"), F.when(F.col("id") < 900, 0).otherwise(1).alias("c"))
    s = sample.sample_per_class(base, "c", 60, "k")
    assert {r["c"]: r["count"] for r in s.groupBy("c").count().collect()} == {0: 60, 1: 60}
    sp = sample.stratified_split(base, "c", "k", 0.8)
    got = {(r["c"], r["is_train"]): r["count"] for r in sp.groupBy("c", "is_train").count().collect()}
    assert got == {(0, True): 720, (0, False): 180, (1, True): 80, (1, False): 20}
    u = sample.undersample(base, "c", "k", ratio=2.0, minority=1)
    assert {r["c"]: r["count"] for r in u.groupBy("c").count().collect()} == {0: 200, 1: 100}
