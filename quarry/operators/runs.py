"""Append-only table of runs: one trial with its parameters and metrics per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "trial string, params map<string,string>, metrics map<string,double>"


def log_runs(runs: DataFrame, path: str) -> None:
    """Append runs(trial, params, metrics) to the table at ``path``, with the time of the append.

    Nothing is rewritten: a trial that is appended again (a job that runs twice)
    has several rows in the files and one in ``read_runs``.
    """
    kept = runs.select(F.col("trial").cast("string"), F.col("params").cast("map<string,string>"), F.col("metrics").cast("map<string,double>"))
    kept.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs logged at ``path``: one row a trial, as appended last."""
    rows = spark.read.schema(RUNS + ", logged_at timestamp").parquet(path)
    last = F.max_by(F.struct("params", "metrics"), F.col("logged_at")).alias("last")
    return rows.groupBy("trial").agg(last).select("trial", "last.params", "last.metrics")


def compare_runs(runs: DataFrame, metric: str, params: list[str], higher_is_better: bool = True) -> DataFrame:
    """trial, the named parameters, the metric, its place among the runs (ties share one) and whether it is the best.

    Runs without the metric come last and are never the best.  A runs table is small.
    """
    value = F.col("metrics")[metric]
    best = runs.select((F.max if higher_is_better else F.min)(value)).scalar()
    t = runs.select("trial", *[F.col("params")[p].alias(p) for p in params], value.alias(metric))
    others = t.groupBy(F.col(metric).alias("__o")).agg(F.count(F.lit(1)).alias("__c"))
    ahead = Window.orderBy(F.col("__o").desc_nulls_last() if higher_is_better else F.col("__o").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    place = others.withColumn("place", F.coalesce(F.sum("__c").over(ahead), F.lit(0)) + 1)
    return (t.join(place, F.col(metric).eqNullSafe(F.col("__o"))).drop("__o", "__c")
            .withColumn("is_best", F.coalesce(F.col(metric) == best, F.lit(False))))
