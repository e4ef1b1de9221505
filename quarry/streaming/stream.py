"""Structured Streaming jobs (G*).

Both run with an ``availableNow`` trigger: every file present is processed
in bounded micro-batches, progress is reported per batch, state and offsets
live in a checkpoint folder, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, in_dir: str, schema: StructType | str, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(in_dir)


PROGRESS = "batch bigint, rows bigint, processed bigint, total bigint, percent double"


def read_progress(spark: SparkSession, progress_dir: str) -> DataFrame:
    """One row per finished batch: rows, rows so far, and with a total the total and percent; readable while the stream runs."""
    return spark.read.schema(PROGRESS).parquet(progress_dir)


def score_stream(spark: SparkSession, in_dir: str, schema, scorer, out_dir: str, ckpt: str,
                 glob: str | None = None, max_files: int | None = None, total: int | None = None, progress_dir: str | None = None):
    """Progressive scoring: stream rows, score, write each batch to Parquet; returns (query, progress) (G1).

    ``scorer`` maps a DataFrame to the scored DataFrame (row-wise only).  A
    batch overwrites its own folder ``batch=<id>``, so a repeated batch is
    written once.  Its rows are counted as they are written (an observed
    metric), and right after a row goes to ``progress_dir`` (default
    ``<out_dir>.progress``): rows, rows so far, and with ``total`` (rows to
    expect) the total and percent.  The count goes on from the last batch
    reported there, so a restarted job carries on.
    """
    src = file_stream(spark, in_dir, schema, glob, max_files)
    progress_dir = progress_dir or out_dir + ".progress"
    before = {"processed": None}

    def sink(batch: DataFrame, epoch: int):
        seen = Observation(f"batch-{epoch}")
        scored = scorer(batch).observe(seen, F.count(F.lit(1)).alias("rows"))
        scored.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={epoch}"))
        if before["processed"] is None:                              # first batch of this job: what earlier jobs reported
            old = read_progress(spark, progress_dir).filter(F.col("batch") < epoch) if epoch else None
            before["processed"] = int(old.agg(F.max("processed")).first()[0] or 0) if old is not None else 0
        rows = int(seen.get["rows"])
        before["processed"] += rows
        percent = 100.0 * before["processed"] / total if total else None
        row = spark.createDataFrame([(epoch, rows, before["processed"], total, percent)], PROGRESS)
        row.coalesce(1).write.mode("overwrite").parquet(os.path.join(progress_dir, f"at={epoch}"))

    q = src.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, read_progress(spark, progress_dir)


def windowed_counts(src: DataFrame, ts: str, window: str, watermark: str, by: list[str] | None = None) -> DataFrame:
    """Tumbling-window counts with a watermark; NTZ time is cast to TIMESTAMP (UTC session) first."""
    t = F.col(ts).cast("timestamp")
    keys = [F.col(b) for b in (by or [])]
    return (src.withColumn("__t", t).withWatermark("__t", watermark)
            .groupBy(F.window("__t", window).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n")))


def periodic_counts(spark: SparkSession, in_dir: str, schema, ts: str, window: str, watermark: str,
                    out_dir: str, ckpt: str, by: list[str] | None = None, glob: str | None = None,
                    mode: str = "complete", max_files: int | None = None):
    """Keep period counts up to date.

    ``complete``: the whole result (one row per period and key) is re-emitted
    each batch and overwrites a Parquet table, equal to the batch answer at
    any time; state grows with the number of periods.  ``append``: a period
    is written once the watermark passes its end and its state is dropped,
    the form for unbounded streams.
    """
    src = file_stream(spark, in_dir, schema, glob, max_files)
    agg = windowed_counts(src, ts, window, watermark, by)
    shaped = agg.select(F.col("w.start").cast("timestamp_ntz").alias("period_start"),
                        *[F.col(b) for b in (by or [])], "n")
    if mode == "append":
        q = (shaped.writeStream.outputMode("append").format("parquet").option("path", out_dir)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    def sink(batch_df: DataFrame, epoch: int):
        batch_df.write.mode("overwrite").parquet(out_dir)

    q = (shaped.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for a job's outputs."""
    import uuid

    from quarry.session import checkpoint_dir
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def linear_scorer(weights: dict[str, Column], bias: float, threshold: float):
    def f(df: DataFrame) -> DataFrame:
        z = sum(weights.values(), F.lit(float(bias)))
        p = 1.0 / (1.0 + F.exp(-z))
        return df.withColumn("proba", p).withColumn("predicted_label", (p >= threshold).cast("int"))
    return f
