"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library expects.  AQE re-plans joins from runtime
# sizes (broadcast only when a side is measured small), coalesces small
# shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "quarry",
              shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset so spark-submit decides; size
    ``shuffle_partitions`` so one partition stays within executor memory
    (about 128-256 MB of shuffle data each).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` as configured for the cluster.  Only a
    local-mode session without the setting gets a fresh scratch folder (tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


# Plain values: a 128 MB split of such a table holds about as many rows whatever their values,
# where well-packed columns would put tens of millions of rows into one task of a fit.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20)}


def cut_lineage(df: DataFrame, partition_by: str | None = None, plain: bool = False) -> DataFrame:
    """Materialise a table in the shared checkpoint folder and continue from it.

    Written as Parquet (columnar, compressed) under ``spark.checkpoint.dir``
    and read back, so the plan after this point no longer depends on the
    lineage before it and survives the loss of any executor.  The table must
    live as long as a plan reads it; ``release_tables`` deletes all of them,
    and runs by itself when the driver ends.  ``partition_by`` gives each value
    of a column a folder, so a filter on it reads that folder only.  ``plain``
    stores values as they are (no dictionary, no compression), which bounds the
    rows of a split by its bytes.
    """
    import uuid

    base = checkpoint_dir(df.sparkSession)
    path = os.path.join(base, "tables", uuid.uuid4().hex)
    w = df.write.options(**PLAIN) if plain else df.write
    (w.partitionBy(partition_by) if partition_by else w).mode("overwrite").parquet(path)
    if not _TABLES:
        atexit.register(release_tables)
    _TABLES.append((df.sparkSession, path))
    read = df.sparkSession.read.schema(df.schema) if partition_by else df.sparkSession.read     # no folders, no files to take it from
    return read.parquet(path)


_TABLES: list[tuple[SparkSession, str]] = []


def release_tables() -> None:
    """Delete the tables that ``cut_lineage`` has written so far; plans that read them end here."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended before us
            return


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for the frames that are run in here."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """Frames made and run in here drop their shuffle files when their run ends, not when the driver happens to collect garbage.

    For a frame that is run once: a second run would shuffle anew.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def few_rows_at_once(spark: SparkSession, rows: int = 4):
    """Frames run in here read and hand over ``rows`` rows at a time: for tables whose rows hold megabytes."""
    return settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": str(rows), "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin rows over the cluster when a scan yields fewer partitions than cores.

    Used before CPU-heavy row work (regex tokenisation of whole texts, model
    calls): a single large row group otherwise lands in one task.  A scan
    that already has enough splits is returned unchanged, so at scale this
    adds no shuffle.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:  # read off the plan, no job runs
        return df
    return df.repartition(want)
