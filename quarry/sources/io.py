"""Scans and sinks (S1-S13).  Explicit schemas, never inference, in jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN is missing: every double or float column with NaN turned into NULL (scans apply it)."""
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c, t in df.dtypes if t in ("double", "float")})


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
             header: bool = True, line_sep: str | None = None,
             encoding: str = "UTF-8") -> DataFrame:
    """CSV/TSV scan with a declared schema."""
    r = (spark.read.schema(schema).option("header", header).option("sep", sep)
         .option("encoding", encoding).option("mode", "PERMISSIVE"))
    if line_sep:
        r = r.option("lineSep", line_sep)
    return nan_as_null(r.csv(path))


def read_first_rows(df: DataFrame, n: int, key) -> DataFrame:
    """Row-limited scan (S3): the first n rows by key, deterministic."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return nan_as_null(df.select(*columns) if columns else df)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Parquet sink (S5, S13).  Key columns stay ordinary columns."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON-lines scan."""
    return nan_as_null(spark.read.schema(schema).json(path))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_binary_tree(spark: SparkSession, root: str, glob: str = "*",
                     label_from_parent: bool = True) -> DataFrame:
    """Recursive binary-file scan (S7); label = name of the parent folder."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(root))
    if label_from_parent:
        df = df.withColumn("label", F.element_at(F.split("path", "/"), -2))
    return df


def write_csv(df: DataFrame, path: str, sep: str = ";", header: bool = True,
              encoding: str = "UTF-8", rename: dict | None = None,
              mode: str = "overwrite") -> None:
    """CSV sink with a delimiter, header, encoding and renamed fields."""
    if rename:
        df = df.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in df.columns])
    (df.write.mode(mode).option("sep", sep).option("header", header)
     .option("encoding", encoding).csv(path))


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Make tables visible to ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    if tables:
        register_views(spark, tables)
    return spark.sql(query)


def read_jdbc(spark: SparkSession, url: str, table: str, props: dict | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """External relational source read in parallel ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def flatten_hits(df: DataFrame, array_col: str, fields: list[str], default: str = "", keep: list[str] | None = None) -> DataFrame:
    """Nested payload flatten (S10): the ``keep`` columns and one row per array element, missing keys -> default."""
    e = df.select(*[F.col(f"`{c}`") for c in keep or ()], F.explode(array_col).alias("_h"))
    return e.select(*[F.col(f"`{c}`") for c in keep or ()], *[F.coalesce(F.col("_h").getField(f).cast("string"), F.lit(default)).alias(f) for f in fields])


def metrics_report(spark: SparkSession, metrics: dict) -> DataFrame:
    """One-row report frame for a JSON sink."""
    return spark.createDataFrame([tuple(metrics.values())], list(metrics.keys()))


def write_report(spark: SparkSession, metrics: dict, path: str) -> None:
    metrics_report(spark, metrics).coalesce(1).write.mode("overwrite").json(path)

