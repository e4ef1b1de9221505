"""Registry of named queries bound to the test tables.

Each entry is a callable (spark, sf_dir) -> DataFrame plus, where the
operator is relational, an equivalent DuckDB SQL string used as an oracle.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def rnd(c, n: int = 6) -> Column:
    """Rounded double for oracle comparison (same digits on both sides)."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), n)


def rounded(df: DataFrame, n: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round every double column (or the given ones) to n decimals."""
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    targets = set(cols) if cols is not None else dbl
    return df.select(*[rnd(f"`{c}`", n).alias(c) if c in targets else F.col(f"`{c}`") for c in df.columns])


# Null injection shared by the Spark bindings and their SQL twins: the test
# tables have no NULLs, so a deterministic share of keys is blanked out.
def null_when(key: str, m: int, value) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.pmod(F.col(key), F.lit(m)) == 0, F.lit(None)).otherwise(v)
