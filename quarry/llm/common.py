"""Shared Spark pieces of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def content_key() -> Column:
    """64-bit key of a document's content; with doc_id it names a document, equal rows share it."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull(),
                      F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())


def crc_fold(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (a null id counts as remainder 0)."""
    return F.coalesce(F.pmod(F.crc32(col.cast("string")), F.lit(n)), F.lit(0))


def needed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, as the operator types them; a missing one is null, and case does not count (as in Spark)."""
    types = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
             "page_id": "bigint", "url": "string", "html": "string", "quality": "int"}
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(types[c]).alias(c) for c in names])
