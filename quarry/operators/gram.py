"""Moments of all column pairs in one pass: dense block sums per task, added up by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.shape import q

BLOCK = 64                       # columns of a block
MERGE = 256                      # partial sums added up in one task
CONSTANT = 1e-13                 # a centred square sum below this share of the raw one is rounding


def numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as doubles named 0, 1, 2, ..."""
    return df.select(*[q(c).cast("double").alias(str(i)) for i, c in enumerate(cols)])


def matrix(batch) -> np.ndarray:
    """[rows, columns] of an Arrow batch of doubles; NULL is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_columns else np.zeros((batch.num_rows, 0))


def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, cii, cjj, cij) for column numbers i < j: rows where both have a value, centred square sums and product sum.

    NULL and NaN are missing.  A task turns its rows into a value and a presence matrix
    and keeps six products per pair of column blocks; the products are added up
    by block, at most ``MERGE`` at a time, so neither the number of columns nor
    of tasks makes a wide aggregate.  Values are taken less one value of their
    column (from the first rows), which keeps the sums small.
    """
    x = numbers(df, cols)
    d, n_blocks = len(cols), -(-len(cols) // BLOCK)
    head = x.limit(1000).toArrow()                     # a bounded number of rows
    some = matrix(head.combine_chunks().to_batches()[0]) if head.num_rows else np.zeros((0, d))
    shift = np.array([next((v for v in some[:, c] if np.isfinite(v)), 0.0) for c in range(d)])
    pairs = [(a, b) for a in range(n_blocks) for b in range(a, n_blocks)]
    cut = [slice(a * BLOCK, min(d, (a + 1) * BLOCK)) for a in range(n_blocks)]

    def products(batches):
        total = None
        for batch in batches:
            v = matrix(batch) - shift
            m = ~np.isnan(v)
            v[~m] = 0.0
            m, v2 = m.astype(float), v * v
            part = [np.stack([p.T @ r for p, r in ((m[:, s], m[:, t]), (v[:, s], m[:, t]), (m[:, s], v[:, t]), (v2[:, s], m[:, t]), (m[:, s], v2[:, t]), (v[:, s], v[:, t]))])
                    for s, t in ((cut[a], cut[b]) for a, b in pairs)]
            total = part if total is None else [x + y for x, y in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.int32()),
                                              pa.array([x.tobytes() for x in total], pa.binary())], names=["a", "b", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(s, np.float64) for s in table.column("sums").to_pylist())
        return pa.table({"a": pa.array([key[0].as_py()], pa.int32()), "b": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def spread(batches):
        for batch in batches:
            for a, b, s in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "sums")]):
                n, si, sj, sii, sjj, sij = np.frombuffer(s, np.float64).reshape(6, cut[a].stop - cut[a].start, -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cii, cjj, cij = sii - si * si / n, sjj - sj * sj / n, sij - si * sj / n
                cii[cii <= CONSTANT * sii], cjj[cjj <= CONSTANT * sjj] = 0.0, 0.0
                i, j = np.meshgrid(np.arange(cut[a].start, cut[a].stop), np.arange(cut[b].start, cut[b].stop), indexing="ij")
                keep = i < j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), pa.array(n[keep].astype(np.int64)),
                     *[pa.array(np.where(n[keep] > 0, c[keep], 0.0)) for c in (cii, cjj, cij)]], names=["i", "j", "n", "cii", "cjj", "cij"])

    sums = x.mapInArrow(products, "a int, b int, sums binary")
    tasks = x.rdd.getNumPartitions()                    # read off the plan, no job runs
    while tasks > MERGE:
        tasks = -(-tasks // MERGE)
        salt = F.pmod(F.spark_partition_id(), F.lit(tasks))
        sums = sums.groupBy("a", "b", salt.alias("salt")).applyInArrow(add, "a int, b int, sums binary")
    return sums.groupBy("a", "b").applyInArrow(add, "a int, b int, sums binary").mapInArrow(spread, "i int, j int, n bigint, cii double, cjj double, cij double")


def pearson():
    """r from the columns of ``pair_moments``; a constant side gives NULL."""
    return F.try_divide(F.col("cij"), F.sqrt(F.col("cii")) * F.sqrt(F.col("cjj")))


def named(moments: DataFrame, cols: list[str]) -> DataFrame:
    """``moments`` with the names of its columns as a and b."""
    names = F.array(*[F.lit(c) for c in cols])
    return moments.withColumns({"a": names[F.col("i")], "b": names[F.col("j")]})
