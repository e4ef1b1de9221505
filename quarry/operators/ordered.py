"""Running totals over an order, without an edge array and without one task for a group.

Rows are range-partitioned by (group, value): Spark samples the bounds, so a
hot group is cut by value over as many tasks as its size asks for, and small
data needs few tasks however many shuffle partitions the session has.  The
sorted rows are written once; the partition a row was written in is its part,
and one small table of totals per (group, part) gives every part's start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shape import join_keys, q
from quarry.session import cut_lineage


def sorted_parts(df: DataFrame, keys: list[str], value: str, n_parts: int | None = None) -> DataFrame:
    """``df`` written in the order of (keys, value), with ``__p``: the part a row lies in, rising with the order.

    ``n_parts`` fixes the number of parts; without it the runtime merges small ones.
    """
    order = [*[q(k) for k in keys], q(value)]
    if n_parts:
        df = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    else:
        df = df.orderBy(*order)
    return cut_lineage(df.withColumn("__p", F.shiftright(F.monotonically_increasing_id(), 33)))


def part_totals(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """(keys, __p) with each sum over the part (``name``) and over the parts before it (``name__off``)."""
    t = rows.groupBy(*[q(k) for k in keys], "__p").agg(*[F.sum(q(c)).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*[q(k) for k in keys]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumns({f"{n}__off": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in sums})


def running(rows: DataFrame, keys: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """``rows`` of ``sorted_parts`` with each sum over all rows of the group up to this one, inclusive."""
    offsets = part_totals(rows, keys, sums).select(*[q(k) for k in keys], "__p", *[f"{n}__off" for n in sums])
    inside = Window.partitionBy(*[q(k) for k in keys], "__p").orderBy(q(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = join_keys(rows, offsets, [*keys, "__p"])
    return out.withColumns({n: F.col(f"{n}__off") + F.sum(q(c)).over(inside) for n, c in sums.items()}).drop(*[f"{n}__off" for n in sums])
