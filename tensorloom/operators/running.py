"""Running sums along an order, split over tasks however many rows one key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.shipping import written

_RANGE = "__range"


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], **sums: Column) -> DataFrame:
    """``rows`` with each of ``sums`` added up over the earlier rows of the same ``keys``, from 0.

    A window by key alone would put a key's rows into one task. Here rows are range-partitioned by
    (keys, order) and written, which fixes the ranges; a window inside each range and a window over
    the ranges' totals, a row each, give the two halves of a sum. Null keys are a key of their own;
    rows that tie in the order share a range and come in any order.
    """
    ranged = written(rows.withColumns(sums).repartitionByRange(*keys, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    before = lambda window: {n: F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint") for n in sums}
    inside = ranged.withColumns(before(Window.partitionBy(*keys, _RANGE).orderBy(*order)))
    totals = ranged.groupBy(*keys, _RANGE).agg(*[F.sum(n).alias(n) for n in sums])
    starts = totals.withColumns(before(Window.partitionBy(*keys).orderBy(_RANGE)))
    same = [*keys, _RANGE]
    starts = starts.select(*[F.col(c).alias(f"__start_{c}") for c in (*same, *sums)])
    on = [F.col(c).eqNullSafe(F.col(f"__start_{c}")) for c in same]
    both = inside.join(starts, on).withColumns({n: F.col(n) + F.col(f"__start_{n}") for n in sums})
    return both.select(*rows.columns, *sums)
