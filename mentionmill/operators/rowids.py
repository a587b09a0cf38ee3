"""Dense row numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Table

# The lower bits of an increasing id count the rows of a partition.
_ROW_BITS = (1 << 33) - 1


def dense_row_ids(df: DataFrame, order: str, name: str = "row_id", buckets: int | None = None) -> DataFrame:
    """Number rows from 1 in the order of a column, rows without a value last.

    Rows are exchanged once by ranges of the column and written in order, each with its partition and its place in it.
    The partitions' counts, one row for each, tell how many rows come before. Rows with one value are in the order
    of a hash of their other columns, so that equal values are spread over partitions too. ``buckets`` sets the
    number of ranges.
    """
    others = [c for c, kind in df.dtypes if c != order and not kind.startswith(("map", "variant"))]
    by = [F.col(order).asc_nulls_last(), F.xxhash64(*others) if others else F.lit(0)]
    placed = df.repartitionByRange(*([buckets] if buckets else []), *by).sortWithinPartitions(*by)
    columns = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = Table(
        placed.select(
            *(F.col(c).alias(n) for c, n in columns.items()),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("place"),
        )
    ).df
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are partitions
    before = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = (F.col("before") + F.col("place") + 1).cast("bigint").alias(name)
    return rows.join(F.broadcast(before), "part").select(number, *(F.col(n).alias(c) for c, n in columns.items()))
