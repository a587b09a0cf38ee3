"""Joins of a big table with a lookup table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _compared(left: DataFrame, right: DataFrame, key: str) -> tuple[Column, Column]:
    """Both keys in their common type: numbers as numbers, a text and anything else as texts."""
    a, b = left.schema[key].dataType, right.schema["_right_key"].dataType
    if a != b and StringType() in (a, b):
        return F.col(key).cast("string"), F.col("_right_key").cast("string")
    return F.col(key), F.col("_right_key")


def left_lookup(left: DataFrame, right: DataFrame, key: str, null_safe: bool = False) -> DataFrame:
    """Left join on ``key``, keeping every row of ``left``.

    The strategy is Spark's: it broadcasts a side whose size, as estimated from the files or as
    measured at run time, is below its threshold, and shuffles otherwise. Nothing is run in advance.

    Rows without a key would all meet in one task of a shuffle, so they pass by the join in a union of
    their own, which the optimizer drops where a later filter asks for something of ``right``. Hot keys
    are split by adaptive execution (of a left join only the left side ever is).
    """
    extra = [c for c in right.columns if c != key]
    right = right.withColumnRenamed(key, "_right_key")
    a, b = _compared(left, right, key)
    if not null_safe:
        right = right.filter(F.col("_right_key").isNotNull())
    if null_safe:
        return left.join(right, a.eqNullSafe(b), "left").select(*left.columns, *extra)
    met = left.filter(F.col(key).isNotNull()).join(right, a == b, "left").select(*left.columns, *extra)
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra]
    return met.union(left.filter(F.col(key).isNull()).select(*left.columns, *nothing))


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Raise when a value of ``key`` repeats; otherwise hand ``df`` back."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} is not unique: {repeated[0][key]!r} occurs {repeated[0]['n']} times")
    return df

