"""Mention counts per period and the small aggregates around them.

Rows with a null key are dropped first, and only groups that occur are given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sections import first_section
from ..functions.time import BERLIN, day_label, utc_label, week_label


def _count(mentions: DataFrame, label: str, period: Column, keys: list[str]) -> DataFrame:
    return (
        # one test per key: each goes below the joins on its own, down to the scan
        reduce(lambda t, k: t.filter(F.col(k).isNotNull()), ["tstamp", *keys], mentions)
        .withColumn(label, period)
        .groupBy(label, *keys)
        .agg(F.count(F.lit(1)).alias("count"))
    )


def count_per_week(mentions: DataFrame, keys: list[str], tz: str = BERLIN) -> DataFrame:
    """Counts per local week, labelled by the closing Sunday, and ``keys``."""
    return _count(mentions, "week_end", week_label(F.col("tstamp"), tz), keys)


def count_per_day(mentions: DataFrame, keys: list[str], tz: str = BERLIN) -> DataFrame:
    """Counts per local day and ``keys``."""
    return _count(mentions, "day", day_label(F.col("tstamp"), tz), keys)


def mentions_per_week(mentions: DataFrame, tz: str = BERLIN) -> DataFrame:
    """Counts per week and entity, in week order."""
    return count_per_week(mentions, ["wd_id"], tz).orderBy("week_end", "wd_id")


def mentions_per_section_per_week(mentions: DataFrame, tz: str = BERLIN) -> DataFrame:
    """Counts per week, first section and entity, in week order."""
    table = mentions.withColumn("section", first_section(F.col("sections")))
    return count_per_week(table, ["section", "wd_id"], tz).orderBy("week_end", "section", "wd_id")


def mentions_per_section_per_sentiment_per_week(mentions: DataFrame, tz: str = BERLIN) -> DataFrame:
    """Counts per week, first section, short-text sentiment and entity, in week order."""
    table = mentions.withColumn("section", first_section(F.col("sections"))).withColumnRenamed(
        "shorttext_sentiment", "sentiment"
    )
    keys = ["section", "sentiment", "wd_id"]
    return count_per_week(table, keys, tz).orderBy("week_end", *keys)


def with_utc_label(counts: DataFrame, tz: str = BERLIN) -> DataFrame:
    """Replace ``week_end`` by ``tstamp``, the local midnight written in UTC."""
    rest = [c for c in counts.columns if c != "week_end"]
    return counts.select(utc_label(F.col("week_end"), tz).alias("tstamp"), *rest)


def article_count(mentions: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of different article urls."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return mentions.agg(distinct("url").alias("articles"))


def table_shape(table: DataFrame) -> DataFrame:
    """Row count and column count."""
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(table.columns)).cast("bigint").alias("n_columns"))


def entity_ids(mentions: DataFrame, keep_null: bool = False) -> DataFrame:
    """Sorted distinct entity ids; a null id is dropped unless asked for, then it comes last."""
    ids = mentions.select("wd_id").distinct()
    if not keep_null:
        ids = ids.filter(F.col("wd_id").isNotNull())
    return ids.orderBy(F.col("wd_id").asc_nulls_last())
