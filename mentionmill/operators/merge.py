"""Merges of facts and sentiment into mention and count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import left_lookup, require_unique

FACTS = ["wd_id", "wd_label", "wd_description"]
SENTIMENTS = ["url", "shorttext_sentiment", "fulltext_sentiment"]


def merge_facts(table: DataFrame, catalog: DataFrame, null_safe: bool = False) -> DataFrame:
    """Add label and description to mentions or to any count table with a ``wd_id``."""
    return left_lookup(table, catalog.select(*FACTS), "wd_id", null_safe=null_safe)


def merge_sentiment(mentions: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Add the article's sentiment; an article scored twice doubles its mentions."""
    return left_lookup(mentions, sentiment.select(*SENTIMENTS), "url")


def join_many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that refuses a right side with repeated keys."""
    return left_lookup(left, require_unique(right, key), key)


def _digest(text: str) -> Column:
    """What stands for a whole text as a key in a shuffle; null for null."""
    return F.sha2(F.col(text), 256)


def attach_by_text(
    articles: DataFrame, scored: DataFrame, order: str, text: str = "shorttext"
) -> DataFrame:
    """Add ``sentiment`` by equal text; of a text scored more than once the first by ``order`` counts."""
    one_each = scored.groupBy(_digest(text).alias("_text_key")).agg(F.min_by("sentiment", order).alias("sentiment"))
    keyed = articles.withColumn("_text_key", _digest(text))
    return left_lookup(keyed, one_each, "_text_key").drop("_text_key")


def membership_count(left: DataFrame, right: DataFrame, text: str = "shorttext") -> DataFrame:
    """How many rows of ``left`` have a text that occurs in ``right``."""
    known = right.filter(F.col(text).isNotNull()).select(_digest(text).alias("_text_key")).distinct()
    return left.select(_digest(text).alias("_text_key")).join(known, "_text_key", "left_semi").agg(F.count(F.lit(1)).alias("matching"))
