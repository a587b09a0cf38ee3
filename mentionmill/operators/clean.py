"""Row filters, deduplication and text classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sections import FRONT_PAGE, is_front_page

# The advertising domain in article lists, the score bounds.
AD_DOMAIN = "premium.zeit.de"
MIN_LINK_SCORE = 0.1
CLASS_THRESHOLD = 0.05


def drop_front_page(articles: DataFrame, name: str = FRONT_PAGE) -> DataFrame:
    """Drop articles filed under the front-page section alone."""
    return articles.filter(~is_front_page(F.col("sections"), name))


def drop_ads(articles: DataFrame, domain: str = AD_DOMAIN) -> DataFrame:
    """Drop links into the subscription shop."""
    return articles.filter(~F.col("url").contains(domain))


def clean_mentions(mentions: DataFrame, min_score: float = MIN_LINK_SCORE) -> DataFrame:
    """Keep complete rows whose link score reaches the bound."""
    return mentions.dropna("any").filter(F.col("score") >= min_score)


def dedupe_mentions(mentions: DataFrame, order: str, keys: tuple[str, ...] = ("url", "wd_id")) -> DataFrame:
    """The first row per key in input order; a null key counts as one value.

    An aggregate rather than a row-number window: each task reduces its rows before the shuffle, so a
    hot key never puts its rows into one task.
    """
    rest = [c for c in mentions.columns if c not in keys]
    return (
        mentions.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
        .select(*keys, "_first.*")
        .select(*mentions.columns)
    )


def sentiment_class(compound: Column, threshold: float = CLASS_THRESHOLD) -> Column:
    """Three-way class of a compound score; both bounds are inclusive."""
    return (
        F.when(compound >= threshold, F.lit("positive"))
        .when(compound <= -threshold, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a source lacks is null there."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
