"""The finished tables: mentions with facts and sentiment, and their weekly counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.clean import drop_front_page
from ..operators.counts import (
    mentions_per_section_per_sentiment_per_week,
    mentions_per_section_per_week,
    mentions_per_week,
)
from ..operators.link import link_entities
from ..operators.merge import merge_facts, merge_sentiment


def linked_mentions(articles: DataFrame, aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Articles without front-page copies, their mentions, with facts."""
    return merge_facts(link_entities(drop_front_page(articles), aliases), catalog)


@dataclass(frozen=True)
class Products:
    """Lazy count tables; nothing runs before one of them is written."""

    per_week: DataFrame
    per_section_per_week: DataFrame
    per_section_per_sentiment_per_week: DataFrame


def count_products(
    mentions: DataFrame, sentiment: DataFrame, catalog: DataFrame | None = None
) -> Products:
    """The three weekly tables from linked mentions and article sentiment, with facts if asked."""

    def finish(counts: DataFrame) -> DataFrame:
        """Facts first, then the order: a join does not keep one."""
        if catalog is None:
            return counts
        keys = [c for c in counts.columns if c != "count"]
        return merge_facts(counts, catalog).orderBy(*keys)

    return Products(
        finish(mentions_per_week(mentions)),
        finish(mentions_per_section_per_week(mentions)),
        finish(mentions_per_section_per_sentiment_per_week(merge_sentiment(mentions, sentiment))),
    )
