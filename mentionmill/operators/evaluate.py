"""Comparison of predicted sentiment classes with gold labels.

Inputs are rows ``(gold, compound)`` with whatever else comes along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.delimited import write_parted
from .clean import CLASS_THRESHOLD, sentiment_class

CLASSES = ["positive", "neutral", "negative"]
# Fixed value: the wider neutral band of one evaluation.
WIDE_THRESHOLD = 0.1


def with_prediction(scored: DataFrame, threshold: float = CLASS_THRESHOLD) -> DataFrame:
    """Add ``predicted`` from ``compound``."""
    return scored.withColumn("predicted", sentiment_class(F.col("compound"), threshold))


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def class_tallies(scored: DataFrame, threshold: float = CLASS_THRESHOLD) -> DataFrame:
    """One row: number of texts, of each predicted class and of each gold label, ``unknown`` for any other."""
    table = with_prediction(scored, threshold)
    return table.agg(
        F.count(F.lit(1)).alias("total"),
        *[_count_if(F.col("predicted") == c).alias(f"predicted_{c}") for c in CLASSES],
        *[_count_if(F.col("gold") == c).alias(f"gold_{c}") for c in CLASSES],
        _count_if(~F.coalesce(F.col("gold").isin(CLASSES), F.lit(False))).alias("gold_unknown"),
    )


def evaluation(scored: DataFrame, threshold: float = CLASS_THRESHOLD) -> DataFrame:
    """Per gold class: how many are right, wrong, or wrongly neutral.

    ``wrong`` counts the opposite class and is 0 for neutral gold, whose errors are told apart by the
    class they went to.
    """
    table = with_prediction(scored, threshold).filter(F.col("gold").isin(CLASSES))
    gold, predicted = F.col("gold"), F.col("predicted")
    polar = gold != "neutral"
    return table.groupBy("gold").agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(gold == predicted).alias("correct"),
        _count_if(polar & (predicted != gold) & (predicted != "neutral")).alias("wrong"),
        _count_if(polar & (predicted == "neutral")).alias("wrong_neutral"),
        _count_if(~polar & (predicted == "positive")).alias("wrong_positive"),
        _count_if(~polar & (predicted == "negative")).alias("wrong_negative"),
    )


def evaluation_splits(scored: DataFrame) -> DataFrame:
    """One row per text and evaluation it takes part in, with the ``outcome`` there.

    ``all``: right or wrong, each apart for neutral gold. ``polar``: without neutral gold.
    ``polar_wide``: the same with the wider neutral band. ``no_neutral``: as ``polar``, with wrongly
    neutral texts apart (the filter was meant to drop negative gold too, but its value is misspelt).
    ``negative_only``: without neutral and positive gold, wrongly neutral apart.

    Every text is read and scored once; the evaluations are spread inside the row.
    """
    gold = F.coalesce("gold", F.lit(""))
    narrow = sentiment_class(F.col("compound"))
    wide = sentiment_class(F.col("compound"), WIDE_THRESHOLD)
    neutral_gold = gold == "neutral"

    def verdict(predicted: Column) -> Column:
        return F.when(predicted == gold, F.lit("right")).otherwise(F.lit("wrong"))

    apart = F.when((narrow != gold) & (narrow == "neutral"), F.lit("wrong_neutral")).otherwise(verdict(narrow))
    splits = {
        "all": (F.lit(True), F.concat(verdict(narrow), F.when(neutral_gold, F.lit("_neutral")).otherwise(F.lit("")))),
        "polar": (~neutral_gold, verdict(narrow)),
        "polar_wide": (~neutral_gold, verdict(wide)),
        "no_neutral": (~gold.isin("neutral", "negtive"), apart),
        "negative_only": (~gold.isin("neutral", "positive"), apart),
    }
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("split"), F.when(takes_part, outcome).alias("outcome"))
            for name, (takes_part, outcome) in splits.items()
        ]
    )
    return scored.select("*", F.inline(rows)).filter(F.col("outcome").isNotNull())


def write_splits(splits: DataFrame, path: str) -> None:
    """Write each outcome of each evaluation to its own folder of tab-separated files."""
    table = splits.select("split", "outcome", "text", "gold", "compound", "scores")
    write_parted(table, ["split", "outcome"], path)
