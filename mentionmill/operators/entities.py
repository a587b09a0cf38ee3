"""Entity documents and the catalog made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BODY = (
    "entities MAP<STRING, STRUCT<"
    "labels: MAP<STRING, STRUCT<value: STRING>>, descriptions: MAP<STRING, STRUCT<value: STRING>>>>"
)


def flatten_entities(documents: DataFrame) -> DataFrame:
    """One catalog row per fetched document ``(wd_id, url, body)``.

    The first key under ``entities`` is the true id, kept as ``wd_redirect`` when it is not the one
    asked for. Label: German, else English, else id. Description: English, else id. Documents that do
    not parse give no row.
    """
    parsed = documents.withColumn("_entities", F.from_json("body", BODY).getField("entities"))
    true_id = F.try_element_at(F.map_keys("_entities"), F.lit(1))
    opened = (
        parsed.withColumn("_id", true_id)
        .filter(F.col("_id").isNotNull())
        .withColumn("_entity", F.element_at("_entities", F.col("_id")))
    )

    def value(part: str, language: str):
        return F.try_element_at(F.col(f"_entity.{part}"), F.lit(language)).getField("value")

    return opened.select(
        F.col("url").alias("wd_url"),
        "wd_id",
        F.when(F.col("_id") != F.col("wd_id"), F.col("_id")).alias("wd_redirect"),
        F.coalesce(value("labels", "de"), value("labels", "en"), F.col("_id")).alias("wd_label"),
        F.coalesce(value("descriptions", "en"), F.col("_id")).alias("wd_description"),
    )


def missing_ids(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested ids the catalog does not hold yet."""
    known = catalog.select("wd_id").filter(F.col("wd_id").isNotNull()).distinct()
    return requested.select("wd_id").join(known, "wd_id", "left_anti")
