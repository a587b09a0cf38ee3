"""JSON Lines in and out, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .. import schemas
from ..functions.time import epoch_seconds

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _drop_nan(df: DataFrame) -> DataFrame:
    """A bare NaN token, which is not JSON, reads as text or as a number; both mean null."""
    fixed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            fixed[f.name] = F.when(F.col(f.name) != "NaN", F.col(f.name))
        elif isinstance(f.dataType, DoubleType):
            fixed[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
    return df.withColumns(fixed) if fixed else df


def _read(spark: SparkSession, path: str | list[str], schema: str, skip_invalid: bool = False) -> DataFrame:
    mode = "DROPMALFORMED" if skip_invalid else "PERMISSIVE"
    df = _drop_nan(spark.read.schema(schema).option("mode", mode).json(path))
    if "tstamp" in df.columns:
        df = df.withColumn("tstamp", epoch_seconds(F.col("tstamp")))
    return df


def read_articles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scraped articles; ``sections`` written as an empty string reads as null."""
    return _read(spark, path, schemas.ARTICLE_RAW)


def read_mentions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entity mentions."""
    return _read(spark, path, schemas.MENTION_RAW)


def read_article_sentiment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sentiment labels per article."""
    return _read(spark, path, schemas.ARTICLE_SENTIMENT_RAW)


def read_catalog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entity catalog; lines that are no JSON object are skipped."""
    return _read(spark, path, schemas.CATALOG, skip_invalid=True).filter(F.col("wd_id").isNotNull())


def read_entity_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fetched entity documents ``(wd_id, url, body)``."""
    return _read(spark, path, schemas.ENTITY_DOCUMENT)


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fetched pages ``(url, html)``."""
    return spark.read.schema(schemas.PAGE).json(path)


def write_jsonl(
    df: DataFrame,
    path: str,
    gzip: bool = False,
    rows_per_file: int | None = None,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write JSON Lines; the folder's part files together are the one logical file.

    ``mode="append"`` adds to a catalog without touching what is there.
    """
    writer = df.write.mode(mode).option("timestampFormat", ISO_UTC).option("timestampNTZFormat", ISO_UTC)
    if gzip:
        writer = writer.option("compression", "gzip")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def json_array_lines(df: DataFrame, key: str, columns: list[str] | None = None, scalar: bool = False) -> DataFrame:
    """Text lines in ``key`` order that read as one JSON array when joined.

    ``key`` is unique and not null. Each row stays a line of its own, so no task ever holds the array:
    the first line opens it, the last one closes it. ``scalar`` writes the bare value of one column.
    """
    columns = df.columns if columns is None else columns
    # a bare value is what to_json leaves inside the brackets of a one-item array
    item = (
        F.regexp_extract(F.to_json(F.array(columns[0])), r"(?s)^\[(.*)\]$", 1)
        if scalar
        else F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    )
    ends = df.agg(F.min(key).alias("first"), F.max(key).alias("last"))
    first = ends.select("first").scalar()
    last = ends.select("last").scalar()
    line = F.concat(
        F.when(F.col(key) == first, F.lit("[")).otherwise(F.lit(",")),
        item,
        F.when(F.col(key) == last, F.lit("]")).otherwise(F.lit("")),
    )
    return df.select(F.col(key).alias("_key"), line.alias("value")).orderBy("_key").select("value")


def write_json_array(df: DataFrame, path: str, key: str, columns: list[str] | None = None, scalar: bool = False) -> None:
    """Write the array as text parts that make one JSON document in name order; ``[]`` for no rows."""
    lines = json_array_lines(df, key, columns, scalar)
    if df.isEmpty():
        lines = df.sparkSession.range(1).select(F.lit("[]").alias("value"))
    lines.write.mode("overwrite").text(path)
