"""The corpus pipeline: documents in, packed sequences out.

Each stage takes what the one before it kept and returns the columns of ``documents``; the last returns pieces of
packed sequences. Between stages the rows are written as Parquet to the folder that all machines share and read
again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionmill.llm.decontaminate import contamination
from mentionmill.llm.near_duplicates import deduplicated
from mentionmill.llm.packing import pack
from mentionmill.llm.quality import line_rules
from mentionmill.llm.queries import tokenizer_path
from mentionmill.llm.substrings import without_repeats
from mentionmill.llm.tables import Table


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with column names of its own, so that no column can clash with those of an operator; old to new names."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted of lines their host repeats, without those lines.

    A text that loses lines is its other lines as they were, and n_chars counts them; any other text stays as it is.
    A null or empty text fails the base rules. Repeated rows and rows with null ids are judged one by one, rows with
    a null source as one host; an empty table stays empty.
    """
    plain, names = _plain(docs)
    kept = line_rules(plain, names["text"], names["source"], list(names.values()), with_text=True).filter("kept")
    counted = F.when(F.col("n_frequent_words") > 0, F.length("clean_text").cast("long")).otherwise(F.col(names["n_chars"]))
    values = {old: F.col(new) for old, new in names.items()} | {"text": F.col("clean_text"), "n_chars": counted}
    return kept.select(*(value.alias(old) for old, value in values.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id.

    Of repeated rows one stays; a null id comes last. Texts without a word are alike if equal, null as empty.
    """
    plain, names = _plain(docs)
    return deduplicated(plain, names["doc_id"], names["text"]).toDF(*names)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that occur again; one that loses all its words goes.

    A text that loses words is its other words joined by one space, and n_chars counts them; any other text, null and
    empty ones included, stays as it is.
    """
    plain, names = _plain(docs)
    others = tuple(new for old, new in names.items() if old != "text")
    found = without_repeats(plain, names["doc_id"], names["text"], keep=others, with_text=True)
    cut = F.col("n_removed") > 0
    counted = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col(names["n_chars"]))
    values = {old: F.col(new) for old, new in names.items()} | {"text": F.col("kept_text"), "n_chars": counted}
    # the key column comes first and once more among the others
    key, *rest = found.columns
    unique = found.toDF("key_", *rest)
    return unique.filter(~cut | (F.col("n_removed") < F.col("n_words"))).select(*(values[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain, names = _plain(docs)
    clean = contamination(plain, names["text"], list(names.values()), benchmark, "item_id", "text").filter("n_hit = 0")
    return clean.select(*(F.col(new).alias(old) for old, new in names.items()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens; a null or empty text is its end token alone."""
    return pack(docs, "doc_id", "text", tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Near duplicates, their classes and packing plans are beyond SQL; the tests check every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Table | None = None
    for _, stage in STAGES:
        after = Table(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return docs
