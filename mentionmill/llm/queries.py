"""The registered queries of this package and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionmill.llm.collocations import collocations
from mentionmill.llm.decontaminate import contamination
from mentionmill.llm.filter_audit import filter_audit
from mentionmill.llm.html_text import extracted_text
from mentionmill.llm.near_duplicates import near_duplicate_classes
from mentionmill.llm.oracles import ORACLES
from mentionmill.llm.packing import pack
from mentionmill.llm.quality import line_rules
from mentionmill.llm.records import read_records, write_records
from mentionmill.llm.sharding import histogram_shards
from mentionmill.llm.substrings import without_repeats
from mentionmill.llm.suffix_index import without_repeated_bytes
from mentionmill.llm.tokens import token_count
from mentionmill.llm.url_filters import Rule, judge_urls, page_edges

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SHARDS = 24
END_ID = 2
URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_shards(spark, sf_dir):
    """All documents in 24 shards of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("group"),
    )
    dealt = histogram_shards(docs, F.col("group"), F.col("doc_id"), F.col("size"), SHARDS)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_url_verdicts(spark, sf_dir):
    """Every page's url judged by the rules and, through redirects and canonical links, by its aliases."""
    pages = table(spark, sf_dir, "pages")
    judged = judge_urls(pages.select("page_id", "url"), URL_RULES, page_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_counts(spark, sf_dir):
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        token_count(F.col("text"), tokenizer_path()).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op8_pack(spark, sf_dir):
    """All documents in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


@query
def op2_contamination(spark, sf_dir):
    """Every document's words that lie in windows of benchmark items."""
    found = contamination(
        table(spark, sf_dir, "documents"), "text", ["doc_id"], table(spark, sf_dir, "benchmark"), "item_id", "text"
    )
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op5_line_rules(spark, sf_dir):
    """Every document's counts and the verdict of the line frequency rules."""
    judged = line_rules(table(spark, sf_dir, "documents"), "text", "source", ["doc_id"])
    return judged.drop("n_frequent_words", "depleted")


@query
def op6_substrings(spark, sf_dir):
    """Every document without the words of windows of 35 words that occur again."""
    return without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op10_suffix_index(spark, sf_dir):
    """Every document without the bytes of strings of 200 bytes that occur again."""
    return without_repeated_bytes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op3_near_duplicates(spark, sf_dir):
    """Every document with the class of its near duplicates; one of each class is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_classes(docs, "doc_id", "text").select(F.col("doc").alias("doc_id"), "class_id", "kept")


@query
def op9_main_text(spark, sf_dir):
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extracted_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_collocations(spark, sf_dir):
    """Each language's best phrases of two and three words."""
    return collocations(table(spark, sf_dir, "documents"), "lang", "text")


@query
def op12_filter_audit(spark, sf_dir):
    """What five filters remove from the documents of each language, in every order."""
    return filter_audit(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", table(spark, sf_dir, "labels"))


@query
def op13_token_records(spark, sf_dir):
    """Every document's token ids, written as binary records and read back."""
    docs = table(spark, sf_dir, "documents")
    written = write_records(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), END_ID)
    return read_records(spark, written).withColumnRenamed("doc", "doc_id")
