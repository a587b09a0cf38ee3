"""The registered queries, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionmill.functions import sections as sec
from mentionmill.functions import time as tm
from mentionmill.operators import clean, counts, evaluate, extract, merge, spines
from mentionmill.operators.entities import flatten_entities, missing_ids
from mentionmill.operators.link import link_entities
from mentionmill.operators.model import batch_score
from mentionmill.operators.sentiment import score_columns, score_sentiment
from mentionmill.operators.sentiment.lexicon import lexicon_hits
from mentionmill.operators.sentiment.score import mean_sentence_score, mean_tag_score
from mentionmill.operators.sentiment.tokens import describe_emoji, punctuation_emphasis, token_context
from mentionmill.operators.topics import article_topics, fit_topics, topic_summary
from mentionmill.plans.products import count_products, linked_mentions
from mentionmill.sources.delimited import (
    read_labelled,
    read_scored_csv,
    read_scored_dir,
    read_splits,
    scoring_input,
    write_csv,
    write_scored_dir,
    write_scoring_input,
)
from mentionmill.sources.jsonl import json_array_lines, read_articles, write_jsonl
from mentionmill.tables import shared_folder

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function name, without a trailing underscore."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# counts


@query
def mentions_per_week(spark, sf_dir):
    return counts.mentions_per_week(inputs.mentions(spark, sf_dir))


@query
def mentions_per_week_years(spark, sf_dir):
    return counts.with_utc_label(counts.mentions_per_week(inputs.order_mentions(spark, sf_dir)))


@query
def mentions_per_section_per_week(spark, sf_dir):
    return counts.mentions_per_section_per_week(inputs.mentions(spark, sf_dir))


def _sentiment(spark, sf_dir):
    return score_sentiment(
        inputs.articles(spark, sf_dir).select("url", "shorttext"), inputs.lexicon(spark, sf_dir)
    )


@query
def mentions_per_section_per_sentiment_per_week(spark, sf_dir):
    merged = merge.merge_sentiment(inputs.mentions(spark, sf_dir), _sentiment(spark, sf_dir))
    return counts.mentions_per_section_per_sentiment_per_week(merged)


def _first_mentions(spark, sf_dir):
    return clean.dedupe_mentions(inputs.mentions(spark, sf_dir), "ingest_id")


@query
def mentions_per_day(spark, sf_dir):
    return counts.count_per_day(_first_mentions(spark, sf_dir), ["wd_id", "label"])


@query
def mentions_per_day_enriched(spark, sf_dir):
    table = merge.merge_facts(_first_mentions(spark, sf_dir), inputs.catalog(spark, sf_dir))
    return counts.count_per_day(table, ["wd_id", "label", "wd_label", "wd_description"]).orderBy("day", "wd_id", "label")


@query
def mentions_per_week_labelled(spark, sf_dir):
    return counts.count_per_week(_first_mentions(spark, sf_dir), ["wd_id", "label"])


@query
def mentions_per_week_enriched(spark, sf_dir):
    table = merge.merge_facts(_first_mentions(spark, sf_dir), inputs.catalog(spark, sf_dir))
    keys = ["wd_id", "label", "wd_label", "wd_description"]
    return counts.count_per_week(table, keys).orderBy(F.desc("count"), "week_end", "wd_id", "label")


@query
def article_count(spark, sf_dir):
    return counts.article_count(inputs.mentions(spark, sf_dir))


@query
def clean_mentions_count(spark, sf_dir):
    return counts.table_shape(clean.clean_mentions(inputs.mentions(spark, sf_dir)))


@query
def catalog_ids(spark, sf_dir):
    both = clean.union_sources(inputs.mentions(spark, sf_dir), inputs.order_mentions(spark, sf_dir))
    return counts.entity_ids(both, keep_null=True)


@query
def catalog_ids_array(spark, sf_dir):
    ids = counts.entity_ids(clean.union_sources(inputs.mentions(spark, sf_dir), inputs.order_mentions(spark, sf_dir)))
    return json_array_lines(ids, "wd_id", scalar=True)


# filters and projections


@query
def drop_front_page(spark, sf_dir):
    table = inputs.mentions(spark, sf_dir).withColumn(
        "sections", F.when(F.col("score") < 0.02, F.array(F.lit("Seite 1"))).otherwise(F.col("sections"))
    )
    return clean.drop_front_page(table).select("ingest_id", sec.first_section(F.col("sections")).alias("section"))


@query
def first_section(spark, sf_dir):
    return inputs.mentions(spark, sf_dir).select("ingest_id", sec.first_section(F.col("sections")).alias("section"))


@query
def epoch_berlin(spark, sf_dir):
    iso = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    return (
        inputs.table(spark, sf_dir, "orders")
        .select("o_orderkey", tm.iso_to_epoch_text(iso).alias("tstamp"))
        .withColumn("seconds", tm.epoch_seconds(F.col("tstamp")))
        .select(
            "o_orderkey",
            "tstamp",
            F.date_format(tm.local_time(F.col("seconds")), "yyyy-MM-dd HH:mm:ss").alias("berlin"),
            tm.week_label(F.col("seconds")).alias("week_end"),
        )
    )


@query
def clean_mentions(spark, sf_dir):
    return clean.clean_mentions(inputs.mentions(spark, sf_dir)).drop("sections")


@query
def classify(spark, sf_dir):
    compound = (F.col("value") - 60.0) / 500.0
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", clean.sentiment_class(compound).alias("narrow"), clean.sentiment_class(compound, 0.1).alias("wide")
    )


@query
def dedupe_mentions(spark, sf_dir):
    return _first_mentions(spark, sf_dir).drop("sections")


@query
def union_sources(spark, sf_dir):
    both = clean.union_sources(inputs.mentions(spark, sf_dir), inputs.order_mentions(spark, sf_dir))
    return both.select("url", "tstamp", "label", "wd_id", "score", sec.first_section(F.col("sections")).alias("section"))


@query
def ad_url_filter(spark, sf_dir):
    return clean.drop_ads(inputs.pages(spark, sf_dir), "blog.").select("page_id", "url")


# sources and sinks: written to the shared folder, read again


def _written(spark, write):
    """A path below the shared folder after ``write(path)`` has filled it."""
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    write(path)
    return path


@query
def jsonl_round_trip(spark, sf_dir):
    rows = inputs.articles(spark, sf_dir).select("url", "tstamp", "shorttext", "fulltext", "sections")
    path = _written(spark, lambda p: write_jsonl(rows, p, gzip=True))
    back = read_articles(spark, path)
    return back.select("url", "tstamp", F.md5("shorttext").alias("short"), F.md5("fulltext").alias("body"), sec.first_section(F.col("sections")).alias("section"))


@query
def partitioned_round_trip(spark, sf_dir):
    rows = inputs.articles(spark, sf_dir).select("url", "tstamp", "shorttext", F.col("sections")[0].alias("source"))
    path = _written(spark, lambda p: write_jsonl(rows, p, partition_by=["source"]))
    files = read_articles(spark, path).select("url", F.length("shorttext").cast("bigint").alias("n"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"))
    return files


@query
def csv_round_trip(spark, sf_dir):
    rows = inputs.articles(spark, sf_dir).select(
        F.concat(F.lit('"'), F.replace("fulltext", F.lit(" "), F.lit('",')), F.lit("\n")).alias("text"), F.lit("unknown").alias("gold"),
        (F.col("doc_id") / 8).alias("compound"), F.lit("{'neg': 0.0}").alias("scores"), F.lit("neutral").alias("sentiment"),
    )
    back = read_scored_csv(spark, _written(spark, lambda p: write_csv(rows, p)))
    return back.select(F.md5("shorttext").alias("text"), "gold", "compound", "scores", "sentiment")


@query
def tsv_round_trip(spark, sf_dir):
    rows = inputs.articles(spark, sf_dir).select("doc_id", "fulltext")
    back = read_labelled(spark, _written(spark, lambda p: write_scoring_input(rows, p, "doc_id", "fulltext")))
    return back.select(F.col("id").cast("bigint").alias("row_id"), "label", F.md5("text").alias("text"))


def _quoted(spark, sf_dir):
    """Articles whose texts hold quotes, separators and line breaks."""
    text = F.concat(F.lit('"'), F.replace("fulltext", F.lit(" "), F.lit('"\t')), F.lit("\n."))
    return inputs.articles(spark, sf_dir).select("doc_id", text.alias("text"), F.lit("{'neg': 0.0}").alias("scores"))


@query
def scored_dir_round_trip(spark, sf_dir):
    rows = _quoted(spark, sf_dir).join(inputs.gold(spark, sf_dir), "doc_id").select(
        "text", "gold", (F.col("doc_id") / 8).alias("compound"), "scores", F.col("gold").alias("sentiment")
    )
    back = read_scored_dir(spark, _written(spark, lambda p: write_scored_dir(rows, p)))
    return back.select(F.md5("text").alias("text"), "gold", "compound", "scores", "sentiment")


@query
def splits_round_trip(spark, sf_dir):
    scored = _quoted(spark, sf_dir).join(inputs.gold(spark, sf_dir), "doc_id").withColumn(
        "compound", (F.pmod("doc_id", F.lit(9)) - 4) / 8
    )
    splits = evaluate.evaluation_splits(scored)
    back = read_splits(spark, _written(spark, lambda p: evaluate.write_splits(splits, p)))
    return back.select(F.md5("text").alias("text"), "gold", "compound", "scores", "split", "outcome")


# joins


@query
def merge_facts_null_safe(spark, sf_dir):
    facts = inputs.catalog(spark, sf_dir).unionByName(
        spark.range(1).select(F.lit(None).cast("string").alias("wd_id"), F.lit("none").alias("wd_label"), F.lit("no entity").alias("wd_description"))
    )
    table = merge.merge_facts(inputs.mentions(spark, sf_dir), facts, null_safe=True)
    return table.select("ingest_id", "wd_id", "wd_label", "wd_description")


@query
def products_per_section(spark, sf_dir):
    sentiment = _sentiment(spark, sf_dir)
    return count_products(inputs.mentions(spark, sf_dir), sentiment, inputs.catalog(spark, sf_dir)).per_section_per_week


@query
def merge_facts(spark, sf_dir):
    table = merge.merge_facts(inputs.mentions(spark, sf_dir), inputs.catalog(spark, sf_dir))
    return table.select("ingest_id", "wd_id", "wd_label", "wd_description")


@query
def merge_facts_counts(spark, sf_dir):
    return merge.merge_facts(mentions_per_section_per_week(spark, sf_dir), inputs.catalog(spark, sf_dir))


@query
def merge_sentiment(spark, sf_dir):
    # two sources score the same urls, so that mentions double
    doubled = clean.union_sources(
        inputs.gold(spark, sf_dir), inputs.gold(spark, sf_dir).filter("gold <> 'positive'")
    ).select(
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("gold").alias("shorttext_sentiment"),
        F.lit("empty").alias("fulltext_sentiment"),
    )
    merged = merge.merge_sentiment(inputs.mentions(spark, sf_dir), doubled)
    return merged.select("ingest_id", "url", "shorttext_sentiment", "fulltext_sentiment")


@query
def many_to_one(spark, sf_dir):
    right = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("url"), "n_chars"
    )
    return merge.join_many_to_one(inputs.mentions(spark, sf_dir), right, "url").select("ingest_id", "url", "n_chars")


def _scored_texts(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("shorttext"))
    return documents.join(inputs.gold(spark, sf_dir), "doc_id").select("doc_id", "shorttext", F.col("gold").alias("sentiment"))


@query
def attach_by_text(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("shorttext"))
    return merge.attach_by_text(documents, _scored_texts(spark, sf_dir), "doc_id").select("doc_id", "sentiment")


@query
def membership_count(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("shorttext"))
    return merge.membership_count(documents, _scored_texts(spark, sf_dir))


@query
def catalog_todo(spark, sf_dir):
    ids = counts.entity_ids(inputs.mentions(spark, sf_dir))
    return missing_ids(ids, inputs.catalog(spark, sf_dir))


# pages


@query
def page_links(spark, sf_dir):
    teasers = extract.extract_teasers(inputs.pages(spark, sf_dir), extract.NAV_LAYOUT)
    return teasers.select("page_url", "position", "title", "url")


@query
def archive_teasers(spark, sf_dir):
    return extract.extract_teasers(inputs.archive_pages(spark, sf_dir))


@query
def archive_next_page(spark, sf_dir):
    return extract.next_page(inputs.archive_pages(spark, sf_dir))


@query
def classed_page_text(spark, sf_dir):
    html = F.col("html")
    texts = inputs.classed_pages(spark, sf_dir)
    return texts.select("page_id", extract.article_text(html, "filled_nodes", extract.CLASSED_PARAGRAPHS).alias("text"))


@query
def url_sections(spark, sf_dir):
    return extract.with_sections(inputs.pages(spark, sf_dir)).select(
        "page_id", F.array_join("sections", ",").alias("sections"), F.size("sections").cast("bigint").alias("depth")
    )


@query
def page_text(spark, sf_dir):
    found = inputs.pages(spark, sf_dir).select("page_id", extract.paragraphs(F.col("html")).alias("found"))
    variants = ("all_nodes", "filled_nodes", "paragraphs")
    return found.select("page_id", *(extract.joined_paragraphs(F.col("found"), v).alias(v) for v in variants))


@query
def section_carry(spark, sf_dir):
    items = extract.section_carry(inputs.issue_pages(spark, sf_dir))
    return items.select("page_url", "position", "url", F.element_at("sections", 1).alias("section"))


@query
def full_view(spark, sf_dir):
    resolved = extract.resolve_full_view(inputs.linked_pages(spark, sf_dir))
    return resolved.select("page_url", "url", F.md5("html").alias("body"))


@query
def article_shape(spark, sf_dir):
    html = F.col("html")
    teasers = inputs.pages(spark, sf_dir).select(
        F.when(~F.col("url").contains("?"), F.col("url")).alias("url"),
        F.col("page_id").cast("string").alias("tstamp"),
        extract.first_text(html, "<h1>").alias("title"),
        F.lit(None).cast("string").alias("date"),
        extract.first_text(html, r"<a\b[^>]*>").alias("shorttext"),
        extract.article_text(html).alias("fulltext"),
    )
    shaped = extract.shape_listing_articles(teasers)
    return shaped.withColumns({"sections": F.array_join("sections", ","), "fulltext": F.md5("fulltext")}).drop("date")


@query
def kb_flatten(spark, sf_dir):
    return flatten_entities(inputs.entity_documents(spark, sf_dir))


@query
def date_spine(spark, sf_dir):
    day = F.to_date(F.col("ts").cast("timestamp"))
    spans = inputs.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.min(day).alias("start_date"), F.max(day).alias("end_date")
    )
    return spines.date_spine(spans)


@query
def issue_spine(spark, sf_dir):
    first, last = F.min("o_orderdate"), F.max("o_orderdate")
    spans = inputs.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.year(first).alias("start_year"),
        (F.month(first) + 43).alias("start_issue"),
        F.year(last).alias("end_year"),
        F.month(last).alias("end_issue"),
    )
    return spines.issue_spine(spans)


# sentiment


@query
def lexicon_hits_(spark, sf_dir):
    return lexicon_hits(inputs.articles(spark, sf_dir), ["doc_id"], "shorttext", inputs.lexicon(spark, sf_dir))


@query
def token_context_(spark, sf_dir):
    return token_context(inputs.articles(spark, sf_dir), ["doc_id"], "shorttext")


@query
def punct_emphasis(spark, sf_dir):
    return inputs.articles(spark, sf_dir).select("doc_id", punctuation_emphasis(F.col("shorttext")).alias("emphasis"))


def _scores(spark, sf_dir):
    return score_columns(
        inputs.articles(spark, sf_dir).select("doc_id", "shorttext"), ["shorttext"], inputs.lexicon(spark, sf_dir)
    ).select("doc_id", "shorttext_score.*")


@query
def sentiment_compound(spark, sf_dir):
    return _scores(spark, sf_dir)


@query
def sentiment_class(spark, sf_dir):
    return _sentiment(spark, sf_dir)


def _evaluated(spark, sf_dir, labelled_only=False):
    """Labels first, so that only the texts an evaluation asks for are scored."""
    texts = inputs.articles(spark, sf_dir).select("doc_id", "shorttext").join(
        inputs.gold(spark, sf_dir), "doc_id", "inner" if labelled_only else "left"
    )
    scored = score_columns(texts, ["shorttext"], inputs.lexicon(spark, sf_dir))
    return scored.select("doc_id", "gold", F.col("shorttext_score.compound").alias("compound"))


@query
def class_tallies(spark, sf_dir):
    return evaluate.class_tallies(_evaluated(spark, sf_dir))


@query
def evaluation(spark, sf_dir):
    return evaluate.evaluation(_evaluated(spark, sf_dir, labelled_only=True))


@query
def evaluation_splits(spark, sf_dir):
    return evaluate.evaluation_splits(_evaluated(spark, sf_dir)).select("doc_id", "gold", "compound", "split", "outcome")


@query
def mean_sentence_score_(spark, sf_dir):
    return mean_sentence_score(inputs.articles(spark, sf_dir), ["doc_id"], "shorttext", inputs.lexicon(spark, sf_dir))


@query
def mean_tag_score_(spark, sf_dir):
    tags = inputs.articles(spark, sf_dir).select("doc_id", F.split("shorttext", "[.]").alias("tags"))
    return mean_tag_score(tags, ["doc_id"], "tags", inputs.lexicon(spark, sf_dir))


@query
def emoji_description(spark, sf_dir):
    texts = inputs.emoji_texts(spark, sf_dir)
    return describe_emoji(texts, "text", inputs.emoji(spark, sf_dir)).select("doc_id", F.md5("text").alias("text"))


@query
def sentiment_emoji(spark, sf_dir):
    scored = score_columns(
        inputs.emoji_texts(spark, sf_dir), ["text"], inputs.lexicon(spark, sf_dir), inputs.emoji(spark, sf_dir)
    )
    return scored.select("doc_id", "text_score.*")


# linking, models, topics


@query
def link_entities_(spark, sf_dir):
    return link_entities(inputs.articles(spark, sf_dir), inputs.aliases(spark, sf_dir), keep=["doc_id"])


@query
def link_entities_unlinked(spark, sf_dir):
    table = link_entities(inputs.articles(spark, sf_dir), inputs.aliases(spark, sf_dir), keep=["doc_id"], include_unlinked=True)
    return table.select("doc_id", "position", "word_at", "ner_text", "label", "wd_id", "score")


@query
def linked_mentions_per_week(spark, sf_dir):
    facts = inputs.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("wd_id"),
        F.length("text").cast("string").alias("wd_label"),
        F.lit("item").alias("wd_description"),
    )
    table = linked_mentions(inputs.articles(spark, sf_dir), inputs.aliases(spark, sf_dir), facts)
    return counts.count_per_week(table, ["wd_id", "label", "wd_label", "wd_description"])


@query
def batch_score_(spark, sf_dir):
    def stub_model():
        """Stands in for a classifier: counts two letters."""

        def predict(texts: list[str]) -> list[str]:
            return ["positive" if t.count("e") > 2 * t.count("a") else "negative" if "!" in t else "neutral" for t in texts]

        return predict

    return batch_score(inputs.articles(spark, sf_dir).drop("sections"), stub_model)


@query
def scoring_input_(spark, sf_dir):
    return scoring_input(inputs.articles(spark, sf_dir).select("doc_id", "shorttext"), "doc_id")


def _fitted(spark, sf_dir):
    return fit_topics(inputs.articles(spark, sf_dir).select("url", "fulltext"), k=6)


@query
def topics(spark, sf_dir):
    return article_topics(_fitted(spark, sf_dir))


@query
def topic_summary_(spark, sf_dir):
    return topic_summary(_fitted(spark, sf_dir)).withColumn("top_terms", F.array_join("top_terms", " "))
