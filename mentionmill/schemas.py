"""Declared schemas (DDL), so that no reader has to infer one."""

# tstamp arrives as epoch digits or as an ISO string; the reader normalises it to seconds.
ARTICLE_RAW = (
    "url STRING, tstamp STRING, title STRING, date STRING, shorttext STRING, fulltext STRING, "
    "sections ARRAY<STRING>"
)

MENTION_RAW = (
    "url STRING, tstamp STRING, sections ARRAY<STRING>, ner_text STRING, label STRING, "
    "wd_id STRING, wd_url STRING, score DOUBLE"
)

ARTICLE_SENTIMENT_RAW = (
    "url STRING, tstamp STRING, sections ARRAY<STRING>, shorttext_sentiment STRING, fulltext_sentiment STRING"
)

CATALOG = (
    "wd_url STRING, wd_id STRING, wd_redirect STRING, wd_label STRING, wd_description STRING"
)

ENTITY_DOCUMENT = "wd_id STRING, url STRING, body STRING"

PAGE = "url STRING, html STRING"

LABELLED_TEXT = "id STRING, label STRING, text STRING"
SCORED_TEXT = "text STRING, gold STRING, compound DOUBLE, scores STRING"
