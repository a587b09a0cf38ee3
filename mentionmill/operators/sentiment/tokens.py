"""From a text to its list of words, inside the row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.folds import bound
from ...functions.text import has_edge, is_upper, words
from ...functions.wordlists import EXCLAMATION, MANY_QUESTIONS, PUNCTUATION, QUESTION

_MARK = "(?:" + "|".join(re.escape(p) for p in sorted(PUNCTUATION, key=len, reverse=True)) + ")"
_MARK_CHARS = "".join(sorted({p[0] for p in PUNCTUATION}))
_WORD = r"[^\p{Punct}]{2,}"
_ONE_MARK = f"^(?:({_WORD}){_MARK}|{_MARK}({_WORD}))$"


def clean_words(text: Column) -> Column:
    """Words of a text: items of one character are dropped, one mark is taken off one end.

    The mark goes only when what is left has two characters or more and no other punctuation.
    """
    return F.transform(
        F.filter(words(text), lambda w: F.length(w) > 1),
        lambda w: F.when(has_edge(w, _MARK_CHARS), F.regexp_replace(w, _ONE_MARK, "$1$2")).otherwise(w),
    )


def describe_emoji(texts: DataFrame, text: str, emoji: DataFrame) -> DataFrame:
    """Replace each item of ``text`` that is an emoji by its description, items joined by one space.

    Items are rows that meet the emoji table by equality; only those that are emoji go on, and come back to their
    text by its digest, as a list of places and descriptions. A null text stays null.
    """
    one_each = emoji.filter(F.col("emoji") != "").groupBy("emoji").agg(F.max("description").alias("_description"))
    items = F.filter(words(F.col(text)), lambda w: w != "")
    digest = F.md5(text)
    spread = texts.select(digest.alias("_digest"), F.posexplode_outer(items).alias("_pos", "_item"))
    # at most one entry for each item of the text; copies of a text give the same ones
    entries = F.collect_set(F.struct("_pos", "_description"))
    listed = spread.join(one_each, F.col("_item") == F.col("emoji")).groupBy("_digest").agg(F.sort_array(entries).alias("_found"))

    def placed(known: Column) -> Column:
        """The descriptions at the places of their items, with nulls between them."""
        none = F.lit(None).cast("string")
        gap = lambda f, i: f["_pos"] - F.when(i > 0, F.get(known, i - 1)["_pos"] + 1).otherwise(0)
        return F.flatten(F.transform(known, lambda f, i: F.concat(F.array_repeat(none, gap(f, i)), F.array(f["_description"]))))

    described = bound(
        placed(F.col("_found")), lambda d: F.array_join(F.transform(items, lambda w, i: F.coalesce(F.get(d, i), w)), " ")
    )
    out = F.when(F.col("_found").isNull(), F.array_join(items, " ")).otherwise(described)
    return texts.withColumn("_digest", digest).join(listed, "_digest", "left").withColumn(text, out).select(*texts.columns)


def caps_differential(tokens: Column) -> Column:
    """Some words are all capitals and some are not."""
    # each search ends at its first find
    return F.exists(tokens, is_upper) & F.exists(tokens, lambda w: ~is_upper(w))


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def punctuation_emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the strength of a text."""
    marks, questions = _occurrences(text, "!"), _occurrences(text, "?")
    exclaim = F.least(marks, F.lit(4)) * F.lit(EXCLAMATION)
    ask = (
        F.when(questions > 3, F.lit(MANY_QUESTIONS))
        .when(questions > 1, questions * F.lit(QUESTION))
        .otherwise(F.lit(0.0))
    )
    return exclaim + ask


def token_context(texts: DataFrame, key: list[str], text: str, before: int = 3, after: int = 2) -> DataFrame:
    """One row per word with its neighbours, taken by index from the row's own word list."""
    # outer: the optimizer would guard a plain explode by making the word list a second time
    spread = (
        texts.select(*key, clean_words(F.col(text)).alias("_tokens"))
        .select(*key, "_tokens", F.posexplode_outer("_tokens").alias("pos", "token"))
        .filter(F.col("pos").isNotNull())
    )
    previous = [F.get("_tokens", F.col("pos") - k).alias(f"prev{k}") for k in range(1, before + 1)]
    following = [F.get("_tokens", F.col("pos") + k).alias(f"next{k}") for k in range(1, after + 1)]
    return spread.select(*key, F.col("pos").cast("bigint").alias("pos"), "token", *previous, *following)
