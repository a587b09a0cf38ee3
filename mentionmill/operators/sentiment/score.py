"""Scores of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.folds import bound
from ...functions.rounding import round_exact
from ...functions.wordlists import ALPHA
from ..clean import CLASS_THRESHOLD, sentiment_class
from .lexicon import Lexicon
from .tokens import caps_differential, clean_words, describe_emoji, punctuation_emphasis
from .valence import add_word_valence, with_neighbours

SENTIMENT_COLUMNS = ["shorttext", "fulltext"]


def _in_order(hits: Column) -> Column:
    """The set of hits as position and value in text order.

    A repeated word has the value of its first use. The hits are sorted by word and place, so equal words are runs;
    the first of a run gives its value as often as the run is long.
    """

    def heads(hs: Column) -> Column:
        """Where runs begin, and the end."""
        n = F.size(hs)
        begins = lambda i: (i == 0) | (i == n) | (F.get(hs, i - 1)["token"] != F.get(hs, i)["token"])
        return F.filter(F.sequence(F.lit(0), n), begins)

    def values(hs: Column, at: Column) -> Column:
        runs = F.slice(at, F.lit(1), F.size(at) - 1)
        return F.flatten(F.transform(runs, lambda h, j: F.array_repeat(F.get(hs, h)["value"], F.get(at, j + 1) - h)))

    def ordered(hs: Column, vs: Column) -> Column:
        return F.sort_array(F.transform(hs, lambda h, i: F.struct(h["pos"].alias("pos"), F.get(vs, i).alias("value"))))

    return bound(
        F.sort_array(hits), lambda hs: bound(heads(hs), lambda at: bound(values(hs, at), lambda vs: ordered(hs, vs)))
    )


def _after_contrast(values: Column, but_at: Column) -> Column:
    """Weaken values before the word "but", strengthen those after it.

    Each step looks up the first place that holds the current value and changes that place, so equal
    values can send a change to an earlier word. When no changed value equals an original one this
    cannot happen, and every value simply gets its own factor.
    """

    def factor(pos: Column) -> Column:
        return F.when(pos < but_at, F.lit(0.5)).when(pos > but_at, F.lit(1.5)).otherwise(F.lit(1.0))

    plain = F.transform(values, lambda h: h["value"])
    scaled = F.transform(values, lambda h: h["value"] * factor(h["pos"]))

    def step(state: Column, k: Column) -> Column:
        place = F.array_position(state, F.element_at(state, k)).cast("int")
        changed = F.element_at(state, place) * factor(F.element_at(values, place)["pos"])
        return F.concat(
            F.slice(state, F.lit(1), place - 1),
            F.array(changed),
            F.slice(state, place + 1, F.size(state)),
        )

    nonzero = F.filter(values, lambda h: (h["value"] != 0) & (h["pos"] != but_at))
    clash = F.arrays_overlap(
        F.transform(nonzero, lambda h: h["value"] * factor(h["pos"])),
        plain,
    ) | F.exists(values, lambda h: (h["pos"] == but_at) & (h["value"] != 0))
    return (
        F.when(F.size(values) == 0, plain)
        .when(clash, F.aggregate(F.sequence(F.lit(1), F.size(values)), plain, step))
        .otherwise(scaled)
    )


def _add_score(texts: DataFrame, column: str) -> DataFrame:
    """The score struct from the word values, word count and emphasis of a text.

    One step per layer of the formula, so that no expression is spelled out inside another.
    """
    values, n, emphasis = f"_values_{column}", f"_n_{column}", f"_emphasis_{column}"
    layers = [
        {
            "_raw": f"aggregate({values}, 0D, (a, v) -> a + v)",
            # each word counts one more, to make up for neutral words that count one
            "_up": f"aggregate({values}, 0D, (a, v) -> IF(v > 0, a + (v + 1), a))",
            "_down": f"aggregate({values}, 0D, (a, v) -> IF(v < 0, a + (1 - v), a))",
            "_neutral": f"CAST({n} - size(filter({values}, v -> v <> 0)) AS DOUBLE)",
        },
        {
            "_strength": f"_raw + signum(_raw) * {emphasis}",
            "_up": f"IF(_up > _down, _up + {emphasis}, _up)",
            "_down": f"IF(_up < _down, _down + {emphasis}, _down)",
        },
        # at least the word count; 1 stands in for a text without words
        {"_total": "greatest(_up + _down + _neutral, 1D)", "_compound": f"_strength / sqrt(_strength * _strength + {ALPHA})"},
        {
            "_compound": "greatest(least(_compound, 1D), -1D)",
            "_pos": "_up / _total",
            "_neg": "_down / _total",
            "_neu": "_neutral / _total",
        },
    ]
    out = texts
    for layer in layers:
        out = out.withColumns({name: F.expr(formula) for name, formula in layer.items()})
    parts = [
        F.when(F.col(n) > 0, round_exact(f"_{part}", digits)).otherwise(F.lit(0.0)).alias(part)
        for part, digits in (("neg", 3), ("neu", 3), ("pos", 3), ("compound", 4))
    ]
    return out.withColumn(f"{column}_score", F.struct(*parts))


def score_columns(
    texts: DataFrame,
    columns: list[str],
    lexicon: DataFrame,
    emoji: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``<column>_score`` (neg, neu, pos, compound) for each text column.

    Words are spread into rows, met with the lexicon and dropped when they miss. Spark sends a small lexicon to the
    tasks that read the texts, and then only one row per text with its lexicon words is shuffled.
    Rows alike in ``keep`` and text fold into one on the way and are repeated at the end.

    ``keep`` lists the columns that come along (default: all but the scored ones; no maps).
    """
    keep = [c for c in texts.columns if c not in columns] if keep is None else keep
    table = Lexicon(lexicon)

    named = texts.select(
        *keep,
        F.xxhash64(*columns).alias("_texts"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("text")) for i, c in enumerate(columns)])).alias("_c"),
    ).select(*keep, "_texts", F.col("_c.i").alias("_i"), F.coalesce("_c.text", F.lit("")).alias("_text"))
    if emoji is not None:
        named = describe_emoji(named, "_text", emoji)

    tokens = F.col("tokens")
    measured = named.withColumn("tokens", clean_words(F.col("_text"))).select(
        *keep,
        "_texts",
        "_i",
        "tokens",
        F.size(tokens).alias("_n"),
        caps_differential(tokens).alias("caps"),
        punctuation_emphasis(F.col("_text")).alias("_emphasis"),
        F.when(
            F.lower("_text").contains("but"), F.array_position(F.transform(tokens, F.lower), F.lit("but")).cast("int") - 1
        ).alias("_but"),
    )
    # the null after the last word keeps texts without lexicon words
    spread = measured.select(
        "*", F.posexplode(F.concat(tokens, F.array(F.lit(None).cast("string")))).alias("pos", "token")
    )
    # each word takes its neighbours along, so that no join carries a text's whole word list
    spread = with_neighbours(spread).drop("tokens")
    found = table.matched(spread, "token", F.xxhash64("_texts", "pos"))
    valued = add_word_valence(found, table)

    hit = F.when(F.col("token").isNotNull(), F.struct("token", "pos", "value"))
    end = F.col("token").isNull()
    aggregates = [F.count(F.when(end & (F.col("_i") == 0), F.lit(1))).alias("_copies")]
    for i, c in enumerate(columns):
        mine = F.col("_i") == i
        aggregates += [
            F.collect_set(F.when(mine, hit)).alias(f"_hits_{c}"),
            F.max(F.when(mine & end, F.col("_n"))).alias(f"_n_{c}"),
            F.max(F.when(mine & end, F.col("_emphasis"))).alias(f"_emphasis_{c}"),
            F.max(F.when(mine & end, F.col("_but"))).alias(f"_but_{c}"),
        ]
    out = valued.groupBy(*keep, "_texts").agg(*aggregates)

    for c in columns:
        but = F.when(F.col(f"_but_{c}") >= 0, F.col(f"_but_{c}"))
        out = out.withColumn(f"_hits_{c}", _in_order(F.col(f"_hits_{c}"))).withColumn(
            f"_values_{c}",
            F.when(but.isNotNull(), _after_contrast(F.col(f"_hits_{c}"), but)).otherwise(
                F.transform(f"_hits_{c}", lambda h: h["value"])
            ),
        )
        out = _add_score(out, c)
    return out.select(
        *keep, *[f"{c}_score" for c in columns], F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")
    ).drop("_copy")


def score_sentiment(
    articles: DataFrame,
    lexicon: DataFrame,
    emoji: DataFrame | None = None,
    columns: list[str] | None = None,
    threshold: float = CLASS_THRESHOLD,
) -> DataFrame:
    """Sentiment class per text column; a column that is not scored holds ``empty``.

    Text and date columns are dropped, as the mention tables need only url, time and sections.
    """
    columns = ["shorttext"] if columns is None else columns
    keep = [c for c in articles.columns if c not in {*SENTIMENT_COLUMNS, *columns, "date", "title"}]
    scored = score_columns(articles, columns, lexicon, emoji, keep)
    labels = [
        (
            sentiment_class(F.col(f"{c}_score.compound"), threshold) if c in columns else F.lit("empty")
        ).alias(f"{c}_sentiment")
        for c in [*SENTIMENT_COLUMNS, *[c for c in columns if c not in SENTIMENT_COLUMNS]]
    ]
    return scored.select(*keep, *labels)


def mean_sentence_score(
    texts: DataFrame, key: list[str], text: str, lexicon: DataFrame, emoji: DataFrame | None = None
) -> DataFrame:
    """Mean compound over the sentences of each text, four digits.

    A null text, an empty one or one without a sentence keeps its row: 0 sentences, null mean.
    """
    sentences = texts.select(*key, F.posexplode_outer(F.split(text, r"(?<=[.!?])\s+")).alias("_sentence", "_text"))
    return _mean(sentences.withColumn("_counts", F.coalesce(F.col("_text") != "", F.lit(False))), key, lexicon, emoji)


def mean_tag_score(
    tags: DataFrame, key: list[str], tag_list: str, lexicon: DataFrame, emoji: DataFrame | None = None
) -> DataFrame:
    """Mean compound over a list of tags, four digits. A null or empty list keeps its row: 0 tags, null mean."""
    items = tags.select(*key, F.posexplode_outer(tag_list).alias("_tag", "_text"))
    return _mean(items.withColumn("_counts", F.col("_tag").isNotNull()), key, lexicon, emoji)


def _mean(items: DataFrame, key: list[str], lexicon: DataFrame, emoji: DataFrame | None) -> DataFrame:
    scored = score_columns(items, ["_text"], lexicon, emoji)
    # compound has four decimals, so whole ten-thousandths add up exactly in any order
    units = F.when(F.col("_counts"), F.round(F.col("_text_score.compound") * 10000).cast("bigint"))
    n = F.count(units)
    sums = scored.groupBy(*key).agg(
        n.alias("sentences"), F.when(n > 0, F.sum(units) / F.lit(10000.0) / F.greatest(n, F.lit(1))).alias("_mean")
    )
    return sums.select(*key, "sentences", round_exact("_mean", 4).alias("mean_compound"))
