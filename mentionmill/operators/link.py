"""Entity mentions from article text by means of a name table ``(name, label, wd_id, score)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import scan
from ..functions.text import ASCII_PUNCTUATION, has_edge, words

ENTITY_URL = "https://www.wikidata.org/wiki/"


def _trim_marks(word: Column) -> Column:
    trimmed = F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", "")
    return F.when(has_edge(word, ASCII_PUNCTUATION), trimmed).otherwise(word)


def name_words(text: Column) -> Column:
    """Words of a text without punctuation around them; words of punctuation alone are dropped."""
    return F.filter(F.transform(words(text), _trim_marks), lambda w: w != "")


def _name_table(aliases: DataFrame) -> DataFrame:
    """The best entity per name. A name's score does not depend on the text, so this needs no mentions."""
    # bounds on the word list, not on the name: those would be checked again for every run of words
    return (
        aliases.withColumn("_parts", name_words(F.col("name")))
        .filter(F.size("_parts") > 0)
        .withColumn("name", F.array_join("_parts", " "))
        .groupBy("name")
        # the smallest id settles equal scores
        .agg(F.min(F.struct((-F.col("score")).alias("_order"), "wd_id", "label", "score")).alias("_best"))
        .select("name", "_best.label", "_best.wd_id", "_best.score")
    )


def _pick(candidates: Column) -> Column:
    """Left to right, the longest candidate that starts after the last one taken."""
    kind = "struct<start:int,_order:int,n_words:int,name:string,label:string,wd_id:string,score:double>"
    start = F.struct(F.lit(0).alias("free"), F.lit(None).cast(kind).alias("found"))

    def take(state: Column, c: Column) -> Column:
        fits = c["start"] >= state["free"]
        free = F.when(fits, c["start"] + c["n_words"]).otherwise(state["free"])
        return F.struct(free.alias("free"), F.when(fits, c).alias("found"))

    return scan(candidates, start, take, kind)


def _join_runs(grouped: DataFrame, taken: str) -> DataFrame:
    """Make one mention of neighbouring words without an entity.

    A run begins where a mention is not the direct neighbour of one like it; the places of the beginnings cut the
    list into runs.
    """
    follows = (
        f"get({taken}, i).wd_id IS NULL AND get({taken}, i - 1).wd_id IS NULL "
        f"AND get({taken}, i - 1).start + get({taken}, i - 1).n_words = get({taken}, i).start"
    )
    heads = F.expr(f"filter(sequence(0, size({taken})), i -> i = 0 OR i = size({taken}) OR NOT ({follows}))")
    run = "sequence(h, get(_heads, j + 1) - 1)"
    joined = (
        f"transform(slice(_heads, 1, size(_heads) - 1), (h, j) -> named_struct('start', get({taken}, h).start, "
        f"'n_words', aggregate({run}, 0, (n, i) -> n + get({taken}, i).n_words), "
        f"'name', array_join(transform({run}, i -> get({taken}, i).name), ' '), "
        f"'label', get({taken}, h).label, 'wd_id', get({taken}, h).wd_id, 'score', get({taken}, h).score))"
    )
    return grouped.withColumn("_heads", heads).withColumn(taken, F.expr(joined)).drop("_heads")


def link_entities(
    articles: DataFrame,
    aliases: DataFrame,
    text: str = "fulltext",
    keep: list[str] | None = None,
    include_unlinked: bool = False,
    entity_url: str = ENTITY_URL,
) -> DataFrame:
    """One row per mention, numbered in text order.

    Words that begin no name are dropped first. The others are followed by as many words as the longest
    name has, and the run lengths that some name with that first word has are looked up. Whether the two
    name tables are broadcast is left to Spark's size checks; a text's whole word list is in no shuffle
    either way. Overlaps go to the leftmost and then the longest name.

    ``include_unlinked`` also gives runs of capitalised words outside any name, with a null entity.
    """
    keep = ["url", "tstamp", "sections"] if keep is None else keep
    names = _name_table(aliases)
    longest = names.agg(F.coalesce(F.max(F.size(F.split("name", " "))), F.lit(1)).alias("n")).scalar()

    # outer: the optimizer would guard a plain explode by making the word list a second time
    spread = articles.select(
        *keep, F.xxhash64(text).alias("_text"), name_words(F.col(text)).alias("_words")
    ).select("*", F.posexplode_outer("_words").alias("start", "_first"))
    spread = spread.withColumn("_run", F.slice("_words", F.col("start") + 1, longest)).drop("_words")
    lengths = names.groupBy(F.substring_index("name", " ", 1).alias("_first")).agg(
        F.collect_set(F.size(F.split("name", " "))).alias("_lengths")
    )
    spread = spread.join(lengths, "_first", "left" if include_unlinked else "inner")
    if include_unlinked:
        # length 0 stands for the word itself, without an entity
        bare = F.when(F.substring("_first", 1, 1) != F.lower(F.substring("_first", 1, 1)), F.array(F.lit(0)))
        none = F.array().cast("array<int>")
        spread = spread.withColumn("_lengths", F.concat(F.coalesce("_lengths", none), F.coalesce(bare, none)))
    runs = (
        spread.select(*keep, "_text", "_run", "start", F.explode("_lengths").alias("_length"))
        .filter(F.col("_length") <= F.size("_run"))
        .withColumn("n_words", F.greatest("_length", F.lit(1)))
        .withColumn("name", F.array_join(F.slice("_run", F.lit(1), F.col("n_words")), " "))
        .drop("_run")
    )
    if include_unlinked:
        linked = F.col("_length") > 0
        found = (
            runs.join(names, "name", "left")
            .filter(~linked | F.col("wd_id").isNotNull())
            .withColumns({c: F.when(linked, F.col(c)) for c in ("label", "wd_id", "score")})
        )
    else:
        found = runs.join(names, "name")
    # rows alike in every kept column and in text fold together; _rows tells how many there were
    candidate = F.struct(
        "start", (-F.col("_length")).alias("_order"), "n_words", "name", "label",
        F.col("wd_id").cast("string").alias("wd_id"), F.col("score").cast("double").alias("score"),
    )
    grouped = (
        found.groupBy(*keep, "_text")
        .agg(F.collect_set(candidate).alias("_found"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_copies", (F.col("_rows") / F.size("_found")).cast("int"))
        .withColumn("_sorted", F.sort_array("_found"))
        .withColumn("_taken", _pick(F.col("_sorted")))
    )
    if include_unlinked:
        grouped = _join_runs(grouped, "_taken")
    mention = F.col("_m")
    return (
        grouped.select(*keep, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"), "_taken")
        .select(*keep, F.posexplode_outer("_taken").alias("position", "_m"))
        .select(
            *keep,
            (F.col("position") + 1).cast("bigint").alias("position"),
            mention["start"].cast("bigint").alias("word_at"),
            mention["name"].alias("ner_text"),
            mention["label"].alias("label"),
            mention["wd_id"].alias("wd_id"),
            F.concat(F.lit(entity_url), mention["wd_id"]).alias("wd_url"),
            mention["score"].alias("score"),
        )
    )
