"""The valence lexicon as a lookup side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import capitalize
from .tokens import clean_words


#: Rows of one word are dealt over so many shares, should the lexicon have to be met by shuffle.
SALTS = 8


class Lexicon:
    """A lexicon ready to be joined with words, by one plan at every size.

    A word is looked up as written, then in lower case, then capitalised. All three follow from its lower-case form,
    so one table keyed by it serves them. Spark joins it as its size suggests, by what it knows in advance or finds
    at run time. Beyond a broadcast the rows of a word that is everywhere are split by a salt, with as many copies of
    the lexicon; words without an entry meet none and go.
    """

    def __init__(self, lexicon: DataFrame):
        exact = lexicon.dropna().groupBy("word").agg(F.max("valence").alias("valence"))
        key = F.lower(F.col("word"))
        self._entries = exact
        self._folded = exact.groupBy(key.alias("folded")).agg(
            F.max(F.when(F.col("word") == key, F.col("valence"))).alias("lower_valence"),
            F.max(F.when(F.col("word") == capitalize(key), F.col("valence"))).alias("capital_valence"),
            # a word has few spellings
            F.map_from_entries(F.collect_list(F.struct("word", "valence"))).alias("spellings"),
        )

    def matched(self, words: DataFrame, word: str, salt: Column, name: str = "valence") -> DataFrame:
        """Rows whose ``word`` has a valence, and those whose word is null; ``salt`` is a hash that parts equal words."""
        # words are never empty: the empty one stands for null, and is an entry too
        table = self._folded.filter("folded <> ''").unionByName(
            words.sparkSession.sql("SELECT '' AS folded"), allowMissingColumns=True
        )
        copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = words.withColumns(
            {"_key": F.coalesce(F.lower(F.col(word)), F.lit("")), "_salt": F.pmod(salt, F.lit(SALTS)).cast("int")}
        )
        valence = F.coalesce(F.try_element_at("spellings", F.col(word)), "lower_valence", "capital_valence")
        return (
            dealt.join(copies, (F.col("_key") == F.col("folded")) & (F.col("_salt") == F.col("_copy")))
            .withColumn(name, F.when(F.col(word).isNotNull(), valence))
            .drop("_key", "_salt", *copies.columns)
            .filter(F.col(name).isNotNull() | F.col(word).isNull())
        )

    def add_known(self, words: DataFrame, lowered: str, name: str) -> DataFrame:
        """Flag whether the lower-case word ``lowered`` is a lexicon entry."""
        entries = self._entries.select(F.col("word").alias("_entry"), F.col("valence").alias("_v1"))
        return (
            words.join(entries, F.col(lowered) == F.col("_entry"), "left")
            .withColumn(name, F.col("_v1").isNotNull())
            .drop("_entry", "_v1")
        )


def lexicon_hits(texts: DataFrame, key: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """Words of the texts that have a lexicon valence."""
    spread = texts.select(*key, F.posexplode_outer(clean_words(F.col(text))).alias("pos", "token")).filter(F.col("token").isNotNull())
    hits = Lexicon(lexicon).matched(spread, "token", F.xxhash64(*key, "pos"))
    return hits.select(*key, F.col("pos").cast("bigint").alias("pos"), "token", "valence")
