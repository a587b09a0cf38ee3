"""Topics of articles and the summary over all articles, by class-based term weights.

Every article starts in a topic given by a digest of its key. Then, a fixed number of times, each article moves to
the topic whose articles use its words most above the average, not counting its own words. All sums are whole
numbers and ties go to the lower topic, so the result depends neither on partitions nor on the order of rows. The
vocabulary is a table like any other; nothing of it is held by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..tables import Table

PASSES = 3
#: Scale of a word's pull to a topic and of a topic's share of an article.
PULL, SHARE = 1000.0, 1e9
#: Characters of text that a block of articles holds on average.
BLOCK_CHARS = 1 << 23


@dataclass(frozen=True)
class Topics:
    """Word lists of blocks of articles, a list of scores by topic per article, the topic of each (null without words).

    ``words`` has one row per block and word: the numbers of the articles in the block that have the word, and how
    often each has it. ``placed`` has each block's list of topics by article number.
    """

    k: int
    words: DataFrame
    placed: DataFrame
    scores: DataFrame
    assigned: DataFrame


def fit_topics(articles: DataFrame, text: str = "fulltext", key: str = "url", k: int = 10, passes: int = PASSES) -> Topics:
    """Assign all articles to ``k`` topics.

    A word is a run of letters, in lower case. Rows that share a key are one article. An article without words keeps
    its row with a null topic; a null key is an article like any other.

    Articles are dealt to blocks of a fixed size by a hash of their key. What moves in a pass is a row per block and
    word; an article's rows never leave its block, so the work grows with the texts alone.
    """
    chars = articles.agg(F.sum(F.length(text))).head()[0] or 0
    named = F.coalesce(F.col(key).cast("string"), F.lit(WHITESPACE))
    block = F.pmod(F.xxhash64("id"), F.lit(chars // BLOCK_CHARS + 1))
    source = articles.select(F.col(key).alias("key"), named.alias("id"), F.col(text).alias("text")).withColumn("block", block)
    by_id = Window.partitionBy("block").orderBy("id")

    start = F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(k))
    number = (F.dense_rank().over(by_id) - 1).alias("number")
    members = Table(source.select("block", "key", "id").distinct().select("block", "key", "id", number)).df
    letters = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), 1)
    spread = source.select("block", number, "text").select("block", "number", F.explode_outer(letters).alias("word"))
    counted = spread.filter("word IS NOT NULL").groupBy("block", "word", "number").agg(F.count(F.lit(1)).alias("n"))
    # the word first, as sorts compare the beginning of the first key
    listed = counted.groupBy("word", "block").agg(F.collect_list(F.struct("number", "n")).alias("in"))
    words = Table(listed.select("block", "word", F.col("in.number").alias("numbers"), F.col("in.n").alias("ns"))).df

    assigned = Table(members.select("block", "number", start.cast("int").alias("topic")).distinct())
    scores = None
    for _ in range(passes):
        scores = Table(_scores(words, _placed(assigned.df), k))
        # without a word that another article has, an article stays where it is
        best = F.array_max("scores")
        first = (F.array_position("scores", best) - 1).cast("int")
        chosen = scores.df.select("block", "number", F.when(best > 0, first).alias("best"))
        assigned = Table(
            assigned.df.join(chosen, ["block", "number"], "left").select("block", "number", F.coalesce("best", "topic").alias("topic"))
        )
    each = members.join(scores.df, ["block", "number"], "left").join(assigned.df, ["block", "number"])
    found = Table(each.select("key", "id", F.when(F.col("scores").isNotNull(), F.col("topic")).alias("topic"), "scores")).df
    return Topics(k, words, _placed(assigned.df), found.filter("scores IS NOT NULL").select("id", "scores").distinct(), found.select("key", "id", "topic"))


def _placed(assigned: DataFrame) -> DataFrame:
    """(block, topics): the topics of a block's articles in the order of their numbers, which begin at 0 without gaps."""
    in_order = F.array_sort(F.collect_list(F.struct("number", "topic")))
    return assigned.groupBy("block").agg(in_order["topic"].alias("topics"))


def _uses(words: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(word, used, word_n): a word's uses in each topic, and in all."""
    each = words.join(placed, "block").select("word", "topics", "ns", F.posexplode("numbers").alias("at", "number"))
    each = each.select("word", F.get("topics", F.col("number")).alias("topic"), F.get("ns", F.col("at")).alias("n"))
    uses = [F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("n"))), F.lit(0)) for t in range(k)]
    return each.groupBy("word").agg(F.array(*uses).alias("used"), F.sum("n").alias("word_n"))


def _scores(words: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(block, number, scores): how strongly each topic pulls each article, the sum of its words' pulls times their counts.

    A word has one row with its uses in all topics, which goes once to each block that has the word.
    """
    used = Table(_uses(words, placed, k)).df
    topics = range(k)
    sizes = used.agg(F.sum("word_n").alias("all"), *(F.sum(F.get("used", F.lit(t))).alias(f"size{t}") for t in topics))
    shares = [F.when(F.col(f"size{t}") > 0, F.col("all") * F.lit(1.0) / F.col(f"size{t}")) for t in topics]
    # a block's rows come together, and its articles' sums need no further exchange
    met = words.join(used, "word").repartition("block").join(placed, "block")
    each = met.select("block", "topics", "used", "word_n", "ns", F.posexplode("numbers").alias("at", "number"))
    each = each.withColumns({"topic": F.get("topics", F.col("number")), "n": F.get("ns", F.col("at"))}).withColumn(
        "rarity", sizes.select(F.array(*shares)).scalar()
    )
    elsewhere = F.col("word_n") - F.col("n")

    def pull(t: int) -> Column:
        use = F.get("used", F.lit(t))
        others = use - F.when(F.col("topic") == t, F.col("n")).otherwise(0)
        return F.when((use > 0) & (elsewhere > 0), F.floor(others * PULL / elsewhere * F.get("rarity", F.lit(t)))).otherwise(0)

    sums = [F.sum(F.col("n") * pull(t)) for t in topics]
    return each.groupBy("block", "number").agg(F.array(*sums).alias("scores"))


def article_topics(topics: Topics, key: str = "url") -> DataFrame:
    """One row per article and topic with its weight; one with neither for an article without words."""
    sums = topics.scores.withColumn("total", F.aggregate("scores", F.lit(0).cast("long"), lambda a, b: a + b))
    places = F.when(F.col("own").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(topics.k - 1)))
    each = topics.assigned.withColumnRenamed("topic", "own").join(sums, "id", "left").withColumn("topic", F.explode(places))
    met = each.withColumn("score", F.get("scores", F.col("topic")))
    share = F.floor(F.coalesce("score", F.lit(0)) * SHARE / F.col("total")) / SHARE
    alone = F.when(F.col("own") == F.col("topic"), 1.0).otherwise(0.0)
    return met.select(
        F.col("key").alias(key),
        "topic",
        F.when(F.col("topic").isNull(), F.lit(None)).when(F.coalesce("total", F.lit(0)) > 0, share).otherwise(alone).alias("weight"),
    )


def topic_terms(topics: Topics, terms: int = 10) -> DataFrame:
    """The words each topic uses most above the average, in order; equal ones from the end of the alphabet."""
    uses = Table(_uses(topics.words, topics.placed, topics.k)).df
    used = uses.select("word", "word_n", F.posexplode("used").alias("topic", "used")).filter("used > 0")
    sizes = used.groupBy("topic").agg(F.sum("used").alias("size"))
    everything = sizes.agg(F.sum("size").alias("all")).scalar()
    excess = F.col("used") - F.floor(F.col("word_n") * F.lit(1.0) * F.col("size") / everything)
    ranked = used.join(sizes, "topic").select("topic", "word", excess.alias("excess"))
    # the optimizer turns the limit into one per task before the rows of a topic meet
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("excess"), F.desc("word")))
    best = ranked.withColumn("place", place).filter(F.col("place") <= terms)
    in_order = F.array_sort(F.collect_list(F.struct("place", "word")))
    return best.groupBy("topic").agg(F.transform(in_order, lambda x: x["word"]).alias("top_terms"))


def topic_summary(topics: Topics, key: str = "url", terms: int = 10) -> DataFrame:
    """Per topic the number of its articles, its mean weight over all articles with words, and its terms.

    Articles without words are counted in a row with a null topic; there is none if all have words.
    """
    table = article_topics(topics, key)
    counts = topics.assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("n_articles"))
    mean = F.sum(F.round(F.col("weight") * SHARE).cast("long")) / F.count("weight") / SHARE
    means = table.groupBy("topic").agg(mean.alias("mean_weight"))
    return (
        means.join(counts, means["topic"].eqNullSafe(counts["topic"]), "left")
        .join(topic_terms(topics, terms).withColumnRenamed("topic", "_t"), means["topic"] == F.col("_t"), "left")
        .select(means["topic"], F.coalesce("n_articles", F.lit(0)).alias("n_articles"), "mean_weight", "top_terms")
    )
