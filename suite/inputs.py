"""The given tables in the shapes the operators take.

Each input is stated twice: as a DataFrame here and as SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionmill.operators.link import name_words

# Word replacements that bring German sentiment words into the given texts.
MARKED_WORDS = [
    (" the ", " sehr "), (" of ", " nicht "), (" de ", " kaum "), (" is ", " so "), (" that ", " yeah right "),
    (" and ", " gut "), (" in ", " Tod "), (" der ", " never "), (" die ", " without doubt "), (" to ", " least "),
    (" la ", " schlecht "), (" for ", " kind of "), (" a ", " ETWAS "), (" it ", " SUPER "), (" was ", " this! "),
    (" on ", " ganz?? "),
]
FIXED_VALENCES = {
    "gut": 1.9, "schlecht": -2.1, "Tod": -2.9, "super": 3.1, "right": 1.2, "kind": 1.5, "nicht": -0.4,
}


# Emoji put in place of words, and the first code point of the emoji table.
EMOJI_BASE = 0x1F600
EMOJI_WORDS = [(" the ", " \U0001f600 "), (" of ", " \U0001f605 \U0001f605 "), (" de ", " :-21 "), (" and ", " \U0001f600\U0001f605 "), (" la ", " \U0001f612, ")]

# Tag replacements that make an archive listing of a page; only its list items are teasers.
ARCHIVE_TAGS = [
    ("<li>", '<div data-teaserdate="1687000000" class="box teaser-right"><span class="teaser-right__date">2023</span><h3 class="teaser-right__headline">Kopf</h3><p class="teaser-right__shorttext"> Kurz &amp; gut </p>'),
    ('<a href="', '<a class="teaser-right__link" href="'),
    ("</li>", "</div>"),
    ("</ul>", '</ul><li class="next"><a class="paginierung__liste--link" href="/archiv/2">weiter</a></li>'),
]

# Tag replacements that give paragraphs the classes of an article's body, inside blocks.
CLASSED_TAGS = [("<p>", '<div><p class="x paragraph article__item">'), ("</p>", "</p></div>")]

# Tag replacements that make an issue overview of a page.
ISSUE_TAGS = [
    ("<article>", "<div>"), ("</article>", "</div>"), ("title>", "h2>"), ("h1>", "h2>"), ("li>", "article>"),
    ("<p>", "<article>"), ("</p>", "</article>"), ("</ul>", "</ul><h2></h2>"), ("<b>", "<h2>Ressorts</h2>"),
    ("<br>", '<a href="/more">more</a><h2>Mehr</h2>'),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it lies on disk."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions from events: a few articles draw most of them, some lack an entity or sections."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/doc/"), F.floor(value * 2).cast("string")).alias("url"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("tstamp"),
        F.when(value < 2, F.array().cast("array<string>")).otherwise(F.array("event_type", F.lit("x"))).alias("sections"),
        F.col("event_type").alias("label"),
        F.when((value < 2) | (value >= 4), F.concat(F.lit("Q"), F.col("user_id").cast("string"))).alias("wd_id"),
        (value / 500).alias("score"),
        F.col("event_id").alias("ingest_id"),
    )


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions over several years, across daylight-saving changes."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/order/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("tstamp"),
        F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("wd_id"),
        F.col("o_orderstatus").alias("label"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity facts from suppliers; users beyond the last supplier have none."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("s_nationkey"), F.col("n_name").alias("wd_description")
    )
    return (
        table(spark, sf_dir, "supplier")
        .withColumn("s_nationkey", F.col("s_nationkey").cast("bigint"))
        .join(nation, "s_nationkey")
        .select(
            F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("wd_id"),
            F.col("s_name").alias("wd_label"),
            "wd_description",
        )
    )


def marked_text(text: str = "text"):
    """The text with its replacements."""
    out = F.col(text)
    for old, new in MARKED_WORDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from documents, whole texts."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("url"),
        (F.col("doc_id") * 3600 + 1704067200).alias("tstamp"),
        marked_text().alias("shorttext"),
        F.col("text").alias("fulltext"),
        F.array("source").alias("sections"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valences for the longer words of the benchmark texts, by a rule, and for a few German words."""
    words = (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(F.split("text", r"\s+")).alias("item"))
        .select(F.translate("item", ".,", "").alias("word"))
        .filter(F.length("word") >= 5)
        .filter(~F.col("word").isin(list(FIXED_VALENCES)))
        .distinct()
        .select("word", (((F.length("word") * 7 + F.ascii("word")) % 9 - 4) * F.lit(0.475)).alias("valence"))
    )
    rows = ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in FIXED_VALENCES.items())
    return words.unionByName(spark.sql(f"SELECT * FROM VALUES {rows} AS t(word, valence)"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold classes from the quality labels."""
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("gold"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the benchmark texts: their long words, and the first two to eight words of each."""
    items = table(spark, sf_dir, "benchmark").select("item_id", name_words(F.col("text")).alias("words"))
    entity = F.concat(F.lit("B"), F.col("item_id").cast("string"))
    single = items.select(
        F.explode("words").alias("name"), F.lit("WORD").alias("label"), entity.alias("wd_id"), F.lit(0.3).alias("score")
    ).filter(F.length("name") >= 8)
    phrases = items.select("words", entity.alias("wd_id"), F.explode(F.array(*map(F.lit, (2, 3, 4, 5, 8)))).alias("n")).select(
        F.array_join(F.slice("words", F.lit(1), F.col("n")), " ").alias("name"),
        F.concat(F.lit("PHRASE"), F.col("n").cast("string")).alias("label"),
        "wd_id",
        (F.lit(1.0) / F.col("n")).alias("score"),
    )
    return single.unionByName(phrases)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages as given."""
    return table(spark, sf_dir, "pages")


def emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emoji with two words each from the names of nations; the last ones are no single characters."""
    sign = F.decode(F.unhex(F.lpad(F.hex(F.col("n_nationkey").cast("bigint") + EMOJI_BASE), 8, "0")), "UTF-32")
    name = F.concat(F.lower("n_name"), F.lit(" super"))
    return table(spark, sf_dir, "nation").select(
        F.when(F.col("n_nationkey") < 20, sign).otherwise(F.concat(F.lit(":-"), F.col("n_nationkey").cast("string"))).alias("emoji"),
        name.alias("description"),
    )


def emoji_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with emoji in place of some words."""
    out = F.col("text")
    for old, new in EMOJI_WORDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("text"))


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rewritten as archive listings: each list item a teaser, paragraphs as short texts."""
    html = F.col("html")
    for old, new in ARCHIVE_TAGS:
        html = F.replace(html, F.lit(old), F.lit(new))
    return pages(spark, sf_dir).select("url", html.alias("html"))


def classed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose paragraphs carry the classes of an article's body, nested in blocks of their own."""
    html = F.col("html")
    for old, new in CLASSED_TAGS:
        html = F.replace(html, F.lit(old), F.lit(new))
    return pages(spark, sf_dir).select("page_id", html.alias("html"))


def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rewritten as issue overviews: titles and headings as section headers, list items as articles."""
    html = F.col("html")
    for old, new in ISSUE_TAGS:
        html = F.replace(html, F.lit(old), F.lit(new))
    return pages(spark, sf_dir).select("url", html.alias("html"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link a full view: chains of up to ten pages of a host, some of them closed to a circle."""
    by_host = Window.partitionBy("host").orderBy("url", "page_id")
    base = pages(spark, sf_dir).withColumn("host", F.split("url", "/")[2])
    placed = base.withColumn("chain", F.floor((F.row_number().over(by_host) - 1) / 10))
    in_chain = Window.partitionBy("host", "chain").orderBy("url", "page_id")
    circle = F.when(F.pmod(F.length("host") + F.col("chain"), F.lit(3)) == 0, F.first("url").over(in_chain))
    target = F.coalesce(F.lead("url").over(in_chain), circle)
    link = F.when(target.isNotNull(), F.concat(F.lit('<a data-ct-label="all" href="'), target, F.lit('">all</a>'))).otherwise("")
    return placed.select("url", F.concat("html", link).alias("html"))


def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity documents written from suppliers, some of them under another id."""
    name, balance = F.col("s_name"), F.col("s_acctbal")

    def value(language: str, text):
        return F.create_map(F.lit(language), F.create_map(F.lit("value"), text))

    none = F.from_json(F.lit("{}"), "map<string, map<string, string>>")
    labels = F.when(balance > 6000, F.map_concat(value("de", name), value("en", F.upper(name)))).when(
        balance > 2000, value("en", F.upper(name))
    ).otherwise(none)
    descriptions = F.when(F.col("s_nationkey") > 10, value("en", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")))).otherwise(
        F.when(F.col("s_nationkey") > 5, value("de", name)).otherwise(none)
    )
    asked = F.concat(F.lit("Q"), F.col("s_suppkey").cast("string"))
    true_id = F.when(balance < 0, F.concat(F.lit("R"), F.col("s_suppkey").cast("string"))).otherwise(asked)
    entity = F.create_map(F.lit("labels"), labels, F.lit("descriptions"), descriptions)
    body = F.to_json(F.struct(F.create_map(true_id, entity).alias("entities")))
    return table(spark, sf_dir, "supplier").select(
        asked.alias("wd_id"), F.concat(F.lit("https://kb.example/"), asked).alias("url"), body.alias("body")
    )
