import datetime as dt
import html
import random
import time
import zoneinfo

import pytest
from pyspark.sql import functions as F

from mentionmill.functions import folds
from mentionmill.functions.rounding import round_exact
from mentionmill.functions.sections import first_section, sections_from_url
from mentionmill.functions.text import capitalize, is_upper, strip, unescape_html, words
from mentionmill.functions.time import epoch_seconds, local_time, utc_label, week_label
from mentionmill.operators import clean, counts, evaluate, extract, merge, spines
from mentionmill.operators.entities import flatten_entities, missing_ids
from mentionmill.operators.link import link_entities, name_words
from mentionmill.operators.lookup import left_lookup
from mentionmill.operators.model import batch_score
from mentionmill.operators.rowids import dense_row_ids
from mentionmill.operators.topics import fit_topics
from mentionmill.plans.products import count_products, linked_mentions
from mentionmill.sources.delimited import read_splits

MENTION = "url string, tstamp long, sections array<string>, label string, wd_id string, score double"


def one(spark, value, schema, expr):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expr(F.col("x"))).first()[0]


# functions


def test_round_exact_equals_decimal_rounding(spark):
    rng = random.Random(1)
    values = [i / 80 for i in range(-80, 81)] + [i / 2000 for i in range(2001)] + [rng.uniform(-1, 1) for _ in range(5000)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    rows = table.select("v", round_exact("v", 3).alias("r3"), round_exact("v", 4).alias("r4")).collect()
    assert all((r["r3"], r["r4"]) == (round(r["v"], 3), round(r["v"], 4)) for r in rows)


@pytest.mark.parametrize("text", ["a b", " a  b ", "a\xa0b", "a b　c", "a\x1cb", "a​b", ""])
def test_words_split_like_python(spark, text):
    got = one(spark, text, "string", lambda x: F.filter(words(x), lambda w: w != ""))
    assert got == text.split()
    assert one(spark, text, "string", strip) == text.strip()


@pytest.mark.parametrize("word", ["GROSS", "GROß", "gross", "1A", "12", "Ärger", "ÄRGER", "ß", "ßa", "éCOLE", "don't"])
def test_case_like_python(spark, word):
    assert one(spark, word, "string", is_upper) is word.isupper()
    assert one(spark, word, "string", capitalize) == word.capitalize()


def test_unescape(spark):
    assert one(spark, "&#228;&amp;lt; &#x1F600; &ouml; &#zz; R&D", "string", unescape_html) == "ä&lt; 😀 ö &#zz; R&D"
    for text in ("&oslash;&ntilde;&trade;&rsaquo; &auml x", "&#00000228;&#xE4;&#228 &#0;&#99999999999;", "&ampamp; &notit; &nope; & &", "&NotEqualTilde;"):
        assert one(spark, text, "string", unescape_html) == html.unescape(text)


def test_epoch_forms(spark):
    for text, want in [("1687000000", 1687000000), ("2023-06-17T13:06:40+02:00", 1687000000), ("soon", None), (None, None)]:
        assert one(spark, text, "string", epoch_seconds) == want


def test_weeks_across_clock_changes(spark):
    berlin = zoneinfo.ZoneInfo("Europe/Berlin")
    seconds = list(range(1679000000, 1699000000, 1801))
    table = spark.createDataFrame([(s,) for s in seconds], "s long")
    rows = table.select("s", local_time(F.col("s")).alias("l"), week_label(F.col("s")).alias("w")).collect()
    for r in rows:
        local = dt.datetime.fromtimestamp(r["s"], berlin).replace(tzinfo=None)
        assert r["l"] == local
        assert r["w"] == local.date() + dt.timedelta(days=6 - local.weekday())


def test_week_bounds_and_utc_label(spark):
    berlin = zoneinfo.ZoneInfo("Europe/Berlin")
    sunday = int(dt.datetime(2023, 3, 26, 23, 59, 59, tzinfo=berlin).timestamp())
    rows = spark.createDataFrame([(sunday,), (sunday + 1,)], "s long").select(
        week_label(F.col("s")).alias("w"), utc_label(week_label(F.col("s"))).alias("u")
    ).collect()
    assert [str(r["w"]) for r in rows] == ["2023-03-26", "2023-04-02"]
    assert [r["u"] for r in rows] == ["2023-03-25T23:00:00.000Z", "2023-04-01T22:00:00.000Z"]


def test_week_label_ignores_session_zone(spark):
    table = spark.createDataFrame([(1679871600,)], "s long")
    want = table.select(week_label(F.col("s"))).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert table.select(week_label(F.col("s"))).first()[0] == want
        label = table.select(utc_label(week_label(F.col("s")))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert label == table.select(utc_label(week_label(F.col("s")))).first()[0]


def test_sections(spark):
    for value, want in [(None, None), ([], None), (["a", "b"], "a")]:
        assert one(spark, value, "array<string>", first_section) == want
    for url, want in [("/a/b/c.html", ["a", "b"]), ("https://x.de/a/c.html?y=/z", ["a"]), (None, []), ("/c.html", [])]:
        assert one(spark, url, "string", sections_from_url) == want


# filters and counts


def test_drop_front_page(spark):
    rows = [(["Seite 1"],), (["Seite 1", "x"],), (None,), ([],)]
    kept = clean.drop_front_page(spark.createDataFrame(rows, "sections array<string>")).collect()
    assert sorted(str(r[0]) for r in kept) == sorted(str(s) for (s,) in rows[1:])


def test_drop_ads(spark):
    table = spark.createDataFrame([("https://premium.zeit.de/abo",), ("https://www.zeit.de/a",)], "url string")
    assert [r[0] for r in clean.drop_ads(table).collect()] == ["https://www.zeit.de/a"]


def test_counts_drop_null_keys(spark):
    rows = [("/a", 1679871600, ["s"], "PER", "Q1", 0.5), ("/a", 1679871600, [], "PER", "Q1", 0.5), ("/b", 1679871600, ["s"], "PER", None, 0.5)]
    table = spark.createDataFrame(rows, MENTION)
    assert [(r["wd_id"], r["count"]) for r in counts.mentions_per_week(table).collect()] == [("Q1", 2)]
    assert [(r["section"], r["count"]) for r in counts.mentions_per_section_per_week(table).collect()] == [("s", 1)]
    assert [r[0] for r in counts.entity_ids(table).collect()] == ["Q1"]
    assert [r[0] for r in counts.entity_ids(table, keep_null=True).collect()] == ["Q1", None]
    assert counts.article_count(table, approximate=True).first()[0] == 2


def test_dedupe_takes_the_first(spark):
    rows = [("/a", "Q1", 3, "c"), ("/a", "Q1", 1, "a"), ("/a", None, 2, "b"), ("/a", None, 4, "d")]
    table = spark.createDataFrame(rows, "url string, wd_id string, at long, x string")
    assert sorted(r["x"] for r in clean.dedupe_mentions(table, "at").collect()) == ["a", "b"]


# joins


@pytest.mark.parametrize("bounds", [{}, "shuffle"])
def test_merges(spark, bounds):
    if bounds == "shuffle":
        bounds = {}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_merges(spark, bounds)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check_merges(spark, bounds):
    mentions = spark.createDataFrame([("/a", "Q1"), ("/a", "Q2"), ("/b", None)], "url string, wd_id string")
    catalog = spark.createDataFrame([("Q1", "eins", "one"), (None, "x", "y")], "wd_id string, wd_label string, wd_description string")
    got = merge.merge_facts(mentions, catalog, **bounds).collect()
    assert sorted((r["wd_id"] or "", r["wd_label"]) for r in got) == [("", None), ("Q1", "eins"), ("Q2", None)]
    same = merge.merge_facts(mentions, catalog, null_safe=True, **bounds).collect()
    assert sorted((r["wd_id"] or "", r["wd_label"]) for r in same) == [("", "x"), ("Q1", "eins"), ("Q2", None)]
    sentiment = spark.createDataFrame([("/a", "p", "empty"), ("/a", "n", "empty")], "url string, shorttext_sentiment string, fulltext_sentiment string")
    doubled = merge.merge_sentiment(mentions, sentiment, **bounds).collect()
    assert sorted((r["url"], r["shorttext_sentiment"]) for r in doubled if r["url"] == "/a") == [("/a", "n"), ("/a", "n"), ("/a", "p"), ("/a", "p")]
    assert len(doubled) == 5


def test_lookups_leave_the_join_to_spark(spark):
    left = spark.range(100).select((F.col("id") % 3).cast("string").alias("k"), "id")
    right = spark.range(3).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"))
    assert "strategy=broadcast" not in left_lookup(left, right, "k")._jdf.queryExecution().analyzed().toString()


def test_rows_without_key_are_spread(spark):
    left = spark.range(10_000).select(F.lit(None).cast("string").alias("k"), "id")
    right = spark.createDataFrame([("a", 1)], "k string, n int")
    joined = left_lookup(left, right, "k")
    assert joined.filter("n IS NULL AND k IS NULL").count() == 10_000
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "Union" in plan and "isnull(k" in plan


def test_keys_meet_in_their_common_type(spark):
    left = spark.createDataFrame([(1.0,), (2.5,), (None,)], "k double")
    right = spark.createDataFrame([(1, "one"), (2, "two")], "k int, v string")
    assert sorted((str(r["k"]), r["v"]) for r in left_lookup(left, right, "k").collect()) == [("1.0", "one"), ("2.5", None), ("None", None)]
    texts = spark.createDataFrame([("1",), ("x",)], "k string")
    assert sorted((r["k"], r["v"]) for r in left_lookup(texts, right, "k").collect()) == [("1", "one"), ("x", None)]


def test_null_filters_reach_below_the_sentiment_join(spark, tmp_path):
    rows = [("/a", 1_700_000_000, ["s"], "l", "Q1", 0.9)]
    spark.createDataFrame(rows, MENTION).write.parquet(str(tmp_path / "m"))
    sentiment = spark.createDataFrame([("/a", "p", "n")], "url string, shorttext_sentiment string, fulltext_sentiment string")
    merged = merge.merge_sentiment(spark.read.parquet(str(tmp_path / "m")), sentiment)
    plan = counts.mentions_per_section_per_sentiment_per_week(merged)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plan and "IsNotNull(wd_id)" in plan and "IsNotNull(tstamp)" in plan


def test_many_to_one_refuses_repeats(spark):
    left = spark.createDataFrame([("/a",)], "url string")
    right = spark.createDataFrame([("/a", 1), ("/a", 2)], "url string, n int")
    with pytest.raises(ValueError, match="not unique"):
        merge.join_many_to_one(left, right, "url")


def test_attach_and_membership(spark):
    articles = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, shorttext string")
    rows = [("a", "positive", 1), ("a", "negative", 2), (None, "neutral", 3)]
    scored = spark.createDataFrame(rows, "shorttext string, sentiment string, at int")
    assert sorted((r["id"], r["sentiment"]) for r in merge.attach_by_text(articles, scored, "at").collect()) == [(1, "positive"), (2, None), (3, None)]
    assert merge.membership_count(articles, scored).first()[0] == 1


# entities


def test_flatten_entities(spark):
    def body(true_id, labels, descriptions):
        import json

        return json.dumps({"entities": {true_id: {"labels": labels, "descriptions": descriptions, "sitelinks": [1]}}})

    de, en = {"language": "de", "value": "Haus"}, {"language": "en", "value": "house"}
    rows = [
        ("Q1", "u1", body("Q1", {"en": en, "de": de}, {"de": de})),
        ("Q2", "u2", body("Q9", {"en": en}, {"en": en})),
        ("Q3", "u3", body("Q3", {}, {})),
        ("Q4", "u4", "not json"),
    ]
    got = flatten_entities(spark.createDataFrame(rows, "wd_id string, url string, body string")).orderBy("wd_id").collect()
    assert [tuple(r) for r in got] == [
        ("u1", "Q1", None, "Haus", "Q1"),
        ("u2", "Q2", "Q9", "house", "house"),
        ("u3", "Q3", None, "Q3", "Q3"),
    ]


def test_missing_ids(spark):
    requested = spark.createDataFrame([("Q1",), ("Q2",)], "wd_id string")
    known = spark.createDataFrame([("Q1",), (None,)], "wd_id string")
    assert [r[0] for r in missing_ids(requested, known).collect()] == ["Q2"]


def test_spines(spark):
    days = spark.createDataFrame([(dt.date(2023, 6, 1), dt.date(2023, 6, 4)), (dt.date(2023, 6, 1), dt.date(2023, 6, 1))], "start_date date, end_date date")
    assert [str(r["day"]) for r in spines.date_spine(days).collect()] == ["2023-06-02", "2023-06-03", "2023-06-04"]
    span = spark.createDataFrame([(2022, 54, 2023, 2), (2023, 3, 2023, 2)], "start_year int, start_issue int, end_year int, end_issue int")
    got = spines.issue_spine(span).collect()
    assert [(r["year"], r["issue"]) for r in got] == [(2022, 54), (2022, 55), (2023, 1), (2023, 2)]
    assert got[2]["url"].endswith("/2023/01/index")


def test_row_ids(spark):
    order = random.Random(5).sample(range(10**12), 999) + [10**15]
    table = spark.createDataFrame([(n, str(n)) for n in order], "n long, s string").repartition(5)
    got = {r["n"]: r["row_id"] for r in dense_row_ids(table, "n", buckets=7).collect()}
    assert got == {n: i for i, n in enumerate(sorted(order), start=1)}
    nulls = spark.createDataFrame([(None, "a"), (5, "b"), (3, "c"), (None, "d")], "n long, s string")
    numbered = {r["s"]: r["row_id"] for r in dense_row_ids(nulls, "n", buckets=3).collect()}
    assert (numbered["c"], numbered["b"]) == (1, 2) and {numbered["a"], numbered["d"]} == {3, 4}


# linking


ALIASES = [("Berlin", "LOC", "Q64", 0.9), ("Berlin", "PER", "Q1", 0.2), ("Neue Berlin Zeitung", "ORG", "Q2", 0.5), ("Zeitung", "MISC", "Q3", 0.3), ("New York", "LOC", "Q60", 0.9)]


def brute_force(text, names):
    parts = [w for w in (p.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for p in text.split()) if w]
    out, at = [], 0
    while at < len(parts):
        for n in (4, 3, 2, 1):
            name = " ".join(parts[at : at + n])
            if at + n <= len(parts) and name in names:
                out.append((at, name, names[name]))
                at += n
                break
        else:
            at += 1
    return out


def link(spark, texts, **options):
    articles = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, fulltext string")
    aliases = spark.createDataFrame(ALIASES, "name string, label string, wd_id string, score double")
    return link_entities(articles, aliases, keep=["id"], **options)


def test_link_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["Neue", "Berlin", "Zeitung", "New", "York,", "(Berlin)", "und", "die", "...", "York", "Zeitung."]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(300)]
    names = {"Berlin": "Q64", "Neue Berlin Zeitung": "Q2", "Zeitung": "Q3", "New York": "Q60"}
    got: dict[int, list] = {}
    for r in link(spark, texts).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["word_at"], r["ner_text"], r["wd_id"]))
    assert {i: m for i, t in enumerate(texts) if (m := brute_force(t, names))} == got


def test_link_without_broadcast(spark):
    texts = ["Die Neue Berlin Zeitung in New York", "Berlin Berlin"]
    want = sorted(map(tuple, link(spark, texts).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, link(spark, texts).collect())) == want and len(want) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_of_any_length(spark):
    names = [("Amt", "ORG", "Q1", 0.9), ("Amt fuer Bau und Wohnen", "ORG", "Q2", 0.5), ("a b c d e f g h", "X", "Q3", 0.1)]
    aliases = spark.createDataFrame(names, "name string, label string, wd_id string, score double")
    articles = spark.createDataFrame([(1, "Das Amt fuer Bau und Wohnen und ein Amt fuer Bau; a b c d e f g h.")], "id int, fulltext string")
    rows = link_entities(articles, aliases, keep=["id"]).orderBy("position").collect()
    assert [r["wd_id"] for r in rows] == ["Q2", "Q1", "Q3"]
    assert link_entities(articles, aliases.limit(0), keep=["id"]).count() == 0


def test_link_unlinked_runs(spark):
    rows = link(spark, ["Frau Angela Muster besucht Berlin Mitte"], include_unlinked=True).orderBy("position").collect()
    assert [(r["ner_text"], r["wd_id"], r["wd_url"] is None) for r in rows] == [
        ("Frau Angela Muster", None, True), ("Berlin", "Q64", False), ("Mitte", None, True),
    ]


def test_link_keeps_equal_rows(spark):
    aliases = spark.createDataFrame(ALIASES, "name string, label string, wd_id string, score double")
    articles = spark.createDataFrame([(1, "New York Berlin")] * 3, "id int, fulltext string")
    assert link_entities(articles, aliases, keep=["id"]).count() == 6


def test_name_words(spark):
    assert one(spark, "«Hallo», (Welt) -- don't!", "string", name_words) == ["«Hallo»", "Welt", "don't"]


# model, evaluation, plans


def test_batch_score(spark):
    sizes = spark.sparkContext.accumulator(0)

    def factory():
        def predict(texts):
            sizes.add(1)
            assert len(texts) <= 50
            return ["long" if len(t) > 3 else "short" for t in texts]

        return predict

    rows = [(f"/{i}", i, "ab" if i % 2 else "abcdef", None) for i in range(120)]
    table = spark.createDataFrame(rows, "url string, tstamp long, shorttext string, fulltext string").coalesce(1)
    got = batch_score(table, factory).collect()
    assert len(got) == 120
    assert got[0].asDict() == {"url": "/0", "tstamp": 0, "shorttext_sentiment": "long", "fulltext_sentiment": "short"}
    assert sizes.value == 2 * 3


SCORED = [("positive", 0.3), ("positive", 0.0), ("positive", -0.3), ("negative", -0.06), ("neutral", 0.05), ("neutral", 0.01), ("neutral", -0.9), ("unknown", 0.2), (None, 0.2)]


def test_evaluation(spark):
    table = spark.createDataFrame(SCORED, "gold string, compound double")
    tallies = evaluate.class_tallies(table).first().asDict()
    assert tallies == {
        "total": 9, "predicted_positive": 4, "predicted_neutral": 2, "predicted_negative": 3,
        "gold_positive": 3, "gold_neutral": 3, "gold_negative": 1, "gold_unknown": 2,
    }
    rows = {r["gold"]: tuple(r)[1:] for r in evaluate.evaluation(table).collect()}
    assert rows == {"positive": (3, 1, 1, 1, 0, 0), "negative": (1, 1, 0, 0, 0, 0), "neutral": (3, 1, 0, 0, 1, 1)}


def test_evaluation_splits(spark, tmp_path):
    table = spark.createDataFrame(SCORED[:7], "gold string, compound double").withColumns({"text": F.lit("t"), "scores": F.lit("{}")})
    splits = evaluate.evaluation_splits(table)
    got = {(r["split"], r["outcome"]): r["count"] for r in splits.groupBy("split", "outcome").count().collect()}
    assert got == {
        ("all", "right"): 2, ("all", "wrong"): 2, ("all", "right_neutral"): 1, ("all", "wrong_neutral"): 2,
        ("polar", "right"): 2, ("polar", "wrong"): 2, ("polar_wide", "right"): 1, ("polar_wide", "wrong"): 3,
        ("no_neutral", "right"): 2, ("no_neutral", "wrong_neutral"): 1, ("no_neutral", "wrong"): 1,
        ("negative_only", "right"): 1,
    }
    evaluate.write_splits(splits, str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=polar_wide" / "outcome=right").is_dir()
    awkward = splits.withColumn("text", F.lit('a "b"\tc\nd'))
    evaluate.write_splits(awkward, str(tmp_path / "awkward"))
    back = read_splits(spark, str(tmp_path / "awkward"))
    assert back.count() == awkward.count() and {r["text"] for r in back.collect()} == {'a "b"\tc\nd'}
    assert back.filter("split = 'polar_wide' AND outcome = 'wrong'").count() == 3


def test_products_end_to_end(spark):
    articles = spark.createDataFrame(
        [("/a", 1679871600, ["Politik"], "gut", "Berlin und Berlin"), ("/b", 1679871600, ["Seite 1"], "gut", "Berlin")],
        "url string, tstamp long, sections array<string>, shorttext string, fulltext string",
    )
    aliases = spark.createDataFrame(ALIASES, "name string, label string, wd_id string, score double")
    catalog = spark.createDataFrame([("Q64", "Berlin", "capital")], "wd_id string, wd_label string, wd_description string")
    mentions = linked_mentions(articles, aliases, catalog)
    assert [r["wd_label"] for r in mentions.collect()] == ["Berlin", "Berlin"]
    sentiment = articles.select("url", F.lit("positive").alias("shorttext_sentiment"), F.lit("empty").alias("fulltext_sentiment"))
    products = count_products(mentions.drop("wd_label", "wd_description"), sentiment, catalog)
    row = products.per_section_per_sentiment_per_week.first().asDict()
    assert row == {
        "week_end": dt.date(2023, 4, 2), "section": "Politik", "sentiment": "positive", "wd_id": "Q64", "count": 2,
        "wd_label": "Berlin", "wd_description": "capital",
    }
    assert products.per_week.first()["count"] == 2


def _seconds(df):
    """Of the second of two runs."""
    for _ in range(2):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        taken = time.perf_counter() - start
    return taken


def _one_text(spark, name, text):
    return spark.createDataFrame([(1, text)], f"id long, {name} string")


GROWING = {
    "page text": lambda spark, n: _one_text(spark, "html", "<article>" + "<p>some <b>bold</b> text</p>" * n + "</article>").select(
        extract.article_text(F.col("html"))
    ),
    "sections": lambda spark, n: extract.section_carry(
        _one_text(spark, "html", "<h2>A</h2><article><a href='/x'></a></article>" * n).withColumn("url", F.lit("/"))
    ),
    "links": lambda spark, n: link_entities(
        _one_text(spark, "fulltext", "Berlin Haus " * n), spark.createDataFrame(ALIASES, "name string, label string, wd_id string, score double"),
        keep=["id"], include_unlinked=True,
    ),
}


@pytest.mark.parametrize("name", GROWING)
def test_time_grows_with_the_text(spark, name):
    make = GROWING[name]
    small, large = _seconds(make(spark, 10_000)), _seconds(make(spark, 20_000))
    assert large < 10 and large < 2.5 * small + 1, (small, large)


def test_scan_goes_through_blocks(spark):
    """Running sums at every third item, over arrays around the block's length."""
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.when(x % 3 == 0, s["sum"] + x).alias("found"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("found"))
    for n in (0, 1, folds.BLOCK - 1, folds.BLOCK, folds.BLOCK + 1, 5 * folds.BLOCK + 7):
        df = spark.createDataFrame([(list(range(1, n + 1)),)], "xs array<long>")
        got = df.select(folds.scan(F.col("xs"), start, step, "bigint")).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1) if i % 3 == 0]


def test_rows_of_one_value_are_numbered(spark):
    table = spark.range(300).select((F.col("id") % 3).cast("long").alias("n"), F.col("id").alias("x")).unionByName(
        spark.createDataFrame([(None, 1000), (None, 1001)], "n long, x long")
    )
    rows = dense_row_ids(table, "n", buckets=5).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(1, 303))
    assert [r["n"] for r in rows] == [0] * 100 + [1] * 100 + [2] * 100 + [None] * 2
    assert {r["x"] for r in rows} == {*range(300), 1000, 1001}
    empty = dense_row_ids(table.filter("n > 9"), "n")
    assert empty.columns == ["row_id", "n", "x"] and empty.count() == 0


def test_topics_join_one_row_per_word(spark):
    articles = spark.createDataFrame([("/a", "rot rot blau"), ("/b", "rot gelb"), ("/c", None)], "url string, fulltext string")
    fitted = fit_topics(articles, k=4)
    assert fitted.scores.count() == 2 and {len(r["scores"]) for r in fitted.scores.collect()} == {4}
