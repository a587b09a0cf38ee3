"""What the capitals test and the listing of emoji go through."""

from pyspark.sql import functions as F

from mentionmill.operators.sentiment.tokens import caps_differential, describe_emoji


def test_emoji_are_listed_by_one_exchange_of_texts(spark):
    texts = spark.createDataFrame([(1, "a :) b :)"), (2, "a :) b :)"), (3, ":( x"), (4, "none"), (5, None)], "id int, text string")
    emoji = spark.createDataFrame([(":)", "smile"), (":)", "grin"), (":(", "frown")], "emoji string, description string")
    described = describe_emoji(texts, "text", emoji)
    assert dict(map(tuple, described.collect())) == {1: "a smile b smile", 2: "a smile b smile", 3: "frown x", 4: "none", 5: None}
    plan = described._jdf.queryExecution().optimizedPlan().toString()
    # one for the emoji table, one for the texts; a third grouped single items
    assert sum(line.lstrip(" +-:").startswith("Aggregate") for line in plan.splitlines()) == 2


def test_capitals_are_sought_up_to_the_first(spark):
    rows = spark.createDataFrame([(["AB", "cd"],), (["AB"],), (["cd", "12"],), ([],), (["AB", "12"],), (None,)], "tokens array<string>")
    differ = caps_differential(F.col("tokens"))
    assert [r[0] for r in rows.select(differ).collect()] == [True, False, False, False, True, None]
    assert "filter(" not in rows.select(differ.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
