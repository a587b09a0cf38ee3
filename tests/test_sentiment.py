import random
import time

import pytest
from pyspark.sql import functions as F

from mentionmill.functions.wordlists import IDIOMS, NEGATIONS
from mentionmill.operators.sentiment import score_columns, score_sentiment
from mentionmill.operators.sentiment.lexicon import lexicon_hits
from mentionmill.operators.sentiment.score import mean_sentence_score, mean_tag_score
from mentionmill.operators.sentiment.tokens import (
    caps_differential,
    clean_words,
    describe_emoji,
    punctuation_emphasis,
    token_context,
)

from . import scalar_model

LEXICON = {
    "gut": 1.9, "schlecht": -2.1, "Tod": -2.5, "super": 3.8, "mies": -1.4, "right": 1.2, "shit": -2.6,
    "so": 0.7, "nicht": -0.3, "death": -2.9, "bad": -2.5, "null": 0.0, "kind": 1.1, "HASS": -3.1, "froh": 0.95,
    "ass": -1.0, "Übel": -1.4,
}
EMOJI = {"😁": "super Lachen", "1️⃣": "eins", "💘": "Herz but gut"}
FILLER = [
    "but", "BUT", "sehr", "SEHR", "Kaum", "kaum", "etwas", "never", "this", "without", "doubt", "least", "at", "very",
    "kind", "of", "kiss", "the", "bomb", "yeah", "Haus", "HAUS", "can't", "x", "Straße", "ÄRGER", "über", "1a", "nix",
]


def lexicon_table(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, valence double")


def emoji_table(spark):
    return spark.createDataFrame(list(EMOJI.items()), "emoji string, description string")


def random_text(rng):
    vocabulary = [*LEXICON, *FILLER, *[w.upper() for w in LEXICON], *EMOJI, *NEGATIONS[:6], *[w for i in IDIOMS for w in i.split()]]
    if rng.random() < 0.5:
        vocabulary = rng.sample(vocabulary, 8)
    marks = ["", "", "", "", "!", "?", "??", "!!!", ".", ",", "'", "?!?", "--"]
    items = [
        rng.choice(["", "", "", "", '"', "-", "!"]) + rng.choice(vocabulary) + rng.choice(marks)
        for _ in range(rng.randint(0, 14))
    ]
    return rng.choice([" ", "  ", "\n", "  "]).join(items)


def test_scores_equal_the_scalar_rules(spark):
    rng = random.Random(7)
    texts = [(i, random_text(rng)) for i in range(6000)]
    table = spark.createDataFrame(texts, "id int, text string").repartition(4)
    got = {
        r["id"]: r["text_score"].asDict()
        for r in score_columns(table, ["text"], lexicon_table(spark), emoji_table(spark)).collect()
    }
    assert len(got) == len(texts)
    wrong = [(t, got[i], want) for i, t in texts if got[i] != (want := scalar_model.score(t, LEXICON, EMOJI))]
    assert not wrong, wrong[:5]


def test_long_text_with_contrast(spark):
    rng = random.Random(3)
    words = [rng.choice([*LEXICON, "Haus", "sehr", "nicht"]) for _ in range(6000)]
    words[2500] = "but"
    text = " ".join(words)
    row = score_columns(
        spark.createDataFrame([(1, text)], "id int, text string"), ["text"], lexicon_table(spark)
    ).first()
    assert row["text_score"].asDict() == scalar_model.score(text, LEXICON)


def test_same_rows_stay_apart(spark):
    rows = [(1, "sehr gut"), (1, "sehr gut"), (1, "schlecht"), (2, None), (2, "")]
    out = score_columns(spark.createDataFrame(rows, "id int, text string"), ["text"], lexicon_table(spark))
    found = sorted((r["id"], r["text_score"]["compound"]) for r in out.collect())
    want = sorted((i, scalar_model.score(t or "", LEXICON)["compound"]) for i, t in rows)
    assert found == want


def test_score_sentiment_columns(spark):
    rows = [("/a", 1, ["x"], "gut", "schlecht"), ("/b", 2, None, None, "gut gut")]
    table = spark.createDataFrame(rows, "url string, tstamp long, sections array<string>, shorttext string, fulltext string")
    short = score_sentiment(table, lexicon_table(spark)).orderBy("url").collect()
    assert [tuple(r) for r in short] == [("/a", 1, ["x"], "positive", "empty"), ("/b", 2, None, "neutral", "empty")]
    both = score_sentiment(table, lexicon_table(spark), columns=["shorttext", "fulltext"]).orderBy("url").collect()
    assert [tuple(r)[3:] for r in both] == [("positive", "negative"), ("neutral", "positive")]


@pytest.mark.parametrize(
    "text, words",
    [("cat,", ["cat"]), (",cat", ["cat"]), ('"cat"', ['"cat"']), ("a b1", ["b1"]), ("cat!!!", ["cat"]), ("cat!!!!", ["cat!!!!"]),
     ("don't,", ["don't,"]), ("a,", ["a,"]), ("ab-", ["ab"]), ("", [])],
)
def test_clean_words(spark, text, words):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean_words(F.col("t"))).first()[0] == words == scalar_model.tokens(text)


@pytest.mark.parametrize("tokens, want", [(["AA", "BB"], False), (["AA", "bb"], True), (["aa", "bb"], False), ([], False)])
def test_caps_differential(spark, tokens, want):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(caps_differential(F.col("t"))).first()[0] is want


@pytest.mark.parametrize("text, want", [("!!!!!!", 1.168), ("??", 0.36), ("????", 0.96), ("?", 0.0), ("!?", 0.292)])
def test_punctuation_emphasis(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(punctuation_emphasis(F.col("t"))).first()[0] == pytest.approx(want)


def test_emoji_description(spark):
    df = spark.createDataFrame([("wie 😁 1️⃣ 1x 😁😁",)], "t string")
    assert describe_emoji(df, "t", emoji_table(spark)).first()[0] == "wie super Lachen eins 1x 😁😁"
    empty = spark.createDataFrame([], "emoji string, description string")
    assert describe_emoji(df, "t", empty).first()[0] == "wie 😁 1️⃣ 1x 😁😁"
    rows = [(1, "😁 a 😁"), (2, "😁 a 😁"), (3, None), (4, ""), (5, "  a  b "), (6, "😁")]
    got = describe_emoji(spark.createDataFrame(rows, "id int, t string"), "t", emoji_table(spark))
    assert {r["id"]: r["t"] for r in got.collect()} == {
        1: "super Lachen a super Lachen", 2: "super Lachen a super Lachen", 3: None, 4: "", 5: "a b", 6: "super Lachen",
    }


def test_context_and_hits(spark):
    df = spark.createDataFrame([(1, "sehr gut, nicht GUT")], "id int, t string")
    rows = token_context(df, ["id"], "t").orderBy("pos").collect()
    assert rows[1].asDict() == {
        "id": 1, "pos": 1, "token": "gut", "prev1": "sehr", "prev2": None, "prev3": None, "next1": "nicht", "next2": "GUT",
    }
    hits = lexicon_hits(df, ["id"], "t", lexicon_table(spark)).orderBy("pos").collect()
    assert [(r["pos"], r["valence"]) for r in hits] == [(1, 1.9), (2, -0.3), (3, 1.9)]


def test_means(spark):
    lexicon = lexicon_table(spark)
    text = "Sehr gut! Das ist schlecht. Haus?"
    df = spark.createDataFrame([(1, text, ["gut", "gut", "mies"])], "id int, t string, tags array<string>")
    parts = [scalar_model.score(s, LEXICON)["compound"] for s in ("Sehr gut!", "Das ist schlecht.", "Haus?")]
    assert mean_sentence_score(df, ["id"], "t", lexicon).first()["mean_compound"] == round(sum(parts) / 3, 4)
    tags = [scalar_model.score(s, LEXICON)["compound"] for s in ("gut", "gut", "mies")]
    assert mean_tag_score(df, ["id"], "tags", lexicon).first()["mean_compound"] == round(sum(tags) / 3, 4)


def test_plan_keeps_words_local(spark, tmp_path):
    """A lexicon in a small file goes to the tasks that read the texts."""
    df = spark.createDataFrame([(1, "gut")], "id int, t string")
    lexicon_table(spark).write.parquet(str(tmp_path / "lexicon"))
    plan = score_columns(df, ["t"], spark.read.parquet(str(tmp_path / "lexicon")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 4
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_lexicon_beyond_broadcast(spark):
    """One word in half of all rows, the lexicon met by shuffle: the plan is the same but for the joins, as are the scores."""
    rows = [(i, "gut " * 40 + f"wort{i} schlecht" if i % 2 else f"Gut wort{i} SCHLECHT haus") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string")
    want = {r["id"]: r["t_score"] for r in score_columns(df, ["t"], lexicon_table(spark)).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        scored = score_columns(df, ["t"], lexicon_table(spark))
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert {r["id"]: r["t_score"] for r in scored.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        if adaptive is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)


def test_means_keep_every_row(spark):
    lexicon = lexicon_table(spark)
    df = spark.createDataFrame([(1, "Sehr gut!", ["gut"]), (2, None, None), (3, "", [])], "id int, t string, tags array<string>")
    for means in (mean_sentence_score(df, ["id"], "t", lexicon), mean_tag_score(df, ["id"], "tags", lexicon)):
        got = {r["id"]: (r["sentences"], r["mean_compound"]) for r in means.collect()}
        assert got[2] == got[3] == (0, None) and got[1][0] == 1 and got[1][1] > 0


def test_many_distinct_words_and_repeats(spark):
    """40,000 distinct lexicon words, some of them twice: a repeated word has the value of its first use."""
    words = [f"wort{i}" for i in range(40_000)]
    lexicon = spark.createDataFrame([(w, 1.5) for w in words], "word string, valence double")
    df = spark.createDataFrame([(1, " ".join(words) + " nicht wort7 nicht wort9")], "id int, t string")
    scored = score_columns(df, ["t"], lexicon)
    assert scored.first()["t_score"]["compound"] == 1.0
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries(transform" not in plan
    start = time.perf_counter()
    scored.collect()
    assert time.perf_counter() - start < 10
