import gzip
import json

from pyspark.sql import functions as F

from mentionmill.operators.clean import union_sources
from mentionmill.operators.counts import mentions_per_week, with_utc_label
from mentionmill.operators.entities import missing_ids
from mentionmill.sources import delimited, jsonl


def lines(folder):
    return [line for part in sorted(folder.glob("part-*")) for line in part.read_text().splitlines()]


def test_articles(spark, tmp_path):
    rows = [
        {"url": "/a", "tstamp": "1687000000", "title": "t", "sections": ["x", "y"]},
        {"url": "/b", "tstamp": 1687000001, "sections": ""},
        {"url": "/c", "tstamp": "2023-06-17T13:06:40+02:00", "sections": []},
        {"url": "/d"},
    ]
    path = tmp_path / "a.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    got = jsonl.read_articles(spark, str(path)).collect()
    assert [(r["url"], r["tstamp"], r["sections"]) for r in got] == [
        ("/a", 1687000000, ["x", "y"]), ("/b", 1687000001, None), ("/c", 1687000000, []), ("/d", None, None),
    ]


def test_nan_is_null(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"url": "/a", "tstamp": 1, "wd_id": NaN, "score": NaN}\n{"url": "/b", "tstamp": 2, "wd_id": "Q1", "score": 0.5}\n')
    got = jsonl.read_mentions(spark, str(path)).orderBy("url").collect()
    assert [(r["wd_id"], r["score"]) for r in got] == [(None, None), ("Q1", 0.5)]


def test_catalog_grows_by_appending(spark, tmp_path):
    folder = tmp_path / "catalog"
    first = spark.createDataFrame([("u1", "Q1", None, "eins", "one")], "wd_url string, wd_id string, wd_redirect string, wd_label string, wd_description string")
    jsonl.write_jsonl(first, str(folder), mode="append")
    (folder / "part-zzz.json").write_text('not json\n["a"]\n')
    requested = spark.createDataFrame([("Q1",), ("Q2",)], "wd_id string")
    todo = missing_ids(requested, jsonl.read_catalog(spark, str(folder)))
    assert [r[0] for r in todo.collect()] == ["Q2"]
    second = todo.select(F.lit("u2").alias("wd_url"), "wd_id", F.lit(None).cast("string").alias("wd_redirect"), F.lit("zwei").alias("wd_label"), F.lit("two").alias("wd_description"))
    jsonl.write_jsonl(second, str(folder), mode="append")
    assert sorted(r["wd_id"] for r in jsonl.read_catalog(spark, str(folder)).collect()) == ["Q1", "Q2"]


def test_sinks(spark, tmp_path):
    mentions = spark.createDataFrame([("/a", 1679871600, "Q1")], "url string, tstamp long, wd_id string")
    counts = with_utc_label(mentions_per_week(mentions))
    jsonl.write_jsonl(counts, str(tmp_path / "w"))
    assert [json.loads(x) for x in lines(tmp_path / "w")] == [{"tstamp": "2023-04-01T22:00:00.000Z", "wd_id": "Q1", "count": 1}]
    stamped = spark.sql("SELECT timestamp_seconds(1679871600) AS t")
    jsonl.write_jsonl(stamped, str(tmp_path / "t"))
    assert lines(tmp_path / "t") == ['{"t":"2023-03-26T23:00:00.000Z"}']
    many = spark.range(450).coalesce(1)
    jsonl.write_jsonl(many, str(tmp_path / "n"), rows_per_file=200)
    assert len(list((tmp_path / "n").glob("part-*.json"))) == 3
    jsonl.write_jsonl(many, str(tmp_path / "z"), gzip=True)
    assert list((tmp_path / "z").glob("part-*.json.gz"))


def test_json_array(spark, tmp_path):
    ids = spark.createDataFrame([(f"Q{i}",) for i in range(50)] + [('Q"x\\',)], "wd_id string").repartition(4)
    jsonl.write_json_array(ids, str(tmp_path / "ids"), "wd_id", scalar=True)
    assert json.loads("\n".join(lines(tmp_path / "ids"))) == sorted(r[0] for r in ids.collect())
    rows = spark.createDataFrame([(2, None), (1, "a")], "k int, v string")
    jsonl.write_json_array(rows, str(tmp_path / "rows"), "k")
    assert json.loads("\n".join(lines(tmp_path / "rows"))) == [{"k": 1, "v": "a"}, {"k": 2, "v": None}]
    jsonl.write_json_array(rows.limit(0), str(tmp_path / "none"), "k")
    assert json.loads("".join(lines(tmp_path / "none"))) == []


def test_lexicon_and_emoji(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("gut\t1.9\t0.3\t[1, 2]\nmies\t-1.0\ngut\t2.0\n\nohne\n")
    got = {r["word"]: r["valence"] for r in delimited.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()}
    assert got == {"gut": 2.0, "mies": -1.0}
    (tmp_path / "emoji.txt").write_text("😁\tlachendes Gesicht\n")
    assert [tuple(r) for r in delimited.read_emoji(spark, str(tmp_path / "emoji.txt")).collect()] == [("😁", "lachendes Gesicht")]


def test_scored_folder(spark, tmp_path):
    for name, text in [("X_Negative.tsv", "schlecht"), ("positive_neutral.tsv", "gut"), ("neutral.tsv", "na"), ("other.tsv", "?"), ("negative.txt", "no")]:
        (tmp_path / name).write_text(f"{text}\tunknown\t0.5\t{{'neg': 0.0}}\n")
    got = delimited.read_scored_dir(spark, str(tmp_path))
    assert {r["text"]: r["sentiment"] for r in got.collect()} == {"schlecht": "negative", "gut": "positive", "na": "neutral", "?": None}
    delimited.write_csv(got, str(tmp_path / "csv"))
    back = delimited.read_scored_csv(spark, str(tmp_path / "csv"))
    assert {r["shorttext"]: r["sentiment"] for r in back.collect()}["schlecht"] == "negative"
    assert back.columns == ["shorttext", "gold", "compound", "scores", "sentiment"]


def test_scoring_input(spark, tmp_path):
    table = spark.createDataFrame([(i * 7, f"text {i}") for i in range(40)], "n long, shorttext string").repartition(3)
    delimited.write_scoring_input(table, str(tmp_path / "in"), "n")
    got = sorted((line.split("\t") for line in lines(tmp_path / "in")), key=lambda f: int(f[0]))
    assert got == [[str(i + 1), "unknown", f"text {i}"] for i in range(40)]
    labelled = delimited.read_labelled(spark, str(tmp_path / "in"))
    assert labelled.filter("label = 'unknown'").count() == 40


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("Q1", 0.5)], "wd_id string, score double")
    b = spark.createDataFrame([("Q2",)], "wd_id string")
    assert sorted(map(tuple, union_sources(a, b).collect())) == [("Q1", 0.5), ("Q2", None)]


def test_tables_as_pandas_writes_them(spark, tmp_path):
    import pandas as pd

    texts = ['He said "hi", ok', "two\nlines", "tab\there", "plain", 'back\\slash "quoted"']
    rows = pd.DataFrame({"text": texts, "gold": "unknown", "compound": [0.5, -0.25, 0.0, 1.0, 0.125], "scores": "{'neg': 0.0}", "sentiment": "neutral"})
    rows.to_csv(tmp_path / "scored.csv", index=False)
    got = delimited.read_scored_csv(spark, str(tmp_path / "scored.csv"))
    assert dict(got.dtypes)["compound"] == "double"
    assert sorted((r["shorttext"], r["gold"], r["compound"]) for r in got.collect()) == sorted(zip(texts, rows["gold"], rows["compound"]))
    delimited.write_csv(got.coalesce(1), str(tmp_path / "out"))
    back = pd.read_csv(next((tmp_path / "out").glob("part-*.csv")))
    assert sorted(back["shorttext"]) == sorted(texts) and sorted(back["compound"]) == sorted(rows["compound"])
    numbered = spark.createDataFrame(list(enumerate(texts)), "n long, shorttext string")
    delimited.write_scoring_input(numbered.coalesce(1), str(tmp_path / "in"), "n")
    parts = [pd.read_csv(p, sep="\t", header=None) for p in (tmp_path / "in").glob("part-*.csv")]
    assert sorted(pd.concat(parts)[2]) == sorted(texts)
    assert sorted(r["text"] for r in delimited.read_labelled(spark, str(tmp_path / "in")).collect()) == sorted(texts)
