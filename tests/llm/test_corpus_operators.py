"""Sharding, URL filters, tokens, packing, page text and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mentionmill.llm.html_text import extracted_text, main_text, second_pass
from mentionmill.llm.packing import fill, pack, plan
from mentionmill.llm.queries import URL_RULES, tokenizer_path
from mentionmill.llm.sharding import histogram_shards
from mentionmill.llm.tokens import counter, encoder, token_count
from mentionmill.llm.url_filters import judge_urls, page_edges
from tests.llm import brute

SF = "/root/testdata/sf0.001"
AWKWARD = "abcXYZ'  \n\t\r\x0b\x0c\x1c\x1f\x85  ​﻿019½Ⅷéßñ中文日本😀👨‍👩‍👧ا,.!?'s're<|endoftext|>"


def shards_of(df, shards=24):
    return histogram_shards(df, F.xxhash64("text"), F.col("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))) + 8, shards)


def test_shards_are_even_gapless_and_keep_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = shards_of(docs, 5).withColumn("size", F.octet_length("text") + 8).collect()
    assert len(rows) == docs.count()
    sums, slots = {}, {}
    for r in rows:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sums) == [0, 1, 2, 3, 4]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sums.values()) / 5, max(r["size"] for r in rows)
    assert max(abs(s - mean) for s in sums.values()) <= max(largest, 0.06 * mean)
    homes = {}
    for r in rows:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_a_huge_group_is_cut_and_awkward_rows_are_kept(spark):
    rows = [(i, "same text") for i in range(900)] + [(i, f"text {i}") for i in range(900, 1200)]
    rows += [(None, None), (None, None), (3, None), (4, "")] + [(5, "same text")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("old"))
    out = shards_of(df).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(a), str(b)) for a, b in rows)
    sums = {}
    for r in out:
        sums[r["shard"]] = sums.get(r["shard"], 0) + len(r["text"] or "") + 8
    mean = sum(sums.values()) / 24
    assert len(sums) == 24 and max(abs(s - mean) for s in sums.values()) <= 0.06 * mean + 60
    assert shards_of(df.limit(0)).count() == 0


def test_url_rules_and_aliases(spark):
    def page(link):
        return f'<html><head><link href="{link}" rel="canonical"></head></html>'

    rows = [
        (1, "http://a.example.org/x", page("http://b.example.org/y")),
        (2, "http://b.example.org/y", '<META http-equiv=refresh content="0; url=\'http://bad.net/z?a=1#top\'">'),
        (3, "http://www.Example.NET/en/1?q#f", "<p>"),
        (4, "http://c.org/fr/1", page("//b.example.org/y")),
        (5, "http://shop.example.com/de/", None),
        (6, "http://shop.example.com/fr/", "<link rel='canonical' href='/de/1'>"),
        (7, None, page("http://bad.net/")),
        (8, "no scheme.net/", ""),
        (9, "http://free.example.com", page("http://free.example.com/home")),
        (10, "http://net", None),
        (11, "http://x.net/", None),
        (12, "http://q.example.com/1", page("http://bad.net/z2")),
        (13, "http://r.example.com/1", page("HTTP://Q.example.com/1#part")),
        (13, "http://r.example.com/1", page("HTTP://Q.example.com/1#part")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = judge_urls(pages.select("page_id", "url"), URL_RULES, page_edges(pages)).collect()
    assert len(found) == len(rows)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    assert got == {
        1: ("a.example.org", "/x", None, "allow"),  # a blocked alias, but one that is allowed as well
        2: ("b.example.org", "/y", None, "allow"),
        3: ("www.example.net", "/en/1", "example.net/en/", "allow"),
        4: ("c.org", "/fr/1", "org/fr/", "allow"),
        5: ("shop.example.com", "/de/", "example.com/de/", "block"),
        6: ("shop.example.com", "/fr/", None, "block"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("free.example.com", "", None, "allow"),
        10: ("net", "", None, "allow"),
        11: ("x.net", "/", "net/", "block"),
        12: ("q.example.com", "/1", None, "block"),
        13: ("r.example.com", "/1", None, "block"),
    }
    assert judge_urls(pages.select("page_id", "url").limit(0), URL_RULES, page_edges(pages.limit(0))).count() == 0


def test_url_query_has_no_python_in_its_plan(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    text = judge_urls(pages, URL_RULES, page_edges(pages))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def awkward_texts(n):
    rng = random.Random(4)
    out = ["", " ", "\n\n", "'s", "a" * 5000, " " * 3000, "<|endoftext|>", "x<|endoftext|> y"]
    while len(out) < n:
        out.append("".join(rng.choice(AWKWARD) for _ in range(rng.randrange(1, 40))))
    return out


def test_token_counts_and_ids_equal_the_library():
    path = tokenizer_path()
    library, count, ids = Tokenizer.from_file(path), counter(path), encoder(path)
    assert len(count.counts.proven) > 45_000
    assert ids.encoding is not None
    for text in awkward_texts(3000):
        expected = library.encode(text, add_special_tokens=False).ids
        assert count.count(text) == len(expected), repr(text)
        assert ids.ids(text).tolist() == expected, repr(text)


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000])
def test_ids_of_very_long_runs_equal_the_library(run):
    path = tokenizer_path()
    text = f"before{run}after<|endoftext|>"
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert encoder(path).ids(text).tolist() == expected
    assert counter(path).count(text) == len(expected)


def test_token_counts_in_spark(spark):
    texts = [*awkward_texts(200), None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    library = Tokenizer.from_file(tokenizer_path())
    for r in df.select("text", token_count(F.col("text"), tokenizer_path()).alias("n")).collect():
        assert r["n"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(30))
def test_fill_comes_closest_to_capacity(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 8))}
    room = rng.randrange(0, 80)
    chosen = fill(dict(counts), room)
    assert all(counts[k] >= n for k, n in chosen.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_places_every_rest_once():
    rng = random.Random(9)
    counts = {rng.randrange(1, 1025): rng.randrange(1, 50) for _ in range(200)}
    used, filled = dict.fromkeys(counts, 0), {}
    for p in plan(counts, 1024):
        assert p.first == used[p.length]
        used[p.length] += p.need * p.copies
        for c in range(p.copies):
            filled[p.sequence + c] = filled.get(p.sequence + c, 0) + p.need * p.length
    assert used == counts and max(filled.values()) <= 1024 and sorted(filled) == list(range(len(filled)))
    assert sum(1024 - f for f in filled.values()) < 0.02 * 1024 * len(filled)


def check_packed(rows, docs, window=1024):
    library = Tokenizer.from_file(tokenizer_path())
    left = sorted((str(d), len(i) + 1, zlib.crc32(np.array(i + [0], dtype="<u4").tobytes())) for d, i in
                  ((d, library.encode(t or "", add_special_tokens=False).ids) for d, t in docs))
    assert sum(r["length"] for r in rows) == sum(n for _, n, _ in left)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    whole = sorted((str(r["doc_id"]), r["doc_tokens"], r["ids_crc32"]) for r in rows if r["length"] == r["doc_tokens"])
    assert whole == [x for x in left if x[1] <= window]


def test_packing(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["tea", "of", "zq"]) for _ in range(rng.randrange(1, 1500)))) for i in range(60)]
    docs += [(i, "same words") for i in range(100, 400)] + [(None, None), (None, ""), (7, "seven")] + [(8, "eight")] * 4
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = pack(df, "doc_id", "text", tokenizer_path(), with_ids=True).collect()
    check_packed(rows, docs)
    library, texts = Tokenizer.from_file(tokenizer_path()), dict(docs)
    for r in (r for r in rows if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] not in (7, 8)):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert pack(df.limit(0), "doc_id", "text", tokenizer_path()).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x:1}</style><script>var a="</p><article>";</script></head>
<body><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<article><h1>Title &amp; more</h1><p>One&nbsp;and
 <b>two<br>three</b><p>Short.<form><p>Name</p></form><div class="ad">Buy the thing of the year now</div>
<ul><li><a href="/a">link</a></li></ul><!-- <p>gone</p> --><p>A long last paragraph of the article, with words enough to stand on its own here.</p>
<section id="comments"><p>I like the article a lot, and the rest of the page as well, thank you so much.</p></section></article>
<aside>More</aside><footer>&copy; us</footer></body></html>"""


def test_main_text_of_an_article():
    expected = "Title & more\nOne and two three\nShort.\nA long last paragraph of the article, with words enough to stand on its own here."
    assert main_text(PAGE) == expected


def test_main_text_without_an_article_element():
    prose = "the cat of the house is in the garden and it is not there any more"
    links = "".join(f"<li><a href=/{i}>A section with a rather long name number {i} to be read</a>" for i in range(9))
    page = f"<div>Top</div><ul>{links}</ul><div><p>{prose} {prose}</p><p>So it was.</p><p>{prose}</p></div>"
    assert main_text(page) == f"{prose} {prose}\nSo it was.\n{prose}"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p <p " * 9999, '<p "' * 9999, "<!--", "<script>" * 999, "<div>" * 9999 + "</b>" * 9999])
def test_main_text_of_broken_pages(page):
    assert main_text(page).strip("< ") == ""


def test_main_text_in_spark(spark):
    rows = spark.createDataFrame([(PAGE,), (None,)], "html string").select(extracted_text(F.col("html")).alias("text")).collect()
    assert [r["text"] for r in rows] == [main_text(PAGE), ""]


def test_main_text_of_given_pages(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name == "packing":
            check_packed(after, [(r["doc_id"], r["text"]) for r in before])
            break
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in after}
        if name == "quality_rules":
            left = brute.without_frequent_lines([(r["text"], r["source"]) for r in before])
            expected = {
                r["doc_id"]: text
                for r, (text, enough) in zip(before, left, strict=True)
                if enough and not brute.quality_counts(r["text"])[5]
            }
        elif name == "near_duplicates":
            roots = {root for _, root in brute.near_duplicate_classes([(r["doc_id"], r["text"]) for r in before])}
            expected = {before[i]["doc_id"]: before[i]["text"] for i in roots}
            assert len(got) == len(expected)
            expected = {d: t for d, t in {r["doc_id"]: r["text"] for r in before}.items() if d in got}
        elif name == "substrings":
            words = [tuple(brute.SPACED.findall(r["text"])) for r in before]
            cut = brute.without_repeats(words, 35)
            expected = {r["doc_id"]: " ".join(kept) if n else r["text"] for r, (total, n, _, kept) in zip(before, cut, strict=True) if n < total}
        else:
            held = brute.contamination([r["text"] for r in before], items)
            expected = {r["doc_id"]: r["text"] for r, (_, n, _) in zip(before, held, strict=True) if not n}
        assert got == expected, name
        assert all(r["n_chars"] == len(r["text"]) for r in after if name in ("quality_rules", "substrings"))


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, extra columns with clashing names."""
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(50))
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def text(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    rows = [(i, text(80), "en", f"s{i % 3}", 1) for i in range(20)]
    rows += [(i, f"{text(60)} {passage} {text(60)}", None, None, None) for i in range(20, 26)]
    rows += [(30, f"{text(60)} {benchmark[0]} {text(60)}", "en", "s", 5), (31, text(30_000), "en", "s", 5)]
    rows += [(None, text(70), None, None, None), (None, None, None, None, None), (40, "", "en", "s", 0), (41, None, "en", "s", 0)]
    rows += [rows[0], rows[0], (50, rows[1][1], "de", "t", 2), (2, text(90), "en", "s", 3), (60, f"{passage} {passage}", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, seed string, doc string, fp string, places string"
    docs = spark.createDataFrame([(*r, "k", None, "d", "f", "p") for r in rows], schema).repartition(4)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
        kept[name] = [tuple(r) for r in after.collect()]
        docs = after
    ids = {name: sorted((str(r[0]) for r in rows_), key=str) for name, rows_ in kept.items()}
    assert len(kept["quality_rules"]) == len(rows) - 4  # null and empty texts, and the one that repeats itself
    assert ids["near_duplicates"].count("0") == 1 and "50" not in ids["near_duplicates"] and ids["near_duplicates"].count("2") == 2
    cut = [r for r in kept["substrings"] if r[0] in range(20, 26)]
    assert len(cut) == 6 and all(passage not in r[1] and len(r[1].split()) == 120 and r[4] == len(r[1]) for r in cut)
    assert "30" not in ids["decontamination"] and "31" in ids["decontamination"] and "None" in ids["decontamination"]
    assert len({r[0] for r in kept["packing"]}) == len({r[0] for r in kept["decontamination"]})


PROSE = "<p>The fox was in the garden and it ate all of the apples that were there, or so they say about it.</p>"


@pytest.mark.parametrize(
    "page, paragraphs",
    [
        (f'<a name="top">{PROSE * 2}', 2),  # an anchor is no link
        (f"<div><p><a href=/x>Home<p>{PROSE}</div>{PROSE}", 2),  # a link that is not closed ends with its block
        (f'<form id="page"><input type="hidden" name="state"><input name="q">{PROSE * 12}</form>', 12),
        (f"<form><article>{PROSE}</article><input name=q></form>", 1),
        (f"{PROSE}<form><p>Sign up for the letter and get all of the news of the day and more of it.</p><input></form>", 1),
        (f'<div class="story social">{PROSE}</div>', 1),
        (f'<div class="layout sidebar-right content">{PROSE}</div>', 1),
        (f'<div class="post-share-enabled post">{PROSE}</div>', 1),
        (f'<div id="content" class="has-sidebar">{PROSE}</div><div class="sidebar">{PROSE}</div>', 1),
        (f'{PROSE}<div class="comment body">{PROSE}</div>', 1),
        (f'<a href="/x"><article>{PROSE}</article></a>', 1),
    ],
)
def test_main_text_on_ordinary_markup(page, paragraphs):
    assert main_text(page).split("\n") == [PROSE[3:-4]] * paragraphs


def test_main_text_without_stop_words():
    """Sentences decide where no block is of a known language; menus do not come with them."""
    chinese = "狐狸在花园里，它吃掉了所有的苹果，大家都这么说。" * 2
    menu = "<ul>" + "".join(f"<li><a href=/{i}>首页{i}</a></li>" for i in range(9)) + "</ul>"
    assert main_text(f"<body>{menu}<p>{chinese}</p></body>") == chinese


def test_second_pass_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        labels = [rng.choice([True, False, None, None, None]) for _ in range(rng.randrange(12))]
        default = rng.random() < 0.5
        expected = []
        for i in range(len(labels)):
            near = [abs(i - j) for j, x in enumerate(labels) if x is not None]
            nearest = {x for j, x in enumerate(labels) if x is not None and abs(i - j) == min(near)}
            expected.append((True in nearest) if near else default)
        assert second_pass(labels, default) == expected
