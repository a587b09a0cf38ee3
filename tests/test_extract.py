import pytest
from pyspark.sql import functions as F

from mentionmill.operators import extract

LISTING = """<html><body><ul>
<div class="teaser teaser-right twelve" data-teaserdate="1687000000">
 <a href="/inland/berlin/wahl-101.html" class="teaser-right__link x"><span class="teaser-right__date">
  17.06.2023 &#8211; 13:06 Uhr</span>
 <span class="teaser-right__headline"> Wahl &amp; Streit </span>
 <p class="teaser-right__shorttext">Ein Text. <b>mehr</b></p></a></div>
<div class='teaser-right' data-teaserdate='1687000001'><span class="teaser-right__headline">Ohne Link</span></div>
<li class="next"><a class="paginierung__liste--link" href="?page=2">weiter</a></li></ul></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


def test_teasers(spark):
    rows = extract.extract_teasers(pages(spark, ("/archiv", LISTING), ("/leer", "<p>nichts</p>"))).collect()
    assert [r.asDict() for r in rows] == [
        {
            "page_url": "/archiv", "position": 1, "tstamp": "1687000000", "title": "Wahl & Streit",
            "date": "17.06.2023 – 13:06 Uhr", "shorttext": "Ein Text.", "url": "/inland/berlin/wahl-101.html",
        },
        {
            "page_url": "/archiv", "position": 2, "tstamp": "1687000001", "title": "Ohne Link", "date": None,
            "shorttext": None, "url": None,
        },
    ]
    following = extract.next_page(pages(spark, ("/archiv", LISTING), ("/leer", "<p></p>"))).collect()
    assert [r["next_url"] for r in following] == ["?page=2", None]


@pytest.mark.parametrize(
    "html, all_nodes, paragraphs, filled",
    [
        ("<article><p> a <b>b</b>c</p><p>d", "a b c d", "a bc d", "a b c d"),
        ("<p>x</p><article><h1>t</h1><p>a</p><p> </p><p></p>z</article><p>y</p>", "a ", "a  ", "a  "),
        ("<article><p>a<br> <br>b</p></article>", "a  b", "a b", "a b"),
        ("<article class='x'><p class='y'>ä &amp; &uuml;<!-- <p>no</p> --></p></article>", "ä & ü", "ä & ü", "ä & ü"),
        ("<div>nichts</div>", "", "", ""),
        ("<article><p>a</p></article><article><p>b</p></article>", "a b", "a b", "a b"),
        ("<article><pre>x</pre><p>a</p></article>", "a", "a", "a"),
        ("<article><p>a</p><div><p>ad</p></div><p>b</article>c", "a b", "a b", "a b"),
        ("<article><p>a<div>no</div>no</p><p>b</p></article>", "a b", "a b", "a b"),
        ("<article><article><p>in</p></article><p>out</p></article><p>no</p>", "in out", "in out", "in out"),
        ("<article></section><p>a<i>b</i></b>c</p></article>", "a b c", "abc", "a b c"),
    ],
)
def test_article_text(spark, html, all_nodes, paragraphs, filled):
    h = F.col("html")
    row = pages(spark, ("/", html)).select(
        extract.article_text(h), extract.article_text(h, "paragraphs"), extract.article_text(h, "filled_nodes")
    ).first()
    assert tuple(row) == (all_nodes, paragraphs, filled)


def test_paragraphs_by_class(spark):
    html = (
        '<p class="paragraph article__item">a <b> b </b></p><article><p>no</p><div><p class="x article__item paragraph">c</p></div>'
        '<p class="paragraph">no</p></article>'
    )
    text = extract.article_text(F.col("html"), "filled_nodes", extract.CLASSED_PARAGRAPHS)
    assert pages(spark, ("/", html)).select(text).first()[0] == "a b c"


def test_article_text_variant_name(spark):
    with pytest.raises(ValueError):
        extract.article_text(F.col("html"), "other")


def test_section_carry(spark):
    html = (
        '<article><a href="/0">0</a></article><h2 class="x">A</h2><article><a href="/1">1</a></article>'
        '<h2><em>B</em></h2><article><h2>in</h2><div><a href="/2">2</a></div></article><a href="/no"></a>'
        '<h2>x <i>y</i></h2><article>no link</article><a href="/no">'
        '<h2>Ressorts</h2><article><a href="/3">3</a></article>'
    )
    got = extract.section_carry(pages(spark, ("/i", html))).orderBy("position").collect()
    assert [(r["position"], r["url"], r["sections"]) for r in got] == [
        (1, "/0", None), (2, "/1", ["A"]), (3, "/2", ["B"]), (4, None, None),
    ]


def test_full_view(spark):
    table = pages(
        spark,
        ("/a", '<a href="/a/all" data-ct-label="all">x</a>one'),
        ("/a/all", '<a class="article-toc__fullview" href="/a/whole">x</a>two'),
        ("/a/whole", "three"),
        ("/b", '<a data-ct-label="all" href="/missing">x</a>four'),
    )
    got = {r["page_url"]: (r["url"], r["html"][-4:]) for r in extract.resolve_full_view(table).collect()}
    assert got["/a"] == ("/a/whole", "hree") and got["/a/all"] == ("/a/whole", "hree")
    assert got["/a/whole"] == ("/a/whole", "hree") and got["/b"] == ("/b", "four")


def test_full_view_chains_and_circles(spark):
    def link(to):
        return f'<a data-ct-label="all" href="{to}">x</a>'

    rows = [(f"/{i}", link(f"/{i + 1}") + f"body {i}") for i in range(1, 12)] + [("/12", "end")]
    rows += [("/c1", link("/c2")), ("/c2", link("/c3")), ("/c3", link("/c2")), ("/self", link("/self")), ("/x", link("/gone"))]
    got = {r["page_url"]: (r["url"], r["html"]) for r in extract.resolve_full_view(pages(spark, *rows)).collect()}
    assert len(got) == len(rows) and all(got[f"/{i}"] == ("/12", "end") for i in range(1, 13))
    assert all(got[u][0] == u for u in ("/c1", "/c2", "/c3", "/self", "/x"))


def test_shapes(spark):
    listing = spark.createDataFrame(
        [("/a/b/c.html", "1", "t", "d", "s", "f"), (None, "1", "t", "d", "s", None)],
        "url string, tstamp string, title string, date string, shorttext string, fulltext string",
    )
    shaped = extract.shape_listing_articles(listing).collect()
    assert [(r["fulltext"], r["sections"]) for r in shaped] == [("f", ["a", "b"]), (None, [])]
    issue = spark.createDataFrame(
        [("/a", " L ", "S", "d", " x ", "f"), ("/b", "", " S ", "d", None, "f"), (None, None, None, "d", "x", None)],
        "url string, large_title string, small_title string, date string, shorttext string, fulltext string",
    ).withColumns({"tstamp": F.lit("1"), "sections": F.lit(None).cast("array<string>")})
    got = [(r["title"], r["date"], r["shorttext"], r["fulltext"]) for r in extract.shape_issue_articles(issue).collect()]
    assert got == [("L", "d", "x", "f"), ("S", "d", None, "f"), (None, "", "x", "")]
    fetched = spark.createDataFrame(
        [("/a", "2023-06-17T13:06:40+02:00", None, "text")], "url string, date string, title string, fulltext string"
    ).withColumn("sections", F.array(F.lit("A")))
    row = extract.shape_fetched_articles(fetched).first()
    assert (row["tstamp"], row["title"], row["shorttext"]) == ("1687000000", "", "text")
