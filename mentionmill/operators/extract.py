"""Extraction of links, sections and article text from tables of fetched pages ``(url, html)``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import scan
from ..functions.sections import sections_from_url
from ..functions.text import blank_to_null, strip, unescape_html
from ..functions.time import iso_to_epoch_text
from ..tables import Table

# Fixed value: the header of the overview block, whose links are no articles.
OVERVIEW_SECTION = "Ressorts"


def class_tag(name: str, tag: str = r"[a-zA-Z][a-zA-Z0-9]*") -> str:
    """Pattern of an opening tag whose class list holds ``name``."""
    return rf"""<{tag}\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>"""


def first_text(html: Column, opening: str) -> Column:
    """Trimmed text right after the first tag that matches ``opening``; null when there is none."""
    return blank_to_null(strip(unescape_html(F.regexp_extract(html, f"{opening}([^<]*)", 1))))


def attribute(html: Column, opening: str, name: str) -> Column:
    """Attribute ``name`` of the first tag that matches ``opening``; null when there is none."""
    tag = F.regexp_extract(html, opening, 0)
    return blank_to_null(unescape_html(F.regexp_extract(tag, rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1), old_names=False))


@dataclass(frozen=True)
class TeaserLayout:
    """Where a listing page keeps its teasers. Every pattern matches one opening tag."""

    block: str
    link: str
    title: str
    date: str | None = None
    shorttext: str | None = None
    tstamp_attribute: str | None = None
    next_block: str | None = None
    next_link: str | None = None


# Class and attribute names of the archive listing.
ARCHIVE_LAYOUT = TeaserLayout(
    block=class_tag("teaser-right"),
    link=class_tag("teaser-right__link", "a"),
    title=class_tag("teaser-right__headline"),
    date=class_tag("teaser-right__date"),
    shorttext=class_tag("teaser-right__shorttext"),
    tstamp_attribute="data-teaserdate",
    next_block=class_tag("next", "li"),
    next_link=class_tag("paginierung__liste--link", "a"),
)

# A plain navigation list.
NAV_LAYOUT = TeaserLayout(block=r"<li\b[^>]*>", link=r"<a\b[^>]*>", title=r"<a\b[^>]*>")


def extract_teasers(pages: DataFrame, layout: TeaserLayout = ARCHIVE_LAYOUT) -> DataFrame:
    """One row per teaser of a listing page, in page order."""
    # the part before the first teaser is item 0; the blank makes sure that there is one
    blocks = pages.select(
        F.col("url").alias("page_url"), F.posexplode_outer(F.split(F.concat(F.lit(" "), "html"), f"(?={layout.block})"))
    ).filter("pos > 0")
    block = F.col("col")

    def text(opening: str | None) -> Column:
        return first_text(block, opening) if opening else F.lit(None).cast("string")

    tstamp = (
        attribute(block, layout.block, layout.tstamp_attribute)
        if layout.tstamp_attribute
        else F.lit(None).cast("string")
    )
    return blocks.select(
        "page_url",
        F.col("pos").cast("bigint").alias("position"),
        tstamp.alias("tstamp"),
        text(layout.title).alias("title"),
        text(layout.date).alias("date"),
        text(layout.shorttext).alias("shorttext"),
        attribute(block, layout.link, "href").alias("url"),
    )


def next_page(pages: DataFrame, layout: TeaserLayout = ARCHIVE_LAYOUT) -> DataFrame:
    """Link from a listing page to the next one; null on the last."""
    block = F.regexp_extract("html", f"(?s){layout.next_block}.*?</li>", 0)
    return pages.select("url", attribute(block, layout.next_link, "href").alias("next_url"))


def with_sections(articles: DataFrame) -> DataFrame:
    """Set ``sections`` to the folders of the article url."""
    return articles.withColumn("sections", sections_from_url(F.col("url")))


# Elements without content, and those that end an open paragraph.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCK_ELEMENTS = (
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "table", "ul",
)


@dataclass(frozen=True)
class ParagraphLayout:
    """Which elements hold the text: their tag, the element they are direct children of, and their classes."""

    tag: str = "p"
    parent: str | None = "article"
    classes: tuple[str, ...] = ()


# Paragraphs by class, anywhere in the page.
CLASSED_PARAGRAPHS = ParagraphLayout(parent=None, classes=("paragraph", "article__item"))


def paragraphs(html: Column, layout: ParagraphLayout = ParagraphLayout()) -> Column:
    """The text nodes of each paragraph of the layout, in page order.

    The page is split at its tags and walked once; ``path`` names the elements that are open. A closing
    tag without its opening one is passed over, and block elements end an open paragraph. The walk's time is in
    proportion to the page.
    """
    bare = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)", "")
    pieces = F.filter(F.split(F.concat(F.lit(" "), bare), "(?=</?[a-zA-Z])"), lambda _, i: i > 0)

    def parsed(piece: Column) -> Column:
        tag = F.regexp_extract(piece, "^<[^>]*>?", 0)
        wanted = F.lit(True)
        for name in layout.classes:
            wanted &= tag.rlike(class_tag(name, layout.tag))
        return F.struct(
            F.lower(F.regexp_extract(piece, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("name"),
            piece.startswith("</").alias("closes"),
            wanted.alias("wanted"),
            F.substr(piece, F.length(tag) + 1).alias("text"),
        )

    def cut(path: Column, name: Column) -> Column:
        """The path up to the last open element of this name."""
        behind = F.call_function("substring_index", path, F.concat(F.lit("/"), name, F.lit("/")), F.lit(-1))
        kept = F.length(path) - F.length(behind)
        return F.substr(path, F.lit(1), kept - F.length(name) - 1)

    def walk(state: Column, e: Column) -> Column:
        path, name = state["path"], e["name"]
        is_open = F.contains(path, F.concat(F.lit("/"), name, F.lit("/")))
        ends_paragraph = name.isin(*BLOCK_ELEMENTS) & F.contains(path, F.lit("/p/"))
        outer = F.when(ends_paragraph, cut(path, F.lit("p"))).otherwise(path)
        starts = ~e["closes"] & (name == layout.tag) & e["wanted"]
        if layout.parent:
            starts &= outer.endswith(f"/{layout.parent}/")
        after = (
            F.when(e["closes"], F.when(is_open, cut(path, name)).otherwise(path))
            .when(name.isin(*VOID_ELEMENTS), outer)
            .otherwise(F.concat(outer, name, F.lit("/")))
        )
        inside = F.when(starts, after).when(after.startswith(state["inside"]), state["inside"]).otherwise(F.lit("\x00"))
        node = F.struct(starts.alias("first"), e["text"].alias("text"))
        return F.struct(
            after.alias("path"),
            inside.alias("inside"),
            F.when(inside != "\x00", node).alias("found"),
        )

    node_type = "struct<first:boolean,text:string>"
    start = F.struct(
        F.lit("/").alias("path"),
        F.lit("\x00").alias("inside"),
        F.lit(None).cast(node_type).alias("found"),
    )
    found = scan(F.transform(pieces, parsed), start, walk, node_type)
    marked = F.transform(found, lambda n: F.concat(F.when(n["first"], F.lit("\x01")).otherwise(F.lit("\x02")), n["text"]))
    each = F.filter(F.split(F.array_join(marked, ""), "\x01"), lambda _, i: i > 0)
    # two tags in a row have no text node between them
    return F.transform(each, lambda p: F.filter(F.split(p, "\x02"), lambda n: n != ""))


def article_text(html: Column, variant: str = "all_nodes", layout: ParagraphLayout = ParagraphLayout()) -> Column:
    """Text of the page's paragraphs, by default those that are direct children of an ``<article>``.

    ``all_nodes``: every text node stripped, empty ones kept, joined by one space.
    ``paragraphs``: the text of each paragraph stripped, joined by one space.
    ``filled_nodes``: in each paragraph the non-empty stripped text nodes are joined by one space,
    then the paragraphs are.
    """
    return joined_paragraphs(paragraphs(html, layout), variant)


def joined_paragraphs(found: Column, variant: str = "all_nodes") -> Column:
    """The text of ``paragraphs``, which several variants can share."""

    def clean(node: Column) -> Column:
        return strip(unescape_html(node))

    if variant == "all_nodes":
        return F.array_join(F.transform(F.flatten(found), clean), " ")
    if variant == "paragraphs":
        return F.array_join(F.transform(found, lambda p: clean(F.array_join(p, ""))), " ")
    if variant == "filled_nodes":
        filled = F.transform(found, lambda p: F.array_join(F.filter(F.transform(p, clean), lambda n: n != ""), " "))
        return F.array_join(filled, " ")
    raise ValueError(f"unknown variant {variant!r}")


@dataclass(frozen=True)
class SectionLayout:
    """Tags of section headers and of the items below them."""

    header: str = "h2"
    item: str = "article"
    dropped: tuple[str, ...] = field(default=(OVERVIEW_SECTION,))


def section_carry(pages: DataFrame, layout: SectionLayout = SectionLayout()) -> DataFrame:
    """Items of a page in order, each filed under the last header before it.

    A header without plain text resets the section. The page is cut twice: at its headers, where each part gives its
    section as often as it has items, and at its items, where each part gives its link. Both lists are in page order
    and are put side by side. All of it stays inside the page's row, so nothing is shuffled and copies of a page do
    not mix; the time is in proportion to the page.
    """
    header, item = f"<{layout.header}[\\s>]", f"<{layout.item}[\\s>]"
    # plain text: one text node, be it inside nested tags
    plain = f"^<{layout.header}(?:\\s[^>]*)?>(?:<[a-zA-Z][^>]*>)*([^<]*)(?:</[a-zA-Z][^>]*>)*?</{layout.header}>"
    # the blank makes sure that the part before the first element is item 0
    page = F.concat(F.lit(" "), "html")

    def sections(part: Column) -> Column:
        pieces = F.split(part, f"(?={item})")
        text = blank_to_null(unescape_html(F.regexp_extract(F.get(pieces, F.lit(0)), plain, 1)))
        return F.array_repeat(text, F.size(pieces) - 1)

    def link(part: Column) -> Column:
        # an item may contain headers of its own, so its link can lie behind one
        pieces = F.split(F.substring_index(part, f"</{layout.item}>", 1), f"(?={header})")
        links = F.transform(pieces, lambda p: attribute(p, r"<a\b[^>]*>", "href"))
        return F.get(F.filter(links, lambda x: x.isNotNull()), F.lit(0))

    parts = F.filter(F.split(page, f"(?={item})"), lambda _, i: i > 0)
    listed = F.arrays_zip(
        F.flatten(F.transform(F.split(page, f"(?={header})"), sections)).alias("section"), F.transform(parts, link).alias("url")
    )
    items = pages.select(F.col("url").alias("page_url"), F.posexplode_outer(listed).alias("position", "_item"))
    kept = items.filter(F.col("position").isNotNull())
    for name in layout.dropped:
        kept = kept.filter(~F.col("_item.section").eqNullSafe(F.lit(name)))
    section = F.col("_item.section")
    return kept.select(
        "page_url",
        (F.col("position") + 1).cast("bigint").alias("position"),
        F.col("_item.url").alias("url"),
        F.when(F.coalesce(section, F.lit("")) != "", F.array(section)).alias("sections"),
    )


# The links to the one-page view of an article.
FULL_VIEW_LINKS = (r"<a\b[^>]*\bdata-ct-label\s*=\s*[\"']all[\"'][^>]*>", class_tag("article-toc__fullview", "a"))


def full_view_url(html: Column, links: tuple[str, ...] = FULL_VIEW_LINKS) -> Column:
    """The page's link to its one-page view, or null."""
    return F.coalesce(*[attribute(html, link, "href") for link in links])


def _chain_ends(steps: DataFrame) -> DataFrame:
    """(url, end) for every url of ``steps`` (url, next) whose chain ends; next is null at an end.

    The stride doubles with each round, so a chain of n steps takes log2(n) rounds. What has not ended once the
    stride exceeds the number of urls runs in a circle.
    """
    ended = F.col("next").isNull()
    now = Table(steps.select("url", F.coalesce("next", "url").alias("at"), ended.alias("ended")))
    for _ in range(now.df.count().bit_length() + 1):
        if now.df.filter(~F.col("ended")).isEmpty():
            break
        far = now.df.select(F.col("url").alias("at"), F.col("at").alias("far"), F.col("ended").alias("far_ended"))
        after = Table(
            now.df.join(far, "at").select("url", F.col("far").alias("at"), F.col("far_ended").alias("ended"))
        )
        now.drop()
        now = after
    return now.df.filter("ended").select("url", F.col("at").alias("end"))


def resolve_full_view(pages: DataFrame, links: tuple[str, ...] = FULL_VIEW_LINKS) -> DataFrame:
    """Replace url and body of a page by those of its one-page view, and of the view of that, to the end.

    A view that was not fetched ends the chain, so the last page that was stands for it. A chain that runs
    in a circle has no end, and its pages stay as they are. Links alone are followed; bodies are joined
    once, at the end. Pages without a link pass straight through.
    """
    marked = pages.select("url", "html", full_view_url(F.col("html"), links).alias("full_url"))
    linking = marked.filter(F.col("full_url").isNotNull())
    named = linking.select(F.col("full_url").alias("url")).distinct()
    # of several copies of a view one is taken, by its fingerprint
    views = Table(
        marked.join(named, "url", "left_semi")
        .groupBy("url").agg(F.min_by(F.struct("html", "full_url"), F.xxhash64("html")).alias("v"))
        .select("url", "v.html", "v.full_url")
    ).df
    known = views.select(F.col("url").alias("next"))
    steps = views.select("url", F.col("full_url").alias("named")).join(known, F.col("named") == F.col("next"), "left")
    ends = _chain_ends(steps.select("url", "next")).select(F.col("url").alias("full_url"), "end")
    bodies = views.select(F.col("url").alias("end"), F.col("html").alias("full_html"))
    resolved = (
        linking.select(F.col("url").alias("page_url"), "html", "full_url")
        .join(ends, "full_url", "left")
        .join(bodies, "end", "left")
        .select("page_url", F.coalesce("end", "page_url").alias("url"), F.coalesce("full_html", "html").alias("html"))
    )
    straight = marked.filter(F.col("full_url").isNull()).select(F.col("url").alias("page_url"), "url", "html")
    return straight.unionByName(resolved)


def shape_listing_articles(teasers: DataFrame) -> DataFrame:
    """Article records from listing teasers joined with their ``fulltext``.

    A teaser without a link keeps a null body and no sections.
    """
    linked = F.col("url").isNotNull()
    return teasers.select(
        "url",
        "tstamp",
        "title",
        "date",
        "shorttext",
        F.when(linked, F.col("fulltext")).alias("fulltext"),
        sections_from_url(F.col("url")).alias("sections"),
    )


def shape_issue_articles(items: DataFrame) -> DataFrame:
    """Article records from issue pages: the large title wins over the small one.

    An item without a link gets an empty body and date.
    """
    linked = F.col("url").isNotNull()
    return items.select(
        "url",
        "tstamp",
        F.coalesce(
            strip(blank_to_null(F.col("large_title"))), strip(blank_to_null(F.col("small_title")))
        ).alias("title"),
        F.when(linked, F.col("date")).otherwise("").alias("date"),
        strip(F.col("shorttext")).alias("shorttext"),
        F.when(linked, F.col("fulltext")).otherwise("").alias("fulltext"),
        "sections",
    )


def shape_fetched_articles(pages: DataFrame) -> DataFrame:
    """Article records from fetched pages: epoch text from the ISO date, short text = full text."""
    return pages.select(
        "url",
        iso_to_epoch_text(F.col("date")).alias("tstamp"),
        F.coalesce("title", F.lit("")).alias("title"),
        "date",
        F.col("fulltext").alias("shorttext"),
        "fulltext",
        "sections",
    )
