"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: length, share of stop words,
share of link text, and where it stands. Blocks too short to tell stay open; in the second pass they take the label
of the nearest decided block, a good one first if two are equally near. Pages are read one by one inside their task.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names by what they do to the text around them, and frequent words of four languages.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video textarea xmp noembed noframes".split())
SKIPPED_TAGS = frozenset("head title nav footer aside menu dialog select optgroup option button datalist".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu menus "
    "nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr popup modal newsletter subscribe "
    "subscription share sharing social related recommended comment comments disqus respond replies login signup "
    "pagination pager toolbar skip paywall".split()
)
WEAK_NAMES = frozenset("header masthead banner notice notices search copyright legal disclaimer widget".split())
CONTENT_NAMES = frozenset("article content main post entry story text body".split())
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his if in into is it its "
    "more no not of on one or our out she so some than that the their them then there they this to up was we were what "
    "when which who will with would you "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par "
    "pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in "
    "ist mit nach nicht noch nur oder sich sie sind so und vom von vor war was wie wird zu zum zur über "
    "al con como del el ella ellos entre era eran es esta este fue ha hay lo los las más muy no nos o para pero por "
    "porque se sin sobre su sus también una uno y ya".split()
)

COMMENT_NAMES = frozenset("comment comments disqus respond replies".split())
SENTENCE_ENDS = frozenset(".!?…。！？।؟։")

SHORT_BLOCK = 70
LINK_SHARE = 0.4
STOP_SHARE = 0.1
#: Characters of scripts that need few of them to a word count as this many.
DENSE, DENSE_FROM = 3, "\u2e80"
#: A form stays if it holds this many characters beside links, or an article.
FORM_TEXT = 500

# A tag with quoted attributes; possessive, so that a page without an end for it is given up at once.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    """One block: its text, the characters of it that are links, and whether an article or main element holds it."""

    text: str
    links: int
    in_main: bool


@dataclass
class _State:
    """What the walk over a page has open."""

    stack: list[tuple[str, bool, bool]] = field(default_factory=list)  # tag, skipped, inside article or main
    open: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    link: int | None = None  # the depth at which the open link began
    forms: list[tuple[int, bool]] = field(default_factory=list)  # blocks before, inside article or main
    blocks: list[Block] = field(default_factory=list)

    @property
    def skipped(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    @property
    def in_main(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def take_text(self, raw: str) -> None:
        if raw and not self.skipped:
            self.parts.append(raw)
            if self.link is not None:
                self.link_parts.append(raw)

    def end_block(self) -> None:
        if self.parts:
            text = _spaced("".join(self.parts))
            if text:
                self.blocks.append(Block(text, len(_spaced(" ".join(self.link_parts))), self.in_main))
            self.parts, self.link_parts = [], []

    def end_element(self) -> None:
        """Close the innermost open element, and a link that began in it."""
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        if self.link is not None and self.link > len(self.stack):
            self.link = None
        if tag == "form":
            self.end_form()

    def end_form(self) -> None:
        """Drop the blocks of a form that has little text, unless an article lies in it."""
        first, in_main = self.forms.pop()
        inside = self.blocks[first:]
        around_article = not in_main and any(b.in_main for b in inside)
        if not around_article and sum(len(b.text) - b.links for b in inside) < FORM_TEXT:
            del self.blocks[first:]


def _spaced(raw: str) -> str:
    return " ".join(references.unescape(raw).split())


def _is_boilerplate(tag: str, attributes: str) -> bool:
    """Whether an element's name, class, id or role says that it is no article text."""
    if tag in SKIPPED_TAGS:
        return True
    if not attributes or tag in MAIN_TAGS or tag in ("html", "body"):
        return False
    names: list[str] = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in SKIPPED_ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id"):
            names += value.split()
    return _named_boilerplate(names)


def _named_boilerplate(names: list[str]) -> bool:
    """Whether class names and ids, taken together, speak against article text.

    A whole name such as "story" outweighs other names and parts of names, but not those of reader comments.
    """
    words = {w for name in names for w in _NAME.findall(name)}
    if words & COMMENT_NAMES:
        return True
    if words & BOILERPLATE_NAMES:
        return not any(name in CONTENT_NAMES for name in names)
    return bool(words & WEAK_NAMES) and not words & CONTENT_NAMES


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in page order, without those that its markup names as something else."""
    state, at, pattern = _State(), 0, _TAG
    while True:
        begin = page.find("<", at)
        state.take_text(page[at : begin if begin >= 0 else len(page)])
        if begin < 0:
            break
        following = page[begin + 1 : begin + 4]
        if following[:1] in ("!", "?"):
            end = "-->" if following == "!--" else ">"
            at = page.find(end, begin)
            if at < 0:
                break
            at += len(end)
            continue
        found = pattern.match(page, begin)
        if found is None and following.lstrip("/")[:1].isalpha():
            if pattern is _TAG:  # a quote that never ends: from here on quotes mean nothing
                pattern = _PLAIN_TAG
                found = pattern.match(page, begin)
            if found is None:  # a tag that never ends
                break
        if found is None:
            state.take_text("<")
            at = begin + 1
        else:
            at = _take_tag(state, page, found.end(), found[1] == "/", found[2].lower(), found[3])
    state.end_block()
    while state.forms:
        state.end_form()
    return state.blocks


def _take_tag(state: _State, page: str, at: int, closing: bool, tag: str, attributes: str) -> int:
    """Open or close an element; where the walk goes on."""
    if tag in RAW_TAGS:
        if closing or attributes.rstrip().endswith("/"):
            return at
        end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
        return end.end() if end else len(page)
    if tag == "a":
        linked = not closing and any(name.lower() == "href" for name, *_ in _ATTRIBUTE.findall(attributes))
        state.link = len(state.stack) if linked else None
    if tag in ("br", "wbr") or tag == "img":
        if tag == "br" and not state.skipped:
            state.parts.append(" ")
        return at
    if tag in BLOCK_TAGS:
        if tag in MAIN_TAGS or state.link_parts:  # a link inside a block ends with it; one around blocks goes on
            state.link = None
        state.end_block()
    if tag in VOID_TAGS:
        return at
    if closing:
        if state.open.get(tag):
            within = state.open[tag] - 1
            while state.open[tag] > within:
                state.end_element()
    elif tag in BLOCK_TAGS or _is_boilerplate(tag, attributes):
        if tag == "p" and state.stack and state.stack[-1][0] == "p":  # a paragraph ends the one before it
            state.end_element()
        in_main = state.in_main or tag in MAIN_TAGS
        skipped = state.skipped or _is_boilerplate(tag, attributes) or (tag == "header" and not in_main)
        if tag not in BLOCK_TAGS and skipped and not state.skipped:
            state.end_block()
        if tag == "form":
            state.forms.append((len(state.blocks), state.in_main))
        state.stack.append((tag, skipped, in_main))
        state.open[tag] = state.open.get(tag, 0) + 1
    elif state.open.get(tag):  # an inline element of a name that is open as boilerplate must close on its own
        state.stack.append((tag, state.skipped, state.in_main))
        state.open[tag] += 1
    return at


def _width(text: str) -> int:
    return len(text) if text.isascii() else len(text) + (DENSE - 1) * sum(c >= DENSE_FROM for c in text)


def _stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def knows_language(blocks: list[Block]) -> bool:
    """Whether any long block without many links holds stop words enough, so that they can tell blocks apart."""
    return any(
        b.links <= LINK_SHARE * len(b.text) and _width(b.text) >= SHORT_BLOCK and _stop_share(b.text) >= STOP_SHARE for b in blocks
    )


def first_pass(block: Block, has_main: bool, known: bool = True) -> bool | None:
    """Good, bad or, if too short to tell, open. Where the language is not ``known``, sentences stand for stop words."""
    if has_main and not block.in_main:
        return False
    if block.links > LINK_SHARE * len(block.text):
        return False
    if _width(block.text) < SHORT_BLOCK:
        return None
    if block.in_main:
        return True
    return _stop_share(block.text) >= STOP_SHARE if known else bool(SENTENCE_ENDS & set(block.text))


def second_pass(labels: list[bool | None], default: bool) -> list[bool]:
    """Open blocks take the label of the nearest decided one, a good one first; without any, ``default``."""
    n, before, after = len(labels), [], []
    last: tuple[int, bool] | None = None
    for i, label in enumerate(labels):
        last = (i, label) if label is not None else last
        before.append(last)
    last = None
    for i in range(n - 1, -1, -1):
        last = (i, labels[i]) if labels[i] is not None else last
        after.append(last)
    after.reverse()
    out = []
    for i in range(n):
        near = [(abs(x[0] - i), not x[1]) for x in (before[i], after[i]) if x is not None]
        out.append(not min(near)[1] if near else default)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line breaks; empty if there is none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    has_main = any(b.in_main for b in blocks)
    if has_main:  # lists of links inside an article go, but say nothing about the blocks beside them
        blocks = [b for b in blocks if b.in_main and b.links <= LINK_SHARE * len(b.text)]
    known = has_main or knows_language(blocks)
    labels = second_pass([first_pass(b, has_main, known) for b in blocks], has_main)
    return "\n".join(b.text for b, good in zip(blocks, labels, strict=True) if good)


def extracted_text(html: Column) -> Column:
    """Main text of each whole page; null and empty pages give an empty text.

    Each row is read alone, so repeated rows give equal texts, no rows give none and other columns do not matter. A
    page of any length is read in one pass over its tags.
    """

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text).astype("object")

    return extract(F.coalesce(html, F.lit("")))
