"""URL filters with redirect equivalence: block decisions pass along redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionmill.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (block or allow) for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """A field of the longest rule that fits; null if none does. ``rules`` is a list written by people, so it is part of the plan."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [(F.concat(F.lit("."), host).endswith("." + r.host) & path.startswith(r.path), getattr(r, field)) for r in ordered]
    return reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))


def address(url: Column) -> Column:
    """The form in which addresses are compared: scheme and host in lower case, a path of / if empty, no fragment."""
    at = F.instr(url, "://")
    scheme = F.translate(F.substring(url, F.lit(1), at - 1), UPPER, LOWER)
    rest = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(at > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolved(base: Column, link: Column) -> Column:
    """A link seen on the page ``base`` as a whole address; null if the page has none."""
    scheme = F.regexp_extract(base, "^[^:]*", 0)
    origin = F.regexp_extract(base, "^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, "^[^?#]*/", 0)
    return address(
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link != "", F.concat(folder, link))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): a page's address and where its canonical links and refresh redirects lead."""
    markup = F.coalesce(F.col(html), F.lit(""))
    tags = F.regexp_extract_all(markup, F.lit(r"(?i)(<(?:link|meta)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>)"), 1)
    attribute = r"""\s{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def value(tag: Column, name: str) -> Column:
        pattern = "(?i)" + attribute.format(name)
        return F.trim(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))

    def target(tag: Column) -> Column:
        canonical = tag.rlike("(?i)^<link") & value(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
        refresh = tag.rlike("(?i)^<meta") & value(tag, "http-equiv").rlike("(?i)^refresh$")
        goal = F.regexp_extract(value(tag, "content"), r"""(?i)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['"]?([^'"\s]+)""", 1)
        return F.when(canonical, value(tag, "href")).when(refresh, goal)

    links = F.filter(F.transform(tags, target), lambda x: x.isNotNull() & (x != ""))
    own = pages.filter(F.col(html).rlike("(?i)canonical|http-equiv")).select(
        address(F.col(url)).alias("u"), F.explode(links).alias("link")
    )
    whole = F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))
    return own.select("u", resolved(F.col("u"), whole).alias("v"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A page with a fitting rule takes the longest one's verdict. Any other page is blocked if it is an alias (linked
    by ``edges``, in either direction and over any number of steps) of an address that a rule blocks, unless one of
    its aliases is allowed by a rule: an explicit allow goes first. Everything else is allowed. A null url has an
    empty host and path, no rule and no aliases. Repeated pages are judged alike; an empty table gives no rows.
    Columns of ``pages`` named host, path, rule or verdict are replaced.
    """
    linked = components(edges)
    node = F.col("node")
    ruled = linked.df.withColumn("verdict", matching_rule(host_of(node), path_of(node), rules, "verdict"))
    decided = (
        ruled.groupBy("component")
        .agg(
            F.max((F.col("verdict") == "block").cast("int")).alias("blocked"),
            F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"),
        )
        .filter("blocked = 1 and coalesce(allowed, 0) = 0")
    )
    aliases = linked.df.join(decided, "component", "left_semi").select(F.col("node").alias("_address")).distinct()
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.drop(*({"host", "path", "rule", "verdict"} & {*pages.columns})).withColumns(
        {
            "host": host,
            "path": path,
            "rule": matching_rule(host, path, rules, "text"),
            "_verdict": matching_rule(host, path, rules, "verdict"),
            "_address": address(F.col(url)),
        }
    )
    met = judged.join(aliases.withColumn("_alias", F.lit(True)), "_address", "left")
    inherited = F.when(F.col("_alias"), F.lit("block")).otherwise(F.lit("allow"))
    return met.withColumn("verdict", F.coalesce("_verdict", inherited)).drop("_verdict", "_address", "_alias")
