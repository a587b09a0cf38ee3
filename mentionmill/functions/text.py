"""Whitespace, trimming, casing and HTML text."""

from __future__ import annotations

import json
import string
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a text is split or stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a pattern; spelled out, as classes of Unicode properties are slow to match.
WHITESPACE_PATTERN = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ASCII_PUNCTUATION = string.punctuation

def _reference_table() -> dict[str, dict[str, str]]:
    """All named references with their semicolon, by their first two letters."""
    table: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        if name.endswith(";"):
            table.setdefault(name[:2], {})[name] = text
    return table


REFERENCES = json.dumps(_reference_table())
# Old names that stand without a semicolon too, longest first, so that the longest one that fits is found.
_OLD_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
OLD_REFERENCES = json.dumps({name: html5[name] for name in _OLD_NAMES})


def strip(value: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(value, F.lit(WHITESPACE))


def words(value: Column) -> Column:
    """Split on runs of white space; an empty first or last item stays for the caller to filter."""
    return F.split(value, f"{WHITESPACE_PATTERN}+")


def has_edge(value: Column, chars: str) -> Column:
    """The first or the last character is one of ``chars``: a cheap test before a pattern is tried."""
    return F.contains(F.lit(chars), F.substring(value, 1, 1)) | F.contains(F.lit(chars), F.substring(value, -1, 1))


def capitalize(value: Column) -> Column:
    """First character in title case, the rest in lower case."""
    return F.concat(F.initcap(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))


def is_upper(value: Column) -> Column:
    """At least one cased character, and none of them in lower case."""
    return (F.upper(value) == value) & (F.lower(value) != value)


def _decode_reference(part: Column, old_names: bool) -> Column:
    """What follows an ampersand, with the reference it begins with resolved; the ampersand stays otherwise."""
    number = F.regexp_extract(part, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 1)
    whole_number = F.regexp_extract(part, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
    digits = F.regexp_extract(number, "^[xX]?0*(.*)$", 1)
    hexadecimal = number.rlike("^[xX]")
    code = F.when(F.length(digits) > 7, F.lit(0)).when(hexadecimal, F.conv(digits, 16, 10).cast("int")).otherwise(
        digits.try_cast("int")
    )
    usable = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    name = F.regexp_extract(part, "^[a-zA-Z][a-zA-Z0-9]*;", 0)
    table = F.from_json(F.lit(REFERENCES), "map<string, map<string, string>>")
    named = F.try_element_at(F.try_element_at(table, F.substring(name, 1, 2)), name)
    out = F.when(number != "", F.concat(char, F.substr(part, F.length(whole_number) + 1))).when(
        named.isNotNull(), F.concat(named, F.substr(part, F.length(name) + 1))
    )
    if old_names:
        old = F.regexp_extract(part, f"^(?:{'|'.join(_OLD_NAMES)})", 0)
        text = F.try_element_at(F.from_json(F.lit(OLD_REFERENCES), "map<string, string>"), old)
        out = out.when(old != "", F.concat(text, F.substr(part, F.length(old) + 1)))
    return out.otherwise(F.concat(F.lit("&"), part))


def unescape_html(value: Column, old_names: bool = True) -> Column:
    """Resolve numeric and named character references in one pass.

    ``old_names`` resolves the old names without a semicolon too, as in running text; in attributes, where
    an ampersand may part the fields of a link, they are left alone. A number that names no character gives
    the replacement character.
    """
    parts = F.split(value, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: _decode_reference(p, old_names))
    return F.when(value.contains("&"), F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(value)


def blank_to_null(value: Column) -> Column:
    """Null in place of an empty string."""
    return F.nullif(value, F.lit(""))
