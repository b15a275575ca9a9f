"""Links and titles out of raw HTML, with JVM regular expressions only.

One scan tokenises the page, so that markup inside comments, scripts, raw-text
elements or quoted attribute values is never taken for a tag. Quantifiers are
possessive: the matcher neither backtracks nor recurses on long inputs.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlkit.functions.bind import let

# HTML tokens.
_REST = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>"""
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_COMMENT = r"!--(?:-?>|.*?(?:--!?>|\z))"
_RAW_TEXT = (
    r"(script|style|textarea|iframe|noembed|noframes|xmp{extra})(?=[\s/>])"
    + _REST
    + r".*?(?:</\1(?=[\s/>])|\z)"
)
#: A tag that never closes takes the rest of the page, so the rest is read once.
_OTHER_TAG = r"[a-z/!?]" + _REST.removesuffix(">") + r"(?:>|\z)"
_ATTRIBUTE_BEFORE_HREF = (
    r"(?:[\s/]*+(?!href[\s=/>])[^\s=/>]++(?:\s*+=\s*+" + _VALUE + r")?+)*+"
)
_LINK = (
    r"a(?=[\s/])" + _ATTRIBUTE_BEFORE_HREF + r"[\s/]*+href\s*+=\s*+(" + _VALUE + r")" + _REST
)
_TITLE = r"title(?=[\s/>])" + _REST + r"(.*?)(?:</title(?=[\s/>])|\z)"



def _tokens(*alternatives: str) -> str:
    return "(?is)<(?:" + "|".join(alternatives) + ")"


HREF_TOKENS = _tokens(_COMMENT, _RAW_TEXT.format(extra="|title"), _LINK, _OTHER_TAG)
TITLE_TOKENS = _tokens(_COMMENT, _RAW_TEXT.format(extra=""), _TITLE, _OTHER_TAG)
CHARACTER_REFERENCE = (
    r"&#[xX][0-9a-fA-F]++;?|&#[0-9]++;?|&[A-Za-z][A-Za-z0-9]*+[;=]?|[^&]++|&"
)
_SPACE = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
OUTER_SPACE = f"^{_SPACE}|{_SPACE}$"
QUOTED = r"""(?s)^"(.*)"$|^'(.*)'$"""
NO_TITLE = "Untitled Document"


def _code_point(number: Column) -> Column:
    """Character for a code point; U+FFFD outside Unicode."""
    good = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(F.coalesce(good, F.lit(False)), char).otherwise(F.lit("\ufffd"))


def _decode_token(token: Column) -> Column:
    named = F.from_json(
        F.lit(json.dumps({f"&{name}": text for name, text in html5.items()})),
        "map<string,string>",
    )
    digits = F.regexp_extract(token, r"^&#[xX]?([0-9a-fA-F]+)", 1)
    return (
        F.when(~token.startswith("&"), token)
        .when(token == "&amp;", F.lit("&"))
        .when(token == "&lt;", F.lit("<"))
        .when(token == "&gt;", F.lit(">"))
        .when(token == "&quot;", F.lit('"'))
        .when(
            token.rlike("^&#[xX]"),
            _code_point(F.conv(F.right(digits, F.lit(8)), 16, 10).try_cast("bigint")),
        )
        .when(token.startswith("&#") & (digits != ""), _code_point(digits.try_cast("bigint")))
        .otherwise(F.coalesce(F.try_element_at(named, token), token))
    )


def unescape(text: Column) -> Column:
    """Decode character references. Text without ``&`` is passed through untouched."""

    def decode(t):
        tokens = F.regexp_extract_all(t, F.lit(CHARACTER_REFERENCE), F.lit(0))
        return F.when(
            t.contains("&"), F.array_join(F.transform(tokens, _decode_token), "")
        ).otherwise(t)

    return let(text, decode)


def extract_hrefs(html: Column) -> Column:
    """Non-empty ``a[href]`` values in document order, duplicates kept, entities decoded."""
    raw = F.regexp_extract_all(html, F.lit(HREF_TOKENS), F.lit(2))
    unquoted = F.transform(
        F.filter(raw, lambda v: v != ""), lambda v: unescape(F.regexp_replace(v, QUOTED, "$1$2"))
    )
    return F.filter(unquoted, lambda v: v != "")


def page_title(html: Column) -> Column:
    """Text of all title elements, trimmed; ``Untitled Document`` if nothing is left."""
    titles = F.regexp_extract_all(html, F.lit(TITLE_TOKENS), F.lit(2))
    text = F.regexp_replace(unescape(F.array_join(titles, "")), OUTER_SPACE, "")
    return F.coalesce(F.regexp_replace(text, "^$", NO_TITLE), F.lit(NO_TITLE))
