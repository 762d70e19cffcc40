"""HTML as an array of tokens, built with Column expressions.

Everything the audit asks of a page is flat: a tag with attribute tests in
document order, or the text inside an element that cannot nest in itself.  One
linear regular expression cuts the markup into tokens; no tree is built.  All
functions are row-local, so they need no shuffle and work on streams.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from crawlglass.functions.text import strip
from crawlglass.functions.urls import let

_ATTRS = r"""(?:[^'"<>]++|"[^"]*+"|'[^']*+')*+>"""
_COMMENT = r"<!--(?:.*?-->|.*)"
_TAG = r"</?[a-z][a-z0-9:-]*+" + _ATTRS + r"|</?[a-z][^<>]*+>|<[!?][^<>]*+>"
_TEXT = r"(?:[^<]++|<(?![a-z/!?]))++"


def _raw_element(tag: str) -> str:
    """An element whose content is not markup; unclosed ones run to the end."""
    return rf"<{tag}\b[^>]*+>(?:.*?</{tag}\s*+>|.*)"


_RAW = "|".join([_COMMENT, _raw_element("script"), _raw_element("style")])
_REST = f"{_TAG}|{_TEXT}|<"
PAGE_REGEX = f"(?is){_RAW}|{_raw_element('noscript')}|{_REST}"
NOSCRIPT_REGEX = f"(?is){_RAW}|{_REST}"
MARKUP_REGEX = f"(?is){_TAG}"
ATTRIBUTE_REGEX = r"""(?s)([^\s"'<>/=]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?"""
_SPACES = " \t\n\r\x0b\x0c"
# Stands for a removed token, so that the texts around it stay apart.
GAP = "<!>"

# HTML 4 names, from the standard library, plus the XML apostrophe.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
_COMMON = ("amp", "lt", "gt", "quot", "nbsp")


def extract_all(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def _is(token: Column, names: str) -> Column:
    """Whether a token is a start tag of one of the ``|``-separated names."""
    return token.startswith("<") & token.rlike(rf"(?i)^<(?:{names})(?:[\s/>])")


def _code_point(hex_digits: Column) -> Column:
    digits = F.regexp_replace(F.lower(hex_digits), "^0+(?=.)", "")
    valid = (F.length(digits) <= 6) & ~digits.rlike("^(?:0|d[89a-f][0-9a-f]{2})$")
    padded = F.lpad(digits, 8, "0")
    in_range = valid & (padded <= "0010ffff")
    return F.when(in_range, F.decode(F.unhex(padded), "UTF-32")).otherwise(F.lit("�"))


def decode_entities(text: Column) -> Column:
    """Decode character references once (``&amp;lt;`` gives ``&lt;``)."""
    table = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def piece(p: Column) -> Column:
        name = F.substring(p, 2, 40)
        named = F.regexp_extract(p, "^&([A-Za-z][A-Za-z0-9]*);$", 1)
        out = F.when(~p.startswith("&"), p)
        for common in _COMMON:
            out = out.when(name == f"{common};", F.lit(ENTITIES[common]))
        return (
            out.when(p.rlike("^&#[xX]"), _code_point(F.regexp_extract(p, "([0-9a-fA-F]+)", 1)))
            .when(
                p.startswith("&#"),
                _code_point(F.hex(F.coalesce(F.regexp_extract(p, "([0-9]+)", 1).try_cast("bigint"), F.lit(0)))),
            )
            .when(named != "", F.coalesce(F.try_element_at(table, named), p))
            .otherwise(p)
        )

    pieces = extract_all(text, r"(?s)&#[xX][0-9a-fA-F]++;?|&#[0-9]++;?|&[A-Za-z][A-Za-z0-9]*+;|[^&]++|&")
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def tokens(html: Column) -> Column:
    """All tokens; a noscript block is one token."""
    return extract_all(html, PAGE_REGEX)


def is_noscript(token: Column) -> Column:
    return token.startswith("<") & token.rlike(r"(?i)^<noscript\b")


def all_tokens(toks: Column) -> Column:
    """Tokens with noscript blocks opened up."""
    opened = F.flatten(
        F.transform(toks, lambda t: F.when(is_noscript(t), extract_all(t, NOSCRIPT_REGEX)).otherwise(F.array(t)))
    )
    return F.when(F.exists(toks, is_noscript), opened).otherwise(toks)


def visible_tokens(toks: Column) -> Column:
    """Tokens without comments, scripts, styles and noscript blocks."""
    return F.filter(toks, lambda t: ~(t.startswith("<") & t.rlike(r"(?i)^<(?:[!?]|(?:script|style|noscript)\b)")))


def markup(toks: Column) -> Column:
    """Tokens joined back, with hidden ones replaced by a gap."""
    hidden = lambda t: t.startswith("<") & t.rlike(r"(?i)^<(?:[!?]|(?:script|style)\b)")
    return F.array_join(F.transform(toks, lambda t: F.when(hidden(t), F.lit(GAP)).otherwise(t)), "")


def is_text(token: Column) -> Column:
    return ~(token.startswith("<") & token.rlike(r"(?i)^<[a-z/!?]"))


def texts(pieces: Column) -> Column:
    """Decoded and trimmed text nodes, empty ones dropped."""
    cleaned = F.transform(pieces, lambda p: strip(decode_entities(p)))
    return F.filter(cleaned, lambda p: p != "")


def inner_text(markup_piece: Column) -> Column:
    """Text nodes of a piece of markup, trimmed and joined without separator."""
    pieces = F.array_join(texts(F.split(markup_piece, MARKUP_REGEX, -1)), "")
    return F.when(markup_piece.contains("<"), pieces).otherwise(strip(decode_entities(markup_piece)))


def elements(text: Column, tag: str) -> Column:
    """Start tag plus content of each ``tag``, up to the next tag of that name."""
    return extract_all(text, rf"(?is)<{tag}(?=[\s/>]){_ATTRS}(?:[^<]++|<(?!/?{tag}[\s/>]))*+")


def first_element(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?is)<{tag}(?=[\s/>]){_ATTRS}(?:[^<]++|<(?!/?{tag}[\s/>]))*+", 0)


def start_tag(element: Column) -> Column:
    return F.regexp_extract(element, rf"(?is)^<[a-z][a-z0-9:-]*+{_ATTRS}", 0)


def content(element: Column) -> Column:
    return F.substring(element, F.length(start_tag(element)) + 1, F.length(element))


def start_tags(toks: Column, names: str) -> Column:
    """Parsed start tags of the ``|``-separated names, in document order."""
    return F.transform(F.filter(toks, lambda t: _is(t, names)), parse_tag)


def has_start_tag(toks: Column, names: str) -> Column:
    return F.exists(toks, lambda t: _is(t, names))


def parse_tag(tag: Column) -> Column:
    """``struct<tag, names, vals>`` of a start tag, values decoded.

    The tag name is the first match of the attribute pattern, so it also heads
    the two arrays; no attribute that is looked up is called like its tag.
    """

    def value(pair: Column) -> Column:
        raw = F.ltrim(F.substring(pair, F.instr(pair, "=") + 1, F.length(pair)), F.lit(_SPACES))
        quoted = raw.startswith('"') | raw.startswith("'")
        plain = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.when(pair.contains("="), decode_entities(plain)).otherwise("")

    def parsed(pairs: Column) -> Column:
        name = lambda pair: F.lower(F.rtrim(F.substring_index(pair, "=", 1), F.lit(_SPACES)))
        return F.struct(
            name(F.get(pairs, F.lit(0))).alias("tag"),
            F.transform(pairs, name).alias("names"),
            F.transform(pairs, value).alias("vals"),
        )

    return let(extract_all(tag, ATTRIBUTE_REGEX), parsed)


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name; null when absent."""
    return F.get(tag["vals"], F.array_position(tag["names"], name).cast("int") - 1)


def has_attribute(tag: Column, name: str) -> Column:
    return F.array_contains(tag["names"], name)


def first_where(tags: Column, test) -> Column:
    return F.get(F.filter(tags, test), F.lit(0))
