"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Every character Python's str.isspace() accepts.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same characters for regular expressions (long lists of ranges match slowly in Java).
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Character classes and fonts of the width estimate.
NARROW_CHARS = "iIl.,:;'|!ftj()[]{}/\\ "
WIDE_CHARS = "mwMW@%"
TITLE_FONT, DESCRIPTION_FONT = 20, 14
TITLE_PIXEL_LIMIT, DESCRIPTION_PIXEL_LIMIT = 580, 1000

# Anchor texts that say nothing about their target.
GENERIC_ANCHORS = (
    "click here", "here", "read more", "more", "link", "this", "this page",
    "learn more", "details", "continue", "go", "download", "visit",
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def word_count(stripped: Column) -> Column:
    """Words of a text that has no outer whitespace."""
    return F.when(stripped == "", F.lit(0)).otherwise(F.size(F.split(stripped, WHITESPACE_RUN)))


def pixel_width(text: Column, font: int) -> Column:
    """Estimated rendered width.

    Characters are first reduced to their width class.  The units are then added
    one by one as doubles: any other order of addition can end one pixel off
    after truncation.
    """
    classed = F.regexp_replace(text, "[\x01-\x03]", "\x04")
    classed = F.regexp_replace(classed, "[" + re.escape(NARROW_CHARS) + "]", "\x01")
    classed = F.regexp_replace(classed, f"[{WIDE_CHARS}]", "\x02")
    classed = F.regexp_replace(classed, r"\p{IsUppercase}", "\x03")
    unit = lambda ch: (
        F.when(ch == "\x01", F.lit(0.30))
        .when(ch == "\x02", F.lit(0.85))
        .when(ch == "\x03", F.lit(0.70))
        .otherwise(F.lit(0.50))
    )
    return F.aggregate(
        F.regexp_extract_all(classed, F.lit("(?s)."), F.lit(0)),
        F.lit(0.0),
        lambda total, ch: total + unit(ch),
        lambda total: F.floor(total * F.lit(float(font))).cast("int"),
    )


def url_decode(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` and malformed escapes as they are."""
    guarded = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(guarded), text)


def url_quote(text: Column) -> Column:
    """Percent-encoding with ``/`` and the unreserved characters kept."""
    out = F.url_encode(text)
    for encoded, char in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(encoded), F.lit(char))
    return out
