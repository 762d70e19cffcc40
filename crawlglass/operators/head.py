"""Columns read from the document head: title, metas, canonicals, language, social tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.columns import built_once
from crawlglass.functions import html as H, text as T, urls


# Columns add_head_columns provides.
HEAD_COLUMNS = frozenset(
    """title title_length title_pixel_width meta_description meta_description_length meta_description_pixel_width
    meta_robots lang viewport charset base_href favicon pagination_next pagination_prev canonical canonical_links
    header_canonical canonical_count canonical_source canonical_is_self hreflang hreflang_has_xdefault
    bad_hreflang_codes og_tags twitter_tags""".split()
)


def _text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _first_attribute(tags: str, test, name: str) -> Column:
    return _text_or_empty(H.attribute(H.first_where(F.col(tags), test), name))


def _meta_named(name: str):
    return lambda t: (t.tag == "meta") & (H.attribute(t, "name") == name)


def _link_rel(regex: str, with_href: bool = False):
    def test(t: Column) -> Column:
        found = (t.tag == "link") & H.attribute(t, "rel").rlike(regex)
        return found & H.has_attribute(t, "href") if with_href else found

    return test


def resolve(ref: Column) -> Column:
    """Resolve against the final URL (a ``<base>`` is recorded, not applied)."""
    return urls.join_parts(F.col("final_url"), F.col("_base"), ref)


def _link_href(regex: str) -> Column:
    return H.attribute(H.first_where(F.col("_head"), _link_rel(regex, with_href=True)), "href")


def title() -> Column:
    """Text of the first title; a title that contains tags has no text."""
    parts = F.split(H.content(F.col("_title_element")), H.MARKUP_REGEX, -1)
    return F.when(F.size(parts) == 1, T.strip(H.decode_entities(F.get(parts, F.lit(0))))).otherwise(F.lit(""))


def header_canonical() -> Column:
    """Unresolved canonical of the ``Link`` header; null when there is none."""
    # Fixed value: what counts as a canonical in the header.
    rel = r"""(?i)<([^>]+)>\s*;\s*rel\s*=\s*"?canonical"?"""
    part = F.get(F.filter(F.split("_link_header", ","), lambda p: p.rlike(rel)), F.lit(0))
    return T.strip(F.regexp_extract(part, rel, 1))


def _social(attribute: str, prefix: str) -> Column:
    """Map of non-empty contents; the last tag of a name wins."""
    tags = F.filter(
        "_resources",
        lambda t: (t.tag == "meta")
        & H.attribute(t, attribute).startswith(prefix)
        & (H.attribute(t, "content") != ""),
    )
    newest_first = F.reverse(F.transform(tags, lambda t: H.attribute(t, attribute)))
    contents = F.reverse(F.transform(tags, lambda t: H.attribute(t, "content")))
    names = F.array_distinct(newest_first)
    return F.map_from_arrays(
        F.reverse(names),
        F.reverse(
            F.transform(names, lambda n: F.get(contents, F.array_position(newest_first, n).cast("int") - 1))
        ),
    )


@built_once
def _first_columns() -> dict[str, Column]:
    non_empty_href = lambda t: H.attribute(t, "href") != ""
    return {
        "title": title(),
        "meta_description": T.strip(_first_attribute("_head", _meta_named("description"), "content")),
        "meta_robots": T.strip(
            _first_attribute(
                "_head", lambda t: (t.tag == "meta") & H.attribute(t, "name").rlike("(?i)robots"), "content"
            )
        ),
        "lang": _first_attribute("_head", lambda t: t.tag == "html", "lang"),
        "viewport": _first_attribute("_head", _meta_named("viewport"), "content"),
        "charset": _first_attribute(
            "_head", lambda t: (t.tag == "meta") & H.has_attribute(t, "charset"), "charset"
        ),
        "base_href": _first_attribute(
            "_head", lambda t: (t.tag == "base") & H.has_attribute(t, "href"), "href"
        ),
        "_canonical_hrefs": F.transform(
            F.filter("_head", lambda t: _link_rel("(?i)canonical")(t) & non_empty_href(t)),
            lambda t: H.attribute(t, "href"),
        ),
        "_single_hrefs": F.array(
            F.when(F.col("_structured"), header_canonical()),
            _link_href("(?i)icon"),
            _link_href(r"(?i)\bnext\b"),
            _link_href(r"(?i)\bprev\b"),
        ),
        "_alternates": F.transform(
            F.filter(
                "_resources",
                lambda t: _link_rel("(?i)alternate")(t) & (H.attribute(t, "hreflang") != ""),
            ),
            lambda t: F.struct(
                H.attribute(t, "hreflang").alias("lang"),
                _text_or_empty(H.attribute(t, "href")).alias("href"),
            ),
        ),
        "og_tags": _social("property", "og:"),
        "twitter_tags": _social("name", "twitter:"),
    }


@built_once
def _resolved_columns() -> dict[str, Column]:
    """All head references resolved in one pass: single ones, canonicals, alternates."""
    refs = F.concat("_single_hrefs", "_canonical_hrefs", F.transform("_alternates", lambda a: a.href))
    return {"_resolved": F.transform(refs, resolve)}


@built_once
def _reference_columns() -> dict[str, Column]:
    single = lambda i: _text_or_empty(F.get("_resolved", F.lit(i)))
    n_canonical = F.size("_canonical_hrefs")
    return {
        "header_canonical": single(0),
        "favicon": single(1),
        "pagination_next": single(2),
        "pagination_prev": single(3),
        "canonical_links": F.slice("_resolved", F.lit(5), n_canonical),
        "hreflang": F.zip_with(
            F.transform("_alternates", lambda a: a.lang),
            F.slice("_resolved", n_canonical + 5, F.size("_alternates")),
            lambda lang, href: F.struct(lang.alias("lang"), href.alias("href")),
        ),
    }


@built_once
def _derived_columns() -> dict[str, Column]:
    has_links = F.size("canonical_links") > 0
    has_header = F.col("header_canonical") != ""
    return {
        "title_length": F.length("title"),
        "title_pixel_width": T.pixel_width(F.col("title"), T.TITLE_FONT),
        "meta_description_length": F.length("meta_description"),
        "meta_description_pixel_width": T.pixel_width(F.col("meta_description"), T.DESCRIPTION_FONT),
        "canonical": F.when(has_links, F.get("canonical_links", F.lit(0))).otherwise(F.col("header_canonical")),
        "canonical_count": F.size("canonical_links") + has_header.cast("int"),
        "canonical_source": F.concat_ws("+", F.when(has_links, "link"), F.when(has_header, "header")),
        "_canonical_norms": F.transform(
            F.concat("canonical_links", F.filter(F.array("header_canonical"), lambda c: c != "")),
            urls.normalize,
        ),
        "_page_norm": urls.normalize(F.col("final_url")),
        "_alternate_norms": F.transform("hreflang", lambda h: urls.normalize(h.href)),
        "_noindex": F.contains(F.lower(F.concat_ws(" ", "meta_robots", "x_robots_tag")), F.lit("noindex")),
        "hreflang_has_xdefault": F.exists("hreflang", lambda h: F.lower(h.lang) == "x-default"),
        "bad_hreflang_codes": F.filter(
            F.transform("hreflang", lambda h: h.lang),
            # fixed value: form of a language code
            lambda l: (F.lower(l) != "x-default") & ~l.rlike(r"^[a-z]{2,3}(?:-[a-zA-Z]{2,4})?\z"),
        ),
        "_missing_og": F.filter(
            F.array(*[F.lit(f"og:{n}") for n in ("title", "image", "url", "type")]),
            lambda n: ~F.array_contains(F.map_keys("og_tags"), n),
        ),
    }


@built_once
def _compared_columns() -> dict[str, Column]:
    return {
        "canonical_is_self": (F.col("canonical") != "") & (F.get("_canonical_norms", F.lit(0)) == F.col("_page_norm")),
        "_canonical_conflict": F.size(F.array_distinct("_canonical_norms")) > 1,
        "_hreflang_self": F.array_contains("_alternate_norms", F.col("_page_norm")),
    }


def add_head_columns(df: DataFrame) -> DataFrame:
    for columns in (_first_columns, _resolved_columns, _reference_columns, _derived_columns, _compared_columns):
        df = df.withColumns(columns())
    return df
