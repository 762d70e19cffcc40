"""Columns read from the document body: headings, text, images, structured data, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlglass.columns import built_once
from crawlglass.functions import html as H, text as T, urls
from crawlglass.operators.head import resolve
from crawlglass.operators.response import add_response_columns
from crawlglass.operators.tokens import add_tokens

# Columns add_body_columns provides.
BODY_COLUMNS = frozenset(
    """h1 h1_count h2_count h3_count h4_count h5_count h6_count heading_order_issues word_count visible_chars
    text_html_ratio microdata_types rdfa_used links mixed_content jsonld_scripts images_total images_missing_alt
    images_missing_dimensions images_lazy_loaded internal_links external_links nofollow_links sponsored_links
    ugc_links empty_anchor_links generic_anchor_links""".split()
)
# Links that lead to no page.
SKIPPED_LINKS = ("mailto:", "tel:", "javascript:", "#")


def heading_order_issues(levels: Column) -> Column:
    n = F.size(levels)
    first = F.when(
        F.get(levels, F.lit(0)) != 1, F.concat(F.lit("First heading is H"), F.get(levels, F.lit(0)), F.lit(", not H1"))
    )
    rest = F.greatest(n - 1, F.lit(0))
    skipped = F.zip_with(
        F.slice(levels, F.lit(1), rest),
        F.slice(levels, F.lit(2), rest),
        lambda a, b: F.when(b - a > 1, F.concat(F.lit("Skipped from H"), a, F.lit(" to H"), b)),
    )
    return F.array_compact(F.concat(F.array(first), skipped))


def _count(array: str, test) -> Column:
    return F.size(F.filter(array, test))


def _level_count(n: int) -> Column:
    return _count("_levels", lambda level: level == n)


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _anchor_parts() -> Column:
    return F.transform("_anchors", lambda e: F.struct(e.alias("e"), H.start_tag(e).alias("start")))


def _anchor_tags() -> Column:
    return F.transform(
        "_anchor_parts",
        lambda x: F.struct(
            H.parse_tag(x.start).alias("a"),
            F.substring(x.e, F.length(x.start) + 1, F.length(x.e)).alias("inner"),
        ),
    )


def _anchor_texts() -> Column:
    return F.transform(
        F.filter("_anchor_tags", lambda x: H.has_attribute(x.a, "href")),
        lambda x: F.struct(
            T.strip(H.attribute(x.a, "href")).alias("raw"),
            F.lower(F.coalesce(H.attribute(x.a, "rel"), F.lit(""))).alias("rel"),
            H.inner_text(x.inner).alias("label"),
            x.inner.rlike(r"(?i)<img[\s/>]").alias("has_img"),
        ),
    )


def _anchor_urls() -> Column:
    skipped = lambda x: F.substring(x.raw, 1, 11).rlike("^(?:" + "|".join(SKIPPED_LINKS) + ")")
    return F.transform(
        F.filter("_anchor_texts", lambda x: ~skipped(x)),
        lambda x: F.struct(
            urls.normalize(resolve(x.raw)).alias("url"),
            x.rel.alias("rel"), x.label.alias("label"), x.has_img.alias("has_img"),
        ),
    )


def _links() -> Column:
    """One struct per followed anchor, in document order, with the target resolved."""
    return F.transform(
        "_anchor_urls",
        lambda x, i: F.struct(
            i.cast("int").alias("pos"),
            x.url.alias("url"),
            urls.same_site(x.url, F.col("site")).alias("is_internal"),
            x.url.startswith("http").alias("is_web"),
            F.contains(x.rel, F.lit("nofollow")).alias("nofollow"),
            F.contains(x.rel, F.lit("sponsored")).alias("sponsored"),
            F.contains(x.rel, F.lit("ugc")).alias("ugc"),
            ((x.label == "") & ~x.has_img).alias("is_empty"),
            F.lower(x.label).isin(*T.GENERIC_ANCHORS).alias("is_generic"),
        ),
    )


@built_once
def _link_columns() -> list[tuple[str, Column]]:
    """Steps from anchor markup to ``links``; one column each keeps the analyzer's work linear."""
    return [
        ("_anchor_parts", _anchor_parts()),
        ("_anchor_tags", _anchor_tags()),
        ("_anchor_texts", _anchor_texts()),
        ("_anchor_urls", _anchor_urls()),
        ("links", _links()),
    ]


@built_once
def _first_columns() -> dict[str, Column]:
    item_types = F.flatten(
        F.transform(
        "_annotated",
        lambda t: F.split(T.strip(F.coalesce(H.attribute(t, "itemtype"), F.lit(""))), T.WHITESPACE_RUN),
        )
    )
    last_segment = lambda t: F.substring_index(F.rtrim(t, F.lit("/")), "/", -1)
    insecure = lambda t: (
        (t.tag == "link") & H.attribute(t, "href").startswith("http://")
    ) | (
        t.tag.isin("img", "iframe", "source", "video", "audio") & H.attribute(t, "src").startswith("http://")
    )
    return {
        "h1": F.transform("_h1_elements", lambda e: H.inner_text(H.content(e))),
        **{f"h{n}_count": _level_count(n) for n in range(1, 7)},
        "heading_order_issues": heading_order_issues(F.col("_levels")),
        "word_count": T.word_count(F.col("_text")),
        "visible_chars": F.length("_text"),
        "microdata_types": F.array_sort(
            F.array_distinct(F.transform(F.filter(item_types, lambda t: t != ""), last_segment))
        ),
        "rdfa_used": F.exists("_annotated", lambda t: H.has_attribute(t, "typeof") | H.has_attribute(t, "vocab")),
        "_images": F.filter("_resources", lambda t: t.tag == "img"),
        "mixed_content": F.when(F.col("is_https"), _count("_resources", insecure)).otherwise(F.lit(0)),
        "jsonld_scripts": F.size("_jsonld"),
    }


@built_once
def _derived_columns() -> dict[str, Column]:
    return {
        "text_html_ratio": F.round(
            F.col("visible_chars") / F.greatest(F.col("html_chars"), F.lit(1)).cast("double"), 3
        ),
        "images_total": F.size("_images"),
        "images_missing_alt": _count(
            "_images", lambda t: T.strip(F.coalesce(H.attribute(t, "alt"), F.lit(""))) == ""
        ),
        "images_missing_dimensions": _count(
            "_images", lambda t: _blank(H.attribute(t, "width")) | _blank(H.attribute(t, "height"))
        ),
        "images_lazy_loaded": _count("_images", lambda t: F.lower(H.attribute(t, "loading")) == "lazy"),
        "internal_links": _count("links", lambda l: l.is_internal),
        "external_links": _count("links", lambda l: ~l.is_internal & l.is_web),
        "nofollow_links": _count("links", lambda l: l.nofollow),
        "sponsored_links": _count("links", lambda l: l.sponsored),
        "ugc_links": _count("links", lambda l: l.ugc),
        "empty_anchor_links": _count("links", lambda l: l.is_empty),
        "generic_anchor_links": _count("links", lambda l: l.is_generic),
    }


def add_body_columns(df: DataFrame) -> DataFrame:
    df = df.withColumns(_first_columns())
    for name, column in _link_columns():
        df = df.withColumn(name, column)
    return df.withColumns(_derived_columns())


def heading_steps(fetch_log: DataFrame) -> DataFrame:
    """``(crawl_seq, pos, previous, level)`` of adjacent headings (one page per window)."""
    tokens = add_tokens(add_response_columns(fetch_log))
    page = Window.partitionBy("crawl_seq").orderBy("pos")
    # outer: an inner generator would push a copy of the extraction into a filter below it
    return (
        tokens.select("crawl_seq", F.posexplode_outer("_levels").alias("pos", "level"))
        .filter(F.col("level").isNotNull())
        .withColumn("previous", F.lag("level").over(page))
        .select("crawl_seq", "pos", "previous", "level")
    )
