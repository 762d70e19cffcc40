"""Token stage: HTML text to the few small arrays every page column reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.columns import built_once
from crawlglass.functions import html as H, urls

HEAD_TAGS = "html|meta|link|base"
RESOURCE_TAGS = "meta|link|img|iframe|source|video|audio"


def _usable(value: Column) -> Column:
    return F.when(F.col("_structured"), value)


@built_once
def _markup_columns() -> dict[str, Column]:
    has_noscript = F.exists("_tokens", H.is_noscript)
    without_noscript = F.transform("_tokens", lambda t: F.when(H.is_noscript(t), F.lit(H.GAP)).otherwise(t))
    return {
        "_markup": _usable(H.markup(F.col("_all"))),
        "_visible": _usable(H.visible_tokens(F.col("_tokens"))),
        "_visible_markup": _usable(F.when(has_noscript, H.markup(without_noscript))),
        "_base": urls.split_clean(F.col("final_url")),
    }


@built_once
def _array_columns() -> dict[str, Column]:
    annotated = r"(?is)^<(?!script\b|style\b)[a-z].*[\s\"'](?:itemtype|typeof|vocab)[\s=/>]"

    def is_jsonld(token: Column) -> Column:
        tag = H.parse_tag(F.regexp_extract(token, r"^<[^>]*+>", 0))
        declared = F.coalesce(H.attribute(tag, "type") == "application/ld+json", F.lit(False))
        return token.startswith("<") & token.rlike(r"(?i)^<script\b") & declared

    return {
        "_head": _usable(H.start_tags(F.col("_all"), HEAD_TAGS)),
        "_resources": H.start_tags(F.col("_visible"), RESOURCE_TAGS),
        "_levels": _usable(
            F.transform(
                F.filter("_all", lambda t: t.startswith("<") & t.rlike(r"(?i)^<h[1-6][\s/>]")),
                lambda t: F.substring(t, 3, 1).cast("int"),
            )
        ),
        "_annotated": _usable(F.transform(F.filter("_all", lambda t: t.startswith("<") & t.rlike(annotated)), H.parse_tag)),
        "_jsonld": _usable(
            F.transform(
                F.filter("_all", is_jsonld),
                lambda t: F.regexp_replace(t, r"(?is)^<script\b[^>]*+>|</script\s*+>$", ""),
            )
        ),
        "_title_element": H.first_element(F.col("_markup"), "title"),
        "_h1_elements": H.elements(F.col("_markup"), "h1"),
        "_anchors": H.elements(F.coalesce("_visible_markup", "_markup"), "a"),
        "_text": F.array_join(H.texts(F.filter("_visible", H.is_text)), " "),
    }


def add_tokens(df: DataFrame) -> DataFrame:
    """Cut ``_html`` of html-stage rows into tokens and drop the text itself.

    Every later column reads the arrays made here, so the page is scanned once.
    Rows of other stages, and documents without structure, get null arrays.
    """
    is_html = F.col("audit_stage") == "html"
    df = df.withColumns(
        {
            "_tokens": F.when(is_html, H.tokens(F.coalesce("_html", F.lit("")))),
            "html_chars": F.length("_html"),
        }
    )
    df = df.drop("_html").withColumn("_all", H.all_tokens(F.col("_tokens")))
    df = df.withColumn("_structured", H.has_start_tag(F.col("_all"), "head|title|meta"))
    return df.withColumns(_markup_columns()).withColumns(_array_columns())
