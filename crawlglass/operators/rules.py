"""The ordered table of page-level issue rules.

A rule is a sequence number, a code and a message Column that is null when the
page passes.  Callers can extend the list.  ``page_issues`` evaluates the table
in one row-local expression; ``explode_issues`` gives the long form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.functions.text import DESCRIPTION_PIXEL_LIMIT, TITLE_PIXEL_LIMIT
from crawlglass.schema import ISSUE_TYPE


@dataclass(frozen=True)
class Rule:
    seq: int
    code: str
    message: Column  # string, or array of strings; null or empty when the rule does not fire
    many: bool = False


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def page_rules() -> list[Rule]:
    """The rules in report order.

    Fixed values: message texts, bounds and patterns are what readers of the report match on (also the hint of rule 4).
    """
    c = F.col
    html = c("parse_ok") & (c("audit_stage") == "html")
    plain_encoding = F.lower("content_encoding").isin("", "gzip", "deflate", "identity")

    def when(condition: Column, *parts) -> Column:
        return F.when(html & condition, text(*parts))

    def counted(column: str, label: str) -> Column:
        return when(c(column) > 0, c(column), label)

    return [
        Rule(1, "request_failed", F.when(c("audit_stage") == "failed", text("Request failed: ", c("_error")))),
        Rule(
            2, "redirect_chain",
            F.when(
                F.size("redirect_chain") > 0,
                text("Redirect chain: [", F.array_join(c("redirect_chain").cast("array<string>"), ", "), "] -> ", c("final_url")),
            ),
        ),
        Rule(3, "error_status", F.when(c("audit_stage") == "error", text("Error status: ", c("status_code")))),
        Rule(
            4, "undecodable_content",
            F.when(
                ~c("parse_ok") & ~plain_encoding,
                text(
                    "Response sent as '", F.lower("content_encoding"), "' but no decoder installed — "
                    "content unreadable. Install it (e.g. pip install brotli) or the crawler advertises only gzip/deflate.",
                ),
            ),
        ),
        Rule(
            5, "no_structure",
            F.when(
                ~c("parse_ok") & plain_encoding,
                text("No HTML structure found (likely JS-rendered; needs a headless browser to audit)."),
            ),
        ),
        Rule(
            6, "title",
            F.coalesce(
                when(c("title") == "", "Missing <title>"),
                when(c("title_length") > 60, "Title too long (", c("title_length"), " chars)"),
                when(c("title_length") < 10, "Title very short (", c("title_length"), " chars)"),
            ),
        ),
        Rule(
            7, "title_truncated",
            when(
                c("title_pixel_width") > TITLE_PIXEL_LIMIT,
                "Title likely truncated in SERP (~", c("title_pixel_width"), f"px > {TITLE_PIXEL_LIMIT}px)",
            ),
        ),
        Rule(
            8, "meta_description",
            F.coalesce(
                when(c("meta_description") == "", "Missing meta description"),
                when(
                    c("meta_description_length") > 160,
                    "Meta description too long (", c("meta_description_length"), " chars)",
                ),
            ),
        ),
        Rule(
            9, "meta_description_truncated",
            when(
                c("meta_description_pixel_width") > DESCRIPTION_PIXEL_LIMIT,
                "Meta description likely truncated in SERP (~", c("meta_description_pixel_width"),
                f"px > {DESCRIPTION_PIXEL_LIMIT}px)",
            ),
        ),
        Rule(10, "noindex", when(c("_noindex"), "Page is noindex")),
        Rule(
            11, "canonical",
            F.coalesce(
                when(c("canonical") == "", "Missing canonical tag"),
                when(~c("canonical_is_self"), "Canonical points elsewhere: ", c("canonical")),
            ),
        ),
        Rule(
            12, "canonical_conflict",
            when(c("_canonical_conflict"), "Conflicting canonical tags (", c("canonical_count"), " found)"),
        ),
        Rule(
            13, "noindex_self_canonical",
            when(~c("indexable") & c("canonical_is_self"), "Conflict: noindex + self-canonical"),
        ),
        Rule(14, "lang", when(c("lang") == "", "Missing lang attribute on <html>")),
        Rule(
            15, "viewport",
            F.coalesce(
                when(c("viewport") == "", "Missing viewport meta (mobile)"),
                when(
                    F.lower("viewport").rlike(r"user-scalable=no|maximum-scale=\s*1\b"),
                    "Viewport disables zoom (user-scalable=no)",
                ),
            ),
        ),
        Rule(
            16, "h1",
            F.coalesce(
                when(c("h1_count") == 0, "No H1 found"),
                when(c("h1_count") > 1, "Multiple H1s (", c("h1_count"), ")"),
            ),
        ),
        Rule(
            17, "heading_order",
            when(
                F.size("heading_order_issues") > 0,
                "Broken heading order (", F.get("heading_order_issues", F.lit(0)), ")",
            ),
        ),
        Rule(
            18, "jsonld_invalid",
            F.when(html, F.array_repeat(F.lit("Invalid JSON-LD structured data"), c("jsonld_invalid"))),
            many=True,
        ),
        Rule(19, "schema_required", F.when(html, c("schema_gaps")), many=True),
        Rule(20, "thin_content", when(c("word_count") < 200, "Thin content (", c("word_count"), " words)")),
        Rule(
            21, "hreflang_xdefault",
            when((F.size("hreflang") > 0) & ~c("hreflang_has_xdefault"), "hreflang set has no x-default"),
        ),
        Rule(
            22, "hreflang_self",
            when((F.size("hreflang") > 0) & ~c("_hreflang_self"), "hreflang set omits a self-referencing entry"),
        ),
        Rule(
            23, "hreflang_codes",
            when(
                F.size("bad_hreflang_codes") > 0,
                "Invalid hreflang code(s): ", F.array_join(F.slice("bad_hreflang_codes", 1, 3), ", "),
            ),
        ),
        Rule(
            24, "open_graph",
            when(
                (F.size("og_tags") > 0) & (F.size("_missing_og") > 0),
                "Incomplete Open Graph (missing: ", F.array_join("_missing_og", ", "), ")",
            ),
        ),
        Rule(
            25, "twitter_card",
            when(
                (F.size("twitter_tags") > 0) & ~F.map_contains_key("twitter_tags", "twitter:card"),
                "Twitter Card present but missing twitter:card type",
            ),
        ),
        Rule(26, "image_alt", counted("images_missing_alt", " image(s) missing alt text")),
        Rule(27, "image_dimensions", counted("images_missing_dimensions", " image(s) missing width/height (CLS)")),
        Rule(28, "empty_anchor", counted("empty_anchor_links", " link(s) with empty anchor text")),
        Rule(29, "generic_anchor", counted("generic_anchor_links", " link(s) with generic anchor text")),
        Rule(30, "mixed_content", counted("mixed_content", " insecure (HTTP) resource(s) on HTTPS page")),
    ]


def evaluate(rules: list[Rule]) -> Column:
    """``array<issue>`` in rule order."""

    def issue(rule: Rule, pos: Column, message: Column) -> Column:
        return F.struct(
            F.lit(rule.seq).alias("seq"), pos.cast("int").alias("pos"),
            F.lit(rule.code).alias("code"), message.alias("message"),
        )

    def numbered(rule: Rule, messages: Column) -> Column:
        return F.transform(messages, lambda message, pos: issue(rule, pos, message))

    parts, singles = [], []

    def flush() -> None:
        if singles:
            parts.append(F.array(*singles))
            singles.clear()

    for rule in rules:
        if rule.many:
            flush()
            messages = F.coalesce(rule.message, F.array().cast("array<string>"))
            parts.append(numbered(rule, messages))
        else:
            singles.append(issue(rule, F.lit(0), rule.message))
    flush()
    return F.filter(F.concat(*parts), lambda i: i.message.isNotNull()).cast(f"array<{ISSUE_TYPE}>")


def explode_issues(facts: DataFrame) -> DataFrame:
    """Long form of the page-level issues: one row per finding."""
    return facts.select("crawl_seq", "url", F.explode("page_issues").alias("issue")).select(
        "crawl_seq", "url", "issue.*"
    )
