"""Per-page audit: fetch log in, one wide row of facts per page out.

Purely row-local: projections over one scan, no shuffle, the same on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.columns import built_once
from crawlglass.operators.body import BODY_COLUMNS, add_body_columns
from crawlglass.operators.head import HEAD_COLUMNS, add_head_columns
from crawlglass.operators.response import add_response_columns
from crawlglass.operators.rules import Rule, evaluate, page_rules
from crawlglass.operators.structured import scan_jsonld
from crawlglass.operators.tokens import add_tokens
from crawlglass.schema import FACT_TYPES, REPORT_FIELDS, REPORT_TYPES

_DEFAULTS = {"string": "''", "int": "0", "bigint": "0L", "double": "0.0D", "boolean": "false"}


def _typed(name: str, kind: str) -> Column:
    """Column with the declared type, and the declared default for null."""
    if kind.startswith("array"):
        default = F.array().cast(kind)
    elif kind.startswith("map"):
        default = F.create_map().cast(kind)
    else:
        default = F.expr(_DEFAULTS[kind])
    return F.coalesce(F.col(name).cast(kind), default).alias(name)


@built_once
def _verdict_columns() -> list[tuple[str, Column]]:
    encoding = F.lower("content_encoding")
    parse_ok = (F.col("audit_stage") != "html") | F.coalesce("_structured", F.lit(False))
    reason = (
        F.when(F.col("audit_stage") == "failed", F.concat(F.lit("request failed: "), F.col("_error")))
        .when(F.col("audit_stage") == "error", F.concat(F.lit("HTTP "), F.col("status_code")))
        .when(F.col("audit_stage") == "non_html", "non-HTML content")
        .when(
            ~F.col("parse_ok"),
            F.when(
                encoding.isin("", "gzip", "deflate", "identity"), F.lit("empty/JS-rendered HTML")
            ).otherwise(F.concat(F.lit("undecodable content ("), encoding, F.lit(")"))),
        )
        .when(F.col("_noindex"), "noindex directive")
        .otherwise("")
    )
    return [
        ("parse_ok", parse_ok),
        ("indexability_reason", reason),
        ("indexable", F.col("indexability_reason") == ""),
    ]


_SCRATCH = """
_tokens _all _markup _visible _visible_markup _base _head _resources _levels _annotated _title_element _h1_elements
_anchors _text _images _link_header _structured _canonical_hrefs _single_hrefs _alternates _resolved _canonical_norms
_page_norm _alternate_norms _anchor_parts _anchor_tags _anchor_texts _anchor_urls
""".split()
_VERDICT = {"parse_ok", "indexability_reason", "indexable"}


def extract(
    fetch_log: DataFrame, keep: list[str] | None = None, names: set[str] | None = None
) -> DataFrame:
    """All page columns before rules; keeps the underscore columns rules refer to.

    With ``names``, groups of columns that none of the names needs are left out of the plan.
    """
    df = add_tokens(add_response_columns(fetch_log, keep))
    if names is None or names & (HEAD_COLUMNS | _VERDICT):
        df = add_head_columns(df)
    if names is None or names & BODY_COLUMNS:
        df = add_body_columns(df)
    if names is None or names & _VERDICT:
        for name, column in _verdict_columns():
            df = df.withColumn(name, column)
    return df.drop(*_SCRATCH)


def with_jsonld(df: DataFrame) -> DataFrame:
    df = df.withColumn("_ld", scan_jsonld(F.coalesce("_jsonld", F.array().cast("array<string>"))))
    return df.withColumns(
        {
            "schema_types": F.col("_ld.types"),
            "schema_gaps": F.col("_ld.gaps"),
            "jsonld_invalid": F.col("_ld.invalid"),
        }
    )


@built_once
def _default_issues() -> Column:
    return evaluate(page_rules())


@built_once
def _fact_columns() -> list[Column]:
    filled_later = {"broken_links", "redirecting_links", "canonical_target_status", "issues"}
    report = [_typed(n, t) for n, t in REPORT_TYPES.items() if n not in filled_later]
    return report + [_typed(n, t) for n, t in FACT_TYPES.items()]


def page_facts(
    fetch_log: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Report columns plus the facts the site passes need (see ``schema``).

    ``keep`` names further fetch-log columns to carry along.
    """
    df = with_jsonld(extract(fetch_log, keep))
    issues = _default_issues() if rules is None else evaluate(rules)
    df = df.withColumn("page_issues", issues)
    # The generator is a barrier: a filter on a derived column would otherwise be pushed below
    # these projections, with every expression it depends on copied into it.
    return df.select(F.inline(F.array(F.struct(*_fact_columns()))), *(keep or []))


def page_columns(fetch_log: DataFrame, names: list[str]) -> DataFrame:
    """Only the named report or fact columns; what they do not need is never computed."""
    types = {**REPORT_TYPES, **FACT_TYPES}
    df = extract(fetch_log, names=set(names))
    if {"schema_types", "schema_gaps", "jsonld_invalid"} & set(names):
        df = with_jsonld(df)
    return df.select(F.inline(F.array(F.struct(*[_typed(n, types[n]) for n in names]))))


@built_once
def _report_columns() -> list[Column]:
    return [_typed(n, t) for n, t in REPORT_TYPES.items()]


def as_report(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Project to the declared page report, after any columns in ``keep``."""
    return df.select(*(keep or []), *_report_columns())


def page_audit(fetch_log: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The page report without site-level findings; stateless, so usable on a stream."""
    df = page_facts(fetch_log, rules)
    return as_report(
        df.withColumns(
            {
                "broken_links": F.array().cast(REPORT_TYPES["broken_links"]),
                "redirecting_links": F.array().cast(REPORT_TYPES["redirecting_links"]),
                "canonical_target_status": F.lit(0),
                "issues": F.transform("page_issues", lambda i: i.message),
            }
        )
    )


__all__ = ["REPORT_FIELDS", "as_report", "extract", "page_audit", "page_columns", "page_facts", "with_jsonld"]
