"""Whole-site audit: page facts once, site passes over them, one report row per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlglass.operators.duplicates import duplicate_candidates, duplicate_issues
from crawlglass.operators.hreflang import hreflang_issues
from crawlglass.operators.link_status import (
    canonical_message,
    canonical_status,
    faulty_links,
    page_link_findings,
)
from crawlglass.operators.rules import Rule
from crawlglass.plans.page_audit import as_report, page_facts
from crawlglass.schema import ISSUE_TYPE, REPORT_TYPES
from crawlglass.sources.fetch_log import with_page_key
from crawlglass.storage import materialize

_LINKS = REPORT_TYPES["broken_links"]


def _findings(df: DataFrame, **columns) -> DataFrame:
    """Bring a pass's output to the common shape (absent parts are null)."""
    shape = {
        "issue": ISSUE_TYPE, "broken_links": _LINKS, "redirecting_links": _LINKS, "canonical_target_status": "int"
    }
    return df.select(
        "crawl_seq", *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in shape.items()]
    )


def _found(facts: DataFrame, link_status: DataFrame | None) -> DataFrame:
    """What the site passes find, one row a finding."""
    issue = F.struct("seq", "pos", "code", "message")
    found = _findings(duplicate_issues(duplicate_candidates(facts)), issue=issue).unionByName(
        _findings(hreflang_issues(facts), issue=issue)
    )
    if link_status is not None:
        links = page_link_findings(faulty_links(facts, link_status))
        canonicals = canonical_status(facts, link_status)
        message = canonical_message(F.col("status"), F.col("redirected"))
        found = found.unionByName(
            _findings(links, broken_links=F.col("broken_links"), redirecting_links=F.col("redirecting_links"))
        ).unionByName(
            _findings(
                canonicals,
                issue=F.when(
                    message.isNotNull(),
                    F.struct(
                        F.lit(35).alias("seq"), F.lit(0).alias("pos"),
                        F.lit("canonical_status").alias("code"), message.alias("message"),
                    ),
                ),
                canonical_target_status=F.col("status"),
            )
        )
    return found


def site_findings(facts: DataFrame, link_status: DataFrame | None = None) -> DataFrame:
    """One row per page with anything found by a site pass."""
    # At most eight issues per page: four duplicates, hreflang, two link counts, canonical.
    return _found(facts, link_status).groupBy("crawl_seq").agg(
        F.collect_list("issue").alias("_site_issues"),
        F.first("broken_links", ignorenulls=True).alias("broken_links"),
        F.first("redirecting_links", ignorenulls=True).alias("redirecting_links"),
        F.max("canonical_target_status").alias("canonical_target_status"),
    )


def _link_issue(column: str, seq: int, label: str):
    n = F.size(F.coalesce(column, F.array().cast(_LINKS)))
    return F.when(
        n > 0,
        F.struct(
            F.lit(seq).alias("seq"), F.lit(0).alias("pos"), F.lit(column).alias("code"),
            F.concat(n, F.lit(label)).alias("message"),
        ),
    ).cast(ISSUE_TYPE)


def issue_rows(facts: DataFrame, link_status: DataFrame | None = None) -> DataFrame:
    """``(crawl_seq, seq, pos, message)`` of all issues of all pages, without putting pages together again."""
    found = _found(facts, link_status)
    own = facts.select("crawl_seq", F.explode("page_issues").alias("i"))
    site = found.filter("issue IS NOT NULL").select("crawl_seq", F.col("issue").alias("i"))
    counts = found.select("crawl_seq", F.explode(F.array_compact(F.array(
        _link_issue("broken_links", 33, " broken link(s)"), _link_issue("redirecting_links", 34, " redirecting link(s)")
    ))).alias("i"))
    return own.unionAll(site).unionAll(counts).select("crawl_seq", "i.seq", "i.pos", "i.message")


def apply_findings(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """Facts with the site passes' columns; ``all_issues`` is in rule order."""
    none = F.array().cast(f"array<{ISSUE_TYPE}>")
    joined = facts.join(findings, "crawl_seq", "left")
    site = F.array_sort(
        F.array_compact(
            F.concat(
                F.coalesce("_site_issues", none),
                F.array(
                    _link_issue("broken_links", 33, " broken link(s)"),
                    _link_issue("redirecting_links", 34, " redirecting link(s)"),
                ),
            )
        )
    )
    empty = F.array().cast(_LINKS)
    return joined.withColumns(
        {
            "all_issues": F.concat("page_issues", site),
            "broken_links": F.coalesce("broken_links", empty),
            "redirecting_links": F.coalesce("redirecting_links", empty),
            "canonical_target_status": F.coalesce("canonical_target_status", F.lit(0)),
        }
    ).withColumn("issues", F.transform("all_issues", lambda i: i.message)).drop("_site_issues")


def audited_pages(
    fetch_log: DataFrame,
    link_status: DataFrame | None = None,
    rules: list[Rule] | None = None,
) -> DataFrame:
    """Facts, site findings and all issues per page.

    The facts are written once; the passes and the final join read columns of that table.
    ``crawl_seq`` tells pages apart: see :func:`with_page_key`.
    """
    facts = materialize(page_facts(with_page_key(fetch_log), rules), "facts")
    return apply_findings(facts, site_findings(facts, link_status))


def site_audit(
    fetch_log: DataFrame,
    link_status: DataFrame | None = None,
    rules: list[Rule] | None = None,
) -> DataFrame:
    """The complete page report (all fields, declared order)."""
    return as_report(audited_pages(fetch_log, link_status, rules))
