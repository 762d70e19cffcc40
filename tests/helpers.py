"""Fetch-log rows built by hand."""

from datetime import datetime

from crawlglass.schema import FETCH_LOG_SCHEMA


def page(seq, html, url=None, final_url=None, status=200, headers=None, chain=(), error=None, at=None):
    url = url or f"https://example.com/p{seq}"
    heads = {"content-type": "text/html"}
    heads.update(headers or {})
    return (
        seq, url, final_url or url, status, list(chain), 12, heads, html, error,
        at or datetime(2024, 1, 1, 0, 0, seq % 60), 1, "test",
    )


def log(spark, rows):
    return spark.createDataFrame(rows, FETCH_LOG_SCHEMA)


def by_seq(df):
    return {r.crawl_seq: r for r in df.collect()}
