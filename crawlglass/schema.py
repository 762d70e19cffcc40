"""Declared schemas: the fetch log read, and the page report produced."""

from __future__ import annotations

FETCH_LOG_SCHEMA = (
    "crawl_seq bigint, url string, final_url string, status_code int, redirect_chain array<int>, "
    "response_time_ms int, headers map<string,string>, html string, error string, "
    "fetched_at timestamp, attempt int, user_agent string"
)

# Names, types and order of the page report are a contract with its readers.
PAGE_REPORT = [
    ("url", "string"), ("final_url", "string"), ("status_code", "int"), ("parse_ok", "boolean"),
    ("redirect_chain", "array<int>"), ("response_time_ms", "int"), ("content_type", "string"),
    ("indexable", "boolean"), ("indexability_reason", "string"),
    ("title", "string"), ("title_length", "int"), ("title_pixel_width", "int"),
    ("meta_description", "string"), ("meta_description_length", "int"),
    ("meta_description_pixel_width", "int"), ("meta_robots", "string"), ("x_robots_tag", "string"),
    ("canonical", "string"), ("canonical_is_self", "boolean"), ("canonical_count", "int"),
    ("canonical_source", "string"), ("canonical_target_status", "int"), ("lang", "string"),
    ("viewport", "string"), ("charset", "string"), ("base_href", "string"), ("favicon", "string"),
    ("pagination_next", "string"), ("pagination_prev", "string"),
    ("h1", "array<string>"), ("h1_count", "int"), ("h2_count", "int"), ("h3_count", "int"),
    ("h4_count", "int"), ("h5_count", "int"), ("h6_count", "int"),
    ("heading_order_issues", "array<string>"), ("word_count", "int"), ("text_html_ratio", "double"),
    ("internal_links", "int"), ("external_links", "int"), ("nofollow_links", "int"),
    ("sponsored_links", "int"), ("ugc_links", "int"), ("empty_anchor_links", "int"),
    ("generic_anchor_links", "int"), ("broken_links", "array<struct<url:string,status:int>>"),
    ("redirecting_links", "array<struct<url:string,status:int>>"),
    ("images_total", "int"), ("images_missing_alt", "int"), ("images_missing_dimensions", "int"),
    ("images_lazy_loaded", "int"),
    ("hreflang", "array<struct<lang:string,href:string>>"), ("hreflang_has_xdefault", "boolean"),
    ("og_tags", "map<string,string>"), ("twitter_tags", "map<string,string>"),
    ("schema_types", "array<string>"), ("microdata_types", "array<string>"), ("rdfa_used", "boolean"),
    ("is_https", "boolean"), ("hsts", "boolean"), ("content_encoding", "string"),
    ("cache_control", "string"), ("content_length", "bigint"), ("mixed_content", "int"),
    ("issues", "array<string>"),
]
REPORT_FIELDS = [name for name, _ in PAGE_REPORT]
REPORT_TYPES = dict(PAGE_REPORT)

ISSUE_TYPE = "struct<seq:int,pos:int,code:string,message:string>"

# Facts kept beside the report for the site-level passes.
FACT_TYPES = {
    "crawl_seq": "bigint",
    "site": "string",
    "audit_stage": "string",
    "visible_chars": "int",
    "html_chars": "int",
    "canonical_links": "array<string>",
    "header_canonical": "string",
    "links": "array<struct<pos:int,url:string,is_internal:boolean,is_web:boolean,"
    "nofollow:boolean,sponsored:boolean,ugc:boolean,is_empty:boolean,is_generic:boolean>>",
    "bad_hreflang_codes": "array<string>",
    "schema_gaps": "array<string>",
    "jsonld_scripts": "int",
    "jsonld_invalid": "int",
    "page_issues": f"array<{ISSUE_TYPE}>",
}
