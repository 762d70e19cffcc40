"""What the physical plans must and must not contain."""

from crawlglass.operators import duplicates, edges, hreflang, link_status
from crawlglass.plans.page_audit import page_audit, page_columns, page_facts
from crawlglass.sources import fetch_log
from crawlglass.storage import materialize
from tests.helpers import log, page

HTML = "<html><head><title>Plan test page</title></head><body><h1>h</h1><a href='/x'>link text</a></body></html>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_page_audit_has_no_shuffle(spark):
    plan = plan_of(page_audit(log(spark, [page(1, HTML)])))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_narrow_audit_needs_no_python(spark):
    plan = plan_of(page_columns(log(spark, [page(1, HTML)]), ["title", "h1_count"]))
    assert "ArrowEvalPython" not in plan and "Exchange" not in plan


def test_passes_read_only_their_columns(spark):
    facts = materialize(page_facts(log(spark, [page(1, HTML)])), "t")
    plan = plan_of(duplicates.duplicate_groups(duplicates.duplicate_candidates(facts)))
    assert "PushedFilters: [IsNotNull(parse_ok), EqualTo(parse_ok,true)]" in plan
    assert "links" not in plan and "page_issues" not in plan
    links = plan_of(link_status.link_rows(facts))
    assert "ReadSchema: struct<crawl_seq:bigint,links:" in links and "title" not in links


def test_joins_are_never_cartesian(spark):
    facts = materialize(page_facts(log(spark, [page(1, HTML)])), "t")
    status = spark.createDataFrame([("https://example.com/x", 404, False)], "url string, status int, redirected boolean")
    plan = plan_of(link_status.faulty_links(facts, status))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert [tuple(r) for r in link_status.faulty_links(facts, status).select("crawl_seq", "pos", "broken").collect()] == [(1, 0, True)]


def test_page_texts_of_the_final_fetch_meet_no_exchange(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, [page(i, HTML, url=f"https://example.com/p{i % 3}") for i in range(9)]).drop("crawl_seq").repartition(3).write.parquet(path)
    last = fetch_log.final_fetches(spark.read.parquet(path).filter("status_code = 200"))
    plan = plan_of(last)
    assert "html" in plan and "BroadcastHashJoin" in plan
    # The only exchange is the broadcast of the bitmaps.
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan
    assert sorted(r.url[-1] for r in last.collect()) == ["0", "1", "2"]


def test_links_are_followed_in_place(spark):
    links = spark.createDataFrame([(f"u{i % 7}", i, f"u{i}") for i in range(50)], "url string, pos int, target string")
    stored = edges.store_edges(links, "url", "t", piece=5)
    starts = materialize(spark.createDataFrame([("u1", 0), ("u2", 1)], "url string, n int"), "starts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = formatted(stored.follow(starts))
        # Starts and hubs meet by key, then starts go to the buckets; a bucketed scan has no exchange above it.
        assert "Bucketed: true" in plan and plan.count("hashpartitioning(url") == 3
        assert stored.follow(starts).count() == 14
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_without_counts_plan_each_side_once(spark):
    facts = materialize(page_facts(log(spark, [page(1, HTML)])), "t")
    status = materialize(spark.createDataFrame([("https://example.com/x", 404, False)], "url string, status int, redirected boolean"), "s")
    assert plan_of(link_status.faulty_links(facts, status)).count("FileScan") == 2
    assert plan_of(link_status.canonical_status(facts, status)).count("FileScan") == 2
    reciprocity = plan_of(hreflang.unreciprocated(facts))
    assert reciprocity.count("FileScan") == 2 and reciprocity.count("Join") <= 2
