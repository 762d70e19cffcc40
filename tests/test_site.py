"""Site passes, crawl expansion, sitemaps, fetch-log audits, sinks and streams."""

import gzip
import json
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from urllib.parse import urldefrag

import pytest
from pyspark.sql import functions as F

from crawlglass.operators import duplicates, edges, hreflang, link_status, skew, tally
from crawlglass.plans.crawl import crawl_expand, merge_seeds, page_links
from crawlglass.plans.page_audit import page_audit, page_facts
from crawlglass.plans.site_audit import audited_pages, site_audit
from crawlglass.schema import FETCH_LOG_SCHEMA, REPORT_FIELDS
from crawlglass.sinks import report as sinks
from crawlglass.sources import fetch_log, robots, sitemaps, url_list
from crawlglass.storage import materialize
from crawlglass.streaming import audit as streaming
from tests.helpers import by_seq, log, page


def doc(title="A page title here", h1="Heading", head="", body=""):
    return f"<html lang=en><head><title>{title}</title>{head}</head><body><h1>{h1}</h1>{body}</body></html>"


def alternates(*pairs):
    return "".join(f'<link rel="alternate" hreflang="{lang}" href="https://example.com{href}">' for lang, href in pairs)


def test_duplicates_and_salting(spark):
    rows = [page(i, doc(h1="Same" if i < 40 else f"own {i}")) for i in range(60)]
    facts = materialize(page_facts(log(spark, rows)), "t")
    candidates = duplicates.duplicate_candidates(facts)
    plain = {(r.crawl_seq, r.label, r.n) for r in duplicates.duplicate_members(candidates).collect()}
    salted = {(r.crawl_seq, r.label, r.n) for r in duplicates.duplicate_members(candidates, hot_rows=5).collect()}
    expected = {(i, "Duplicate H1", 40) for i in range(40)} | {(i, "Duplicate title", 60) for i in range(60)}
    assert plain == salted == expected


def test_join_unique_equals_plain_join(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, rng.choice([1, 1, 1, 2, 3, 4, 9])) for i in range(400)], "id int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in (1, 2, 3, 7)], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = Counter(map(tuple, left.join(right, "k", how).select("id", "k").collect()))
        for hot in (10, 10**6):
            counts = skew.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", hot)
            got = skew.join_unique(left, right, ["k"], spread="id", how=how, hot=counts)
            assert Counter(map(tuple, got.select("id", "k").collect())) == want, (how, hot)


def test_positions(spark):
    values = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(v, "a" if v % 3 else "b") for v in values], "v int, g string").repartition(7)
    ranked = {r.v: r.p for r in skew.with_position(df, ["v"], "p", "t").collect()}
    assert ranked == {v: i for i, v in enumerate(sorted(values))}
    grouped = {(r.g, r.v): r.p for r in skew.with_group_position(df, ["g"], ["v"], "p", "t").collect()}
    for g in "ab":
        members = sorted(v for v in values if ("a" if v % 3 else "b") == g)
        assert [grouped[g, v] for v in members] == list(range(len(members)))


def test_hreflang_reciprocity(spark):
    rows = [
        page(1, doc(head=alternates(("en", "/p1"), ("de", "/p2"))), final_url="https://example.com/p1"),
        page(2, doc(head=alternates(("de", "/p2"))), final_url="https://example.com/p2"),
        page(3, doc(head=alternates(("fr", "/nowhere"))), final_url="https://example.com/p3"),
        page(4, doc(head=alternates(("x-default", "/p2"))), final_url="https://example.com/p4"),
        page(5, doc(head=alternates(("en", "/p6"))), final_url="https://example.com/p5"),
        page(6, doc(head=alternates(("x-default", "/p5/"))), final_url="https://example.com/p6"),
        page(7, doc(head=alternates(("en", "/p8"))), final_url="https://example.com/p7"),
        page(8, doc(head=alternates(("en", "/p7"))), final_url="https://example.com/p8"),
        page(9, doc(), url="https://example.com/q", final_url="https://example.com/p8/"),
    ]
    facts = materialize(page_facts(log(spark, rows)), "t")
    found = {r.crawl_seq: r.href for r in hreflang.unreciprocated(facts).collect()}
    # 9 is the last page collected under p8, and it points nowhere
    assert found == {1: "https://example.com/p2", 7: "https://example.com/p8"}


def test_link_and_canonical_status(spark):
    links = '<a href="/ok">a b</a><a href="/dead">b c</a><a href="/moved">c d</a><a href="/dead">e f</a><a href="/gone">g h</a>'
    rows = [
        page(1, doc(head='<link rel="canonical" href="/dead">', body=links)),
        page(2, doc(head='<link rel="canonical" href="/moved/">')),
        page(3, doc(head='<link rel="canonical" href="/unknown">')),
    ]
    status = spark.createDataFrame(
        [("https://example.com/ok", 200, False), ("https://example.com/dead", 404, False),
         ("https://example.com/moved", 200, True), ("https://example.com/gone", -1, False)],
        "url string, status int, redirected boolean",
    )
    out = by_seq(audited_pages(log(spark, rows), status))
    assert [(l.url[-5:], l.status) for l in out[1].broken_links] == [("/dead", 404), ("/dead", 404), ("/gone", -1)]
    assert [l.url for l in out[1].redirecting_links] == ["https://example.com/moved"]
    assert out[1].issues[-5:] == [
        "Duplicate title (shared by 3 pages)", "Duplicate H1 (shared by 3 pages)", "3 broken link(s)",
        "1 redirecting link(s)", "Canonical target is unreachable (HTTP 404)",
    ]
    assert out[2].issues[-1] == "Canonical points to a redirect" and out[2].canonical_target_status == 200
    assert out[3].canonical_target_status == 0 and "Canonical target" not in " ".join(out[3].issues)
    assert site_audit(log(spark, rows), status).columns == REPORT_FIELDS


def test_tally_keys_and_ties(spark):
    rows = [(1, ["Multiple H1s (2)", "Canonical points elsewhere: x"]), (2, ["Multiple H1s (13)", "b", "a"]), (3, [])]
    df = spark.createDataFrame(rows, "crawl_seq int, issues array<string>")
    assert [tuple(r) for r in tally.top_issues(df).collect()] == [
        ("Multiple HNs (N)", 2), ("Canonical points elsewhere", 1), ("b", 1), ("a", 1)]


def _reference_walk(seed, links, cap, depth, allowed):
    """Plain breadth-first search with the same admission order."""
    visited, order, frontier = set(), [], [seed]
    for d in range(depth + 1):
        admitted = []
        for u in dict.fromkeys(frontier):
            if cap and len(order) >= cap:
                break
            if u not in visited and allowed(u):
                visited.add(u)
                admitted.append(u)
                order.append((u, d))
        frontier = [t for u in admitted for t in links.get(u, ())]
    return order


@pytest.mark.parametrize("cap", [0, 9, 25])
def test_crawl_expand_matches_breadth_first_search(spark, cap):
    rng = random.Random(cap)
    nodes = [f"https://{'www.' if i % 4 == 0 else ''}example.com/n{i}{'.pdf' if i % 9 == 8 else ''}" for i in range(40)]
    nodes += ["https://other.com/x"]
    links = {n: [rng.choice(nodes) for _ in range(rng.randint(0, 5))] for n in nodes}
    link_df = spark.createDataFrame([(n, i, t) for n, ts in links.items() for i, t in enumerate(ts)], "url string, pos int, target string")
    seeds = spark.createDataFrame([(nodes[0], nodes[0], 0)], "start_url string, url string, pos int")
    allowed = lambda u: "other.com" not in u and not u.endswith(".pdf")
    got = crawl_expand(seeds, link_df, max_pages=cap, max_depth=3).collect()
    want = _reference_walk(nodes[0], links, cap, 3, allowed)
    assert [(r.url, r.depth) for r in sorted(got, key=lambda r: (r.depth, r.path))] == want


def test_crawl_from_html_respects_robots(spark):
    from crawlglass.sources.robots import agent_policy

    rows = [
        page(1, doc(body='<a href="/a/">x</a><a href="/private/x">x</a><a href="https://www.example.com/w">x</a>'), url="https://example.com/"),
        page(2, doc(body='<a href="/b#f">x</a><a href="">self</a><a href="/file.PDF">x</a>'), url="https://example.com/a"),
    ]
    links = page_links(page_facts(log(spark, rows)))
    robots_txt = spark.createDataFrame([("example.com", 200, "User-agent: *\nDisallow: /private")], "host string, status int, text string")
    seeds = spark.createDataFrame([("https://example.com/", "https://example.com/", 0)], "start_url string, url string, pos int")
    got = crawl_expand(seeds, links, agent_policy(robots_txt, "bot"))
    assert {(r.url, r.depth) for r in got.collect()} == {
        ("https://example.com", 0), ("https://example.com/a", 1), ("https://www.example.com/w", 1), ("https://example.com/b", 2)}
    listed = crawl_expand(seeds.withColumn("url", F.lit("https://else.where/x.pdf")), links, list_only=True)
    assert [r.url for r in listed.collect()] == ["https://else.where/x.pdf"]


def test_merge_seeds_keeps_first_occurrence(spark):
    a = spark.createDataFrame([("https://e.com/", 0)], "url string, pos int")
    b = spark.createDataFrame([("https://e.com/b/#x", 0), ("", 1), ("https://e.com", 2), ("https://e.com/b", 3)], "url string, pos int")
    got = sorted(map(tuple, merge_seeds(a, b).collect()))
    assert got == [("https://e.com", 0, 0), ("https://e.com/b", 1, 0)]


def _xml(kind, locs):
    return f"<{kind}>" + "".join(f"<x><loc>\n {u} </loc></x>" for u in locs) + f"</{kind}>"


def test_sitemap_walk(spark):
    base = "https://example.com/"
    docs = {
        base + "sitemap.xml": _xml("sitemapindex", [base + "pages.xml", base + "blog.xml.gz", base + "sitemap.xml", base + "missing.xml"]),
        base + "pages.xml": _xml("urlset", [base + "a", base + "b?x=1&amp;y=2", "https://other.com/external", "ftp://x", base + "a/"]),
        base + "blog.xml.gz": _xml("urlset", [base + "blog/post-1", base + "a#f"]),
    }
    raw = [(u, 200, gzip.compress(t.encode()) if u.endswith(".gz") else t.encode()) for u, t in docs.items()]
    raw += [(base + "plain.gz", 200, b"not zipped \xff"), (base + "sniffed.xml", 200, gzip.compress(b"<urlset/>")), (base + "bad", 500, b"x")]
    read = sitemaps.sitemap_docs(spark.createDataFrame(raw, "sitemap_url string, status int, body binary"))
    texts = {r.sitemap_url: r.body for r in read.collect()}
    assert texts[base + "blog.xml.gz"] == docs[base + "blog.xml.gz"] and texts[base + "sniffed.xml"] == "<urlset/>"
    assert texts[base + "plain.gz"] == "not zipped �" and base + "bad" not in texts
    seeds = spark.createDataFrame([("example.com", base + "sitemap.xml", 0)], "site string, sitemap_url string, pos int")
    found = lambda **o: [r.url for r in sitemaps.sitemap_expand(seeds, read, **o).orderBy("level", "path").collect()]
    assert found() == [base + "a", base + "b?x=1&y=2", base + "blog/post-1"]
    assert found(max_urls=2) == [base + "a", base + "b?x=1&y=2"]
    assert found(max_sitemaps=2) == [base + "a", base + "b?x=1&y=2"]
    assert "https://other.com/external" in found(same_domain=False)
    walked = sitemaps.sitemap_walk(seeds, sitemaps.document_locations(read))
    assert [r.sitemap_url for r in walked.orderBy("level", "path").collect()] == [
        base + "sitemap.xml", base + "pages.xml", base + "blog.xml.gz", base + "missing.xml"]


def test_url_file(spark, tmp_path):
    f = tmp_path / "urls.txt"
    f.write_text("# seeds\nhttps://e.com/a \n\n  http://e.com/b\nexample.com/no-scheme\n")
    lines = url_list.read_url_file(spark, str(f))
    assert [r.url for r in url_list.listed_urls(lines).orderBy("pos").collect()] == ["https://e.com/a", "http://e.com/b"]
    assert [r.line for r in url_list.rejected_lines(lines).collect()] == ["example.com/no-scheme"]


def test_pacing_matches_a_plain_lag(spark):
    rng = random.Random(5)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(500):
        t += timedelta(seconds=rng.choice([0.1, 0.26, 5, 4000]))
        rows.append((f"u{i}", rng.choice(["hot", "hot", "cold"]), t))
    df = spark.createDataFrame(rows, "url string, host string, fetched_at timestamp")
    delays = spark.createDataFrame([("cold", 10.0)], "host string, crawl_delay double")
    got = {r.url: (r.gap_seconds, r.too_soon) for r in fetch_log.pacing_audit(df, delays).collect()}
    last = {}
    for url, host, at in sorted(rows, key=lambda r: (r[2], r[0])):
        gap = (at - last[host]).total_seconds() if host in last else None
        limit = 0.85 * (10.0 if host == "cold" else 0.3)
        assert got[url] == (pytest.approx(gap) if gap is not None else None, gap is not None and gap < limit)
        last[host] = at
    assert len(got) == len(rows)


def test_attempts_and_status_from_log(spark):
    base = datetime(2024, 1, 1)
    rows = [
        (1, "https://e.com/a", None, 503, [], 0, {}, None, None, base, 1, ""),
        (2, "https://e.com/a", None, 200, [301], 0, {}, "x", None, base + timedelta(1), 2, ""),
        (3, "https://e.com/b/#f", None, 0, [], 0, {}, None, "reset", base, 1, ""),
    ]
    df = spark.createDataFrame(rows, FETCH_LOG_SCHEMA)
    assert {tuple(r) for r in fetch_log.retry_rollup(df).collect()} == {("https://e.com/a", 200, 2, 1), ("https://e.com/b/#f", 0, 1, 0)}
    assert {r.crawl_seq for r in fetch_log.final_attempts(df).collect()} == {2, 3}
    assert {tuple(r) for r in fetch_log.link_status_from_log(df).collect()} == {("https://e.com/a", 200, True), ("https://e.com/b", -1, False)}
    numbered = fetch_log.assign_crawl_seq(df).orderBy("crawl_seq").collect()
    assert [r.url for r in numbered][0] == "https://e.com/a" and len({r.crawl_seq for r in numbered}) == 3


def test_sinks_round_trip(spark, tmp_path):
    rows = [page(1, doc(title='Quoted "title", ünïcode')), page(2, None, error="x")]
    report = materialize(site_audit(log(spark, rows)), "t")
    sinks.write_outputs(report, str(tmp_path / "out"))
    lines = [json.loads(l) for p in (tmp_path / "out.json").glob("part-*") for l in p.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 2 and all(list(l) == REPORT_FIELDS for l in lines)
    assert any("ünïcode" in l["title"] for l in lines)
    flat = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out.csv"))
    assert flat.columns == sinks.FLAT_COLUMNS and len(flat.columns) == 46
    assert {r.title for r in flat.collect()} == {'Quoted "title", ünïcode', None}
    parts = sinks.summary(report, order="url")
    assert tuple(parts["indexable"].first()) == (1, 2)
    assert [tuple(r) for r in parts["statuses"].collect()] == [(-1, 1), (200, 1)]
    assert [tuple(r) for r in parts["issues"].collect()] == [tuple(r) for r in tally.top_issues(report, order="url").collect()]
    empty = sinks.summary(report.limit(0), order="url")
    assert tuple(empty["indexable"].first()) == (0, 0) and empty["issues"].count() == 0


def _drain(stream, tmp_path, name):
    query = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [page(i, doc(h1=f"h{i}", head='<script type="application/ld+json">{"@type":"Article"}</script>'),
                 url=f"https://example.com/s{i % 5}/", at=base + timedelta(minutes=20 * i)) for i in range(12)]
    path = str(tmp_path / "in")
    log(spark, rows).repartition(3).write.parquet(path)
    read = lambda: streaming.read_fetch_stream(spark, path)
    streamed = _drain(streaming.stream_page_audit(read()), tmp_path, "audit")
    as_text = lambda df: Counter(df.select(F.to_json(F.struct(*df.columns)).alias("j")).toPandas()["j"])
    assert as_text(streamed) == as_text(page_audit(log(spark, rows)))
    assert _drain(streaming.stream_dedup(read(), "10 days"), tmp_path, "dedup").count() == 5
    tallied = _drain(streaming.stream_issue_tally(read(), "1 hour", "0 seconds"), tmp_path, "tallied").collect()
    by_window = defaultdict(int)
    for r in tallied:
        if r.issue == "Missing meta description":
            by_window[r.window_start] += r.n
    assert by_window and set(by_window.values()) == {3}


def test_live_tally_outlives_a_restart_and_counts_late_rows(spark, tmp_path):
    base, source, out = datetime(2024, 1, 5), str(tmp_path / "in"), str(tmp_path / "out")
    pages = [page(i, doc(h1=f"h{i}"), at=base + timedelta(minutes=25 * i)) for i in range(8)]
    late = [page(20 + i, doc(h1=f"l{i}"), at=base - timedelta(days=3)) for i in range(3)]
    changed = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        def run(wanted) -> None:
            """Until its batches are as wanted: by their input rows, and the counts that are not told yet."""
            told = streaming.stream_live_tally(streaming.read_fetch_stream(spark, source), wait_ms=10_000)
            query = (told.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
                     .trigger(processingTime="1 second").start())
            until = datetime.now() + timedelta(seconds=150)
            while datetime.now() < until and not query.awaitTermination(0.2):
                done = [(p["numInputRows"], sum(o["numRowsTotal"] for o in p["stateOperators"])) for p in query.recentProgress]
                if done and wanted(done):
                    return query.stop()
            raise AssertionError("the stream did not get there")

        log(spark, pages).coalesce(1).write.parquet(source)
        run(lambda done: done[-1][0] and done[-1][1])  # stopped with counts that are not told
        log(spark, late).coalesce(1).write.mode("append").parquet(source)
        run(lambda done: any(rows for rows, _ in done) and done[-1] == (0, 0))  # all is read, and nothing left in the state
        schema = "window_start timestamp, issue string, n bigint"
        told = {(r.window_start, r.issue): r[2] for r in spark.read.schema(schema).parquet(out).groupBy("window_start", "issue").agg(F.sum("n")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    issues = page_facts(log(spark, pages + late), keep=["fetched_at"]).select("fetched_at", F.explode("page_issues").alias("i"))
    key = [F.date_trunc("hour", "fetched_at").alias("w"), tally.issue_key(F.col("i.message")).alias("issue")]
    assert told == {(r.w, r.issue): r["count"] for r in issues.groupBy(*key).count().collect()}


def test_nothing_is_capped_unless_asked(spark):
    from crawlglass.plans.run import audit_run

    url = lambda i: f"https://example.com/p{i}"
    links = lambda i: "".join(f'<a href="/p{3 * i + k}">p</a>' for k in (1, 2, 3)) + f'<a href="/gone{i}">gone</a>'
    tree = [page(i, doc(body=links(i)), url=url(i)) for i in range(130)]
    fetched = log(spark, tree).drop("crawl_seq")
    found = audit_run(fetched, start_url=url(0)).select("url", "status_code", "indexability_reason").collect()
    assert {r.url for r in found} == {url(i) for i in range(391)} | {f"https://example.com/gone{i}" for i in range(130)}
    absent = [r for r in found if "gone" in r.url or int(r.url.rpartition("p")[2]) >= 130]
    assert absent and all((r.status_code, r.indexability_reason) == (-1, "request failed: not collected") for r in absent)
    capped = audit_run(fetched, start_url=url(0), max_pages=5).orderBy("crawl_seq").collect()
    assert [r.url for r in capped] == [url(0), url(1), url(2), url(3), "https://example.com/gone0"]
    assert {r.url for r in audit_run(fetched, start_url=url(0), max_depth=0).collect()} == {url(0)}


def test_one_key_for_each_page(spark):
    base = datetime(2024, 1, 1)
    rows = [
        page(1, doc(title="An earlier title"), url="https://example.com/a", at=base),
        page(1, doc(title="Shared page title"), url="https://example.com/a/", at=base + timedelta(1)),
        page(1, doc(title="Shared page title"), url="https://example.com/b", at=base),
        page(1, doc(title="Shared page title"), url="https://example.com/b", at=base),
    ]
    last = fetch_log.final_fetches(log(spark, rows))
    assert {(r.url, r.fetched_at) for r in last.collect()} == {("https://example.com/a/", base + timedelta(1)), ("https://example.com/b", base)}
    for numbered in (last.drop("crawl_seq"), last.withColumn("crawl_seq", F.lit(None).cast("bigint"))):
        report = site_audit(numbered)
        for r in report.collect():
            assert [i for i in r.issues if i.startswith("Duplicate title")] == ["Duplicate title (shared by 2 pages)"]
    with pytest.raises(ValueError):
        site_audit(log(spark, rows))
    with pytest.raises(ValueError):
        site_audit(last.withColumn("crawl_seq", F.when(F.col("url").endswith("b"), F.lit(1).cast("bigint"))))
    same_day = [page(1, "x", url="https://example.com/c", status=s, at=base + timedelta(d)) for d, s in ((0, 503), (1, 200))]
    attempts = fetch_log.final_attempts(log(spark, same_day)).collect()
    assert [r.status_code for r in attempts] == [200]
    assert fetch_log.retry_rollup(log(spark, same_day)).first().status_code == 200


def test_damaged_zips_and_stored_files(spark, tmp_path):
    whole = gzip.compress(b"<urlset><loc>https://e.com/z</loc></urlset>")
    broken = whole[:12] + b"\xff\xff\xff" + whole[15:]
    bodies = [("a.xml.gz", 200, whole), ("b.xml.gz", 200, whole[:20]), ("c.xml.gz", 200, broken), ("d.xml", 200, b"plain"), ("e.xml.gz", 200, None)]
    got = {r.sitemap_url: r.body for r in sitemaps.sitemap_docs(spark.createDataFrame(bodies, "sitemap_url string, status int, body binary")).collect()}
    assert "e.com/z" in got["a.xml.gz"] and got["d.xml"] == "plain" and got["e.xml.gz"] is None and len(got) == 5
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "s.xml.gz").write_bytes(whole)
    files = sitemaps.read_sitemap_files(spark, str(tmp_path / "maps"), "https://e.com/")
    assert [(r.sitemap_url, "e.com/z" in r.body) for r in sitemaps.sitemap_docs(files).collect()] == [("https://e.com/s.xml.gz", True)]
    (tmp_path / "robots").mkdir()
    (tmp_path / "robots" / "e.com.txt").write_text("User-agent: *\nDisallow: /x\n")
    stored = robots.read_robots_files(spark, str(tmp_path / "robots"))
    assert [(r.host, r.allow, r.path) for r in robots.robots_rules(stored).collect()] == [("e.com", False, "/x")]


def test_final_fetches_of_any_log(spark, tmp_path, monkeypatch):
    rng, base = random.Random(4), datetime(2024, 1, 1)
    rows = [page(i, f"text {i}", url=f"https://example.com/p{rng.randint(0, 30)}{rng.choice(['', '/', '#f'])}", status=rng.choice([200, 503]),
                 at=base + timedelta(days=rng.randint(0, 3))) for i in range(200)]
    want = {}
    for r in rows:
        key = urldefrag(r[1])[0].rstrip("/")
        want[key] = max(want.get(key, ()), (r[9], r[10], r[3], r[1]))
    table = log(spark, rows)
    table.repartition(5).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    some = lambda df: Counter((r.fetched_at, r.attempt, r.status_code, r.url) for r in df.collect())
    assert some(fetch_log.final_fetches(table)) == some(fetch_log.final_fetches(stored)) == Counter(want.values())
    assert some(fetch_log.final_fetches(stored.unionAll(stored))) == Counter(want.values())  # rows that repeat
    monkeypatch.setattr(fetch_log, "LOCATOR_BYTES", 9_000)  # a few bitmaps a scan
    assert some(fetch_log.final_fetches(stored.filter("status_code > 0"))) == Counter(want.values())
    assert fetch_log.final_fetches(stored.filter("url = 'x'")).count() == 0


def test_robots_index_finds_the_first_rule(spark):
    rng = random.Random(6)
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b", "/é", "/" + "x" * 40] + ["/" + "".join(rng.choice("ab/") for _ in range(rng.randint(1, 4))) for _ in range(20)]
    rules = {h: [(rng.random() < 0.4, rng.choice(paths[1:] if h != "h1" else paths)) for _ in range(n)] for h, n in (("h1", 30), ("h2", 5), ("h3", 1), ("h4", 0))}
    policy = spark.createDataFrame([(h, r) for h, r in rules.items()], "host string, rules array<struct<allow:boolean,path:string>>")
    tried = [(h, f"https://{h}/" + "".join(rng.choice("ab/x") for _ in range(rng.randint(0, 6)))) for h in [*rules, "h5"] for _ in range(40)]
    got = {(r.host, r.url): r.allowed for r in robots.with_robots_decision(spark.createDataFrame(tried, "host string, url string"), policy).collect()}
    for host, url in tried:
        path = url.removeprefix(f"https://{host}") or "/"
        first = next((allow for allow, start in rules.get(host, ()) if path.startswith(start)), True)
        assert got[host, url] == first, (host, url)


def test_zipped_sitemaps_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sitemaps, "ZIPPED_CHUNK", 7)
    monkeypatch.setattr(sitemaps, "CHUNK", 11)
    pages_ = b"<urlset>" + b"".join(b"<url><LOC>\n https://e.com/%d?a=1&amp;b=\xc3\xa9 </loc></url>" % i for i in range(50)) + b"<loc>open</urlset>"
    index = b"<x><sitemapIndex><loc>https://e.com/m.xml</loc></sitemapIndex>"
    both = gzip.compress(pages_[:300]) + gzip.compress(pages_[300:]) + b"\0\0"  # two members, padded
    damaged = bytearray(gzip.compress(pages_))
    damaged[60] ^= 255
    bodies = {"a.gz": gzip.compress(pages_), "two.xml": both, "i.gz": gzip.compress(index), "cut.gz": gzip.compress(pages_)[:-9], "bad.gz": bytes(damaged),
              "junk.gz": gzip.compress(pages_) + b"x", "text.gz": pages_, "p.xml": pages_, "empty.gz": b"", "null.gz": None}
    fetched = spark.createDataFrame([(u, 200, b) for u, b in bodies.items()] + [("no.xml", 404, pages_)], "sitemap_url string, status int, body binary")
    rows = lambda edges_: Counter((r.sitemap_url, r.is_index, r.pos, r["loc"]) for r in edges_.rows.collect())
    chunked, whole = rows(sitemaps.document_locations(fetched)), rows(sitemaps.document_locations(sitemaps.sitemap_docs(fetched)))
    assert chunked == whole
    assert {u for u, _, _, _ in whole} == {"a.gz", "two.xml", "i.gz", "text.gz", "p.xml"} and ("i.gz", True, 0, "https://e.com/m.xml") in whole
    assert max(map(len, sitemaps.unzip_chunks(gzip.compress(bytes(10_000))))) <= 11


def test_the_latest_robots_text_counts(spark):
    rows = [("e.com", 200, "User-agent: *\nDisallow: /old", 1), ("e.com", 200, "User-agent: *\nDisallow: /new", 2), ("e.com", 500, "", 3)]
    table = spark.createDataFrame(rows, "host string, status int, text string, fetched_at int")
    assert [r.path for r in robots.robots_rules(table).collect()] == ["/new"]


def test_edges_of_two_frequent_sides(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(25)] + [("a", 0), ("b", 1)], "url string, pos int")
    starts = spark.createDataFrame([("hot", f"s{i}") for i in range(7)] + [("a", "s"), ("z", "s")], "url string, site string")
    stored = edges.store_edges(rows, "url", "t", piece=4)
    got = Counter((r.url, r.pos, r.site) for r in stored.follow(starts).collect())
    assert [tuple(r) for r in stored.hubs.collect()] == [("hot", 7)]
    assert sum(got.values()) == sum(r[1] for r in stored.follow(starts, "pos < 3").groupBy("url").count().collect()) + 22 * 7
    assert got == Counter([("hot", i, f"s{j}") for i in range(25) for j in range(7)] + [("a", 0, "s")])


def test_intermediate_tables_can_be_removed(spark):
    from crawlglass.storage import remove_run, run_dir

    kept = materialize(spark.range(3), "t")
    assert kept.count() == 3 and os.path.isdir(run_dir(spark))
    remove_run(spark)
    assert not os.path.exists(run_dir(spark))


def test_complete_run(spark):
    from crawlglass.plans.run import audit_run

    home, a, b = "https://www.example.com/", "https://example.com/a", "https://example.com/b"
    rows = [
        page(10, doc(title="Home page title", body='<a href="https://example.com/a">to a</a><a href="/private/x">secret</a>'), url=home),
        page(11, doc(title="Shared page title", body='<a href="/b">to b</a>'), url=a),
        page(12, doc(title="Shared page title"), url=b),
        page(13, doc(title="Unlinked page here"), url="https://example.com/unlinked"),
        page(14, doc(title="Private page here"), url="https://www.example.com/private/x"),
        page(15, doc(title="Elsewhere"), url="https://other.com/"),
    ]
    fetched = log(spark, rows)
    robots_txt = spark.createDataFrame(
        [("www.example.com", 200, "User-agent: *\nDisallow: /private\nSitemap: https://www.example.com/s.xml")], "host string, status int, text string")
    docs = spark.createDataFrame([("https://www.example.com/s.xml", "<urlset><loc>https://example.com/unlinked</loc></urlset>")], "sitemap_url string, body string")
    run = lambda **o: {r.crawl_seq: (r.url, r.issues) for r in audit_run(fetched, robots_txt=robots_txt, sitemap_docs=docs, **o).collect()}
    # the link from /a resolves to example.com/b
    out = run(start_url=home)
    assert [out[i][0] for i in range(3)] == [home, a, b] and len(out) == 3
    assert "Duplicate title (shared by 2 pages)" in out[1][1] and "Duplicate title (shared by 2 pages)" not in out[0][1]
    assert [out[i][0] for out in [run(start_url=home, max_pages=2)] for i in sorted(out)] == [home, a]
    with_map = run(start_url=home, from_sitemap="auto")
    assert with_map[1][0] == "https://example.com/unlinked" and len(with_map) == 4
    lines = spark.createDataFrame([(0, "# x"), (1, "https://other.com/"), (2, b)], "pos int, line string")
    assert {u for u, _ in run(url_lines=lines, list_only=True).values()} == {"https://other.com/", b}
    assert len(run(start_url=home, respect_robots=False)) == 4
    for bad in ({}, {"start_url": "example.com"}, {"from_sitemap": "auto"}):
        with pytest.raises(ValueError):
            run(**bad)
