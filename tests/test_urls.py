"""URL functions against the standard library, and robots decisions against its parser."""

import itertools
import random
from urllib.parse import urldefrag, urljoin, urlparse
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from crawlglass.functions import urls
from crawlglass.sources import robots

BASES = [
    "https://e.com/a/b?x=1", "https://e.com/a/b", "https://e.com", "https://e.com/a/", "https://e.com/a;p",
    "https://e.com/a//b", "http://e.com/a", "http://e.com/a/b", "https://e.com/a/b?x", "", "https://e.com/a/b/../c",
]
REFS = [
    "?y=2", "../c", "../../../c/./d/", "c", "//o.com/z", "", "HTTPS://E.com/Q", "JavaScript:x", "#f", "d;q", "c d",
    "./", "https:rel", "http:rel", "/x/y", "/x/../y", "/..", "..", ".", "a//b", "/a//b", "https://h.com/a/../b?",
    "x?", "mailto:a@b", " /lead", "/tab\tbed", "?", "a/./b/../c?d=e#f", "http://user:pw@h:80/x", "ftp://e.com/x",
    "é/ü", "x/", "../", "/#top", "https://e.com/#", "//o.com", "tel:1",
]


def test_join_matches_stdlib(spark):
    pairs = list(itertools.product(BASES, REFS))
    df = spark.createDataFrame(pairs, "base string, ref string")
    rows = df.select("base", "ref", urls.join(F.col("base"), F.col("ref")).alias("got")).collect()
    wrong = [(r.base, r.ref, r.got, urljoin(r.base, r.ref)) for r in rows if r.got != urljoin(r.base, r.ref)]
    assert not wrong


def test_normalize_and_parts(spark):
    samples = BASES + REFS + ["https://WWW.E.com:80/a/#x", "https://e.com/?u=/", "HTTP://E.com/A/#b", "http://e.com///"]
    df = spark.createDataFrame([(s,) for s in samples], "u string")
    for r in df.select(
        "u", urls.normalize(F.col("u")).alias("n"), urls.netloc(F.col("u")).alias("h"),
        urls.root_host(urls.netloc(F.col("u"))).alias("r"),
    ).collect():
        assert r.n == urldefrag(r.u)[0].rstrip("/"), r
        if not any(c in r.u for c in "\t ") and r.u != "http:rel":
            host = urlparse(r.u).netloc
            assert r.h == host, r
            assert r.r == (host[4:] if host.lower().startswith("www.") else host)


def test_skip_extension(spark):
    cases = {
        "https://e.com/a.PDF": True, "https://e.com/a.pdf?x": True, "https://e.com/a?f=x.pdf": False,
        "https://e.com/a.jpeg": True, "https://e.com/a.html": False, "https://e.com/pdf": False, "https://e.com/x.woff2": True,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    for r in df.select("u", urls.has_skipped_extension(F.col("u")).alias("s")).collect():
        assert r.s == cases[r.u], r


def test_xml_unescape_is_sequential(spark):
    df = spark.createDataFrame([("&amp;lt;a&gt;&#39;&quot;",)], "u string")
    assert df.select(urls.xml_unescape(F.col("u"))).first()[0] == "<a>'\""


def _random_robots(rng):
    lines = []
    for _ in range(rng.randint(1, 14)):
        lines.append(
            rng.choice(
                [
                    "User-agent: *", "User-Agent: mozilla", "user-agent: Googlebot", "User-agent: zilla # c", "",
                    "", "Disallow: /a", "Disallow:", "Allow: /a/b", "Disallow: /", "Allow: /x?q=1", "Disallow: /x",
                    "Crawl-delay: 3", "crawl-delay: x", "Request-rate: 1/5", "# only comment", "   ", "Disallow: /%61",
                    "Sitemap: https://e.com/s.xml", "noise", "Disallow: /é", "Allow: *", "Disallow: /c d",
                ]
            )
        )
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_robots_match_stdlib(spark):
    rng = random.Random(7)
    texts = [(f"h{i}", 200, _random_robots(rng)) for i in range(300)] + [("gone", 404, "User-agent: *\nDisallow: /")]
    paths = ["", "/", "/a", "/a/b", "/a/bc", "/x?q=1", "/x?q=2", "/x", "/%61b", "/é", "/c d", "/c%20d?", "/+a"]
    txt = spark.createDataFrame(texts, "host string, status int, text string")
    urls_df = spark.createDataFrame([(h, f"https://{h}{p}") for h, _, _ in texts for p in paths], "host string, url string")
    for agent in ("Mozilla/5.0 (compatible; Googlebot/2.1)", "Googlebot"):
        policy = robots.agent_policy(txt, agent)
        got = {r.url: r.allowed for r in robots.with_robots_decision(urls_df, policy).collect()}
        delays = {r.host: r.crawl_delay for r in robots.crawl_delays(txt, agent).collect()}
        assert len(got) == len(texts) * len(paths)
        for host, status, text in texts:
            parser = RobotFileParser()
            parser.parse(text.splitlines() if status == 200 else [])
            for p in paths:
                url = f"https://{host}{p}"
                assert got[url] == parser.can_fetch(agent, url), (agent, url, text)
            assert delays.get(host) == (parser.crawl_delay(agent) or None), (agent, text)
