"""robots.txt texts as a rules table, and the decision for a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crawlglass.functions import text as T, urls

# The line ends Python's str.splitlines() knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def read_robots_files(spark: SparkSession, path: str) -> DataFrame:
    """``(host, status, text)`` of stored robots.txt files, each named ``<host>.txt``."""
    files = spark.read.text(path, wholetext=True)
    file_name = T.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1))
    return files.select(F.regexp_replace(file_name, r"\.txt$", "").alias("host"), F.lit(200).alias("status"), F.col("value").alias("text"))


def _latest(robots_txt: DataFrame) -> DataFrame:
    """One text a host: the last fetched, where the table says so, then the greatest."""
    order = [F.col("fetched_at")] if "fetched_at" in robots_txt.columns else []
    return robots_txt.filter("status = 200").groupBy("host").agg(F.max_by("text", F.struct(*order, "text")).alias("text"))


def _lines(robots_txt: DataFrame) -> DataFrame:
    return _latest(robots_txt).select(
        "host", F.posexplode(F.split("text", LINE_END, -1)).alias("line_no", "line")
    )


def _without_empty_parts(path: Column) -> Column:
    return F.regexp_replace(path, r"\?(?=#|$)|#$", "")


def quoted_path(url: Column) -> Column:
    """Path, query and fragment in the form rule paths are compared in."""
    rest = F.regexp_extract(T.url_decode(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?(.*)$", 1)
    return urls.let(
        T.url_quote(_without_empty_parts(rest)), lambda p: F.when(p == "", F.lit("/")).otherwise(p)
    )


def directives(robots_txt: DataFrame) -> DataFrame:
    """``(host, line_no, field, value, group_id)`` of the lines that build rule groups.

    A group starts at a user-agent line that does not follow another one; a
    blank line ends it, and rules after that blank line belong to nothing.  The
    windows run over the lines of one document.
    """
    bare = F.split("line", "#", 2)[0]
    field = F.lower(T.strip(F.split(bare, ":", 2)[0]))
    value = T.url_decode(T.strip(F.get(F.split(bare, ":", 2), F.lit(1))))
    kind = (
        F.when(F.col("line") == "", "blank")
        .when(F.col("value").isNull(), None)
        .when(F.col("field") == "user-agent", "agent")
        .when(F.col("field").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    document = Window.partitionBy("host").orderBy("line_no")
    last_line = lambda k: F.max(F.when(F.col("kind") == k, F.col("line_no"))).over(document)
    return (
        _lines(robots_txt)
        .withColumns({"field": field, "value": value})
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .withColumn("previous", F.lag("kind").over(document))
        .withColumns(
            {
                "group_id": F.count_if(
                    (F.col("kind") == "agent") & ~F.col("previous").eqNullSafe("agent")
                ).over(document),
                "_agent_line": last_line("agent"),
                "_blank_line": F.coalesce(last_line("blank"), F.lit(-1)),
            }
        )
        .filter((F.col("kind") != "blank") & (F.col("_agent_line") > F.col("_blank_line")))
        .select("host", "line_no", "kind", "field", "value", "group_id")
    )


def rule_groups(robots_txt: DataFrame) -> DataFrame:
    """``(host, group_id, agents, rules, delay)``; groups without any rule line are dropped."""
    is_path = F.col("field").isin("allow", "disallow")
    allow = (F.col("field") == "allow") | (F.col("value") == "")
    rule = F.struct(
        "line_no", allow.alias("allow"), T.url_quote(_without_empty_parts(F.col("value"))).alias("path")
    )
    digits = F.when((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^\d+$"), F.col("value"))
    grouped = (
        directives(robots_txt)
        .groupBy("host", "group_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == "agent", F.struct("line_no", "value")))),
                lambda a: a.value,
            ).alias("agents"),
            F.array_sort(F.collect_list(F.when(is_path, rule))).alias("rules"),
            F.max_by(digits.try_cast("double"), F.when(digits.isNotNull(), F.col("line_no"))).alias("delay"),
            F.count_if(F.col("kind") == "rule").alias("n_rules"),
        )
    )
    return grouped.filter("n_rules > 0").drop("n_rules")


def robots_rules(robots_txt: DataFrame) -> DataFrame:
    """Long form: ``(host, group_id, agent, seq, allow, path)``."""
    return (
        rule_groups(robots_txt)
        .select("host", "group_id", F.explode("agents").alias("agent"), "rules")
        .select("host", "group_id", "agent", F.posexplode("rules").alias("seq", "rule"))
        .select("host", "group_id", "agent", "seq", "rule.allow", "rule.path")
    )


def agent_policy(robots_txt: DataFrame, agent: str) -> DataFrame:
    """The one group per host that applies to ``agent``: ``(host, rules, delay)``.

    Only the text before the first ``/`` of the agent counts; groups naming it
    come before the first ``*`` group.
    """
    token = F.lit(agent.split("/")[0].lower())
    is_default = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: F.contains(token, F.lower(a)))
    return (
        rule_groups(robots_txt)
        .filter(is_default | named)
        .groupBy("host")
        .agg(F.min_by(F.struct("rules", "delay"), F.struct(is_default, "group_id")).alias("g"))
        .select("host", "g.rules", "g.delay")
    )


def crawl_delays(robots_txt: DataFrame, agent: str) -> DataFrame:
    """``(host, crawl_delay)``; zero and absent delays are left out."""
    return (
        agent_policy(robots_txt, agent)
        .filter(F.col("delay") > 0)
        .select("host", F.col("delay").alias("crawl_delay"))
    )


def prefix_index(policy: DataFrame) -> DataFrame:
    """``(host, lengths, slots)`` of every host with rules: a hash table of its rule paths, and the lengths they have.

    A host with n rules has n slots; a path lies in the slot its hash names, so a look-up meets one or two paths.
    """
    n = F.size("rules")
    slot_of = lambda path: F.pmod(F.xxhash64(path), n)
    paths = F.transform("rules", lambda r, i: F.struct(slot_of(r.path).alias("slot"), F.struct(i.alias("seq"), r.allow.alias("allow"), r.path.alias("path")).alias("rule")))
    empty = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(i.alias("slot"), F.lit(None).cast("struct<seq:int,allow:boolean,path:string>").alias("rule")))
    # Dealt out by host once: both aggregates find it so.
    rows = policy.filter(n > 0).repartition("host").select("host", F.inline(F.concat(paths, empty)))
    slots = rows.groupBy("host", "slot").agg(
        F.collect_list("rule").alias("paths"), F.collect_set(F.length("rule.path")).alias("lengths")
    )
    return slots.groupBy("host").agg(
        F.array_distinct(F.flatten(F.collect_list("lengths"))).alias("lengths"),
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "paths"))), lambda s: s.paths).alias("slots"),
    )


def with_robots_decision(candidates: DataFrame, policy: DataFrame) -> DataFrame:
    """Add ``allowed`` to ``(host, url, …)``: the first rule whose path is a prefix decides.

    ``policy`` is :func:`agent_policy`, or its :func:`prefix_index`, which a host's URLs carry as one row.  A URL's
    prefixes of the lengths that rules have are looked up, so the work for a URL follows from these lengths and not
    from the number of rules, and no url-rule pairs are produced.
    """
    index = policy if "slots" in policy.columns else prefix_index(policy)

    def rules_at(path: Column, length: Column) -> Column:
        prefix = F.substring(path, F.lit(1), length)
        slot = F.get("slots", F.pmod(F.xxhash64(prefix), F.size("slots")).cast("int"))
        return F.filter(slot, lambda r: r.path == prefix)

    decision = urls.let(
        quoted_path(F.col("url")),
        lambda p: F.array_min(F.flatten(F.transform(
            F.filter("lengths", lambda n: n <= F.length(p)), lambda n: rules_at(p, n)
        ))).allow,
    )
    joined = candidates.join(index.select("host", "lengths", "slots"), "host", "left")
    return joined.withColumn("allowed", F.coalesce(decision, F.lit(True))).drop("lengths", "slots")


def robots_sitemaps(hosts: DataFrame, robots_txt: DataFrame) -> DataFrame:
    """Sitemap references of each ``(host, start_url)``, or its conventional location."""
    declared = (
        _lines(robots_txt)
        .filter(F.lower("line").startswith("sitemap:"))
        .select(
            "host", F.col("line_no").alias("pos"), T.strip(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1)).alias("sitemap_url")
        )
    )
    guessed = hosts.join(declared.select("host").distinct(), "host", "left_anti").select(
        "host", F.lit(0).alias("pos"), urls.join(F.col("start_url"), F.lit("/sitemap.xml")).alias("sitemap_url")
    )
    return declared.join(hosts.select("host").distinct(), "host", "left_semi").unionByName(guessed)
