"""Queries over single functions and readers: stated inputs dealt to pages by id, results as text.

Each case is an input and what the function must make of it; the SQL holds the expected values, so
every query checks positive, negative and odd inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions import parsing, text, urls
from weblathe.functions.vocabulary import SIGNALS
from weblathe.operators import analysis, contracts, detectors, gates, jobs, observe
from weblathe.plans import captures, corpus, oracle, scan
from weblathe.sources import lists, sinks, snapshots
from weblathe.sources.shared import shared_folder

table = corpus.table
NOW = "2026-01-02 00:00:00"
ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: weblathe\nDisallow: /none"
OBSERVED = '{"value":1,"outcome":"observed","confidence":"confirmed","confidence_score":1.0,"method":"m"}'


def snapshot_text(observation: str = OBSERVED, version: str = "0.2.0", more: str = "", count: str = "1") -> str:
    """A snapshot document with one observation."""
    return (
        f'{{"schema_version":"{version}","run_id":"r","domain":"d.example","origin":"https://d.example","started_at":"2026-01-01T00:00:00Z","completed_at":"2026-01-01T00:01:00Z",'
        f'"collector_version":"1","request_count":{count},"observations":{{"human.paywall_detected":{observation}}},"requests":[]{more}}}'
    )


Case = tuple[str | None, str | None]
CASES: dict[str, tuple[Callable[[Column], Column], tuple[Case, ...]]] = {
    "squeezed_text": (lambda c: text.squeeze(c, 10), (("  a  b\n c ", "a b c"), ("   ", None), ("abcdefghijklmnop", "abcdefghij"), ("x\ty", "x y"))),
    "link_markers": (
        lambda c: F.concat_ws(",", *(F.when(text.has_marker(c, m), F.lit(m)) for m in ("terms", "log-in", "sign-up"))),
        (("/Terms", "terms"), ("/termsheet", ""), ("/blog-index", "log-in"), ("/design-update", "sign-up"), ("log in, terms", "terms,log-in")),
    ),
    "bounded_markers": (lambda c: text.has_bounded_marker(c, "cookie-banner").cast("string"), (("x-cookie-banner", "true"), ("cookie-banners", "false"), ("cookie-banner", "true"), ("my-cookie-banner-box", "true"))),
    "policy_link_scores": (lambda c: text.policy_score(c).cast("string"), (("/ai-policy", "120"), ("terms of use", "110"), ("/aup", "105"), ("terms", "90"), ("legal notice", "70"), ("about us", "0"))),
    "economic_link_scores": (
        lambda c: text.economic_score(c).cast("string"),
        (("api pricing", "120"), ("plans for the api", "105"), ("/plans", "100"), ("registration requirements", "90"), ("/api-docs", "70"), ("developers", "50"), ("contact", "0")),
    ),
    "report_cells": (
        lambda c: text.display_cell(F.nullif(F.substring_index(c, "|", 1), F.lit("")), F.substring_index(c, "|", -1)),
        (("collected|12", "12"), ("collected|" + "x" * 50, "x" * 37 + "..."), ("no_evidence|null", "no evidence"), ("|", "—"), ("collected|" + "y" * 40, "y" * 40)),
    ),
    "error_cells": (lambda c: text.error_cell(F.split(c, ";")), (("a;b", "a; b"), ("a|b", "a\\|b"), ("z" * 90, "z" * 77 + "..."))),
    "retry_after_seconds": (
        lambda c: text.retry_after(c, F.to_timestamp(F.lit(NOW))).cast("int").cast("string"),
        (("120", "120"), ("+5", "5"), ("-1", None), ("Fri, 02 Jan 2026 00:00:10 GMT", "10"), ("Thu, 01 Jan 2026 00:00:00 GMT", "0"), ("soon", None)),
    ),
    "text_types": (lambda c: text.is_text_type(c).cast("string"), (("text/html; charset=utf-8", "true"), ("APPLICATION/XHTML+XML", "true"), ("text/plain", "true"), ("application/pdf", "false"), (None, None))),
    "issuer_names": (lambda c: text.distinguished_name(F.transform(F.split(c, ";"), lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"), F.substring_index(p, ":", -1).alias("value")))), (("O:Ca;C:SE", "O=Ca, C=SE"), ("CN:x", "CN=x"))),
    "host_names": (
        lambda c: parsing.canonical_host(c),
        (("WWW.Example.com.", "www.example.com"), ("bücher.example", "xn--bcher-kva.example"), ("a_b.example", None), ("-x.example", None), (" h.example ", "h.example"), ("", None)),
    ),
    "registrable_domains": (
        lambda c: urls.registrable_domain(c),
        (("news.bbc.co.uk", "bbc.co.uk"), ("www.example.com", "example.com"), ("project.github.io", "project.github.io"), ("github.io", None), ("127.0.0.1", None), ("localhost", None)),
    ),
    "politeness_keys": (lambda c: urls.politeness_key(c), (("a.b.example.com", "example.com"), ("localhost", "localhost"), ("co.uk", "co.uk"))),
    "targets": (
        lambda c: urls.normalized_target(c),
        (("example.com", "https://example.com"), ("http://Example.com:8080/a?b", "http://example.com:8080"), ("ftp://example.com", None), ("https://u:p@example.com", None), ("https://a_b.example", None)),
    ),
    "same_sites": (lambda c: urls.same_site(F.substring_index(c, " ", 1), F.substring_index(c, " ", -1)).cast("string"), (("a.example.com b.example.com", "true"), ("a.co.uk b.co.uk", "false"), ("localhost localhost", "true"))),
    "public_addresses": (lambda c: parsing.is_public_address(c).cast("string"), (("8.8.8.8", "true"), ("10.0.0.1", "false"), ("127.0.0.1", "false"), ("::1", "false"), ("224.0.0.1", "false"), ("name", None))),
    "public_urls": (
        lambda c: urls.is_public_url(F.substring_index(c, " ", 1), F.transform(F.array(F.substring_index(c, " ", -1)), lambda x: x == "public")).cast("string"),
        (("https://a.example/ public", "true"), ("https://a.example/ private", "false"), ("https://u@a.example/ public", "false"), ("http://a.example:8080/ public", "false"), ("http://a.example:80/ public", "true"), ("https://localhost/ public", "false"), ("ftp://a.example/ public", "false")),
    ),
    "joined_urls": (
        lambda c: parsing.join_url(F.lit("https://a.example/x/y"), c),
        (("../z", "https://a.example/z"), ("//b.example/q", "https://b.example/q"), ("javascript:1", None), ("https://u@b.example/", None), ("?p=1", "https://a.example/x/y?p=1")),
    ),
    "canonical_values": (lambda c: parsing.canonical_json(c), (('{"b": 1, "a": [1.0, "é"]}', '{"a":[1.0,"\\u00e9"],"b":1}'), ("[ ]", "[]"), ("1.50", "1.5"), (None, None))),
    "linked_data_facts": (
        lambda c: F.to_json(parsing.linked_data(F.array(c))),
        (
            ('{"@type":["B","A"],"isAccessibleForFree":"False"}', '{"parsed":true,"types":["A","B"],"licences":[],"free":[false],"subscription":[]}'),
            ('[{"license":{"url":"https://l.example"}},{"hasPart":{"requiresSubscription":{"@type":"M"}}}]', '{"parsed":true,"types":["M"],"licences":["https://l.example"],"free":[],"subscription":[true]}'),
            ("{not json", '{"parsed":false,"types":[],"licences":[],"free":[],"subscription":[]}'),
        ),
    ),
    "robots_rules": (
        lambda c: parsing.can_fetch(F.lit(ROBOTS), F.substring_index(c, " ", 1), F.substring_index(c, " ", -1)).cast("string"),
        (
            ("https://a.example/private/x other", "false"), ("https://a.example/private/open/x other", "true"), ("https://a.example/f.pdf other", "false"), ("https://a.example/f.pdf?x other", "true"),
            ("https://a.example/private weblathe", "true"), ("https://a.example/none weblathe/1.0", "false"), ("https://a.example/robots.txt other", "true"),
        ),
    ),
    "conditional_headers": (
        lambda c: gates.conditional_header_ok(F.substring_index(c, "=", 1), F.substring_index(c, "=", -1)).cast("string"),
        (("If-None-Match=x", "true"), ("if-modified-since=Thu", "true"), ("cookie=a", "false"), ("if-none-match=a\nb", "false"), ("if-none-match=" + "e" * 4097, "false")),
    ),
    "snapshot_problems": (
        lambda c: snapshots.snapshot_problem(c),
        (
            (snapshot_text(), None),
            ("[1]", "the document is no JSON object"),
            (snapshot_text(more=',"extra":1'), "snapshot has unknown fields ['extra']"),
            (snapshot_text(OBSERVED.replace('"observed"', '"error"')), "outcome and confidence disagree"),
            (snapshot_text(OBSERVED.replace("1.0", "1.5")), "confidence_score out of range"),
            (snapshot_text('{"value":null,"confidence":"unknown","confidence_score":0,"method":"m"}', "0.1.0"), None),
            (snapshot_text('{"value":null,"confidence":"odd","confidence_score":0,"method":"m"}', "0.1.0"), "a 0.1.0 observation has no confidence that tells its outcome"),
            (snapshot_text(version="9"), "unsupported schema version"),
            (snapshot_text(count="-1"), "request_count must not be negative"),
        ),
    ),
}


def case_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    function, cases = CASES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        given = F.element_at(F.array(*(F.lit(c[0]).cast("string") for c in cases)), (F.col("page_id") % len(cases) + 1).cast("int"))
        return table(spark, d, "pages").select("page_id", given.alias("given")).select("page_id", function(F.col("given")).alias("result"))

    run.__name__ = name
    return run


def case_sql(name: str) -> str:
    values = ", ".join("null" if want is None else captures.quoted(want) for _, want in CASES[name][1])
    return f"select page_id, cast([{values}][page_id % {len(CASES[name][1])} + 1] as varchar) as result from pages"


# Readers and writers, through files in the shared folder


def file_of(spark: SparkSession, content: str) -> str:
    """A new text file with this content."""
    path = f"{shared_folder(spark)}/text"
    spark.range(1).select(F.lit(content).alias("value")).coalesce(1).write.text(path)
    return path


def target_list(spark, d):
    return lists.read_targets(spark, file_of(spark, "b.example # note\n\n# all\nhttps://www.a.example/x\nb.example\nftp://x")).select("position", "target", "origin", "registrable_domain")


def cease_list(spark, d):
    return lists.read_cease_list(spark, file_of(spark, "A.example\n*.b.example\nhttps://c.example\nd_.example # no")).select("line", "domain", "problem")


def complaint_lines(spark, d):
    """Orders as complaints; those of a third of the customers lack fields, some lines are no JSON."""
    o = table(spark, d, "orders")
    line = F.when(F.col("o_orderkey") % 10 == 0, F.lit("{no json")).when(F.col("o_custkey") % 3 == 0, F.lit('{"domain":"a.example","status":"open"}')).otherwise(F.to_json(F.struct(*(F.lit("x").alias(c) for c in lists.COMPLAINT_FIELDS))))
    path = f"{shared_folder(spark)}/complaints"
    o.select(line.alias("value")).write.text(path)
    return lists.read_complaints(spark, path).groupBy(F.array_join("missing", ",").alias("missing"), "valid").agg(F.count("*").alias("n"))


def probing_file(spark, d):
    content = "Canonical: https://a.example/probing.txt\n# note\nContact: mailto:x@a.example\nContact: https://a.example\nExpires: 2001-01-01T00:00:00Z"
    return lists.probing_problems(spark, file_of(spark, content)).select(F.array_join("missing", ",").alias("missing"), F.array_join("repeated", ",").alias("repeated"), "expires_in_time")


def frame_rows(spark, d):
    """Customers as rows of a frame file with planted faults, written as CSV and read by the frame's reader."""
    n = F.col("c_custkey")
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))
    rows = table(spark, d, "customer").select(
        F.concat(F.lit("WWW."), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), pick(".example", ".co.uk", ".example", "_.example")).alias("domain"), pick(" l1", "l2", "").alias("source"), pick("Commerce", "news_media", "odd", "commerce", "commerce").alias("sector"),
        F.lit("europe").alias("geography"), F.lit(" head ").alias("popularity_band"), pick("true", "false", "true", "true", "false", "true", "maybe").alias("eligible"), F.when(n % 11 == 1, "dead").alias("exclusion_reason"),
    )
    path = f"{shared_folder(spark)}/frame"
    rows.write.option("header", True).csv(path)
    return lists.read_frame(spark, path).groupBy("sector", "eligible", "problem").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains"), F.max("source").alias("source"))


def event_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Events as snapshots: one for each user and day; a domain stands for a third of the users."""
    user = F.regexp_extract("domain", r"(\d+)", 1).cast("long")
    seen = corpus.analysis_observations(spark, d).withColumn("domain", F.concat(F.lit("h"), (user % 3).cast("string"), F.lit(".example")))
    evidence = F.array(F.struct(F.lit("https://h.example").alias("source_url"), F.to_timestamp("completed_at").alias("observed_at"), F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("content_sha256"), F.lit(None).cast("string").alias("note")))
    entry = F.struct("signal", F.struct("value_json", "outcome", "confidence", "confidence_score", "method", evidence.alias("evidence")))
    runs = seen.groupBy("run_id", "domain", "completed_at").agg(F.map_from_entries(F.collect_list(entry)).alias("observations"))
    done = F.to_timestamp("completed_at")
    return runs.select(
        F.lit("0.2.0").alias("schema_version"), "run_id", "domain", F.lit("https://h.example").alias("origin"), done.alias("started_at"), done.alias("completed_at"), F.lit("1").alias("collector_version"), F.size("observations").alias("request_count"),
        "observations", F.array().cast(f"array<{snapshots.REQUEST}>").alias("requests"), F.array().cast("array<struct<probe: string, message: string>>").alias("errors"),
    )


def snapshots_written_and_read(spark, d):
    """Snapshots written as documents, read back by the strict reader, as rows of runs."""
    root = f"{shared_folder(spark)}/snapshots"
    made = event_snapshots(spark, d)
    value = F.transform_values("observations", lambda _, o: F.struct(F.get_json_object(o["value_json"], "$.k").cast("int").alias("value"), o["outcome"].alias("outcome"), o["confidence"].alias("confidence"), o["confidence_score"].alias("confidence_score"), o["method"].alias("method")))
    text_ = F.to_json(F.struct(*(value.alias(c) if c == "observations" else F.col(c) for c in made.columns)), {"ignoreNullFields": "false"})
    files = made.select(F.col("run_id").alias("path"), text_.alias("text"))
    parsed = snapshots.parse_snapshots(files)
    snapshots.write_snapshots(parsed.where("problem is null").drop("problem", "path"), root)
    again = spark.read.option("recursiveFileLookup", True).text(root)
    runs = analysis.runs_of_snapshots(again.select(F.from_json("value", snapshots.SNAPSHOT).alias("s")).select("s.*"))
    return runs.select("run_id", "domain", corpus.stamp(F.col("completed_at")).alias("completed_at"), "http_requests", "browser_requests", "observed", "no_evidence", "skipped", "errors", "probe_errors")


def csv_lines(spark, d):
    """The lines of a CSV export."""
    path = f"{shared_folder(spark)}/csv"
    rows = table(spark, d, "nation").select("n_nationkey", F.col("n_name"), (F.col("n_nationkey") % 2 == 0).alias("even"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("region"))
    sinks.write_csv(rows.coalesce(1), path)
    return spark.read.text(path, lineSep="\r\n").select(F.col("value").alias("line"))


def manifest_domains(spark, d):
    """The domain list that a manifest holds."""
    path = f"{shared_folder(spark)}/manifest"
    selection = corpus.sample(spark, d)
    sinks.write_manifest(selection, corpus.frame_manifest(spark, d), path)
    return spark.read.text(f"{path}/domains").select(F.col("value").alias("domain"))


# Jobs, reports and assembly


def new_jobs(spark, d):
    """Events as targets of a run for each user: the first of each origin, numbered."""
    e = table(spark, d, "events")
    origin = F.concat(F.lit("https://o"), (F.col("event_id") % 17).cast("string"), F.lit(".example"))
    return jobs.create_jobs(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), origin.alias("origin"), origin.alias("registrable_domain"))).select("run_id", "ordinal", "origin", "status")


def progress_json(spark, d):
    return jobs.progress_lines(corpus.job_progress(spark, d).select("run_id", "total", "completed"))


def stop_control(spark, d):
    rows = table(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, "global_stop").otherwise("other").alias("name"), F.lit(" TRUE").alias("value"))
    return jobs.readiness(rows.withColumn("value", F.trim("value")))


def response_byte_caps(spark, d):
    """Line items as chunks of an order's responses; what is refused doesn't count."""
    chunks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("n")).agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    rows = chunks.withColumn("response", F.floor(F.col("n") / 3))
    return gates.byte_caps(rows, 100, 70).select("run_id", "n", "decision", "total_bytes", "within_cap")


def report_totals(spark, d):
    """Orders as scanned targets; those without a domain failed."""
    o = table(spark, d, "orders")
    runs = o.select(F.when(F.col("o_orderkey") % 7 != 0, F.lit("d")).alias("domain"), (F.col("o_custkey") % 9).alias("http_requests"), (F.col("o_orderkey") % 3).alias("probe_errors"))
    return analysis.run_totals(runs)


def failed_targets(spark, d):
    failures = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_name").alias("target"), F.lit("timeout").alias("message"))
    return analysis.failed_results(failures, contracts.signal_catalog(spark)).select("target", "signal", "outcome", "method")


def stratum_outcomes(spark, d):
    """Outcome shares by stratum and family of the observations of selected domains."""
    users = table(spark, d, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 150).cast("string")).alias("domain"), "c_custkey", "c_mktsegment")
    selection = users.groupBy("domain").agg(F.min_by("c_mktsegment", "c_custkey").alias("sector")).select("domain", "sector", F.lit("g").alias("geography"), F.lit("b").alias("popularity_band"), (F.length("domain") > 2).alias("selected"))
    return analysis.stratum_shares(corpus.analysis_observations(spark, d), selection)


def evidence_rows(spark, d):
    """Line items as attempts of an order's scan, as evidence; kept where the address is among the matched ones."""
    line = F.struct(
        F.concat(F.lit("https://a.example/"), F.col("l_linenumber").cast("string")).alias("requested_url"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("https://b.example/")).alias("final_url"), F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(200).alias("status_code"), F.col("l_returnflag").alias("content_sha256"),
    )
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("requests"))
    pieces = observe.matching_evidence(observe.request_evidence(F.col("requests")), F.array(F.lit("https://b.example/"), F.lit("https://a.example/1")))
    return grouped.select(F.col("l_orderkey").alias("run_id"), F.inline(pieces)).groupBy("run_id", "source_url", "http_status").agg(F.count("*").alias("n"), F.max("content_sha256").alias("digest"))


def page_candidates(spark, d):
    """The best policy and economic link of pages with planted links."""
    links = ((2, "/terms", "Terms"), (3, "/legal", "Legal"), (5, "/use?x=1#top", "Terms of use"), (7, "https://other.example/terms", "Terms"), (4, "/pricing", "Pricing"), (6, "/about", "Our terms and prices"))
    n = F.col("page_id")
    body = F.concat(F.lit("<html><body>"), *(F.when(n % k == 0, F.lit(f'<a href="{href}">{label}</a>')).otherwise("") for k, href, label in links), F.lit("</body></html>"))
    pages = captures.page_fetches(spark, d).withColumns({"origin": F.lit("https://www.site.example/a"), "final_url": F.lit("https://www.site.example/a")})
    made = pages.withColumn("page_id", F.col("run_id").cast("long")).withColumn("body", body)
    return detectors.best_candidates(detectors.with_page_facts(made)).select("run_id", "url", "score", F.array_join("scope", ",").alias("scope"))


def scan_outcomes(spark, d):
    """Snapshots assembled from the name and address captures: outcomes of each run, counted in its map."""
    runs = table(spark, d, "pages").select(captures.id_text("page_id").alias("run_id"))
    whole = scan.assemble({"network": captures.network_rows(spark, d), "dns_metadata": captures.dns_rows(spark, d)}, runs)
    kinds = F.transform(F.map_values("observations"), lambda o: o["outcome"])
    count = lambda kind: F.size(F.filter(kinds, lambda o: o == kind)).alias(kind)
    return whole.select("run_id", F.size(kinds).alias("signals"), *(count(k) for k in ("observed", "no_evidence", "skipped", "error")))


def signal_registry(spark, d):
    return contracts.signal_catalog(spark).groupBy("family").agg(F.count("*").alias("signals"), F.min("ordinal").alias("first"))


PLAIN = (
    target_list, cease_list, complaint_lines, probing_file, frame_rows, snapshots_written_and_read, csv_lines, manifest_domains, new_jobs, progress_json, stop_control, response_byte_caps, report_totals, failed_targets,
    stratum_outcomes, evidence_rows, page_candidates, scan_outcomes, signal_registry,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: case_query(name) for name in CASES} | {f.__name__: f for f in PLAIN}

STRATA = """u as (select 'u' || (c_custkey % 150) as domain, c_custkey, c_mktsegment from customer), s as (select domain, arg_min(c_mktsegment, c_custkey) || '/g/b' as stratum from u where length(domain) > 2 group by domain)"""
FAULTS = """
f as (select c_custkey as n, c_custkey % 4 <> 3 as fine, trim([' l1', 'l2', ''][c_custkey % 3 + 1]) as source, lower(['Commerce', 'news_media', 'odd', 'commerce', 'commerce'][c_custkey % 5 + 1]) as sector,
        ['true', 'false', 'true', 'true', 'false', 'true', 'maybe'][c_custkey % 7 + 1] as e, c_custkey % 11 = 1 as r, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || case c_custkey % 4 when 1 then '.co.uk' else '.example' end as domain from customer),
p as (select *, case when not fine then 'no registrable domain' when source = '' then 'source is empty' when sector = 'odd' then 'unknown sector' when e = 'maybe' then 'eligible must be true or false' when e = 'true' and r then 'an eligible domain has an exclusion reason' when e = 'false' and not r then 'an ineligible domain needs an exclusion reason' end as problem from f)
"""

SQL: dict[str, str] = {name: case_sql(name) for name in CASES} | {
    "target_list": "select * from (values (0, 'b.example', 'https://b.example', 'b.example'), (3, 'https://www.a.example/x', 'https://www.a.example', 'a.example'), (5, 'ftp://x', null, null)) v(position, target, origin, registrable_domain)",
    "cease_list": "select * from (values ('A.example', 'a.example', null), ('*.b.example', null, 'give host names without scheme or wildcard'), ('https://c.example', null, 'give host names without scheme or wildcard'), ('d_.example', null, 'not a host name')) v(line, domain, problem)",
    "complaint_lines": "select case when o_orderkey % 10 = 0 then 'domain,received_at,reference,scope,status' when o_custkey % 3 = 0 then 'received_at,reference,scope' else '' end as missing, o_orderkey % 10 <> 0 and o_custkey % 3 <> 0 as valid, count(*) as n from orders group by all",
    "probing_file": "select 'Description,Preferred-Languages' as missing, 'Contact' as repeated, false as expires_in_time",
    "frame_rows": f"with {FAULTS} select sector, e = 'true' as eligible, problem, count(*) as n, count(distinct domain) filter (fine) as domains, nullif(max(source), '') as source from p group by all",
    "snapshots_written_and_read": f"with {oracle.OBS} select run_id, 'h' || (cast(substr(domain, 2) as bigint) % 3) || '.example' as domain, completed_at, cast(count(*) as integer) as http_requests, 0::bigint as browser_requests, {oracle.COUNTS.format('observed', 'errors')}, 0::bigint as probe_errors from obs group by run_id, domain, completed_at",
    "csv_lines": "select 'n_nationkey,n_name,even,region' as line union all select n_nationkey || ',' || n_name || ',' || case when n_nationkey % 2 = 0 then 'True' else 'False' end || ',' || coalesce(cast(case when n_regionkey > 1 then n_regionkey end as varchar), '') from nation",
    "manifest_domains": f"with {oracle.FRAME} select domain from smp where selected",
    "new_jobs": "with t as (select user_id as run_id, event_id % 17 as o, min(event_id) as position from events group by all) select run_id, cast(row_number() over (partition by run_id order by position) - 1 as integer) as ordinal, 'https://o' || o || '.example' as origin, 'pending' as status from t",
    "progress_json": f"with {oracle.JOBS} select '{{\"completed\":' || completed || ',\"run_id\":' || run_id || ',\"total\":' || total || '}}' as value from progress",
    "stop_control": "select true as control_present, true as stopped",
    "response_byte_caps": """with recursive r as (select l_orderkey as run_id, cast(l_linenumber as bigint) as n, l_linenumber // 3 as response, sum(cast(trunc(l_quantity) as bigint)) as b from lineitem group by all),
q as (select *, row_number() over (partition by run_id order by n) as rn from r),
f as (select distinct run_id, 0::bigint as rn, 0::bigint as n, null::varchar as decision, 0::bigint as response, 0::bigint as own, 0::bigint as total from r
 union all select run_id, rn, n, decision, response, case when decision = 'accepted' then own + b else own end, case when decision = 'accepted' then total + b else total end
 from (select *, case when own + b > 70 then 'response_cap' when total + b > 100 then 'total_cap' else 'accepted' end as decision from (select q.run_id, q.rn, q.n, q.response, q.b, f.total, case when q.response = f.response then f.own else 0 end as own from f join q on q.run_id = f.run_id and q.rn = f.rn + 1)))
select run_id, n, decision, total as total_bytes, decision = 'accepted' as within_cap from f where rn > 0""",
    "report_totals": "select count(*) as targets, cast(sum(o_custkey % 9) as bigint) as requests, count(*) filter (o_orderkey % 7 = 0) as failed, cast(sum(o_orderkey % 3) as bigint) as notes from orders",
    "failed_targets": f"select s_name as target, signal, 'error' as outcome, 'timeout' as method from supplier, (select unnest([{', '.join(map(captures.quoted, SIGNALS))}]) as signal) where s_suppkey % 10 = 0",
    "stratum_outcomes": f"with {oracle.OBS}, {STRATA}, g as (select stratum, split_part(signal, '.', 1) as family, outcome, count(*) as n from obs join s using (domain) group by all) select *, n / sum(n) over (partition by stratum, family) as share from g",
    "evidence_rows": "with r as (select l_orderkey as run_id, case when l_linenumber % 2 = 0 then 'https://b.example/' else 'https://a.example/' || l_linenumber end as source_url, l_returnflag as d from lineitem) select run_id, source_url, 200 as http_status, count(*) as n, max(d) as digest from r where source_url in ('https://b.example/', 'https://a.example/1') group by all",
    "page_candidates": """with p as (select cast(page_id as varchar) as run_id, page_id as n from pages), c as (
select run_id, 'https://www.site.example/use?x=1' as url, 'legal' as scope, 110 as score from p where n % 5 = 0 union all select run_id, 'https://www.site.example/terms', 'legal', 90 from p where n % 2 = 0
union all select run_id, 'https://www.site.example/about', 'legal', 90 from p where n % 6 = 0 union all select run_id, 'https://www.site.example/legal', 'legal', 70 from p where n % 3 = 0
union all select run_id, 'https://www.site.example/pricing', 'economic', 100 from p where n % 4 = 0 union all select run_id, 'https://www.site.example/about', 'economic', 100 from p where n % 6 = 0),
b as (select * from c qualify row_number() over (partition by run_id, scope order by score desc, url) = 1) select run_id, url, max(score) as score, string_agg(scope, ',' order by scope) as scope from b group by all""",
    "scan_outcomes": f"with o as ({captures.SQL['detect_dns']} union all {captures.SQL['detect_network']}) select run_id, cast(count(*) as integer) as signals, {', '.join(f"cast(count(*) filter (outcome = '{k}') as integer) as {k}" for k in ('observed', 'no_evidence', 'skipped', 'error'))} from o group by run_id",
    "signal_registry": f"select split_part(signal, '.', 1) as family, count(*) as signals, min(ordinal) as first from (select unnest([{', '.join(map(captures.quoted, SIGNALS))}]) as signal, cast(generate_subscripts([{', '.join(map(captures.quoted, SIGNALS))}], 1) - 1 as integer) as ordinal) group by all",
}
