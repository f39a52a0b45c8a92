"""Detector queries: pages, events and line items shaped into captures, then judged by the detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblathe.operators import detectors, gates, jobs

from .corpus import line_attempts, order_runs, page_hosts, table


def id_text(column: str, prefix: str = ""):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def event_responses(spark, d) -> DataFrame:
    """Events as homepage responses: status by type, headers and cookies by id."""
    status = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 302).when(F.col("event_type") == "signup", 401).when(F.col("event_type") == "purchase", 429).otherwise(503)
    n = F.col("event_id")
    header = lambda k, v: F.struct(F.lit(k).alias("k"), (v if isinstance(v, Column) else F.lit(v)).alias("v"))
    given = [F.when(n % k == r, header(name, value)) for name, k, r, value in HEADERS]
    pairs = F.array_compact(F.array(header("server", F.concat(F.lit("s"), (n % 5).cast("string"))), *given))
    cookies = F.array_compact(F.array(F.when(n % 6 == 0, F.lit("__cf_bm")), F.when(n % 10 == 0, F.lit("BIGipServerx")), F.when(n % 13 == 0, F.lit("datadome"))))
    attempts = F.array_compact(F.array(F.struct(status.alias("status_code")), F.when(n % 31 == 0, F.struct(F.lit(451).alias("status_code")))))
    return table(spark, d, "events").select(
        id_text("event_id").alias("run_id"), status.alias("status_code"), F.lit("HTTP/2").alias("http_version"), F.map_from_entries(pairs).alias("headers"), cookies.alias("cookie_names"),
        attempts.alias("attempts"), F.when(n % 11 == 0, "timeout").alias("error"), F.lit(True).alias("allowed"), F.lit("https://h.example/").alias("final_url"),
    )


# Headers of the made responses: name, value, and the ids that have it (id % k = r).
HEADERS = (
    ("alt-svc", 6, 1, "h3=:443"),
    ("cache-control", 2, 0, "no-store"),
    ("cf-mitigated", 17, 0, "challenge"),
    ("cf-ray", 3, 0, "8f0a-FRA"),
    ("content-encoding", 4, 1, "gzip"),
    ("content-type", 3, 1, "text/html"),
    ("www-authenticate", 29, 0, "Basic"),
    ("x-amz-cf-id", 4, 0, "1"),
    ("x-cache", 5, 0, "HIT"),
    ("x-frame-options", 7, 0, "DENY"),
    ("x-sucuri-block", 19, 0, "1"),
    ("x-wa-info", 23, 0, "1"),
)
# Markup put into pages: the ids that have it (id % k = r), and what.
HEAD = (
    (2, 1, '<script type="application/ld+json">{"@type":["NewsArticle","Article"],"isAccessibleForFree":"False","license":"https://l.example/x","requiresSubscription":true}</script>'),
    (22, 0, '<script type="application/ld+json">{"@type"</script>'),
    (3, 0, '<meta property="og:title" content="x">'),
    (4, 0, '<link rel="alternate" type="application/rss+xml" href="https://h.example/feed.xml">'),
    (5, 0, '<link rel="canonical" href="/own">'),
    (7, 0, '<meta name="generator" content="Gen  1">'),
    (8, 0, '<link rel="manifest" href="https://h.example/m.json">'),
    (10, 0, '<link rel="search" type="application/opensearchdescription+xml" href="https://h.example/os.xml">'),
    (6, 0, '<link rel="service-desc" type="application/openapi+json" href="https://h.example/openapi.json">'),
    (27, 0, '<link rel="license" href="https://l.example/y">'),
    (25, 0, '<script src="https://www.google.com/recaptcha/api.js"></script>'),
)
# Links of the body: (k, the part of the address after the host, text).
ANCHORS = (
    (11, "graphql", "Query"), (13, ".well-known/oauth-authorization-server", "Keys"), (14, "mcp", "Tools"), (15, "a2a", "Agents"), (16, ".well-known/agent-card.json", "Card"),
    (17, "api-docs", "Reference"), (18, "terms", "Rules"), (19, "licensing", "Reuse"), (20, "pricing", "Offers"), (21, "register", "Join"),
)
# Sentences of the body.
SAYINGS = (
    (3, "You may not scrape this site."), (4, "Content may not be used for machine learning."), (5, "Registration is required."), (7, "No account required."), (6, "Includes 100 requests per day."),
    (8, "API access costs $5 per month."), (10, "API access is free."),
)
BODY = (
    *((k, 0, f'<a href="https://h.example/{path}">{text}</a>') for k, path, text in ANCHORS),
    *((k, 0, f"<p>{text}</p>") for k, text in SAYINGS),
    (23, 0, '<div class="x piano-offer"></div>'),
    (24, 0, '<div id="onetrust-banner-sdk"></div>'),
    (26, 0, "<noscript>Please enable JavaScript.</noscript>"),
)


def page_fetches(spark, d) -> DataFrame:
    """Pages as homepage captures, with markup by id; every ninth was cut off."""
    n = F.col("page_id")
    put = lambda parts: F.concat(*(F.when(n % k == r, F.lit(markup)).otherwise("") for k, r, markup in parts))
    body = F.replace(F.replace("html", F.lit("</head>"), F.concat(put(HEAD), F.lit("</head>"))), F.lit("<article>"), F.concat(put(BODY), F.lit("<article>")))
    return table(spark, d, "pages").select(
        id_text("page_id").alias("run_id"), F.col("url").alias("origin"), F.col("url").alias("final_url"), F.col("url").alias("requested_url"), F.lit(200).alias("status_code"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), body.alias("body"), (n % 9 == 0).alias("truncated"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("allowed"),
    )


def told(observations: DataFrame) -> DataFrame:
    return observations.select("run_id", "signal", "outcome", "confidence", "confidence_score", "value_json")


def detect_response(spark, d):
    return told(detectors.response_signals(event_responses(spark, d)))


def detect_homepage(spark, d):
    return told(detectors.homepage_signals(event_responses(spark, d)))


def detect_attempts(spark, d):
    return told(detectors.attempt_signals(line_attempts(spark, d)))


def detect_metadata(spark, d):
    return told(detectors.metadata_signals(detectors.with_page_facts(page_fetches(spark, d))))


def detect_page_signals(spark, d):
    return told(detectors.page_signals(detectors.with_page_facts(page_fetches(spark, d))))


def detect_policy(spark, d):
    pages = detectors.with_page_facts(page_fetches(spark, d))
    texts = pages.select("run_id", F.lit(0).alias("position"), F.col("final_url").alias("source_url"), F.col("page.text").alias("text"))
    issues = pages.where("truncated").select("run_id", F.lit("economic.metering").alias("signal"), F.lit("error").alias("outcome"))
    return told(detectors.policy_signals(pages, texts, issues))


def detect_robots(spark, d):
    """robots.txt by page id: missing, forbidden, for all, or barring one agent."""
    n = F.col("page_id")
    site = F.when(n % 3 == 0, F.lit("\nSitemap: https://h.example/s.xml\nSitemap: https://h.example/a.xml")).otherwise("")
    body = F.when(n % 2 == 0, F.lit("User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nAllow: /\nCrawl-delay: 2")).otherwise(F.lit("User-agent: *\nDisallow: /"))
    rows = table(spark, d, "pages").select(id_text("page_id").alias("run_id"), F.when(n % 5 == 0, 404).when(n % 5 == 1, 403).otherwise(200).alias("status_code"), F.concat(body, site).alias("body"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"), F.lit("https://h.example/").alias("homepage_url"))
    return told(detectors.robots_signals(rows))


def detect_sitemap(spark, d):
    n = F.col("page_id")
    whole = lambda root, item: F.concat(F.lit(f"<{root}>"), F.repeat(F.lit(f"<{item}/>"), (n % 4).cast("int")), F.when(n % 3 == 0, F.lit("")).otherwise(F.lit(f"</{root}>")))
    body = F.when(n % 8 > 4, whole("sitemapindex", "sitemap")).otherwise(whole("urlset", "url"))
    rows = table(spark, d, "pages").select(id_text("page_id").alias("run_id"), F.when(n % 5 == 0, 404).otherwise(200).alias("status_code"), body.cast("binary").alias("body"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"), (n % 7 != 0).alias("allowed"))
    return told(detectors.sitemap_signals(rows))


def detect_llms_txt(spark, d):
    n = F.col("page_id")
    rows = table(spark, d, "pages").select(id_text("page_id").alias("run_id"), F.when(n % 3 == 0, 200).when(n % 3 == 1, 404).otherwise(500).alias("status_code"), F.lit(None).cast("string").alias("error"), (n % 7 != 0).alias("allowed"))
    return told(detectors.llms_signals(rows))


def dns_rows(spark, d) -> DataFrame:
    n = F.col("page_id")
    hosts = page_hosts(spark, d)
    name = F.when(n % 3 == 0, F.concat("host", F.lit(".edgekey.net."))).when(n % 3 == 1, F.concat("host", F.lit(".Fastly.net"))).when(n % 4 == 0, F.concat("host", F.lit(".github.io")))
    gate = n % 4 == 1
    return hosts.select(
        id_text("page_id").alias("run_id"), name.alias("canonical_name"), F.array(F.concat(F.lit("NS1."), F.when(n % 2 == 0, "awsdns-01.com").otherwise("cloudflare.com"), F.lit("."))).alias("nameservers"), F.when(n % 6 == 1, "NS0.Example.org.").alias("soa_primary"),
        F.when(gate, F.concat(F.lit("tollbit."), "host")).alias("tollbit_hostname"), F.when(gate, F.array(F.lit("NS"), F.lit("CNAME"))).when(n % 4 == 2, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>")).alias("tollbit_record_types"), F.when(gate, "gate.example").alias("tollbit_canonical_name"),
        F.when(n % 10 == 0, F.create_map(F.lit("nameservers"), F.lit("timeout"))).alias("errors"),
    )


def detect_dns(spark, d):
    return told(detectors.dns_signals(dns_rows(spark, d)))


def network_rows(spark, d) -> DataFrame:
    n = F.col("page_id")
    addresses = F.transform(F.sequence(F.lit(0), (n % 20).cast("int")), lambda i: F.struct(F.when(i % 2 == 0, "IPv4").otherwise("IPv6").alias("family"), F.concat(F.lit("a"), i.cast("string")).alias("address")))
    tls = F.struct(F.lit("TLSv1.3").alias("version"), F.lit("AES").alias("cipher_name"), F.lit("TLS").alias("cipher_protocol"), F.lit(256).alias("cipher_bits"), F.lit("x").alias("not_before"), F.lit("y").alias("not_after"), F.when(n % 4 == 0, "O=Ca").alias("issuer"), F.lit(True).alias("verified"))
    return table(spark, d, "pages").select(id_text("page_id").alias("run_id"), F.regexp_extract("url", "^(https?)", 1).alias("scheme"), F.when(n % 13 != 0, addresses).alias("addresses"), (n % 13 != 0).alias("safe"), F.when(n % 6 != 0, tls).alias("tls"))


def detect_network(spark, d):
    return told(detectors.network_signals(network_rows(spark, d)))


def detect_archive(spark, d):
    n = F.col("page_id")
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    body = F.when(n % 4 == 0, F.lit("[]")).when(n % 4 == 1, F.lit("This URL has been excluded")).when(n % 4 == 2, F.concat(F.lit('[["timestamp"],["202001'), day, F.lit('000000"],["20190101000000"]]'))).otherwise(F.lit('[["timestamp"],["bad"]]'))
    rows = table(spark, d, "pages").select(id_text("page_id").alias("run_id"), (n % 9 != 0).alias("enabled"), F.lit(200).alias("status_code"), body.alias("body"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"))
    return told(detectors.archive_signals(rows))


def detect_renderings(spark, d):
    n = F.col("page_id")
    shown = [F.when(n % k == 0, F.struct(F.lit(kind).alias("k"), F.array(F.lit(selector)).alias("v"))) for k, kind, selector in MARKERS]
    markers = F.map_from_entries(F.array_compact(F.array(*shown)))
    render = F.struct(
        F.col("url").alias("final_url"), F.lit(200).alias("status_code"), F.lit("t").alias("title"), F.length("html").alias("document_chars"), F.lit(10).alias("visible_text_chars"), markers.alias("markers"),
        (n % 30).cast("int").alias("request_count"), F.lit(1).alias("third_party_request_count"), F.lit(0).alias("blocked_request_count"), F.lit(900).cast("long").alias("total_response_bytes"),
    )
    rows = table(spark, d, "pages").select(id_text("page_id").alias("run_id"), (n % 5 != 0).alias("enabled"), F.lit(True).alias("allowed"), F.lit(True).alias("fetched"), F.when(n % 10 == 1, 403).otherwise(200).alias("status_code"), F.col("url").alias("final_url"), F.col("url").alias("requested_url"), F.lit(None).cast("string").alias("error"), F.left("html", F.lit(100)).alias("body"), F.when(n % 7 != 0, render).alias("render"))
    return told(detectors.browser_signals(rows))


MARKERS = ((2, "login", "#login"), (4, "paywall", ".piano-offer"), (3, "cookie_wall", "#consent"), (6, "captcha", ".g-recaptcha"))


def detect_cache(spark, d):
    docs = table(spark, d, "documents")
    n = F.col("doc_id")
    side = lambda status, text: F.struct(status.alias("status_code"), F.create_map(F.when(n % 3 == 0, "etag").when(n % 3 == 1, "last-modified").otherwise("age"), F.lit("1")).alias("headers"), F.sha2(text.cast("binary"), 256).alias("sha256"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"), F.lit("u").alias("final_url"))
    changed = F.when(n % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    rows = docs.select(id_text("doc_id").alias("run_id"), F.lit(True).alias("enabled"), F.lit(True).alias("allowed"), side(F.lit(200), F.col("text")).alias("base"), side(F.when(n % 5 == 0, 304).otherwise(200), changed).alias("repeat"))
    return told(detectors.cache_signals(rows))


def browser_gate(spark, d):
    """Events as a user's browser requests, in order: caps count only what was let through."""
    e = table(spark, d, "events")
    url = F.concat(F.lit("https://"), F.when(F.col("event_type") == "click", "cdn.other.example").otherwise("a.example"), F.lit("/"), F.col("event_id").cast("string"))
    cents = F.round(F.col("value") * 100).cast("long")
    rows = e.select(
        id_text("user_id", "u").alias("run_id"), F.col("event_id").alias("n"), F.lit("https://a.example/").alias("origin"), url.alias("url"), (cents % 5 == 0).alias("top_level"), (F.col("event_type") != "error").alias("permitted"),
        (cents % 7 != 0).alias("public"), F.when(F.col("value") > 90, 25.0).otherwise(1.0).alias("elapsed"),
    )
    return gates.browser_gate(rows, request_cap=20, third_party_cap=5).select("run_id", "n", "decision")


ATTEMPT_LIMITS = {"base": 2.0, "threshold": 2, "cooldown": 300.0, "max_wait": 5.0}


def attempt_circuits(spark, d):
    """Line items as attempts of runs (orders) at a supplier: budget, retries and redirects under the supplier's circuit."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"))
    status = F.when(F.col("flag") == "R", F.when(F.col("quantity") > 45, None).otherwise(503)).when(F.col("flag") == "A", 301).otherwise(200)
    after = F.when(F.col("quantity") % 3 == 0, F.col("quantity") / 3)
    rows = lines.select(
        id_text("l_suppkey", "s").alias("domain"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("run_id"), F.floor(F.col("n") / 4).alias("request"), "n",
        (F.col("l_orderkey") * 100 + F.col("n") * 3).cast("double").alias("at"), status.alias("status_code"), after.cast("double").alias("retry_after"),
    )
    return gates.attempt_log(rows, budget=3, redirects=1, **ATTEMPT_LIMITS)


def attempt_follow_ups(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("flag"))
    status = F.when(F.col("flag") == "R", 503).when(F.col("flag") == "A", 301).otherwise(200)
    rows = lines.select(id_text("l_orderkey").alias("run_id"), F.floor(F.col("n") / 4).alias("request"), "n", status.alias("status_code"), F.when(F.col("n") % 2 == 0, F.lit(9.0)).alias("retry_after"))
    return gates.attempt_outcomes(rows).select("run_id", "n", "follow")


def lease_log(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "release").when(F.col("event_type") == "click", "renew").otherwise("acquire")
    rows = e.select(id_text("user_id", "u").alias("run_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("n"), kind.alias("event"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("owner"))
    return gates.leases(rows, seconds=20_000.0)


def job_transitions(spark, d):
    """Open orders as running jobs; their results count only under a live lease of the owner."""
    o = table(spark, d, "orders").withColumn("run_id", F.col("o_custkey") % 10)
    running = F.when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    j = o.select("run_id", F.col("o_orderkey").alias("ordinal"), F.lit("o").alias("origin"), F.col("o_custkey").alias("registrable_domain"), running.alias("status"), F.lit(None).cast("double").alias("not_before"), F.lit(1).alias("request_count"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("notes"))
    kind = F.element_at(F.array(F.lit("completed"), F.lit("deferred"), F.lit("failed")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    results = o.where("o_orderkey % 2 = 0").select("run_id", F.col("o_orderkey").alias("ordinal"), kind.alias("result"), F.lit(4).alias("requests"), F.lit(77.0).alias("not_before"), F.lit("n").alias("notes"))
    return jobs.apply_results(j, order_runs(spark), results, "a", F.lit(50.0)).select("run_id", "ordinal", "status", "request_count")


QUERIES = {
    f.__name__: f
    for f in (
        detect_response, detect_homepage, detect_attempts, detect_metadata, detect_page_signals, detect_policy, detect_robots, detect_sitemap, detect_llms_txt, detect_dns, detect_network,
        detect_archive, detect_renderings, detect_cache, browser_gate, attempt_follow_ups, attempt_circuits, lease_log, job_transitions,
    )
}


def rows_sql(source: str, *parts: tuple[str, str, str, str, str]) -> str:
    """One select for each signal: (signal, outcome, confidence, score, value)."""
    return " union all ".join(f"select run_id, '{s}' as signal, {o} as outcome, {c} as confidence, cast({p} as double) as confidence_score, {v} as value_json from {source}" for s, o, c, p, v in parts)


def found(signal: str, there: str, value: str, sure: str = "confirmed", score: str = "1.0", broken: str = "false", why: str = "'error'", absent: str | None = None) -> tuple[str, str, str, str, str]:
    value = value if absent is None else f"case when {there} then {value} else {absent} end"
    return (
        signal,
        f"case when {broken} then {why} when {there} then 'observed' else 'no_evidence' end",
        f"case when {broken} then 'unknown' when {there} then '{sure}' else 'no_evidence' end",
        f"case when {broken} then 0.0 when {there} then {score} else 1.0 end",
        f"case when {broken} then 'null' else {value} end",
    )


EVENTS = "(select cast(event_id as varchar) as run_id, event_id as n, case event_type when 'view' then 200 when 'click' then 302 when 'signup' then 401 when 'purchase' then 429 else 503 end as s from events)"
PAGES = "(select cast(page_id as varchar) as run_id, page_id as n, html, url, page_id % 9 = 0 as cut, to_json(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))) as host, to_json(url) as u from pages)"
DOWN = "n % 11 = 0"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def if_(condition: str, text: str, other: str = "null") -> str:
    return f"case when {condition} then {quoted(text)} else {other} end"


def listed(*parts: str, opened: str = "[", closed: str = "]") -> str:
    """A JSON list (or map) of those parts that aren't null."""
    return f"'{opened}' || array_to_string(list_filter([{', '.join(parts)}], lambda x: x is not null), ',') || '{closed}'"


def names(*pairs: tuple[str, str]) -> str:
    return listed(*(if_(condition, f'"{name}"') for condition, name in pairs))


def mapped(*pairs: tuple[str, str, str]) -> str:
    return listed(*(if_(condition, f'"{key}":"{value}"') for condition, key, value in pairs), opened="{", closed="}")


def header_map(*only: str) -> str:
    every = [(f"n % {k} = {r}", name, value) for name, k, r, value in HEADERS if not only or name in only]
    parts = [if_(c, f'"{name}":"{value}"') for c, name, value in every]
    if not only:
        at = [name for _, name, _ in every].index("www-authenticate")
        parts.insert(at, "'\"server\":\"s' || (n % 5) || '\"'")
    return listed(*parts, opened="{", closed="}")


def any_(*numbers: int) -> str:
    return "(" + " or ".join(f"n % {k} = 0" for k in numbers) + ")"


LOCKED = "(s = 401 or n % 29 = 0)"
CDN = names(("n % 4 = 0", "amazon_cloudfront"), ("n % 3 = 0", "cloudflare"))
LIKELY, POSSIBLE = ("likely", "0.8"), ("possible", "0.6")


def page_found(signal: str, there: str, value: str, sure: str = "confirmed", score: str = "1.0", absent: str = "'null'") -> tuple[str, str, str, str, str]:
    """What a page says: absences of cut-off pages are errors without a value."""
    return found(signal, there, value, sure, score, f"cut and not ({there})", absent=absent)


def link_json(k: int, rel: str, tag: str, kind: str, path: str) -> str:
    return if_(f"n % {k} = 0", f'{{"rel":{rel},"tag":"{tag}","type":{kind},"url":"https://h.example/{path}"}}')


INTERFACES = [(6, '["service-desc"]', "link", '"application/openapi+json"', "openapi.json"), *((k, "[]", "a", "null", path) for k, path, _ in ANCHORS[:6])]


def interface(signal: str, *numbers: int) -> tuple[str, str, str, str, str]:
    urls = sorted((path, k) for k, *_, path in INTERFACES if k in numbers)
    return page_found(signal, any_(*numbers), names(*((f"n % {k} = 0", f"https://h.example/{path}") for path, k in urls)), *POSSIBLE, absent="'[]'")


def named_link(signal: str, k: int) -> tuple[str, str, str, str, str]:
    path, text = next((p, t) for n, p, t in ANCHORS if n == k)
    return page_found(signal, f"n % {k} = 0", quoted(f'[{{"text":"{text}","url":"https://h.example/{path}"}}]'), *POSSIBLE, absent="'[]'")


def detection(signal: str, there: str, markers: str, sure: str, score: str) -> tuple[str, str, str, str, str]:
    return page_found(signal, there, f"'{{\"detected\":true,\"markers\":' || {markers} || '}}'", sure, score)


def declared(signal: str, broken: str, *rules: tuple[str, str, str | None]) -> tuple[str, str, str, str, str]:
    """A list of declarations: (condition, rule, detail)."""
    parts = [f"case when {c} then '{{' || {quoted(f'"detail":"{detail}",' if detail else '')} || '\"rule\":\"{rule}\",\"source_url\":' || u || '}}' end" for c, rule, detail in rules]
    there = "(" + " or ".join(c for c, _, _ in rules) + ")"
    return found(signal, there, f"'{{\"declarations\":' || {listed(*parts)} || ',\"detected\":true}}'", broken=f"({broken}) and not {there}", absent="'null'")


ODD, PAID = "n % 2 = 1", "n % 2 = 1"
TITLE = "trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '\\s+', ' ', 'g'))"
BOTH = "(n % 5 = 0 and n % 7 = 0)"
AGENTS = ("amazonbot", "anthropic-ai", "bytespider", "ccbot", "chatgpt-user", "claude-web", "cohere-ai", "google-extended", "gptbot", "meta-externalagent", "perplexitybot")


def agent_policies(all_: str, gptbot: str) -> str:
    return quoted("{" + ",".join(f'"{a}":{gptbot if a == "gptbot" else all_}' for a in AGENTS) + "}")


def attempt_rate(code: int) -> str:
    return f"""select a.run_id, 'crawler.http_{code}_frequency' as signal, case when r.n is null then 'no_evidence' else 'observed' end as outcome, case when r.n is null then 'no_evidence' else 'confirmed' end as confidence, 1.0::double as confidence_score, case when r.n is null then 'null' else '{{"count":' || r.n_{code} || ',"rate":' || cast(r.n_{code}::double / r.n as varchar) || ',"response_count":' || r.n || '}}' end as value_json from (select distinct run_id from att) a left join r using (run_id)"""


SQL = {
    "detect_response": rows_sql(
        EVENTS,
        found("network.http_version", "true", "'\"HTTP/2\"'", broken=DOWN),
        found("infrastructure.response_headers", "true", header_map(), broken=DOWN),
        found("infrastructure.server_header", "true", "'\"s' || (n % 5) || '\"'", broken=DOWN),
        found("infrastructure.security_headers", "n % 7 = 0", "'[\"x-frame-options\"]'", broken=DOWN, absent="'[]'"),
        found("infrastructure.cache_headers", any_(2, 5), header_map("cache-control", "x-cache"), broken=DOWN, absent="'{}'"),
        found("infrastructure.cdn_hints", any_(3, 4), CDN, *LIKELY, DOWN),
        found("infrastructure.cdn", any_(3, 4), CDN, *LIKELY, DOWN),
        found("infrastructure.edge_response_hints", any_(3, 4, 17, 19, 23), names(("n % 4 = 0", "amazon_cloudfront"), (any_(3, 17), "cloudflare"), ("n % 23 = 0", "f5"), ("n % 19 = 0", "sucuri")), *LIKELY, DOWN),
        found("infrastructure.waf", any_(17, 19), names(("n % 17 = 0", "cloudflare"), ("n % 19 = 0", "sucuri")), *LIKELY, DOWN),
        found("infrastructure.challenge_response", any_(17, 19), if_("n % 17 = 0", '{"provider":"cloudflare","type":"challenge"}', quoted('{"provider":"sucuri","type":"block"}')), broken=DOWN, absent="'null'"),
        found("infrastructure.cache_status", "n % 5 = 0", "'[{\"provider\":\"' || case when n % 12 = 0 then 'unspecified' when n % 4 = 0 then 'amazon_cloudfront' when n % 3 = 0 then 'cloudflare' else 'unspecified' end || '\",\"status\":\"HIT\"}]'", broken=DOWN, absent="'[]'"),
        found("infrastructure.edge_location_hints", "n % 3 = 0", "'{\"cloudflare\":\"FRA\"}'", *LIKELY, DOWN, absent="'{}'"),
        found("infrastructure.http3_advertised", "n % 6 = 1", "'true'", broken=DOWN, absent="'null'"),
        found("infrastructure.content_encoding", "n % 4 = 1", "'\"gzip\"'", broken=DOWN, absent="'null'"),
        found("infrastructure.response_cookie_fingerprints", any_(6, 10, 13), names(("n % 6 = 0", "cloudflare:__cf_bm"), ("n % 13 = 0", "datadome:datadome"), ("n % 10 = 0", "f5:BIGipServer*")), *POSSIBLE, DOWN),
        found("infrastructure.bot_management_hints", any_(6, 13), names(("n % 6 = 0", "cloudflare"), ("n % 13 = 0", "datadome")), *POSSIBLE, DOWN),
        found("infrastructure.load_balancer_hints", "n % 10 = 0", names(("n % 10 = 0", "f5")), *POSSIBLE, DOWN),
        found("infrastructure.acceleration_hints", "n % 23 = 0", names(("n % 23 = 0", "f5_big_ip")), *LIKELY, DOWN),
        found("human.http_access_disposition", "true", "'\"' || case when s = 401 then 'authentication_required' when s = 429 then 'rate_limited' when s < 400 then 'reachable' else 'server_error' end || '\"'", broken=DOWN),
        found("human.authentication_challenge", LOCKED, "'true'", broken=DOWN, absent="'false'"),
        found("human.login_required", LOCKED, "'true'", broken=DOWN, absent="'null'"),
        found("human.rate_limited", "true", "case when s = 429 then 'true' else 'false' end", broken=DOWN),
        found("human.geographic_restriction", "n % 31 = 0", "'{\"detected\":true,\"status\":451}'", *POSSIBLE, DOWN, absent="'null'"),
        found("preservation.cache_header_hints", any_(2, 5), header_map("cache-control", "x-cache"), broken=DOWN, absent="'{}'"),
    ),
    "detect_homepage": rows_sql(
        EVENTS,
        found("human.homepage_accessible", "true", "case when s < 400 then 'true' else 'false' end", broken=DOWN),
        found("human.homepage_status", "true", "cast(s as varchar)", broken=DOWN),
        found("human.homepage_final_url", "true", "'\"https://h.example/\"'", broken=DOWN),
        found("human.homepage_content_type", "n % 3 = 1", "'\"text/html\"'", broken=DOWN, absent="'null'"),
    ),
    "detect_attempts": f"""with att as (select cast(l_orderkey as bigint) as run_id, case when l_returnflag = 'R' then case when l_linenumber = 1 then 403 else 429 end when l_linestatus = 'O' then 200 when l_linenumber > 2 then 404 end as s from lineitem),
g as (select run_id, s, count(*) as n from att where s is not null group by all), r as (select run_id, sum(n)::bigint as n, coalesce(sum(n) filter (s = 403), 0)::bigint as n_403, coalesce(sum(n) filter (s = 429), 0)::bigint as n_429, '{{' || string_agg('"' || s || '":' || n, ',' order by s) || '}}' as v from g group by run_id)
select a.run_id, 'crawler.http_status_distribution' as signal, case when v is null then 'no_evidence' else 'observed' end as outcome, case when v is null then 'no_evidence' else 'confirmed' end as confidence, 1.0::double as confidence_score, coalesce(v, 'null') as value_json from (select distinct run_id from att) a left join r using (run_id)
union all {attempt_rate(403)} union all {attempt_rate(429)}""",
    "detect_metadata": rows_sql(
        PAGES,
        page_found("metadata.json_ld", "(n % 2 = 1 or n % 22 = 0)", "'true'", absent="'false'"),
        (
            "metadata.json_ld_types", "case when n % 2 = 1 then 'observed' when n % 22 = 0 or cut then 'error' else 'no_evidence' end", "case when n % 2 = 1 then 'confirmed' when n % 22 = 0 or cut then 'unknown' else 'no_evidence' end",
            "case when n % 2 = 1 then 1.0 when n % 22 = 0 or cut then 0.0 else 1.0 end", "case when n % 2 = 1 then '[\"Article\",\"NewsArticle\"]' when cut and n % 22 <> 0 then 'null' else '[]' end",
        ),
        page_found("metadata.open_graph", "n % 3 = 0", "'true'", absent="'false'"),
        page_found("metadata.feeds", "n % 4 = 0", "'[\"https://h.example/feed.xml\"]'", absent="'[]'"),
        page_found("metadata.html_title", f"{TITLE} <> ''", f"to_json({TITLE})"),
        page_found("metadata.html_language", "true", "'\"' || regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) || '\"'"),
        page_found("metadata.canonical_url", "n % 5 = 0", "to_json(regexp_extract(url, '^https?://[^/?#]+') || '/own')"),
        page_found("metadata.generator", "n % 7 = 0", "'\"Gen 1\"'"),
        page_found("metadata.web_manifest_url", "n % 8 = 0", "'\"https://h.example/m.json\"'"),
        page_found("metadata.opensearch_url", "n % 10 = 0", "'\"https://h.example/os.xml\"'"),
        page_found("agent.interface_links", any_(6, 11, 13, 14, 15, 16, 17), listed(*(link_json(*link) for link in INTERFACES)), *POSSIBLE, absent="'[]'"),
        interface("agent.openapi", 6),
        interface("agent.graphql", 11),
        interface("agent.oauth_metadata", 13),
        interface("agent.mcp", 14),
        interface("agent.a2a", 15),
        interface("agent.agent_card", 16),
        interface("agent.api_documentation", 6, 17),
        named_link("legal.policy_links", 18),
        named_link("legal.license_links", 19),
        named_link("economic.pricing_links", 20),
        named_link("economic.registration_links", 21),
    ),
    "detect_page_signals": rows_sql(
        PAGES,
        detection("human.paywall_detected", f"({ODD} or n % 23 = 0)", names(("n % 23 = 0", "dom:piano-offer"), (PAID, "jsonld:isAccessibleForFree=false")), "' || case when n % 2 = 1 then 'likely' else 'possible' end || '", "case when n % 2 = 1 then 0.8 else 0.6 end"),
        detection("human.cookie_wall_detected", "n % 24 = 0", names(("true", "dom:onetrust-banner-sdk")), *POSSIBLE),
        detection("human.captcha_detected", "n % 25 = 0", names(("true", "resource:google.com/recaptcha")), *POSSIBLE),
        detection("human.javascript_required", "n % 26 = 0", names(("true", "noscript:javascript-required")), *LIKELY),
        page_found("legal.license", f"({ODD} or n % 27 = 0)", names((ODD, "https://l.example/x"), ("n % 27 = 0", "https://l.example/y")), absent="'[]'"),
        page_found("economic.subscription_required", ODD, "'true'"),
    ),
    "detect_policy": rows_sql(
        PAGES,
        declared("legal.scraping_restrictions", "false", ("n % 3 = 0", "automated_access_prohibited", None)),
        declared("legal.ai_restrictions", "false", ("n % 4 = 0", "content_ai_training_prohibited", None)),
        (
            "economic.registration_required", f"case when {BOTH} then 'error' when {any_(5, 7)} then 'observed' else 'no_evidence' end", f"case when {BOTH} then 'unknown' when {any_(5, 7)} then 'confirmed' else 'no_evidence' end",
            f"case when {BOTH} then 0.0 else 1.0 end", f"case when {BOTH} then 'null' when n % 5 = 0 then 'true' when n % 7 = 0 then 'false' else 'null' end",
        ),
        declared("economic.metering", "cut", ("n % 6 = 0", "periodic_limit", "Includes 100 requests per day")),
        declared("economic.api_pricing", "false", ("n % 8 = 0", "api_price", "$5 per month"), ("n % 10 = 0", "free_tier", None)),
    ),
    "detect_robots": rows_sql(
        "(select cast(page_id as varchar) as run_id, page_id as n, page_id % 5 as k, page_id % 2 = 0 as e from pages)",
        *(
            (s, "case when k = 1 then 'no_evidence' else 'observed' end", "case when k = 1 then 'no_evidence' else 'confirmed' end", "case when k = 1 then 0.0 else 1.0 end", f"case when k = 1 then 'null' when k = 0 then {gone} else {v} end")
            for s, gone, v in (
                ("crawler.robots_exists", "'false'", "'true'"),
                ("crawler.user_agents", "'[]'", "case when e then '[\"*\",\"gptbot\"]' else '[\"*\"]' end"),
                ("crawler.ai_specific_user_agents", "'[]'", "case when e then '[\"gptbot\"]' else '[]' end"),
                ("crawler.ai_homepage_policies", agent_policies("true", "true"), f"case when e then {agent_policies('true', 'false')} else {agent_policies('false', 'false')} end"),
                ("crawler.crawl_delays", "'{}'", "case when e then '{\"*\":\"2\"}' else '{}' end"),
                ("crawler.sitemaps", "'[]'", "case when n % 3 = 0 then '[\"https://h.example/a.xml\",\"https://h.example/s.xml\"]' else '[]' end"),
                ("crawler.homepage_policy_allowed", "'true'", "case when e then 'true' else 'false' end"),
            )
        ),
        ("crawler.robots_status", "'observed'", "'confirmed'", "1.0", "case k when 0 then '404' when 1 then '403' else '200' end"),
    ),
    "detect_sitemap": rows_sql(
        "(select cast(page_id as varchar) as run_id, page_id as n, page_id % 7 = 0 as barred, page_id % 5 = 0 as gone, page_id % 3 = 0 as bad, page_id % 8 > 4 as idx from pages)",
        found("metadata.sitemap_exists", "true", "case when gone then 'false' else 'true' end", broken="barred or (bad and not gone)", why="case when barred then 'skipped' else 'error' end"),
        *(
            found(s, "not gone", v, broken="barred or (bad and not gone)", why="case when barred then 'skipped' else 'error' end", absent="'null'")
            for s, v in (
                ("metadata.sitemap_document_type", "case when idx then '\"sitemapindex\"' else '\"urlset\"' end"),
                ("metadata.sitemap_url_count", "case when idx then '0' else cast(n % 4 as varchar) end"),
                ("metadata.sitemap_child_sitemap_count", "case when idx then cast(n % 4 as varchar) else '0' end"),
            )
        ),
        found("metadata.sitemap_status", "true", "case when gone then '404' else '200' end", broken="barred", why="'skipped'"),
    ),
    "detect_llms_txt": rows_sql(
        "(select cast(page_id as varchar) as run_id, page_id % 3 as k, page_id % 7 = 0 as barred from pages)",
        ("metadata.llms_txt_exists", "case when barred then 'skipped' when k = 2 then 'no_evidence' else 'observed' end", "case when barred then 'unknown' when k = 2 then 'no_evidence' else 'confirmed' end", "case when barred or k = 2 then 0.0 else 1.0 end", "case when barred or k = 2 then 'null' when k = 0 then 'true' else 'false' end"),
        found("metadata.llms_txt_status", "true", "case k when 0 then '200' when 1 then '404' else '500' end", broken="barred", why="'skipped'"),
    ),
    # A failed lookup turns absences into errors; what was found stands.
    "detect_dns": rows_sql(
        PAGES,
        found("network.dns_canonical_name", "(n % 3 <> 2 or n % 4 = 0)", "'\"' || substr(host, 2, length(host) - 2) || case when n % 3 = 0 then '.edgekey.net' when n % 3 = 1 then '.fastly.net' else '.github.io' end || '\"'", absent="'null'"),
        found("network.dns_nameservers", "true", "case when n % 2 = 0 then '[\"ns1.awsdns-01.com\"]' else '[\"ns1.cloudflare.com\"]' end"),
        found("network.dns_soa_primary", "n % 6 = 1", "'\"ns0.example.org\"'", absent="'null'"),
        found("infrastructure.edge_provider", "n % 3 <> 2", "case when n % 3 = 0 then '[\"akamai\"]' else '[\"fastly\"]' end", *LIKELY, absent="'null'"),
        found("infrastructure.edge_service_hints", "n % 3 = 0", "'[\"akamai_enhanced_tls_edge_hostname\"]'", *LIKELY, absent="'null'"),
        found("infrastructure.dns_provider", "true", "case when n % 2 = 0 then '[\"amazon_route_53\"]' else '[\"cloudflare\"]' end", *LIKELY),
        found("infrastructure.hosting_provider", "(n % 3 = 2 and n % 4 = 0)", "'[\"github_pages\"]'", *LIKELY, absent="'null'"),
        found("agent.tollbit_gateway", "n % 4 = 1", "'{\"canonical_name\":\"gate.example\",\"hostname\":\"tollbit.' || substr(host, 2, length(host) - 2) || '\",\"record_types\":[\"CNAME\",\"NS\"]}'", absent="'null'"),
    ),
    "detect_network": rows_sql(
        "(select cast(page_id as varchar) as run_id, page_id as n, page_id % 20 + 1 as a, page_id % 13 = 0 as lost, regexp_extract(url, '^(https?)', 1) <> 'https' or page_id % 13 = 0 as barred, page_id % 6 = 0 as none, list_transform(range(0, page_id % 20 + 1), lambda i: case when i % 2 = 0 then {'f': 'IPv4', 'a': 'a' || i} else {'f': 'IPv6', 'a': 'a' || i} end) as l from pages)",
        found("network.dns_resolved", "true", "'true'", broken="lost"),
        found("network.dns_addresses", "true", "'[' || array_to_string(list_transform(list_sort(list_transform(l, lambda x: x.f || x.a))[1:16], lambda x: '{\"address\":\"' || substr(x, 5) || '\",\"family\":\"' || substr(x, 1, 4) || '\"}'), ',') || ']'", broken="lost"),
        found("network.dns_address_count", "true", "cast(a as varchar)", broken="lost"),
        found("network.dns_ip_families", "true", "case when a > 1 then '[\"IPv4\",\"IPv6\"]' else '[\"IPv4\"]' end", broken="lost"),
        found("network.dns_addresses_truncated", "true", "case when a > 16 then 'true' else 'false' end", broken="lost"),
        *(
            found(f"network.{s}", "true", v, broken="barred or none", why="case when barred then 'skipped' else 'error' end")
            for s, v in (
                ("tls_handshake", "'true'"),
                ("tls_version", "'\"TLSv1.3\"'"),
                ("tls_cipher", "'{\"bits\":256,\"name\":\"AES\",\"protocol\":\"TLS\"}'"),
                ("tls_certificate_not_before", "'\"x\"'"),
                ("tls_certificate_not_after", "'\"y\"'"),
                ("tls_certificate_verified", "'true'"),
            )
        ),
        (
            "network.tls_certificate_issuer", "case when barred then 'skipped' when none then 'error' when n % 4 = 0 then 'observed' else 'no_evidence' end", "case when barred or none then 'unknown' when n % 4 = 0 then 'confirmed' else 'no_evidence' end",
            "case when not (barred or none) and n % 4 = 0 then 1.0 else 0.0 end", "case when not (barred or none) and n % 4 = 0 then '\"O=Ca\"' else 'null' end",
        ),
    ),
    "detect_archive": rows_sql(
        "(select cast(page_id as varchar) as run_id, page_id as n, page_id % 4 as k, page_id % 9 = 0 as off from pages)",
        (
            "preservation.archive_coverage", "case when off then 'skipped' when k = 3 then 'error' when k = 1 then 'no_evidence' else 'observed' end", "case when off or k = 3 then 'unknown' when k = 1 then 'no_evidence' else 'confirmed' end", "case when off or k in (1, 3) then 0.0 else 1.0 end",
            "case when off or k in (1, 3) then 'null' when k = 0 then '{\"earliest_sampled_capture\":null,\"homepage_captured\":false,\"latest_sampled_capture\":null,\"monthly_capture_samples\":0,\"sample_capped\":false}' else '{\"earliest_sampled_capture\":\"20190101000000\",\"homepage_captured\":true,\"latest_sampled_capture\":\"202001' || lpad(cast(n % 28 + 1 as varchar), 2, '0') || '000000\",\"monthly_capture_samples\":2,\"sample_capped\":false}' end",
        ),
        ("preservation.archive_blocked", "case when off then 'skipped' when k = 3 then 'error' when k = 0 then 'no_evidence' else 'observed' end", "case when off or k = 3 then 'unknown' when k = 1 then 'likely' when k = 2 then 'confirmed' else 'no_evidence' end", "case when off or k in (0, 3) then 0.0 when k = 1 then 0.9 else 1.0 end", "case when off or k in (0, 3) then 'null' when k = 1 then 'true' else 'false' end"),
    ),
    "detect_renderings": rows_sql(
        "(select cast(page_id as varchar) as run_id, page_id as n, to_json(url) as u, length(html) as c, page_id % 10 = 1 as shut, page_id % 5 = 0 as off, page_id % 7 = 0 as none from pages)",
        *(found(f"human.browser_{kind}_marker_visible", f"n % {k} = 0", quoted(f'{{"selectors":["{selector}"],"visible":true}}'), "likely", "0.9", "off or none", "case when off then 'skipped' else 'error' end", "'null'") for k, kind, selector in MARKERS),
        found(
            "crawler.browser_http_difference", "true",
            "'{\"access_disposition_changed\":' || case when shut then 'true' else 'false' end || ',\"browser_final_url\":' || u || ',\"browser_status\":200,\"document_char_delta\":' || (c - least(c, 100)) || ',\"final_url_changed\":false,\"http_available\":true,\"http_document_chars\":' || least(c, 100) || ',\"http_final_url\":' || u || ',\"http_status\":' || case when shut then 403 else 200 end || ',\"rendered_document_chars\":' || c || ',\"status_changed\":' || case when shut then 'true' else 'false' end || '}'",
            broken="off or none", why="case when off then 'skipped' else 'error' end",
        ),
        found("browser.navigation", "true", "'{\"accessible\":true,\"final_url\":' || u || ',\"status\":200}'", broken="off or none", why="case when off then 'skipped' else 'error' end"),
        found("browser.rendered_document", "true", "'{\"document_chars\":' || c || ',\"title\":\"t\",\"visible_text_chars\":10}'", broken="off or none", why="case when off then 'skipped' else 'error' end"),
        found("browser.network_summary", "true", "'{\"blocked_requests\":0,\"requests\":' || (n % 30) || ',\"third_party_requests\":1,\"transferred_response_bytes\":900}'", broken="off or none", why="case when off then 'skipped' else 'error' end"),
    ),
    "detect_cache": rows_sql(
        "(select cast(doc_id as varchar) as run_id, doc_id as n, doc_id % 3 < 2 as v from documents)",
        ("preservation.cache_behavior", "case when v then 'observed' else 'no_evidence' end", "case when v then 'confirmed' else 'no_evidence' end", "case when v then 1.0 else 0.0 end",
         "case when v then '{\"conditional_status\":' || case when n % 5 = 0 then '304' else '200' end || ',\"content_unchanged\":' || case when n % 5 = 0 or n % 2 = 0 then 'true' else 'false' end || ',\"result\":\"' || case when n % 5 = 0 then 'not_modified' when n % 2 = 0 then 'full_response_unchanged' else 'full_response_changed' end || '\",\"validator\":\"' || case when n % 3 = 0 then 'etag' else 'last-modified' end || '\"}' else 'null' end"),
    ),
    "attempt_follow_ups": """with a as (select cast(l_orderkey as varchar) as run_id, l_linenumber // 4 as request, l_linenumber as n, case l_returnflag when 'R' then 503 when 'A' then 301 else 200 end as s, case when l_linenumber % 2 = 0 then 9.0 else 0.0 end as w from (select l_orderkey, l_linenumber, max(l_returnflag) as l_returnflag from lineitem group by all)),
b as (select *, coalesce(sum(case when s = 301 then 1 else 0 end) over p, 0) as r, coalesce(sum(case when s = 503 then 1 else 0 end) over p, 0) as t, count(*) over (partition by run_id order by request, n rows unbounded preceding) as spent from a window p as (partition by run_id, request order by n rows between unbounded preceding and 1 preceding))
select run_id, n, case when s = 200 then 'done' when spent >= 8 then 'budget_exhausted' when s = 301 then case when r >= 5 then 'too_many_redirects' else 'redirect' end when t >= 1 then 'gave_up' when w > 5 then 'deferred' else 'retry' end as follow from b""",
    "job_transitions": """with o as (select o_custkey % 10 as run_id, o_orderkey as ordinal, o_orderstatus = 'O' as r, o_orderkey % 2 = 0 as e, o_orderkey % 3 as k from orders)
select run_id, ordinal, case when not r then 'pending' when e and run_id % 2 = 0 and run_id < 8 then case k when 0 then 'completed' when 1 then 'deferred' else 'failed' end else 'running' end as status, 1 + case when r and e and run_id % 2 = 0 and run_id < 8 and k < 2 then 4 else 0 end as request_count from o""",
}
