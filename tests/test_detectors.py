"""Detectors on small captures: present, absent, cut off, failed."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weblathe.functions import vocabulary as V
from weblathe.functions.parsing import PIECE, TEXT, Robots, host_name, in_pieces, read_linked_data, read_page, read_sitemap
from weblathe.operators import detectors as D
from weblathe.operators.observe import snapshots_of

FETCH = """run_id string, origin string, requested_url string, final_url string, status_code int, http_version string, headers map<string,string>, cookie_names array<string>,
attempts array<struct<status_code: int>>, body string, truncated boolean, error string, allowed boolean, homepage_url string"""
HTML = {"content-type": "text/html; charset=utf-8"}


def fetch(run_id="r", status=200, headers=None, body="", **more):
    row = {"run_id": run_id, "origin": "https://site.example", "requested_url": "https://site.example/", "final_url": "https://site.example/", "status_code": status, "http_version": "HTTP/2",
           "headers": headers if headers is not None else HTML, "cookie_names": [], "attempts": [(status,)], "body": body, "truncated": False, "error": None, "allowed": True, "homepage_url": "https://site.example/"}
    return tuple((row | more).values())


def table(spark, *rows):
    return spark.createDataFrame(list(rows), FETCH)


def by_signal(df, run="r"):
    return {r["signal"]: (json.loads(r["value_json"]), r["outcome"], r["confidence"], r["confidence_score"]) for r in df.where(F.col("run_id") == run).collect()}


def test_catalog():
    assert len(V.SIGNALS) == len(set(V.SIGNALS)) == 110
    families = {f: sum(s.startswith(f + ".") for s in V.SIGNALS) for f in "agent browser crawler economic human infrastructure legal metadata network preservation".split()}
    assert families == {"agent": 9, "browser": 3, "crawler": 12, "economic": 6, "human": 17, "infrastructure": 21, "legal": 5, "metadata": 17, "network": 16, "preservation": 4}


ROBOTS = "User-agent: GPTBot\nCrawl-delay: 10\nDisallow: /\n\nUser-agent: CCBot\nuser-agent: ClaudeBot-Web # note\nAllow: /open\nDisallow: /closed/*.html$\n\nUser-agent: *\nCrawl-delay: 2.5\nDisallow: /private\nSitemap: https://site.example/map.xml\n"


def test_robots_rules():
    r = Robots(ROBOTS)
    assert r.agents == {"gptbot", "ccbot", "claudebot-web", "*"}
    assert not r.can_fetch("https://site.example/x", "gptbot")
    assert r.can_fetch("https://site.example/closed/a.html?x", "ccbot") and not r.can_fetch("https://site.example/closed/a.html", "CCBot/2.0")
    assert not r.can_fetch("https://site.example/private/1", "other") and r.can_fetch("https://site.example/", "other")
    assert (r.delay("gptbot"), r.delay("ccbot"), r.delay("other")) == (10.0, None, 2.5)
    longest = Robots("User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /c\nAllow: /c")
    assert longest.can_fetch("https://h.example/a/b/1", "x") and not longest.can_fetch("https://h.example/a/1", "x") and longest.can_fetch("https://h.example/c", "x")


def test_robots_decisions(spark):
    rows = table(spark, fetch("yes", body=ROBOTS), fetch("gone", 404), fetch("barred", 403), fetch("cut", body=ROBOTS, truncated=True), fetch("down", None, error="timeout"))
    out = D.robots_signals(rows)
    yes = by_signal(out, "yes")
    assert yes["crawler.ai_specific_user_agents"][0] == ["ccbot", "gptbot"]
    assert yes["crawler.crawl_delays"][0] == {"*": "2.5", "gptbot": "10"} and yes["crawler.sitemaps"][0] == ["https://site.example/map.xml"]
    assert yes["crawler.ai_homepage_policies"][0]["gptbot"] is False and yes["crawler.homepage_policy_allowed"] == (True, "observed", "confirmed", 1.0)
    gone = by_signal(out, "gone")
    assert gone["crawler.robots_exists"][0] is False and gone["crawler.user_agents"] == ([], "observed", "confirmed", 1.0) and all(gone["crawler.ai_homepage_policies"][0].values())
    assert by_signal(out, "barred")["crawler.robots_exists"] == (None, "no_evidence", "no_evidence", 0.0) and by_signal(out, "barred")["crawler.robots_status"] == (403, "observed", "confirmed", 1.0)
    assert by_signal(out, "cut")["crawler.robots_exists"][1] == "error" and by_signal(out, "cut")["crawler.robots_status"][0] == 200
    assert {o[1] for o in by_signal(out, "down").values()} == {"error"}
    allowed = {r["run_id"]: r["allowed"] for r in D.followup_allowed(rows).collect()}
    assert allowed == {"yes": True, "gone": True, "barred": False, "cut": False, "down": False}


def test_sitemaps(spark):
    xml = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url/><url/></urlset>'
    assert read_sitemap(xml)["urls"] == 2 and read_sitemap(b"<sitemapindex><sitemap/></sitemapindex>")["children"] == 1
    for bad in (b"", b"<urlset>", b"<!DOCTYPE x><urlset/>", b"<rss/>", b" " * 9 + b"<urlset/>" + b" " * 1_000_000):
        assert read_sitemap(bad)["error"]
    rows = table(spark, fetch("yes", body=xml.decode()), fetch("gone", 404), fetch("bad", body="<urlset>"), fetch("barred", 200, allowed=False), fetch("odd", 500)).withColumn("body", F.col("body").cast("binary"))
    out = D.sitemap_signals(rows)
    assert by_signal(out, "yes")["metadata.sitemap_url_count"] == (2, "observed", "confirmed", 1.0)
    assert by_signal(out, "gone")["metadata.sitemap_exists"][:2] == (False, "observed")
    assert [by_signal(out, r)["metadata.sitemap_exists"][1] for r in ("bad", "barred", "odd")] == ["error", "skipped", "no_evidence"]


def test_llms(spark):
    out = D.llms_signals(table(spark, fetch("a"), fetch("b", 404), fetch("c", 500), fetch("d", allowed=False)))
    assert [by_signal(out, r)["metadata.llms_txt_exists"][:2] for r in "abcd"] == [(True, "observed"), (False, "observed"), (None, "no_evidence"), (None, "skipped")]


def test_response_headers(spark):
    headers = {"cf-ray": "8f-FRA", "cf-cache-status": "hit", "server": "x", "strict-transport-security": "1", "x-frame-options": "DENY", "alt-svc": 'h3=":443"; ma=1', "cf-mitigated": "challenge", "x-wa-info": "1"}
    cookies = ["__cf_bm", "_abck", "TS01ab", "BIGipServerpool", "incap_ses_1", "other"]
    rows = table(spark, fetch("a", 403, headers, cookie_names=cookies, attempts=[(429,), (451,), (403,)]), fetch("b", headers={}), fetch("c", None, error="refused"), fetch("d", 401))
    out = D.response_signals(rows)
    a = by_signal(out, "a")
    assert a["infrastructure.cdn"] == (["cloudflare"], "observed", "likely", 0.8)
    assert a["infrastructure.edge_response_hints"][0] == ["cloudflare", "f5"] and a["infrastructure.challenge_response"][0] == {"provider": "cloudflare", "type": "challenge"}
    assert a["infrastructure.cache_status"][0] == [{"provider": "cloudflare", "status": "HIT"}] and a["infrastructure.edge_location_hints"][0] == {"cloudflare": "FRA"}
    assert a["infrastructure.response_cookie_fingerprints"][0] == ["akamai:_abck", "cloudflare:__cf_bm", "f5:BIGipServer*", "f5:TS*", "imperva:session_cookie"]
    assert a["infrastructure.bot_management_hints"][0] == ["akamai", "cloudflare", "f5", "imperva"] and a["infrastructure.load_balancer_hints"][0] == ["f5"]
    assert a["human.http_access_disposition"][0] == "forbidden" and a["human.rate_limited"][0] is True and a["human.geographic_restriction"] == ({"detected": True, "status": 451}, "observed", "possible", 0.6)
    assert a["infrastructure.http3_advertised"][0] is True and a["infrastructure.security_headers"][0] == ["strict-transport-security", "x-frame-options"]
    b = by_signal(out, "b")
    assert b["infrastructure.cdn_hints"] == ([], "no_evidence", "no_evidence", 1.0) and b["human.rate_limited"] == (False, "observed", "confirmed", 1.0)
    assert b["human.authentication_challenge"] == (False, "no_evidence", "no_evidence", 1.0) and b["human.login_required"][0] is None
    assert len(by_signal(out, "c")) == 24 and {o[1] for o in by_signal(out, "c").values()} == {"error"}
    assert by_signal(out, "d")["human.login_required"][:2] == (True, "observed")
    assert by_signal(D.homepage_signals(rows), "a")["human.homepage_accessible"][:2] == (False, "observed")


PAGE = """<html lang="en"><head><title>A  page</title><svg><title>icon</title></svg><meta property="og:title" content="x"><meta name="generator" content="Gen 1">
<link rel="canonical" href="/c"><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="manifest" href="m.json"><link rel="service-desc" href="/openapi.json">
<link rel="license" href="https://lic.example/by"><script type="application/ld+json">{"@type": ["B", "A"], "isAccessibleForFree": "false", "requiresSubscription": {"x": 1}, "license": "L"}</script></head>
<body><div class="paywall" id="x"></div><script src="https://www.google.com/recaptcha/api.js"></script><noscript>Please enable JavaScript.</noscript>
<a href="/mcpherson">m</a><a href="/photos">p</a><a href="/legal/Terms_of_Use">Terms</a><a href="/plans">Plans</a><a href="/blog">Log in</a><a href="/api/graphql">q</a>
<p>You may not use automated means or scrape this site. Users must register. Up to 1,000 requests per day. API access costs $5 per month.</p></body></html>"""


def test_metadata_of_a_rich_page(spark):
    pages = D.with_page_facts(table(spark, fetch("a", body=PAGE), fetch("b", body="<p>hi"), fetch("cut", body="<meta property=og:x>", truncated=True), fetch("pdf", headers={"content-type": "application/pdf"}), fetch("down", None, error="x"), fetch("no", allowed=False, status=None)))
    out = D.metadata_signals(pages)
    a = by_signal(out, "a")
    assert a["metadata.html_title"][0] == "A page" and a["metadata.json_ld_types"][0] == ["A", "B"] and a["metadata.open_graph"][0] is True
    assert a["metadata.canonical_url"][0] == "https://site.example/c" and a["metadata.feeds"][0] == ["https://site.example/feed"] and a["metadata.generator"][0] == "Gen 1"
    assert [x["url"] for x in a["agent.interface_links"][0]] == ["https://site.example/openapi.json", "https://site.example/api/graphql"]
    assert a["agent.openapi"] == (["https://site.example/openapi.json"], "observed", "possible", 0.6) and a["agent.mcp"][1] == "no_evidence"
    assert [x["url"] for x in a["legal.policy_links"][0]] == ["https://site.example/legal/Terms_of_Use"] and a["economic.registration_links"][0][0]["text"] == "Log in"
    b = by_signal(out, "b")
    assert b["metadata.json_ld"] == (False, "no_evidence", "no_evidence", 1.0) and b["metadata.html_title"][0] is None
    cut = by_signal(out, "cut")
    assert cut["metadata.open_graph"][1] == "observed" and cut["metadata.feeds"] == (None, "error", "unknown", 0.0)
    assert [by_signal(out, r)["metadata.feeds"][1] for r in ("pdf", "down", "no")] == ["skipped", "error", "skipped"]
    assert len(a) == 22
    s = by_signal(D.page_signals(pages), "a")
    assert s["human.paywall_detected"] == ({"detected": True, "markers": ["dom:paywall", "jsonld:isAccessibleForFree=false"]}, "observed", "likely", 0.8)
    assert s["human.captcha_detected"][2:] == ("possible", 0.6) and s["human.javascript_required"][2] == "likely" and s["human.cookie_wall_detected"][:2] == (None, "no_evidence")
    assert s["legal.license"][0] == ["L", "https://lic.example/by"] and s["economic.subscription_required"][0] is True


@pytest.mark.parametrize(("written", "title"), [("a &amp; b", "a & b"), ("&quot;a", '"a'), ("a &amp", "a &"), ("a&amp;&amp", "a&&"), ("&amp;quot;", "&quot;")])
def test_titles_decode_all_references(spark, written, title):
    assert read_page(f"<title>{written}</title><p>x", None)["title"] == title


def test_metadata_takes_every_link_of_a_page(spark):
    n = 120
    links = [f'<a href="/mcp/{i}">Tool</a><a href="/plans/{i}">{"x " * 200} <b>Plans</b> {i}</a>' for i in (*range(n), *reversed(range(n)))]
    a = by_signal(D.metadata_signals(D.with_page_facts(table(spark, fetch("a", body="".join(links))))), "a")
    assert [x["url"] for x in a["agent.interface_links"][0]] == [f"https://site.example/mcp/{i}" for i in range(n)]
    assert a["agent.mcp"][0] == sorted(f"https://site.example/mcp/{i}" for i in range(n))
    assert [(x["url"], x["text"]) for x in a["economic.pricing_links"][0]] == [(f"https://site.example/plans/{i}", "x " * 200 + f"Plans {i}") for i in range(n)]
    # No address: no link. What only the text says comes after 256 characters.
    a = by_signal(D.metadata_signals(D.with_page_facts(table(spark, fetch("a", body=f"<a href='javascript:/mcp'>no</a><a href='/other'>{'x' * 300} pricing</a><a href='javascript:1'>pricing</a>")))), "a")
    assert a["agent.interface_links"][1] == "no_evidence" and [x["url"] for x in a["economic.pricing_links"][0]] == ["https://site.example/other"]


def test_metadata_takes_long_values_whole(spark):
    long, kinds = "y" * 5_000, [f"T{i:05}" for i in range(20_000)]
    body = f'<html lang="{long}"><head><title>{long} end</title><meta name="generator" content="{long}"><link rel="canonical" href="/{long}/c"><script type="application/ld+json">{json.dumps({"@type": kinds})}</script></head>'
    a = by_signal(D.metadata_signals(D.with_page_facts(table(spark, fetch("a", body=body)))), "a")
    assert a["metadata.html_title"][0] == f"{long} end" and a["metadata.html_language"][0] == a["metadata.generator"][0] == long
    assert a["metadata.canonical_url"][0] == f"https://site.example/{long}/c" and a["metadata.json_ld_types"][0] == kinds


def test_first_of_each_url_on_many_links(spark):
    n = 30_000
    links = F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda i: F.struct(i.alias("n"), F.when(i % 7 > 0, F.concat(F.lit("u"), ((i * 7_919) % n).cast("string"))).alias("url")))
    rows = spark.range(1).select(links.alias("a"), F.lit(None).cast("array<struct<n: int, url: string>>").alias("b"))
    got = D.first_of_each_url(rows, "a", "b").first()
    want = {}
    for i in range(2 * n):
        if i % 7:
            want.setdefault(f"u{i * 7_919 % n}", i)
    assert {x["url"]: x["n"] for x in got["a"]} == want and [x["n"] for x in got["a"]] == list(want.values()) and got["b"] is None


def test_policy_texts(spark):
    pages = D.with_page_facts(table(spark, fetch("a", body=PAGE), fetch("b", body="<p>We wrote about scraping, prices and artificial intelligence.</p>"), fetch("c", body="<p>Registration is required. No account required.</p>"), fetch("d", body="")))
    texts = pages.select("run_id", F.lit(0).alias("position"), F.lit("u").alias("source_url"), F.col("page.text").alias("text"))
    issues = spark.createDataFrame([("b", "economic.metering", "skipped"), ("b", "economic.metering", "error"), ("a", "economic.metering", "error")], "run_id string, signal string, outcome string")
    out = D.policy_signals(pages, texts, issues)
    a = by_signal(out, "a")
    assert [d["rule"] for d in a["legal.scraping_restrictions"][0]["declarations"]] == ["automated_access_prohibited"]
    assert a["economic.registration_required"][:2] == (True, "observed") and a["economic.metering"][0]["declarations"][0]["detail"] == "Up to 1,000 requests per day"
    assert a["economic.api_pricing"][0]["declarations"][0]["detail"] == "$5 per month"
    b = by_signal(out, "b")
    assert {k: v[1] for k, v in b.items()} == {"legal.scraping_restrictions": "no_evidence", "legal.ai_restrictions": "no_evidence", "economic.registration_required": "no_evidence", "economic.metering": "error", "economic.api_pricing": "no_evidence"}
    assert by_signal(out, "c")["economic.registration_required"] == (None, "error", "unknown", 0.0)
    best = {r["url"]: (r["score"], r["scope"]) for r in D.best_candidates(pages).where("run_id = 'a'").collect()}
    assert best == {"https://site.example/legal/Terms_of_Use": (110, ["legal"]), "https://site.example/plans": (100, ["economic"])}


def test_names_and_addresses(spark):
    rows = spark.createDataFrame(
        [("a", "https", [("IPv4", f"8.8.8.{i}") for i in range(20)] + [("IPv6", "2001:4860::1")], True, ("TLSv1.3", "AES", "TLS", 256, "x", "y", "CN=z", True)), ("b", "http", None, False, None), ("c", "https", [("IPv4", "10.0.0.1")], False, None)],
        "run_id string, scheme string, addresses array<struct<family: string, address: string>>, safe boolean, tls struct<version: string, cipher_name: string, cipher_protocol: string, cipher_bits: int, not_before: string, not_after: string, issuer: string, verified: boolean>",
    )
    out = D.network_signals(rows)
    a = by_signal(out, "a")
    assert a["network.dns_address_count"][0] == 21 and len(a["network.dns_addresses"][0]) == 16 and a["network.dns_addresses_truncated"][0] is True and a["network.dns_ip_families"][0] == ["IPv4", "IPv6"]
    assert a["network.tls_cipher"][0] == {"bits": 256, "name": "AES", "protocol": "TLS"}
    assert by_signal(out, "b")["network.dns_resolved"][1] == "error" and by_signal(out, "b")["network.tls_version"][1] == "skipped" and by_signal(out, "c")["network.tls_version"][1] == "skipped"
    names = spark.createDataFrame(
        [("a", "X.edgekey.net.", ["NS1.awsdns-01.com."], "soa.example", "tollbit.x.example", ["CNAME", "A"], "gw.example", {}), ("b", None, [], None, None, ["A"], None, {"nameservers": "timeout"})],
        "run_id string, canonical_name string, nameservers array<string>, soa_primary string, tollbit_hostname string, tollbit_record_types array<string>, tollbit_canonical_name string, errors map<string,string>",
    )
    out = D.dns_signals(names)
    a = by_signal(out, "a")
    assert a["infrastructure.edge_provider"] == (["akamai"], "observed", "likely", 0.8) and a["infrastructure.dns_provider"][0] == ["amazon_route_53"] and a["infrastructure.edge_service_hints"][0] == ["akamai_enhanced_tls_edge_hostname"]
    assert a["agent.tollbit_gateway"][0]["record_types"] == ["A", "CNAME"]
    b = by_signal(out, "b")
    assert b["network.dns_nameservers"][1] == "error" and b["infrastructure.dns_provider"][1] == "error" and b["infrastructure.edge_provider"][:2] == (None, "no_evidence") and b["agent.tollbit_gateway"][0] is None


def test_renderings_archives_and_repeats(spark):
    render = "struct<final_url: string, status_code: int, title: string, document_chars: int, visible_text_chars: int, markers: map<string,array<string>>, request_count: int, third_party_request_count: int, blocked_request_count: int, total_response_bytes: bigint>"
    one = ("https://site.example/x", 200, "t", 50, 10, {"login": ["form"]}, 3, 1, 0, 900)
    rows = spark.createDataFrame(
        [("a", True, True, True, 200, "https://site.example/", "u", None, "12345", one), ("b", False, True, True, 200, "u", "u", None, "", None), ("c", True, True, False, None, None, None, None, None, one), ("d", True, True, True, 200, "u", "u", None, "", None)],
        f"run_id string, enabled boolean, allowed boolean, fetched boolean, status_code int, final_url string, requested_url string, error string, body string, render {render}",
    )
    out = D.browser_signals(rows)
    a = by_signal(out, "a")
    assert a["crawler.browser_http_difference"][0]["document_char_delta"] == 45 and a["crawler.browser_http_difference"][0]["final_url_changed"] is True and a["browser.network_summary"][0]["requests"] == 3
    assert a["human.browser_login_marker_visible"][2:] == ("likely", 0.9) and a["human.browser_captcha_marker_visible"][1] == "no_evidence"
    assert [by_signal(out, r)["browser.navigation"][1] for r in "bd"] == ["skipped", "error"] and by_signal(out, "c")["crawler.browser_http_difference"][0]["http_available"] is False
    body = json.dumps([["urlkey", "timestamp"], ["k", "20200101000000"], ["k", "20190101000000"], ["k", "20200101000000"]])
    archive = spark.createDataFrame([("a", True, 200, body, False, None), ("b", True, 200, "[]", False, None), ("c", True, 403, "This URL has been excluded", False, None), ("d", True, 200, "{", False, None), ("e", False, None, None, None, None), ("f", True, 200, '[["timestamp"],["20201301000000"]]', False, None)], "run_id string, enabled boolean, status_code int, body string, truncated boolean, error string")
    out = D.archive_signals(archive)
    assert by_signal(out, "a")["preservation.archive_coverage"][0] == {"earliest_sampled_capture": "20190101000000", "homepage_captured": True, "latest_sampled_capture": "20200101000000", "monthly_capture_samples": 2, "sample_capped": False}
    assert [by_signal(out, r)["preservation.archive_blocked"][:2] for r in "abcdef"] == [(False, "observed"), (None, "no_evidence"), (True, "observed"), (None, "error"), (None, "skipped"), (None, "error")]
    side = "struct<status_code: int, headers: map<string,string>, sha256: string, truncated: boolean, error: string, attempts: int, final_url: string>"
    base = (200, {"etag": "1"}, "d1", False, None, 1, "u")
    pairs = [("a", base, (304, {}, None, False, None, 1, "u")), ("b", base, (200, {}, "d1", False, None, 1, "u")), ("c", base, (200, {}, "d2", False, None, 1, "u")), ("d", (200, {}, "d1", False, None, 1, "u"), None), ("e", base, (200, {}, "d1", True, None, 1, "u")), ("f", (200, {"etag": "1"}, "d1", True, None, 1, "u"), (200, {}, "d1", False, None, 1, "u"))]
    out = D.cache_signals(spark.createDataFrame([(i, True, True, b, r) for i, b, r in pairs], f"run_id string, enabled boolean, allowed boolean, base {side}, repeat {side}"))
    found = {i: by_signal(out, i)["preservation.cache_behavior"] for i, _, _ in pairs}
    assert [found[i][0] and found[i][0]["result"] for i in "abc"] == ["not_modified", "full_response_unchanged", "full_response_changed"]
    assert found["d"][1] == "no_evidence" and found["e"][1] == "error" and found["f"][0]["content_unchanged"] is None


def test_attempts(spark):
    rows = spark.createDataFrame([("a", s) for s in (200, 403, 429, 429, None)] + [("b", None)], "run_id string, status_code int")
    out = D.attempt_signals(rows)
    a = by_signal(out, "a")
    assert a["crawler.http_status_distribution"][0] == {"200": 1, "403": 1, "429": 2} and a["crawler.http_403_frequency"][0]["rate"] == 0.25 and a["crawler.http_429_frequency"][0]["rate"] == 0.5
    assert {v[:2] for v in by_signal(out, "b").values()} == {(None, "no_evidence")}


def test_every_signal_has_a_detector(spark):
    page = table(spark, fetch("r", body=PAGE))
    pages = D.with_page_facts(page)
    texts = pages.select("run_id", F.lit(0).alias("position"), F.lit("u").alias("source_url"), F.col("page.text").alias("text"))
    none = spark.createDataFrame([], "run_id string, signal string, outcome string")
    parts = [D.robots_signals(page), D.sitemap_signals(page.withColumn("body", F.col("body").cast("binary"))), D.llms_signals(page), D.homepage_signals(page), D.response_signals(page), D.metadata_signals(pages), D.page_signals(pages), D.policy_signals(pages, texts, none)]
    names = {r["signal"] for p in parts for r in p.select("signal").collect()}
    others = {s for s in V.SIGNALS if s.startswith(("network.dns", "network.tls", "browser.", "human.browser", "preservation.archive", "preservation.cache_b", "crawler.http_", "crawler.browser", "agent.tollbit")) or s in ("infrastructure.edge_provider", "infrastructure.edge_service_hints", "infrastructure.dns_provider", "infrastructure.hosting_provider")}
    assert names | others == set(V.SIGNALS)
    whole = snapshots_of(parts[0].unionByName(parts[2]), page.select("run_id", "origin"))
    assert whole.select(F.size("observations")).first()[0] == 10


@pytest.mark.parametrize(("host", "want"), [("Bücher.example", "xn--bcher-kva.example"), ("www.example.com.", "www.example.com"), ("", None), ("a_b.example", None), ("-a.example", None)])
def test_host_names(host, want):
    assert host_name(host) == want


def test_linked_data_and_limits():
    got = read_linked_data(['{"@graph": [{"license": {"url": "u1"}}, {"license": ["b", " a "]}]}', "{"])
    assert got["licences"] == ["a", "b", "u1"] and got["parsed"]
    assert read_linked_data(["[", "{"])["parsed"] is False
    page = read_page("".join(f"<a href='/x{i}'>t</a>" for i in range(60)) + "<a href='/terms'>Terms</a>", "https://h.example")
    assert len(page["anchors"]) == 61 and page["anchors"][-1]["url"] == "https://h.example/terms"


def test_a_batch_is_read_in_pieces():
    alive, most = 0, 0

    class Fact(str):
        def __new__(cls, value):
            nonlocal alive, most
            alive, most = alive + 1, max(most, alive + 1)
            return super().__new__(cls, value)

        def __del__(self):
            nonlocal alive
            alive -= 1

    given = pa.array([str(i) for i in range(10 * PIECE + 1)])
    assert in_pieces(Fact, TEXT, given).equals(given)
    assert most <= 2 * PIECE
    assert len(in_pieces(Fact, TEXT, given[:0])) == 0
