"""The detectors: captured responses, addresses, names and renderings to the 110 signals.

Every function takes a table of captures, one row for each run_id, and returns rows of observations
(see ``observe``). All rules are Column expressions on headers, statuses and parsed facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblathe.functions import vocabulary as V
from weblathe.functions.parsing import page_facts, robots_facts, sitemap_facts
from weblathe.functions.text import any_of, dns_name, economic_score, has_bounded_marker, has_marker, lit_array, policy_score, providers, squeeze
from weblathe.functions.urls import host_of, same_site

from .observe import certain, emit, inconclusive, list_value, missing_page, nested_json, observe, scalar_json, seen, text_value, unless

TOKEN = "weblathe"


def ok(status: Column) -> Column:
    return (status >= 200) & (status < 400)


def sorted_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


# Addresses and TLS


def network_signals(rows: DataFrame, stored: int = 16) -> DataFrame:
    """rows: scheme, addresses (array of family, address; null: the lookup failed), safe, tls (struct or null), tls_error."""
    every = sorted_set(F.transform("addresses", lambda a: F.struct(a["address"].alias("address"), a["family"].alias("family"))))
    by_family = F.array_sort(every, lambda x, y: F.when(x["family"] < y["family"], -1).when(x["family"] > y["family"], 1).when(x["address"] < y["address"], -1).when(x["address"] > y["address"], 1).otherwise(0))
    how, failed = "system address resolution", F.col("addresses").isNull()
    dns = [
        certain("network.dns_resolved", scalar_json(F.size(every) > 0), how),
        certain("network.dns_addresses", nested_json(F.slice(by_family, 1, stored)), how),
        certain("network.dns_address_count", scalar_json(F.size(every)), how),
        certain("network.dns_ip_families", nested_json(sorted_set(F.transform(every, lambda a: a["family"]))), how),
        certain("network.dns_addresses_truncated", scalar_json(F.size(every) > stored), "storage bound"),
    ]
    dns = [inconclusive(o, failed, "address lookup failed", only_absent=False) for o in dns]
    t = lambda f: F.left(F.col(f"tls.{f}"), F.lit(1024))
    value = lambda s, c, j, m: observe(s, j, F.when(c.isNotNull(), "confirmed").otherwise("no_evidence"), F.when(c.isNotNull(), 1.0).otherwise(0.0), m)
    cipher = F.when(F.col("tls.cipher_name").isNotNull(), F.struct(F.col("tls.cipher_bits").alias("bits"), t("cipher_name").alias("name"), t("cipher_protocol").alias("protocol")))
    tls = [
        certain("network.tls_handshake", F.lit("true"), "TLS handshake"),
        value("network.tls_version", t("version"), scalar_json(t("version")), "negotiated TLS protocol"),
        value("network.tls_cipher", cipher, nested_json(cipher), "negotiated TLS cipher"),
        value("network.tls_certificate_not_before", t("not_before"), scalar_json(t("not_before")), "certificate validity start"),
        value("network.tls_certificate_not_after", t("not_after"), scalar_json(t("not_after")), "certificate validity end"),
        value("network.tls_certificate_issuer", t("issuer"), scalar_json(t("issuer")), "certificate issuer"),
        value("network.tls_certificate_verified", F.col("tls.verified"), scalar_json(F.col("tls.verified")), "certificate verification"),
    ]
    why = F.when((F.col("scheme") != "https") | ~F.coalesce("safe", F.lit(False)), "skipped").otherwise("error")
    untold = (why == "skipped") | F.col("tls").isNull()
    return emit(rows, *dns, *(inconclusive(o, untold, "TLS wasn't inspected", why, only_absent=False) for o in tls))


def dns_signals(rows: DataFrame) -> DataFrame:
    """rows: canonical_name, nameservers, soa_primary, tollbit_hostname, tollbit_record_types, tollbit_canonical_name, errors (map)."""
    cname, soa = dns_name(F.col("canonical_name")), dns_name(F.col("soa_primary"))
    ns = F.slice(sorted_set(F.array_compact(F.transform("nameservers", dns_name))), 1, 32)
    failed = lambda f: F.map_contains_key(F.coalesce("errors", F.create_map().cast("map<string,string>")), F.lit(f))
    strong = F.arrays_overlap("tollbit_record_types", lit_array(("CNAME", "NS")))
    gate = F.when(strong, F.struct(F.col("tollbit_canonical_name").alias("canonical_name"), F.col("tollbit_hostname").alias("hostname"), F.array_sort("tollbit_record_types").alias("record_types")))
    names = F.when(cname.isNotNull(), F.array(cname))
    matches = lambda *s: providers(names, {"x": s})
    service = F.when(F.size(matches("edgekey.net", "akamaiedge.net")) > 0, F.array(F.lit("akamai_enhanced_tls_edge_hostname"))).when(F.size(matches("edgesuite.net")) > 0, F.array(F.lit("akamai_standard_tls_edge_hostname")))
    hint = lambda s, v, m: list_value(s, F.coalesce(v, F.array().cast("array<string>")), m, "likely", 0.8, absent="null")
    rows = rows.withColumns({"_names": names, "_ns": ns})
    names, ns = F.col("_names"), F.col("_ns")
    rows = rows.withColumns({"_edge": providers(names, V.EDGE_SUFFIXES), "_dns": providers(ns, V.DNS_SUFFIXES), "_host": providers(names, V.HOSTING_SUFFIXES), "_service": service})
    return emit(
        rows,
        inconclusive(text_value("network.dns_canonical_name", cname, "CNAME lookup"), failed("canonical_name"), "lookup failed"),
        inconclusive(list_value("network.dns_nameservers", F.coalesce(ns, F.array().cast("array<string>")), "NS lookup", absent="null"), failed("nameservers"), "lookup failed"),
        inconclusive(text_value("network.dns_soa_primary", soa, "SOA lookup"), failed("soa_primary"), "lookup failed"),
        inconclusive(hint("infrastructure.edge_provider", F.col("_edge"), "suffix of the CNAME"), failed("canonical_name"), "lookup failed"),
        inconclusive(hint("infrastructure.edge_service_hints", F.col("_service"), "edge host suffix"), failed("canonical_name"), "lookup failed"),
        inconclusive(hint("infrastructure.dns_provider", F.col("_dns"), "suffix of nameservers"), failed("nameservers"), "lookup failed"),
        inconclusive(hint("infrastructure.hosting_provider", F.col("_host"), "suffix of the CNAME"), failed("canonical_name"), "lookup failed"),
        inconclusive(seen("agent.tollbit_gateway", gate.isNotNull(), nested_json(gate), "CNAME or NS of the gateway name"), failed("tollbit"), "lookup failed"),
    )


# robots.txt, sitemap, llms.txt


def robots_signals(rows: DataFrame, token: str = TOKEN) -> DataFrame:
    """rows: status_code, body (text), truncated, error, homepage_url."""
    status, body = F.col("status_code"), F.when(F.col("status_code") == 200, F.coalesce("body", F.lit("")))
    r = rows.withColumn("r", robots_facts(token, V.AI_AGENTS)(body, F.col("homepage_url")))
    gone = status.isin(404, 410)
    pick = lambda there, absent: F.when(gone, F.lit(absent)).otherwise(there)
    ai = F.array_intersect(F.coalesce("r.user_agents", F.array().cast("array<string>")), lit_array(V.AI_AGENTS))
    open_to_all = "{" + ",".join(f'"{a}":true' for a in sorted(V.AI_AGENTS)) + "}"
    how = F.when(gone, "robots.txt was not present").otherwise("robots.txt rules")
    values = {
        "crawler.robots_exists": F.when(gone, "false").otherwise("true"),
        "crawler.user_agents": pick(nested_json(F.col("r.user_agents")), "[]"),
        "crawler.ai_specific_user_agents": pick(nested_json(ai), "[]"),
        "crawler.ai_homepage_policies": pick(F.col("r.policies"), open_to_all),
        "crawler.crawl_delays": pick(F.col("r.delays"), "{}"),
        "crawler.sitemaps": pick(nested_json(F.col("r.sitemaps")), "[]"),
        "crawler.homepage_policy_allowed": pick(scalar_json(F.col("r.allowed")), "true"),
    }
    failed = F.col("error").isNotNull() | F.coalesce("truncated", F.lit(False)) | status.isNull()
    odd = ~failed & ~gone & (status != 200)
    out = [inconclusive(certain(s, v, how), failed, "robots.txt was not read completely", only_absent=False) for s, v in values.items()]
    nothing = lambda o: F.when(odd, observe_like(o, "no_evidence", "no_evidence", 0.0, "null", "robots.txt returned an inconclusive status")).otherwise(o)
    known = certain("crawler.robots_status", scalar_json(status), "HTTP status")
    known = inconclusive(known, F.col("error").isNotNull() | status.isNull(), "robots.txt fetch failed", only_absent=False)
    return emit(r, known, *(nothing(o) for o in out))


def observe_like(o: Column, outcome: str, confidence: str, score: float, value: str, method: str) -> Column:
    return F.struct(o["signal"].alias("signal"), F.lit(outcome).alias("outcome"), F.lit(confidence).alias("confidence"), F.lit(score).alias("confidence_score"), F.lit(value).alias("value_json"), F.lit(method).alias("method"))


def followup_allowed(rows: DataFrame, token: str = TOKEN) -> DataFrame:
    """(run_id, allowed, sitemaps, delay): whether robots.txt lets the scan go on; a missing file allows all, a failure nothing."""
    body = F.when((F.col("status_code") == 200) & F.col("error").isNull() & ~F.coalesce("truncated", F.lit(False)), F.coalesce("body", F.lit("")))
    r = rows.withColumn("r", robots_facts(token, V.AI_AGENTS)(body, F.col("homepage_url")))
    fine = F.col("error").isNull() & ~F.coalesce("truncated", F.lit(False))
    allowed = F.coalesce(F.when(fine & F.col("status_code").isin(404, 410), True).otherwise(F.col("r.allowed")), F.lit(False))
    return r.select("run_id", allowed.alias("allowed"), "r.sitemaps", F.col("r.own_delay").alias("delay"))


def sitemap_signals(rows: DataFrame) -> DataFrame:
    """rows: status_code, body (binary), truncated, error, allowed (robots allow the path)."""
    r = rows.withColumn("s", sitemap_facts(F.when(F.col("status_code") == 200, F.coalesce("body", F.lit("").cast("binary")))))
    status, gone = F.col("status_code"), F.col("status_code").isin(404, 410)
    parsed = (status == 200) & F.col("s.error").isNull()
    field = lambda s, c: F.when(gone, observe(s, F.lit("null"), "no_evidence", 1.0, "no sitemap")).otherwise(certain(s, scalar_json(c), "sitemap XML"))
    out = [
        certain("metadata.sitemap_exists", F.when(gone, "false").otherwise("true"), "HTTP status and XML root"),
        field("metadata.sitemap_document_type", F.col("s.type")),
        field("metadata.sitemap_url_count", F.col("s.urls")),
        field("metadata.sitemap_child_sitemap_count", F.col("s.children")),
    ]
    barred = ~F.coalesce("allowed", F.lit(False))
    broken = F.col("error").isNotNull() | F.coalesce("truncated", F.lit(False)) | status.isNull() | ((status == 200) & ~parsed)
    odd = ~barred & ~broken & ~gone & (status != 200)
    why = F.when(barred, "skipped").otherwise("error")
    out = [inconclusive(o, barred | broken, "sitemap was not read", why, only_absent=False) for o in out]
    out = [F.when(odd, observe_like(o, "no_evidence", "no_evidence", 0.0, "null", "inconclusive status")).otherwise(o) for o in out]
    known = inconclusive(certain("metadata.sitemap_status", scalar_json(status), "HTTP status"), barred | status.isNull(), "no response", why, only_absent=False)
    return emit(r, known, *out)


def llms_signals(rows: DataFrame) -> DataFrame:
    """rows: status_code, error, allowed."""
    status, barred = F.col("status_code"), ~F.coalesce("allowed", F.lit(False))
    why = F.when(barred, "skipped").otherwise("error")
    missing = barred | F.col("error").isNotNull() | status.isNull()
    sure = F.when((status == 200) | status.isin(404, 410), "confirmed").otherwise("no_evidence")
    value = F.when(status == 200, "true").when(status.isin(404, 410), "false").otherwise("null")
    exists = observe("metadata.llms_txt_exists", value, sure, F.when(sure == "confirmed", 1.0).otherwise(0.0), "HTTP status of llms.txt")
    known = certain("metadata.llms_txt_status", scalar_json(status), "HTTP status")
    return emit(rows, *(inconclusive(o, missing, "llms.txt was not fetched", why, only_absent=False) for o in (exists, known)))


# The homepage's response


def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def has_header(name: str) -> Column:
    return F.coalesce(F.map_contains_key("headers", F.lit(name)), F.lit(False))


def flags(*pairs: tuple[Column, str]) -> Column:
    """Sorted names of the conditions that hold."""
    return sorted_set(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs))))


def cookie_prints() -> Column:
    """Recognised cookie names as provider:name; first rule that fits."""
    n = lambda c: F.lower(c)
    rule = lambda c: (
        F.when(n(c).isin("__cf_bm", "cf_clearance", "__cflb"), F.concat(F.lit("cloudflare:"), n(c)))
        .when(n(c).isin("_abck", "ak_bmsc", "bm_sz"), F.concat(F.lit("akamai:"), n(c)))
        .when(n(c) == "datadome", "datadome:datadome")
        .when(n(c).startswith("incap_ses_") | n(c).startswith("visid_incap_"), "imperva:session_cookie")
        .when(n(c).startswith("bigipserver"), "f5:BIGipServer*")
        .when(n(c).rlike("^ts[0-9a-f]+$"), "f5:TS*")
    )
    return sorted_set(F.array_compact(F.transform(F.coalesce("cookie_names", F.array().cast("array<string>")), rule)))


def disposition(status: Column) -> Column:
    return (
        F.when(status == 401, "authentication_required").when(status == 403, "forbidden").when(status == 429, "rate_limited").when(status == 451, "unavailable_for_legal_reasons")
        .when(ok(status), "reachable").when((status >= 400) & (status < 500), "other_client_error").when(status >= 500, "server_error").when(status.isNotNull(), "other_status")
    )


def homepage_signals(rows: DataFrame) -> DataFrame:
    """rows: status_code, final_url, headers, error, allowed."""
    status = F.col("status_code")
    out = [
        certain("human.homepage_accessible", scalar_json(ok(status)), "HTTP status"),
        certain("human.homepage_status", scalar_json(status), "HTTP status"),
        certain("human.homepage_final_url", scalar_json(F.col("final_url")), "last address of the redirects"),
        text_value("human.homepage_content_type", header("content-type"), "Content-Type header"),
    ]
    missing = F.col("error").isNotNull() | status.isNull() | ~F.coalesce("allowed", F.lit(False))
    why = F.when(~F.coalesce("allowed", F.lit(False)), "skipped").otherwise("error")
    return emit(rows, *(inconclusive(o, missing, "homepage was not fetched", why, only_absent=False) for o in out))


def response_signals(rows: DataFrame) -> DataFrame:
    """rows: status_code, http_version, headers (lower-case names), cookie_names, attempts (array with status_code), error, allowed."""
    kept = F.transform_values("headers", lambda _, v: F.left(v, F.lit(2048)))
    r = rows.withColumn("headers", F.coalesce(kept, F.create_map().cast("map<string,string>")))
    status, has = F.col("status_code"), has_header
    challenge = F.lower(header("cf-mitigated")) == "challenge"
    cdn_rules = [
        (has("cf-ray") | has("cf-cache-status"), "cloudflare"),
        (has("x-amz-cf-id"), "amazon_cloudfront"),
        (has("x-akamai-transformed") | has("akamai-grn"), "akamai"),
        (has("x-served-by") & F.lower(header("via")).contains("fastly"), "fastly"),
    ]
    edge_rules = [(challenge, "cloudflare"), (has("x-sucuri-id") | has("x-sucuri-block"), "sucuri"), (has("x-iinfo") | F.lower(header("x-cdn")).contains("imperva"), "imperva"), (has("x-wa-info"), "f5")]
    r = r.withColumns({"_cdn": flags(*cdn_rules), "_prints": cookie_prints()})
    cdn, prints = F.col("_cdn"), F.col("_prints")
    with_prefix = lambda p: F.exists(prints, lambda c: c.startswith(p))
    bots = flags((with_prefix("cloudflare:__cf_bm"), "cloudflare"), *((with_prefix(f"{p}:"), p) for p in ("akamai", "datadome", "imperva")), (with_prefix("f5:TS"), "f5"))
    balancers = flags((F.array_contains(prints, "cloudflare:__cflb"), "cloudflare"), (with_prefix("f5:BIGipServer"), "f5"))
    cache = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("headers", lambda k, _: k.isin(*V.CACHE_HEADERS)))))
    entry = lambda p, s: F.struct(p.alias("provider"), s.alias("status"))
    cached = F.array_compact(F.array(
        F.when(header("cf-cache-status") != "", entry(F.lit("cloudflare"), F.upper(header("cf-cache-status")))),
        F.when(header("x-cache") != "", entry(F.when(F.size(cdn) == 1, F.element_at(cdn, 1)).otherwise("unspecified"), header("x-cache"))),
    ))
    blocked = F.when(challenge, F.struct(F.lit("cloudflare").alias("provider"), F.lit("challenge").alias("type"))).when(has("x-sucuri-block"), F.struct(F.lit("sucuri").alias("provider"), F.lit("block").alias("type")))
    place = F.upper(F.regexp_extract(header("cf-ray"), "-([A-Za-z0-9]{3})$", 1))
    h3 = header("alt-svc").rlike(r"(?i)(?:^|,)\s*h3(?:-[0-9]+)?\s*=")
    locked = (status == 401) | has("www-authenticate")
    tried = lambda s: F.exists(F.coalesce("attempts", F.array(F.struct(status.alias("status_code")))), lambda a: F.coalesce(a["status_code"] == s, F.lit(False)))
    security = F.array_sort(F.array_intersect(F.map_keys("headers"), lit_array(V.SECURITY_HEADERS)))
    edge = flags(*cdn_rules, *edge_rules)
    r = r.withColumns({"_bots": bots, "_balancers": balancers, "_cache": cache, "_cached": cached, "_security": security, "_edge": edge, "_place": place, "_blocked": blocked})
    bots, balancers, cache, cached, security, edge, place, blocked = (F.col(c) for c in ("_bots", "_balancers", "_cache", "_cached", "_security", "_edge", "_place", "_blocked"))
    true_or_null = lambda c: F.when(F.coalesce(c, F.lit(False)), "true").otherwise("null")
    likely, possible = ("likely", 0.8), ("possible", 0.6)
    out = [
        text_value("network.http_version", F.col("http_version"), "protocol of the response"),
        certain("infrastructure.response_headers", nested_json(F.map_from_entries(F.array_sort(F.map_entries("headers")))), "kept response headers"),
        text_value("infrastructure.server_header", header("server"), "Server header"),
        list_value("infrastructure.security_headers", security, "browser security headers"),
        seen("infrastructure.cache_headers", F.size(cache) > 0, nested_json(cache), "cache headers"),
        list_value("infrastructure.cdn_hints", cdn, "headers of providers; not proof", *likely),
        list_value("infrastructure.cdn", cdn, "headers of providers; attribution is probable", *likely),
        list_value("infrastructure.edge_response_hints", edge, "edge headers of providers", *likely),
        list_value("infrastructure.waf", flags((challenge, "cloudflare"), (has("x-sucuri-block"), "sucuri")), "challenge or block headers", *likely),
        seen("infrastructure.challenge_response", blocked.isNotNull(), nested_json(blocked), "challenge or block header"),
        list_value("infrastructure.cache_status", cached, "cache result of providers"),
        seen("infrastructure.edge_location_hints", place != "", F.when(place != "", nested_json(F.create_map(F.lit("cloudflare"), place))).otherwise("{}"), "suffix of the request id", *likely),
        seen("infrastructure.http3_advertised", h3, true_or_null(h3), "h3 in Alt-Svc"),
        text_value("infrastructure.content_encoding", header("content-encoding"), "Content-Encoding header"),
        list_value("infrastructure.response_cookie_fingerprints", prints, "names of cookies", *possible),
        list_value("infrastructure.bot_management_hints", bots, "names of cookies", *possible),
        list_value("infrastructure.load_balancer_hints", balancers, "names of cookies", *possible),
        list_value("infrastructure.acceleration_hints", flags((has("x-wa-info"), "f5_big_ip")), "acceleration header", *likely),
        certain("human.http_access_disposition", scalar_json(disposition(status)), "HTTP status class"),
        seen("human.authentication_challenge", locked, scalar_json(locked), "HTTP 401 or WWW-Authenticate"),
        seen("human.login_required", locked, true_or_null(locked), "HTTP authentication challenge"),
        certain("human.rate_limited", scalar_json(tried(429)), "HTTP 429 in any attempt"),
        seen("human.geographic_restriction", tried(451), F.when(tried(451), '{"detected":true,"status":451}').otherwise("null"), "HTTP 451 in any attempt", *possible),
        seen("preservation.cache_header_hints", F.size(cache) > 0, nested_json(cache), "cache headers"),
    ]
    why = F.when(~F.coalesce("allowed", F.lit(False)) & F.col("error").isNull(), "skipped").otherwise("error")
    missing = F.col("error").isNotNull() | status.isNull()
    r = r.withColumns({"_why": why, "_missing": missing})
    return emit(r, *out, judge=unless(F.col("_missing"), "the homepage gave no response", F.col("_why")))


# The homepage's markup


def with_page_facts(rows: DataFrame) -> DataFrame:
    """``rows`` (status_code, final_url, origin, headers, body, error, truncated, allowed) with facts of 2xx HTML pages, parsed once."""
    html = F.lower(header("content-type")).rlike("^(text/html|application/xhtml)") & (F.col("status_code") >= 200) & (F.col("status_code") < 300) & F.col("error").isNull()
    body = F.when(html, F.col("body").cast("string"))
    read = rows.withColumn("_read", page_facts(body, F.coalesce("final_url", "origin")))
    return read.withColumns({"page": F.col("_read.page"), "ld": F.col("_read.ld"), "is_page": F.coalesce(html, F.lit(False))}).drop("_read")


def judged(pages: DataFrame, out: list[Column]) -> DataFrame:
    """The observations of each page. Absences on cut-off pages are errors; without a page all is skipped or error."""
    why = missing_page(F.col("status_code"), F.col("error"), F.col("allowed"))

    def judge(o: Column) -> Column:
        none, cut = ~F.col("is_page"), F.coalesce("truncated", F.lit(False)) & (o["outcome"] == "no_evidence")
        pick = lambda field, absent, broken: F.when(none, absent).when(cut, broken).otherwise(o[field]).alias(field)
        return F.struct(
            o["signal"].alias("signal"),
            pick("outcome", why, "error"),
            pick("confidence", "unknown", "unknown"),
            pick("confidence_score", 0.0, 0.0),
            pick("value_json", "null", "null"),
            pick("method", "there was no homepage markup", "the page was cut off; absence can't be told"),
        )

    return emit(pages, *out, judge=judge)


def interface_candidate(link: Column) -> Column:
    parts = F.filter(F.split(F.lower(link["path"]), "/"), lambda p: p != "")
    named = F.exists(parts, lambda p: any_of((p == n) | p.startswith(f"{n}-") | p.startswith(f"{n}.") for n in V.INTERFACE_NAMES))
    known = (F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(-2)) == ".well-known") & F.try_element_at(parts, F.lit(-1)).isin(*V.INTERFACE_FILES)
    return F.arrays_overlap(link["rels"], lit_array(V.INTERFACE_RELS)) | F.coalesce(link["type"].isin(*V.INTERFACE_TYPES), F.lit(False)) | F.coalesce(known, F.lit(False)) | named


def first_of_each_url(pages: DataFrame, *columns: str) -> DataFrame:
    """Of the links in each column those with an address, the first of each address, in order. Sorted by address: a page of n links takes n log n steps."""
    sorted_ = {c: f"{c}_by_url" for c in columns}
    by_url = lambda c: F.array_sort(F.filter(F.transform(c, lambda x, i: F.struct(x["url"].alias("url"), i.alias("at"))), lambda x: x["url"].isNotNull()))
    heads = lambda c: F.filter(c, lambda x, i: ~x["url"].eqNullSafe(F.get(c, i - 1)["url"]))
    firsts = lambda c, by: F.transform(F.array_sort(F.transform(heads(by), lambda x: x["at"])), lambda at: F.get(c, at))
    pages = pages.withColumns({by: by_url(c) for c, by in sorted_.items()})
    return pages.withColumns({c: firsts(c, by) for c, by in sorted_.items()}).drop(*sorted_.values())


def marked(link: Column, path: str, markers: tuple[str, ...]) -> Column:
    text = F.replace(F.lower(F.concat_ws(" ", link[path], link["text"])), F.lit("_"), F.lit("-"))
    return any_of(has_marker(text, m) for m in markers)


def metadata_signals(pages: DataFrame) -> DataFrame:
    """pages: the result of ``with_page_facts``."""
    links = F.col("page.links")
    rel = lambda r, extra=None: F.filter(links, lambda x: (x["tag"] == "link") & F.array_contains(x["rels"], r) & (extra(x) if extra else F.lit(True)))
    first = lambda a: F.try_element_at(F.filter(F.transform(a, lambda x: x["url"]), lambda u: u.isNotNull()), F.lit(1))
    feeds = sorted_set(F.array_compact(F.transform(rel("alternate", lambda x: x["type"].isin(*V.FEED_TYPES)), lambda x: x["url"])))
    interfaces = F.transform("_candidates", lambda x: F.struct(x["rels"].alias("rel"), x["tag"].alias("tag"), x["type"].alias("type"), x["url"].alias("url")))
    kind = lambda words: sorted_set(F.transform(F.filter("_candidates", lambda x: any_of(F.lower(F.concat_ws(" ", x["url"], F.coalesce(x["type"], F.lit("")))).contains(w) for w in words)), lambda x: x["url"]))
    anchors = F.filter("page.anchors", lambda x: any_of(marked(x, "path", m) for m in V.LINK_MARKERS.values()))
    named = lambda m: F.filter("_anchors", lambda x: x["url"].isNotNull() & marked(x, "url_path", m))
    label = lambda c: F.transform(c, lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url")))
    # Step by step: a column that is read more than once is computed once, and no expression is copied into others.
    kinds, groups = {f"_k{i}": s for i, s in enumerate(V.INTERFACE_MARKERS)}, {f"_m{i}": s for i, s in enumerate(V.LINK_MARKERS)}
    pages = pages.withColumns({"_candidates": F.filter(links, interface_candidate), "_anchors": anchors})
    pages = first_of_each_url(pages.withColumns({c: named(V.LINK_MARKERS[s]) for c, s in groups.items()}), "_candidates", *groups)
    pages = pages.withColumns({"_interfaces": interfaces, "_feeds": feeds, **{c: kind(V.INTERFACE_MARKERS[s]) for c, s in kinds.items()}, **{c: label(c) for c in groups}})
    metas, has_ld = F.col("page.metas"), F.col("page.has_ld")
    generator = F.try_element_at(F.filter(F.transform(F.filter(metas, lambda m: m["name"] == "generator"), lambda m: m["content"]), lambda c: c.isNotNull()), F.lit(1))
    graph = F.exists(metas, lambda m: m["property"].startswith("og:"))
    types = observe("metadata.json_ld_types", nested_json(F.col("ld.types")), F.when(F.col("ld.parsed"), "confirmed").when(has_ld, "unknown").otherwise("no_evidence"), F.when(has_ld & ~F.col("ld.parsed"), 0.0).otherwise(1.0), "JSON-LD types")
    opensearch = first(rel("search", lambda x: x["type"] == V.OPENSEARCH_TYPE))
    out = [
        seen("metadata.json_ld", has_ld, scalar_json(has_ld), "JSON-LD script"),
        types,
        seen("metadata.open_graph", graph, scalar_json(graph), "Open Graph property"),
        list_value("metadata.feeds", F.col("_feeds"), "alternate links of feed types"),
        text_value("metadata.html_title", F.col("page.title"), "title element"),
        text_value("metadata.html_language", F.col("page.lang"), "lang of html"),
        text_value("metadata.canonical_url", first(rel("canonical")), "canonical link"),
        text_value("metadata.generator", generator, "generator meta"),
        text_value("metadata.web_manifest_url", first(rel("manifest")), "manifest link"),
        text_value("metadata.opensearch_url", opensearch, "search description link"),
        list_value("agent.interface_links", F.col("_interfaces"), "service relations and named links; not fetched", "possible", 0.6),
        *(list_value(s, F.col(c), "named link; not fetched", "possible", 0.6) for c, s in kinds.items()),
        *(list_value(s, F.col(c), "named homepage link", "possible", 0.6) for c, s in groups.items()),
    ]
    return judged(pages, out)


def page_signals(pages: DataFrame) -> DataFrame:
    """pages: the result of ``with_page_facts``. Markers of paywalls, consent, CAPTCHAs, scripting, licences, subscriptions."""

    def markers(kind: str) -> list[tuple[Column, str]]:
        dom = lambda w: F.exists("page.marks", lambda m: has_bounded_marker(m, w))
        resource = lambda w: F.exists("page.sources", lambda s: s.contains(w))
        return [(dom(w), f"dom:{w}") for w in V.DOM_MARKERS[kind]] + [(resource(w), f"resource:{w}") for w in V.RESOURCE_MARKERS[kind]]

    def detection(signal: str, found: Column, sure: Column, method: str) -> Column:
        some = F.size(found) > 0
        value = F.when(some, nested_json(F.struct(F.lit(True).alias("detected"), found.alias("markers")))).otherwise("null")
        return observe(signal, value, F.when(~some, "no_evidence").when(sure, "likely").otherwise("possible"), F.when(~some, 1.0).when(sure, 0.8).otherwise(0.6), method)

    # Fixed value: wording that tells visitors to switch scripting on.
    script = F.col("page.noscript").rlike(r"(?iu)\b(?:enable|turn on) javascript\b|\bjavascript (?:is )?required\b|\brequires javascript\b")
    paid = F.array_contains("ld.free", False)
    licences = F.slice(sorted_set(F.concat("page.licence_urls", "ld.licences")), 1, 50)
    subscription = F.exists("ld.subscription", lambda x: x)
    pages = pages.withColumns({
        "_paywall": flags(*markers("paywall"), (paid, "jsonld:isAccessibleForFree=false")),
        "_consent": flags(*markers("cookie_wall")),
        "_captcha": flags(*markers("captcha")),
        "_script": flags((script, "noscript:javascript-required")),
        "_licences": licences,
    })
    out = [
        detection("human.paywall_detected", F.col("_paywall"), F.coalesce(paid, F.lit(False)), "paywall declaration or marker"),
        detection("human.cookie_wall_detected", F.col("_consent"), F.lit(False), "consent marker"),
        detection("human.captcha_detected", F.col("_captcha"), F.lit(False), "CAPTCHA marker"),
        detection("human.javascript_required", F.col("_script"), F.lit(True), "noscript instruction"),
        list_value("legal.license", F.col("_licences"), "licence link or declaration"),
        seen("economic.subscription_required", F.size("ld.subscription") > 0, F.when(F.size("ld.subscription") > 0, scalar_json(subscription)).otherwise("null"), "requiresSubscription declaration"),
    ]
    return judged(pages, out)


# Policy texts

# Names of rules and the wording they match, in one line of collapsed text. Each pattern stands whole.
RULES = {
    "legal.scraping_restrictions": {
        "automated_access_prohibited": r"\b(?:you|users?|visitors?)\s+(?:may|must|shall|can)\s+not\b.{0,160}\b(?:scrap(?:e|ing)|crawl(?:er|ing)?|spider(?:ing)?|automated (?:means|access|collection|extraction))\b",
        "scraping_prohibited": r"\b(?:scrap(?:e|ing)|web craw(?:l|ling|lers?)|automated (?:access|collection|extraction))\b.{0,100}\b(?:is|are)\s+(?:strictly )?(?:prohibited|forbidden|not permitted)\b",
        "automated_tools_prohibited": r"\b(?:do not|don't)\s+(?:use|deploy)\b.{0,100}\b(?:robots?|spiders?|scrapers?|crawlers?|automated (?:means|tools?))\b",
        "automated_access_requires_permission": r"\b(?:access|collect|extract|download)\b.{0,100}\b(?:robots?|spiders?|scrapers?|crawlers?|automated means)\b.{0,100}\bwithout\b.{0,60}\b(?:permission|consent)\b",
    },
    "legal.ai_restrictions": {
        "ai_training_prohibited": r"\b(?:you|users?|third parties)\s+(?:may|must|shall|can)\s+not\b.{0,80}\b(?:use|copy|collect|extract)\b.{0,100}\b(?:to|for)\b.{0,40}\b(?:train|training|develop|developing|improve|improving|fine[- ]?tune|fine[- ]?tuning)\b.{0,100}\b(?:artificial intelligence|machine learning|generative (?:artificial intelligence|ai)|large language models?|llms?|ai models?)\b",
        "ai_use_prohibited": r"\b(?:you|users?|third parties)\s+(?:may|must|shall|can)\s+not\b.{0,80}\b(?:use|copy|collect|extract)\b.{0,100}\b(?:to|for)\b.{0,40}\b(?:artificial intelligence|machine learning|generative (?:artificial intelligence|ai)|large language models?|llms?|ai models?)\b.{0,40}\b(?:train|training|develop|developing|improve|improving|fine[- ]?tune|fine[- ]?tuning)\b",
        "content_ai_training_prohibited": r"\b(?:content|materials?|data)\s+(?:may|must|shall|can)\s+not\s+be\s+used\b.{0,140}\b(?:artificial intelligence|machine learning|generative (?:artificial intelligence|ai)|large language models?|llms?|ai training)\b",
        "ai_training_explicitly_prohibited": r"\b(?:ai|artificial intelligence|machine learning|model)\s+training\b.{0,80}\b(?:is|are)\s+(?:strictly )?(?:prohibited|forbidden|not permitted)\b",
    },
    "registration_required": {
        "registration_required": r"\b(?:registration|an? (?:user )?account|signing up)\s+(?:is|are)\s+(?:required|mandatory)\b|\b(?:you|users?)\s+(?:must|are required to)\s+(?:register|create an account|sign up)\b|\b(?:access|use)\b.{0,60}\brequires?\s+(?:registration|an account|signing up)\b",
    },
    "registration_not_required": {
        "registration_not_required": r"\bno (?:registration|account|sign[- ]?up)\s+(?:is )?required\b|\b(?:access|use|browse)\b.{0,80}\bwithout\s+(?:registration|an account|signing up)\b",
    },
    "economic.metering": {
        "periodic_limit": r"\b(?:up to|includes?|limited to|allows?)\s+\d[\d,]*(?:\.\d+)?\s+(?:articles?|requests?|api calls?|calls?|queries|credits?|tokens?)\s+(?:per|/)\s+(?:second|minute|hour|day|week|month|year)\b",
        "explicit_quota": r"\b(?:daily|monthly|annual|hourly)\s+(?:limit|quota)\s+(?:of|is)\s+\d[\d,]*(?:\.\d+)?\s+(?:articles?|requests?|api calls?|calls?|queries|credits?|tokens?)\b",
        "metered_access": r"\bmetered\s+(?:access|plan|usage|billing)\b",
    },
}
API_PRICES = (
    r"\bapi(?: access| plan| usage)?\b.{0,50}\b(?:costs?|is priced at|starts? at|from)\s*((?:US\$|USD|EUR|GBP|\$|€|£)\s?\d[\d,]*(?:\.\d{1,2})?(?:\s*(?:per|/)\s*(?:request|call|credit|month|year))?)",
    r"((?:US\$|USD|EUR|GBP|\$|€|£)\s?\d[\d,]*(?:\.\d{1,2})?(?:\s*(?:per|/)\s*(?:request|call|credit|month|year))?).{0,60}\b(?:for|includes?)\b.{0,40}\bapi(?: access| usage| plan| calls?)\b",
)
API_FREE = r"(?:\bapi (?:access|usage|plan)\s+(?:is|are)\s+free\b|\bfree api (?:access|usage|plan)\b|\bfree (?:tier|plan) for (?:the )?api\b)"
API_SALES = r"(?:\bapi (?:pricing|access|plan)\b.{0,50}\bcontact sales\b|\bcontact sales (?:for|about) (?:our |the )?api\b)"
DECLARATION = "array<struct<detail: string, rule: string, source_url: string>>"


# Of each rule, what its matches contain at least one of (in lower case): texts without them skip the pattern.
SCRAPING, AI, ACCOUNT = ("scrap", "crawl", "spider", "automated", "robot"), ("artificial intelligence", "machine learning", "ai", "language model", "llm", "model training"), ("registration", "account", "sign", "register")
CUES = {
    "automated_access_prohibited": SCRAPING,
    "scraping_prohibited": (*SCRAPING, "web craw"),
    "automated_tools_prohibited": SCRAPING,
    "automated_access_requires_permission": ("without",),
    "ai_training_prohibited": AI,
    "ai_use_prohibited": AI,
    "content_ai_training_prohibited": AI,
    "ai_training_explicitly_prohibited": AI,
    "registration_required": ACCOUNT,
    "registration_not_required": ACCOUNT,
    "periodic_limit": ("up to", "include", "limited", "allow"),
    "explicit_quota": ("limit", "quota"),
    "metered_access": ("metered",),
}


def flagged(pattern: str) -> str:
    """Case-insensitive over Unicode, as the patterns are meant."""
    return f"(?iuU){pattern}"


def declarations(texts: DataFrame) -> DataFrame:
    """From (run_id, position, source_url, text): every declaration of every text, (run_id, topic, position, n, rule, source_url, detail)."""
    # Upper, then lower case: letters that patterns take for others of the same case are folded to those.
    texts = texts.select("run_id", "position", "source_url", squeeze(F.col("text"), 200_000).alias("_text")).withColumn("_lower", F.lower(F.upper("_text")))
    text, none = F.col("_text"), F.lit(None).cast("string")
    some = lambda cues: any_of(F.col("_lower").contains(c) for c in cues)
    item = lambda topic, rule, detail: F.struct(F.lit(topic).alias("topic"), F.lit(rule).alias("rule"), detail.alias("detail"))

    def declared(topic: str, rule: str):  # noqa: ANN202
        return lambda m: F.when(m.isNotNull(), item(topic, rule, F.left(m, F.lit(160)) if topic == "economic.metering" else none))

    found = []
    for topic, rules in RULES.items():
        for rule, pattern in rules.items():
            # One search: the match itself, empty if there is none.
            match = F.nullif(F.regexp_extract(text, flagged(f"({pattern})"), 1), F.lit(""))
            one = F.filter(F.transform(F.array(match), declared(topic, rule)), lambda x: x.isNotNull())
            found.append(F.when(some(CUES[rule]), one))
    price = lambda p: F.transform(F.regexp_extract_all(text, F.lit(flagged(p)), F.lit(1)), lambda d: item("economic.api_pricing", "api_price", F.left(d, F.lit(80))))
    plain = lambda p, r: F.when(text.rlike(flagged(p)), F.array(item("economic.api_pricing", r, none)))
    api = some(("api",))
    found += [*(F.when(api, price(p)) for p in API_PRICES), F.when(api, plain(API_FREE, "free_tier")), F.when(api, plain(API_SALES, "contact_sales"))]
    rows = texts.withColumn("d", F.flatten(F.array_compact(F.array(*found))))
    # An outer explode: an inner one is given a filter on its size, which copies all of the expressions above.
    every = rows.select("run_id", "position", "source_url", F.posexplode_outer("d").alias("n", "d")).where("d is not null")
    return every.select("run_id", "position", "n", "source_url", "d.topic", "d.rule", "d.detail")


def best_candidates(pages: DataFrame) -> DataFrame:
    """(run_id, url, score, scope): the best policy and the best economic link of each page; one address for both merges them.

    A page's links are an array of at most 100 candidates, so ranking stays inside the row.
    """
    text = lambda x, p: F.lower(F.concat_ws(" ", x[p], x["text"]))
    links = F.slice(F.filter("page.anchors", lambda x: (policy_score(text(x, "path")) > 0) | (economic_score(text(x, "path")) > 0)), 1, 100)
    rows = pages.select("run_id", F.coalesce("final_url", "origin").alias("base"), F.explode(links).alias("x")).where("x.url is not null")
    rows = rows.where(same_site(host_of(F.col("x.url")), host_of(F.col("base"))))
    clean = F.regexp_replace(F.regexp_replace("x.url", "#.*$", ""), r"^([a-zA-Z]+://[^/?]+)($|\?)", "$1/$2")
    scored = rows.select("run_id", clean.alias("url"), policy_score(text(F.col("x"), "url_path")).alias("policy"), economic_score(text(F.col("x"), "url_path")).alias("economic"))
    kinds = scored.select("run_id", "url", F.inline(F.array(F.struct(F.lit("legal").alias("scope"), F.col("policy").alias("score")), F.struct(F.lit("economic").alias("scope"), F.col("economic").alias("score"))))).where("score > 0")
    best = kinds.groupBy("run_id", "scope").agg(F.min_by(F.struct("url", "score"), F.struct((-F.col("score")).alias("s"), F.col("url").alias("u"))).alias("b"))
    return best.groupBy("run_id", "b.url").agg(F.max("b.score").alias("score"), F.array_sort(F.collect_set("scope")).alias("scope"))


def policy_signals(pages: DataFrame, texts: DataFrame, issues: DataFrame) -> DataFrame:
    """pages: ``with_page_facts``. texts: (run_id, position, source_url, text) of homepage and documents.
    issues: (run_id, signal, outcome) of texts that were skipped or failed; an issue replaces only an absence, error over skipped."""
    first = declarations(texts).groupBy("run_id", "topic", "rule", "source_url", "detail").agg(F.min(F.struct("position", "n")).alias("at"))
    item = F.struct("at", F.struct("detail", "rule", "source_url").alias("d"))
    lists = first.groupBy("run_id").pivot("topic", [*RULES, "economic.api_pricing"]).agg(F.slice(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["d"]), 1, 10))
    worst = issues.groupBy("run_id").pivot("signal", POLICY_SIGNALS).agg(F.max(F.when(F.col("outcome") == "error", "2error").otherwise("1skipped")))
    worst = worst.select("run_id", *(F.substring(F.col(f"`{s}`"), 2, 9).alias(f"issue_{i}") for i, s in enumerate(POLICY_SIGNALS)))
    lists = lists.select("run_id", *(F.col(f"`{t}`").alias(f"d_{i}") for i, t in enumerate([*RULES, "economic.api_pricing"])))
    rows = pages.select("run_id", "status_code", "error", "allowed", "is_page").join(lists, "run_id", "left").join(worst, "run_id", "left")
    d = {t: F.coalesce(F.col(f"d_{i}"), F.array().cast(DECLARATION)) for i, t in enumerate([*RULES, "economic.api_pricing"])}
    listed = lambda s: seen(s, F.size(d[s]) > 0, F.when(F.size(d[s]) > 0, F.to_json(F.struct(d[s].alias("declarations"), F.lit(True).alias("detected")))).otherwise("null"), "explicit public declaration")
    yes, no = F.size(d["registration_required"]) > 0, F.size(d["registration_not_required"]) > 0
    registration = observe("economic.registration_required", F.when(yes & no, "null").when(yes, "true").when(no, "false").otherwise("null"), F.when(yes & no, "unknown").when(yes | no, "confirmed").otherwise("no_evidence"), F.when(yes & no, 0.0).otherwise(1.0), "explicit registration declaration")
    out = [registration if s == "economic.registration_required" else listed(s) for s in POLICY_SIGNALS]
    out = [inconclusive(o, F.col(f"issue_{i}").isNotNull(), "public text was not analysed completely", F.col(f"issue_{i}")) for i, o in enumerate(out)]
    why = missing_page(F.col("status_code"), F.col("error"), F.col("allowed"))
    return emit(rows, *(inconclusive(o, ~F.col("is_page"), "there was no homepage markup", why, only_absent=False) for o in out))


POLICY_SIGNALS = ["legal.scraping_restrictions", "legal.ai_restrictions", "economic.registration_required", "economic.metering", "economic.api_pricing"]


# Renderings, archives, repeat requests, attempts


def browser_signals(rows: DataFrame) -> DataFrame:
    """rows: render (struct or null), enabled, allowed, and the HTTP homepage's status_code, final_url, requested_url, error, body, fetched."""
    r = lambda f: F.col(f"render.{f}")
    there = F.col("error").isNull() & F.col("status_code").isNotNull()
    http_url = F.coalesce("final_url", "requested_url")
    chars = F.length(F.col("body").cast("string"))
    known = lambda c: F.when(there, c)
    compared = F.struct(
        known(ok(F.col("status_code")) != F.coalesce(ok(r("status_code")), F.lit(False))).alias("access_disposition_changed"), r("final_url").alias("browser_final_url"), r("status_code").alias("browser_status"),
        known(r("document_chars") - chars).alias("document_char_delta"), known(http_url != r("final_url")).alias("final_url_changed"), there.alias("http_available"), known(chars).alias("http_document_chars"),
        http_url.alias("http_final_url"), F.col("status_code").alias("http_status"), r("document_chars").alias("rendered_document_chars"), known(~F.col("status_code").eqNullSafe(r("status_code"))).alias("status_changed"),
    )
    alone = F.struct(r("final_url").alias("browser_final_url"), r("status_code").alias("browser_status"), F.lit(False).alias("http_available"), r("document_chars").alias("rendered_document_chars"))
    difference = F.when(F.coalesce("fetched", F.lit(False)), nested_json(compared)).otherwise(nested_json(alone))
    navigation = F.struct(F.coalesce(ok(r("status_code")), F.lit(False)).alias("accessible"), r("final_url").alias("final_url"), r("status_code").alias("status"))
    document = F.struct(r("document_chars").alias("document_chars"), r("title").alias("title"), r("visible_text_chars").alias("visible_text_chars"))
    network = F.struct(r("blocked_request_count").alias("blocked_requests"), r("request_count").alias("requests"), r("third_party_request_count").alias("third_party_requests"), r("total_response_bytes").alias("transferred_response_bytes"))

    def marker(kind: str) -> Column:
        found = F.coalesce(F.try_element_at(r("markers"), F.lit(kind)), F.array().cast("array<string>"))
        value = F.when(F.size(found) > 0, nested_json(F.struct(found.alias("selectors"), F.lit(True).alias("visible")))).otherwise("null")
        return seen(f"human.browser_{kind}_marker_visible", F.size(found) > 0, value, "visible selector", "likely", 0.9)

    out = [
        certain("crawler.browser_http_difference", difference, "HTTP response against rendering"),
        certain("browser.navigation", nested_json(navigation), "navigation without interaction"),
        certain("browser.rendered_document", nested_json(document), "rendered document"),
        certain("browser.network_summary", nested_json(network), "request gate and counters"),
        *(marker(k) for k in ("login", "paywall", "cookie_wall", "captcha")),
    ]
    barred = ~(F.coalesce("enabled", F.lit(False)) & F.coalesce("allowed", F.lit(False)))
    why = F.when(barred, "skipped").otherwise("error")
    return emit(rows, *(inconclusive(o, barred | F.col("render").isNull(), "no rendering", why, only_absent=False) for o in out))


def archive_captures(body: Column) -> Column:
    """Sorted distinct timestamps of an archive index answer (rows of strings under a header); null if any row is malformed."""
    table = F.from_json(body, "array<array<string>>", {"mode": "PERMISSIVE"})
    at = F.array_position(F.try_element_at(table, F.lit(1)), "timestamp")
    values = F.transform(F.slice(table, 2, 1_000_000), lambda row: F.try_element_at(row, at.cast("int")))
    fine = F.forall(values, lambda v: F.coalesce(v.rlike("^[0-9]{14}$") & F.try_to_timestamp(v, F.lit("yyyyMMddHHmmss")).isNotNull(), F.lit(False)))
    return F.when(F.size(table) == 0, F.array().cast("array<string>")).when((at > 0) & fine, sorted_set(values))


def archive_signals(rows: DataFrame, cap: int = 120) -> DataFrame:
    """rows: enabled, status_code, body, truncated, error of the archive index."""
    body = F.col("body").cast("string")
    captures = archive_captures(body)
    blocked = any_of(F.lower(body).contains(p) for p in V.ARCHIVE_BLOCKS)
    n, status = F.size(captures), F.col("status_code")
    coverage = F.struct(F.when(n > 0, F.array_min(captures)).alias("earliest_sampled_capture"), (n > 0).alias("homepage_captured"), F.when(n > 0, F.array_max(captures)).alias("latest_sampled_capture"), n.alias("monthly_capture_samples"), (n >= cap).alias("sample_capped"))
    odd = F.coalesce(blocked, F.lit(False)) | (status != 200)
    covered = observe("preservation.archive_coverage", F.when(odd, "null").otherwise(nested_json(coverage)), F.when(odd, "no_evidence").otherwise("confirmed"), F.when(odd, 0.0).otherwise(1.0), "monthly captures of the homepage")
    told = observe(
        "preservation.archive_blocked", F.when(blocked, "true").when((status == 200) & (n > 0), "false").otherwise("null"),
        F.when(blocked, "likely").when((status == 200) & (n > 0), "confirmed").otherwise("no_evidence"), F.when(blocked, 0.9).when((status == 200) & (n > 0), 1.0).otherwise(0.0), "exclusion text or captures",
    )
    off = ~F.coalesce("enabled", F.lit(False))
    failed = off | F.col("error").isNotNull() | F.coalesce("truncated", F.lit(False)) | status.isNull() | ((status == 200) & ~F.coalesce(blocked, F.lit(False)) & captures.isNull())
    return emit(rows, *(inconclusive(o, failed, "no archive lookup", F.when(off, "skipped").otherwise("error"), only_absent=False) for o in (covered, told)))


def cache_signals(rows: DataFrame) -> DataFrame:
    """rows: enabled, allowed, and two structs base and repeat (status_code, headers, sha256, truncated, error, attempts, final_url)."""
    b, r = (lambda f: F.col(f"base.{f}")), (lambda f: F.col(f"repeat.{f}"))
    validator = F.when(F.try_element_at(b("headers"), F.lit("etag")).isNotNull(), "etag").when(F.try_element_at(b("headers"), F.lit("last-modified")).isNotNull(), "last-modified")
    comparable = ~F.coalesce(b("truncated"), F.lit(False)) & b("sha256").isNotNull() & r("sha256").isNotNull()
    same = F.when(r("status_code") == 304, True).otherwise(F.when(comparable, b("sha256") == r("sha256")))
    result = F.when(r("status_code") == 304, "not_modified").when(same, "full_response_unchanged").when(~same, "full_response_changed").otherwise("full_response_not_comparable")
    value = F.struct(r("status_code").alias("conditional_status"), same.alias("content_unchanged"), result.alias("result"), validator.alias("validator"))
    moved = (F.coalesce(r("attempts"), F.lit(1)) != 1) | ~r("final_url").eqNullSafe(b("final_url"))
    success = (b("status_code") >= 200) & (b("status_code") < 300)
    usable = F.coalesce(success, F.lit(False)) & validator.isNotNull() & ~moved & F.coalesce(r("status_code").isin(200, 304), F.lit(False))
    o = observe("preservation.cache_behavior", F.when(usable, nested_json(value)).otherwise("null"), F.when(usable, "confirmed").otherwise("no_evidence"), F.when(usable, 1.0).otherwise(0.0), "one conditional request")
    barred = ~(F.coalesce("enabled", F.lit(False)) & F.coalesce("allowed", F.lit(False)))
    asked = F.coalesce(success, F.lit(False)) & validator.isNotNull()
    failed = F.col("base").isNull() | b("error").isNotNull() | (asked & (F.col("repeat").isNull() | r("error").isNotNull() | ((r("status_code") == 200) & F.coalesce(r("truncated"), F.lit(False)))))
    return emit(rows, inconclusive(o, barred | failed, "no repeat request", F.when(barred, "skipped").otherwise("error"), only_absent=False))


def attempt_signals(attempts: DataFrame) -> DataFrame:
    """attempts: (run_id, status_code), one row for each HTTP attempt. Without any response the frequencies are unknown, not zero."""
    by_status = attempts.groupBy("run_id", "status_code").agg(F.count("*").alias("n"))
    answered = F.col("status_code").isNotNull()
    runs = by_status.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(answered, F.struct("status_code", "n")))).alias("s"), F.coalesce(F.sum(F.when(answered, F.col("n"))), F.lit(0)).alias("responses"),
        *(F.coalesce(F.sum(F.when(F.col("status_code") == c, F.col("n"))), F.lit(0)).alias(f"n_{c}") for c in (403, 429)),
    )
    some = F.col("responses") > 0
    counts = F.map_from_entries(F.transform("s", lambda e: F.struct(e["status_code"].cast("string"), e["n"])))
    rate = lambda c: F.struct(F.col(f"n_{c}").alias("count"), F.try_divide(F.col(f"n_{c}"), F.col("responses")).alias("rate"), F.col("responses").alias("response_count"))
    return emit(
        runs,
        seen("crawler.http_status_distribution", some, F.when(some, nested_json(counts)).otherwise("null"), "statuses of all responses"),
        *(seen(f"crawler.http_{c}_frequency", some, F.when(some, nested_json(rate(c))).otherwise("null"), f"HTTP {c} among all responses") for c in (403, 429)),
    )
