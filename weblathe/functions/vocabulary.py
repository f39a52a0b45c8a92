"""Names and word lists that results depend on. All are fixed values, in their published order."""

# The signal catalog, in catalog order.
SIGNALS = (
    "network.dns_resolved",
    "network.dns_addresses",
    "network.dns_address_count",
    "network.dns_ip_families",
    "network.dns_addresses_truncated",
    "network.dns_canonical_name",
    "network.dns_nameservers",
    "network.dns_soa_primary",
    "network.tls_handshake",
    "network.tls_version",
    "network.tls_cipher",
    "network.tls_certificate_not_before",
    "network.tls_certificate_not_after",
    "network.tls_certificate_issuer",
    "network.tls_certificate_verified",
    "network.http_version",
    "infrastructure.response_headers",
    "infrastructure.server_header",
    "infrastructure.security_headers",
    "infrastructure.cache_headers",
    "infrastructure.cdn_hints",
    "infrastructure.cdn",
    "infrastructure.edge_response_hints",
    "infrastructure.waf",
    "infrastructure.challenge_response",
    "infrastructure.cache_status",
    "infrastructure.edge_location_hints",
    "infrastructure.http3_advertised",
    "infrastructure.content_encoding",
    "infrastructure.response_cookie_fingerprints",
    "infrastructure.bot_management_hints",
    "infrastructure.load_balancer_hints",
    "infrastructure.acceleration_hints",
    "infrastructure.edge_provider",
    "infrastructure.edge_service_hints",
    "infrastructure.dns_provider",
    "infrastructure.hosting_provider",
    "crawler.robots_exists",
    "crawler.robots_status",
    "crawler.user_agents",
    "crawler.ai_specific_user_agents",
    "crawler.ai_homepage_policies",
    "crawler.crawl_delays",
    "crawler.sitemaps",
    "crawler.homepage_policy_allowed",
    "crawler.http_status_distribution",
    "crawler.http_403_frequency",
    "crawler.http_429_frequency",
    "crawler.browser_http_difference",
    "browser.navigation",
    "browser.rendered_document",
    "browser.network_summary",
    "human.homepage_accessible",
    "human.homepage_status",
    "human.homepage_final_url",
    "human.homepage_content_type",
    "human.http_access_disposition",
    "human.authentication_challenge",
    "human.login_required",
    "human.rate_limited",
    "human.geographic_restriction",
    "human.paywall_detected",
    "human.cookie_wall_detected",
    "human.captcha_detected",
    "human.javascript_required",
    "human.browser_login_marker_visible",
    "human.browser_paywall_marker_visible",
    "human.browser_cookie_wall_marker_visible",
    "human.browser_captcha_marker_visible",
    "preservation.cache_header_hints",
    "metadata.sitemap_exists",
    "metadata.sitemap_status",
    "metadata.sitemap_document_type",
    "metadata.sitemap_url_count",
    "metadata.sitemap_child_sitemap_count",
    "metadata.json_ld",
    "metadata.json_ld_types",
    "metadata.open_graph",
    "metadata.feeds",
    "metadata.html_title",
    "metadata.html_language",
    "metadata.canonical_url",
    "metadata.generator",
    "metadata.web_manifest_url",
    "metadata.opensearch_url",
    "agent.interface_links",
    "agent.openapi",
    "agent.graphql",
    "agent.oauth_metadata",
    "agent.mcp",
    "agent.a2a",
    "agent.agent_card",
    "agent.api_documentation",
    "agent.tollbit_gateway",
    "legal.policy_links",
    "legal.license_links",
    "legal.license",
    "legal.scraping_restrictions",
    "legal.ai_restrictions",
    "economic.pricing_links",
    "economic.registration_links",
    "economic.subscription_required",
    "economic.registration_required",
    "economic.metering",
    "economic.api_pricing",
    "preservation.archive_coverage",
    "preservation.archive_blocked",
    "preservation.cache_behavior",
    "metadata.llms_txt_exists",
    "metadata.llms_txt_status",
)

OUTCOMES = ("observed", "no_evidence", "skipped", "error")
CONFIDENCES = ("confirmed", "likely", "possible", "no_evidence", "unknown")
# Crawlers of AI services.
AI_AGENTS = (
    "amazonbot",
    "anthropic-ai",
    "bytespider",
    "ccbot",
    "chatgpt-user",
    "claude-web",
    "cohere-ai",
    "google-extended",
    "gptbot",
    "meta-externalagent",
    "perplexitybot",
)
# Response headers by use.
SECURITY_HEADERS = ("content-security-policy", "permissions-policy", "referrer-policy", "strict-transport-security", "x-content-type-options", "x-frame-options")
CACHE_HEADERS = ("age", "cache-control", "cf-cache-status", "x-cache")
# Host suffixes of providers; a suffix that ends in "-" matches anywhere in the name.
EDGE_SUFFIXES = {
    "akamai": ("edgekey.net", "edgesuite.net", "akamaiedge.net", "akamaized.net"),
    "amazon_cloudfront": ("cloudfront.net",),
    "cloudflare": ("cdn.cloudflare.net", "cloudflare.net"),
    "fastly": ("fastly.net", "fastlylb.net"),
    "imperva": ("incapdns.net",),
    "sucuri": ("cloudproxy.net", "sucuri.net"),
}
DNS_SUFFIXES = {
    "akamai": ("akam.net",),
    "amazon_route_53": ("awsdns-",),
    "azure_dns": ("azure-dns.com", "azure-dns.net", "azure-dns.org", "azure-dns.info"),
    "cloudflare": ("cloudflare.com",),
    "google_cloud_dns": ("googledomains.com",),
    "netlify_dns": ("netlifydns.com",),
    "ns1": ("nsone.net",),
    "vercel_dns": ("vercel-dns.com",),
}
HOSTING_SUFFIXES = {
    "github_pages": ("github.io",),
    "netlify": ("netlify.app", "netlifyglobalcdn.com"),
    "shopify": ("myshopify.com",),
    "squarespace": ("squarespace.com",),
    "vercel": ("vercel-dns.com",),
    "wix": ("wixdns.net",),
    "wordpress_com": ("wordpress.com",),
    "wordpress_vip": ("go-vip.net", "go-vip.co"),
}
# Markers in id and class attributes, and in addresses of resources.
DOM_MARKERS = {
    "paywall": ("metered-content", "paywall", "piano-offer", "subscription-wall", "tp-modal", "zephr-paywall"),
    "cookie_wall": (
        "cookie-banner",
        "cookie-consent",
        "cookie-notice",
        "cybotcookiebotdialog",
        "didomi-host",
        "onetrust-banner-sdk",
        "onetrust-consent-sdk",
        "qc-cmp2-container",
        "usercentrics-root",
    ),
    "captcha": ("cf-turnstile", "g-recaptcha", "h-captcha"),
}
RESOURCE_MARKERS = {
    "paywall": ("cdn.tinypass.com", "experience.tinypass.com", "piano.io", "pelcro.com", "poool.fr", "zephr.com"),
    "cookie_wall": ("consentmanager.net", "cookiebot.com", "cookielaw.org", "didomi.io", "privacy-mgmt.com", "usercentrics.eu"),
    "captcha": ("challenges.cloudflare.com/turnstile", "google.com/recaptcha", "gstatic.com/recaptcha", "hcaptcha.com"),
}
# What names a link of each kind.
LINK_MARKERS = {
    "legal.policy_links": ("acceptable-use", "legal", "privacy", "terms", "tos"),
    "legal.license_links": ("copyright", "license", "licensing"),
    "economic.pricing_links": ("membership", "plans", "pricing", "subscribe", "subscription"),
    "economic.registration_links": ("create-account", "log-in", "login", "register", "sign-up"),
}
INTERFACE_MARKERS = {
    "agent.openapi": ("openapi", "swagger"),
    "agent.graphql": ("graphql",),
    "agent.oauth_metadata": ("oauth", "openid-configuration"),
    "agent.mcp": ("/mcp", "model-context-protocol"),
    "agent.a2a": ("/a2a", "agent2agent"),
    "agent.agent_card": ("agent-card", "agent.json", "/.well-known/agent"),
    "agent.api_documentation": ("api-docs", "developer", "openapi", "swagger"),
}
INTERFACE_NAMES = ("a2a", "api-docs", "graphql", "mcp", "oauth", "oauth2", "openapi", "swagger")
INTERFACE_FILES = ("agent.json", "agent-card.json", "mcp", "mcp.json", "oauth-authorization-server", "openid-configuration")
INTERFACE_RELS = ("service-desc", "service-doc")
INTERFACE_TYPES = ("application/openapi+json", "application/schema+json", "application/vnd.oai.openapi+json")
FEED_TYPES = ("application/atom+xml", "application/feed+json", "application/json", "application/rss+xml")
OPENSEARCH_TYPE = "application/opensearchdescription+xml"
ARCHIVE_BLOCKS = ("blocked site error", "excluded from the wayback machine", "this url has been excluded")
# The sampling frame's categories.
SECTORS = ("academia_research", "commerce", "forums_communities", "general_other", "government_civic", "news_media")
GEOGRAPHIES = ("africa", "americas", "asia", "europe", "global_or_unassigned", "oceania")
BANDS = ("head", "middle", "long_tail")
# Well-known public-suffix rules with more than one label, and private ones; all other
# suffixes are their last label. A full list is a table that operators.suffixes joins.
SUFFIXES = (
    "*.ck",
    "!www.ck",
    "*.kawasaki.jp",
    "!city.kawasaki.jp",
    "k12.ca.us",
    "pvt.k12.ma.us",
    "co.uk",
    "org.uk",
    "gov.uk",
    "ac.uk",
    "me.uk",
    "ltd.uk",
    "plc.uk",
    "net.uk",
    "sch.uk",
    "nhs.uk",
    "co.jp",
    "or.jp",
    "ne.jp",
    "ac.jp",
    "go.jp",
    "com.au",
    "net.au",
    "org.au",
    "edu.au",
    "gov.au",
    "co.nz",
    "org.nz",
    "govt.nz",
    "ac.nz",
    "com.br",
    "org.br",
    "gov.br",
    "net.br",
    "co.in",
    "org.in",
    "gov.in",
    "ac.in",
    "co.kr",
    "or.kr",
    "go.kr",
    "com.cn",
    "org.cn",
    "gov.cn",
    "edu.cn",
    "com.mx",
    "com.ar",
    "com.tr",
    "com.tw",
    "com.hk",
    "com.sg",
    "co.za",
    "org.za",
    "gov.za",
    "co.il",
    "org.il",
    "com.pl",
    "com.ua",
    "github.io",
    "gitlab.io",
    "netlify.app",
    "vercel.app",
    "pages.dev",
    "workers.dev",
    "web.app",
    "firebaseapp.com",
    "herokuapp.com",
    "blogspot.com",
    "myshopify.com",
    "azurewebsites.net",
    "cloudfront.net",
    "appspot.com",
)
