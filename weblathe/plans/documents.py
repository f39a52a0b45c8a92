"""Queries over documents that are read as rows: robots files, sitemaps and JSON-LD made from the tables' own values, rule tables over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions.tables import LinkedDataNodes, RobotsRules, SitemapEntries
from weblathe.functions.text import lit_array
from weblathe.operators import detectors, rules
from weblathe.plans.corpus import table

# One sentence for each rule of the built-in table, and two that look like it and match none.
DECLARED = (
    "Visitors may not use any crawler here.", "Web crawling is strictly prohibited.", "Please do not deploy any spiders on these pages.", "To collect data by robots without our prior consent is theft.",
    "You may not copy our text for training of large language models.", "Third parties must not extract pages for machine learning or training.", "Our materials may not be used for AI training.", "Model training is forbidden.",
    "Signing up is mandatory.", "No account required.", "The plan includes 1,000 requests per month.", "A daily quota of 50 articles applies.", "We offer metered access.",
    "The API costs $9.50 per month, and API usage from EUR 3 / call.", "Pay USD 20 per month for our API access.", "There is a free tier for the API.", "About API pricing, contact sales.",
    "Robots are described in our articles, free of charge.", "The api of the crawler is documented, as is its account.",
)


def robots_rule_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rules of a robots file for each page: the folders above it are closed to all, its own path is open to two agents."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)", 1)
    parts = F.slice(F.split("path", "/"), 2, F.size(F.split("path", "/")))
    closed = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat(F.lit("Disallow: /"), F.array_join(F.slice("parts", F.lit(1), i), "/")))
    agents = F.concat(F.lit("User-agent: GPTBot\nuser-agent : CCBot\n\nALLOW: "), F.col("path"), F.lit("  # open\nCrawl-delay: "), (F.col("page_id") % 7).cast("string"))
    lines = F.concat(F.array(F.lit("# a note: none"), F.lit("User-agent: *")), closed, F.array(agents, F.concat(F.lit("Sitemap: "), F.col("url"))))
    pages = table(spark, d, "pages").select("page_id", "url", path.alias("path")).where("path <> ''").withColumn("parts", parts)
    made = pages.select("page_id", F.array_join(lines, "\n").alias("body"))
    return made.lateralJoin(RobotsRules(F.col("body").outer())).select("page_id", "line", "agent", "key", "value")


def sitemap_entry_rows(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a sitemap of the addresses that a page links to; every fifth is an index, every seventh is no XML."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    index = F.col("page_id") % 5 == 0
    kind, root = F.when(index, "sitemap").otherwise("url"), F.when(index, "sitemapindex").otherwise("urlset")
    pages = table(spark, d, "pages").select("page_id", links.alias("links"), kind.alias("k"), root.alias("r"))
    day = lambda i: F.when(i % 2 == 0, F.concat(F.lit("<lastmod> 2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise("")
    entry = lambda x, i: F.concat(F.lit("<"), F.col("k"), F.lit(">"), day(i), F.lit("<loc> "), escaped(x), F.lit("\n</loc></"), F.col("k"), F.lit(">"))
    inner = F.array_join(F.transform("links", entry), "<other/>")
    body = F.concat(F.lit("<?xml version='1.0'?><"), F.col("r"), F.lit(' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), inner, F.when(F.col("page_id") % 7 == 0, "<").otherwise(""), F.lit("</"), F.col("r"), F.lit(">"))
    made = pages.select("page_id", body.cast("binary").alias("body"))
    return made.lateralJoin(SitemapEntries(F.col("body").outer())).select("page_id", "position", "kind", "loc", "lastmod")


def linked_data_rows(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a JSON-LD graph for each document: articles by its source, with their author and language."""
    article = lambda i: F.struct(
        F.array(F.lit("Article"), F.col("source")).alias("@type"), i.alias("position"), F.struct(F.lit("Person").alias("@type"), F.col("lang").alias("name")).alias("author"), F.array(F.struct(F.col("lang").alias("name"))).alias("inLanguage")
    )
    graph = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_chars") % 3 + 1), article)
    docs = table(spark, d, "documents")
    made = docs.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "{").otherwise(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), graph.alias("@graph")))).alias("body"))
    nodes = made.lateralJoin(LinkedDataNodes(F.col("body").outer()))
    return nodes.select("doc_id", "node", "parent", "key", F.array_join("types", ",").alias("types"))


def policy_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """All matches of the built-in rule table in the documents, each with one of the declarations at its end."""
    said = F.element_at(lit_array(DECLARED), (F.col("doc_id") % len(DECLARED) + 1).cast("int"))
    texts = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("text"))
    return rules.rule_hits(texts, rules.policy_rules(spark))


QUERIES = {f.__name__: f for f in (robots_rule_rows, sitemap_entry_rows, linked_data_rows, policy_rule_hits)}


def policy_sql() -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    listed = [(topic, rule, pattern, 0) for topic, named in detectors.RULES.items() for rule, pattern in named.items()]
    listed += [("economic.api_pricing", "api_price", pattern, 1) for pattern in detectors.API_PRICES]
    listed += [("economic.api_pricing", "free_tier", detectors.API_FREE, 0), ("economic.api_pricing", "contact_sales", detectors.API_SALES, 0)]
    found = " union all ".join(f"select doc_id, {text(topic)} as topic, {text(rule)} as rule, regexp_extract_all(t, {text('(?i)' + pattern)}, {group}) as m from d" for topic, rule, pattern, group in listed)
    return f"""with d as (select doc_id, coalesce(text, '') || chr(10) || [{", ".join(map(text, DECLARED))}][doc_id % {len(DECLARED)} + 1] as t from documents),
f as ({found}) select doc_id, topic, rule, cast(i - 1 as integer) as n, m[i] as detail from (select *, unnest(range(1, len(m) + 1)) as i from f)"""


SQL = {
    "robots_rule_rows": """with p as (select page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) as path from pages), q as (select *, string_split(path, '/')[2:] as parts from p where path <> ''), r as (select *, cast(len(parts) as integer) as n from q)
select page_id, 2 as line, '*' as agent, 'user-agent' as key, '*' as value from r
union all select page_id, cast(2 + i as integer), '*', 'disallow', '/' || array_to_string(parts[1:i], '/') from (select *, unnest(range(1, n + 1)) as i from r)
union all select page_id, n + 2 + a.i, lower(a.name), 'user-agent', a.name from r, (values (1, 'GPTBot'), (2, 'CCBot')) a(i, name)
union all select page_id, n + 6, a.name, 'allow', path from r, (values ('gptbot'), ('ccbot')) a(name)
union all select page_id, n + 7, a.name, 'crawl-delay', cast(page_id % 7 as varchar) from r, (values ('gptbot'), ('ccbot')) a(name)
union all select page_id, n + 8, null, 'sitemap', regexp_replace(url, '#.*', '') from r""",
    "sitemap_entry_rows": """with p as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as links from pages where page_id % 7 <> 0)
select page_id, cast(i - 1 as integer) as position, case when page_id % 5 = 0 then 'sitemap' else 'url' end as kind, links[i] as loc, case when i % 2 = 1 then '2024-01-' || lpad(cast((i - 1) % 28 + 1 as varchar), 2, '0') end as lastmod from (select *, unnest(range(1, len(links) + 1)) as i from p)""",
    "linked_data_rows": """with d as (select doc_id, lang, source, cast(n_chars % 3 + 1 as integer) as k from documents where doc_id % 11 <> 0), a as (select *, cast(unnest(range(0, k)) as integer) as i from d)
select doc_id, 0 as node, cast(null as integer) as parent, cast(null as varchar) as key, '' as types from d
union all select doc_id, 1 + 3 * i, 0, '@graph', 'Article' || coalesce(',' || source, '') from a
union all select doc_id, 2 + 3 * i, 1 + 3 * i, 'author', 'Person' from a
union all select doc_id, 3 + 3 * i, 1 + 3 * i, 'inLanguage', '' from a""",
    "policy_rule_hits": policy_sql(),
}
