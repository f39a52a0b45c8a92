"""Queries over hosts by public-suffix rules: the pages' hosts, moved below suffixes of one to four labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions.text import lit_array
from weblathe.operators import jobs, suffixes
from weblathe.plans.corpus import page_hosts, table

# Rules of every kind and depth, and the names that hosts are moved below (suffixes, parts of them, and none at all).
RULES = (
    "// a list as it is published", "com", "net", "org", "jp", "co.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "uk", "co.uk", "us", "ma.us", "k12.ma.us",
    "pvt.k12.ma.us", "*.compute.cloud.example.net", "github.io // private", "  io", "",
)
ENDINGS = (
    "example.com", "shop.example.net", "co.jp", "city.kawasaki.jp", "x.kawasaki.jp", "kawasaki.jp", "www.ck", "any.ck", "ck", "co.uk", "pvt.k12.ma.us", "k12.ma.us",
    "eu.compute.cloud.example.net", "compute.cloud.example.net", "github.io", "intranet", "lan.local",
)


def moved_hosts(spark: SparkSession, d: str) -> DataFrame:
    """page_id, host: the first labels of a page's host before the ending that its checksum picks."""
    hosts = page_hosts(spark, d)
    pick = F.conv(F.substring(F.md5(F.concat("host", F.col("page_id").cast("string"))), 1, 6), 16, 10).cast("long")
    ending = F.element_at(lit_array(ENDINGS), (pick % len(ENDINGS) + 1).cast("int"))
    labels = F.split("host", r"\.")
    some = F.slice(labels, 1, F.greatest(F.lit(1), F.size(labels) - 2))
    prefix = F.when(pick % 7 > 0, F.concat(F.array_join(some, "."), F.lit("."))).otherwise("")
    return hosts.select("page_id", F.concat(prefix, ending).alias("host"))


def rule_table(spark: SparkSession) -> DataFrame:
    lines = spark.range(1).select(F.explode(lit_array(RULES)).alias("rule"))
    return suffixes.parse_rules(lines).where("problem is null").drop("problem")


def site_domains(spark, d):
    """The registrable domain with and without the rule that an unlisted last label is a suffix."""
    rules = rule_table(spark)
    strict = suffixes.with_registrable(moved_hosts(spark, d), "host", rules, "listed", unlisted=False)
    return suffixes.with_suffix_labels(suffixes.with_registrable(strict, "host", rules), "host", rules, "suffix_labels")


def politeness_groups(spark, d):
    """Pages and bytes by the key that requests are paced by."""
    hosts = moved_hosts(spark, d).join(table(spark, d, "pages").select("page_id", F.octet_length("html").alias("bytes")), "page_id")
    keyed = suffixes.with_politeness_key(hosts, "host", rule_table(spark))
    return keyed.groupBy("politeness_key").agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"), F.sum("bytes").cast("long").alias("bytes"))


def same_site_pages(spark, d):
    """Whether a page and the next one are of one site."""
    hosts = moved_hosts(spark, d)
    after = hosts.select((F.col("page_id") - 1).alias("page_id"), F.col("host").alias("next_host"))
    return suffixes.with_same_site(hosts.join(after, "page_id"), "host", "next_host", rule_table(spark))


def ceased_sites(spark, d):
    """Hosts that a cease list of registrable domains covers."""
    hosts = moved_hosts(spark, d)
    listed = suffixes.with_registrable(hosts.where(F.length("host") % 4 == 0), "host", rule_table(spark)).where("registrable_domain is not null")
    blocked = jobs.cease_matches(hosts.select("host").distinct(), listed.select(F.col("registrable_domain").alias("domain")))
    return hosts.join(blocked, "host", "left").select("page_id", "host", "ceased_by")


QUERIES = {f.__name__: f for f in (site_domains, politeness_groups, same_site_pages, ceased_sites)}


def sites() -> str:
    """Hosts with the labels of their suffix, by longest match over all their endings."""
    listed = [r.split()[0] for r in RULES if r.strip() and not r.startswith("//")]
    rules = ", ".join(f"('{r.removeprefix('*.').removeprefix('!')}', '{r[0] if r[0] in '*!' else ''}')" for r in listed)
    endings = ", ".join(f"'{e}'" for e in ENDINGS)
    return f"""r(name, kind) as (values {rules}),
h0 as (select page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) as host from pages),
h1 as (select *, cast('0x' || substr(md5(host || page_id), 1, 6) as bigint) as pick, string_split(host, '.') as p from h0),
h as (select page_id, case when pick % 7 > 0 then array_to_string(p[1 : greatest(1, len(p) - 2)], '.') || '.' else '' end || [{endings}][pick % {len(ENDINGS)} + 1] as host from h1),
x as (select host, n, n - i + 1 as d, array_to_string(p[i : n], '.') as name from (select *, len(p) as n, unnest(range(1, len(p) + 1)) as i from (select distinct host, string_split(host, '.') as p from h))),
l as (select host, any_value(n) as n, coalesce(max(case when kind = '!' then d - 1 end), max(case when kind = '' then d when kind = '*' and d < n then d + 1 end), 0) as listed from x left join r using (name) group by host),
s as (select host, n, listed, greatest(listed, 1) as any_, string_split(host, '.') as p from l),
reg as (select host, cast(any_ as integer) as suffix_labels, case when n > any_ then array_to_string(p[n - any_ : n], '.') end as registrable_domain, case when listed > 0 and n > listed then array_to_string(p[n - listed : n], '.') end as listed from s)"""


SQL = {
    "site_domains": f"with {sites()} select page_id, host, listed, registrable_domain, suffix_labels from h join reg using (host)",
    "politeness_groups": f"with {sites()} select coalesce(registrable_domain, host) as politeness_key, count(*) as pages, count(distinct host) as hosts, cast(sum(strlen(html)) as bigint) as bytes from h join reg using (host) join pages using (page_id) group by 1",
    "same_site_pages": f"with {sites()} select a.page_id, a.host, b.host as next_host, coalesce(ra.registrable_domain, a.host) = coalesce(rb.registrable_domain, b.host) as same_site from h a join h b on b.page_id = a.page_id + 1 join reg ra on ra.host = a.host join reg rb on rb.host = b.host",
    "ceased_sites": f"with {sites()}, c as (select distinct registrable_domain as domain from h join reg using (host) where length(host) % 4 = 0 and registrable_domain is not null), m as (select q.host, arg_max(domain, length(domain)) as ceased_by from (select distinct host from h) q join c on q.host = domain or ends_with(q.host, '.' || domain) group by q.host) select page_id, host, ceased_by from h left join m using (host)",
}
