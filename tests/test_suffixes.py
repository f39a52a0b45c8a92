"""Public-suffix rules of any depth, as an expression and as a table, against the published algorithm."""

import random

import pytest
from pyspark.sql import functions as F

from weblathe.functions.urls import registrable_domain
from weblathe.operators import suffixes

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "us", "k12.ma.us", "pvt.k12.ma.us", "*.b.c.d.e", "!x.b.c.d.e"]


def plain(host, rules, unlisted=True):
    """The published algorithm, label by label."""
    labels = host.split(".")
    if labels[-1].isdigit():
        return None
    best, exception = 0, None
    for rule in rules:
        name = rule.lstrip("!").split(".")
        tail = labels[-len(name) :]
        if len(tail) == len(name) and all(a in ("*", b) for a, b in zip(name, tail)):
            if rule.startswith("!"):
                exception = len(name) - 1
            best = max(best, len(name))
    n = exception if exception is not None else best or int(unlisted)
    return ".".join(labels[-n - 1 :]) if 0 < n < len(labels) else None


@pytest.fixture(scope="module")
def hosts(spark):
    rng = random.Random(4)
    endings = [*(r.replace("*.", "").replace("!", "") for r in RULES), "q.ck", "io", "a.b.c.d.e", "127.0.0.1"]
    rows = {".".join([rng.choice("abxq") for _ in range(rng.randrange(0, 4))] + [rng.choice(endings)]) for _ in range(600)}
    return spark.createDataFrame([(h, "mine", "kept") for h in sorted(rows)], "host string, depth string, name string")


@pytest.mark.parametrize("unlisted", [True, False])
def test_table_and_expression_follow_the_published_algorithm(spark, hosts, unlisted):
    rules = suffixes.parse_rules(spark.createDataFrame([(r,) for r in RULES], "rule string"))
    found = suffixes.with_registrable(hosts, "host", rules, unlisted=unlisted).withColumn("other", registrable_domain(F.col("host"), tuple(RULES), unlisted))
    got = {r["host"]: (r["registrable_domain"], r["other"], r["depth"], r["name"]) for r in found.collect()}
    assert len(got) == hosts.count() > 200
    for host, values in got.items():
        want = plain(host, RULES, unlisted)
        assert values == (want, want, "mine", "kept"), host


def test_published_cases(spark):
    cases = {"news.bbc.co.uk": "bbc.co.uk", "www.example.com": "example.com", "project.github.io": "project.github.io", "www.xn--bcher-kva.de": "xn--bcher-kva.de", "localhost": None, "127.0.0.1": None, "a.b.any.ck": "b.any.ck", "www.www.ck": "www.ck", "x.city.kawasaki.jp": "city.kawasaki.jp"}
    df = spark.createDataFrame([(h,) for h in cases], "host string").withColumn("r", registrable_domain(F.col("host")))
    assert {r["host"]: r["r"] for r in df.collect()} == cases


def test_rule_lines_are_cleaned_and_checked(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text("// comment\n\ncom\n  CO.UK \n*.ck trailing words\n!www.ck\nck\nbücher.example\n")
    got = {r["name"]: (r["depth"], r["plain"], r["wildcard"], r["exception"]) for r in suffixes.read_rules(spark, str(path)).collect()}
    assert got == {"com": (1, True, False, False), "co.uk": (2, True, False, False), "ck": (1, True, True, False), "www.ck": (2, False, False, True), "xn--bcher-kva.example": (2, True, False, False)}
    path.write_text("com\na_b\n!ck\n")
    with pytest.raises(Exception, match="not a suffix rule|two labels"):
        suffixes.read_rules(spark, str(path)).collect()
    assert sorted(r["problem"] for r in suffixes.parse_rules(spark.read.text(str(path)).withColumnRenamed("value", "rule")).where("problem is not null").collect()) == ["an exception needs two labels", "not a suffix rule"]


def test_keys_sites_and_no_rules(spark):
    df = spark.createDataFrame([("a.x.co.uk", "b.x.co.uk"), ("co.uk", "x.co.uk"), ("localhost", "localhost"), (None, "a.com")], "a string, b string")
    rules = suffixes.parse_rules(spark.createDataFrame([("co.uk",)], "rule string"))
    assert [r["same_site"] for r in suffixes.with_same_site(df, "a", "b", rules).orderBy(F.col("a").desc_nulls_last()).collect()] == [True, False, True, None]
    none = suffixes.with_registrable(df, "a", rules.where("false"))
    assert {r["a"]: r["registrable_domain"] for r in none.collect()} == {"a.x.co.uk": "co.uk", "co.uk": "co.uk", "localhost": None, None: None}


