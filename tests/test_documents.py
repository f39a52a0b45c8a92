"""Documents as rows (table functions) and rules as a table."""

import pytest
from pyspark.sql import functions as F

from weblathe.functions import tables
from weblathe.operators import rules
from weblathe.plans import documents


def plain_hits(text, table):
    import re

    return sorted((t, r, n, m[1] if m.re.groups else m[0]) for t, r, p, _ in table for n, m in enumerate(re.finditer(p, text, re.I)))


def test_every_rule_is_matched_and_cues_lose_nothing(spark):
    table = [tuple(r) for r in rules.policy_rules(spark).collect()]
    finder = rules.Finder(table)
    assert len(table) == 17
    for text in (*documents.DECLARED, " ".join(documents.DECLARED), "", "ＡＰＩ ſcrape K"):
        assert sorted(finder.hits(text)) == plain_hits(text, table)
    found = [sorted({rule for _, rule, _, _ in finder.hits(text)}) for text in documents.DECLARED]
    assert {rule for hit in found for rule in hit} == {r[1] for r in table}
    assert found[-2:] == [[], []]


def test_rule_tables_of_users(spark):
    rows = [(1, "Free LUNCH, free lunch", "mine", "x"), (1, "Free LUNCH, free lunch", "mine", "x"), (2, None, "mine", "x"), (3, "", None, None), (None, "no cue here", "mine", "y")]
    texts = spark.createDataFrame(rows, "id long, body string, rule string, other string")
    table = spark.createDataFrame([("food", "lunch", "free (lunch)", ["lunch"]), ("food", "any", "c.e", None), ("food", "none", "here", ["absent"])], rules.RULE_TABLE)
    got = rules.rule_hits(texts, table, "body")
    assert got.columns == ["id", "other", "topic", "rule", "n", "detail"]
    want = [(1, "x", "food", "lunch", 0, "LUNCH"), (1, "x", "food", "lunch", 1, "lunch")] * 2 + [(None, "y", "food", "any", 0, "cue")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert rules.rule_hits(texts.where("id = 9"), table, "body").count() == 0
    assert rules.rule_hits(texts, table.where("rule = 'x'"), "body").count() == 0


def test_rule_tables_that_are_refused(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="unterminated"):
        rules.rule_hits(texts, spark.createDataFrame([("t", "r", "(", None)], rules.RULE_TABLE))
    monkeypatch.setattr(rules, "MOST_RULES", 1)
    with pytest.raises(ValueError, match="at most 1 rules"):
        rules.rule_hits(texts, spark.createDataFrame([("t", "r", "a", None)] * 2, rules.RULE_TABLE))


def test_table_functions_in_sql(spark):
    tables.register(spark)
    robots = "User-agent: A\nUser-agent: b\nDisallow: /x # why\nAllow:\nCrawl-delay: soon\n\nsitemap: https://h.example/s.xml\nnot a rule\nUser-agent: c\nDisallow: /y"
    spark.createDataFrame([(1, robots), (2, None), (3, "")], "id int, body string").createOrReplaceTempView("robots_files")
    got = spark.sql("select id, r.* from robots_files, lateral robots_rules(body) r order by line, agent").collect()
    want = [(1, "a", "user-agent", "A"), (2, "b", "user-agent", "b"), (3, "a", "disallow", "/x"), (3, "b", "disallow", "/x"), (5, "a", "crawl-delay", "soon"), (5, "b", "crawl-delay", "soon"), (7, None, "sitemap", "https://h.example/s.xml"), (9, "c", "user-agent", "c"), (10, "c", "disallow", "/y")]
    assert [tuple(r) for r in got] == [(1, *w) for w in want]


def test_sitemaps_and_graphs_that_cannot_be_read(spark):
    bodies = [b"", None, b"<urlset>", b"<!DOCTYPE x><urlset><url/></urlset>", b"<feed><url><loc>x</loc></url></feed>", b"<urlset><url/><sitemap/><url><loc> </loc><loc>y</loc></url></urlset>"]
    maps = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body binary")
    got = maps.lateralJoin(tables.SitemapEntries(F.col("body").outer())).select("id", "position", "kind", "loc").collect()
    assert sorted(map(tuple, got)) == [(5, 0, "url", None), (5, 1, "url", None)]
    deep = '{"a":' * 300 + "1" + "}" * 300
    texts = [None, "", "{", "[]", "7", '[{"@type": ["A", 1, null], "x": [[{"@type": "B"}]]}, {}]', deep, "[" * 100_000]
    graphs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    nodes = graphs.lateralJoin(tables.LinkedDataNodes(F.col("body").outer()))
    assert sorted(map(tuple, nodes.where("id = 5").select("node", "parent", "key", "types").collect())) == [(0, None, None, ["A", ]), (1, 0, "x", ["B"]), (2, None, None, [])]
    assert {r["id"]: r["count"] for r in nodes.groupBy("id").count().collect()} == {5: 3, 6: 300}


def test_lateral_joins_are_narrow(spark):
    plan = documents.robots_rule_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
