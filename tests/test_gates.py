"""Gates, retries, leases, the catalog and the command line."""

import json

from pyspark.sql import functions as F

from weblathe import cli
from weblathe.operators import contracts, gates

from .test_operators import observed, snapshot


def test_browser_gate_counts_only_what_it_lets_through(spark):
    rows = [("r", i, "https://a.example/", f"https://{'cdn.other.example' if i % 2 else 'a.example'}/{i}", i == 1, i != 2) for i in range(8)]
    df = spark.createDataFrame(rows, "run_id string, n long, origin string, url string, top_level boolean, permitted boolean").repartition(3)
    got = [r["decision"] for r in gates.browser_gate(df, request_cap=4, third_party_cap=1).orderBy("n").collect()]
    assert got == ["allowed", "cross_site_navigation", "not_permitted", "allowed", "allowed", "third_party_cap", "allowed", "request_cap"]


def test_browser_gate_checks_in_order_and_takes_reservations_back(spark):
    """One reason before another, and an address that isn't public frees what was reserved."""
    site, other = "https://a.example/", "https://cdn.other.example/"
    rows = [
        (1, other, True, False, True, 0.0), (2, other, True, True, True, 1.0), (3, other, False, True, False, 2.0), (4, other, False, True, True, 3.0), (5, other, True, True, True, 4.0), (6, other, False, True, True, 5.0),
        (7, site, False, True, True, 6.0), (8, site, False, False, True, 7.0), (9, site, False, True, True, 20.0),
    ]
    df = spark.createDataFrame([("r", n, site, *r) for n, *r in rows], "run_id string, n long, origin string, url string, top_level boolean, permitted boolean, public boolean, elapsed double")
    got = [r["decision"] for r in gates.browser_gate(df, request_cap=2, third_party_cap=1).orderBy("n").collect()]
    assert got == ["not_permitted", "cross_site_navigation", "not_public", "allowed", "cross_site_navigation", "third_party_cap", "allowed", "request_cap", "wall_time"]


def test_attempts_share_the_circuit_of_their_domain(spark):
    rows = [
        ("d", "r1", 1, 1, 0.0, 503, None), ("d", "r1", 1, 2, 10.0, 503, None), ("d", "r1", 2, 3, 20.0, 200, None),  # the second failure opens the circuit
        ("d", "r2", 1, 1, 400.0, None, 2.0), ("d", "r2", 1, 2, 401.0, 200, None), ("d", "r2", 2, 3, 402.0, 200, None),
        ("e", "r3", 1, 1, 0.0, 429, 60.0), ("e", "r3", 2, 2, 1.0, 200, None), ("e", "r3", 2, 3, 100.0, 301, None), ("e", "r3", 2, 4, 101.0, 301, None), ("e", "r3", 3, 5, 102.0, 200, None), ("e", "r3", 3, 6, 110.0, 200, None),
    ]
    df = spark.createDataFrame(rows, "domain string, run_id string, request int, n int, at double, status_code int, retry_after double").repartition(3)
    got = [(r["made"], r["follow"]) for r in gates.attempt_log(df, budget=4, redirects=1).orderBy("domain", "run_id", "n").collect()]
    assert got[:3] == [(True, "retry"), (True, "circuit_open"), (False, "rejected")]
    assert got[3:6] == [(True, "circuit_open"), (True, "done"), (True, "done")]  # until an answer closes it
    assert got[6:] == [(True, "deferred"), (False, "deferred"), (True, "redirect"), (True, "too_many_redirects"), (True, "done"), (False, "budget_exhausted")]


def test_attempts_redirect_retry_and_stop(spark):
    rows = [("r", 1, i, 302, None) for i in range(7)] + [("s", 1, 1, 503, 1.0), ("s", 1, 2, 503, 1.0), ("t", 1, 1, 429, 60.0), ("u", 1, 1, None, None), ("u", 1, 2, 200, None)]
    df = spark.createDataFrame(rows, "run_id string, request int, n int, status_code int, retry_after double")
    got = {(r["run_id"], r["n"]): r["follow"] for r in gates.attempt_outcomes(df).collect()}
    assert got["r", 4] == "redirect" and got["r", 5] == "too_many_redirects"
    assert [got["s", 1], got["s", 2], got["t", 1], got["u", 1], got["u", 2]] == ["retry", "gave_up", "deferred", "retry", "done"]


def test_leases_compare_and_set(spark):
    rows = [("r", 0.0, 1, "acquire", "a"), ("r", 10.0, 2, "acquire", "b"), ("r", 50.0, 3, "renew", "a"), ("r", 100.0, 4, "acquire", "b"), ("r", 111.0, 5, "acquire", "b"), ("r", 112.0, 6, "renew", "a"), ("r", 113.0, 7, "release", "b"), ("r", 114.0, 8, "acquire", "a")]
    got = [r["granted"] for r in gates.leases(spark.createDataFrame(rows, "run_id string, at double, n long, event string, owner string")).orderBy("n").collect()]
    assert got == [True, False, True, False, True, False, True, True]


def test_caps_and_headers(spark):
    df = spark.createDataFrame([("r", 1, "a", 59), ("r", 2, "b", 5), ("r", 3, "b", 1), ("r", 4, "c", -1), ("q", 1, "a", 30), ("q", 2, "a", 30), ("q", 3, "a", 20)], "run_id string, n int, response string, bytes int")
    got = [(r["decision"], r["total_bytes"]) for r in gates.byte_caps(df, 60, 59).orderBy("run_id", "n").collect()]
    assert got == [("accepted", 30), ("response_cap", 30), ("accepted", 50), ("accepted", 59), ("total_cap", 59), ("accepted", 60), ("negative", 60)]
    check = lambda n, v: spark.range(1).select(gates.conditional_header_ok(F.lit(n), F.lit(v))).first()[0]
    assert [check("If-None-Match", "x"), check("Cookie", "x"), check("if-none-match", "a\nb"), check("if-none-match", "x" * 5000)] == [True, False, False, False]


def test_catalog_table_and_drift(spark):
    catalog = contracts.signal_catalog(spark)
    assert catalog.count() == 110 and catalog.select("family").distinct().count() == 10
    stored = contracts.schema_json(catalog.schema)
    assert not contracts.schema_drift(catalog.schema, stored) and contracts.schema_drift(catalog.drop("family").schema, stored)
    twice = spark.createDataFrame([("r", "a.b"), ("r", "a.b"), ("r", "c.d")], "run_id string, signal string")
    assert [tuple(r) for r in contracts.duplicate_signals(twice).collect()] == [("r", "a.b", 2)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(snapshot("a.example", "1", "2026-01-01T00:00:00Z", {"crawler.robots_exists": observed(True)})))
    cli.main(["analyze", "--snapshots", str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    assert json.loads(capsys.readouterr().out)["snapshots"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "observations")).count() == 1
    (tmp_path / "f.csv").write_text("domain,source,sector,geography,popularity_band,eligible,exclusion_reason\n" + "".join(f"d{i}.example,one,commerce,europe,head,true,\n" for i in range(5)))
    cli.main(["frame-sample", "--frame", str(tmp_path / "f.csv"), "--out", str(tmp_path / "sample"), "--seed", "s", "--per-stratum", "2"])
    assert spark.read.text(str(tmp_path / "sample" / "domains")).count() == 2
    cli.main(["report", "--snapshots", str(tmp_path / "in")])
    assert "a.example" in capsys.readouterr().out
