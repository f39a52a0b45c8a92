"""Analysis, sampling, jobs, pacing, readers and sinks on small tables."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from weblathe.functions import text as T
from weblathe.functions import urls as U
from weblathe.functions.parsing import canonical_json
from weblathe.operators import analysis, jobs, sampling
from weblathe.sources import lists, sinks, snapshots

NOW = "2026-01-01T00:00:00+00:00"


def snapshot(domain, run, at, signals, **more):
    return {"schema_version": "0.2.0", "run_id": run, "domain": domain, "origin": f"https://{domain}", "started_at": at, "completed_at": at, "collector_version": "1", "request_count": 2, "observations": signals, "requests": [], "errors": []} | more


def observed(value, outcome="observed", confidence="confirmed", **more):
    return {"value": value, "outcome": outcome, "confidence": confidence, "confidence_score": 1.0, "method": "m", "evidence": []} | more


SKIPPED = observed(None, "skipped", "unknown")


@pytest.fixture
def tree(tmp_path):
    docs = [
        snapshot("a.example", "1", "2026-01-01T00:00:00Z", {"crawler.robots_exists": observed(True), "browser.network_summary": observed({"requests": 7})}),
        snapshot("a.example", "2", "2026-01-02T00:00:00Z", {"crawler.robots_exists": observed(False), "human.rate_limited": SKIPPED}),
        snapshot("b.example", "3", "2026-01-01T00:00:00Z", {"crawler.robots_exists": observed({"b": 1, "a": "é"}), "human.rate_limited": SKIPPED}),
    ]
    for i, d in enumerate(docs):
        folder = tmp_path / "tree" / str(i)
        folder.mkdir(parents=True)
        (folder / "s.json").write_text(json.dumps(d))
    return tmp_path / "tree"


def test_analysis_of_a_tree(spark, tree):
    found = snapshots.read_snapshots(spark, str(tree))
    runs = {r["run_id"]: r for r in analysis.runs_of_snapshots(found).collect()}
    assert (runs["1"]["browser_requests"], runs["1"]["observed"], runs["2"]["skipped"], runs["3"]["http_requests"]) == (7, 2, 1, 2)
    seen = analysis.observations_of_snapshots(found)
    assert seen.count() == 6
    values = {(r["run_id"], r["signal"]): r["value_json"] for r in seen.collect()}
    assert values["3", "crawler.robots_exists"] == '{"a":"\\u00e9","b":1}'
    changes = analysis.longitudinal_changes(seen)
    assert [(r["domain"], r["signal"], r["previous_run_id"], r["current_run_id"], r["changed"]) for r in changes.collect()] == [("a.example", "crawler.robots_exists", "1", "2", True)]
    assert {(r["scope"], r["outcome"]): r["n"] for r in analysis.summary(seen).where("scope = 'all'").collect()} == {("all", "observed"): 4, ("all", "skipped"): 2}
    assert tuple(analysis.totals(seen, changes).first()) == (3, 2, 3, 1, 1, 0)
    assert sum(r["observations"] for r in analysis.run_counts(seen).collect()) == seen.count()


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"extra": 1}, "unknown fields"),
        ({"schema_version": "9"}, "unsupported"),
        ({"request_count": -1}, "negative"),
        ({"observations": {"x.y": observed(1, "error", "no_evidence")}}, "disagree"),
        ({"observations": {"x.y": observed(1, confidence_score=1.5)}}, "range"),
        ({"observations": {"x.y": observed(1) | {"odd": 1}}}, "unknown fields"),
        ({"observations": [1]}, "object"),
        ({"errors": [{"probe": "p"}]}, "lacks"),
    ],
)
def test_bad_snapshots_fail_the_load(spark, tree, change, problem):
    (tree / "bad.json").write_text(json.dumps(snapshot("c.example", "9", "2026-01-01T00:00:00Z", {"x.y": observed(1)}) | change))
    loose = snapshots.read_snapshots(spark, str(tree), strict=False).where("problem is not null").collect()
    assert len(loose) == 1 and problem in loose[0]["problem"]
    with pytest.raises(Exception, match="bad.json"):
        snapshots.read_snapshots(spark, str(tree)).count()


def test_old_snapshots_migrate_and_files_that_are_not_json_fail(spark, tmp_path):
    old = snapshot("a.example", "1", "2026-01-01T00:00:00Z", {k: {f: v for f, v in observed(1, confidence=c).items() if f != "outcome"} for k, c in (("a.b", "likely"), ("c.d", "unknown"), ("e.f", "no_evidence"))}, schema_version="0.1.0")
    rows = spark.createDataFrame([("p", json.dumps(old)), ("q", "{"), ("r", "[]")], "path string, text string")
    got = {r["path"]: r for r in snapshots.parse_snapshots(rows).collect()}
    assert {k: o["outcome"] for k, o in got["p"]["observations"].items()} == {"a.b": "observed", "c.d": "error", "e.f": "no_evidence"}
    assert got["p"]["problem"] is None and got["q"]["problem"] and got["r"]["problem"]


def test_documents_are_parsed_once_under_a_filter(spark):
    rows = spark.createDataFrame([("p", "{"), ("q", "[]")], "path string, text string")
    fine = snapshots.parse_snapshots(rows).where("problem is null").drop("problem")
    plan = fine._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and fine.count() == 0


def test_snapshots_write_and_keep_earlier_files(spark, tree, tmp_path):
    found = snapshots.read_snapshots(spark, str(tree))
    snapshots.write_snapshots(found, str(tmp_path / "out"))
    snapshots.write_snapshots(found.limit(1), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    assert snapshots.request_rows(found).count() == 0


FRAME = "domain string, source string, sector string, geography string, popularity_band string, eligible boolean, exclusion_reason string"


def frame(n=40):
    return [(f"d{i}.example", f"list{i % 3}", "commerce", "europe", "head" if i % 2 else "middle", i % 7 != 0, None if i % 7 else "closed") for i in range(n)]


def test_sample_depends_on_the_frame_alone(spark):
    rows = frame()
    pick = lambda df: {tuple(r) for r in sampling.select_sample(sampling.merge_frame(df), "s", 4).select("domain", "random_order", "selected", "inclusion_probability").collect()}
    a = pick(spark.createDataFrame(rows, FRAME).repartition(1))
    assert a == pick(spark.createDataFrame(rows[::-1], FRAME).repartition(7))
    assert sum(x[2] for x in a) == 8 and {x[3] for x in a if x[2]} == {4 / 17}
    assert all(x[1] is None and x[3] == 0.0 for x in a if int(x[0][1:].split(".")[0]) % 7 == 0)


def test_five_domains_two_drawn(spark):
    rows = [(f"d{i}.example", "one", "commerce", "europe", "head", True, None) for i in range(5)] + [("d0.example", "two", "commerce", "europe", "head", True, None)]
    merged = sampling.merge_frame(spark.createDataFrame(rows, FRAME))
    got = sampling.select_sample(merged, "seed", 2)
    assert got.where("selected").count() == 2 and {r[0] for r in got.select("inclusion_probability").collect()} == {0.4}
    assert merged.where("domain = 'd0.example'").first()["sources"] == ["one", "two"] and not merged.where("conflict").count()
    header = sampling.manifest(got, "seed", 2).first()
    assert (header["frame_size"], header["selected_size"], header["sources"]) == (5, 2, "one,two")


def test_design_mean_of_a_census_is_the_mean(spark):
    rows = sampling.select_sample(sampling.merge_frame(spark.createDataFrame(frame(), FRAME)), "s", 1000).withColumn("x", F.length("domain"))
    got = sampling.design_means(rows, "x").first()
    want = rows.where("selected").select(F.avg("x")).first()[0]
    assert got["weighted_mean"] == pytest.approx(want) and got["standard_error"] == pytest.approx(0)


def test_pacing_opens_the_circuit(spark):
    events = [("a.example", 1000.0, 1, "transient", None), ("a.example", 1005.0, 2, "transient", None), ("a.example", 1006.0, 3, "reserve", None), ("a.example", 1070.0, 4, "reserve", None), ("b.example", 5.0, 1, "reserve", None), ("b.example", 5.2, 2, "reserve", None), ("b.example", 5.3, 3, "interval", 30.0), ("b.example", 5.4, 4, "reserve", None), ("b.example", 50.0, 5, "success", None)]
    df = spark.createDataFrame(events, "domain string, at double, sequence long, event string, amount double").repartition(3)
    got = {(r["domain"], r["sequence"]): r for r in jobs.pace(df, threshold=2, cooldown=60.0).collect()}
    assert got["a.example", 2]["circuit_until"] == 1065.0 and got["a.example", 3]["decision"] == "rejected" and got["a.example", 4]["decision"] == "granted"
    assert got["b.example", 2]["wait"] == pytest.approx(0.8) and got["b.example", 4]["decision"] == "deferred" and got["b.example", 5]["failures"] == 0


def test_guarded_transitions(spark):
    j = spark.createDataFrame([(1, 0, "o", "d", "running", None, 1, 1, None), (1, 1, "o", "d", "pending", None, 0, 0, None), (2, 0, "o", "e", "running", None, 0, 1, None)], "run_id long, ordinal long, origin string, registrable_domain string, status string, not_before double, request_count int, attempts int, notes string")
    runs = spark.createDataFrame([(1, "a", 100.0), (2, "b", 100.0)], "run_id long, owner string, lease_expires double")
    results = spark.createDataFrame([(1, 0, "deferred", 4, 77.0, "x" * 3000), (1, 1, "completed", 4, None, None), (2, 0, "completed", 4, None, None)], "run_id long, ordinal long, result string, requests int, not_before double, notes string")
    got = {(r["run_id"], r["ordinal"]): r for r in jobs.apply_results(j, runs, results, "a", F.lit(50.0)).collect()}
    assert (got[1, 0]["status"], got[1, 0]["request_count"], got[1, 0]["not_before"], len(got[1, 0]["notes"])) == ("deferred", 5, 77.0, 2048)
    assert got[1, 1]["status"] == "pending" and got[2, 0]["status"] == "running"
    late = jobs.apply_results(j, runs, results, "a", F.lit(500.0)).where("status = 'deferred'").count()
    assert late == 0


def test_jobs_are_numbered_once(spark):
    t = spark.createDataFrame([(1, 5, "x", "d"), (1, 2, "x", "d"), (1, 3, "y", "d")], "run_id long, position int, origin string, registrable_domain string")
    assert sorted((r["ordinal"], r["origin"]) for r in jobs.create_jobs(t).collect()) == [(0, "x"), (1, "y")]


def test_cease_list_takes_the_longest_entry(spark):
    hosts = spark.createDataFrame([("a.b.example",), ("b.example",), ("ab.example",)], "host string")
    listed = spark.createDataFrame([("b.example",), ("a.b.example",)], "domain string")
    assert {tuple(r) for r in jobs.cease_matches(hosts, listed).collect()} == {("a.b.example", "a.b.example"), ("b.example", "b.example")}


def test_hosts_and_addresses(spark):
    hosts = ["news.bbc.co.uk", "www.example.com", "project.github.io", "github.io", "localhost", "127.0.0.1", "co.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r[0] for r in df.select(U.registrable_domain(F.col("h"))).collect()] == ["bbc.co.uk", "example.com", "project.github.io", None, None, None, None]
    targets = ["Example.com/path", "http://h.example:8080/x?y", "ftp://h.example", "https://u:p@h.example", "https://[::1]/"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in targets], "t string").select(U.normalized_target(F.col("t"))).collect()] == ["https://example.com", "http://h.example:8080", None, None, None]
    rows = spark.createDataFrame([("https://h.example/", "8.8.8.8"), ("https://h.example/", "10.0.0.1"), ("https://h.example:444/", "8.8.8.8"), ("https://localhost/", "8.8.8.8"), ("https://a@h.example/", "8.8.8.8")], "u string, ip string").withColumn("flag", U.public_flags(F.col("ip")))
    assert [r[0] for r in rows.select(U.is_public_url(F.col("u"), F.array("flag"))).collect()] == [True, False, False, False, False]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.squeeze(F.lit(" a  b\n"))) == "a b" and one(T.squeeze(F.lit("  "))) is None
    assert [one(T.has_marker(F.lit(t), m)) for t, m in (("/photos", "tos"), ("/tos", "tos"), ("blog index", "log-in"), ("sign_up", "sign-up"))] == [False, True, True, True]
    assert [one(T.policy_score(F.lit(t))) for t in ("ai policy", "terms of use", "aup", "terms", "legal", "x")] == [120, 110, 105, 90, 70, 0]
    assert [one(T.economic_score(F.lit(t))) for t in ("api pricing", "api plans", "plans", "registration requirements", "api docs", "developer", "x")] == [120, 105, 100, 90, 70, 50, 0]
    assert one(T.display_cell(F.lit("collected"), F.lit("x" * 41))) == "x" * 37 + "..." and one(T.display_cell(F.lit("no_evidence"), F.lit("1"))) == "no evidence"
    assert one(T.error_cell(F.array(F.lit("a|b"), F.lit("c")))) == "a\\|b; c"
    now = F.lit(dt.datetime(2026, 1, 1, tzinfo=dt.UTC))
    assert [one(T.retry_after(F.lit(v), now)) for v in ("120", "+5", "Thu, 01 Jan 2026 00:01:00 GMT", "Wed, 31 Dec 2025 00:00:00 GMT", "soon")] == [120.0, 5.0, 60.0, 0.0, None]
    assert one(canonical_json(F.lit('{"b": 1.0, "a": "é"}'))) == '{"a":"\\u00e9","b":1.0}'


def test_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# head\nb.example\n\na.example # note\nb.example\n")
    assert [(r["target"], r["origin"]) for r in lists.read_targets(spark, str(tmp_path / "t.txt")).orderBy("position").collect()] == [("b.example", "https://b.example"), ("a.example", "https://a.example")]
    (tmp_path / "c.txt").write_text("x.example\nhttps://y.example\n*.z.example\n")
    assert [r["problem"] is None for r in lists.read_cease_list(spark, str(tmp_path / "c.txt")).orderBy("n").collect()] == [True, False, False]
    (tmp_path / "f.csv").write_text("source,domain,sector,geography,popularity_band,eligible,exclusion_reason\none, WWW.Example.com ,Commerce,europe,head,true,\none,b.example,commerce,europe,head,false,\none,b.example,space,europe,head,true,\n")
    got = lists.read_frame(spark, str(tmp_path / "f.csv")).collect()
    assert (got[0]["domain"], got[0]["problem"]) == ("example.com", None) and "reason" in got[1]["problem"] and "sector" in got[2]["problem"]
    (tmp_path / "g.csv").write_text("domain\nx\n")
    with pytest.raises(ValueError, match="columns"):
        lists.read_frame(spark, str(tmp_path / "g.csv"))
    (tmp_path / "j.jsonl").write_text(json.dumps(dict.fromkeys(lists.COMPLAINT_FIELDS, 1)) + '\n{"domain": 1}\nnope\n')
    assert [r["valid"] for r in lists.read_complaints(spark, str(tmp_path / "j.jsonl")).collect()] == [True, False, False]
    (tmp_path / "p.txt").write_text("Contact: mailto:x\nContact: y\nExpires: 2001-01-01T00:00:00Z\n")
    p = lists.probing_problems(spark, str(tmp_path / "p.txt")).first()
    assert (p["missing"], p["repeated"], p["expires_in_time"]) == (["Canonical", "Description", "Preferred-Languages"], ["Contact"], False)


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", True, None, [1])], "x string, y boolean, z string, w array<int>").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text == b"x,y,z,w\r\na,True,,[1]\r\n"
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_csv(df, str(tmp_path / "csv"))
    assert sinks.summary_json(df.select("y", "x")) == '{\n  "x": "a",\n  "y": true\n}\n'
    assert sinks.markdown_table(df.select("x", "z")).endswith("| a | — |")


def test_scores_and_validation(spark):
    seen = spark.createDataFrame([("1", "a.x", "observed", 1.0, 4.0), ("1", "a.y", "observed", 3.0, 8.0), ("1", "a.z", "error", 5.0, None), ("2", "a.x", "error", 1.0, None), ("2", "a.y", "observed", 1.0, 2.0), ("2", "a.z", "skipped", 1.0, None)], "run_id string, signal string, outcome string, w double, x double")
    got = {r["run_id"]: (r["score"], r["coverage"]) for r in analysis.dimension_score(seen, F.col("w"), F.col("x"), 0.5).collect()}
    assert got["1"] == (7.0, pytest.approx(2 / 3)) and got["2"][0] is None and math.isclose(got["2"][1], 1 / 3)
    judged = spark.createDataFrame([(True, True), (True, False), (False, True), (None, True), (False, False)], "flag boolean, truth boolean")
    r = analysis.detector_validation(judged).first()
    assert (r["precision"], r["recall"], r["abstention"]) == (0.5, pytest.approx(1 / 3), 0.2)


def test_library_without_training_subpackage():
    """Nothing outside llm imports it, except the guarded entry module and the pipeline."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent
    for path in (root / "weblathe").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "weblathe.llm" not in path.read_text() and "from .llm" not in path.read_text()
