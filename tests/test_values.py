"""Observation values as VARIANT."""

from pyspark.sql import functions as F

from weblathe.functions import text, values
from weblathe.operators import analysis

CASES = {
    "1": ("integer", "1", "1"),
    "-5": ("integer", "-5", "-5"),
    "1234567890123": ("integer", "1234567890123", "1234567890123"),
    "99999999999999999999999": ("integer", "99999999999999999999999", "99999999999999999999999"),
    "true": ("boolean", None, "true"),
    "null": ("null", None, "null"),
    "3.0": ("number", None, "3"),
    "1.50": ("number", None, "1.5"),
    "1e3": ("number", None, "1000.0"),
    '"1"': ("string", None, '"1"'),
    ' [2 , "é"]': ("array", None, '[2,"é"]'),
    '{"b": 1, "a": {"d": null, "c": 2}}': ("object", None, '{"a":{"c":2,"d":null},"b":1}'),
    "{broken": (None, None, None),
    "": (None, None, None),
}


def test_kinds_whole_numbers_and_canonical_text(spark):
    df = spark.createDataFrame([(k,) for k in [*CASES, None]], "given string")
    got = {r["given"]: (r["k"], r["w"], r["c"]) for r in df.select("given", values.kind(F.col("given")).alias("k"), values.whole_number(F.col("given")).cast("string").alias("w"), values.canonical(F.col("given")).alias("c")).collect()}
    assert got == CASES | {None: (None, None, None)}


def test_request_counts_of_any_size(spark):
    cases = {'{"requests":12345678901}': 12345678901, '{"requests":-3}': -3, '{"requests":true}': 0, '{"requests":3.0}': 0, '{"other":1}': 0, "null": 0, '{"requests":99999999999999999999999}': None}
    one = "map('browser.network_summary', named_struct('value_json', v, 'outcome', 'observed'))"
    rows = spark.createDataFrame([(v,) for v in cases], "v string").selectExpr("v as run_id", "'d' as domain", "'o' as origin", "now() as started_at", "now() as completed_at", "'1' as collector_version", "1 as request_count", f"{one} as observations", "array('x') as errors")
    assert {r["run_id"]: r["browser_requests"] for r in analysis.runs_of_snapshots(rows).collect()} == cases


def test_long_waits_are_waits(spark):
    df = spark.createDataFrame([("12345678901234",), ("+7",), ("-1",), ("1.5",)], "v string").select("v", text.retry_after(F.col("v"), F.current_timestamp()).alias("s"))
    assert {r["v"]: r["s"] for r in df.collect()} == {"12345678901234": 12345678901234.0, "+7": 7.0, "-1": None, "1.5": None}
