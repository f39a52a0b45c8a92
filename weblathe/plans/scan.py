"""From captures to snapshots: the registered detectors, run over their tables and gathered by run.

A detector is a function of a table of captures; ``DETECTORS`` names them with their table. Further
detectors of the same shape can be added for one call.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblathe.operators import detectors
from weblathe.operators.contracts import duplicate_signals
from weblathe.operators.observe import snapshots_of

Detector = Callable[[DataFrame], DataFrame]
DETECTORS: tuple[tuple[str, Detector], ...] = (
    ("network", detectors.network_signals),
    ("dns_metadata", detectors.dns_signals),
    ("robots", detectors.robots_signals),
    ("sitemap", detectors.sitemap_signals),
    ("homepage", detectors.homepage_signals),
    ("homepage", detectors.response_signals),
    ("pages", detectors.metadata_signals),
    ("pages", detectors.page_signals),
    ("renders", detectors.browser_signals),
    ("llms", detectors.llms_signals),
    ("archive", detectors.archive_signals),
    ("cache", detectors.cache_signals),
    ("attempts", detectors.attempt_signals),
)


def with_robots(homepage: DataFrame, robots: DataFrame) -> DataFrame:
    """Homepage captures with ``allowed`` as robots.txt says; without a robots capture nothing is allowed."""
    allowed = detectors.followup_allowed(robots).select("run_id", "allowed")
    return homepage.drop("allowed").join(allowed, "run_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def observe_all(captures: dict[str, DataFrame], more: tuple[tuple[str, Detector], ...] = ()) -> DataFrame:
    """Observations of all detectors whose table is given. Pages are homepage captures, parsed once."""
    tables = dict(captures)
    if "homepage" in tables and "robots" in tables:
        tables["homepage"] = with_robots(tables["homepage"], tables["robots"])
    if "homepage" in tables:
        tables.setdefault("pages", detectors.with_page_facts(tables["homepage"]))
    parts = [run(tables[name]) for name, run in (*DETECTORS, *more) if name in tables]
    columns = ["run_id", "signal", "outcome", "confidence", "confidence_score", "value_json", "method"]
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


def assemble(captures: dict[str, DataFrame], runs: DataFrame, more: tuple[tuple[str, Detector], ...] = ()) -> DataFrame:
    """One snapshot for each run; detectors that give a signal twice are an error, found before gathering."""
    observations = observe_all(captures, more)
    twice = duplicate_signals(observations).limit(3).collect()
    if twice:
        raise ValueError(f"signals given twice: {[(r['run_id'], r['signal']) for r in twice]}")
    return snapshots_of(observations, runs)
