"""Text rules as a table: patterns with topics, names and cues.

A rule says what its matches contain at least one of (``cues``). All cues of a rule table go into one
Aho-Corasick automaton; a text is read by it once, and only the patterns of rules that it cues are
searched. A rule without cues is always searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from weblathe.operators import detectors

RULE_TABLE = "topic string, rule string, pattern string, cues array<string>"
MOST_RULES = 10_000
FOUND = [StructField("topic", StringType()), StructField("rule", StringType()), StructField("n", IntegerType()), StructField("detail", StringType())]


def folded(text: str) -> str:
    """Letters that patterns take for others of the same case become one."""
    return text.upper().lower()


class Finder:
    """The rules of a table, ready to search texts; in order of topic, rule and pattern."""

    def __init__(self, rules: list[tuple[str, str, str, list[str] | None]]):
        self.rules = [(topic, rule, re.compile(pattern, re.I)) for topic, rule, pattern, _ in rules]
        self.always = {i for i, r in enumerate(rules) if not r[3]}
        cued: dict[str, set[int]] = {}
        for i, rule in enumerate(rules):
            for cue in rule[3] or ():
                cued.setdefault(folded(cue), set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for cue, which in cued.items():
            self.automaton.add_word(cue, which)
        if cued:
            self.automaton.make_automaton()
        self.cued = bool(cued)

    def hits(self, text: str) -> Iterator[tuple[str, str, int, str]]:
        """(topic, rule, n, detail) of each match, n from 0 for each pattern; detail is its first group, if it has one."""
        asked = set(self.always)
        if self.cued:
            for _, which in self.automaton.iter(folded(text)):
                asked |= which
        for i in sorted(asked):
            topic, rule, pattern = self.rules[i]
            for n, match in enumerate(pattern.finditer(text)):
                yield topic, rule, n, match[1 if pattern.groups else 0]


def rule_hits(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` without the text, a row for each match of each rule in it: topic, rule, n, detail.

    ``rules`` (topic, rule, pattern, cues) has at most ``MOST_RULES`` rows, which go to every task; more are an
    error, as is a pattern that can't be read. Patterns are Python's, without regard to case; ``.`` ends at a line
    break. A null text has no matches; columns of ``texts`` named like the new ones are replaced. One narrow pass.
    """
    table = [(r["topic"], r["rule"], r["pattern"], r["cues"]) for r in rules.select("topic", "rule", "pattern", "cues").limit(MOST_RULES + 1).collect()]
    if len(table) > MOST_RULES:
        raise ValueError(f"a rule table has at most {MOST_RULES} rules")
    table.sort(key=lambda r: r[:3])
    Finder(table)  # an unreadable pattern is an error here, not in a task
    names = [f.name for f in FOUND]
    base = texts.drop(*(n for n in names if n != text))
    rest = [f for f in base.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(table)
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                if value is not None:
                    for hit in finder.hits(value):
                        at.append(i)
                        found.append(hit)
            kept = batch.select([f.name for f in rest]).take(pa.array(at, pa.int64()))
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            own = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *own], [*(f.name for f in rest), *names])

    return base.mapInArrow(run, StructType(rest + FOUND))


def policy_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules over policy texts, as a rule table."""
    rows = [(topic, rule, pattern, list(detectors.CUES[rule])) for topic, rules in detectors.RULES.items() for rule, pattern in rules.items()]
    rows += [("economic.api_pricing", "api_price", pattern, ["api"]) for pattern in detectors.API_PRICES]
    rows += [("economic.api_pricing", "free_tier", detectors.API_FREE, ["api"]), ("economic.api_pricing", "contact_sales", detectors.API_SALES, ["api"])]
    return spark.createDataFrame(rows, RULE_TABLE)
