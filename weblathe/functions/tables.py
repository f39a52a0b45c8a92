"""Documents as rows: table functions for lateral joins.

``rows.lateralJoin(RobotsRules(F.col("body").outer()))`` gives each row once for every rule, entry or
node of its document; ``register`` makes the same functions known to SQL (``LATERAL robots_rules(body)``).
A lateral join is narrow: nothing is shuffled, and a document's rows leave the task as they are read.

A null document has no rows; neither has one that can't be read (``sitemap_facts`` and ``linked_data`` say why).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from weblathe.functions.parsing import robots_rows, sitemap_root


def local_name(element) -> str:  # noqa: ANN001
    return element.tag.rsplit("}", 1)[-1].lower() if isinstance(element.tag, str) else ""


@udtf(returnType="line: int, agent: string, key: string, value: string", useArrow=True)
class RobotsRules:
    """The lines of a robots file, once for each agent of their group: declarations, rules, delays, sitemaps (of no agent)."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from robots_rows(text or "")


@udtf(returnType="position: int, kind: string, loc: string, lastmod: string", useArrow=True)
class SitemapEntries:
    """The entries (url, sitemap) of a sitemap or sitemap index of at most ``limit`` bytes, in order; white space around values is cut."""

    def eval(self, body: bytes, limit: int = 1_000_000) -> Iterator[tuple]:
        root, _ = sitemap_root(body or b"", limit)
        kind = {"urlset": "url", "sitemapindex": "sitemap"}.get(local_name(root)) if root is not None else None
        entries = (e for e in root if local_name(e) == kind) if kind else ()
        for position, entry in enumerate(entries):
            said = {local_name(child): (child.text or "").strip() for child in reversed(entry)}
            yield position, kind, said.get("loc") or None, said.get("lastmod") or None


@udtf(returnType="node: int, parent: int, key: string, types: array<string>", useArrow=True)
class LinkedDataNodes:
    """The objects of a JSON-LD document in order, each with the object it is in, the key it is under and its types."""

    def eval(self, document: str) -> Iterator[tuple]:
        try:
            waiting = [(json.loads(document), None, None)] if document is not None else []
        except (ValueError, RecursionError):
            return
        node = 0
        while waiting:
            value, parent, key = waiting.pop()
            if isinstance(value, list):
                waiting += [(item, parent, key) for item in reversed(value)]
            elif isinstance(value, dict):
                kinds = value.get("@type")
                yield node, parent, key, [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
                waiting += [(item, node, name) for name, item in reversed(value.items())]
                node += 1


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as robots_rules, sitemap_entries and linked_data_nodes."""
    for name, function in (("robots_rules", RobotsRules), ("sitemap_entries", SitemapEntries), ("linked_data_nodes", LinkedDataNodes)):
        spark.udtf.register(name, function)
