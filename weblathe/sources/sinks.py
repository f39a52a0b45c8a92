"""Outputs: CSV in the exporters' dialect, summaries, manifests that never overwrite, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, CRLF, True and False; arrays and structs as JSON; null as an empty field."""
    text = lambda f: F.initcap(F.col(f.name).cast("string")) if f.dataType.typeName() == "boolean" else F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
    rows = df.select(*(text(f).alias(f.name) for f in df.schema.fields))
    rows.write.mode("errorifexists").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)


def summary_json(row: DataFrame) -> str:
    """A one-row summary as JSON, sorted keys, two blanks of indent, a newline at the end."""
    first = json.loads(row.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    return json.dumps(first, indent=2, sort_keys=True) + "\n"


def write_manifest(selection: DataFrame, header: DataFrame, path: str) -> None:
    """Header, selection and domain list; fails if any of them is there."""
    header.write.mode("errorifexists").json(f"{path}/header")
    selection.orderBy("domain").write.mode("errorifexists").json(f"{path}/selection")
    selection.where("selected").select("domain").orderBy("domain").write.mode("errorifexists").text(f"{path}/domains")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report table; reports are for people, so a table shows ``limit`` rows and says how many more there are."""
    rows = df.limit(limit + 1).collect()
    cell = lambda v: "—" if v is None else str(v).replace("|", "\\|")
    shown = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:limit])]
    if len(rows) > limit:
        shown += ["", f"{df.count() - limit} more rows are not shown."]
    return "\n".join(shown)
