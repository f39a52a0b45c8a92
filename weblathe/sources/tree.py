"""A data source for snapshot trees (``root/day/domain/*.json``): pruned reading, writing that commits or leaves nothing.

Reading. ``spark.read.format("weblathe_snapshots").load(root)`` has a partition for every ``folders`` (8) folders of a day and domain. Filters
on ``date`` and ``host`` choose folders before any file is opened. Each document, one to a file or one to a line, comes
normalised (older versions migrated, key sets checked) with its problem; ``strict`` fails the job on the first
problem, naming the file, and on a tree without documents.

Writing. Tasks stage their files below ``root/_staged``; only the commit moves them into their folders, and an abort
deletes them (a killed task may leave one there), so readers never see a failed write. ``write_once`` first takes away the runs that the tree holds
already: the same write twice leaves one copy, a write that died while it committed is completed by
repeating it, and another document under a known run_id is an error. Only the folders of the days
that are written are read for that.

Files go through Arrow's file systems, so ``root`` may be a path or a URI that Arrow knows.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from weblathe.functions.parsing import in_pieces
from weblathe.sources import snapshots
from weblathe.sources.shared import written

FORMAT = "weblathe_snapshots"
TREE = "path string, date date, host string, run_id string, document string, problem string"
WRITTEN = ("date", "host", "run_id", "document")
STAGED = "_staged"


def opened(root: str):  # noqa: ANN201
    """(file system, path) of a root, also where it isn't there yet."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def listed(files, folder: str, directories: bool) -> list[str]:  # noqa: ANN001
    """Names in a folder, sorted; none if it isn't there. Hidden ones (``_``, ``.``) are not the tree's."""
    from pyarrow import fs

    kind = fs.FileType.Directory if directories else fs.FileType.File
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == kind and f.base_name[:1] not in "._")


def day_of(name: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(name.removeprefix("date="))
    except ValueError:
        return None


@dataclass
class Folders(InputPartition):
    """What one task reads: (day, domain, path) of some folders."""

    folders: list[tuple[dt.date, str, str]]


TESTS = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
}


class TreeReader(DataSourceReader):
    def __init__(self, root: str, strict: bool, at_once: int):
        self.root, self.strict, self.at_once = root.rstrip("/"), strict, at_once
        self.chosen: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if type(f) in TESTS and column in (("date",), ("host",)):
                self.chosen.append((column[0], type(f), f.value))
            else:
                yield f

    def fits(self, column: str, value: object) -> bool:
        return all(TESTS[kind](value, given) for name, kind, given in self.chosen if name == column)

    def partitions(self) -> list[Folders]:
        files, root = opened(self.root)
        days = [(name, day_of(name)) for name in listed(files, root, True)]
        found, any_folder = [], False
        for name, day in days:
            if day is None:
                continue
            any_folder = True
            if self.fits("date", day):
                hosts = listed(files, f"{root}/{name}", True)
                found += [(day, h.removeprefix("host="), f"{root}/{name}/{h}") for h in hosts if self.fits("host", h.removeprefix("host="))]
        if self.strict and not any_folder:
            raise ValueError(f"no snapshots below {self.root}")
        return [Folders(found[i : i + self.at_once]) for i in range(0, len(found), self.at_once)]

    def read(self, partition: Folders | None) -> Iterator[tuple]:
        for date, host, folder in partition.folders if partition is not None else ():  # None if no folder is left
            yield from self.read_folder(date, host, folder)

    def read_folder(self, date: dt.date, host: str, folder: str) -> Iterator[tuple]:
        files, _ = opened(self.root)
        for name in listed(files, folder, False):
            path = f"{folder}/{name}"
            if not name.endswith((".json", ".txt")):
                continue
            with files.open_input_stream(path) as stream:
                text = stream.read().decode("utf-8", "replace")
            for at, document in documents(text):
                normal, problem = snapshots.normal_form(document)
                if problem and self.strict:
                    raise ValueError(f"invalid snapshot {path}{at}: {problem}")
                run = json.loads(normal).get("run_id") if normal else None
                yield path, date, host, run if isinstance(run, str) else None, normal if normal else document, problem


def documents(text: str) -> Iterator[tuple[str, str]]:
    """(place, document): the whole text if it is one document, else its lines."""
    lines = [(f" line {n}", line) for n, line in enumerate(text.splitlines(), 1) if line.strip()]
    if len(lines) <= 1:
        yield "", text
        return
    try:
        json.loads(text)
    except ValueError:
        yield from lines
    else:
        yield "", text


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task staged: (staged, final) paths below the root."""

    files: list[tuple[str, str]]


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.write_id = root.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        """Rows of (date, host, run_id, document); those of one folder come together, so one file is open at a time."""
        files, root = opened(self.root)
        done: list[tuple[str, str]] = []
        stream, folder, task = None, None, uuid.uuid4().hex[:12]
        try:
            for row in iterator:
                where = f"{row['date']:%Y-%m-%d}/{row['host']}"
                if where != folder:
                    if stream is not None:
                        stream.close()
                    folder, name = where, f"part-{self.write_id}-{task}-{len(done)}.json"
                    files.create_dir(f"{root}/{STAGED}/{self.write_id}/{where}", recursive=True)
                    staged = f"{STAGED}/{self.write_id}/{where}/{name}"
                    stream = files.open_output_stream(f"{root}/{staged}")
                    done.append((staged, f"{where}/{name}"))
                stream.write((row["document"] + "\n").encode())
        finally:
            if stream is not None:
                stream.close()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = opened(self.root)
        for staged, final in (pair for m in messages if m is not None for pair in m.files):
            files.create_dir(f"{root}/{final.rsplit('/', 1)[0]}", recursive=True)
            files.move(f"{root}/{staged}", f"{root}/{final}")
        self.clear(files, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear(*opened(self.root))

    def clear(self, files, root: str) -> None:  # noqa: ANN001
        """Delete what this write staged, files of failed attempts too."""
        from pyarrow import fs

        folder = f"{root}/{STAGED}/{self.write_id}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class SnapshotTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TREE

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("strict", "true").lower() == "true", int(self.options.get("folders", "8")))

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("snapshots are never overwritten; use mode append")
        if tuple(schema.names) != WRITTEN:
            raise ValueError(f"the columns must be {WRITTEN}")
        return TreeWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotTree)


def load(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """date, host and problem beside the columns of snapshots. Strict also holds values against the contract, and has no problem column."""
    register(spark)
    rows = spark.read.format(FORMAT).option("strict", str(strict)).load(root)
    parsed = rows.withColumn("s", F.from_json(F.when(F.col("problem").isNull(), F.col("document")), snapshots.SNAPSHOT))
    problem = F.coalesce("problem", snapshots.problems(F.col("s")))
    if not strict:
        return parsed.select("path", "date", "host", problem.alias("problem"), "s.*")
    failed = F.raise_error(F.concat(F.lit("invalid snapshot "), F.col("path"), F.lit(": "), problem)).cast("string")
    checked = F.when(problem.isNotNull(), failed).otherwise(F.col("s.run_id"))
    names = StructType.fromDDL(snapshots.SNAPSHOT).names
    return parsed.select("date", "host", *(checked.alias("run_id") if c == "run_id" else F.col(f"s.{c}") for c in names))


def documents_of(found: DataFrame) -> DataFrame:
    """date, host, run_id, document: snapshots as they are written, values as JSON values."""
    return found.select(
        F.to_date("completed_at").alias("date"), F.regexp_replace("domain", ":", "_").alias("host"), "run_id",
        as_document(F.to_json(F.struct(*StructType.fromDDL(snapshots.SNAPSHOT).names), {"ignoreNullFields": "false"})).alias("document"),
    )


@F.arrow_udf(StringType())
def as_document(text: pa.Array) -> pa.Array:
    """The contract's form: observations hold ``value``, not its text; fields that may be missing go if they are null."""
    return in_pieces(lambda t: written_form(json.loads(t)), StringType(), text)


def written_form(document: dict) -> str:
    for o in document["observations"].values():
        o["value"] = json.loads(o.pop("value_json") or "null")
        o["evidence"] = [{k: v for k, v in e.items() if v is not None} for e in o.get("evidence") or []]
    document["requests"] = [{k: v for k, v in r.items() if v is not None} for r in document.get("requests") or []]
    document["errors"] = document.get("errors") or []
    return json.dumps(document, sort_keys=True, separators=(",", ":"))


def write_once(found: DataFrame, root: str) -> None:
    """Add the runs that the tree doesn't hold yet, all or none of them; each run once, also if it is given twice.

    A run that is held with another document, or given with two, fails before anything is written.
    """
    spark = found.sparkSession
    register(spark)
    new = documents_of(found).groupBy("date", "host", "run_id").agg(F.min("document").alias("document"), (F.min("document") != F.max("document")).alias("torn"))
    new = written(new, "snapshots-new")  # made once: its days are looked up, and it meets what is held
    days = [r["date"] for r in new.select("date").distinct().collect()]
    if not days:
        return
    held = spark.read.format(FORMAT).option("strict", "false").load(root).where(F.col("date").isin(days))
    digest = lambda text: F.sha2(text, 256)
    # Documents are compared by their digests, so those that are held aren't shuffled.
    held = held.select("date", "host", "run_id", digest(F.col("document")).alias("digest")).groupBy("date", "host", "run_id").agg(F.min("digest").alias("held"), F.max("digest").alias("held_too"))
    both = new.join(held, ["date", "host", "run_id"], "left")
    # Only documents of held runs are normalised, to be compared.
    normal = F.coalesce(snapshots.normalised(F.when(F.col("held").isNotNull(), F.col("document")))["json"], F.col("document"))
    clashes = F.coalesce(F.col("torn") | (digest(F.col("normal")) != F.col("held")) | (F.col("held") != F.col("held_too")), F.lit(False))
    judged = both.withColumn("normal", normal).select("date", "host", "run_id", F.when(F.col("held").isNull(), F.col("document")).alias("document"), clashes.alias("clashes"))
    judged = written(judged, "snapshots-judged")
    clash = judged.where("clashes").select("run_id").first()
    if clash is not None:
        raise ValueError(f"run {clash['run_id']} is there with another document")
    rows = judged.where("document is not null").select("date", "host", "run_id", "document")
    rows.repartition("date", "host").sortWithinPartitions("date", "host", "run_id").write.format(FORMAT).mode("append").option("path", root).save()
