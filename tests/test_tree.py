"""The snapshot tree as a data source: pruning, strict and reporting reads, writes that commit once or not at all."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weblathe.sources import snapshots, tree

from .test_operators import observed, snapshot


def laid_out(root, *documents):
    """A tree with one document to a file, indented, as the published layout has it."""
    for doc in documents:
        folder = root / doc["completed_at"][:10] / doc["domain"]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{doc['run_id']}.json").write_text(json.dumps(doc, indent=2) + "\n")


@pytest.fixture
def made():
    return [snapshot(f"{h}.example", f"{h}{d}", f"2026-01-0{d}T00:00:00Z", {"crawler.robots_exists": observed(d % 2 == 0)}) for h in "ab" for d in (1, 2, 3)]


def test_folders_are_chosen_before_files_are_opened(spark, tmp_path, made, capsys):
    laid_out(tmp_path, *made)
    (tmp_path / "2026-01-01" / "a.example" / "a1.json").write_text("broken")  # never opened below
    (tmp_path / "_staged").mkdir()
    found = tree.load(spark, str(tmp_path)).where("date > '2026-01-01' and host = 'a.example'")
    found.explain("formatted")
    assert "PushedFilters: [GreaterThan(date,2026-01-01), EqualTo(host,a.example)]" in capsys.readouterr().out
    assert sorted(r["run_id"] for r in found.collect()) == ["a2", "a3"]
    reader = tree.TreeReader(str(tmp_path), True, 1)
    list(reader.pushFilters([tree.In(("host",), ("b.example",)), tree.LessThanOrEqual(("date",), dt.date(2026, 1, 2))]))
    assert [f.folders[0][:2] for f in reader.partitions()] == [(dt.date(2026, 1, 1), "b.example"), (dt.date(2026, 1, 2), "b.example")]


def test_strict_and_reporting_reads(spark, tmp_path, made):
    laid_out(tmp_path, *made)
    assert tree.load(spark, str(tmp_path)).count() == 6
    plain = snapshots.read_snapshots(spark, str(tmp_path))
    columns = ("run_id", "domain", "request_count", "observations")
    assert sorted(map(repr, tree.load(spark, str(tmp_path)).select(*columns).collect())) == sorted(map(repr, plain.select(*columns).collect()))
    bad = {**made[0], "run_id": "odd", "extra": 1}
    laid_out(tmp_path, bad, {**made[1], "run_id": "minus", "request_count": -1})
    seen = {r["problem"] for r in tree.load(spark, str(tmp_path), strict=False).where("problem is not null").collect()}
    assert seen == {"snapshot has unknown fields ['extra']", "request_count must not be negative"}
    with pytest.raises(Exception, match="invalid snapshot .*odd.json: snapshot has unknown fields"):
        tree.load(spark, str(tmp_path)).collect()


def test_an_empty_root_is_an_error_only_if_strict(spark, tmp_path):
    (tmp_path / "none").mkdir()
    for root in (tmp_path / "none", tmp_path / "missing"):
        assert tree.load(spark, str(root), strict=False).count() == 0
        with pytest.raises(Exception, match="no snapshots below"):
            tree.load(spark, str(root)).count()
    with pytest.raises(ValueError, match="no snapshots below"):
        snapshots.read_snapshots(spark, str(tmp_path / "none"))


def test_the_same_write_twice_leaves_one_copy(spark, tmp_path, made):
    laid_out(tmp_path / "given", *made)
    found = tree.load(spark, str(tmp_path / "given"))
    out = tmp_path / "out"
    tree.write_once(found.where("run_id <> 'a2'"), str(out))
    tree.write_once(found.unionByName(found), str(out))
    tree.write_once(found, str(out))
    again = tree.load(spark, str(out))
    assert sorted(r["run_id"] for r in again.collect()) == ["a1", "a2", "a3", "b1", "b2", "b3"]
    assert sorted(map(repr, again.drop("date", "host").collect())) == sorted(map(repr, found.drop("date", "host").collect()))
    assert not list((out / "_staged").iterdir())


def test_another_document_under_a_known_run_is_refused(spark, tmp_path, made):
    laid_out(tmp_path / "given", *made)
    found = tree.load(spark, str(tmp_path / "given"))
    out = str(tmp_path / "out")
    tree.write_once(found.where("run_id = 'a1'"), out)
    with pytest.raises(ValueError, match="run a1 is there"):
        tree.write_once(found.withColumn("request_count", F.lit(9)), out)
    assert tree.load(spark, out).count() == 1
    with pytest.raises(ValueError, match="run b1 is there"):
        tree.write_once(found.where("run_id = 'b1'").unionByName(found.where("run_id = 'b1'").withColumn("request_count", F.lit(9))), out)


def test_a_failed_write_leaves_nothing(spark, tmp_path, made):
    tree.register(spark)
    fails = F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("{}"))
    rows = spark.range(100).repartition(4).select(F.to_date(F.lit("2026-01-01")).alias("date"), F.lit("h").alias("host"), F.col("id").cast("string").alias("run_id"), fails.alias("document"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format(tree.FORMAT).mode("append").option("path", str(tmp_path)).save()
    assert [p for p in tmp_path.rglob("*.json") if tree.STAGED not in p.parts] == []
    assert tree.load(spark, str(tmp_path), strict=False).count() == 0
    with pytest.raises(Exception, match="never overwritten"):
        rows.write.format(tree.FORMAT).mode("overwrite").option("path", str(tmp_path)).save()


def test_a_commit_that_stopped_halfway_is_completed(spark, tmp_path, made):
    laid_out(tmp_path / "given", *made)
    found = tree.load(spark, str(tmp_path / "given"))
    out = tmp_path / "out"
    tree.write_once(found, str(out))
    lost = next(out.rglob("2026-01-02/b.example/*.json"))
    lost.unlink()  # as if the driver had died before it moved this one
    tree.write_once(found, str(out))
    assert sorted(r["run_id"] for r in tree.load(spark, str(out)).collect()) == ["a1", "a2", "a3", "b1", "b2", "b3"]


def test_a_write_makes_each_snapshot_once(spark, tmp_path, made):
    laid_out(tmp_path / "given", *made)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    found = tree.load(spark, str(tmp_path / "given")).withColumn("collector_version", counted("collector_version"))
    tree.write_once(found, str(tmp_path / "out"))
    assert seen.value == len(made) and tree.load(spark, str(tmp_path / "out")).count() == len(made)
