"""Very long texts: three million characters of lines, one word of a million, one line of two million."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weblathe.llm import chunking, decontaminate, lattice, licences, mixing, quality, runindex, sharding, simhash


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(13)
    names = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    lines = "\n".join(" ".join(rng.choice(names) for _ in range(12)) for _ in range(36_000))
    rows = [(1, lines), (2, "QUJD" * 250_000), (3, " ".join(rng.choice(names) for _ in range(290_000))), (4, "a short text of some words"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("src0"), "n_chars": F.length("text").cast("long")}).repartition(2).cache()


REPORTS = {
    "op1": lambda docs, bench: mixing.mix_report(docs),
    "op2": lambda docs, bench: quality.quality_report(docs),
    "op3": lambda docs, bench: runindex.repeats_report(docs),
    "op4": lambda docs, bench: sharding.shard_documents(docs),
    "op5": lambda docs, bench: simhash.near_duplicate_groups(docs),
    "op6": decontaminate.contamination_report,
    "op8": lambda docs, bench: lattice.lattice_report(docs),
    "op9": lambda docs, bench: chunking.chunk_report(docs),
    "op10": lambda docs, bench: licences.licence_report(docs),
    "near_duplicates": lambda docs, bench: simhash.one_of_each_group(docs),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_every_document_has_its_result(spark, long_docs, name):
    text = long_docs.where("doc_id = 3").first()["text"]
    bench = spark.createDataFrame([(1, text[1_000_000:1_000_400])], "item_id long, text string")
    got = REPORTS[name](long_docs, bench).collect()
    wordless = {5, 6}
    ids = {r["doc_id"] for r in got}
    if name == "op1":
        assert ids <= {1, 2, 3, 4} and 1 in ids
    elif name == "near_duplicates":
        assert ids == {1, 2, 3, 4, 5}  # the two wordless texts are one group
    else:
        assert ids == {1, 2, 3, 4} | wordless
    if name == "op6":
        assert {r["doc_id"] for r in got if r["contaminated"]} == {3}
    if name == "op8":
        assert all(r["score"] < 0 for r in got)


def test_the_pipeline_runs_over_them(spark, long_docs, tmp_path):
    long_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a few words that nobody wrote")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 6


def test_the_stages_take_empty_repeated_and_odd_tables(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(1, "a few words that nobody wrote")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
        kept = stage(spark, odd, str(tmp_path))
        assert kept.columns == odd.columns and kept.where("votes <> 'mine' or _id <> 'mine' or _hash <> 'mine' or _q_votes <> 'mine'").count() == 0, name
    kept = simhash.one_of_each_group(odd)
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id is null and text is null").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() == 5
