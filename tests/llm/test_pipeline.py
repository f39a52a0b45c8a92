"""The pipeline, stage by stage, against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from weblathe.llm import mixing, quality

from . import brute
from .test_pairs_and_repeats import plain_similar
from .test_single_documents import jump


def plain_quality(rows):
    seen = {i: quality.inspect((t or "").encode()) for i, t in rows}
    fine = {i: v for i, (c, v) in seen.items() if c[0] >= 50 and 2 * c[4] <= c[0]}
    patterns = Counter(tuple(v) for v in fine.values())
    model = quality.LabelModel(np.array(sorted(patterns), dtype=np.int8), np.array([float(patterns[p]) for p in sorted(patterns)]))
    return {i for i, v in fine.items() if model.posterior(np.array([v], dtype=np.int8))[0] >= 0.5}


def plain_mix(spark, rows):
    recipe = corpus_pipeline.RECIPE
    domain = {s: d for d, ss in recipe.domain_sources.items() for s in ss}
    leaves = defaultdict(dict)
    for i, text, lang, source in rows:
        if n := len(brute.WORD.findall(text or "")):
            leaves[domain.get(source, "other"), lang or "", source or ""][i] = n
    table = spark.createDataFrame([(*k, sum(v.values())) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    budget = sum(sum(v.values()) for v in leaves.values()) * recipe.budget_percent // 100
    quota = {tuple(r)[:3]: r["quota"] for r in mixing.allocate(table, recipe, budget).collect()}
    kept = set()
    for leaf, sizes in leaves.items():
        left, epoch = quota[leaf], quota[leaf] // sum(sizes.values())
        for i in sorted(sizes, key=lambda i: hashlib.md5(f"42:{epoch if epoch < 1 else 0}:{i}".encode()).hexdigest()):
            if left > 0:
                kept.add(i)
                left -= sizes[i]
    return kept


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(11)
    item = " ".join(f"bench{rng.randrange(999)}" for _ in range(30))
    rows = []
    for i in range(80):
        words = "the of and to in is that river stone walks light morning people said where under".split()
        text = "\n".join(" ".join(rng.choice(words) + rng.choice(["", "s", "ed", str(rng.randrange(99))]) for _ in range(rng.randint(6, 14))) + "." for _ in range(rng.randint(8, 20)))
        rows.append([i, text, rng.choice(["en", "de"]), f"src{rng.choice([0, 0, 3, 9, 17])}", 0])
    for i in (5, 25, 45):
        rows[i][1] += " " + item + "."
    for i in (10, 30):
        rows[i][1] = rows[i - 1][1]
    rows[60][1], rows[61][1], rows[62][1] = None, "short", " ".join("x***" for _ in range(200))
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {r[0]: r for r in rows}
    seen, frame = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == docs.columns, name
        frame = spark.createDataFrame(out.collect(), docs.schema)
        seen.append({r["doc_id"] for r in frame.collect()})
        now = [(i, left[i][1]) for i in sorted(left)]
        if name == "quality_rules":
            want = plain_quality(now)
        elif name == "near_duplicates":
            want = {i for i, g in plain_similar([(i, t or "") for i, t in now])[0].items() if i == g}
        elif name == "decontamination":
            want = {i for i, found in brute.contamination(now, [(1, item)]).items() if not found[4]}
        else:
            want = plain_mix(spark, [tuple(left[i])[:4] for i in sorted(left)])
        assert seen[-1] == want, name
        assert want < set(left), f"{name} decides nothing"
        left = {i: left[i] for i in want}
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["shard"] for r in last.collect()} == {i: jump(i, 16) for i in left}
    assert {r["doc_id"]: r["text"] for r in last.collect()} == {i: r[1] for i, r in left.items()}


def test_entry_holds_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
