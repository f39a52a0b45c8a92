"""Boosted trees: statistics, fitting and traversal against plain versions, accuracy on held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblathe.llm import boosting
from weblathe.llm.quality import COMMON_WORDS

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_statistics(text: bytes) -> dict[str, float]:
    words = WORD.findall(text)
    n, size = len(words), len(text)
    if not n:
        return dict.fromkeys(boosting.FEATURES, 0.0)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    count = lambda chars: sum(b in chars for b in text)
    mark = lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum()
    lines = [line for line in text.split(b"\n") if WORD.search(line)]
    upper, lower = sum(65 <= b <= 90 for b in text), sum(97 <= b <= 122 for b in text)
    common = {f.encode() for w in COMMON_WORDS for f in (w, w.capitalize(), w.upper())}
    return {
        "log_words": np.log1p(n),
        "word_bytes": sum(map(len, words)) / n,
        "longest_word": np.log1p(max(map(len, words))),
        "symbols": count(b"#*$%&<>~^=+@\\{}[]_") / size,
        "bars": count(b"|") / n,
        "shouts": count(b"!?") / n,
        "commas": count(b",") / n,
        "stops": count(b".") / n,
        "digits": count(b"0123456789") / size,
        "capitals": upper / max(1, upper + lower),
        "high_bytes": sum(b > 127 for b in text) / size,
        "spaces": count(b" \t\n\r\x0b\x0c") / size,
        "stutter": sum(a == b for a, b in zip(words, words[1:])) / n,
        "repeats": len(covered) / n,
        "distinct": len(set(words)) / n,
        "richness": len(set(words)) / n**0.75,
        "top_word": max(Counter(words).values()) / n,
        "doubled_lines": 1 - len(set(lines)) / len(lines),
        "line_words": np.log1p(n / len(lines)),
        "ended_lines": sum(line.rstrip()[-1:] in (b".", b"!", b"?", b":", b";", b'"', b"'") for line in lines) / len(lines),
        "common_words": sum(w in common for w in words) / n,
        "bare_marks": sum(all(map(mark, w)) for w in words) / n,
        "marked_ends": sum(len(w) > 1 and mark(w[-1]) and mark(w[-2]) for w in words) / n,
        "capital_words": sum(len(w) > 1 and w.isupper() for w in words) / n,
        "compressed": len(zlib.compress(text, 1)) / size,
    }


def test_statistics_equal_plain_version():
    rng = random.Random(3)
    alphabet = ["the", "The", "DER", "äö", "a", "!!", "x#", "end.", "say!!", "\n", "\n\n", "|", "12", "...", "y,", "日本", "\t", " "]
    for _ in range(300):
        text = " ".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))).encode()
        want = plain_statistics(text)
        got = dict(zip(boosting.FEATURES, boosting.statistics(text), strict=True))
        assert got == pytest.approx(want), text


def walked(trees, row):
    odds = trees.base
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node]
        odds += trees.value[node]
    return odds


def made(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, 6)).astype(np.float32)
    rows[:, 5] = np.round(rows[:, 5])
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 1] * rows[:, 5] > 0.5)).astype(float)
    return rows, labels


def test_traversal_equals_single_walks_and_fits():
    rows, labels = made()
    trees = boosting.fit(rows[:2000], labels[:2000], np.ones(2000))
    assert len(trees.roots) == 60 and trees.depth >= 3
    odds = trees.odds(rows)
    assert odds[:300] == pytest.approx([walked(trees, r) for r in rows[:300]])
    assert ((odds[2000:] > 0) == labels[2000:]).mean() > 0.95
    assert trees.odds(rows[:0]).shape == (0,)


def test_first_cut_is_the_best_of_all():
    rows, labels = made(400, 2)
    settings = boosting.Settings(trees=1, leaves=2, bins=512)
    trees = boosting.fit(rows, labels, np.ones(400), settings)
    p = labels.mean()
    g, h = p - labels, np.full(400, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + settings.ridge)
    gains = {}
    for j in range(rows.shape[1]):
        for v in np.unique(rows[:, j]):
            low = rows[:, j] <= v
            if min(h[low].sum(), h[~low].sum()) >= settings.least:
                gains[j, v] = score(low) + score(~low)
    best = max(gains, key=gains.get)
    root = trees.roots[0]
    assert (trees.feature[root], np.float32(trees.cut[root])) == best
    for child, side in ((trees.left[root], rows[:, best[0]] <= best[1]), (trees.right[root], rows[:, best[0]] > best[1])):
        assert trees.value[child] == pytest.approx(-settings.rate * g[side].sum() / (h[side].sum() + settings.ridge))


def test_weights_count_as_repeated_rows():
    rows, labels = made(500, 3)
    weights = np.random.default_rng(4).integers(1, 4, 500)
    settings = boosting.Settings(trees=5, bins=1024)
    a = boosting.fit(rows, labels, weights.astype(float), settings)
    b = boosting.fit(np.repeat(rows, weights, axis=0), np.repeat(labels, weights), np.ones(weights.sum()), settings)
    assert a.probability(rows) == pytest.approx(b.probability(rows), abs=0.02)


def test_held_out_rows_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = boosting.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(out) > 50 and sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95


def test_labels_that_are_held_out_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(boosting.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, boosting.classify(docs, table).collect())) for table in (labels, turned))
    assert a == b


def test_sample_is_bounded(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows, marks, weights = boosting.sampled(boosting.with_statistics(docs), labels, 100)
    assert 60 <= len(rows) <= 140 and len(marks) == len(weights) == len(rows)


def test_odd_and_empty_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, quality int").withColumn("text", F.lit("mine"))
    assert boosting.classify(nothing, labels).collect() == []
    clashing = odd.withColumns({c: F.lit("mine") for c in ("quality", "weight", "symbols", "held_out")})
    got = boosting.classify(clashing, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False, False]
    assert {r["score"] for r in boosting.classify(odd, labels.where("false")).collect()} == {0.5}
    assert min(r["score"] for r in boosting.classify(odd, labels.where("quality = 1")).collect()) > 0.99


def test_long_texts(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(1, " ".join(f"n{rng.randrange(10**5)}" for _ in range(300_000))), (2, "QUJD" * 250_000), (3, None), (4, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in boosting.classify(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect()} == {1, 2, 3, 4}
