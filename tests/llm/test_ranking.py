"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblathe.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, best=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scored = []
        for doc, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=repr)


def made(seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "The", *(f"w{i}" for i in range(60)), "größe", "日本", "x_y", "a-b", "ÄB"]
    text = lambda n: " ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(300)]
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w9"), (500, None), (501, ""), (502, "... --"), (503, "the " * 5000 + "w1")]
    docs += [(i, "the very same text w5") for i in range(600, 630)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(40)] + [(3, "w59 more of item three"), (None, "w1 w2"), (90, None), (91, ""), (92, "nobody wrote this")]
    return docs, items


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)


@pytest.mark.parametrize("block", [ranking.BLOCK, 64, 8])
def test_equals_plain_version_in_any_blocks(spark, block):
    """Blocks of 64 pairs hold a few items each; of 8 pairs, most items are split and added again."""
    docs, items = made()
    if block == 8:
        items = items[:8] + items[-5:]
    got = ranking.search(*tables(spark, docs, items), block=block)
    assert rows(got) == plain(docs, items)


def test_runs_are_cut_and_heaps_keep_the_best(spark):
    docs, items = made(6)
    assert rows(ranking.search(*tables(spark, docs, items), best=3, at_once=50)) == plain(docs, items, 3)


def test_radix_order():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 1 << 32, 5000, dtype=np.uint32)
    key[100:200] = key[0]
    assert (ranking.radix_order(key) == np.argsort(key, kind="stable")).all()


def test_odd_and_empty_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, "eleven another"), (2, "two")], "item_id long, text string").withColumns({c: F.lit("mine") for c in ("term", "rank", "place", "block", "n")})
    assert ranking.search(nothing, items).collect() == []
    assert ranking.search(odd, items.where("false")).collect() == []
    clashing = odd.withColumns({c: F.lit("mine") for c in ("doc_row", "term", "df", "place", "rank")})
    want = plain([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "eleven another"), (2, "two")])
    assert rows(ranking.search(clashing, items)) == want and want


def test_long_texts(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(3000)]
    docs = [(1, " ".join(rng.choice(names) for _ in range(300_000))), (2, "QUJD" * 250_000), (3, "n1 n2")]
    items = [(1, " ".join(names) + " qujd"), (2, "qujd" * 250_000), (3, " ".join(names[:2]))]
    assert rows(ranking.search(*tables(spark, docs, items))) == plain(docs, items)
