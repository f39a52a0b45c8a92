"""The Merkle manifest against a plain version, and its proofs as a verifier uses them."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weblathe.llm import merkle

from .conftest import SCHEMA


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def first_null(value):
    return (value is not None, value if value is not None else 0)


def climb(level, at):
    """The digest at the top and the siblings of leaf ``at`` on the way."""
    path = []
    while len(level) > 1:
        run = at // 8 * 8
        path.append((level[run:at], level[at + 1 : run + 8]))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at //= 8
    return level[0], path


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        shown = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf = leaf_of((doc_id, source, lang, n_chars, text))
        groups.setdefault(lang, []).append((first_null(doc_id), leaf, leaf_of((doc_id, source, lang, n_chars, shown)), doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort()
    subroots = [climb([r[1] for r in groups[g]], 0)[0] for g in order]
    out = []
    for t, g in enumerate(order):
        for i, (_, leaf, shown, doc_id) in enumerate(groups[g]):
            path = climb([r[1] for r in groups[g]], i)[1]
            root, more = climb(subroots, t)
            node = shown
            for before, after in path + more:
                node = sha("".join(before) + node + "".join(after))
            siblings = "".join("".join(b) + "".join(a) for b, a in path + more)
            out.append((doc_id, leaf, subroots[t], root, sha(siblings), node, node == root))
    return out


def made(n, langs, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Gämma", "delta", "\U0001f600"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "x"]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        rows.append((None if rng.random() < 0.05 else rng.randrange(-50, n), text, rng.choice(langs), rng.choice(["a", None]), None if text is None else len(text)))
    return rows + rows[: n // 5]


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(
    "rows",
    [
        made(700, ["en", "en", "en", "de", None, "z", "ä"], 1),
        made(90, [f"l{i}" for i in range(70)], 2),
        made(64, ["en"], 3)[:64],
        [(i, f"Text {i}", f"g{n}", "s", 6) for n in (65, 73, 513) for i in range(n)],
        [(1, "One", "en", "s", 3)],
        [(i, f"Text {i}", "en", "s", 6) for i in range(9)] + [(3, "Lone", "fr", "s", 4)],
        [(5, "The same row", "en", "s", 12)] * 80,
    ],
    ids=["groups", "many groups", "a full tree", "lone nodes in runs", "one row", "nine and one", "one row repeated"],
)
def test_report_equals_plain_version(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in merkle.manifest_report(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_empty_and_odd_tables(spark, nothing, odd):
    assert merkle.manifest_report(nothing).collect() == []
    clashing = odd.withColumns({c: F.lit("mine") for c in ("index", "tree", "size", "digest", "_part", "_place", "level", "group", "steps")})
    want = plain([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in odd.collect()])
    assert sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest_report(clashing).collect()), key=repr) == sorted(want, key=repr)


def test_coordinates_at_every_index(spark):
    for size in (1, 2, 8, 9, 64, 65, 513):
        got = spark.range(size).select("id", merkle.coordinates("id", str(size), 0).alias("c")).collect()
        for r in got:
            want, at, n, level = [], r["id"], size, 0
            while n > 1:
                want += [(level, i) for i in range(at // 8 * 8, min(at // 8 * 8 + 8, n)) if i != at]
                at, n, level = at // 8, -(-n // 8), level + 1
            assert [tuple(c) for c in r["c"]] == want


def test_some_leaves_only(spark):
    rows = [(i, f"Text {i}", "en" if i % 3 else "de", "s", 6) for i in range(100)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    few = found.leaves.where("doc_id in (4, 98)")  # 98 is alone in its run, and the run in the one above
    proved = merkle.proofs(found, few)
    assert proved.count() == 2
    assert proved.where(merkle.folded(F.col("digest"), F.col("steps")) == F.col("root")).count() == 2
    assert proved.where(merkle.folded(F.unhex(F.lit("00" * 32)), F.col("steps")) == F.col("root")).count() == 0
