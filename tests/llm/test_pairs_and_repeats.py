"""Operators that compare documents: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weblathe.llm import chunking, common, decontaminate, runindex, simhash

from . import brute


def plain_similar(texts):
    """Groups of texts by definition: every pair of shingle sets."""
    words = {i: brute.WORD.findall(brute.lower(t)) for i, t in texts}
    sets = {i: {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}, pairs


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_texts_are_found(spark):
    rng = random.Random(21)
    texts = []
    for n in range(60):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400)))
        texts.append((10 * n, base))
        size = len(base.split())
        for k in range(rng.randrange(4)):
            texts.append((10 * n + 1 + k, edited(rng, base, max(1, round(size * rng.choice([0.003, 0.008, 0.015, 0.02, 0.05]))))))
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    want, pairs = plain_similar(texts)
    got = {r["id"]: r["group"] for r in simhash.similar_groups(df).collect()}
    together = [(i, j) for i in want for j in want if i < j and want[i] == want[j]]
    caught = sum(got[i] == got[j] for i, j in together) / len(together)
    assert pairs > 50 and caught >= 0.9
    assert all(want[i] == want[g] for i, g in got.items()), "a group holds texts that no links connect"


def test_links_are_a_forest_of_close_pairs():
    value = np.unique(np.concatenate([np.array([c ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)], dtype=np.uint64) for c in (0, 2**63 - 1)]))
    forest = simhash.Forest(np.zeros(len(value), np.int64), value)
    a, b = forest.links(1, 2, 4)
    assert len(a) == len(value) - 2 and (np.bitwise_count(value[a] ^ value[b]) <= 4).all()


def test_simhash_groups_equal_brute_force(docs, rows):
    prints = {r[0]: brute.simhash(r[1]) for r in rows}
    want = brute.groups(prints)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


def test_simhash_links_random_fingerprints_with_chains(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(50)}
    for v in list(values)[:25]:
        for _ in range(12):
            v ^= 1 << rng.randrange(64)
            v ^= 1 << rng.randrange(64)
            values.add(v)
    prints = dict(enumerate(sorted(values, key=lambda _: rng.random())))
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "id long, fp long")
    roots = {r["id"]: r["root"] for r in simhash.connected(simhash.shard_links(nodes)).collect()}
    assert {i: roots.get(i, i) for i in prints} == brute.groups(prints)


def test_dense_group_stays_small():
    rng = np.random.default_rng(0)
    value = np.unique(np.array([1 << a | 1 << b for a in range(64) for b in range(a)], dtype=np.uint64))
    member, root = simhash.Forest(np.zeros(len(value), np.int64), value).spanning(2)
    assert len(member) == len(value) - 1 and set(root) == {0}


def test_one_of_each_group_keeps_columns_and_rows(docs, rows):
    want = {i for i, root in plain_similar([(r[0], r[1] or "") for r in rows])[0].items() if i == root}
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_simhash_odd_tables(odd, nothing):
    assert simhash.near_duplicate_groups(nothing).count() == 0
    assert simhash.near_duplicate_groups(odd).count() == 5
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 1").count() == 1


def test_run_index_removes_exactly_the_repeats(docs, rows):
    want = brute.repeats([(r[0], r[1]) for r in rows])
    got = {r[0]: tuple(r)[1:] for r in runindex.repeats_report(docs).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_run_index_hot_anchors_take_the_other_way_to_the_same_result(docs, rows):
    want = brute.repeats([(r[0], r[1]) for r in rows])
    assert {r[0]: tuple(r)[1:] for r in runindex.repeats_report(docs, hot_segments=1).collect()} == want


def test_run_index_odd_tables(odd, nothing):
    assert runindex.repeats_report(nothing).count() == 0
    got = runindex.repeats_report(odd).collect()
    assert len(got) == 5
    assert sorted(r["n_bytes"] for r in got) == sorted(len(r["text"] or "") for r in odd.collect())


@pytest.mark.parametrize("hot_segments", [1, 20_000])
def test_run_index_keeps_the_first_of_equal_rows(spark, hot_segments):
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    data = [(1, a), (1, a), (1, a), (2, b), (None, c), (None, c), (None, "short"), (None, "short"), (3, None), (3, None)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    whole = lambda i, t: (i, len(t), 0, 0, sha(t))
    gone = lambda i, t: (i, len(t), len(t), 1, sha(""))
    want = [whole(1, a), gone(1, a), gone(1, a), whole(2, b), whole(None, c), gone(None, c), *[whole(None, "short")] * 2, *[whole(3, "")] * 2]
    got = [tuple(r) for r in runindex.repeats_report(frame, hot_segments).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=10))
def test_run_index_streams_rows_and_matches(strings):
    index = runindex.RunIndex(strings, depth=6)
    suffixes = sorted(([c + 1 for c in s[i:]] + [0, k], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
    rank = {(k, i): n for n, (_, k, i) in enumerate(suffixes)}
    for read, which, row, match in index.stream():
        for k, q, m in zip(which.tolist(), row.tolist(), match.tolist(), strict=True):
            assert rank[k, len(strings[k]) - read] == q
            a, b = suffixes[q - 1][0][:-2], suffixes[q][0][:-2]
            same = 0
            while same < min(len(a), len(b)) and a[same] == b[same]:
                same += 1
            assert m == min(6, same if q else 0)


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(1)
    sizes = [500, 99, 100, 0, 1200]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    ends = np.cumsum(sizes)
    _, _, at, n = runindex.segments(data, ends)
    got = sorted(i for a, k in zip(at, n, strict=True) for i in range(a, a + k))
    assert got == [i for e, s in zip(ends, sizes, strict=True) for i in range(e - s, e - 99)]


def test_winnowing_equals_brute_force(spark, docs, rows):
    rng = random.Random(5)
    items = [(1, brute.prose(rng, 40)), (2, "w1 w2"), (3, rows[0][1][50:400]), (4, rows[14][1][3000:3300].upper()), (5, None), (6, " .. "), (7, rows[0][1][50:400]), (8, "ab ab ab ab ab ab ab ab ab ab ab")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination([(r[0], r[1]) for r in rows], items)
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination_report(docs, benchmark).collect()}
    assert got == want
    assert sum(w[4] for w in want.values()) >= 2
    found = decontaminate.find_contamination(docs, benchmark)
    assert {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), len(r["items"])) for r in found.collect()} == {i: w[:3] for i, w in want.items()}
    kept = decontaminate.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[4]}


def test_winnowing_by_shuffled_joins_and_in_small_pieces(spark, docs, rows, monkeypatch):
    rng = random.Random(9)
    long = brute.prose(rng, 5000)
    items = [(n, " ".join(long.split()[n * 7 : n * 7 + rng.randrange(1, 30)])) for n in range(40)] + [(99, "!")]
    texts = [(i, t) for i, t in [(r[0], r[1]) for r in rows] if t] + [(5000, long), (5001, long[5000:9000] + " " + items[3][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.word_hashes(long.encode())
    prints = [decontaminate.winnowed(whole, n) for n in (1, 4, 10)]
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 64)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 100)
    assert (decontaminate.word_hashes(long.encode()) == whole).all()
    for n, (at, value) in zip((1, 4, 10), prints, strict=True):
        parts = decontaminate.winnowed(whole, n)
        assert (parts[0] == at).all() and (parts[1] == value).all()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination_report(df, benchmark).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute.contamination(texts, items)


def test_winnowing_odd_tables(spark, odd, nothing):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontaminate.contamination_report(nothing, benchmark).count() == 0
    found = decontaminate.find_contamination(odd, benchmark)
    assert set(odd.columns) <= set(found.columns) and found.where(F.size("hit_spans") > 0).count() == 3
    assert decontaminate.contamination_report(odd, benchmark.limit(0)).where("contaminated").count() == 0


def plain_cuts(data):
    """Ends of chunks by definition: the sum over the last 16 bytes, each byte's word shifted by its age."""

    def word(byte):
        x = byte + 1
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1):
            x = (x ^ x >> 33) * factor % 2**64
        return x % 2**32

    words = [word(b) for b in range(256)]
    ends = [at + 1 for at in range(len(data)) if sum(words[data[at - k]] << k for k in range(min(16, at + 1))) % 2**32 < 2**32 // 32]
    return ends if not data or (ends and ends[-1] == len(data)) else [*ends, len(data)]


def chunk_brute(rows):
    first, out, texts = {}, {}, set()
    for i, text in sorted(rows):
        data, begin, spans = (text or "").encode(), 0, []
        if 0 < len(data) < 96 and data in texts:
            out[i] = (len(data), len(data), 1)
            continue
        texts.add(data)
        for end in plain_cuts(data):
            piece = data[begin:end]
            if piece in first:
                spans.append((begin, end))
            first.setdefault(piece, i)
            begin = end
        merged = []
        for a, b in spans:
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        merged = [(a, b) for a, b in merged if b - a >= 96]
        out[i] = (len(data), sum(b - a for a, b in merged), len(merged))
    return out


def test_chunks_equal_brute_force(docs, rows):
    want = chunk_brute([(r[0], r[1]) for r in rows])
    assert {r[0]: tuple(r)[1:] for r in chunking.chunk_report(docs).collect()} == want
    assert want[3][1] > 0


def test_exact_copies_go_whatever_their_length(spark):
    rng = random.Random(11)
    texts = ["a", "yes\n", *(brute.prose(rng, n)[:n * 5] for n in range(2, 30))]
    rows = [(copy * 100 + i, t) for i, t in enumerate(texts) for copy in range(3)] + [(900, "yes"), (901, "yes\nand more"), (902, ""), (903, "")]
    got = {r["doc_id"]: tuple(r)[1:] for r in chunking.chunk_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == chunk_brute(rows)
    assert all(got[i][1] == 0 and got[100 + i][:2] == got[200 + i][:2] == (len(t.encode()),) * 2 for i, t in enumerate(texts))
    assert all(got[i][1] == 0 for i in range(900, 904))


def test_chunks_resist_insertions():
    rng = random.Random(2)
    text = brute.prose(rng, 2000).encode()
    moved = text[:500] + b"inserted words" + text[500:]
    cut = lambda t: {t[a:b] for a, b in zip([0, *chunking.chunk_ends(t)[:-1]], chunking.chunk_ends(t), strict=True)}
    assert len(cut(text) - cut(moved)) <= 3


def test_chunk_borders_do_not_depend_on_blocks(monkeypatch):
    text = brute.prose(random.Random(4), 3000).encode()
    want = chunking.chunk_ends(text).tolist()
    monkeypatch.setattr(chunking, "BLOCK", 1000)
    assert chunking.chunk_ends(text).tolist() == want


def test_chunks_keep_the_first_of_repeated_ids_and_rows(spark):
    text = brute.prose(random.Random(7), 100)
    rows = [(2, text), (1, text), (1, text), (1, "other words"), (None, text), (None, text), (3, None)]
    got = sorted((r["doc_id"] or 9, r["n_removed"] > 0) for r in chunking.chunk_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(1, False), (1, False), (1, True), (2, True), (3, False), (9, True), (9, True)]


def test_chance_phrases_stay(spark):
    rng = random.Random(8)
    phrase = "as every reader of these pages knows well"
    rows = [(i, " ".join(f"w{rng.getrandbits(40)}" for _ in range(30)) + f" {phrase} " + " ".join(f"w{rng.getrandbits(40)}" for _ in range(30))) for i in range(50)]
    assert chunking.chunk_report(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").count() == 0


def test_chunks_odd_tables(odd, nothing, docs):
    assert chunking.chunk_report(nothing).count() == 0
    assert chunking.chunk_report(odd).count() == 5
    clash = odd.selectExpr("*", "'mine' as sub", "'mine' as _sub", "'mine' as _spans", "'mine' as spans")
    kept = chunking.without_repeats(clash)
    assert kept.columns == clash.columns and {(r["sub"], r["_sub"], r["_spans"], r["spans"], r["_id"]) for r in kept.collect()} == {("mine",) * 5}
    cleaned = chunking.without_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()


@pytest.mark.parametrize("text", [b"", b"   ", b"one", b"one two"])
def test_fingerprint_of_short_texts(text):
    assert simhash.fingerprint(text) == brute.simhash(text.decode())


@pytest.mark.parametrize("n", [3, 7, 8, 9, 50, 997])
def test_least_of_windows_over_blocks(n):
    rng = random.Random(n)
    values = np.array([rng.randrange(5) << 24 | rng.getrandbits(24) for _ in range(n)], dtype=np.uint64)
    for width in (1, 2, 3, 5):
        want = [min(range(i, i + width), key=lambda j: (int(values[j]) >> 24, j)) for i in range(n - width + 1)]
        assert common.sliding_argmin(values, width).tolist() == common.sliding_argmin(values, width, 8).tolist() == want
