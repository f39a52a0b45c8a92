"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Each test item is cut into windows of ``WINDOW`` words. In every window the least hash of its word
k-grams is kept as a fingerprint, so any two texts that share ``WINDOW`` consecutive words share a
fingerprint. Three joins find every shared window:

1. Documents are fingerprinted in the same way, and their fingerprints joined with those of the test
   items (a distinct table).
2. Documents with a hit are read again: each window around a hit is a candidate, by its words.
3. Candidates are joined with the windows of the test items, one row for each distinct window with all
   its items. Equal keys are equal words, so the result is exact.

All tables are written to the shared folder, so Spark knows their sizes and broadcasts the test side
where it is small; where it isn't, both sides are dealt by key, and skewed keys (a passage that a third
of the documents holds) are split. Nothing of the benchmark but the lengths of its windows (at most
``WINDOW`` numbers) passes through the driver. Words are hashed and winnowed in pieces, so a long text
costs eight bytes a word.

Items of fewer words than the window form one window each. Null or wordless texts have no
windows. Items that share an id count once. Rows with the same doc_id and text are one document to the
joins and have the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, free_names, id_or_last, mix64, sliding_argmin, written

WINDOW = 10
CHUNK_WORDS = 1 << 20
PIECE_BYTES = 1 << 22

WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Runs of digits, letters and non-ASCII characters; A-Z in lower case; in lists of bounded size."""
    clean, at = text.translate(WORD_BYTES), 0
    while at < len(clean):
        stop = at + PIECE_BYTES
        if stop < len(clean):
            stop = clean.find(b" ", stop)
            stop = len(clean) if stop < 0 else stop
        yield clean[at:stop].split()
        at = stop


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    lists = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) for words in word_lists(text)]
    return np.concatenate(lists) if lists else np.zeros(0, dtype=np.uint64)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes."""
    out = words[: max(0, len(words) - size + 1)].copy()
    for i in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : len(words) - size + 1 + i]
    return mix64(out)


def gram_size(length: int) -> int:
    """Words in the grams of windows of ``length`` words."""
    return (length + 1) // 2


def winnowed(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all windows of ``length`` words: positions and hashes."""
    size = gram_size(length)
    width = length - size + 1
    kept = []
    for begin in range(0, len(words) - length + 1, CHUNK_WORDS):
        grams = gram_hashes(words[begin : begin + CHUNK_WORDS + length - 1], size)
        kept.append(np.unique(sliding_argmin(grams, width)) + begin)
    at = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    return at, gram_hashes(words, size)[at]


PRINTS = pa.list_(pa.struct([("length", pa.int32()), ("print", pa.int64()), ("at", pa.int32())]))
PRINTS_SQL = "array<struct<length: int, print: long, at: int>>"
KEY = ("_id", "_hash")  # tells documents apart


def key_columns(text: str = "text") -> list[Column]:
    return [id_or_last().alias("_id"), F.xxhash64(text).alias("_hash")]


def lists(values: list[np.ndarray], sizes: list[int]) -> pa.ListArray:
    """Arrow lists of fingerprints from columns laid end to end."""
    columns = [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["length", "print", "at"]))


def document_prints(docs: DataFrame, lengths: list[int], text: str = "text") -> DataFrame:
    """doc_id, KEY, n_words and prints of each row."""
    rows = docs.select(F.col("doc_id"), *key_columns(text), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_rows(batch.column("text"))
            begin = 0
            while begin < len(texts):
                # One array of words for several texts, a word that is none between them.
                held, total, end = [], 0, begin
                while end < len(texts) and (not held or total < CHUNK_WORDS // 8):
                    held += [word_hashes(texts[end]), np.zeros(1, np.uint64)]
                    total += len(held[-2]) + 1
                    end += 1
                words = np.concatenate(held)
                n = np.array([len(h) for h in held[::2]], dtype=np.int64)
                first = np.cumsum(n + 1) - (n + 1)
                row, length, prints, at = [], [], [], []
                for size in lengths:
                    where, value = winnowed(words, size)
                    which = np.searchsorted(first, where, "right") - 1
                    inside = where - first[which] + gram_size(size) <= n[which]
                    row.append(which[inside])
                    length.append(np.full(int(inside.sum()), size, dtype=np.int32))
                    prints.append(value[inside].view(np.int64))
                    at.append((where - first[which])[inside])
                r = np.concatenate(row) if row else np.zeros(0, np.int64)
                order = np.argsort(r, kind="stable")
                columns = [np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (length, prints, at)]
                found = lists(columns, np.bincount(r, minlength=len(n)).tolist())
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *KEY)), pa.array(n), found], ["doc_id", *KEY, "n_words", "prints"])
                begin = end

    return rows.mapInArrow(run, f"doc_id {kind}, _id long, _hash long, n_words long, prints {PRINTS_SQL}")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, window, items, prints): each distinct window of the test items with all items that hold it."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), byte_rows(batch.column("text")), strict=True):
                words = [w for part in word_lists(text) for w in part]
                length = min(window, len(words))
                if not length:
                    continue
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
                grams = gram_hashes(hashes, gram_size(length))
                prints = grams[sliding_argmin(grams, length - gram_size(length) + 1)].view(np.int64)
                n = len(words) - length + 1
                for at in range(0, n, 1 << 15):
                    texts = [b" ".join(words[j : j + length]) for j in range(at, min(n, at + (1 << 15)))]
                    columns = [pa.array([length] * len(texts), pa.int32()), pa.array(texts, pa.binary()), pa.array([item] * len(texts)), pa.array(prints[at : at + len(texts)])]
                    yield pa.RecordBatch.from_arrays(columns, ["length", "window", "item", "print"])

    windows = rows.mapInArrow(run, "length int, window binary, item string, print long")
    return windows.groupBy("length", "window").agg(F.collect_set("item").alias("items"), F.first("print").alias("print"))


def candidate_windows(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(KEY, start, length, window) of every window around a hit; ``hits`` has KEY and hits (length, at)."""
    rows = docs.join(hits, list(KEY)).select(*KEY, "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (text, hits) in enumerate(zip(byte_rows(batch.column("text")), batch.column("hits").to_pylist(), strict=True)):
                words = [w for part in word_lists(text) for w in part]
                near = sorted({(h["length"], s) for h in hits for s in range(h["at"] - h["length"] + gram_size(h["length"]), h["at"] + 1) if 0 <= s <= len(words) - h["length"]})
                for at in range(0, len(near), 1 << 15):
                    part = near[at : at + (1 << 15)]
                    texts = pa.array([b" ".join(words[s : s + n]) for n, s in part], pa.binary())
                    keys = [pa.repeat(batch.column(k)[row], len(part)) for k in KEY]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([s for _, s in part], pa.int32()), pa.array([n for n, _ in part], pa.int32()), texts], [*KEY, "start", "length", "window"])

    return rows.mapInArrow(run, "_id long, _hash long, start int, length int, window binary")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def with_spans(found: DataFrame) -> DataFrame:
    """(KEY, hit_spans, items) from (KEY, windows, items): windows merged where they touch or overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for windows in batch.column("windows").to_pylist():
                spans: list[dict[str, int]] = []
                for start, end in sorted((w["start"], w["start"] + w["length"]) for w in windows):
                    if spans and start <= spans[-1]["end"]:
                        spans[-1]["end"] = max(end, spans[-1]["end"])
                    else:
                        spans.append({"start": start, "end": end})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(out, SPANS), batch.column("items")], [*KEY, "hit_spans", "items"])

    return found.select(*KEY, "windows", "items").mapInArrow(run, "_id long, _hash long, hit_spans array<struct<start: int, end: int>>, items array<string>")


def shared_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Prints of all rows (doc_id, KEY, n_words), and (KEY, hit_spans, items) of the documents that share a window."""
    tests = written(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r["length"] for r in tests.select("length").distinct().collect())
    test_prints = written(tests.select("length", "print").distinct(), "prints")
    scanned = written(document_prints(docs, lengths, text), "scanned")
    mine = scanned.select(*KEY, F.inline("prints"))
    met = mine.join(test_prints, ["length", "print"]).groupBy(*KEY).agg(F.collect_set(F.struct("length", "at")).alias("hits"))
    hits = written(met, "hits")
    candidates = candidate_windows(docs.select(*key_columns(text), F.col(text).alias("text")), hits)
    verified = candidates.join(tests.drop("print"), ["length", "window"]).groupBy(*KEY)
    found = verified.agg(F.collect_set(F.struct("start", "length")).alias("windows"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return scanned.drop("prints"), written(with_spans(found), "found")


def with_key(docs: DataFrame, text: str, found: DataFrame) -> tuple[DataFrame, list[str], DataFrame]:
    """``docs`` with the key's columns, their names (none that ``docs`` has), and ``found`` under those names."""
    key = free_names(docs, *KEY)
    named = docs.select("*", *(c.alias(k) for c, k in zip(key_columns(text), key)))
    return named, key, found.withColumnsRenamed(dict(zip(KEY, key)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, end excluded) and items of the benchmark found.

    Columns of these names in ``docs`` are replaced. ``benchmark`` has item_id and text.
    """
    _, found = shared_windows(docs, benchmark, text, window)
    rest = docs.drop("n_words", "hit_spans", "items")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    named, key, found = with_key(rest, text, found)
    named = named.withColumn("n_words", words)
    none = F.array().cast("array<struct<start: int, end: int>>")
    return named.join(found, key, "left").select(
        *rest.columns, "n_words", F.coalesce("hit_spans", none).alias("hit_spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark."""
    _, found = shared_windows(docs, benchmark, text, window)
    named, key, found = with_key(docs, text, found)
    return named.join(found.select(*key), key, "left_anti").select(*docs.columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, words hit, items with a window in it, and their digest."""
    scanned, found = shared_windows(docs.select("doc_id", "text"), benchmark)
    hit = F.coalesce(F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return scanned.join(found, list(KEY), "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
