"""Ranked lexical search by sort-based accumulation: the best documents for each of many items.

Two passes over the documents. The first counts documents, terms and, for the items' terms, the documents
that hold them; it combines in the task before anything is shuffled. The second holds every document
against the items, a block of items at a time. A task goes through its own range of the documents in
runs of at most 65,536. For each run the matched (item, document, impact) arrays are concatenated, the pairs
packed into one key, radix sorted by its two 16-bit halves and added up with reduceat; a heap of the best is kept
for each item. A document lies whole in one run, so no sum crosses tasks. What leaves a task is its
heaps, at most ``best`` rows an item; they meet by item, ranked partly before the shuffle.

The items' index: blocks hold at most 2 x ``block`` (item, term) pairs, so what is sent to the tasks is
bounded however many items there are; more items are more passes. An item whose terms don't fit one
block gets no heaps: its partial sums leave the tasks for every document, are range-partitioned by item
and document and added there, which is exact as well.

Defined results. Null and empty texts have no terms: they aren't counted and never found; an item
without known terms finds nothing. Rows of one item_id are one item, their terms united; null is an item
of its own. Every document row is ranked by itself, also if ids or whole rows repeat; equal scores go
by ascending doc_id, null last. Long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, numbered, written

BEST = 10
BLOCK = 1 << 18  # (item, term) pairs of a block
RUN = 1 << 20  # matched pairs of documents and terms, or of documents and items, that are sorted at once
HALF = 1 << 16
FLUSH = 1 << 17
# Term bytes: digits, letters (lower-cased) and all bytes of characters beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [sorted(set(terms_of(t))) for t in byte_rows(part.column("text"))]
                ids = part.column("item_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())], ["item_id", "term"])

    rows = items.select("item_id", "text")
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string").distinct()


def term_counts(docs: DataFrame) -> DataFrame:
    """term, df, n: rows to add up. Of null terms, df counts the documents that have terms and n their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "df", "n"]
        seen: Counter[bytes] = Counter()
        n_docs = n_terms = 0

        def flush() -> pa.RecordBatch:
            terms = pa.array([*seen, None], pa.binary()).cast(pa.string())
            counts = pa.array([*seen.values(), n_docs], pa.int64())
            return pa.RecordBatch.from_arrays([terms, counts, pa.array([0] * len(seen) + [n_terms], pa.int64())], names)

        for batch in batches:
            for text in byte_rows(batch.column("text")):
                terms = terms_of(text)
                n_docs += bool(terms)
                n_terms += len(terms)
                seen.update(set(terms))
                if len(seen) >= FLUSH:
                    yield flush()
                    seen.clear()
                    n_docs = n_terms = 0
        yield flush()

    return docs.select("text").mapInArrow(run, "term string, df long, n long")


class Index:
    """A block of items: for each term its weight and the places of the items that hold it."""

    def __init__(self, rows: list, n_docs: int):
        items = sorted({r["place"] for r in rows})
        self.items = np.array(items, dtype=np.int64)
        self.whole = np.zeros(len(items), dtype=bool)
        local = {p: i for i, p in enumerate(items)}
        held: dict[bytes, list[int]] = {}
        weight: dict[bytes, int] = {}
        for r in rows:
            term = r["term"].encode()
            held.setdefault(term, []).append(local[r["place"]])
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
            self.whole[local[r["place"]]] = r["whole"]
        self.number = {t: i for i, t in enumerate(held)}
        self.weight = np.array([weight[t] for t in held], dtype=np.int64)
        self.start = np.cumsum([0, *(len(v) for v in held.values())])
        self.holders = np.array([i for v in held.values() for i in v], dtype=np.int64)


def radix_order(key: np.ndarray) -> np.ndarray:
    """The order of 32-bit keys: two stable passes over 16-bit digits, which numpy sorts by radix."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]


def accumulated(index: Index, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, document and score of every pair with a term in common; documents count from 0 and are under 65,536."""
    times = index.start[terms + 1] - index.start[terms]
    posting = np.repeat(np.arange(len(terms)), times)
    offset = np.arange(len(posting)) - np.repeat(np.cumsum(times) - times, times)
    key = (index.holders[index.start[terms[posting]] + offset] << 16 | docs[posting]).astype(np.uint32)
    order = radix_order(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(impacts[posting][order], first) if len(key) else np.zeros(0, dtype=np.int64)
    return (key[first] >> 16).astype(np.int64), (key[first] & 0xFFFF).astype(np.int64), sums


class Heaps:
    """The best documents of each item so far: (score, id is there, -id), the worst of them on top."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, dtype=np.int64)  # what a score must reach

    def push(self, items: np.ndarray, scores: np.ndarray, ids: list) -> None:
        for item, score, doc in zip(items.tolist(), scores.tolist(), ids):
            heap, entry = self.held[item], (score, doc is not None, -doc if doc is not None else 0)
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.best:
                self.least[item] = heap[0][0]


def searcher(index: Index, n_docs: int, n_terms: int, best: int, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's documents: each whole item's best, and every partial score of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, holders = ["place", "doc_id", "doc_row", "score"], index.number, np.diff(index.start).tolist()
        heaps = Heaps(len(index.items), best)
        ids: list = []
        rows: list = []
        terms: list[int] = []
        docs: list[int] = []
        tfs: list[int] = []
        ms: list[int] = []
        pairs = 0

        def rank() -> pa.RecordBatch | None:
            nonlocal pairs
            tid, tf = np.array(terms, dtype=np.int64), np.array(tfs, dtype=np.int64)
            at = np.array(docs, dtype=np.int64)
            impacts = index.weight[tid] * ((SCALE * tf) // (1000 * tf + 8 * np.array(ms, dtype=np.int64)[at])) if len(tid) else tid
            item, doc, score = accumulated(index, tid, at, impacts)
            part = (score > 0) & ~index.whole[item]
            good = (score > 0) & index.whole[item] & (score >= heaps.least[item])
            # Highest first, so that a heap fills with what stays and most others fail at its top.
            order = np.flatnonzero(good)[np.argsort(-score[good], kind="stable")]
            for some in np.array_split(order, max(1, len(order) // 4096)):
                some = some[score[some] >= heaps.least[item[some]]]
                heaps.push(item[some], score[some], [ids[d] for d in doc[some].tolist()])
            out = None
            if part.any():
                d = doc[part].tolist()
                columns = [pa.array(index.items[item[part]]), pa.array([ids[i] for i in d], pa.int64()), pa.array([rows[i] for i in d], pa.int64()), pa.array(score[part])]
                out = pa.RecordBatch.from_arrays(columns, names)
            for held in (ids, rows, terms, docs, tfs, ms):
                held.clear()
            pairs = 0
            return out

        for batch in batches:
            for text, doc, row in zip(byte_rows(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("doc_row").to_pylist()):
                words = terms_of(text)
                found = [(number[t], tf) for t, tf in Counter(words).items() if t in number]
                if not found:
                    continue
                terms += [t for t, _ in found]
                tfs += [tf for _, tf in found]
                docs += [len(ids)] * len(found)
                pairs += sum(holders[t] for t, _ in found)
                ms.append(10 + 90 * len(words) * n_docs // n_terms)
                ids.append(doc)
                rows.append(row)
                if pairs >= at_once or len(terms) >= at_once or len(ids) == HALF:
                    out = rank()
                    if out is not None:
                        yield out
        out = rank()
        if out is not None:
            yield out
        kept = [(int(index.items[i]), -e[2] if e[1] else None, None, e[0]) for i, heap in enumerate(heaps.held) for e in heap]
        columns = [pa.array([k[j] for k in kept], pa.int64()) for j in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def blocked(pairs: DataFrame, block: int) -> DataFrame:
    """``pairs`` (place, term, df) with block and whole. Items fill blocks in the order of their places, each
    counted as 8 pairs or more, so a block holds at most 2 x ``block`` pairs and block / 8 items. The terms of
    an item with more than ``block`` pairs are dealt over blocks of its own."""
    sizes = written(pairs.groupBy("place").agg(F.count("*").alias("n")), "ranking-sizes")
    small = sizes.where(F.col("n") <= block).select("place", F.greatest("n", F.lit(8)).alias("cost"), F.floor(F.col("place") / 4096).alias("bucket"))
    inside = Window.partitionBy("bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for 4,096 items
    starts = small.groupBy("bucket").agg(F.sum("cost").alias("sum")).select("bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    before = F.col("start") + F.coalesce(F.sum("cost").over(inside), F.lit(0))
    small = small.join(starts, "bucket").select("place", F.floor(before / block).alias("block"))
    large = sizes.where(F.col("n") > block).select("place", F.floor(2 * F.col("n") / block + 1).alias("parts"))
    dealt = F.pmod(F.xxhash64("term"), "parts")
    return (
        pairs.join(small, "place")
        .select("place", "term", "df", F.col("block").cast("string").alias("block"), F.lit(True).alias("whole"))
        .unionByName(pairs.join(large, "place").select("place", "term", "df", F.concat_ws("/", "place", dealt).alias("block"), F.lit(False).alias("whole")))
    )


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block: int = BLOCK, at_once: int = RUN) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``best`` documents."""
    if not 8 <= block <= 8 * HALF:
        raise ValueError("a block holds 8 to 524,288 pairs")
    spark = docs.sparkSession
    wanted = written(item_terms(items), "ranking-items")
    counted = written(term_counts(docs), "ranking-counts")
    n_docs, n_terms = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = counted.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    places = written(numbered(wanted.select("item_id").distinct(), [], ["item_id"], "ranking-numbers").withColumnRenamed("index", "place"), "ranking-places")
    a, b = wanted.alias("a"), places.alias("b")
    pairs = a.join(b, F.col("a.item_id").eqNullSafe(F.col("b.item_id"))).select("place", "term").join(known, "term")
    dealt = written(blocked(written(pairs, "ranking-pairs"), block), "ranking-blocks")
    names = [(r["block"], r["whole"]) for r in dealt.select("block", "whole").distinct().collect()]
    rows = docs.select("doc_id", "text").withColumn("doc_row", F.monotonically_increasing_id())
    if not all(whole for _, whole in names):
        rows = written(rows, "ranking-rows")  # sums that meet across blocks need one number for a row
    found = spark.createDataFrame([], "place long, doc_id long, doc_row long, score long")
    for name, _ in sorted(names):
        index = Index(dealt.where(F.col("block") == name).collect(), n_docs)
        found = found.unionByName(written(rows.mapInArrow(searcher(index, n_docs, n_terms, best, at_once), found.schema), "ranking-found"))
    parts = found.where("doc_row is not null")
    if not all(whole for _, whole in names):
        added = parts.repartitionByRange("place", "doc_row").groupBy("place", "doc_row").agg(F.first("doc_id").alias("doc_id"), F.sum("score").alias("score"))
        found = found.where("doc_row is null").unionByName(added)
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(places, "place").select("item_id", "rank", "doc_id", "score")
