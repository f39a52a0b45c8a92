"""Substring dedup by content-defined chunking (gear hash, as in FastCDC, Xia et al., 2016).

A rolling gear hash over the last ``REACH`` bytes cuts each text wherever it is small, so borders
depend on the bytes next to them alone: an insertion moves the borders near it and no others. There
is no least or greatest chunk size, since such limits carry a shift on to later chunks. Chunks are
deduplicated by a 128-bit digest: the first occurrence (least doc_id, then least start) stays, every
later one is removed, if the run of such chunks has ``LEAST_RUN`` bytes or more. With a cut every
``MEAN_BYTES`` bytes on average, a repeated passage of 50 words holds several whole chunks. A text
shorter than such a run is one more chunk as a whole, so exact copies go whatever their length.

A chunk repeated inside its own document is found in the task that cuts it. For the rest, the least
document of each digest is a minimum, combined before the shuffle; only digests of two or more
documents are joined back, and adaptive skew joins split a digest that very many documents hold.
Texts are not shuffled for the statistics.

Null and empty texts have no chunks. Null ids order last. If ids repeat, documents are ordered by the
hash of their text, and equal rows by their place: the first of them stays, the others are copies of
it. An empty table gives an empty one; columns of any name are kept as they are. A text is held by one
task, with 41 bytes for each chunk of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, free_names, id_or_last, mix64, written

MEAN_BYTES = 32
LEAST_RUN = 96
REACH = 16  # bytes that the gear hash sees
WHOLE = -1  # the start of a chunk that is a short text as a whole; its digest has a seed of its own
BLOCK = 1 << 22

GEAR = mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)  # one random word for each byte


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = (h << 1) + GEAR[byte], over ``REACH`` bytes by doubling."""
    out = GEAR[data]
    step = 1
    while step < REACH:
        longer = out.copy()
        longer[step:] += out[:-step] << np.uint32(step)
        out = longer
        step *= 2
    return out


def chunk_ends(text: bytes, mean: int = MEAN_BYTES) -> np.ndarray:
    """Ends of the chunks of ``text``; the last is its length."""
    data = np.frombuffer(text, dtype=np.uint8)
    most = np.uint32((1 << 32) // mean)
    found = []
    for begin in range(0, len(data), BLOCK):
        low = max(0, begin - REACH + 1)
        value = gear(data[low : begin + BLOCK])[begin - low :]
        found.append(np.flatnonzero(value < most) + begin + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return ends


KEY = ("id", "sub", "copy")  # tells rows apart and orders them


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with id, sub and copy; sub and copy are 0 while ids are unique (they would decide nothing)."""
    own = docs.drop(*KEY).withColumn("id", id_or_last())
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return own.withColumns({"sub": F.lit(0).cast("long"), "copy": F.lit(0).cast("long")})
    # Written, so that the numbers of the rows stay the same each time the table is read.
    return written(own.withColumns({"sub": F.shiftright(F.xxhash64("text"), 1), "copy": F.monotonically_increasing_id()}), "keyed")


def chunk_rows(named: DataFrame, mean: int = MEAN_BYTES, least: int = LEAST_RUN) -> DataFrame:
    """From (KEY, text): KEY, digest (hi, lo), start and end of each chunk, and whether its document had it before.

    A text of under ``least`` bytes is also a chunk as a whole, with start ``WHOLE``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, starts, stops, again = [], [], [], [], []
            for text in byte_rows(batch.column("text")):
                ends = chunk_ends(text, mean).tolist()
                begins = [0, *ends[:-1]] if ends else []
                own = [xxhash.xxh3_128_digest(text[b:e]) for b, e in zip(begins, ends, strict=True)]
                seen: set[bytes] = set()
                again += [d in seen or bool(seen.add(d)) for d in own]
                if 0 < len(text) < least:
                    own.append(xxhash.xxh3_128_digest(text, seed=1))
                    begins, ends = [*begins, WHOLE], [*ends, len(text)]
                    again.append(False)
                digests += own
                starts += begins
                stops += ends
                sizes.append(len(ends))
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            start = np.array(starts, dtype=np.int32)
            columns = [pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in KEY] + [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            columns += [pa.array(start), pa.array(np.array(stops, dtype=np.int32)), pa.array(again, pa.bool_())]
            for at in range(0, len(start), 1 << 16):
                yield pa.RecordBatch.from_arrays([c[at : at + (1 << 16)] for c in columns], [*KEY, "hi", "lo", "start", "end", "again"])

    return named.mapInArrow(run, "id long, sub long, copy long, hi long, lo long, start int, end int, again boolean")


def repeated_chunks(named: DataFrame, mean: int = MEAN_BYTES, least: int = LEAST_RUN) -> DataFrame:
    """From (KEY, text): KEY, start and end of every chunk that occurs earlier."""
    chunks = chunk_rows(named, mean, least)
    first = chunks.where("not again").groupBy("hi", "lo").agg(F.min(F.struct(*KEY)).alias("first"), F.count("*").alias("n"))
    shared = first.where("n > 1").drop("n")
    found = chunks.join(shared, ["hi", "lo"], "left").where(F.col("again") | (F.struct(*KEY) != F.col("first")))
    return found.select(*KEY, "start", "end")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def removed_spans(named: DataFrame, mean: int = MEAN_BYTES, least: int = LEAST_RUN) -> DataFrame:
    """From (KEY, text): KEY and the spans of bytes to remove, in order and merged; only documents that have some."""
    grouped = repeated_chunks(named, mean, least).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("chunks"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("chunks")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            begin, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.lexsort((begin, row))
            row, begin, end = row[order], begin[order], end[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (begin[1:] != end[:-1])] if len(row) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            stop = end[np.r_[at[1:] - 1, len(row) - 1]] if len(at) else end
            # A whole text sorts before its chunks, whose runs are too short.
            long = (stop - begin[at] >= least) | (begin[at] == WHOLE)
            at, stop = at[long], stop[long]
            spans = pa.StructArray.from_arrays([pa.array(np.maximum(begin[at], 0)), pa.array(stop)], ["start", "end"])
            offsets = np.searchsorted(row[at], np.arange(len(lists) + 1)).astype(np.int32)
            merged = pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.ListArray.from_arrays(pa.array(offsets), spans)], [*KEY, "spans"])
            yield merged.filter(pa.array(np.diff(offsets) > 0))

    return grouped.mapInArrow(merge, "id long, sub long, copy long, spans array<struct<start: int, end: int>>")


def chunk_report(docs: DataFrame, mean: int = MEAN_BYTES, least: int = LEAST_RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed (bytes in runs of chunks that occur earlier), n_spans (those runs)."""
    named = keyed(docs.select("doc_id", "text"))
    spans = removed_spans(named.select(*KEY, "text"), mean, least)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    sizes = named.select("doc_id", *KEY, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sizes.join(spans, list(KEY), "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
    )


def without_repeats(docs: DataFrame, mean: int = MEAN_BYTES, least: int = LEAST_RUN) -> DataFrame:
    """``docs`` with the repeated runs cut out of text (a cut inside a character drops its rest)."""
    columns = docs.columns
    aside = dict(zip(KEY, free_names(docs, *(f"_{c}" for c in KEY)), strict=True))
    (gone,) = free_names(docs, "_spans")
    named = keyed(docs.select(*(F.col(c).alias(aside.get(c.lower(), c)) for c in columns)))
    spans = removed_spans(named.select(*KEY, "text"), mean, least).withColumnRenamed("spans", gone)

    @F.pandas_udf("string")
    def cut(text, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, s in zip(text, spans, strict=True):
            if t is not None and s is not None:
                data, at, parts = t.encode(), 0, []
                for span in s:
                    parts.append(data[at : span["start"]])
                    at = span["end"]
                t = b"".join([*parts, data[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    out = named.join(spans, list(KEY), "left").withColumn("text", cut("text", gone))
    return out.select(*(F.col(aside.get(c.lower(), c)).alias(c) for c in columns))
