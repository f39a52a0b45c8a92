"""Exact removal of repeated byte strings with run-length BWT indexes (r-index; Gagie et al., 2018).

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier (smaller doc_id, or
earlier in the document). The work is cut so that no index holds the corpus:

1. Each window of 100 bytes is assigned to its anchor, the least hash among its 32-byte grams. Equal
   windows have equal anchors, so windows that share no anchor never need comparing. The windows of
   one anchor occurrence are a segment of text. Equal segments of a slice are joined in the task;
   the rest travel as packed columns to the shard of their anchor.
2. A shard drops anchors that occur once, marks all but the first of equal segments (64-bit anchor
   and 64-bit content hash agree), and keeps the distinct segments of each anchor.
3. Distinct segments are indexed in blocks of whole anchors: a Burrows-Wheeler transform in run-length
   form, with suffix position and longest common prefix sampled at run ends. All segments of the
   block are then streamed through it from right to left, one LF step per byte: inside a run the
   match length grows by one, at a run end it is the sample's. Rows whose match statistics stay at
   100 or more are occurrences of one window; all but the first are marked.
4. Marks meet the texts once more by document; the remaining bytes are hashed.

An anchor with more than ``HOT_SEGMENTS`` distinct segments (a very common line whose surroundings
differ) is not indexed in one block: its windows become rows keyed by a 128-bit digest, whose first
occurrence is a minimum. This is exact, too, and spreads one anchor over all tasks.

Null and empty texts are empty. If doc_ids repeat, rows of one id are ordered by the hash of their
text, and rows that also have the same text are numbered: the first keeps its bytes, the others are
repeats of it. Null ids are one id, which orders last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, id_or_last, mix64, null_if_last, sliding_argmin, written

WINDOW = 100
GRAM = 32
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
HOT_SEGMENTS = 20_000
ODD = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on."""
    n = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)
    out = np.full(n, ODD, dtype=np.uint64)
    for at in range(0, GRAM, 8):
        out = mix64(out ^ np.ndarray((n,), dtype="<u8", buffer=raw, offset=at, strides=(1,)))
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up, down = np.full(n, ODD, dtype=np.uint64), np.full(n, pow(ODD, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def segments(data: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: each segment's anchor hash, content hash, first window and number of windows."""
    none = np.zeros(0, dtype=np.uint64)
    if len(data) < window:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    grams = gram_hashes(data)
    anchor = sliding_argmin(grams, window - GRAM + 1)
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, "right")
    whole = start + window <= ends[text]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(whole & (new | np.r_[True, ~whole[:-1]]))
    stop = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True]) + 1
    up, down = powers(len(grams) + 1)
    total = np.r_[np.uint64(0), np.cumsum(grams * up[:-1], dtype=np.uint64)]
    last = stop - 1 + window - GRAM + 1
    content = mix64((total[last] - total[at]) * down[at] ^ (stop - at).astype(np.uint64))
    return grams[anchor[at]], content, at, stop - at


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Cut a batch into lists of about ``SLICE_BYTES``: (row numbers, texts)."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) >= WINDOW:
            held.append(i)
            size += len(text)
            if size >= SLICE_BYTES:
                yield np.array(held), [texts[j] for j in held]
                held, size = [], 0
    if held:
        yield np.array(held), [texts[j] for j in held]


def parts_of(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in overlapping parts that hold every window once."""
    size = 1 << 22
    for at in range(0, max(1, len(text) - WINDOW + 1), size):
        yield at, text[at : at + size + WINDOW - 1]


COLUMNS = (("anchor", "<u8"), ("content", "<u8"), ("id", "<i8"), ("sub", "<i8"), ("start", "<i4"), ("n", "u1"), ("first", "u1"))


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns one after another, compressed; ids as numbers into the ids present."""
    ids, number = np.unique(np.stack([columns["id"], columns["sub"]]), axis=1, return_inverse=True)
    parts = [np.array([len(number), ids.shape[1]], dtype="<i4").tobytes(), ids.astype("<i8").tobytes(), number.astype("<i4").tobytes()]
    parts += [columns[name].astype(kind).tobytes() for name, kind in COLUMNS if name not in ("id", "sub")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(raw, "<i4", 2)
    ids = np.frombuffer(raw, "<i8", 2 * m, 8).reshape(2, m)
    at = 8 + 16 * m
    number = np.frombuffer(raw, "<i4", n, at)
    at += 4 * n
    out = {"id": ids[0][number], "sub": ids[1][number]}
    for name, kind in COLUMNS:
        if name not in out:
            out[name] = np.frombuffer(raw, kind, n, at)
            at += n * np.dtype(kind).itemsize
    return out


def earliest(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, content and place; and which of that order are the first of their segment."""
    order = np.lexsort((c["start"], c["sub"], c["id"], c["content"], c["anchor"]))
    a, g = c["anchor"][order], c["content"][order]
    return order, np.r_[True, (a[1:] != a[:-1]) | (g[1:] != g[:-1])] if len(order) else np.zeros(0, bool)


def packed_segments(named: DataFrame, buckets: int) -> DataFrame:
    """From (id, sub, text): packed segments by bucket of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy()
            for rows, texts in slices(byte_rows(batch.column("text"))):
                pieces = [(r, at, part) for r, t in zip(rows, texts, strict=True) for at, part in parts_of(t)]
                group, size, groups = [], 0, []
                for piece in pieces:
                    if group and size + len(piece[2]) > 1 << 22:
                        groups.append(group)
                        group, size = [], 0
                    group.append(piece)
                    size += len(piece[2])
                for group in [*groups, group]:
                    data = np.frombuffer(b"".join(p[2] for p in group), dtype=np.uint8)
                    length = np.array([len(p[2]) for p in group])
                    ends = np.cumsum(length)
                    anchor, content, at, n = segments(data, ends)
                    if not len(at):
                        continue
                    which = np.searchsorted(ends, at, "right")
                    row = np.array([p[0] for p in group])[which]
                    offset = np.array([p[1] for p in group]) - (ends - length)
                    c = {"anchor": anchor, "content": content, "id": ids[row], "sub": subs[row], "start": at + offset[which], "n": n}
                    order, first = earliest(c)
                    c = {k: v[order] for k, v in c.items()} | {"first": first}
                    bucket = (c["anchor"] % np.uint64(buckets)).astype(np.int64)
                    turn = np.argsort(bucket, kind="stable")
                    cut = np.flatnonzero(np.r_[True, np.diff(bucket[turn]) > 0])
                    packs = [pack({k: v[part] for k, v in c.items()}) for part in np.split(turn, cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[turn[cut]].astype(np.int32)), pa.array(packs, pa.binary())], ["bucket", "packed"])

    return named.mapInArrow(run, "bucket int, packed binary")


FOUND = "kind int, anchor long, id long, sub long, start int, n int"
MARK, INDEX, HOT = 0, 1, 2


def rows_of(kind: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    columns = [kind.astype(np.int32), c["anchor"].view(np.int64), c["id"], c["sub"], c["start"].astype(np.int32), c["n"].astype(np.int32)]
    for at in range(0, len(kind), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in columns], ["kind", "anchor", "id", "sub", "start", "n"])


def shared_segments(packed: DataFrame, hot_segments: int) -> DataFrame:
    """Marks for repeated segments, and the distinct segments of anchors that have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(p) for batch in batches for p in byte_rows(batch.column("packed"))]
        if not held:
            return
        c = {name: np.concatenate([h[name] for h in held]) for name, _ in COLUMNS}
        held.clear()
        again = c["first"] == 0
        yield from rows_of(np.full(int(again.sum()), MARK), {k: v[again] for k, v in c.items()})
        c = {k: v[~again] for k, v in c.items()}
        order = np.argsort(c["anchor"])
        sorted_anchor = c["anchor"][order]
        same = sorted_anchor[1:] == sorted_anchor[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        c = {k: v[order] for k, v in c.items()}
        order, first = earliest(c)
        c = {k: v[order] for k, v in c.items()}
        yield from rows_of(np.full(int((~first).sum()), MARK), {k: v[~first] for k, v in c.items()})
        c = {k: v[first] for k, v in c.items()}
        _, number, count = np.unique(c["anchor"], return_inverse=True, return_counts=True)
        several = count[number] > 1
        kind = np.where(count[number] > hot_segments, HOT, INDEX)[several]
        yield from rows_of(kind, {k: v[several] for k, v in c.items()})

    return packed.mapInArrow(run, FOUND)


class RunIndex:
    """A run-length Burrows-Wheeler transform of several strings, sampled at run ends."""

    def __init__(self, strings: list[bytes], depth: int = WINDOW):
        self.depth = depth
        size = np.array([len(s) for s in strings], dtype=np.int64)
        m = len(strings)
        self.first = np.cumsum(size + 1) - (size + 1)  # each string is followed by its end mark
        self.size = size
        n = int((size + 1).sum())
        text = np.zeros(n, dtype=np.uint16)
        ends = self.first + size
        body = np.ones(n, dtype=bool)
        body[ends] = False
        text[body] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint16) + 1
        self.text = text
        row = suffix_rows(text, ends)  # end marks come first, in the order of the strings
        place = np.empty(n, dtype=np.int64)
        place[row] = np.arange(n)
        before = text[place - 1]  # at a string's start: an end mark, where streaming stops
        head = np.r_[True, before[1:] != before[:-1]]
        self.run_start = np.flatnonzero(head)
        self.run_char = before[self.run_start]
        count = np.diff(np.r_[self.run_start, n])
        # Where the run's rows go in one LF step: all smaller characters, then earlier runs of its own.
        order = np.argsort(self.run_char, kind="stable")
        self.run_to = np.empty(len(order), dtype=np.int64)
        self.run_to[order] = np.cumsum(count[order]) - count[order]
        # Samples: position at each run's head after the LF step, and its match with the row above.
        at = place[self.run_start] - 1
        to = self.run_to
        above = place[np.maximum(to - 1, 0)]
        self.sample = np.where((to > 0) & (self.run_char > 0), self.common(at, above), 0)
        self.rows, self.strings = n, m

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at a and b, up to ``depth``."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        n = len(self.text)
        for j in range(self.depth):
            x, y = self.text[np.minimum(a[live] + j, n - 1)], self.text[np.minimum(b[live] + j, n - 1)]
            live = live[(x == y) & (x > 0)]
            if not live.size:
                break
            out[live] = j + 1
        return out

    def stream(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Match statistics of all strings from their ends: (bytes read, strings still read, row, match with the row above)."""
        by_size = np.argsort(-self.size, kind="stable")
        row = by_size.astype(np.int64).copy()  # the rows of the end marks
        match = np.zeros(len(row), dtype=np.int64)
        sizes = self.size[by_size]
        for read in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -read, "right"))
            row, match = row[:k], match[:k]
            run = np.searchsorted(self.run_start, row, "right") - 1
            inside = row - self.run_start[run]
            match = np.where(inside > 0, np.minimum(match + 1, self.depth), self.sample[run])
            row = self.run_to[run] + inside
            yield read, by_size[:k], row, match


def suffix_rows(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rank of every suffix, by prefix doubling from 4 characters on; end marks order by their string."""
    n = len(text)
    padded = np.r_[text.astype(np.uint64), np.zeros(4, np.uint64)]
    key = padded[:n]
    for j in range(1, 4):
        key = (key << np.uint64(9)) | padded[j : n + j]
    # Characters after an end mark must not count: keep only what stands before the first one.
    zero = np.zeros(n, dtype=bool)
    for j in range(3):
        zero |= padded[j : n + j] == 0
        key = np.where(zero, key & ~np.uint64((1 << (9 * (3 - j))) - 1), key)
    # Suffixes cut by an end mark are told apart by their string.
    close = np.searchsorted(ends, np.arange(n))
    cut = ends[close] - np.arange(n) < 4
    key = (key << np.uint64(28)) | np.where(cut, close, 0).astype(np.uint64)
    _, rank = np.unique(key, return_inverse=True)
    width = 4
    while int(rank.max(initial=0)) < n - 1:
        second = np.zeros(n, dtype=np.uint64)
        second[: n - width] = rank[width:].astype(np.uint64) + np.uint64(1)
        second[ends[close] - np.arange(n) < width] = 0
        _, rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | second, return_inverse=True)
        width *= 2
    return rank.astype(np.int64)


def repeated_windows(texts: list[bytes], ids: np.ndarray, subs: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, windows) for runs of windows that occur earlier in the block."""
    index = RunIndex(texts, window)
    segs, offsets, rows, same = [], [], [], []
    for read, strings, row, match in index.stream():
        if read >= window:
            segs.append(strings)
            offsets.append(index.size[strings] - read)
            rows.append(row)
            same.append(match >= window)
    if not segs:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    seg, offset, row, joined = (np.concatenate(x) for x in (segs, offsets, rows, same))
    order = np.argsort(row)
    seg, offset, group = seg[order], offset[order], np.cumsum(~joined[order])
    order = np.lexsort((starts[seg] + offset, subs[seg], ids[seg], group))
    seg, offset, group = seg[order], offset[order], group[order]
    later = np.r_[False, group[1:] == group[:-1]]
    seg, offset = seg[later], offset[later]
    order = np.lexsort((offset, seg))
    seg, offset = seg[order], offset[order]
    new = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(seg) else np.zeros(0, np.int64)
    return seg[new], offset[new], np.diff(np.r_[new, len(seg)])


def compressed(named: DataFrame) -> DataFrame:
    """(id, sub, z): texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array([press.compress(t) for t in byte_rows(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sub"), z], ["id", "sub", "z"])

    return named.mapInArrow(run, "id long, sub long, z binary")


def segment_texts(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the ``wanted`` segments: (kind, anchor, id, sub, start, n, bytes)."""
    lists = wanted.groupBy("id", "sub").agg(F.collect_list(F.struct("kind", "anchor", "start", "n")).alias("wanted"))
    joined = compressed(named).join(lists, ["id", "sub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release = zstandard.ZstdDecompressor()
        for batch in batches:
            lists = batch.column("wanted")
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            kind, anchor, start, n = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            texts = [release.decompress(z) for z in byte_rows(batch.column("z"))]
            found = [texts[r][s : s + c + WINDOW - 1] for r, s, c in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
            columns = [pa.array(kind), pa.array(anchor), batch.column("id").take(pa.array(row)), batch.column("sub").take(pa.array(row)), pa.array(start), pa.array(n), pa.array(found, pa.binary())]
            for at in range(0, len(found), 1 << 15):
                yield pa.RecordBatch.from_arrays([x[at : at + (1 << 15)] for x in columns], ["kind", "anchor", "id", "sub", "start", "n", "bytes"])

    return joined.select("id", "sub", "z", "wanted").mapInArrow(run, FOUND + ", bytes binary")


MARKS = "id long, sub long, start int, n int"


def index_marks(texts: DataFrame) -> DataFrame:
    """Marks from the run-length indexes of blocks of whole anchors."""
    sorted_rows = texts.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "id", "sub", "start", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def search() -> Iterator[pa.RecordBatch]:
            ids, subs, starts = (np.array([h[i] for h in held], dtype=np.int64) for i in (1, 2, 3))
            seg, offset, n = repeated_windows([h[4] for h in held], ids, subs, starts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[seg]), pa.array(subs[seg]), pa.array((starts[seg] + offset).astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "sub", "start", "n"])

        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and item[0] != held[-1][0]:
                    yield from search()
                    held.clear()
                    size = 0
                held.append(item)
                size += len(item[4])
        if held:
            yield from search()

    return sorted_rows.mapInArrow(run, MARKS)


def hot_marks(texts: DataFrame) -> DataFrame:
    """Marks for anchors with very many segments: windows as rows, the first of each digest is a minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s, start, n, data in zip(*(batch.column(c).to_pylist() for c in ("id", "sub", "start", "n", "bytes")), strict=True):
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[j : j + WINDOW]) for j in range(n)), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(np.full(n, i)), pa.array(np.full(n, s)), pa.array(np.arange(start, start + n, dtype=np.int32))], ["hi", "lo", "id", "sub", "start"])

    windows = texts.mapInArrow(run, "hi long, lo long, id long, sub long, start int")
    first = windows.groupBy("hi", "lo").agg(F.min(F.struct("id", "sub", "start")).alias("first"))
    later = windows.join(first, ["hi", "lo"]).where(F.struct("id", "sub", "start") != F.col("first"))
    return later.select("id", "sub", "start", F.lit(1).alias("n"))


def removed(size: int, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which bytes of a text the marked windows cover."""
    edges = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + n + WINDOW - 1, size), -1)
    return np.cumsum(edges)[:-1] > 0


def find_marks(named: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """From (id, sub, text): the windows that occur earlier, as runs (id, sub, start, n)."""
    spark = named.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = packed_segments(named, parts * 4).repartition(parts, "bucket")
    found = written(shared_segments(packed, hot_segments), "segments")
    texts = written(segment_texts(named, found.where(F.col("kind") != MARK)), "texts")
    marks = found.where(F.col("kind") == MARK).select("id", "sub", "start", "n")
    indexed = index_marks(texts.where(F.col("kind") == INDEX))
    hot = texts.where(F.col("kind") == HOT)
    if hot.limit(1).count():
        indexed = indexed.unionByName(hot_marks(hot))
    return marks.unionByName(indexed)


def named_documents(docs: DataFrame) -> DataFrame:
    """(id, sub, text): sub tells rows apart that share a doc_id, 0 while ids are unique.

    Else it is the hash of the text (63 bits) plus the number of the row among equal ones, so no two
    rows are one; the table is written, as each reading would sort it anew.
    """
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return docs.select(id_or_last().alias("id"), F.lit(0).cast("long").alias("sub"), "text")
    hashed = docs.select(id_or_last().alias("id"), F.shiftright(F.xxhash64("text"), 1).alias("sub"), "text")
    copy = F.row_number().over(Window.partitionBy("id", "sub").orderBy("text"))
    return written(hashed.withColumn("sub", F.col("sub") + copy - 1), "named")


def repeats_report(docs: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    named = named_documents(docs)
    marks = find_marks(named.where(F.octet_length("text") >= WINDOW), hot_segments)
    lists = marks.groupBy("id", "sub").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    joined = compressed(named).join(lists, ["id", "sub"], "left").select("id", "z", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            lists = batch.column("marks")
            for i, z in enumerate(byte_rows(batch.column("z"))):
                text = release.decompress(z)
                gone, spans, kept = 0, 0, text
                if lists[i].is_valid:
                    start, n = (lists[i].values.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                    mask = removed(len(text), start, n)
                    gone, spans = int(mask.sum()), int((np.diff(np.r_[False, mask].astype(np.int8)) > 0).sum())
                    kept = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
                out.append((len(text), gone, spans, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([o[j] for o in out], pa.int64() if j < 3 else pa.string()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    report = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return report.select(null_if_last(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
