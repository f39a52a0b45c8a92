"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are one narrow pass over the documents, written as a table of floats; texts are read once
and never shuffled. The trees are fitted to a bounded sample of the labelled rows, flattened into
arrays and traversed by all rows of a batch at once.

Fitting. Each statistic is cut at quantiles into at most 64 bins. A tree grows at its best leaf: the sums of
gradients and curvatures of the logistic loss by bin tell the gain of every cut; the larger child's
sums are its parent's less its sibling's. The sample (``sample`` rows, 32,768) is a share of the labelled
ids by hash, so it is the same on every run and its size doesn't grow with the corpus. Equal rows of the
sample are counted, not repeated. Nothing else comes to the driver.

Defined results. Null texts are empty; an empty text has statistics (all 0) and a score like any other.
Labels other than 0 and 1, and null ones, are passed over; a label given twice counts once, contradicting
ones count both. Rows that share an id are scored each by its own text and take that id's label. A row
without id has no label and isn't held out. Without labels every score is 0.5, with labels of one
class their share. Columns besides doc_id and text, or doc_id and quality, are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, written
from .quality import COMMON_FORMS, LOWER, PUNCTUATION, SPACE, UPPER, removed, repeated_words

SAMPLE = 32_768
THRESHOLD = 0.3
DIGITS = bytes(range(0x30, 0x3A))
HIGH = bytes(range(0x80, 0x100))
SYMBOLS = b"#*$%&<>~^=+@\\{}[]_"
FEATURES = (
    "log_words", "word_bytes", "longest_word", "symbols", "bars", "shouts", "commas", "stops", "digits", "capitals", "high_bytes", "spaces",
    "stutter", "repeats", "distinct", "richness", "top_word", "doubled_lines", "line_words", "ended_lines", "common_words", "bare_marks", "marked_ends", "capital_words", "compressed",
)
SCHEMA = "doc_id long, " + ", ".join(f"{name} float" for name in FEATURES)


def statistics(text: bytes) -> list[float]:
    """The statistics of a text, in the order of FEATURES."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    times = np.bincount(codes)
    lengths = np.array([len(w) for w in number], dtype=np.int64)
    share = lambda which: sum(int(times[i]) for w, i in number.items() if which(w)) / n
    lines = [line for line in text.split(b"\n") if line.strip()]
    upper, lower = removed(text, UPPER), removed(text, LOWER)
    return [
        float(np.log1p(n)),
        float((times * lengths).sum() / n),
        float(np.log1p(lengths.max())),
        removed(text, SYMBOLS) / size,
        text.count(b"|") / n,
        (text.count(b"!") + text.count(b"?")) / n,
        text.count(b",") / n,
        text.count(b".") / n,
        removed(text, DIGITS) / size,
        upper / max(1, upper + lower),
        removed(text, HIGH) / size,
        removed(text, SPACE) / size,
        float((codes[1:] == codes[:-1]).sum() / n),
        repeated_words(codes, len(number)) / n,
        len(number) / n,
        len(number) / n**0.75,
        float(times.max() / n),
        (len(lines) - len(set(lines))) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(line.rstrip()[-1:] in b".!?:;\"'" for line in lines) / len(lines),
        sum(int(times[number[f]]) for f in COMMON_FORMS if f in number) / n,
        share(lambda w: not w.translate(None, PUNCTUATION)),
        share(lambda w: w[-1] in PUNCTUATION and w[-2:-1] and w[-2] in PUNCTUATION),
        share(lambda w: len(w) > 1 and w.isupper()),
        len(zlib.compress(text, 1)) / size,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in byte_rows(batch.column("text"))], dtype=np.float32).reshape(-1, len(FEATURES))
            columns = [batch.column("doc_id"), *(pa.array(np.ascontiguousarray(found[:, j])) for j in range(len(FEATURES)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays. A leaf leads to itself; a row goes left where its value is at most the cut."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """The log odds of each row: every row walks all trees at once."""
        out = np.full(len(rows), self.base)
        if not len(self.roots):
            return out
        for start in range(0, len(rows), 4096):
            part = rows[start : start + 4096]
            flat, offset = part.ravel(), (np.arange(len(part)) * part.shape[1])[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(flat[offset + self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out[start : start + 4096] += self.value[node].sum(axis=1)
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(rows), -500, 500)))


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    leaves: int = 12
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0  # added to a leaf's curvature
    least: float = 2.0  # curvature that a leaf must hold


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 cuts between values, by quantiles."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))[: bins - 1]


def best_cut(sums: np.ndarray, settings: Settings) -> tuple[float, int, int]:
    """Gain, feature and bin of the best cut, from the sums of gradient and curvature (2, features, bins)."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :1, -1:]
    right = total - left
    score = lambda s: s[0] ** 2 / (s[1] + settings.ridge)
    gain = score(left) + score(right) - score(total)
    gain[(left[1] < settings.least) | (right[1] < settings.least)] = 0
    at = int(np.argmax(gain))
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def fit(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Trees for weighted rows with labels 0 and 1."""
    total = weights.sum()
    positive = float((labels * weights).sum())
    none = Trees(0.0 if not total else float(np.log((positive + 1e-9) / (total - positive + 1e-9))), *(np.zeros(0, dtype=int) for _ in range(6)), 0)
    if not total or positive in (0.0, total):
        return none
    n_features, bins = rows.shape[1], settings.bins
    cuts = [cut_points(rows[:, j], bins) for j in range(n_features)]
    binned = np.stack([np.searchsorted(cuts[j], rows[:, j], side="left") + j * bins for j in range(n_features)], axis=1)
    odds = np.full(len(rows), none.base)
    feature, cut, left, right, value, roots, deepest = [], [], [], [], [], [], 0

    def node() -> int:
        for held, first in ((feature, 0), (cut, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            held.append(first)
        return len(feature) - 1

    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-odds))
        slopes = np.stack([(p - labels) * weights, np.maximum(p * (1 - p), 1e-6) * weights])

        def sums(members: np.ndarray) -> np.ndarray:
            flat = binned[members].ravel()
            return np.stack([np.bincount(flat, np.repeat(s[members], n_features), n_features * bins).reshape(n_features, bins) for s in slopes])

        members = np.arange(len(rows))
        roots.append(node())
        found = sums(members)
        gain, j, b = best_cut(found, settings)
        grown, leaves = [(-gain, roots[-1], 0, members, found, j, b)], []
        while grown and len(grown) + len(leaves) < settings.leaves:
            gain, at, depth, members, found, j, b = heapq.heappop(grown)
            if -gain <= 1e-6 or b >= len(cuts[j]):
                leaves.append((at, depth, members))
                continue
            goes = binned[members, j] <= j * bins + b
            parts = [members[goes], members[~goes]]
            small = int(len(parts[1]) < len(parts[0]))
            known = sums(parts[small])
            halves = [known, found - known] if small == 0 else [found - known, known]
            feature[at], cut[at] = j, float(cuts[j][b])
            left[at], right[at] = node(), node()
            for child, part, half in zip((left[at], right[at]), parts, halves):
                g, cj, cb = best_cut(half, settings)
                heapq.heappush(grown, (-g, child, depth + 1, part, half, cj, cb))
        for at, depth, members in [*leaves, *((g[1], g[2], g[3]) for g in grown)]:
            value[at] = -settings.rate * float(slopes[0][members].sum() / (slopes[1][members].sum() + settings.ridge))
            odds[members] += value[at]
            deepest = max(deepest, depth)
    arrays = (np.array(a) for a in (roots, feature, cut, left, right, value))
    return Trees(none.base, *arrays, deepest)


def share_by_hash(column: Column, share: float) -> Column:
    """True for about this share of a column's values, chosen by their hash alone."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 40)) < int(share * (1 << 40))


def sampled(counted: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, labels and weights of about ``sample`` labelled rows at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").distinct()
    known = written(known, "boosting-labels")
    chosen = known.where(share_by_hash(F.col("doc_id"), min(1.0, sample / max(1, known.count()))))
    # The chosen labels are bounded by the sample, so they may be sent to all tasks.
    rows = counted.join(F.broadcast(chosen), "doc_id").groupBy(*FEATURES, "quality").agg(F.count("*").alias("weight"))
    rows = written(rows, "boosting-sample")
    kept = rows.where(share_by_hash(F.struct(*FEATURES), min(1.0, sample / max(1, rows.count()))))
    table = kept.orderBy(*FEATURES, "quality").toArrow()
    stacked = np.stack([np.asarray(table.column(c), dtype=np.float32) for c in FEATURES], axis=1)
    return stacked, np.asarray(table.column("quality"), dtype=float), np.asarray(table.column("weight"), dtype=float)


def scored(counted: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.probability(rows))], ["doc_id", "score"])

    return counted.mapInArrow(run, "doc_id long, score double")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: trees fitted to the labels of rows that aren't held out score all rows."""
    counted = written(with_statistics(docs), "boosting-statistics")
    trees = fit(*sampled(counted, labels.where(~held_out()), sample), settings)
    found = scored(counted, trees)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
