"""Language-model scores from subword lattices (the unigram model of Kudo, 2018).

A word can be cut into pieces of an existing vocabulary in many ways. The unigram model gives each
piece a probability, and a text the sum over all its segmentations, which the forward recursion in
log space computes without listing them. Pieces don't cross white space, so a document's marginal
log-probability is the sum over its words, and every distinct word is computed once.

The vocabulary is read from a SentencePiece model file (path given); it is not trained here. The
files at hand rank their pieces but hold no log-probabilities, so the scores of the pieces are learnt
from the training words: they start as Zipf's law of the rank and are fitted by ``ROUNDS`` rounds of
expectation-maximisation (each the expected uses of the pieces over all segmentations). ``score`` is
the marginal of that lattice and nothing else. Characters outside the vocabulary share one unknown
piece, spread evenly over Unicode; one end piece closes each document, so probabilities of documents
add up to at most one.

A word of more than ``LONG_CHARS`` characters (an encoded blob) is scored exactly by the same recursion
in a sliding window of as many nodes as the longest piece has characters, in linear time and constant
memory; the fit reads such words in parts of that length.

Word counts are a distributed table, pre-aggregated in each task. Words are scored in two ways with
equal results: the most frequent (at most ``HEAD_WORDS`` of at most ``HEAD_BYTES`` bytes, a proven
bound) are broadcast, all others are joined, so neither the vocabulary of the corpus nor a hot word
passes through one task. The driver sees piece sums (as many as pieces) and a histogram.

Null and empty texts consist of the end token alone. A null doc_id counts as the empty text when
rows are split. Repeated rows are scored separately.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 3
HEAD_WORDS = 1 << 18
HEAD_BYTES = 64
FLUSH_WORDS = 1 << 19
BATCH_CHARS = 1 << 18
CODE_POINTS = 1_112_064
TABLE_BITS = 18
LONG_CHARS = 256
SPACE_MARK = "▁"


def step(value: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Extend the hash of a string by one character."""
    out = (value ^ char.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


class Pieces:
    """A vocabulary with its scores, and all prefixes of its pieces in a hash table."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown, self.end = len(pieces), len(pieces) + 1
        prefixes: dict[str, int] = {}
        for number, piece in enumerate(pieces):
            for size in range(1, len(piece)):
                prefixes.setdefault(piece[:size], -1)
            prefixes[piece] = number
        names = list(prefixes)
        keys = np.full(len(names), 0, dtype=np.uint64)
        for size in range(self.longest):
            longer = [i for i, n in enumerate(names) if len(n) > size]
            keys[longer] = step(keys[longer], np.array([ord(names[i][size]) for i in longer], dtype=np.uint64))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(prefixes.values()), dtype=np.int32)[order]
        self.start = np.searchsorted(self.keys >> np.uint64(64 - TABLE_BITS), np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)
        rank = np.arange(len(pieces), dtype=np.float64)
        self.score = np.log(np.r_[1 / (rank + 10), 1e-6, 1e-3])
        self.score -= np.log(np.exp(self.score).sum())

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in sorted(usable, key=lambda i: (-model.get_score(i), i))]
        return cls([n for n in names if SPACE_MARK not in n[1:]])

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """A piece's number, -1 for a mere prefix, -2 for neither."""
        bucket = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        at, stop = self.start[bucket].copy(), self.start[bucket + 1]
        out = np.full(len(keys), -2, dtype=np.int32)
        live = np.flatnonzero(at < stop)
        while live.size:
            same = self.keys[at[live]] == keys[live]
            out[live[same]] = self.values[at[live[same]]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out

    def lattice(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids[l, i]: the piece of length l + 1 at character i, -1 if none; and their scores.

        ``left`` tells how many characters of the word remain from each on.
        """
        ids = np.full((self.longest, len(chars)), -1, dtype=np.int32)
        live, keys = np.arange(len(chars)), np.zeros(len(chars), dtype=np.uint64)
        for size in range(self.longest):
            keys = step(keys, chars[live + size])
            found = self.lookup(keys)
            ids[size, live] = np.maximum(found, -1)
            on = (found > -2) & (left[live] > size + 1)
            live, keys = live[on], keys[on]
            if not live.size:
                break
        scores = np.where(ids >= 0, self.score[ids], -np.inf)
        strange = ids[0] < 0
        ids[0, strange] = self.unknown
        scores[0, strange] = self.score[self.unknown] - np.log(CODE_POINTS)
        return ids, scores

    def batches(self, words: list[bytes], whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Words by falling length: their numbers, lengths (with the space mark), first characters, and all characters.

        If not ``whole``, long words come in parts of ``LONG_CHARS``.
        """
        texts = [SPACE_MARK + w.decode("utf-8", "replace") for w in words]
        number = np.arange(len(texts))
        if not whole and any(len(t) > LONG_CHARS for t in texts):
            parts = [(i, t[at : at + LONG_CHARS]) for i, t in enumerate(texts) for at in range(0, len(t), LONG_CHARS)]
            number, texts = np.array([i for i, _ in parts]), [t for _, t in parts]
        size = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        cut = np.cumsum(size[order]) // BATCH_CHARS
        for part in np.split(order, np.flatnonzero(np.diff(cut)) + 1) if len(order) else []:
            n = size[part]
            chars = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "replace"), dtype="<u4")
            yield number[part], n, np.cumsum(n) - n, chars

    def forward(self, n: np.ndarray, first: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """alpha of all nodes; the node before character i of word k is i + k."""
        alpha = np.full(int(n.sum()) + len(n), -np.inf)
        node = first + np.arange(len(n))
        alpha[node] = 0.0
        for j in range(1, int(n[0]) + 1 if len(n) else 0):
            k = int(np.searchsorted(-n, -j, "right"))
            ways = np.stack([alpha[node[:k] + j - s] + scores[s - 1, first[:k] + j - s] for s in range(1, min(j, self.longest) + 1)])
            top = ways.max(axis=0)
            alpha[node[:k] + j] = top + np.log(np.exp(ways - top).sum(axis=0))
        return alpha

    def backward(self, n: np.ndarray, first: np.ndarray, scores: np.ndarray) -> np.ndarray:
        beta = np.full(int(n.sum()) + len(n), -np.inf)
        node = first + np.arange(len(n))
        beta[node + n] = 0.0
        for j in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
            k = int(np.searchsorted(-n, -(j + 1), "right"))
            room = n[:k] - j
            ways = []
            for s in range(1, min(int(room.max()), self.longest) + 1):
                to = np.minimum(node[:k] + j + s, node[:k] + n[:k])
                ways.append(np.where(room >= s, beta[to] + scores[s - 1, first[:k] + j], -np.inf))
            ways = np.stack(ways)
            top = ways.max(axis=0)
            beta[node[:k] + j] = top + np.log(np.exp(ways - top).sum(axis=0))
        return beta

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """The marginal natural log-probability of each word."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) < LONG_CHARS]
        for i, w in enumerate(words):
            if len(w) >= LONG_CHARS:
                out[i] = self.long_word(w)
        for part, n, first, chars in self.batches([words[i] for i in short]):
            _, scores = self.lattice(chars, remaining(n, first))
            out[np.array(short)[part]] = self.forward(n, first, scores)[first + np.arange(len(n)) + n]
        return out

    def long_word(self, word: bytes, block: int = 1 << 14) -> float:
        """The same for one word of any length: probabilities of the next nodes in a ring, scaled as they fall."""
        chars = np.frombuffer((SPACE_MARK + word.decode("utf-8", "replace")).encode("utf-32-le", "replace"), dtype="<u4")
        size = self.longest + 1
        ring, scale = [0.0] * size, 0.0
        ring[0] = 1.0
        for begin in range(0, len(chars), block):
            part = chars[begin : begin + block + self.longest - 1]
            mine = min(block, len(chars) - begin)
            _, scores = self.lattice(part, len(part) - np.arange(len(part)))
            at, length = np.nonzero(np.isfinite(scores[:, :mine].T))
            factor = np.exp(scores[length, at]).tolist()
            stops = np.searchsorted(at, np.arange(mine), "right").tolist()
            length, arc = (length + 1).tolist(), 0
            for i, stop in enumerate(stops):
                slot = (begin + i) % size
                here = ring[slot]
                ring[slot] = 0.0
                if here < 1e-60:
                    ring, here, scale = [x * 1e60 for x in ring], here * 1e60, scale - 60
                while arc < stop:
                    ring[(slot + length[arc]) % size] += here * factor[arc]
                    arc += 1
        return float(np.log(ring[len(chars) % size]) + scale * np.log(10))

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (and the unknown piece) in ``counts`` copies of the words."""
        out = np.zeros(len(self.pieces) + 2)
        for part, n, first, chars in self.batches(words, whole=False):
            ids, scores = self.lattice(chars, remaining(n, first))
            alpha, beta = self.forward(n, first, scores), self.backward(n, first, scores)
            word = np.repeat(np.arange(len(n)), n)
            node = np.arange(len(chars)) + word
            total = alpha[first + np.arange(len(n)) + n]
            weight = counts[part].astype(np.float64)
            for size in range(self.longest):
                at = np.flatnonzero(ids[size] >= 0)
                if at.size:
                    share = np.exp(alpha[node[at]] + scores[size, at] + beta[node[at] + size + 1] - total[word[at]])
                    out += np.bincount(ids[size, at], share * weight[word[at]], len(out))
        return out


def remaining(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.repeat(first + n, n) - np.arange(int(n.sum()))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def is_held_out() -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(rows: DataFrame) -> DataFrame:
    """From (held_out, text): every distinct word with its count in training rows (c) and in all rows (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(train.keys() | held.keys())
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                c = np.array([train[w] for w in part], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(c), pa.array(c + np.array([held[w] for w in part], dtype=np.int64))], ["word", "c", "n"])
            train.clear()
            held.clear()

        for batch in batches:
            for out, text in zip(batch.column("held_out").to_pylist(), byte_rows(batch.column("text")), strict=True):
                (held if out else train).update(tokens(text))
                if len(train) + len(held) > FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(pieces: Pieces, words: DataFrame, documents: int, rounds: int = ROUNDS) -> Pieces:
    """Expectation-maximisation of the piece scores over all training words."""
    spark = words.sparkSession
    used = words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                total = total + shared.value.expected(byte_rows(batch.column("word")), batch.column("c").to_numpy())
            if not isinstance(total, float):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        # As many rows as the vocabulary has pieces, at most.
        sums = used.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(pieces.score), 0.01)
        for row in sums:
            uses[row["piece"]] += row["uses"]
        uses[pieces.end] += documents
        pieces.score = np.log(uses / uses.sum())
    return pieces


def with_log_probability(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` with lm, the marginal log10 probability of the lattice."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = shared.value.log_probability(byte_rows(batch.column("word"))) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "lm"])

    return words.mapInArrow(run, "word binary, c long, n long, lm double")


def frequent(words: DataFrame) -> dict[bytes, tuple[int, float]]:
    """The most frequent words, at most ``HEAD_WORDS``, with (c, lm): those above the least count that keeps the bound."""
    band = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int").alias("band")  # at most 1,008 bands
    short = words.where(F.length("word") <= HEAD_BYTES)
    bands = sorted(((r["band"], r["count"]) for r in short.groupBy(band).count().collect()), reverse=True)
    least, total = None, 0
    for number, count in bands:
        total += count
        if total > HEAD_WORDS:
            break
        least = number
    if least is None:
        return {}
    return {bytes(r["word"]): (r["c"], r["lm"]) for r in short.where(band >= least).select("word", "c", "lm").toLocalIterator()}


def lattice_report(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word model) and score (lattice), both log10."""
    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    counted = written(word_counts(rows), "words")
    documents = rows.where("not held_out").count()
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    trained, distinct = sums["n"] + documents, sums["v"] + (documents > 0)
    pieces = fit(Pieces.load(vocabulary), counted, documents, rounds)
    words = written(with_log_probability(counted, pieces), "words")
    head = docs.sparkSession.sparkContext.broadcast(frequent(words))
    end = float(pieces.score[pieces.end] / np.log(10))
    row_type = "doc_id " + docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(head.value)}
        table = np.array([*head.value.values(), (0, 0.0)], dtype=np.float64)
        known, base, lm = table[:, 0] > 0, np.log10(table[:, 0] + 1.0), table[:, 1]
        uid = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))
        for batch in batches:
            found: list[list] = [[], [], [], [], [], []]
            for text in byte_rows(batch.column("text")):
                words = tokens(text)
                at = np.array([number.get(w, -1) for w in words], dtype=np.int64)
                rare = Counter(w for w, i in zip(words, at.tolist(), strict=True) if i < 0) if (at < 0).any() else {}
                values = (uid, len(words) + 1, int(known[at].sum()), float(base[at].sum()), float(lm[at].sum()), [{"word": w, "times": t} for w, t in rare.items()])
                for column, value in zip(found, values, strict=True):
                    column.append(value)
                uid += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.int64()), batch.column("doc_id"), batch.column("held_out"), *(pa.array(f, t) for f, t in zip(found[1:], (pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind), strict=True))],
                ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "rare"],
            )

    # Written before it is read twice, so that the row numbers given in the tasks are one and the same.
    found = written(rows.mapInArrow(run, f"uid long, {row_type}, held_out boolean, n_tokens long, n_known long, base double, lm double, rare array<struct<word: binary, times: int>>"), "rows")
    rare = found.select("uid", F.inline("rare")).join(words.select("word", "c", F.col("lm").alias("p")), "word")
    sums = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("r_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("r_base"),
        F.sum(F.col("times") * F.col("p")).alias("r_lm"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    end_known = 1 if documents else 0
    return found.join(sums, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", zero) + end_known).cast("long").alias("n_known"),
        F.lit(trained).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", none) + float(np.log10(documents + 1)) - F.col("n_tokens") * float(np.log10(trained + distinct + 1))).alias("base_score"),
        (F.col("lm") + F.coalesce("r_lm", none) + end).alias("score"),
    )
