"""Quality rules as weak supervision: rules vote good, bad or abstain; a label model weighs them.

Each rule looks at one trait of a text and votes 1 (good), -1 (bad) or 0 (abstains). Nobody says how
far a rule can be trusted: expectation-maximisation over all documents' votes estimates, for good
and for bad documents, how often each rule votes each way (Dawid and Skene, 1979). A document's
posterior probability of being good replaces the usual filter that all rules must pass.

The statistic is the count of each vote pattern. With ten rules there are at most 3**10 = 59,049
patterns, so what comes to the driver is bounded whatever the number of documents. Features are one
narrow pass; the counts are the only shuffle.

Null and empty texts have no words and fail the base rule. Rows with equal text get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, LongType, StructField, StructType

from .common import byte_rows, written

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER, LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
MIN_WORDS = 50
ROUNDS = 30
# Very common words of the four languages.
COMMON_WORDS = (
    "the of and to in is that it for was on are with as be by this "
    "der die das und ist nicht ein zu von mit den auf "
    "le la les de des et un une est que pour dans "
    "el los las del y en por con para su al"
).split()
COMMON_FORMS = sorted({f.encode() for w in COMMON_WORDS for f in (w, w.capitalize(), w.upper())})

RULES = ("symbols", "repeats", "lines", "capitals", "exclamations", "bare_marks", "common_words", "variety", "word_length", "line_ends")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def removed(text: bytes, these: bytes) -> int:
    return len(text) - len(text.translate(None, these))


def repeated_words(codes: np.ndarray, distinct: int, span: int = 3) -> int:
    """Words inside a window of ``span`` words that occurs twice or more."""
    if len(codes) <= span:
        return 0
    key, size = codes, distinct
    for i in range(1, span):
        if size * distinct >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key[:-1] * distinct + codes[i:]
        size *= distinct
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(codes), dtype=bool)
    for i in range(span):
        covered[twice + i] = True
    return int(covered.sum())


def ballot(value: float, bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


def inspect(text: bytes) -> tuple[list[int], list[int]]:
    """The base counts of a text and the rules' votes."""
    words = text.split()
    n = len(words)
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    lines, seen, doubled, ended = 0, set(), 0, 0
    for line in text.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            doubled += line in seen
            ended += bare[-1:] in (b".", b"!", b"?", b":", b'"', b";")
            seen.add(line)
    counts = [n, len(text.translate(None, SPACE + CONTINUATION)), removed(text, SYMBOLS), doubled, repeated_words(codes, len(number))]
    if not n:
        return counts, [0] * len(RULES)
    times = np.bincount(codes, minlength=len(number))
    marks = sum(int(times[i]) for w, i in number.items() if not w.translate(None, PUNCTUATION))
    common = sum(int(times[number[f]]) for f in COMMON_FORMS if f in number)
    upper, lower = removed(text, UPPER), removed(text, LOWER)
    capitals = upper / max(1, upper + lower)
    shouts, symbols, repeats, length = text.count(b"!") / n, counts[2] / n, counts[4] / n, counts[1] / n
    variety = len(number) / n**0.5
    votes = [
        ballot(symbols, symbols > 0.1, symbols <= 0.03),
        ballot(repeats, repeats > 0.3, repeats <= 0.15),
        ballot(doubled, doubled > 0.3 * lines, doubled <= 0.1 * lines),
        ballot(capitals, capitals > 0.4, capitals < 0.2),
        ballot(shouts, shouts > 0.1, shouts < 0.02),
        ballot(marks, marks > 0.1 * n, marks < 0.02 * n),
        ballot(common, common < 0.02 * n, common > 0.1 * n),
        ballot(variety, variety < 2, variety > 4),
        ballot(length, length < 2 or length > 12, 3 <= length <= 9),
        ballot(ended, n >= 100 and ended == 0, ended >= 0.5 * lines),
    ]
    return counts, votes


FEATURES = [
    *(StructField(name, LongType()) for name in COUNTS),
    StructField("base_failed", BooleanType()),
    StructField("votes", ArrayType(ByteType())),
]


def with_votes(docs: DataFrame, text: str = "text", keep_text: bool = True, prefix: str = "") -> DataFrame:
    """``docs`` with the base counts, base_failed and the votes (names after ``prefix``); columns of these names are replaced."""
    features = [StructField(prefix + f.name, f.dataType) for f in FEATURES]
    names = [f.name for f in features]
    base = docs.drop(*names)
    rest = [f for f in base.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inspect(t) for t in byte_rows(batch.column(text))]
            columns = [batch.column(f.name) for f in rest]
            columns += [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            failed = [f[0][0] < MIN_WORDS or 100 * f[0][4] > 50 * f[0][0] for f in found]
            columns += [pa.array(failed, pa.bool_()), pa.array([f[1] for f in found], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in rest), *names])

    return base.mapInArrow(run, StructType(rest + features))


class LabelModel:
    """Class prior and, for each class, rule and vote, its probability; fitted to pattern counts."""

    def __init__(self, votes: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS):
        n_rules = votes.shape[1] if votes.size else len(RULES)
        self.prior = 0.8
        # rows: bad, good; columns: votes bad, abstain, good. Every rule starts out a little trusted.
        start = np.array([[0.3, 0.2, 0.5], [0.02, 0.18, 0.8]])
        self.table = np.repeat(start[:, None, :], n_rules, axis=1)
        if not votes.size:
            return
        one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        for _ in range(rounds):
            good = self.posterior(votes)
            mass = np.stack([(1 - good) * weights, good * weights])
            seen = np.einsum("cp,prv->crv", mass, one_hot) + 10 * start[:, None, :]
            self.table = seen / seen.sum(axis=2, keepdims=True)
            # A rule counts as better than chance: bad documents get bad votes at least as often.
            worse = self.table[0, :, 0] < self.table[1, :, 0]
            self.table[:, worse] = self.table[:, worse].mean(axis=0)
            self.prior = float(np.clip(mass[1].sum() / mass.sum(), 0.05, 0.95))

    def weights(self) -> tuple[float, np.ndarray]:
        """Log odds of good: the prior's, and those that each rule's vote adds."""
        return float(np.log(self.prior / (1 - self.prior))), np.log(self.table[1] / self.table[0])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        base, add = self.weights()
        odds = base + sum(add[j, votes[:, j].astype(int) + 1] for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(voted: DataFrame) -> LabelModel:
    """Expectation-maximisation over all rows that pass the base rule; see the bound above."""
    rows = voted.where("not base_failed").groupBy("votes").count().collect()
    rows.sort(key=lambda r: r["votes"])
    votes = np.array([r["votes"] for r in rows], dtype=np.int8).reshape(len(rows), len(RULES))
    return LabelModel(votes, np.array([r["count"] for r in rows], dtype=float))


def probability(model: LabelModel, votes: str = "votes") -> Column:
    """The posterior probability of good as an expression on the column of votes."""
    base, add = model.weights()
    odds = F.lit(base)
    for j, row in enumerate(add):
        odds = odds + F.element_at(F.array(*(F.lit(float(x)) for x in row)), F.get(votes, F.lit(j)).cast("int") + 2)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def quality_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the posterior p_good and the votes."""
    voted = written(with_votes(docs.select("doc_id", "text"), keep_text=False), "votes")
    good = probability(fit(voted))
    kept = ~F.col("base_failed") & (good >= threshold)
    return voted.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), good.alias("p_good"), "votes")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they were; texts are read twice, never shuffled."""
    columns = docs.columns
    model = fit(with_votes(docs.select("text"), keep_text=False))
    mine = "_q_"
    while any(c.lower().startswith(mine) for c in columns):
        mine = "_" + mine
    voted = with_votes(docs, prefix=mine)
    return voted.where(~F.col(f"{mine}base_failed") & (probability(model, f"{mine}votes") >= threshold)).select(*columns)
