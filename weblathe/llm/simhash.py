"""SimHash near-duplicate groups with BK-trees (Charikar, 2002; Burkhard and Keller, 1973).

Every text gets a 64-bit fingerprint of its word shingles. There are two ways to link documents; a
group is what links connect.

``near_duplicate_groups`` links fingerprints that differ in at most ``RADIUS`` bits. Distinct
fingerprints are dealt into shards by 4 of 6 blocks of their bits, in all 15 ways: two fingerprints
that differ in two bits agree in at least four blocks, so every link is inside some shard. A shard
holds at most 2**22 distinct fingerprints (the bits outside its four blocks), which bounds its tree.

``similar_groups`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Such texts differ in about ten bits, more than blocks can cover, so fingerprints are dealt by
``SAMPLES`` fixed random choices of ``SAMPLED_BITS`` bits each; trees find the links within
``WIDE_RADII`` bits, nearest first, and every link whose second fingerprints agree, too, is then verified
on the sets themselves. On the
sample corpus (10,000 documents) 0.90 of 293 pairs of different sets at 0.8 or more end up in one
group, 0.99 with copies (the settings were chosen on these pairs; see the README). Shards grow with the corpus; each further bit halves them.

In a task, all shards of a partition form one forest of BK-trees; queries follow only child edges
whose distance lies within the radius of the distance to the parent. A tree yields the links of a
spanning forest of its shard, at most one for each fingerprint, not all pairs. Groups then come from
alternating large-star and small-star steps (Kiveris et al., 2014) on tables in the shared folder.

Copies share a fingerprint and are one node. Null and wordless texts have fingerprint zero and link
like any other. A null doc_id orders after all others: a group with no other id has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, free_names, id_or_last, mix64, null_if_last, written

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit, bits
STAGE_WORDS = 5
SIMILARITY = 0.8
SAMPLES = 96
SAMPLED_BITS = 16
WIDE_RADII = (3, 6, 9, 12, 15)
SECOND_RADIUS = 20
BITMAP_WORDS = 1 << 17
FRONTIER = 1 << 17
QUERIES = 1 << 12


def shingle_hashes(text: bytes, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the lower-cased text's word shingles, repeats included; of all its words if they are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = (ends - [len(w) + 1 for w in words])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.array([digest(joined[b:e], SEED) for b, e in zip(begins, stops, strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 100_000):
        votes += np.unpackbits(hashes[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: a bit is 1 if more than half of the shingles' hashes have it; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, second: bool = False) -> DataFrame:
    """(id, fp) from (id, text), fp as a signed long; with ``second`` also fp2, from other hashes of the same shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, other = [], []
            for text in byte_rows(batch.column("text")):
                hashes = shingle_hashes(text, shingle)
                first.append(majority(hashes))
                if second:
                    other.append(majority(mix64(hashes)))
            signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in ([first, other] if second else [first])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *signed], ["id", "fp", "fp2"][: len(signed) + 1])

    return docs.select("id", "text").mapInArrow(run, "id long, fp long, fp2 long" if second else "id long, fp long")


class Forest:
    """BK-trees over sorted groups of distinct values, built and searched all at once."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value = value
        self.root = np.searchsorted(group, group, "left")
        self.parent = np.arange(len(value))
        pending = np.flatnonzero(self.root != np.arange(len(value)))
        node = self.root[pending]
        keys, self.levels = [], []
        while pending.size:
            distance = np.bitwise_count(value[pending] ^ value[node]).astype(np.int64)
            edge = node * 128 + distance
            order = np.argsort(edge, kind="stable")
            edge, pending = edge[order], pending[order]
            first = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1]])
            keys.append(edge[first])
            self.levels.append(pending[first])
            self.parent[pending[first]] = edge[first] >> 7
            child = np.repeat(pending[first], np.diff(np.r_[first, len(edge)]))
            below = child != pending
            pending, node = pending[below], child[below]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.edge = key[order]
        self.child = (np.concatenate(self.levels) if keys else np.zeros(0, np.int64))[order]

    def one_label(self, label: np.ndarray) -> np.ndarray:
        """For each subtree, the label that all its values have, -1 if they differ."""
        least, most = label.copy(), label.copy()
        for level in reversed(self.levels):
            np.minimum.at(least, self.parent[level], least[level])
            np.maximum.at(most, self.parent[level], most[level])
        return np.where(least == most, least, -1)

    def spanning(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) for all values that links within ``radius`` connect to a smaller root."""
        label, _ = self.search(radius)
        member = np.flatnonzero(label != np.arange(len(label)))
        return member, label[member]

    def links(self, *radii: int) -> tuple[np.ndarray, np.ndarray]:
        """The links (a, b) themselves, of a forest; closer ones are taken first."""
        _, found = self.search(*radii)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def search(self, *radii: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Join all values within the last radius: the label of each value, and the links that joined them.

        A query skips subtrees that are joined to it already, so a dense group costs little more
        than its size. What waits to be visited is held as ranges: memory is the depth of the trees
        times one piece.
        """
        label = np.arange(len(self.value))
        alone = self.root == np.arange(len(self.value))
        has_more = np.zeros(len(self.value), dtype=bool)
        has_more[self.root[~alone]] = True
        query = np.flatnonzero(has_more[self.root])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for radius in radii:
            joined, known = np.full(len(label), -1), 0
            for begin in range(0, len(query), QUERIES):
                if known != (now := int((label != np.arange(len(label))).sum())):
                    joined, known = self.one_label(label), now
                label = self.visit(query[begin : begin + QUERIES], radius, label, joined, found)
        return label, found

    def visit(self, asked: np.ndarray, radius: int, label: np.ndarray, joined: np.ndarray, found: list) -> np.ndarray:
        """Search the trees of the values ``asked`` and join what lies within the radius; new labels."""
        stack = []
        visit = (asked, self.root[asked])
        while True:
            asked, node = visit
            open_ = joined[node] != label[asked]
            asked, node = asked[open_], node[open_]
            distance = np.bitwise_count(self.value[asked] ^ self.value[node]).astype(np.int64)
            near = (distance <= radius) & (asked > node)
            label = hook(label, asked[near], node[near], distance[near], found)
            low = np.searchsorted(self.edge, node * 128 + np.maximum(distance - radius, 0), "left")
            count = np.searchsorted(self.edge, node * 128 + np.minimum(distance + radius, 127), "right") - low
            some = count > 0
            if some.any():
                stack.append((asked[some], low[some], count[some]))
            if not stack:
                return label
            asked, low, count = stack.pop()
            end = max(1, int(np.searchsorted(np.cumsum(count), FRONTIER, "right")))
            if end < len(asked):
                stack.append((asked[end:], low[end:], count[end:]))
            n = count[:end]
            slot = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[:end], n)
            visit = (np.repeat(asked[:end], n), self.child[slot])


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray, found: list) -> np.ndarray:
    """Union the classes of each pair, closest first; a label is the least index of its class.

    Pairs that join two classes are added to ``found``: each takes one class into another.
    """
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, distance, x, y = a[apart], b[apart], distance[apart], x[apart], y[apart]
        more, less = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((distance, more))
        first = order[np.r_[True, more[order][1:] != more[order][:-1]]]
        label = label.copy()
        label[more[first]] = less[first]
        found.append((a[first], b[first]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def shard_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between ids, from distinct fingerprints ``nodes`` (id, fp): a spanning set of each shard."""
    if radius > 2:
        raise ValueError("the shards cover radii up to 2")
    masks = [sum(((1 << bits) - 1) << at for at, bits in chosen) for chosen in combinations(BLOCKS, len(BLOCKS) - 2)]
    return tree_links(nodes, masks, radius, roots=True)


def wide_links(nodes: DataFrame, samples: int = SAMPLES, bits: int = SAMPLED_BITS, radii: tuple[int, ...] = WIDE_RADII) -> DataFrame:
    """Links within the last radius that share the bits of some sample, the closest of each shard first."""
    rng = np.random.default_rng(SEED)
    masks = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(samples)]
    return tree_links(nodes, masks, *radii)


def tree_links(nodes: DataFrame, masks: list[int], *radii: int, roots: bool = False) -> DataFrame:
    """Links (a, b) of the BK-trees over shards: fingerprints that agree in the bits of one of the masks.

    ``roots``: each value with the root of its group instead, which is as well connected and less deep.
    """
    signed = np.array(masks, dtype=np.uint64).view(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ids, prints = (batch.column(c).to_numpy()[at : at + 4096] for c in ("id", "fp"))
                way = np.tile(np.arange(len(signed), dtype=np.int32), len(ids))
                prints = np.repeat(prints, len(signed))
                yield pa.RecordBatch.from_arrays([pa.array(way), pa.array(prints & np.tile(signed, len(ids))), pa.array(np.repeat(ids, len(signed))), pa.array(prints)], ["way", "key", "id", "fp"])

    dealt = nodes.select("id", "fp").mapInArrow(deal, "way int, key long, id long, fp long")
    sorted_rows = dealt.repartition("way", "key").sortWithinPartitions("way", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for way, key, ids, prints in whole_groups(batches):
            turn = np.r_[True, (way[1:] != way[:-1]) | (key[1:] != key[:-1])]
            forest = Forest(np.cumsum(turn), prints.view(np.uint64))
            a, b = forest.spanning(radii[-1]) if roots else forest.links(*radii)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return sorted_rows.mapInArrow(search, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], enough: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """Join sorted batches into blocks that hold whole groups (equal first two columns)."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) >= enough:
            block = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = (block[0] == block[0][-1]) & (block[1] == block[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield [c[:cut] for c in block]
            held = [[c[cut:] for c in block]]
    if held and sum(len(h[0]) for h in held):
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def connected(links: DataFrame) -> DataFrame:
    """(id, root) for each id in ``links`` (a, b): root is the least id that links reach.

    Large-star then small-star until the set of links stays as it is. Each round is a written
    table; only its row count and checksum come to the driver.
    """
    tidy = lambda e: e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    current = written(tidy(links), "links")
    while True:
        state = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == state or not state["n"]:
            return current.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        current = written(tidy(small), "links")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document; no link is lost."""
    prints = written(fingerprints(docs.select(id_or_last().alias("id"), "text")), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    roots = connected(shard_links(nodes))
    groups = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("group"))
    return prints.join(groups, "fp").select(
        null_if_last(F.col("id")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        null_if_last(F.col("group")).alias("component_id"),
    )


def hash_slot() -> list:
    """The word and the bit of an id in a bitmap of ``BITMAP_WORDS`` words."""
    hashed = F.xxhash64("id")
    return [F.pmod(F.shiftrightunsigned(hashed, 6), F.lit(BITMAP_WORDS)).cast("int").alias("word"), hashed.bitwiseAND(F.lit(63)).cast("int").alias("bit")]


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the hashes of ids: at most ``BITMAP_WORDS`` rows come to the driver."""
    words = ids.select(*hash_slot()).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out = np.zeros(BITMAP_WORDS, dtype=np.int64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out


def shingle_sets(docs: DataFrame, asked: DataFrame, shingle: int = STAGE_WORDS) -> DataFrame:
    """(id, shingles): the distinct hashes of each text's shingles, from (id, text); for all ids in ``asked``, and some more.

    A bitmap of the ids asked for goes to the tasks, so texts stay where they are; as it fills, more
    sets are made than are asked for, which joins on the id leave out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = batch.column("word").to_numpy(), batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((shared.value[word] >> bit & 1).astype(bool)))
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in byte_rows(batch.column("text"))]
            offsets = np.cumsum([0, *(len(x) for x in sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["id", "shingles"])

    return docs.select("id", "text", *hash_slot()).mapInArrow(run, "id long, shingles array<long>")


def verified(links: DataFrame, docs: DataFrame, shingle: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The links (a, b) whose texts in ``docs`` (id, text; ids unique) are similar: Jaccard on shingle sets."""
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(shingle_sets(docs, asked, shingle), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar_groups(docs: DataFrame, shingle: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, group) of every id in ``docs`` (id, text): the least id of its group of similar texts.

    Rows that share an id must be one document to the caller: the least fingerprint stands for them.
    """
    prints = written(fingerprints(docs, shingle, second=True).groupBy("id").agg(F.min_by(F.struct("fp", "fp2"), "fp").alias("p")).select("id", "p.fp", "p.fp2"), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min_by(F.struct("id", "fp2"), "id").alias("n")).select("fp", "n.id", "n.fp2"), "nodes")
    # The second fingerprint leaves out nearly all links of unlike texts before any text is read again.
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("fp2").alias(f"fp_{c}"))
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= SECOND_RADIUS
    links = written(wide_links(nodes).distinct(), "links").join(side("a"), "a").join(side("b"), "b").where(near)
    roots = connected(verified(written(links.select("a", "b"), "near"), docs.select("id", "text"), shingle, similarity))
    groups = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("group"))
    return prints.join(groups, "fp").select("id", "group")


def one_of_each_group(docs: DataFrame, shingle: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the least doc_id.

    Rows that share a doc_id are one document (the row of the least text hash stands for it). Rows
    without an id are told apart by their text and order after all ids below 2**62.
    """
    columns = docs.columns
    key, code = free_names(docs, "_id", "_hash")
    own = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    named = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), own), code: F.xxhash64("text")})
    repeated = named.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        first = named.groupBy(key).agg(F.min(code).alias(code))
        named = named.join(first, [key, code], "left_semi").dropDuplicates([key, code])
        named = written(named, "named")
    groups = written(similar_groups(named.select(F.col(key).alias("id"), "text"), shingle, similarity), "groups")
    later = written(groups.where("id <> group").select(F.col("id").alias(key)), "later")
    return named.join(later, key, "left_anti").select(*columns)
