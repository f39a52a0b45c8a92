"""A Merkle manifest of a dataset: what each row hashes to, and proofs that a row belongs to the root.

Rows are leaves. The leaves of a group (``lang``) ascend by ``doc_id``; every 8 consecutive nodes
become one node above them until one is left, the group's subroot. The subroots, in the order of their
groups, give the root in the same way. A node is known by its coordinates: tree (the group's place
in the order of groups, -1 for the tree over the subroots), level and index.

A proof is a lookup by coordinates. From a leaf's index and the size of its group alone follow the
coordinates of all siblings on its way to the root. They are exploded, joined with the written table of
nodes, put in order, concatenated and folded. The eight leaves of a run share all coordinates above their own level,
so those are exploded once a run, not once a leaf.

Scale. Leaves get their index from range partitions: the place in the partition plus the rows of that
group in earlier ones, so a group may hold any share of the rows. A node of level k is asked for by about
8**k runs; the table of nodes repeats it 8**(k-2) times under salts, which adds n/64 rows a level and leaves
no coordinate that more than 64 runs ask for. Only the tree's height comes to the driver.

Defined results. A null field hashes as ``-``; an empty text as ``0:``; null ids come first in their group,
null groups first of all. Rows that share an id are ordered by their hash; equal rows are leaves
of their own, side by side. No rows, no root. Columns besides the five are not read, whatever their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
TOP = -1  # the tree over the subroots
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, index, size, group, doc_id, digest, shown; nodes: tree, level, index, size, digest; groups: tree, size, group, subroot."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    n_groups: int
    root: bytes | None


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after the other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(column: Column) -> Column:
    return F.lower(F.hex(column))


def row_digest(values: list[Column]) -> Column:
    """The digest of a row's values, each with its length in bytes; null as ``-``."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def level_sizes(size: int) -> list[int]:
    """The number of nodes of each level, the single one at the top included."""
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def grown(level: DataFrame) -> DataFrame:
    """The level above: each run of nodes becomes the digest of their digests."""
    run = F.floor(F.col("index") / ARITY).alias("index")
    members = F.sort_array(F.collect_list(F.struct("index", "digest")))
    runs = level.where("size > 1").groupBy("tree", run).agg(members.alias("members"), F.max("size").alias("size"))
    joined = F.array_join(F.transform("members", lambda m: hexed(m["digest"])), "")
    above = F.floor((F.col("size") + ARITY - 1) / ARITY)
    return runs.select("tree", "index", above.alias("size"), digest(joined).alias("digest"))


def all_levels(leaves: DataFrame, size: int, label: str) -> list[DataFrame]:
    """All levels of the trees over ``leaves``, the largest of which has ``size`` of them; each is written."""
    levels = [leaves.select("tree", "index", "size", "digest")]
    for _ in level_sizes(size)[1:]:
        levels.append(written(grown(levels[-1]), label))
    return levels


def stacked(levels: list[DataFrame]) -> DataFrame:
    found = None
    for k, level in enumerate(levels):
        part = level.withColumn("level", F.lit(k))
        found = part if found is None else found.unionByName(part)
    return found


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, shown: Column | None = None) -> Manifest:
    """The manifest of ``rows``. ``shown``, a text in place of the last field, is hashed to be held against the proof."""
    values = [F.col(c) for c in fields]
    leaf = row_digest(values)
    other = leaf if shown is None else row_digest([*values[:-1], shown])
    hashed = rows.select(F.col(group).alias("group"), F.col(order).alias("doc_id"), leaf.alias("digest"), other.alias("shown"))
    ordered = numbered(written(hashed, "merkle-hashed"), ["group"], ["doc_id", "digest", "shown"], "merkle-leaves")
    counted = written(ordered.groupBy("group").agg(F.count("*").alias("size")), "merkle-sizes")
    trees = written(numbered(counted, [], ["group"], "merkle-groups").withColumnRenamed("index", "tree"), "merkle-trees")
    a, b = ordered.alias("a"), trees.alias("b")
    leaves = a.join(b, F.col("a.group").eqNullSafe(F.col("b.group"))).select("tree", "index", "size", "a.group", "doc_id", "digest", "shown")
    leaves = written(leaves, "merkle-indexed")
    n_groups, largest = trees.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    levels = stacked(all_levels(leaves, largest, "merkle-level"))
    subroots = written(levels.where("size = 1").select("tree", "digest"), "merkle-subroots")
    top_leaves = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(n_groups).cast("long").alias("size"), "digest")
    top = stacked(all_levels(top_leaves, n_groups, "merkle-top"))
    root = top.where("size = 1").first()
    groups = written(trees.select("tree", "size", "group").join(subroots.withColumnRenamed("digest", "subroot"), "tree"), "merkle-groups")
    return Manifest(leaves, levels.unionByName(top), groups, n_groups, bytes(root["digest"]) if root else None)


def nodes_at(size: str) -> str:
    """The number of nodes at level l of a tree with ``size`` leaves."""
    return f"((cast({size} as long) + cast(power({ARITY}, l) as long) - 1) div cast(power({ARITY}, l) as long))"


def levels_from(first: int, size: str) -> str:
    """The levels from ``first`` on that have a level above them: all with more than one node."""
    height = f"cast(ceil(log({ARITY}, cast({size} as long))) as int)"  # rounding can't make it more than one too few
    return f"filter(sequence({first}, greatest({first}, {height} + 1)), l -> {nodes_at(size)} > 1)"


def coordinates(index: str, size: str, first: int) -> Column:
    """The siblings (level, index) of the node ``index`` of level ``first`` and of all nodes above it, in a tree of ``size`` leaves."""
    at = f"(cast({index} as long) div cast(power({ARITY}, l - {first}) as long))"  # the ancestor at level l
    run = f"({at} - {at} % {ARITY})"
    siblings = f"filter(sequence({run}, least({run} + {ARITY}, {nodes_at(size)}) - 1), x -> x <> {at})"
    return F.expr(f"flatten(transform({levels_from(first, size)}, l -> transform({siblings}, x -> struct(l as level, x as index))))")


def salts(level: Column) -> Column:
    """How often the table of nodes repeats a node of this level."""
    return F.pow(F.lit(float(ARITY)), F.greatest(level - 2, F.lit(0))).cast("long")


def lookup(starts: DataFrame, nodes: DataFrame, first: int) -> DataFrame:
    """``starts`` (tree, index, size: nodes of level ``first``) with ``steps``: for each level below the
    top the siblings' digests as hex text, those before and those after the own node (a lone node has none)."""
    asked = starts.withColumn("c", F.explode_outer(coordinates("index", "size", first)))
    asked = asked.select("tree", "size", F.col("index").alias("start"), F.col("c.level").alias("level"), F.col("c.index").alias("index"))
    salted = asked.withColumn("salt", F.col("start") % salts(F.col("level")))
    held = nodes.where(F.col("level") >= first).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts(F.col("level")) - 1)))
    found = salted.join(held.select("tree", "level", "index", "salt", "digest"), ["tree", "level", "index", "salt"], "left")
    own = F.floor(F.col("start") / F.pow(F.lit(float(ARITY)), F.col("level") - first))
    found = found.withColumn("after", F.col("index") > own)
    got = F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "index", "after", "digest"))))
    steps = f"""transform({levels_from(first, "size")}, l -> struct(
        array_join(transform(filter(got, g -> g.level = l and not g.after), g -> lower(hex(g.digest))), '') as before,
        array_join(transform(filter(got, g -> g.level = l and g.after), g -> lower(hex(g.digest))), '') as after))"""
    return found.groupBy("tree", "start", "size").agg(got.alias("got")).select("tree", F.col("start").alias("index"), F.expr(steps).alias("steps"))


def proofs(found: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """``leaves`` (all of the manifest if None) with subroot, root and ``steps`` from the leaf to the root."""
    leaves = found.leaves if leaves is None else leaves
    run = F.floor(F.col("index") / ARITY)
    # The runs of leaves: nodes of level 1, or the lone leaf of a group
    runs = leaves.groupBy("tree", run.alias("index")).agg(F.max("size").alias("size"))
    upper = lookup(runs, found.nodes.where(F.col("tree") != TOP), 1)
    members = F.sort_array(F.collect_list(F.struct("index", "digest")))
    asked = runs.select("tree", "index")
    near = found.nodes.where((F.col("tree") != TOP) & (F.col("level") == 0)).groupBy("tree", run.alias("index")).agg(members.alias("members"))
    if leaves is not found.leaves:
        near = near.join(asked, ["tree", "index"], "left_semi")
    near = near.join(upper, ["tree", "index"]).withColumnRenamed("index", "run")
    subroots = found.groups.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(found.n_groups).cast("long").alias("size"))
    tops = lookup(subroots, found.nodes.where(F.col("tree") == TOP), 0)
    groups = found.groups.join(tops.select(F.col("index").alias("tree"), F.col("steps").alias("top_steps")), "tree")
    # A large group's row is repeated, so that its leaves don't all meet in one task.
    copies = F.greatest(F.lit(1), F.floor(F.col("size") / 32768)).cast("long")
    groups = groups.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("size", "group")
    rows = leaves.withColumns({"run": run, "copy": run % copies}).join(near, ["tree", "run"]).join(groups, ["tree", "copy"])
    text = lambda side: F.array_join(F.transform(F.filter("members", side), lambda m: hexed(m["digest"])), "")
    own = F.struct(text(lambda m: m["index"] < F.col("index")).alias("before"), text(lambda m: m["index"] > F.col("index")).alias("after"))
    # The lone leaf of a group has no run: it is the subroot.
    steps = F.concat(F.when(F.col("size") > 1, F.array(own)).otherwise(F.array().cast("array<struct<before:string,after:string>>")), "steps", "top_steps")
    return rows.select(*leaves.columns, "subroot", F.lit(found.root).alias("root"), steps.alias("steps"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.reduce(steps, leaf, lambda node, step: digest(step["before"], hexed(node), step["after"]))


def proof_text(steps: Column) -> Column:
    """All siblings' digests of a proof, from the leaf up, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def tampered(docs: DataFrame) -> Column:
    """The text as shown to the verifier: lower-cased where 3 divides the id's checksum."""
    low = F.translate("text", UPPER, LOWER)
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, low).otherwise(F.col("text"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the row as shown) and verified, for every row."""
    rows = docs.select(*FIELDS)
    proved = proofs(manifest(rows, shown=tampered(rows)))
    end = folded(F.col("shown"), F.col("steps"))
    shown = proved.withColumns({"folded": end, "proof": proof_text(F.col("steps"))})
    return shown.select(
        "doc_id",
        hexed(F.col("digest")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
