"""Mixing sources to target weights by hierarchical budgets.

A tree domain - language - source carries weights. The token budget flows from the root: each node
splits its budget among its children by weight. A child takes no more than its subtree holds
(tokens x ``max_epochs``); what it can't take goes to its siblings by weight, and only what all
siblings together can't take leaves the subtree, to the siblings of their parent. With capacities
summed bottom-up and budgets filled top-down, this is one water-filling per level, in closed form:
children in order of capacity / weight, of which a prefix is full. All amounts are whole tokens and
add up exactly.

A leaf's quota is a prefix of its token stream: whole seeded epochs first, then documents of the
next epoch in the order of md5(seed:epoch:doc_id) until the quota is reached; the last document may
count in part. The cut is found in two steps, so that no leaf is ever sorted as a whole: token sums
of 4,096 hash buckets per leaf, then the rows of the one bucket where the quota ends.

Null language or source is the empty name; a null text has no tokens and is not selected. Rows that
share a doc_id in a leaf also share their place; at the cut they share what is left, rounded down.
A weight of 0 leaves a branch out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Recipe:
    """Whole-number weights by name at each level, the domain of each source, and the budget."""

    domain_sources: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "web": tuple(f"src{i}" for i in range(8)),
            "books": tuple(f"src{i}" for i in range(8, 12)),
            "reference": tuple(f"src{i}" for i in range(12, 16)),
            "forums": tuple(f"src{i}" for i in range(16, 20)),
        }
    )
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {
            "domain": {"web": 500, "books": 250, "reference": 150, "forums": 100},
            "lang": {"en": 600, "de": 150, "fr": 150, "es": 100},
            "source": {"src0": 3},
        }
    )
    other: dict[str, int] = field(default_factory=lambda: {"domain": 50, "lang": 20, "source": 1})
    max_epochs: int = 2
    budget_percent: int = 60
    seed: int = 42

    def domain(self) -> Column:
        out = F
        for name, sources in self.domain_sources.items():
            out = out.when(F.col("source").isin(*sources), name)
        return out.otherwise("other")

    def weight(self, level: str) -> Column:
        out = F
        for name, weight in self.weights[level].items():
            out = out.when(F.col(level) == name, weight)
        return out.otherwise(self.other[level]).cast("long")


def whole(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` among children (``weight``, ``capacity``); replaces budget by the child's."""
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("capacity") / F.col("weight"), name)
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    rows = children.where("weight > 0").withColumns(
        {
            "_w_before": F.coalesce(F.sum("weight").over(before), zero),
            "_c_before": F.coalesce(F.sum("capacity").over(before), zero),
            "_w": F.sum("weight").over(family),
        }
    )
    full = whole(F.col("capacity")) * (F.col("_w") - F.col("_w_before")) <= whole(F.col("weight")) * (F.col("budget") - F.col("_c_before"))
    rows = rows.withColumn("_full", full)
    open_weight = F.when(~F.col("_full"), F.col("weight")).otherwise(zero)
    rows = rows.withColumns(
        {
            "_rest": F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(zero)).over(family),
            "_open": F.sum(open_weight).over(family),
            "_open_upto": F.sum(open_weight).over(upto),
        }
    )
    share = F.expr("(cast(_rest as decimal(38,0)) * _open_upto) div _open - (cast(_rest as decimal(38,0)) * (_open_upto - weight)) div _open")
    rows = rows.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(share).cast("long"))
    return rows.drop("_w_before", "_c_before", "_w", "_full", "_rest", "_open", "_open_upto")


def allocate(leaves: DataFrame, recipe: Recipe, budget: int) -> DataFrame:
    """The quota of each leaf (domain, lang, source, tokens)."""
    weighed = leaves.withColumns({f"w_{level}": recipe.weight(level) for level in LEVELS})
    usable = F.when(F.least(*(F.col(f"w_{level}") for level in LEVELS)) > 0, F.col("tokens") * recipe.max_epochs).otherwise(0).cast("long")
    weighed = weighed.withColumn("capacity", usable)
    by_domain = weighed.groupBy("domain", F.col("w_domain").alias("weight")).agg(F.sum("capacity").alias("capacity"))
    by_lang = weighed.groupBy("domain", "lang", F.col("w_lang").alias("weight")).agg(F.sum("capacity").alias("capacity"))
    by_source = weighed.select("domain", "lang", "source", F.col("w_source").alias("weight"), "capacity", "tokens")
    domains = fill(by_domain.withColumn("budget", F.lit(budget).cast("long")), [], "domain")
    langs = fill(by_lang.join(domains.select("domain", "budget"), "domain"), ["domain"], "lang")
    sources = fill(by_source.join(langs.select("domain", "lang", "budget"), ["domain", "lang"]), ["domain", "lang"], "source")
    return sources.select(*LEVELS, "tokens", F.col("budget").alias("quota"))


def place(seed: int, epoch: Column) -> Column:
    """A document's place in an epoch: sortable hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def counted(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """doc_id, leaf and whole-text token count of each document."""
    named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    tokens = F.regexp_count("text", F.lit(TOKEN)).cast("long")
    return named.select("doc_id", recipe.domain().alias("domain"), "lang", "source", F.coalesce(tokens, F.lit(0)).alias("n_tokens"))


def leaf_plan(counts: DataFrame, recipe: Recipe) -> DataFrame:
    """For each leaf: whole epochs, and where in the next epoch its quota ends (place, tokens of the last document)."""
    total = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    leaves = counts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    quota = allocate(leaves, recipe, total * recipe.budget_percent // 100)
    plan = written(quota.withColumn("epochs", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens")), "leaves")
    placed = counts.where("n_tokens > 0").join(plan.where("rest > 0"), list(LEVELS)).withColumn("place", place(recipe.seed, F.col("epochs")))
    placed = placed.withColumn("bucket", F.substring("place", 1, 3))
    leaf = Window.partitionBy(*LEVELS)
    upto = leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("size")).withColumn("upto", F.sum("size").over(upto))
    ends = sums.where("upto >= rest and upto - size < rest").select(*LEVELS, "bucket", (F.col("upto") - F.col("size")).alias("before"))
    last = placed.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "rest", "before", "place").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n"))
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(leaf.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    cut = last.where("upto >= rest and upto - size < rest").select(*LEVELS, F.col("place").alias("cut"), F.expr("(rest - upto + size) div n").alias("cut_tokens"))
    # Written: what documents join is then a table of known size, broadcast if small, else split where a leaf is hot.
    return written(plan.join(cut, list(LEVELS), "left"), "plan")


def select_tokens(rows: DataFrame, plan: DataFrame, recipe: Recipe) -> DataFrame:
    """``rows`` (leaf columns, doc_id, n_tokens) once for each epoch that uses it, with epoch and take_tokens."""
    joined = rows.join(plan, list(LEVELS)).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    joined = joined.withColumn("place", place(recipe.seed, F.col("epoch")))
    take = F.when(F.col("epoch") < F.col("epochs"), F.col("n_tokens"))
    take = take.when(F.col("place") < F.col("cut"), F.col("n_tokens")).when(F.col("place") == F.col("cut"), F.least("n_tokens", "cut_tokens"))
    return joined.withColumn("take_tokens", F.coalesce(take, F.lit(0).cast("long"))).where("take_tokens > 0")


def mix_report(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """doc_id, leaf, epoch, n_tokens, take_tokens of every document in every epoch that uses it."""
    counts = written(counted(docs, recipe), "counts")
    chosen = select_tokens(counts, leaf_plan(counts, recipe), recipe)
    return chosen.select("doc_id", *LEVELS, "epoch", "n_tokens", "take_tokens")


def mix_documents(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """The chosen rows of ``docs`` with their own columns, one for each epoch; texts are read twice, not shuffled
    (unless the table of leaves is too large to broadcast, which Spark checks when it has it)."""
    columns = docs.columns
    plan = leaf_plan(written(counted(docs, recipe), "counts"), recipe)
    leaves = docs.select(F.struct(*columns).alias("_row"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n_tokens"))
    leaves = leaves.where("n_tokens > 0").withColumn("domain", recipe.domain())
    return select_tokens(leaves, plan, recipe).select("_row.*")
