"""Mixing sources to target weights by hierarchical budgets.

The corpus is a tree, by default domain, language, source. A budget of tokens flows from the
root to the leaves: each node divides what it gets among its children by their weights, no
child gets more than the tokens below it times ``epochs``, and what a short child leaves goes
to its siblings by weight. Because a node counts with all that lies below it, a shortage is
made good among siblings first and reaches the parent's siblings only when a whole subtree is
used up. The level at which the children of a node fill up is found in closed form from their
order of supply to weight, with windows over siblings.

A leaf then reads its documents in seeded epochs, each in its own order, and takes the token
prefix that its budget allows; the last document taken may be cut. Running sums go through
hash stretches of the order, so a leaf with a third of all rows is many small windows.

Defined results: null texts count 0 tokens and are never taken; a null level value is a node
of its own (written as an empty name); nodes without a weight get weight 1, weights of 0 get
nothing while siblings last; repeated rows are documents of their own; rows without an id are
ordered first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, materialise

EPOCHS = 2
SEED = "mix-1"
STRETCHES = 1024
TINY = 1e-9


def token_count(text: Column) -> Column:
    """Words of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")).cast("long")


def leaf(levels: list[str]) -> list[Column]:
    """The names p0.. of a row's nodes."""
    return [F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(f"p{i}") for i, c in enumerate(levels)]


def place(epoch: Column, seed: str = SEED) -> Column:
    """Where a leaf's order of an epoch has a document."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _shares(nodes: DataFrame, level: int) -> DataFrame:
    """Give each node of a level its part of its parent's budget (``have``)."""
    parent = Window.partitionBy(*[f"p{i}" for i in range(level)])
    fill = F.col("supply") / F.greatest(F.col("weight"), F.lit(TINY))  # the level at which the node is used up
    ahead = parent.orderBy("fill", f"p{level}")
    out = nodes.withColumn("fill", fill)
    out = (out.withColumn("_full", F.coalesce(F.sum("supply").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("_rest", F.sum(F.greatest("weight", F.lit(TINY))).over(ahead.rowsBetween(0, Window.unboundedFollowing))))
    # a node is used up if the budget left by those before it reaches its own level for all that are left
    used = F.col("have") - F.col("_full") >= F.col("fill") * F.col("_rest")
    out = out.withColumn("_used", used)
    out = out.withColumn("_level", F.max(F.when(~F.col("_used"), (F.col("have") - F.col("_full")) / F.col("_rest"))).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.when(F.col("_used"), F.col("supply")).otherwise(F.least(F.col("supply"), F.col("_level") * F.greatest("weight", F.lit(TINY))))
    return out.withColumn("budget", share).drop("fill", "_full", "_rest", "_used", "_level")


def budgets(leaves: DataFrame, depth: int, weights: dict[int, dict[str, float]], total: Column) -> DataFrame:
    """p0..p{depth-1}, tokens -> budget of each leaf (whole tokens, rounded down).

    ``weights[level]`` maps a node's name on that level to its weight; ``total`` is the root's
    budget as an expression of ``tokens`` summed over all leaves (column ``all_tokens``).
    """
    names = [f"p{i}" for i in range(depth)]
    tree = leaves.withColumn("supply", F.col("capacity").cast("double"))
    have = tree.agg(F.sum("tokens").alias("all_tokens"), F.sum("supply").alias("_all")).select(F.least(total.cast("double"), F.col("_all")).alias("have"))
    for level in range(depth):
        known = weights.get(level, {})
        weight = F.coalesce(F.create_map(*[x for k, v in sorted(known.items()) for x in (F.lit(k), F.lit(float(v)))])[F.col(f"p{level}")], F.lit(1.0)) if known else F.lit(1.0)
        nodes = tree.groupBy(*names[:level + 1]).agg(F.sum("supply").alias("supply")).withColumn("weight", weight)
        nodes = nodes.crossJoin(have) if level == 0 else nodes.join(have, names[:level])  # the root is one row
        have = materialise(_shares(nodes, level).select(*names[:level + 1], F.col("budget").alias("have")))
    return leaves.join(have, names).withColumn("budget", F.floor(F.col("have") + 1e-6)).drop("have")


def mixed(df: DataFrame, levels: list[str], weights: dict[int, dict[str, float]], total: Column | None = None, doc_id: str = "doc_id", text: str = "text",
          epochs: int = EPOCHS, seed: str = SEED, stretches: int = STRETCHES, more: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """Rows taken: doc_id, levels p0.., epoch, start, n_tokens, take, and ``more`` columns.

    ``levels`` are SQL expressions over the rows. ``start`` is the place in the leaf's stream of tokens; ``take`` (at most n_tokens) is how
    many of the document's first tokens fall under the leaf's budget. A leaf's order is by
    ``place``, then by a hash of the text, which ``tie`` adds as a column.
    """
    depth = len(levels)
    names = [f"p{i}" for i in range(depth)]
    total = F.col("all_tokens") if total is None else total
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), token_count(F.col(text)).alias("n_tokens"), F.xxhash64(text).alias("_tie"),
                     *leaf(levels), *[F.col(c) for c in more])
    rows = materialise(rows.filter("n_tokens > 0"))
    leaves = materialise(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), (F.sum("n_tokens") * epochs).alias("capacity")))
    given = materialise(budgets(leaves, depth, weights, total))
    # an epoch that a leaf's budget cannot reach is never dealt
    dealt = rows.join(given.select(*names, "tokens", "budget"), names).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).filter(F.col("epoch") * F.col("tokens") < F.col("budget"))
    dealt = dealt.withColumn("place", place(F.col("epoch"), seed)).withColumn("stretch", F.floor(F.conv(F.substring("place", 1, 6), 16, 10).cast("long") * stretches / (1 << 24)).cast("int"))
    key = [*names, "epoch"]
    held = dealt.groupBy(*key, "stretch").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # at most ``stretches`` rows
    held = held.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*key, "stretch").orderBy("place", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(held, [*key, "stretch"]).filter(F.col("epoch") * F.col("tokens") + F.col("_base") < F.col("budget"))
    start = F.col("epoch") * F.col("tokens") + F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    out = placed.withColumn("start", start).filter(F.col("start") < F.col("budget"))
    return out.select("doc_id", *names, "epoch", "start", "n_tokens", F.least(F.col("n_tokens"), F.col("budget") - F.col("start")).alias("take"), *more, *([F.col("_tie").alias(tie)] if tie else []))


#: Production tree over documents: four domains of sources, languages, sources.
LEVELS = ["concat('d', pmod(cast(regexp_extract(source, '([0-9]+)$', 1) as int), 4))", "lang", "source"]
WEIGHTS = {0: {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, 1: {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
