"""Mix sources to target weights over a tree, for example domain, language, source.

A budget of tokens goes down the tree. At each node it is shared by the children's weights; what a child cannot use, since its whole subtree
has fewer tokens (times the epochs allowed), goes to its siblings by their weights, and only what no sibling can use
stays with the parent's siblings. Each leaf then gives its documents in the order of a seeded hash: whole epochs, and of the last
epoch the prefix that reaches the budget.

The prefix of a leaf of any size is found in two steps: token sums by slots, the first digits of the hash, then the order
inside each slot, which begins where the slots before it end. Only ids, tokens and paths are shuffled.

Defined results: a null or empty path part is ``(none)``; a null text has no tokens; rows that repeat an id in a leaf
are weighed together and stay together; a node without a weight has the default weight, one with a weight of 0 or less gets no tokens;
ties of the hash are broken by the id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

NONE = "(none)"
SLOT_DIGITS = 3


def words_of(text: Column) -> Column:
    """Tokens of a text as its runs of non-white-space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"\S+"))).cast("long")


def budgets(leaves: DataFrame, weights: DataFrame, path: Sequence[str], total: float, default: float = 1.0) -> DataFrame:
    """leaves: path and tokens the leaf can give. weights: path, depth (how many parts of it name the node), weight.
    Gives path, tokens, budget (double)."""
    for depth in range(1, len(path) + 1):  # what lies below a weight of 0 can give nothing
        node = list(path[:depth])
        barred = weights.filter((F.col("depth") == depth) & (F.col("weight") <= 0)).select(*node, F.lit(True).alias("barred"))
        leaves = leaves.join(barred, node, "left").withColumn("tokens", F.when(F.col("barred"), F.lit(0)).otherwise(F.col("tokens"))).drop("barred")
    level = stored(leaves.withColumn("budget", F.lit(float(total))), "budgets")
    for depth in range(1, len(path) + 1):
        above, node = list(path[: depth - 1]), list(path[:depth])
        named = weights.filter(F.col("depth") == depth).select(*[F.col(c) for c in node], F.col("weight"))
        children = level.groupBy(*node).agg(F.sum("tokens").alias("cap"), F.first("budget").alias("budget"))
        children = children.join(named, node, "left")
        children = children.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(float(default))), F.lit(0.0)))
        # children are filled in the order in which they run out; level is what each unit of weight gets then
        ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
        children = children.withColumn("ratio", ratio)
        order = W.partitionBy(*above).orderBy("ratio", *node)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
        children = children.withColumn("level", F.when(rest > 0, F.greatest(F.col("budget") - before, F.lit(0.0)) / rest).otherwise(F.lit(0.0)))
        open_level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(W.partitionBy(*above))
        share = F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * open_level)
        children = children.select(*node, share.alias("budget"))
        level = stored(level.drop("budget").join(children, node), "budgets")
    return level


def mix(
    docs: DataFrame,
    weights: DataFrame,
    path: Sequence[str],
    total: float | None = None,
    share: float = 0.5,
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    default: float = 1.0,
) -> DataFrame:
    """The documents of the mixture: id, path, tokens, copies (epochs that hold the document). ``total`` tokens are asked for, or
    ``share`` of all tokens; path are columns of docs; tokens is an expression over docs."""
    tokens = words_of(docs["text"]) if tokens is None else tokens
    parts = [F.coalesce(F.nullif(docs[c].cast("string"), F.lit("")), F.lit(NONE)).alias(c) for c in path]
    rows = docs.select(docs[id_col].alias("id"), *parts, tokens.alias("tokens"))
    rows = stored(rows.groupBy("id", *path).agg(F.sum("tokens").alias("tokens")), "weighed")
    if total is None:
        total = float(rows.agg(F.sum("tokens")).first()[0] or 0) * share
    leaves = rows.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("tokens"))
    plan = budgets(leaves, weights, path, total, default)
    have = F.col("tokens") / max_epochs
    plan = plan.select(*path, F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"), have.cast("long").alias("have"))
    whole = F.when(F.col("have") > 0, F.expr("budget div have")).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("have"))

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = rows.join(plan, list(path)).withColumn("key", key).withColumn("slot", F.substring("key", 1, SLOT_DIGITS))
    keyed = stored(keyed, "keyed")
    slots = keyed.groupBy(*path, "slot").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy(*path).orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    # rows and sums meet by leaf and slot, so the join and the order below share one shuffle and no leaf lies in one task
    placed = keyed.join(slots.withColumn("before", before).drop("n"), [*path, "slot"])
    order = W.partitionBy(*path, "slot").orderBy("key", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.sum("tokens").over(order) - F.col("tokens") + F.col("before")
    out = placed.withColumn("first", first).withColumn("copies", F.col("whole") + (F.col("first") < F.col("rest")).cast("long"))
    return out.filter("copies > 0").select(F.col("id").alias(id_col), *path, "tokens", "copies")
