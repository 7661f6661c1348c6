"""Operator 10: mixing sources to target weights (DataFrame functions only).

Leaves of a tree (domain, language, source) get token budgets from the top down: the children of a node share its budget by
weight, a child takes no more than the tokens below it (times ``max_epochs``), and what it can't take goes to its
siblings by weight before anything is left for the level above: since a child's capacity is that of all its leaves, a
shortage leaves a subtree only when the whole subtree is used up. Sharing is water-filling in closed form: children sorted
by capacity/weight, running sums, and integer shares.

A leaf's budget is filled by seeded epochs: each epoch shuffles the leaf by md5(seed, epoch, id, text); whole epochs are
repeated, and the last one gives the longest prefix of rows whose tokens fit. The end of that prefix is found on narrow rows
and in two steps, so that no task sorts a whole leaf: tokens by (leaf, first three hex digits of the shuffle key), running
sums over these few buckets, and an order only of the distinct keys inside the bucket where the budget ends. What comes out is one
shuffle key for each leaf, to which the rows compare themselves: the texts are never sorted. Where the budget ends among rows of
one key (equal rows, maybe a third of all), these are counted, and as many copies are given as fit.

Defined results: null levels form a branch of their own, named by the empty string; a null or empty text has no tokens and is
taken with every epoch that reaches it; repeated rows are rows of their own; weights that aren't given are the default weight;
a weight of 0 gives nothing; rows that tie in the shuffle key have equal ids and texts, and of these as many as fit are taken, by the
order of their other columns; an empty table, or a budget of 0, gives no rows. All columns of the input stay; ``epoch`` and
``n_tokens`` come beside them in a struct named ``mix``, which takes the place of an input column of that name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Default weight, in thousandths.
UNIT = 1000


def tokens(text_col: str = "text") -> Column:
    """The number of words of the whole text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(level: Column, weights: Mapping[str, int], default: int = UNIT) -> Column:
    """The weight, in thousandths, of a child by its name."""
    out = F.lit(default)
    for name, w in sorted(weights.items()):
        out = F.when(level == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def fill(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds ``budget`` to rows (parents, child, cap, weight, total): integer shares of ``total`` by weight, none above its
    ``cap``. Children are visited by cap/weight: as long as the next one can't take its share of what is left, it is
    filled; all after it get the same tokens per weight."""
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parents).orderBy(ratio, child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = children.withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_weight", F.sum("weight").over(after))
    short = (F.col("weight") > 0) & (F.col("cap").cast("decimal(38,0)") * F.col("_weight") <= F.col("weight").cast("decimal(38,0)") * (F.col("total") - F.col("_used")))
    df = df.withColumn("_full", short)
    # the first child that isn't filled fixes the tokens per weight for the rest
    first = F.min_by(F.struct("_used", "_weight"), F.struct(ratio, F.col(child))).over(Window.partitionBy(*parents, "_full"))
    df = df.withColumn("_rest", first)
    rest = F.greatest(F.col("total") - F.col("_rest._used"), F.lit(0)).cast("decimal(38,0)")
    df = df.withColumn("_left", rest)
    share = F.expr("if(_rest._weight > 0, (weight * _left) div _rest._weight, 0L)")
    budget = F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), share))
    return df.withColumn("budget", budget).drop("_used", "_weight", "_full", "_rest", "_left")


def leaf_budgets(leaves: DataFrame, levels: list[str], percent: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """(levels, supply, budget) from leaves (levels, supply); the tree's budget is so many ``percent`` of its supply."""
    caps = leaves.withColumn("cap", F.col("supply") * max_epochs)
    known = None
    for depth in range(1, len(levels) + 1):
        at, child = levels[:depth], levels[depth - 1]
        nodes = caps.groupBy(*at).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", weight_of(F.col(child), weights.get(child, {})))
        if known is None:  # the children of the root are few
            whole = F.sum("supply").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("total", F.lit(percent).cast("long") * whole).withColumn("total", F.expr("total div 100"))
        else:
            nodes = nodes.join(known, at[:-1])
        filled = fill(nodes, at[:-1] or [F.lit(0)], child)
        known = filled.select(*at, F.col("budget").alias("total"))
    return filled.select(*levels, "supply", "budget")


def shuffle_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("key")))


def plan(narrow: DataFrame, names: list[str], percent: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int, seed: int) -> DataFrame:
    """(levels, whole, last, cut, copies) for each leaf with a budget, from rows (levels, n, key): the epochs taken whole, the last
    shuffle key that the next epoch takes whole (null: none), and the key of which it takes some ``copies``."""
    leaves = narrow.groupBy(*names).agg(F.sum("n").alias("supply"))
    budgets = leaf_budgets(leaves, names, percent, weights, max_epochs).where("budget > 0")
    budgets = budgets.select(*names, F.expr("budget div supply").alias("whole"), F.expr("budget % supply").alias("rest"))
    rows = narrow.join(budgets, names).withColumn("order", shuffle_key(seed)).withColumn("bucket", F.substring("order", 1, 3))
    sums = rows.groupBy(*names, "bucket").agg(F.sum("n").alias("bn"), F.max("order").alias("top"), F.first("rest").alias("rest"), F.first("whole").alias("whole"))
    running = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bn").over(running), F.lit(0)))
    fits = F.col("before") + F.col("bn") <= F.col("rest")
    whole_buckets = sums.groupBy(*names).agg(F.first("whole").alias("whole"), F.max(F.when(fits, F.col("top"))).alias("last"))
    # the bucket where the budget ends is put in order, a key at a time; one bucket for each leaf
    edge = sums.where(~fits & (F.col("before") <= F.col("rest"))).select(*names, "bucket", "before")
    keys = rows.join(edge, [*names, "bucket"]).groupBy(*names, "order").agg(F.sum("n").alias("kn"), *(F.first(c).alias(c) for c in ("n", "rest", "before")))
    keys = keys.withColumn("upto", F.col("before") + F.sum("kn").over(Window.partitionBy(*names).orderBy("order")))
    over = F.col("upto") > F.col("rest")
    inside = keys.groupBy(*names).agg(F.max(F.when(~over, F.col("order"))).alias("inside"),
                                      F.min(F.when(over, F.struct("order", F.expr("(rest - upto + kn) div n").alias("copies")))).alias("cut"))
    found = whole_buckets.join(inside, names, "left")
    return found.select(*names, "whole", F.greatest("last", "inside").alias("last"), F.col("cut.order").alias("cut"), F.coalesce("cut.copies", F.lit(0)).alias("copies"))


def mix(docs: DataFrame, levels: Mapping[str, Column], percent: int = 60, weights: Mapping[str, Mapping[str, int]] | None = None,
        max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns (a row once for every epoch that takes it) and the struct
    ``mix`` (epoch, n_tokens and the levels). ``levels``: name -> column, from the top; ``percent``: the budget as a share of
    all tokens; ``weights``: level -> name -> thousandths. Plans of up to ``broadcast_rows`` leaves are broadcast, larger
    ones are joined by a shuffle."""
    names = list(levels)
    rows = docs.select(
        F.struct("*").alias("row"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()),
        tokens(text_col).alias("n"), F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("key"))
    narrow = materialize(rows.select(*names, "n", "key"), "mixing")
    leaves = materialize(plan(narrow, names, percent, weights or {}, max_epochs, seed), "mixing-plan")
    if leaves.count() <= broadcast_rows:
        leaves = F.broadcast(leaves)
    order = shuffle_key(seed)
    rows = rows.join(leaves, names)
    chosen = rows.withColumn("epochs", F.col("whole") + F.when(order <= F.col("last"), 1).otherwise(0)).where("epochs > 0")
    chosen = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs")))).select("row", "epoch", "n", *names)
    # equal rows where the budget ends: counted, and given out until the copies are used up
    equal = rows.where((F.col("copies") > 0) & (order == F.col("cut"))).groupBy("row", *names, "n", "whole", "copies").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*names).orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    some = equal.withColumn("some", F.least("c", F.greatest(F.col("copies") - F.coalesce(F.sum("c").over(before), F.lit(0)), F.lit(0)))).where("some > 0")
    some = some.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("some")))).select("row", (F.col("whole") + 1).alias("epoch"), "n", *names)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "mix"]
    return chosen.unionByName(some).select(*kept, F.struct("epoch", F.col("n").alias("n_tokens"), *names).alias("mix"))
