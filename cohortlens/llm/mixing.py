"""Mixing sources to target weights over a tree of groups.

The levels of the tree are columns, such as domain, language and source. A node's
budget is split among its children by weight. A child that cannot use its share,
even with every document repeated ``max_epochs`` times, takes what it can, and
its siblings share the rest by their weights; only what a whole family cannot use
goes back to the ancestor's other children. Each leaf spends its budget on whole
epochs, then on a prefix of one more epoch in a seeded order.

DataFrame functions only. The tree has one row for each leaf. Documents are summed
by buckets of the seeded order before any window, so a hot leaf is dealt over
thousands of small windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import stored, words_of

NULL = "∅"  # stands for a null in the names of nodes


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    known = weights.get(level, {})
    if not known:
        return F.lit(1).cast("long")
    pairs = [F.lit(x) for item in known.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(1)).cast("long")


def _fill(children: DataFrame, parents: Sequence[str], level: str) -> DataFrame:
    """``children`` (parents, level, cap, weight, given) with ``budget``: ``given`` split by weight, up to cap.

    In the order of cap over weight, those that cannot use their share come first.
    Shares are rounded down.
    """
    family = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = family.orderBy(F.col("cap") / F.col("weight"), level)
    before, after = W.unboundedPreceding, W.unboundedFollowing
    wide = lambda c: c.cast("decimal(19,0)")
    rows = children.withColumn(
        "left", F.col("given") - F.coalesce(F.sum("cap").over(order.rowsBetween(before, -1)), F.lit(0))
    ).withColumn("rest", F.sum("weight").over(order.rowsBetween(0, after)))
    rows = rows.withColumn(
        "full", wide(F.col("cap")) * wide(F.col("rest")) <= wide(F.col("left")) * wide(F.col("weight"))
    )
    rows = rows.withColumn(
        "used", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    ).withColumn(
        "open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(family), F.lit(1))
    )
    share = F.expr(
        "(cast(given - used AS decimal(19,0)) * cast(weight AS decimal(19,0))) div cast(open AS decimal(19,0))"
    )
    budget = F.when(F.col("full"), F.col("cap")).otherwise(F.least(share, F.col("cap")))
    return rows.select(*parents, level, "cap", budget.cast("long").alias("budget"))


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    budget: int,
    weights: Mapping[str, Mapping[str, int]],
    max_epochs: int,
) -> DataFrame:
    """``leaves`` (levels, tokens) with the budget of each.

    A weight that is not stated is 1; weights are positive integers.
    """
    caps = leaves.select(*levels, (F.col("tokens") * max_epochs).alias("cap"))
    given = None
    for depth, level in enumerate(levels):
        parents = list(levels[:depth])
        children = caps.groupBy(*parents, level).agg(F.sum("cap").alias("cap"))
        children = children.withColumn("weight", _weight(level, weights))
        if given is None:
            children = children.withColumn("given", F.lit(budget).cast("long"))
        else:
            children = children.join(given, parents)
        filled = _fill(children, parents, level)
        given = filled.select(*parents, level, F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), list(levels))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    weights: Mapping[str, Mapping[str, int]] | None = None,
    budget_percent: int = 90,
    max_epochs: int = 2,
    seed: str = "0",
    buckets: int = 4096,
) -> DataFrame:
    """(doc_id, the levels, n_tokens, copies) of every row of ``docs``.

    ``levels`` name the tree's columns from the root down; a null is a group of its
    own, named by :data:`NULL`. Tokens are words, and the budget is ``budget_percent``
    of all of them. ``copies`` is how often a document is taken: once for each whole
    epoch of its leaf, and once more if it lies in the prefix of the last one, whose
    tokens never exceed the budget. The order is by the MD5 of seed, epoch and id,
    then by id; rows that repeat an id have no fixed order among them, and a null id
    counts as an empty one. A null text has no tokens; a leaf without tokens takes
    nothing, and its documents have no copies. An empty table gives an empty one.
    """
    names = list(levels)
    rows = stored(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            *[F.coalesce(c.cast("string"), F.lit(NULL)).alias(n) for n, c in levels.items()],
            F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("n_tokens"),
        ),
        "tokens",
    )
    leaves = stored(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, names, total * budget_percent // 100, weights or {}, max_epochs)
    # Written, so that the join can split a hot leaf's documents.
    budgets = stored(
        budgets.select(
            *names,
            F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).alias("epochs"),
            F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(-1)).alias("rest"),
        ),
        "budgets",
    )
    key = F.md5(
        F.concat_ws(":", F.lit(seed), F.col("epochs") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )
    # Few columns and no text: this table is sorted and joined below.
    keyed = rows.join(budgets, names).withColumn("key", key)
    # Buckets follow the order of the keys.
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")
    keyed = stored(keyed.withColumn("bucket", bucket), "keyed")
    sums = keyed.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = W.partitionBy(*names).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(
        sums.select(*names, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")),
        "starts",
    )
    within = W.partitionBy(*names, "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n_tokens").over(within)
    return keyed.join(starts, [*names, "bucket"]).select(
        "doc_id",
        *names,
        "n_tokens",
        (F.col("epochs") + F.when(upto <= F.col("rest"), 1).otherwise(0)).cast("int").alias("copies"),
    )


def take_copies(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as ``mixed`` says; an id decides for all rows that have it."""
    taken = mixed.filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    taken = taken.withColumnRenamed("doc_id", "_id")
    rows = docs.join(taken, F.col(f"`{doc_id}`").eqNullSafe(F.col("_id"))).drop("_id")
    return rows.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")
