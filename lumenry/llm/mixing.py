"""Operator 5: mixing sources to target weights by hierarchical budgets.

A tree of groups (say domain, language, source) splits a token budget by weight, level by
level. A leaf can give at most its tokens times the epochs allowed. What a node can't
give is redistributed among its siblings by weight first; only what all of them can't
give goes up, to its ancestors' siblings. Each leaf then takes its documents in seeded
epochs, each of an order of its own: whole epochs as far as the budget goes, and of the
next one the prefix that fills it, whose last document is cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

PART_ROWS = 20_000  # a leaf that held all rows would be ordered in parts of about so many
LEAST_PARTS = 64
TOKENS = r"[^\x20\x09-\x0D]+"


def _shares(nodes: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Splits the budget of each parent among its children, at most ``room`` to each.

    nodes: path (array), weight, room. parents: path, budget. Filling in order of room to
    weight gives each child its share of what the fuller ones leave: the only fixed point
    of redistributing shortages among siblings.
    """
    up = F.slice("path", 1, F.size("path") - 1)
    held = nodes.withColumn("up", up).join(parents.select(F.col("path").alias("up"), "budget"), "up")
    # children that are filled come first: those of the least room to weight
    ratio = F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(0.0)
    order = Window.partitionBy("up").orderBy(ratio, "path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("up")
    held = (
        held.withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("weight_left") > 0, (F.col("budget") - F.col("room_before")) / F.col("weight_left")))
        .withColumn("filled", F.col("room") <= F.col("level") * F.col("weight"))
    )
    # the first child that isn't filled sets the level of those after it
    at = F.min(F.when(~F.col("filled"), F.struct(ratio.alias("r"), "path", "level"))).over(every)
    return held.withColumn("own", at["level"]).select(
        "path", F.greatest(F.lit(0.0), F.least("room", F.when(F.col("own").isNull(), F.col("room")).otherwise(F.col("own") * F.col("weight")))).alias("budget")
    )


def budgets(leaves: DataFrame, total: float, weights: Mapping[tuple[str, ...], float], epochs: int) -> DataFrame:
    """(path, tokens, budget) of each leaf. leaves: path (array<string>), tokens.

    ``weights`` gives the weight of a node by its path, 1 where it has none; nodes of
    weight 0 get nothing. Room is added up to each ancestor, so a subtree that can't use
    its share leaves it to its siblings at the lowest level where one can.
    """
    spark = leaves.sparkSession
    depth = leaves.select(F.max(F.size("path"))).first()[0] or 0
    given = [(list(k), float(v)) for k, v in weights.items()] or [(["\0"], 1.0)]
    table = spark.createDataFrame(given, "path array<string>, given double")
    levels = {depth: leaves.select("path", (F.col("tokens") * float(epochs)).alias("room"))}

    def weighted(df: DataFrame) -> DataFrame:
        out = df.join(F.broadcast(table), "path", "left").select("path", "room", F.coalesce("given", F.lit(1.0)).alias("weight"))
        return out.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(0.0))

    for k in range(depth, 0, -1):  # the room of a node is what its children can give
        levels[k] = weighted(levels[k])
        levels[k - 1] = levels[k].groupBy(F.slice("path", 1, k - 1).alias("path")).agg(F.sum("room").alias("room"))
    now = levels[0].select("path", F.least(F.col("room"), F.lit(float(total))).alias("budget")) if depth else leaves.select("path", F.lit(0.0).alias("budget"))
    for k in range(1, depth + 1):
        now = _shares(levels[k], now)
    return leaves.join(now, "path").select("path", "tokens", "budget")


def mix_sources(
    docs: DataFrame,
    levels: Sequence[str],
    share: float = 0.5,
    weights: Mapping[tuple[str, ...], float] | None = None,
    epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Which documents a mixture takes, how often, and how much of the last one of each leaf.

    ``levels`` are SQL expressions over ``docs`` that give the tree's levels, root first;
    nulls are the group "". The budget is ``share`` of all tokens (words). Returns doc_id,
    path, epoch (from 0), n_tokens of the document and n_taken, one row for each epoch in
    which a row of ``docs`` is taken (n_taken > 0); with ``carry``, also those columns of
    the row, as the struct ``row``.

    Null and empty texts have no tokens and are never taken. Repeated rows are taken as
    rows of their own, in an order that the seed, id and text give; ties of all three are
    alike. Leaves of weight 0 give nothing; an empty table gives an empty result. Columns
    of ``docs`` that no level names are not read. A leaf that holds a third of all rows is
    ordered by hashed parts, so no task reads it whole.
    """
    path = F.array(*[F.coalesce(F.expr(x).cast("string"), F.lit("")) for x in levels])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rank = F.xxhash64(F.lit(seed), F.col(id_col), text)
    light = [F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.regexp_count(text, F.lit(TOKENS)).cast("long").alias("n_tokens"), rank.alias("rank")]
    rows = B.written(docs.select(*light))
    n_parts = max(LEAST_PARTS, rows.count() // PART_ROWS)
    rows = rows.filter("n_tokens > 0")
    leaves = B.written(rows.groupBy("path").agg(F.sum("n_tokens").alias("tokens")))
    total = share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    budget = F.floor("budget").cast("long")
    given = B.written(
        budgets(leaves, total, weights or {}, epochs)
        .select("path", F.floor(budget / F.col("tokens")).cast("int").alias("whole"), (budget - F.floor(budget / F.col("tokens")) * F.col("tokens")).cast("long").alias("rest"))
    )

    def in_order(df: DataFrame) -> DataFrame:
        """Rows in the order of the epoch that their leaf doesn't take whole: a hash of the rank and the epoch."""
        order = F.xxhash64("rank", "whole")
        return df.join(given, "path").withColumn("order", order).withColumn("part", F.floor((order.cast("double") / 2.0**64 + 0.5) * n_parts))

    by_part = in_order(rows).groupBy("path", "part").agg(F.sum("n_tokens").alias("tokens"))
    before_part = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = B.written(by_part.withColumn("earlier", F.coalesce(F.sum("tokens").over(before_part), F.lit(0))).select("path", "part", "earlier"))
    held = docs.select(*light, F.struct(*carry).alias("row")).filter("n_tokens > 0") if carry else rows
    inside = Window.partitionBy("path", "part").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = in_order(held).withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, ["path", "part"])
    left = F.greatest(F.lit(0), F.least("n_tokens", F.col("rest") - F.col("earlier") - F.col("within")))
    taken = placed.withColumn("left", left).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    taken = taken.withColumn("n_taken", F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens")).otherwise(F.col("left"))).filter("n_taken > 0")
    return taken.select("doc_id", "path", "epoch", "n_tokens", "n_taken", *(["row"] if carry else []))


def cut(text, n_tokens, n_taken):
    """``text``, or its first ``n_taken`` tokens joined by a space where that is less than ``n_tokens``."""
    return F.when(n_taken < n_tokens, F.array_join(F.slice(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), 1, n_taken.cast("int")), " ")).otherwise(text)
