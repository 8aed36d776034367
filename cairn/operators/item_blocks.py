"""Blocks of similar items by bisecting k-means on the items' rating vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut, forget

#: Rounds after which a split is taken as it is; most settle in fewer.
ROUNDS = 20


def entries(train: DataFrame) -> DataFrame:
    """The non-zero entries of the items' vectors as rows ``item_id, user_id, rating``.

    Users are vector positions; an item's vector is never put together in one row.
    """
    return train.select("item_id", "user_id", F.col("rating").cast("double").alias("rating"))


def _two_means(cells: DataFrame, seed: int, rounds: int) -> DataFrame:
    """Split every node of ``cells`` (``node, item_id, user_id, rating``) in two: ``item_id, node, side``.

    Centres start as the node's mean, each entry moved a little to either side.
    """
    items = cut(cells.select("node", "item_id").distinct())
    sizes = items.groupBy("node").agg(F.count("*").alias("items"))
    mean = cells.groupBy("node", "user_id").agg(F.sum("rating").alias("total")).join(sizes, "node").withColumn(
        "value", F.col("total") / F.col("items"))
    nudge = F.pmod(F.col("user_id").cast("long") * 7919 + seed * 104729, F.lit(1000)) / 1000 * 1e-2
    centres = mean.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "node", "side", "user_id", (F.col("value") * F.when(F.col("side") == 0, 1 - nudge).otherwise(1 + nudge)).alias("value"))
    sides = last = None
    for _ in range(rounds):
        centres = cut(centres)
        lengths = centres.groupBy("node", "side").agg(F.sum(F.col("value") * F.col("value")).alias("length"))
        dots = cells.join(centres, ["node", "user_id"]).groupBy("node", "item_id", "side").agg(
            F.sum(F.col("rating") * F.col("value")).alias("dot"))
        costs = items.join(lengths, "node").join(dots, ["node", "item_id", "side"], "left").withColumn(
            "cost", F.col("length") - 2 * F.coalesce("dot", F.lit(0.0)))
        now = costs.groupBy("node", "item_id").agg(F.min(F.struct("cost", "side")).alias("best")).select(
            "node", "item_id", F.col("best.side").alias("side"))
        if sides is None:
            now = cut(now.withColumn("moved", F.lit(True)))
        else:
            before = sides.select("node", "item_id", F.col("side").alias("before"))
            now = cut(now.join(before, ["node", "item_id"]).withColumn("moved", F.col("side") != F.col("before")).drop("before"))
        sides = now.select("node", "item_id", "side")
        forget(centres, last)
        last = now
        if now.filter("moved").isEmpty():
            break
        parts = now.groupBy("node", "side").agg(F.count("*").alias("items"))
        centres = cells.join(now, ["node", "item_id"]).groupBy("node", "side", "user_id").agg(
            F.sum("rating").alias("total")).join(parts, ["node", "side"]).select(
            "node", "side", "user_id", (F.col("total") / F.col("items")).alias("value"))
    return sides


def item_blocks(train: DataFrame, k: int = 50, min_divisible: float | None = None, seed: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """``item_id, cluster_id``: items in at most k blocks, by bisecting k-means.

    A block may split while it has ``min_divisible`` items (a share of all items
    below 1, 1/k by default); the largest split first.  ``rounds`` bounds the passes of
    one split.  Centres and items stay ratings in long form at every size: distances are joins on
    (node, user) added up per item, so neither an item rated by everyone nor
    a centre with every user has to fit into one row.
    """
    least = 1 / k if min_divisible is None else min_divisible
    r = entries(train)
    nodes = cut(r.select("item_id").distinct().withColumn("node", F.lit(1).cast("long")))
    enough = max(1.0, least if least >= 1 else least * nodes.count())
    stuck: set[int] = set()
    while True:
        sizes = {x.node: x.n for x in nodes.groupBy("node").agg(F.count("*").alias("n")).collect()}  # at most k rows
        open_ = sorted((n for n, c in sizes.items() if c >= enough and c > 1 and n not in stuck), key=lambda n: (-sizes[n], n))
        chosen = open_[: k - len(sizes)]
        if not chosen:
            break
        cells = cut(r.join(nodes.filter(F.col("node").isin(chosen)), "item_id"))
        split = _two_means(cells, seed, rounds)
        moved = nodes.join(split.select("item_id", "side"), "item_id", "left")
        first = max(sizes) + 1
        base = {n: first + 2 * i for i, n in enumerate(chosen)}
        child = _lookup(base)[F.col("node")] + F.col("side")
        old, nodes = nodes, cut(moved.select("item_id", F.coalesce(child, F.col("node")).alias("node")))
        whole = split.groupBy("node").agg(F.countDistinct("side").alias("sides")).filter(F.col("sides") == 1)
        stuck |= {c for x in whole.collect() for c in (base[x.node], base[x.node] + 1)}
        forget(old, cells)
    numbers = _lookup({n: i for i, n in enumerate(sorted(sizes))})
    return nodes.select("item_id", numbers[F.col("node")].cast("int").alias("cluster_id"))


def _lookup(values: dict[int, int]):
    return F.create_map(*[F.lit(v).cast("long") for pair in values.items() for v in pair])
