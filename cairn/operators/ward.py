"""Agglomerative clustering with Ward's linkage, exact, as rounds of Spark jobs.

Two clusters that are each other's cheapest partner can be merged at once,
anywhere in the data: Ward's cost is reducible, so the merges found this way are
those of the one-by-one method (Bruynooghe 1977, Murtagh 1983).  One merge history
serves every number of clusters.

A table keeps each cluster's cheapest partner.  As the cost is reducible, a merge makes no cluster cheaper for others than
its parts were, so after a round only the merged clusters and those whose partner was merged search again,
and a search that finds a cluster cheaper than that one's own partner tells it so.  Once the clusters alive fit one
tile, a fixed number of rows however large the seed was, the last merges are made
in one go.

Clusters of up to ``HELD_BYTES`` are kept on the driver, as states are in `assign`: a round is then one job, in which
every task gets all clusters and searches for some of those that ask, and nothing is shuffled or written.  More
take rounds over tables until they are few enough.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cairn.functions.kernels import all_merges, cheapest_of, cheapest_partner, matrix
from cairn.operators.balls import LEAF, PIVOTS, SLACK, cover, grown, leaf, tile_pairs
from cairn.operators.checks import require_numbers
from cairn.operators.graph import components
from cairn.session import cut, forget

#: A tile holds up to this share of the clusters alive, the last one a quarter of those at first or what they exceed ``TILE`` by; ``TILE`` rows at most.
PARTS, TILE = 8, 1 << 10
#: Up to so many clusters alive all tiles meet, in one job: the levels of a cover would take more jobs than bounds save work.
DIRECT = PARTS * TILE
#: Clusters alive that the driver keeps, by their vectors' bytes and by number; so many pairs are compared without a job.
HELD_BYTES, HELD_ROWS, AT_ONCE = 100_000_000, 1 << 18, 1 << 22


def _cost(n: Column, m: Column, d: Column) -> Column:
    return n.cast("double") * m / (n + m) * d * d


def _may_be_cheapest(pairs: DataFrame) -> DataFrame:
    """Keep pairs that could hold the cheapest partner of an asking cluster of either ball."""
    apart = F.greatest(F.col("gap") - F.col("r_a") - F.col("r_b"), F.lit(0.0))
    low = _cost(F.col("w_min_a"), F.col("w_min_b"), apart)
    high = _cost(F.col("w_max_a"), F.col("w_max_b"), F.col("gap") + F.col("r_a") + F.col("r_b"))
    partner = (F.col("a") != F.col("b")) | (F.col("n_a") > 1)  # alone in its ball: no partner there
    priced = pairs.withColumns({"low": low * (1 - SLACK), "high": F.when(partner, high * (1 + SLACK))})
    ceilings = (
        priced.select("grp", F.col("a").alias("ball"), "high")
        .unionByName(priced.select("grp", F.col("b").alias("ball"), "high"))
        .groupBy("grp", "ball").agg(F.min("high").alias("top"))
    )
    top_a = ceilings.select("grp", F.col("ball").alias("a"), F.col("top").alias("top_a"))
    top_b = ceilings.select("grp", F.col("ball").alias("b"), F.col("top").alias("top_b"))
    asks_a, asks_b = (F.get(f"hi_{s}", F.lit(0)) > 0 for s in "ab")
    useful = (asks_a & (F.col("low") <= F.col("top_a"))) | (asks_b & (F.col("low") <= F.col("top_b")))
    return priced.join(top_a, ["grp", "a"]).join(top_b, ["grp", "b"]).filter(
        useful | (asks_a & (F.col("a") == F.col("b"))))


def _covered(live: DataFrame, leaf_rows: int) -> DataFrame:
    """Pairs of tiles that may hold the cheapest partner of an asking cluster."""
    asks = F.array_repeat(F.col("asks").cast("double"), PIVOTS)  # a ball's limits say if any of its clusters asks
    pts = live.select(F.lit(0).alias("grp"), "id", F.col("centroid").alias("x"), F.col("n").alias("w"), asks.alias("t"))
    return tile_pairs(cover(pts, leaf(leaf_rows), _may_be_cheapest))


def _dealt(live: DataFrame, tiles: int) -> DataFrame:
    """Every pair of tiles with an asking cluster, clusters dealt over the tiles by hash."""
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("tile")
    packed = cut(live.groupBy(tile).agg(
        F.sort_array(F.collect_list(F.struct("id", F.col("centroid").alias("x"), F.col("n").alias("w")))).alias("p"), F.max("asks").alias("asks")))

    def side(s: str) -> DataFrame:
        return packed.select(F.col("tile").alias(s), F.col("p.id").alias(f"ids_{s}"), F.col("p.x").alias(f"xs_{s}"), F.col("p.w").alias(f"ws_{s}"), F.col("asks").alias(f"asks_{s}"))

    met = live.sparkSession.range(tiles).withColumnRenamed("id", "a").withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(tiles - 1).cast("long"))))
    return met.repartition(tiles, "a", "b").join(side("a"), "a").join(side("b"), "b").filter("asks_a OR asks_b")


def _best_partners(live: DataFrame, leaf_rows: int, alive: int) -> DataFrame:
    """Cheapest merge ``(cost, lo, hi)``, among all live clusters, of every one that ``asks``."""
    pairs = _dealt(live, -(-alive // leaf_rows)) if alive <= DIRECT and alive <= 2 * PARTS * leaf_rows else _covered(live, leaf_rows)
    offers = pairs.select(
        "ids_a", "ids_b",
        F.explode(cheapest_partner("xs_a", "ws_a", "xs_b", "ws_b", F.col("a") == F.col("b"))).alias("o"))
    mine = F.when(F.col("o.side") == 0, F.get("ids_a", "o.i")).otherwise(F.get("ids_b", "o.i"))
    other = F.when(F.col("o.side") == 0, F.get("ids_b", "o.j")).otherwise(F.get("ids_a", "o.j"))
    merge = F.struct(F.col("o.cost").alias("cost"), F.least(mine, other).alias("lo"), F.greatest(mine, other).alias("hi"))
    offers = offers.select(mine.alias("id"), merge.alias("best")).join(live.filter("asks").select("id"), "id", "left_semi")
    return offers.groupBy("id").agg(F.min("best").alias("best"))


def _ends(merges: DataFrame) -> DataFrame:
    return merges.select(F.col("lo").alias("end")).unionByName(merges.select(F.col("hi").alias("end")))


def _weighted_mean(live: DataFrame) -> DataFrame:
    """Merge states of equal id: sizes add up, centroids average by size."""
    cells = live.select("id", "n", F.posexplode("centroid").alias("dim", "c")).groupBy("id", "dim").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("c"))
    return cells.groupBy("id").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "c")))["c"].alias("centroid"))


def history(points: DataFrame, leaf_rows: int = LEAF, log: list[tuple[int, int]] | None = None) -> DataFrame:
    """All merges ``(cost, lo, hi)``; a cluster goes by the smallest point id in it.

    Features that are null or no finite numbers raise.  ``log`` gets, for each round, how many clusters
    searched and how many were alive.
    """
    require_numbers(points)
    same = points.groupBy("features").agg(F.min("point_id").alias("id"), F.count("*").alias("n"))
    live, table = cut(same.select("id", "n", F.col("features").alias("centroid"), F.lit(True).alias("asks"))), None
    copies = points.join(same.select("features", "id"), "features").filter(F.col("point_id") != F.col("id"))
    merges = [copies.select(F.lit(0.0).alias("cost"), F.col("id").alias("lo"), F.col("point_id").alias("hi"))]
    alive = live.count()
    last_rows = max(grown(leaf_rows, alive, 1, 4, TILE), min(TILE, alive - TILE))
    while alive > last_rows:
        if _few(live, alive):
            found, live = _held_rounds(live, last_rows, log)
            merges.append(found)
            break
        if log is not None:
            log.append((live.filter("asks").count(), live.count()))
        asked = cut(_best_partners(live, grown(leaf_rows, alive, 1, PARTS, TILE), alive))
        told = asked.select(F.when(F.col("id") == F.col("best.lo"), F.col("best.hi")).otherwise(F.col("best.lo")).alias("id"), "best")
        every = asked.unionByName(told) if table is None else asked.unionByName(told).unionByName(table)
        best = cut(every.groupBy("id").agg(F.min("best").alias("best")))
        mutual = (
            best.groupBy("best").agg(F.count("*").alias("sides")).filter(F.col("sides") == 2).select("best.*")
        )
        found = cut(mutual)
        if found.isEmpty():
            raise RuntimeError("no two clusters are each other's cheapest partner; are all features numbers?")
        merges.append(found)
        lo, ends = F.coalesce("lo", F.col("id")), _ends(found)
        left = best
        for end in ("id", "best.lo", "best.hi"):  # partners stay where none of the two was merged
            left = left.join(ends, F.col(end) == F.col("end"), "left_anti")
        last, table = table, cut(left)
        renamed = live.join(found.select("lo", F.col("hi").alias("id")), "id", "left").select(lo.alias("id"), "n", "centroid")
        touched = renamed.join(found.select(F.col("lo").alias("id")), "id", "left_semi")
        rest = renamed.join(found.select(F.col("lo").alias("id")), "id", "left_anti")
        settled = table.select("id", F.lit(False).alias("again"))
        merged = rest.unionByName(_weighted_mean(touched)).join(settled, "id", "left")
        before, live = live, cut(merged.select("id", "n", "centroid", F.coalesce("again", F.lit(True)).alias("asks")))
        forget(before, best, asked, last)
        alive = live.count()
    merges.append(_last_merges(live))
    return reduce(DataFrame.unionByName, merges)


def _few(live: DataFrame, alive: int) -> bool:
    """True for clusters that one last tile is too small for and the driver is not."""
    return TILE < alive <= HELD_ROWS and alive * 8 * len(live.first().centroid) <= HELD_BYTES


def _searched(spark, x: np.ndarray, n: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost and row of the cheapest partner of every asking row, searched by tasks that get all rows."""
    if len(asks) * len(x) <= AT_ONCE:
        return cheapest_of(x, n, asks)
    tasks = min(4 * spark.sparkContext.defaultParallelism, -(-len(asks) // 64))
    held = spark.sparkContext.broadcast((x, n, asks))

    def run(batches):
        for batch in batches:
            for t in batch["id"].to_pylist():
                x, n, asks = held.value
                rows = np.arange(t, len(asks), tasks)
                cost, which = cheapest_of(x, n, asks[rows])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cost), pa.array(which)], ["row", "cost", "partner"])

    found = spark.range(0, tasks, 1, tasks).mapInArrow(run, "row long, cost double, partner long").toArrow()
    held.destroy()
    rows, cost, which = (found[c].to_numpy() for c in ("row", "cost", "partner"))
    order = np.argsort(rows)
    return cost[order], which[order]


def _held_rounds(live: DataFrame, last_rows: int, log: list[tuple[int, int]] | None) -> tuple[DataFrame, DataFrame]:
    """The merges until at most ``last_rows`` clusters are alive, and those clusters.

    The same rounds as over tables: rows are in the order of ids, and of equal costs the smallest partner counts.
    """
    spark, kind = live.sparkSession, live.schema["id"].dataType
    got = live.select("id", "n", "centroid").orderBy("id").toArrow().combine_chunks()
    ids, n, x = got["id"].combine_chunks(), got["n"].to_numpy().copy(), matrix(got["centroid"].combine_chunks()).copy()
    alive, asks = np.arange(len(x)), np.ones(len(x), bool)
    least, partner = np.full(len(x), np.inf), np.full(len(x), -1)
    merged: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(alive) > last_rows:
        rows = np.flatnonzero(asks[alive])
        if log is not None:
            log.append((len(rows), len(alive)))
        cost, which = _searched(spark, x[alive], n[alive].astype(float), rows)
        rows, which = alive[rows[which >= 0]], alive[which[which >= 0]]
        cost = cost[np.isfinite(cost)]
        least[rows], partner[rows] = cost, which
        order = np.lexsort((rows, cost, which))  # tell the cluster found, if none it knows is as cheap
        rows, cost, which = rows[order], cost[order], which[order]
        first = np.flatnonzero(np.diff(which, prepend=-1))
        rows, cost, which = rows[first], cost[first], which[first]
        news = (cost < least[which]) | ((cost == least[which]) & (rows < partner[which]))
        least[which[news]], partner[which[news]] = cost[news], rows[news]
        known = alive[partner[alive] >= 0]
        lo = known[(partner[partner[known]] == known) & (known < partner[known])]
        if not len(lo):
            raise RuntimeError("no two clusters are each other's cheapest partner; are all features numbers?")
        hi = partner[lo]
        merged.append((least[lo], lo, hi))
        x[lo] = (n[lo, None] * x[lo] + n[hi, None] * x[hi]) / (n[lo] + n[hi])[:, None]
        n[lo] += n[hi]
        ends = np.zeros(len(x), bool)
        ends[lo] = ends[hi] = True
        asks = ends | (partner < 0) | ends[partner]
        gone = np.zeros(len(x), bool)
        gone[hi] = True
        alive = alive[~gone[alive]]
        partner[asks], least[asks] = -1, np.inf
    cost, lo, hi = (np.concatenate([m[i] for m in merged]) for i in range(3))
    schema = StructType([StructField("cost", DoubleType()), StructField("lo", kind), StructField("hi", kind)])
    found = pa.table({"cost": cost, "lo": ids.take(pa.array(lo)), "hi": ids.take(pa.array(hi))})
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(alive) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[alive].ravel()))
    left = pa.table({"id": ids.take(pa.array(alive)), "n": n[alive], "centroid": vectors})
    shape = StructType([StructField("id", kind), StructField("n", LongType()), live.schema["centroid"]])
    return cut(spark.createDataFrame(found, schema)), cut(spark.createDataFrame(left, shape))


def _last_merges(live: DataFrame) -> DataFrame:
    """Merges of the last clusters, at most one tile of them whatever the seed's size."""
    last = live.agg(F.sort_array(F.collect_list(F.struct("id", F.col("centroid").alias("x"), F.col("n").alias("w")))).alias("p"))
    found = last.filter(F.size("p") > 1).select(
        F.col("p.id").alias("ids"), F.explode(all_merges("p.x", "p.w")).alias("m"))
    return found.select("m.cost", F.get("ids", "m.i").alias("lo"), F.get("ids", "m.j").alias("hi"))


def labels(points: DataFrame, merges: DataFrame, ks: list[int]) -> DataFrame:
    """``k, point_id, cluster_id`` for every wanted number of clusters.

    Cutting at k undoes the k - 1 costliest merges.  The part common to all cuts
    is labelled once; the few merges in which the cuts differ are then added per k.
    Clusters are numbered in the order of their smallest point id.
    """
    order = F.row_number().over(Window.orderBy(F.desc("cost"), F.desc("lo"), F.desc("hi")))
    costly = cut(
        merges.orderBy(F.desc("cost"), F.desc("lo"), F.desc("hi")).limit(max(ks) - 1).withColumn("nth", order))
    common = merges.join(costly.select("lo", "hi"), ["lo", "hi"], "left_anti")
    base = components(common.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    base = cut(points.join(base, F.col("point_id") == F.col("node"), "left").select(
        "point_id", F.coalesce("component", F.col("point_id")).alias("base")))
    wanted = F.array(*[F.lit(k) for k in sorted(set(ks))])
    ends = (
        costly.join(base.withColumnsRenamed({"point_id": "lo", "base": "base_lo"}), "lo")
        .join(base.withColumnsRenamed({"point_id": "hi", "base": "base_hi"}), "hi")
        .withColumn("k", F.explode(F.filter(wanted, lambda k: k <= F.col("nth"))))
        .select("k", F.struct("k", "base_lo").alias("u"), F.struct("k", "base_hi").alias("v"))
    )
    top = components(ends.select(
        F.struct(F.col("u.k").alias("k"), F.col("u.base_lo").alias("id")).alias("u"),
        F.struct(F.col("v.k").alias("k"), F.col("v.base_hi").alias("id")).alias("v")))
    tops = top.select(F.col("node.k").alias("k"), F.col("node.id").alias("base"), F.col("component.id").alias("top"))
    roots = base.select("base").distinct().select("base", F.explode(wanted).alias("k"))
    named = roots.join(tops, ["k", "base"], "left").withColumn("top", F.coalesce("top", "base"))
    number = F.dense_rank().over(Window.partitionBy("k").orderBy("top")) - 1
    return base.join(named.withColumn("cluster_id", number), "base").select("k", "point_id", "cluster_id")


def ward(points: DataFrame, k: int, leaf_rows: int = LEAF) -> DataFrame:
    """``point_id, features, cluster_id`` for k clusters."""
    cutting = labels(points, cut(history(points, leaf_rows)), [k])
    return points.select("point_id", "features").join(cutting.drop("k"), "point_id")
