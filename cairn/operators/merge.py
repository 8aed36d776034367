"""Merging compression sets, and folding them into the nearest clusters.

Sets are listed in the order of their key.  A pass goes through all pairs in list
order and merges a pair when the mean variance of the union stays below ``alpha``
times the larger mean variance, each set at most once per pass; passes repeat
until one merges nothing.  A merged set comes after all others.

The mean variance of a union is that of its parts, weighed by their sizes, and ``n m / (n + m)^2`` times the mean
squared difference of their centroids, so a set enters with its size, centroid and mean variance only.

A pass equals a greedy matching in the order of the pairs.  It is settled prefix by
prefix of the list: the first sets of it meet all others in parallel, and only who takes
whom among their first possible partners is decided in order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from cairn.functions.kernels import matrix
from cairn.operators import states as st
from cairn.operators.assign import euclidean, nearest
from cairn.operators.balls import LEAF
from cairn.session import cut

KEY = ("set_key",)
PAIR = ArrayType(StructType([
    StructField("side", IntegerType()), StructField("i", IntegerType()), StructField("j", IntegerType())]))
PAIR_ARROW = pa.list_(pa.struct([("side", pa.int32()), ("i", pa.int32()), ("j", pa.int32())]))


def described(sets: DataFrame) -> DataFrame:
    """``set_key, n, c, v``: size, centroid and mean variance of sets with vectors ``s``, ``q`` and, if there, ``m2``."""
    n = F.col("n")
    spread = F.col("m2") if "m2" in sets.columns else F.zip_with("q", "s", lambda q, s: q - s * s / n)
    mean = F.aggregate(spread, F.lit(0.0), lambda a, x: a + x) / n / F.size("s")
    return sets.select("set_key", "n", F.transform("s", lambda s: s / n).alias("c"), mean.alias("v"))


def fitting(n: float, c: np.ndarray, v: float, sizes: np.ndarray, centroids: np.ndarray, spreads: np.ndarray, alpha: float) -> np.ndarray:
    """Which of many sets may merge with one."""
    both = n + sizes
    within, between = (n * v + sizes * spreads) / both, ((centroids - c) ** 2).mean(axis=1)
    return within + n * sizes / both**2 * between < alpha * np.maximum(v, spreads)


@arrow_udf(PAIR)
def first_partner(n_a: pa.Array, c_a: pa.Array, v_a: pa.Array, n_b: pa.Array, c_b: pa.Array, v_b: pa.Array,
                  same: pa.Array, alpha: pa.Array) -> pa.Array:
    """First mergeable row of the other tile for every row of either; tiles are sorted by key."""
    out = []
    for na, ca, va, nb, cb, vb, one, al in zip(n_a, c_a, v_a, n_b, c_b, v_b, same, alpha):
        (n1, v1), (n2, v2) = ((np.array(n.as_py(), float), np.array(v.as_py(), float)) for n, v in ((na, va), (nb, vb)))
        c1, c2 = matrix(ca.values), matrix(cb.values)
        fits = np.array([fitting(n1[i], c1[i], v1[i], n2, c2, v2, al.as_py()) for i in range(len(n1))])
        rows = []
        if one.as_py():
            np.fill_diagonal(fits, False)
        else:
            rows += [(1, int(j), int(fits[:, j].argmax())) for j in np.flatnonzero(fits.any(axis=0))]
        rows += [(0, int(i), int(fits[i].argmax())) for i in np.flatnonzero(fits.any(axis=1))]
        out.append([dict(zip(("side", "i", "j"), r)) for r in rows])
    return pa.array(out, PAIR_ARROW)


def first_pairs(sets: DataFrame, alpha: float, leaf_rows: int = LEAF) -> DataFrame:
    """``set_key, best``: the first pair ``(lo, hi)`` in list order that each set could merge in.

    ``sets`` holds one row per set with vectors ``s``, ``q`` and, if there, ``m2``.  Tiles hold about ``leaf_rows``
    sets however many there are; every tile meets every other one in a row of its own.
    """
    sets = cut(described(sets))
    tiles = max(1, -(-sets.count() // leaf_rows))
    tile = F.pmod(F.xxhash64("set_key"), F.lit(tiles))
    entry = F.struct("set_key", "n", "c", "v")
    packed = sets.groupBy(tile.alias("tile")).agg(F.sort_array(F.collect_list(entry)).alias("p"))
    meet = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("other", F.col("other").cast("long"))
    pair = F.struct(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    sides = meet.withColumn("pair", pair)
    left = sides.filter(F.col("tile") == F.col("pair.a")).select("pair", F.col("p").alias("pa"))
    right = sides.filter(F.col("tile") == F.col("pair.b")).select("pair", F.col("p").alias("pb"))
    same = F.col("pair.a") == F.col("pair.b")
    offers = left.join(right, "pair").select(
        F.col("pa.set_key").alias("ka"), F.col("pb.set_key").alias("kb"),
        F.explode(first_partner("pa.n", "pa.c", "pa.v", "pb.n", "pb.c", "pb.v", same, F.lit(float(alpha)))).alias("o"))
    mine = F.when(F.col("o.side") == 0, F.get("ka", "o.i")).otherwise(F.get("kb", "o.i"))
    other = F.when(F.col("o.side") == 0, F.get("kb", "o.j")).otherwise(F.get("ka", "o.j"))
    best = F.struct(F.least(mine, other).alias("lo"), F.greatest(mine, other).alias("hi"))
    return offers.select(mine.alias("set_key"), best.alias("best")).groupBy("set_key").agg(F.min("best").alias("best"))


def _key(value) -> tuple:
    """A set's key as something that Python orders as Spark does."""
    return tuple(value.values()) if isinstance(value, dict) else tuple(value) if isinstance(value, tuple) else (value,)


def _partners(live: DataFrame, alpha: float, head: list, most: int) -> DataFrame:
    """``at, set_key``: per set of ``head`` (rows in list order) its first ``most`` mergeable later sets of each task."""
    keys = [_key(r.set_key) for r in head]
    held = live.sparkSession.sparkContext.broadcast(
        (keys, *[np.array([r[x] for r in head], float) for x in ("n", "c", "v")]))

    def found(batches):
        first, size, centroid, spread = held.value
        best: list[list] = [[] for _ in first]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("set_key").to_pylist()
            names, c2 = [_key(r) for r in rows], matrix(batch.column("c"))
            n2, v2 = (batch.column(x).to_numpy(zero_copy_only=False).astype(float) for x in ("n", "v"))
            for i in range(len(first)):
                fits = fitting(size[i], centroid[i], spread[i], n2, c2, v2, alpha)
                more = [(names[j], rows[j]) for j in np.flatnonzero(fits) if names[j] > first[i]]
                best[i] = sorted(best[i] + more, key=lambda x: x[0])[:most]
        at = [i for i, b in enumerate(best) for _ in b]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([k for b in best for _, k in b], kind)], ["at", "set_key"])

    kind = to_arrow_type(live.schema["set_key"].dataType)
    schema = StructType([StructField("at", IntegerType()), StructField("set_key", live.schema["set_key"].dataType)])
    return live.select("set_key", "n", "c", "v").mapInArrow(found, schema)


def matching(sets: DataFrame, alpha: float, leaf_rows: int = LEAF) -> DataFrame:
    """Pairs ``(lo, hi)`` one pass merges.

    Each round settles the first ``leaf_rows`` sets of the list: they are sent to the tasks, and a set's
    first ``2 * leaf_rows`` possible partners are enough, as fewer sets can be taken before its turn.  The
    round's pairs, at most ``leaf_rows``, are picked in list order on the driver.
    """
    live, taken, most = described(sets), [], 2 * leaf_rows
    while True:
        head = live.orderBy("set_key").limit(leaf_rows).collect()
        if len(head) < 2:
            break
        offers = _partners(live, alpha, head, most)
        nth = F.row_number().over(Window.partitionBy("at").orderBy("set_key"))
        offers = offers.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth").collect()
        wanted: dict[int, list] = {}
        for r in sorted(offers, key=lambda r: (r.at, _key(r.set_key))):
            wanted.setdefault(r.at, []).append(r.set_key)
        used, pairs = set(), []
        for i, r in enumerate(head):
            if _key(r.set_key) in used:
                continue
            partner = next((k for k in wanted.get(i, []) if _key(k) not in used), None)
            if partner is not None:
                pairs.append((r.set_key, partner))
                used |= {_key(r.set_key), _key(partner)}
        if pairs:
            kind = live.schema["set_key"].dataType
            taken.append(cut(live.sparkSession.createDataFrame(pairs, StructType([StructField("lo", kind), StructField("hi", kind)]))))
        if len(head) < leaf_rows:
            break
        live = live.filter(F.col("set_key") > F.lit(head[-1].set_key) if not isinstance(head[-1].set_key, tuple) else _after(head[-1].set_key))
        if taken and pairs:
            live = live.join(taken[-1].select(F.col("hi").alias("set_key")), "set_key", "left_anti")
        live = cut(live)
    if taken:
        return reduce(DataFrame.unionByName, taken)
    return sets.select(F.col("set_key").alias("lo"), F.col("set_key").alias("hi")).limit(0)


def _after(key: Row):
    """Keys that come later in the list than ``key``."""
    return F.col("set_key") > F.struct(*[F.lit(v).cast("long").alias(n) for n, v in key.asDict().items()])


def ranked(rows: DataFrame, step: int, order: str, into: str) -> DataFrame:
    """``rows`` with a key ``(step, rank)`` each, both BIGINT, in the order of column ``order``.

    Rows are sorted over many tasks; ranks have gaps, as they only have to keep the order.
    """
    sorted_ = rows.repartitionByRange(order).sortWithinPartitions(order)
    return cut(sorted_.withColumn(into, F.struct(F.lit(step).cast("long").alias("step"), F.monotonically_increasing_id().alias("rank"))))


def listed(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States with keys of any form under keys of step 0 in the same order, and the names ``set_key, old_key``."""
    names = ranked(states.select(F.col("set_key").alias("name")).distinct(), 0, "name", "set_key")
    keyed = st.with_moment(states).withColumnRenamed("set_key", "name").join(names, "name").select("set_key", "dim", *st.CELL)
    return keyed, names


def merge_sets(states: DataFrame, alpha: float, step: int = 1, leaf_rows: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """Merge until nothing fits: the states left, the renamings and the next step number.

    Keys are ``(step, rank)``: the step that made a set, and its place among the sets of
    that step (see `ranked`), so that later sets come last and sets of one step keep the order of
    their first members.  The renamings ``old_key, new_key`` cover all sets that came in.
    """
    now = cut(st.with_moment(states))
    names = now.select(F.col("set_key").alias("old_key"), F.col("set_key").alias("new_key")).distinct()
    while True:
        sets = st.as_vectors(now, ["s", "q", "m2"], KEY)
        pairs = cut(matching(cut(sets), alpha, leaf_rows))
        if pairs.isEmpty():
            return now, names, step
        fresh = ranked(pairs, step, "lo", "to")
        step += 1
        moves = fresh.select(F.col("lo").alias("from"), "to").unionByName(fresh.select(F.col("hi").alias("from"), "to"))
        renamed = now.join(moves, F.col("set_key") == F.col("from"), "left").withColumn("set_key", F.coalesce("to", "set_key"))
        now = cut(st.merge(renamed, keys=KEY))
        names = cut(names.join(moves, F.col("new_key") == F.col("from"), "left").select(
            "old_key", F.coalesce("to", "new_key").alias("new_key")))


def fold_targets(compression: DataFrame, discard: DataFrame) -> DataFrame:
    """``set_key, cluster_id``: the cluster whose centroid is nearest to each set's, lowest id on ties."""
    middles = st.as_vectors(st.finish(compression), ["centroid"], KEY).select(
        F.col("set_key"), F.col("centroid").alias("features"))
    return nearest(middles, discard, euclidean).select("set_key", "cluster_id", "distance")


def fold(compression: DataFrame, discard: DataFrame, targets: DataFrame) -> DataFrame:
    """Cluster states with the compression sets added to their targets."""
    moved = st.with_moment(compression).join(targets.select("set_key", "cluster_id"), "set_key")
    return st.merge(discard, moved)
