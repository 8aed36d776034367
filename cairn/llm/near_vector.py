"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits by random directions at the median of a bounded sample; vectors close to a split go
down both sides.  Vectors of one label that share a leaf of any tree are compared by cosine, links
are counted once per pair, and classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut
from cairn.llm.top_k import usable
from cairn.operators.graph import components

SIMILARITY = 0.93
TREES, LEAF, TILE = 8, 512, 1024
#: Half width of the zone around a split whose vectors (of length 1) go both ways.
SPILL = 0.02
#: Vectors that the splits are fitted on; every vector is then indexed.
SAMPLE = 16_384


def fit(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per tree and level the directions and thresholds of its nodes."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        node, levels = np.zeros(len(sample), dtype=int), []
        for level in range(depth):
            directions = rng.standard_normal((1 << level, sample.shape[1]))
            directions /= np.linalg.norm(directions, axis=1, keepdims=True)
            along = np.einsum("ij,ij->i", sample, directions[node])
            thresholds = np.zeros(1 << level)
            for k in range(1 << level):
                mine = along[node == k]
                if len(mine):
                    thresholds[k] = np.median(mine)
            node = 2 * node + (along > thresholds[node])
            levels.append((directions, thresholds))
        out.append(levels)
    return out


def leaves(forest, vectors: np.ndarray) -> list[list[int]]:
    """Ascending leaf numbers of each vector over all trees; a tree's leaves follow those of the tree before."""
    out: list[list[int]] = [[] for _ in vectors]
    for tree, levels in enumerate(forest):
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), dtype=int)
        for directions, thresholds in levels:
            off = np.einsum("ij,ij->i", vectors[row], directions[node]) - thresholds[node]
            low, high = off <= SPILL, off > -SPILL
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
        for r, k in sorted(zip(row.tolist(), node.tolist())):
            out[r].append((tree << len(levels)) + k)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale  # first by the largest component, so that squares neither overflow nor vanish
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def compare(batch: pd.DataFrame, leaf: int, cross: bool) -> pd.DataFrame:
    """Links within one leaf, or between its two tiles: per row its number, and one tree of links.

    A pair is counted in the smallest leaf that both share, so over all leaves once.
    """
    empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "linked": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64")})
    if len(batch) < 2:
        return empty
    sizes = batch["vector"].map(len).to_numpy()
    found = []
    for dims in np.unique(sizes):
        b = batch[sizes == dims].reset_index(drop=True)
        unit = _unit(np.stack(b["vector"]).astype(float))
        close = unit @ unit.T >= SIMILARITY
        np.fill_diagonal(close, False)
        if cross:
            tile = b["tile"].to_numpy()
            close &= tile[:, None] != tile[None, :]
        if not close.any():
            continue
        near = np.flatnonzero(close.any(axis=1))
        close, nodes, copies = close[np.ix_(near, near)], b["node"].to_numpy()[near], b["copies"].to_numpy()[near]
        earlier = [[x for x in own if x < leaf] for own in b["leaves"].iloc[near]]
        number = {x: i for i, x in enumerate(sorted({x for own in earlier for x in own}))}
        if number:
            shared = np.zeros((len(near), len(number)), dtype=np.float32)
            for r, own in enumerate(earlier):
                shared[r, [number[x] for x in own]] = 1
            fresh = close & ~(shared @ shared.T > 0)
        else:
            fresh = close
        found.append(pd.DataFrame({"node": nodes, "linked": fresh @ copies, "other": _parents(close, nodes)}))
    return pd.concat(found) if found else empty


def _parents(close: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row the smallest node of its component within the leaf."""
    least = nodes.copy()
    while True:
        now = np.array([min(least[i], least[row].min(initial=least[i])) for i, row in enumerate(close)])
        if (now == least).all():
            return least
        least = now


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows link when their labels are equal and not null and their cosine, in doubles, is at least
    0.93.  Vectors that are null, empty, zero or hold null or non-finite components, and rows without label or key, link
    with nothing and stay.  Vectors of unlike length do not link.  Equal vectors of one label are
    gathered first and count as often as they occur; a repeated row is a vector like any other.  Extra
    columns are not read; an empty table gives no rows.

    The forest is fitted on ``SAMPLE`` vectors and indexes all.  Leaves of more than ``TILE``
    vectors are compared tile by tile, each pair of tiles a task's group of its own.
    """
    spark = df.sparkSession
    zero = F.forall(vector, lambda x: x == 0)
    fit_for_use = usable(vector) & ~F.coalesce(zero, F.lit(True)) & F.col(label).isNotNull() & F.col(key).isNotNull()
    kinds = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"), fit_for_use.alias("good"))
    rows = kinds.filter("good").select("id", "label", "vector")
    nodes = rows.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    most = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    depth = max(0, int(np.ceil(np.log2(most / LEAF)))) if most else 0
    drawn = [r["vector"] for r in nodes.orderBy(F.xxhash64("vector"), "node").select("vector").limit(SAMPLE).collect()] if depth else []
    dims = max({len(v) for v in drawn}, key=[len(v) for v in drawn].count) if drawn else 0
    sample = _unit(np.array([v for v in drawn if len(v) == dims], dtype=float)) if drawn else np.zeros((0, 1))
    forest = spark.sparkContext.broadcast(fit(sample, depth))

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["vector"].map(len).to_numpy()
            own: list[list[int]] = [[0]] * len(batch)  # vectors of other lengths share one leaf
            here = np.flatnonzero(sizes == dims) if dims else []
            if len(here):
                found = leaves(forest.value, _unit(np.stack(batch["vector"].iloc[here]).astype(float)))
                for r, f in zip(here, found):
                    own[r] = f
            yield batch.assign(leaves=own)

    kind = nodes.schema["vector"].dataType.simpleString()
    label_kind = nodes.schema["label"].dataType.simpleString()
    placed = nodes.select("node", "copies", "label", "vector").mapInPandas(indexed, f"node long, copies long, label {label_kind}, vector {kind}, leaves array<long>")
    placed = cut(placed)
    spread = placed.withColumn("leaf", F.explode("leaves"))
    counts = placed.select("label", F.explode("leaves").alias("leaf")).groupBy("label", "leaf").agg(F.count("*").alias("n"))
    spread = spread.join(counts, ["label", "leaf"]).filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    spread = spread.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("node", "copies", "label", "vector", "leaves", "leaf", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compared(group: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        return compare(batch, int(group[1]), group[2] != group[3])

    found = cut(spread.groupBy("label", "leaf", "i", "j").applyInPandas(compared, "node long, linked long, other long"))
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    joined = components(found.filter("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")))
    classes = nodes.select("node", "low").join(joined, "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    named = classes.join(smallest, "class").select("node", "component_id").join(linked, "node", "left")
    named = nodes.join(named, "node").select("label", "vector", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = kinds.filter("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
