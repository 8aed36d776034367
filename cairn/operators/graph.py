"""Connected components by alternating stars (Kiveris et al., 2014), on edges that every partition joins by itself first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut, forget

HELD = 1 << 19  # nodes that a task joins at a time

def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node in ``edges (u, v)``.

    Each round links neighbours to the smallest one near them; the number of
    rounds grows with the logarithm of the graph, not with its longest path.
    Minima are taken map-side and joined back, so no neighbour list is built.  Before a
    round each partition joins the edges it holds into stars, which leaves at most one edge per node and partition.
    Once the edges left are as few as a task joins at a time, one task joins them all and no round is needed.
    """
    now = cut(_joined(edges.select("u", "v").filter(F.col("u") != F.col("v"))))
    while not (few := 2 * now.count() <= HELD) and not _only_stars(now):
        before, now = now, cut(_joined(_small_star(_large_star(now))))
        forget(before)
    if few:
        before, now = now, cut(_joined(now.coalesce(1)))
        forget(before)
    named = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    roots = named.select(F.col("component").alias("node"), "component").distinct()
    return named.unionByName(roots)


def _joined(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars around the smallest node of what they connect."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        def told(schema) -> Iterator[pa.RecordBatch]:
            nodes = [x for x in up if top(x) != x]
            for s in range(0, len(nodes), 1 << 16):
                part = nodes[s:s + (1 << 16)]
                sides = ([_value(x) for x in part], [_value(top(x)) for x in part])
                yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(n).type) for x, n in zip(sides, "uv")], schema=schema)
            up.clear()

        schema = None
        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                a, b = sorted((top(_node(u)), top(_node(v))))
                if a != b:
                    up[b] = a
            if len(up) > HELD:
                yield from told(schema)
        if up:
            yield from told(schema)

    return edges.mapInArrow(stars, edges.schema)


def _node(x):
    """A value that hashes, and sorts as in Spark: texts by their bytes, structs field by field."""
    return x.encode() if isinstance(x, str) else tuple((k, _node(y)) for k, y in x.items()) if isinstance(x, dict) else x


def _value(x):
    return x.decode() if isinstance(x, bytes) else {k: _value(y) for k, y in x} if isinstance(x, tuple) else x


def _only_stars(edges: DataFrame) -> bool:
    """True when every node points at one smaller node that points nowhere."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    forked = down.groupBy("u").agg(F.count("*").alias("ways")).filter(F.col("ways") > 1).select("u")
    onward = down.join(down.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return forked.unionByName(onward).isEmpty()


def _clean(edges: DataFrame) -> DataFrame:
    """Without loops and repeats; repeats are dropped map-side first."""
    return edges.filter(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    bigger = both.filter(F.col("v") > F.col("u")).join(low, "u")
    return _clean(bigger.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _clean(linked.unionByName(low.select("u", F.col("m").alias("v"))))
