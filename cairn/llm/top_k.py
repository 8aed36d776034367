"""Exact top-k by inner product without random access.

Candidates lie in blocks.  Within a block each dimension is a list sorted by value; for one query
it is read from the end where its contributions are largest.  After reading all lists to
one depth, a candidate's score lies between what was read of it plus the least, and
plus the most, that the unread rest of each list can add.  Candidates whose upper
bound is below the k-th best lower bound are out.  Once few are left their scores are
resolved; otherwise the lists are read deeper.  Bounds of all queries of a block are
taken together as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut

#: Rows of a candidate and of a query block; bytes of query blocks that may be broadcast.
CANDIDATES, QUERIES, BROADCAST = 4096, 512, 8 << 20
#: Parts of a block's lists read before the bounds are looked at, and candidates few enough to resolve.
DEPTHS, FEW = (16, 4, 1), 64


def no_random_access(values: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query number, row, score) of at least the k best rows of every query, all ties of the k-th included.

    A row with the query's own id is no candidate.  ``values`` and ``queries`` are integers; sums are
    exact in doubles below 2**53, beyond that whole numbers of any size are used.
    """
    n, dims = values.shape
    reach = int(np.abs(values).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(dims, 1)
    if reach >= 1 << 53:
        return _direct(values.astype(object), ids, queries.astype(object), query_ids, k)
    v, q_all = values.astype(float), queries.astype(float)
    order = np.argsort(-v, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(v, order, axis=0)
    out: list[tuple[int, int, int]] = []
    active = np.arange(len(q_all))
    for part in DEPTHS:
        if not len(active):
            break
        depth = -(-n // part)
        q = q_all[active]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        top, bottom = (place < depth).astype(float), (place >= n - depth).astype(float)
        seen = np.concatenate([v * top, v * bottom], axis=1) @ np.concatenate([up, down], axis=1).T
        if depth < n:
            next_top, next_bottom = lists[depth], lists[n - 1 - depth]
            read = np.concatenate([top, bottom], axis=1)
            most = np.concatenate([up * next_top, down * next_bottom], axis=1)
            least = np.concatenate([up * lists[-1], down * lists[0]], axis=1)
            upper = seen + (most.sum(axis=1) - read @ most.T)
            lower = seen + (least.sum(axis=1) - read @ least.T)
        else:
            upper = lower = seen
        own = ids[:, None] == query_ids[active][None, :]
        upper = np.where(own, -np.inf, upper)
        lower = np.where(own, -np.inf, lower)
        floor = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(active), -np.inf)
        left = (upper >= floor) & np.isfinite(upper)
        few = (left.sum(axis=0) <= FEW) | (depth >= n)
        for j in np.flatnonzero(few):
            rows = np.flatnonzero(left[:, j])
            scores = (v[rows] @ q[j]).astype(np.int64)  # final scores of those that may qualify
            if len(rows) > k:
                keep = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                rows, scores = rows[keep], scores[keep]
            out += [(int(active[j]), int(r), int(s)) for r, s in zip(rows, scores)]
        active = active[~few]
    return out


def _direct(values, ids, queries, query_ids, k):
    out = []
    for j, q in enumerate(queries):
        scored = sorted(((-int(s), i) for i, s in enumerate(values @ q) if ids[i] != query_ids[j]))
        kth = scored[min(k, len(scored)) - 1][0] if scored else 0
        for s, i in scored:
            if s > kth:
                break
            if -s >= 1 << 63 or -s < -(1 << 63):
                raise OverflowError("a score does not fit into 64 bits")
            out.append((j, i, -s))
    return out


def _blocks(df: DataFrame, rows: int, scale: int, whole: bool) -> DataFrame:
    """(block, dims, ids, marks, data) from (id, mark, vector); one block per task if ``whole``, else ``rows`` rows each."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held = TaskContext.get().partitionId(), {}

        def flush(dims: int) -> pd.DataFrame:
            ids, marks, data = zip(*held.pop(dims))
            return pd.DataFrame({"block": [task], "dims": [dims], "ids": [np.array(ids)], "marks": [np.array(marks)], "data": [np.stack(data).astype("<i8").tobytes()]})

        for batch in batches:
            for i, m, x in zip(batch["id"], batch["mark"], batch["vector"]):
                x = np.floor(np.asarray(x, dtype=float) * scale)
                if np.abs(x).max(initial=0) >= 2.0**62:
                    raise OverflowError("a scaled component does not fit into 64 bits")
                held.setdefault(len(x), []).append((i, m, x.astype(np.int64)))
                if not whole and len(held[len(x)]) >= rows:
                    yield flush(len(x))
        for dims in list(held):
            yield flush(dims)

    return df.mapInPandas(packed, "block int, dims int, ids array<long>, marks array<long>, data binary")


def usable(vector: str) -> Column:
    """True for vectors that are not null or empty and hold finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best other rows for every row where ``is_query`` holds.

    Components become floor(``scale`` * x).  Ties go to the smaller key.  Vectors that are null, empty or
    hold null or non-finite components take no part; rows of null key neither.  Vectors of unlike length are not
    compared.  A repeated query row is one query; repeated candidates all count; rows sharing the
    query's key are its own.  Extra columns are not read; an empty table gives no rows.
    A finite component of which ``scale`` times x reaches 2**62 raises, as its score would not fit into a BIGINT.

    Each candidate block meets each query block once; what leaves it is about ``k`` rows per query.
    Query blocks are broadcast while they are known to be small and joined otherwise.
    """
    rows = df.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(vector).alias("mark"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    asked = cut(rows.filter("asks").select("id", "mark", "vector").distinct())
    parts = max(1, -(-asked.count() // QUERIES))
    asked = cut(_blocks(asked.repartition(parts), QUERIES, scale, True))
    have = rows.select("id", "mark", "vector")
    have = cut(_blocks(have, CANDIDATES, scale, False))
    pairs = have.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    named = asked.select(F.col("block").alias("asked"), "dims", F.col("ids").alias("q_ids"), F.col("marks").alias("q_marks"), F.col("data").alias("q_data"))
    size = asked.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).head()[0]
    pairs = pairs.drop("marks", "block").join(F.broadcast(named) if size <= BROADCAST else named, ["asked", "dims"])

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, ids, data, q_ids, q_marks, q_data in zip(*(batch[c] for c in ("dims", "ids", "data", "q_ids", "q_marks", "q_data"))):
                values, queries = (np.frombuffer(b, dtype="<i8").reshape(-1, dims) for b in (data, q_data))
                found = no_random_access(values, ids, queries, q_ids, k)
                j, i, s = (np.array(c, dtype=np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                best = pd.DataFrame({"query_id": q_ids[j], "mark": q_marks[j], "vec_id": ids[i], "score": s})
                best = best.sort_values(["query_id", "mark", "score", "vec_id"], ascending=[True, True, False, True])
                yield best.groupby(["query_id", "mark"]).head(k)

    columns = ["asked", "dims", "ids", "data", "q_ids", "q_marks", "q_data"]
    best = pairs.select(columns).mapInPandas(searched, "query_id long, mark long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
