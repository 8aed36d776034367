"""Packing token sequences by cutting-stock column generation.

Documents give full sequences and one remainder each, shorter than a sequence.
The remainders' length histogram (at most ``capacity - 1`` rows, whatever the data) goes to the driver,
where a linear program over patterns (multisets of lengths that fill one sequence) is
solved: a knapsack over the dual values finds the pattern to add next.  Rounded down, the
patterns are dealt to documents by their rank within their length.  The few remainders left
by rounding (at most one pattern's worth for each column of the basis) are laid end to end and cut.

A sequence is padded to ``capacity`` unless its length is a power of two, so such a pattern
costs its own length only.  Documents may be cut, so a pattern may also fill a stretch of several
sequences end to end (a stock roll of several lengths), where what crosses a bound is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, give_back, kept_by_worker, slices, small_batches, strings
from cairn.llm.library import Library

CAPACITY = 1024
#: Pivots of the linear program at most, and the padding (share of all tokens) at which it may stop.
PIVOTS, GAP = 2500, 1e-3
#: A pattern fills up to this many sequences end to end, cutting what crosses their bounds; charge for a cut.
ROLLS, CUT = 3, 0.25
#: Pieces of text that a worker remembers the ids of (some 120 MB).
MEMO = 400_000
#: Rows of one rank group aimed at; groups are split further as the table grows.
GROUP = 100_000


def costs(capacity: int, rolls: int = ROLLS) -> np.ndarray:
    """Tokens that a stretch of each length takes up, with a small charge for each cut in it."""
    whole, last = np.divmod(np.arange(rolls * capacity + 1), capacity)
    single = np.where((last & (last - 1)) == 0, last, capacity)
    return (whole * capacity + single + CUT * np.maximum(0, whole + (last > 0) - 1)).astype(float)


def price(duals: np.ndarray, cost: np.ndarray) -> tuple[float, list[int]]:
    """Pattern of most dual value beyond its cost, by a knapsack over exact fillings.

    ``best[c]`` is the value of the best pattern of length c; repeats are allowed.
    """
    size, longest = len(cost) - 1, len(duals) - 1
    best, last = np.full(size + 1, -np.inf), [0] * (size + 1)
    best[0] = 0.0
    backwards = duals[:0:-1].copy()  # of the longest first
    for c in range(1, size + 1):
        n = min(c, longest)
        tops = best[c - n:c] + backwards[longest - n:]
        i = tops.argmax()
        best[c], last[c] = tops[i], n - int(i)
    gain = best - cost
    gain[0] = -np.inf
    c = int(gain.argmax())
    value, pattern = float(gain[c]), []
    while c:
        pattern.append(last[c])
        c -= last[c]
    return value, pattern


def first_columns(demand: dict[int, int], capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """A feasible basis: lengths that complete each other in pairs, and one length by itself for what is left."""
    lengths = sorted(demand)
    columns, amounts = [], []
    for s in lengths:
        other = capacity - s
        alone = [s] * (capacity // s)
        if other in demand and other != s:
            if demand[s] < demand[other] or demand[s] == demand[other] and s < other:
                columns.append([s, other])
                amounts.append(float(demand[s]))
            else:
                columns.append(alone)
                amounts.append((demand[s] - demand[other]) / len(alone))
        else:
            columns.append(alone)
            amounts.append(demand[s] / len(alone))
    return columns, np.array(amounts)


def solve(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], float]]:
    """Patterns and how often each is used (fractions), covering ``demand`` (count per length) exactly."""
    if not demand:
        return []
    lengths, cost = sorted(demand), costs(capacity, ROLLS)
    row = {s: i for i, s in enumerate(lengths)}
    columns, x = first_columns(demand, capacity)

    def vector(pattern: list[int]) -> np.ndarray:
        v = np.zeros(len(lengths))
        for s in pattern:
            v[row[s]] += 1
        return v

    inverse = np.linalg.inv(np.array([vector(p) for p in columns]).T)
    paid = np.array([cost[sum(p)] for p in columns])
    tokens = float(sum(s * n for s, n in demand.items()))
    for step in range(PIVOTS):
        if paid @ x - tokens <= GAP * tokens:
            break
        duals = np.full(capacity, -np.inf)
        duals[lengths] = paid @ inverse
        gain, pattern = price(duals, cost)
        if gain <= 1e-7 * capacity:
            break
        direction = inverse @ vector(pattern)
        rising = direction > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, x / np.where(rising, direction, 1.0), np.inf)
        out = int(ratio.argmin())
        theta = max(0.0, float(ratio[out]))
        x = np.maximum(x - theta * direction, 0.0)
        x[out] = theta
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[out], paid[out] = pattern, cost[sum(pattern)]
        if step % 500 == 499:  # take rounding errors out
            inverse = np.linalg.inv(np.array([vector(p) for p in columns]).T)
            x = np.maximum(inverse @ np.array([demand[s] for s in lengths], dtype=float), 0.0)
    return [(sorted(p, reverse=True), float(a)) for p, a in zip(columns, x) if a > 1e-9]


class Plan(NamedTuple):
    """Who goes where: ranks of a length are dealt to patterns in turn, the rest is listed.

    ``table`` rows: length, first rank, copies in the pattern, first sequence, sequences of the
    pattern, place of the first copy in it.  ``rest`` rows: length, rank, sequence, place.
    """

    table: np.ndarray
    rest: np.ndarray
    sequences: int


def plan(demand: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Whole numbers from the linear program, sequences numbered from 0."""
    used = dict.fromkeys(demand, 0)
    table, sequence = [], 0
    for pattern, amount in sorted(solve(demand, capacity), key=lambda p: (-p[1], p[0])):
        sizes = sorted(set(pattern), reverse=True)
        copies = {s: pattern.count(s) for s in sizes}
        times = min(int(amount + 1e-6), *((demand[s] - used[s]) // copies[s] for s in sizes))
        if times <= 0:
            continue
        place, rolls = 0, -(-sum(pattern) // capacity)
        for s in sizes:
            table.append((s, used[s], copies[s], sequence, rolls, place))
            used[s] += times * copies[s]
            place += s * copies[s]
        sequence += times * rolls
    rest, place = [], 0
    for s in sorted(demand, reverse=True):
        for rank in range(used[s], demand[s]):
            rest.append((s, rank, sequence, place))
            place += s
    sequence += -(-place // capacity)
    return Plan(np.array(sorted(table), dtype=np.int64).reshape(-1, 6), np.array(sorted(rest), dtype=np.int64).reshape(-1, 4), sequence)


def locate(made: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First sequence of the stretch that holds each remainder, and its place in that stretch."""
    scale = np.int64(1) << 40
    wanted = length * scale + rank
    listed = made.rest[:, 0] * scale + made.rest[:, 1]
    at = np.minimum(np.searchsorted(listed, wanted), max(len(listed) - 1, 0))
    is_rest = listed[at] == wanted if len(listed) else np.zeros(len(wanted), bool)
    sequence, place = np.empty_like(wanted), np.empty_like(wanted)
    if is_rest.any():
        sequence[is_rest], place[is_rest] = made.rest[at[is_rest], 2], made.rest[at[is_rest], 3]
    if not is_rest.all():
        dealt = ~is_rest
        t = made.table[np.searchsorted(made.table[:, 0] * scale + made.table[:, 1], wanted[dealt], "right") - 1]
        nth = rank[dealt] - t[:, 1]
        sequence[dealt] = t[:, 3] + nth // t[:, 2] * t[:, 4]
        place[dealt] = t[:, 5] + nth % t[:, 2] * t[:, 0]
    return sequence, place


def _tokens(df: DataFrame, path: str, end: int, capacity: int, key: str, text: str) -> DataFrame:
    """Per row its token count, the checksums of its full sequences, the ids beyond them, and a place of its own."""
    with open(path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    stop = np.array([end], dtype="<u4").tobytes()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        library = kept_by_worker(("library", path, MEMO), lambda: Library(source.value, MEMO))
        part, row, step = TaskContext.get().partitionId(), 0, 4 * capacity
        for batch in batches:
            for b in slices(batch, "text"):
                raws = [r + stop for r in library.encode(strings(b["text"]))]
                full = [len(r) // step for r in raws]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"], "part": part, "row": np.arange(row, row + len(b)), "doc_tokens": [len(r) // 4 for r in raws],
                    "sums": [[zlib.crc32(r[i * step:(i + 1) * step]) for i in range(n)] for r, n in zip(raws, full)],
                    "tail": [r[n * step:] for r, n in zip(raws, full)]})
                row += len(b)

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(counted, "doc_id long, part long, row long, doc_tokens long, sums array<long>, tail binary")


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, path: str, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's tokens (ids of the text, then ``end``) laid into sequences of at most ``capacity``.

    One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.
    Each token lies in one piece; offsets in a sequence run from 0 without a gap.  Null texts
    count as empty and hold ``end`` alone; null keys and repeated rows each keep
    their own pieces; an empty table has none.  Other columns are not read.

    Texts are encoded where they lie; what is shuffled is one row per document with the
    ids of its remainder.  Ranks are taken within (length, group), where a group is
    a part of the rows by hash, so documents that are all of one length spread over
    many groups.  The driver sees the length histogram only.
    """
    with small_batches(df.sparkSession):
        rows = cut(_tokens(df, path, end, capacity, key, text))
    groups = max(64, -(-rows.count() // GROUP))
    rows = rows.withColumns({
        "rest": F.col("doc_tokens") % capacity, "full": F.size("sums").cast("long"),
        "grp": F.pmod(F.xxhash64("part", "row"), F.lit(groups))})
    ends = rows.filter("rest > 0")
    counts = cut(ends.groupBy("rest", "grp").agg(F.count("*").alias("n")))
    demand = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    made = plan(demand, capacity)
    before = Window.partitionBy("rest").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("rest", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before")))
    nth = F.row_number().over(Window.partitionBy("rest", "grp").orderBy("part", "row")) - 1
    ranked = ends.select("doc_id", "doc_tokens", "tail", "rest", "full", "grp", nth.alias("nth")).join(counts, ["rest", "grp"])
    ranked = ranked.select("doc_id", "doc_tokens", "tail", "rest", "full", (F.col("nth") + F.col("ranks_before")).alias("rank"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["rest"].to_numpy(np.int64)
            first, place = locate(made, length, b["rank"].to_numpy(np.int64))
            out = []
            for doc, n, tail, full, size, sequence, at in zip(b["doc_id"], b["doc_tokens"], b["tail"], b["full"], length.tolist(), first.tolist(), place.tolist()):
                done = 0
                while done < size:
                    roll, offset = divmod(at + done, capacity)
                    take = min(size - done, capacity - offset)
                    out.append((doc, full * capacity + done, take, zlib.crc32(tail[4 * done:4 * (done + take)]), n, sequence + roll, offset))
                    done += take
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")]).astype({"doc_id": "Int64"})

    # full sequences: numbered within each group, after all planned ones
    long = rows.filter("full > 0").select("doc_id", "doc_tokens", "part", "row", "full", "grp", "sums")
    sums = long.groupBy("grp").agg(F.sum("full").alias("n"))
    sums = sums.select("grp", (F.coalesce(F.sum("n").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + made.sequences).alias("first"))
    own = Window.partitionBy("grp").orderBy("part", "row").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("base", F.sum("full").over(own) - F.col("full")).join(sums, "grp")
    long = long.select("doc_id", "doc_tokens", (F.col("base") + F.col("first")).alias("base"), F.posexplode("sums").alias("i", "ids_crc32"))
    long = long.select(
        "doc_id", (F.col("i").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", (F.col("base") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInPandas(placed, _PIECES).unionByName(long)
