"""Near-duplicate texts: ProbMinHash signatures of weighted word shingles, banding, verification.

Every distinct run of five words of a text has a weight (1 + ln of its count) and throws a
Poisson process at that rate; each arrival falls on one of the signature's places, and a place keeps
the shingle that came first.  A shingle is dropped once its arrivals are later than all places'
first ones.  Two texts agree at a place with the probability Jaccard similarity of their weights.

A second signature has all weights 1, so two texts agree at a place of it with their plain Jaccard
similarity, however often their unlike parts repeat.  Where no shingle repeats the two are one.

Texts that agree in a whole band of places of either signature are candidates.  Their distinct shingles are then
compared, and a Jaccard similarity of at least 0.8 links them.  Classes are the
connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, give_back, release_kept, slices, small_batches, strings, text_key
from cairn.operators.graph import components
from cairn.session import forget

WORDS, SIMILARITY = 5, 0.8
#: Places of a signature: BANDS bands of ROWS.  A pair at 0.8 is missed by the signature of weights 1, and so by both
#: together, with probability (1 - 0.8**5)**30 < 1e-5 at most.
BANDS, ROWS = 30, 5
#: Rounds in which a bucket's texts meet one text of it, before groups still open are compared tile by tile.
ROUNDS, TILE = 2, 256

_P = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 1 << 17
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word, a run of bytes above the space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], raw > 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):  # whole words, about ``_STEP`` bytes of text at a time
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _STEP)))
        a, z = int(starts[first]), int(ends[last - 1])
        up, down = _powers(1 << max(12, (z - a).bit_length()))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw[a:z].astype(np.uint64) + np.uint64(1)) * up[:z - a])))
        s, e = starts[first:last] - a, ends[first:last] - a
        hashes[first:last] = mix((sums[e] - sums[s]) * down[s])
        first = last
    return hashes, starts


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Per text the hashes of its runs of five words, in order; all its words where there are fewer."""
    raw = [t.encode() for t in texts]
    hashes, starts = word_hashes(b" ".join(raw))
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    at = np.searchsorted(starts, bounds)
    out = []
    with np.errstate(over="ignore"):
        for a, z in zip(at[:-1], at[1:]):
            w = hashes[a:z]
            k = min(WORDS, len(w))
            if not k:
                out.append(w)
                continue
            v = w[:len(w) - k + 1].copy()
            for i in range(1, k):
                v = mix(v * np.uint64(_P) + w[i:len(w) - k + 1 + i])
            out.append(v)
    return out


def signatures(items: list[tuple[np.ndarray, np.ndarray]], places: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of sets of (distinct hashes, weights); a row per set, 0 everywhere for an empty one."""
    n = len(items)
    first, kept = np.full(n * places, np.inf), np.zeros(n * places, dtype=np.uint64)
    h = np.concatenate([i[0] for i in items]) if items else np.zeros(0, np.uint64)
    w = np.concatenate([i[1] for i in items]) if items else np.zeros(0)
    d = np.repeat(np.arange(n), [len(i[0]) for i in items])
    t, latest, turn = np.zeros(len(h)), np.full(n, np.inf), 0
    with np.errstate(over="ignore"):
        while len(h):
            x = mix(h + np.uint64((2 * turn + 1) * _P & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
            alive = t < latest[d]
            if not alive.all():
                h, w, d, t, x = h[alive], w[alive], d[alive], t[alive], x[alive]
                if not len(h):
                    break
            slot = d * places + (mix(x) % np.uint64(places)).astype(np.int64)
            better = t < first[slot]
            s, tb = slot[better], t[better]
            np.minimum.at(first, s, tb)
            won = tb == first[s]
            kept[s[won]] = h[better][won]
            latest = first.reshape(n, places).max(axis=1)
            turn += 1
    return kept.reshape(n, places)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    v = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            v = mix(v * np.uint64(_P) + parts[:, :, i])
    return v


def banded(items: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Distinct bands of each set's weighted signature and of the one with all weights 1; none for an empty set."""
    codes = bands(signatures(items)).view(np.int64)
    out = [np.unique(c) if len(i[0]) else c[:0] for c, i in zip(codes, items)]
    again = [n for n, i in enumerate(items) if (i[1] != 1).any()]
    even = bands(signatures([(items[n][0], np.ones(len(items[n][0]))) for n in again])).view(np.int64)
    for n, c in zip(again, even):
        out[n] = np.union1d(out[n], c)
    return out


def _signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, sha, size, bands) of every row; no bands where there is no word."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_kept()
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                items = []
                for s in shingles(strings(b["text"])):
                    values, counts = np.unique(s, return_counts=True)
                    items.append((values, 1 + np.log(counts)))
                codes = banded(items)
                yield pd.DataFrame({"id": b["id"], "sha": b["sha"], "size": [len(i[0]) for i in items],
                                    "bands": codes})
        give_back()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), text_key(text).alias("sha"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInPandas(signed, f"id {kind}, sha string, size int, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, items) from (node, text)."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                yield pd.DataFrame({"node": b["node"], "items": [np.unique(s).view(np.int64) for s in shingles(strings(b["text"]))]})
        give_back()

    return docs.mapInPandas(listed, "node long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct nodes with their similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    both = both.select("u", "v", common.alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return both.select("u", "v", (F.col("common") / (F.col("total") - F.col("common"))).alias("similarity"))


def _classed(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """``nodes`` with the ``class`` of each: its component of the links, or itself."""
    joined = linked.select("node", F.col("component").alias("class"))
    return nodes.join(joined, "node", "left").withColumn("class", F.coalesce("class", "node"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sha, class_id, kept) of every row: ``class_id`` is the smallest key of its class.

    Rows of equal text are one class by their SHA-256, whatever the text's length; an empty text
    is linked to empty texts only, a null text (null ``sha``) to nothing: its class is its own key.
    A class whose keys are all null has a null ``class_id``.  ``kept`` marks the rows whose key is
    the class's smallest and whose text is the smallest by digest among those of that key; repeats of that row
    are marked alike.  Extra columns are not read; an empty table gives no rows.

    Copies are gathered map-side by digest.  A bucket's texts are compared with one text of the
    bucket per round and never listed as pairs.  Texts that share too little with other classes are then left
    aside, and what is open after ``ROUNDS`` rounds is compared in tiles, so no link is lost.  A text is shuffled once, and only its shingle hashes after that.
    """
    with small_batches(df.sparkSession, 2000):
        signed = cut(_signed(df, key, text))
    nodes = signed.groupBy("sha").agg(F.min("id").alias("low"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbers stay as written
    coded = nodes.select("node", "size", F.explode("bands").alias("h"))
    buckets = coded.groupBy("h").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    members = cut(coded.join(buckets.select("h"), "h"))
    wanted = nodes.join(members.select("node"), "node", "left_semi").select("node", "sha", "low")
    docs = df.select(F.col(key).alias("id"), text_key(text).alias("sha"), F.col(text).cast("string").alias("text")).alias("d")
    docs = docs.join(wanted.alias("w"), F.expr("d.id <=> w.low AND d.sha = w.sha")).select("w.node", "d.text")
    with small_batches(df.sparkSession, 2000):
        sets = cut(_sets(docs).dropDuplicates(["node"]))

    links, active = None, members.withColumn("class", F.col("node"))
    for turn in range(ROUNDS):
        order = F.struct(F.xxhash64("node", F.lit(turn)) if turn else F.lit(0).cast("long"), "node", "size", "class")
        heads = active.groupBy("h").agg(F.min(order).alias("head"))
        pairs = active.join(heads, "h").filter(F.col("class") != F.col("head.class"))
        # sizes that rule 0.8 out
        pairs = pairs.filter(F.least("size", "head.size") >= SIMILARITY * F.greatest("size", "head.size"))
        pairs = pairs.select(F.least("node", "head.node").alias("u"), F.greatest("node", "head.node").alias("v")).distinct()
        found = cut(_verified(pairs, sets).filter(F.col("similarity") >= SIMILARITY).select("u", "v"))
        links = found if links is None else links.unionByName(found)
        linked = components(links)
        before, active = active, cut(_open(_classed(active.select("h", "node", "size"), linked)))
        forget(members if turn == 0 else before)
        if active.isEmpty():
            break
    else:
        active = _linkable(active, sets)
        if not active.isEmpty():
            links = links.unionByName(cut(_compared(active, sets)))
            linked = components(links)
    forget(active, sets)

    named = _classed(nodes.select("node", "sha", "low"), linked)
    # smallest (key, digest) of a class, null keys last
    first = named.groupBy("class").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "sha")).alias("first"))
    named = named.join(first, "class").select("sha", F.col("first.low").alias("class_id"), F.col("first.sha").alias("first_sha"))
    out = signed.select("id", "sha").join(named, "sha")
    out = out.select("id", "sha", "class_id", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("sha") == F.col("first_sha"))).alias("kept"))
    nulls = df.filter(F.col(text).isNull()).select(F.col(key).alias("id"), F.lit(None).cast("string").alias("sha"), F.col(key).alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(nulls).withColumnRenamed("id", key)


def _linkable(active: DataFrame, sets: DataFrame) -> DataFrame:
    """What is open of ``active`` without texts that share too few shingles with other classes to link to any of them.

    Similarity 0.8 with a set of size m asks for 4/9 (n + m) common shingles, and m is at least 0.8 n and
    at least the smallest size in the text's buckets.  Shingles that occur in one class only
    are common with none of another.
    """
    least = active.groupBy("h").agg(F.min("size").alias("least"))
    needs = active.join(least, "h").groupBy("node", "size", "class").agg(F.min("least").alias("least"))
    items = cut(needs.join(sets, "node").select("node", "size", "class", "least", F.explode("items").alias("item")))
    shared = items.groupBy("item").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("item")
    common = items.join(shared, "item", "left_semi").groupBy("node").agg(
        F.count("*").alias("common"), F.first("size").alias("size"), F.first("least").alias("least"))
    share = SIMILARITY / (1 + SIMILARITY)
    fair = F.col("common") >= F.floor(share * (F.col("size") + F.greatest(F.col("least"), SIMILARITY * F.col("size"))))
    left = cut(_open(active.join(common.filter(fair).select("node"), "node", "left_semi")))
    forget(items, active)
    return left


def _compared(active: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between texts of different classes, by comparing all texts joined by shared buckets.

    Such a group is dealt into tiles of about ``TILE`` texts, and each pair of tiles is a task's group of its own that
    answers with at most one link per text and other class, never with pairs.
    """
    heads = active.groupBy("h").agg(F.min("node").alias("u"))
    joined = components(active.join(heads, "h").select("u", F.col("node").alias("v")))
    owners = active.select("node", "class").distinct()
    placed = joined.select("node", F.col("component").alias("grp")).join(owners, "node").join(sets, "node")
    counts = joined.groupBy(F.col("component").alias("grp")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = placed.join(counts, "grp").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("grp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "class", "items")

    def compared(batch: pd.DataFrame) -> pd.DataFrame:
        release_kept()
        node, owner = batch["node"].to_numpy(), batch["class"].to_numpy()
        near = jaccard([np.asarray(x) for x in batch["items"]]) >= SIMILARITY
        near &= owner[:, None] != owner[None, :]
        out = []
        for i in np.flatnonzero(near.any(axis=1)):
            others = np.flatnonzero(near[i])
            out += [(node[i], node[j]) for j in others[np.unique(owner[others], return_index=True)[1]]]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return dealt.groupBy("grp", "i", "j").applyInPandas(compared, "u long, v long")


def jaccard(sets: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Similarity of every two sets, from their 0/1 table taken some columns at a time."""
    sizes = np.array([len(s) for s in sets])
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, keep = np.repeat(np.arange(len(sets)), sizes), times > 1
    column = (np.cumsum(keep) - 1)[code]
    row, column = row[keep[code]], column[keep[code]]
    order = np.argsort(column, kind="stable")
    row, column, common = row[order], column[order], np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(keep.sum()), columns):
        a, z = np.searchsorted(column, (start, start + columns))
        table = np.zeros((len(sets), columns), dtype=np.float32)
        table[row[a:z], column[a:z] - start] = 1
        common += table @ table.T
    common = common.astype(float)
    return common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1)


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that still hold several classes."""
    mixed = members.groupBy("h").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("h")
    return members.join(mixed, "h", "left_semi").select("h", "node", "size", "class")


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` with one row of each class: its ``kept`` one, once.  Null texts all stay, as nothing is like them."""
    stays = near_duplicates(df, key, text).filter("kept AND sha IS NOT NULL").select(F.col(key).alias("id__"), F.col("sha").alias("sha__")).distinct()
    marked = df.withColumn("sha___", text_key(text)).alias("d")
    kept = marked.join(stays.alias("s"), F.expr(f"d.`{key}` <=> s.id__ AND d.sha___ = s.sha__")).select("d.*", "s.id__", "s.sha__")
    kept = kept.dropDuplicates(["id__", "sha__"]).select([F.col(f"`{c}`") for c in df.columns])
    return kept.unionByName(df.filter(F.col(text).isNull()))
