"""Frequent phrases by fingerprints: every run of words is hashed, only frequent ones are ever spelled out.

1. Texts of one language are laid into chunks of about ``CHUNK`` bytes, in plain form, and written once.
2. Prefix polynomials over the words of a chunk give the fingerprint of each run of words in one
   subtraction.  A chunk's fingerprints travel sorted, with count and place of an occurrence,
   in one block per range of fingerprints.
3. Per range, what may be frequent is let through.  A fingerprint that texts share only adds to its sum,
   so nothing frequent is lost.
4. Let-through occurrences are looked up in their chunks and counted by their words, so a shared
   fingerprint does not change a count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, kept_by_worker, release_kept, small_batches

WORDS, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Bytes of text in a chunk, and in all open chunks of a task.
CHUNK, OPEN = 3 << 20, 1 << 23
#: Bytes of text whose fingerprints make one range on average.
RANGE = 1 << 21
#: Moduli, bases for words and for runs of words, and bits of a fingerprint.
PRIMES, LETTER, WORD, BITS = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749), (772_657_111, 1_048_583_477), 44
#: Entries that a range gathers before it looks which are frequent.
GATHER = 1 << 19

_BREAKS = ".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(
    (_BREAKS + "\t" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ").encode(), ("\n" * len(_BREAKS) + " " + "abcdefghijklmnopqrstuvwxyz").encode())


def plain_form(texts: list[bytes]) -> tuple[bytes, int]:
    """Words of the texts, each followed by a blank within a piece or a line end after it, and their number."""
    b = np.frombuffer(b"\n".join(texts).translate(_PLAIN) + b"\n", dtype=np.uint8)
    line = b == 10
    gap = line | (b == 32)
    after = np.concatenate([[True], gap[:-1]])
    ends = np.flatnonzero(gap & ~after)
    if not len(ends):
        return b"", 0
    starts = np.flatnonzero(~gap & after)
    lines = np.cumsum(line, dtype=np.int64)
    # a word's piece ends if a line end stands before the next word
    last = np.concatenate([lines[starts[1:]] > lines[ends[:-1] - 1], [True]])
    out = b[~(gap & after)].copy()
    out[np.flatnonzero((out == 10) | (out == 32))] = np.where(last, 10, 32)
    return out.tobytes(), len(ends)


def places(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the words in a plain form, and whether the next word is of the same piece."""
    b = np.frombuffer(body, dtype=np.uint8)
    ends = np.flatnonzero((b == 10) | (b == 32))
    return b, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)], ends, b[ends] == 32


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), and more, modulo ``prime``; made once per worker and power of two."""
    size = 1 << max(10, (n - 1).bit_length())

    def make() -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
        return out

    return kept_by_worker(("powers", base, prime, size), make)


def fingerprints(body: bytes, language: str, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, first words, fingerprints) of all runs of 1 to ``longest`` words within pieces."""
    b, starts, ends, same = places(body)
    if not len(starts):
        return
    lengths, count = ends - starts, len(starts)
    inside = np.arange(len(b), dtype=np.int64) - np.repeat(starts, lengths + 1)
    seed, prefixes = zlib.crc32(language.encode()), []
    for prime, letter, word in zip(PRIMES, LETTER, WORD):
        p = np.uint64(prime)
        terms = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(letter, prime, int(lengths.max()) + 1)[inside] % p)])
        own = (terms[ends] - terms[starts]) % p
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * _powers(word, prime, count)[:count] % p)])
        prefixes.append((p, sums, _powers(pow(word, -1, prime), prime, count)))
    valid = np.ones(count, dtype=bool)
    for n in range(1, longest + 1):
        if n > 1:
            valid = valid[:-1] & same[n - 2: count - 1]
        first = np.flatnonzero(valid)
        parts = []
        for (p, sums, back), word in zip(prefixes, WORD):
            value = (sums[first + n] - sums[first]) % p * back[first] % p
            parts.append((value * np.uint64(word) + np.uint64(seed + n)) % p)
        yield n, first, parts[0] << np.uint64(BITS - 31) | parts[1] & np.uint64((1 << (BITS - 31)) - 1)


def _word_numbers(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes only; ``first`` of ``of`` is the first word with the same fingerprint."""
    lengths, like = ends - starts, first[of]
    other = np.flatnonzero(like != np.arange(len(starts)))
    if len(other):
        same = lengths[other] == lengths[like[other]]
        if same.all():
            n = lengths[other]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            same = b[np.repeat(starts[other], n) + step] == b[np.repeat(starts[like[other]], n) + step]
        if not same.all():  # two words with one fingerprint: number them by their bytes
            seen: dict[bytes, int] = {}
            whole = b.tobytes()
            return np.array([seen.setdefault(whole[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())], dtype=np.int64)
    return like


def entries(body: bytes, language: str, longest: int) -> tuple[np.ndarray, ...]:
    """Fingerprint, count, first word and number of words of each different run of words, by fingerprint."""
    b, starts, ends, _ = places(body)
    numbers, out = None, []
    for n, first, prints in fingerprints(body, language, longest):
        if not len(first):
            continue
        order = np.argsort(prints, kind="stable")
        sorted_prints = prints[order]
        new = np.concatenate([[True], sorted_prints[1:] != sorted_prints[:-1]])
        if numbers is None:
            group = np.empty(len(order), dtype=np.int64)
            group[order] = np.cumsum(new) - 1
            numbers = _word_numbers(b, starts, ends, order[new], group)
        words = [numbers[first + k] for k in range(n)]
        unlike = np.zeros(len(order) - 1, dtype=bool)
        for w in words:
            unlike |= w[order][1:] != w[order][:-1]
        if (unlike & ~new[1:]).any():  # unlike words with one fingerprint: keep them apart
            order = np.lexsort([*words, prints])
            sorted_prints = prints[order]
            new = np.concatenate([[True], sorted_prints[1:] != sorted_prints[:-1]])
            for w in words:
                new[1:] |= w[order][1:] != w[order][:-1]
        at = np.flatnonzero(new)
        out.append((sorted_prints[at], np.diff(np.append(at, len(order))), first[order[at]], np.full(len(at), n)))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    columns = [np.concatenate([o[i] for o in out]) for i in range(4)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _packed(*columns: tuple[np.ndarray, str]) -> bytes:
    """Columns byte plane by byte plane, so that high bytes that are all zero vanish when compressed."""
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c.astype(kind)).view(np.uint8).reshape(len(c), -1).T).tobytes() for c, kind in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(blob: bytes, rows: int, *kinds: str) -> list[np.ndarray]:
    data, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at:at + width * rows].reshape(width, rows).T).view(kind).ravel())
        at += width * rows
    return out


_ENTRY, _PLACE = ("<u8", "<u4", "<u4", "u1"), ("<u4", "<u4", "u1")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, language, words, bytes, body) rows from (language, text) rows."""
    release_kept()
    open_texts: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    task, made = TaskContext.get().partitionId(), 0

    def closed(language: str) -> pa.RecordBatch:
        nonlocal made
        body, words = plain_form(open_texts.pop(language))
        del sizes[language]
        made += 1
        packed = zstandard.ZstdCompressor(level=3).compress(body)
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + made - 1], pa.int64()), pa.array([language]), pa.array([words], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([packed], pa.binary())],
            names=["chunk", "lang", "words", "size", "body"])

    for batch in batches:
        for language, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary())):
            if not (text := text.as_py()):
                continue
            open_texts.setdefault(language, []).append(text)
            sizes[language] = sizes.get(language, 0) + len(text) + 1
            if sizes[language] >= CHUNK:
                yield closed(language)
            elif sum(sizes.values()) >= OPEN:
                yield closed(max(sizes, key=sizes.get))
    for language in list(open_texts):
        yield closed(language)


def _blocks(longest: int, ranges: int):
    """(range, chunk, rows, block) rows from chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, language, body in zip(batch["chunk"].to_pylist(), batch["lang"].to_pylist(), batch["body"]):
                prints, count, first, n = entries(zstandard.ZstdDecompressor().decompress(body.as_py()), language, longest)
                if not len(prints):
                    continue
                numbers = (prints.astype(np.float64) * (ranges / 2.0**BITS)).astype(np.int64)  # rising with the fingerprint
                bounds = np.append(np.flatnonzero(np.diff(numbers, prepend=-1)), len(numbers)).tolist()
                rows = []
                for s, e in zip(bounds, bounds[1:]):
                    steps = np.diff(prints[s:e], prepend=np.uint64(0))
                    rows.append((int(numbers[s]), e - s, _packed(*zip((steps, count[s:e], first[s:e], n[s:e]), _ENTRY))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["range", "chunk", "rows", "block"])

    return run


def _frequent(least: int):
    """(chunk, rows, block) rows of the entries whose fingerprint occurs ``least`` times among all blocks of a partition.

    At most ``least - 1`` entries of a fingerprint wait; once it is known to be frequent its entries pass at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64)  # fingerprint, chunk, count, first, words
        held = [np.zeros(0, dtype=k) for k in kinds]
        known = np.zeros(0, dtype=np.uint64)
        new: list[list[np.ndarray]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal held, known
            all_ = [np.concatenate([held[i], *[x[i] for x in new]]).astype(kinds[i], copy=False) for i in range(5)]
            new.clear()
            order = np.argsort(all_[0], kind="stable")
            prints = all_[0][order]
            if not len(prints):
                return
            starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            total = np.add.reduceat(all_[2][order], starts)
            each = prints[starts]
            passed = total >= least
            if len(known):
                passed |= known[np.minimum(np.searchsorted(known, each), len(known) - 1)] == each
            known = np.union1d(known, each[passed])
            through = np.repeat(passed, np.diff(np.append(starts, len(prints))))
            held = [c[order[~through]] for c in all_]
            out = order[through]
            out = out[np.argsort(all_[1][out], kind="stable")]
            chunks = all_[1][out]
            bounds = np.append(np.flatnonzero(np.diff(chunks, prepend=-1)), len(chunks)).tolist()
            for s, e in zip(bounds, bounds[1:]):
                rows = out[s:e]
                blob = _packed(*zip((all_[2][rows], all_[3][rows], all_[4][rows]), _PLACE))
                yield pa.RecordBatch.from_arrays([pa.array([int(chunks[s])], pa.int64()), pa.array([e - s], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "rows", "block"])

        waiting = 0
        for batch in batches:
            for chunk, rows, block in zip(batch["chunk"].to_pylist(), batch["rows"].to_pylist(), batch["block"]):
                steps, count, first, n = _unpacked(block.as_py(), rows, *_ENTRY)
                new.append([np.cumsum(steps, dtype=np.uint64), np.full(rows, chunk), count, first, n])
                waiting += rows
                if waiting >= GATHER:
                    yield from settled()
                    waiting = 0
        yield from settled()

    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) rows of the places let through, from their chunks' bodies."""
    for batch in batches:
        for language, body, found in zip(batch["lang"].to_pylist(), batch["body"], batch["found"].to_pylist()):
            b, starts, ends, _ = places(zstandard.ZstdDecompressor().decompress(body.as_py()))
            count, first, n = (np.concatenate(c).astype(np.int64) for c in zip(*[_unpacked(f["block"], f["rows"], *_PLACE) for f in found]))
            for s in range(0, len(first), 1 << 16):
                at, words = first[s:s + (1 << 16)], n[s:s + (1 << 16)]
                begin, length = starts[at], ends[at + words - 1] - starts[at]
                offsets = np.concatenate([[0], np.cumsum(length)])
                letters = b[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])]
                phrases = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(at), pa.string()), phrases.cast(pa.string()), pa.array(count[s:s + (1 << 16)], pa.int64())],
                    names=["lang", "phrase", "n"])


def frequent_phrases(df: DataFrame, text: str = "text", language: str = "lang", longest: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of runs of 1 to ``longest`` words that occur ``least`` times in a language, and (lang, n).

    ``n`` counts all words.  Counts are exact and cover all texts whole; overlapping occurrences count.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(f"`{language}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    with small_batches(spark, 500):
        chunks = cut(rows.mapInArrow(_chunks, "chunk bigint, lang string, words bigint, size bigint, body binary"))
    totals = cut(chunks.groupBy("lang").agg(F.sum("words").alias("n")).filter("n > 0"))
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = min(max(1, -(-size // RANGE)), 1 << 30)
    with small_batches(spark, 8):
        blocks = chunks.select("chunk", "lang", "body").mapInArrow(_blocks(longest, ranges), "range int, chunk bigint, rows int, block binary")
        through = cut(blocks.repartitionById(ranges, "range").mapInArrow(_frequent(least), "chunk bigint, rows int, block binary"))
        found = through.groupBy("chunk").agg(F.collect_list(F.struct("rows", "block")).alias("found"))
        spelled = chunks.select("chunk", "lang", "body").join(found, "chunk").select("lang", "body", "found").mapInArrow(_spelled, "lang string, phrase string, n bigint")
        counted = spelled.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        return cut(counted.withColumn("words", F.size(F.split("phrase", " ", -1)))), totals


def _part(words: Column, start, n) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(
    df: DataFrame, text: str = "text", language: str = "lang", longest: int = WORDS, least: int = LEAST, top: int = TOP, inside: int = INSIDE,
) -> DataFrame:
    """The ``top`` phrases of each language by how much more often their parts stand together than apart.

    Texts are lower-cased in A-Z, split into pieces at ``.,;:!?`` and line ends and those into words at blanks and tabs.
    A phrase has 2 to ``longest`` words and occurs ``least`` times.  Each cut into two parts scores
    floor(1000000 a a / (l r)), a, l and r being the counts of phrase and parts; the lowest counts, of equal ones the
    earliest.  A phrase goes if a longer one around it has ``inside`` percent of its count.

    A null language is ``und``, null and empty texts have no words, repeated rows count as often as they
    stand, other columns do not matter, and a table without phrases gives no rows.  Ties are settled by count, then bytes of the phrase.
    A chunk holds whole texts, so the longest text bounds a task's memory.
    """
    common, totals = frequent_phrases(df, text, language, longest, least)
    words = F.split("phrase", " ", -1)
    phrases = common.filter("words > 1")
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _part(words, F.lit(1), F.col("k")), "right": _part(words, F.col("k") + 1, F.col("words") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(common.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    million = F.lit(1_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumns({"top": million * (exact["a"] * exact["a"]), "bottom": exact["l"] * exact["r"]})
    best = cuts.withColumn("score", F.expr("top div bottom")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    shorter = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: _part(words, s, m))))
    around = phrases.filter("words > 2").select("lang", F.explode(F.array_distinct(shorter)).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


#: The same for DuckDB, with production parameters.
ORACLE_SQL = r"""
WITH pieces AS (
    SELECT lang, unnest(range(len(p))) AS j, doc, unnest(p) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents) AS split
), lists AS (
    SELECT lang, doc, j, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), words AS MATERIALIZED (
    SELECT lang, doc, j, unnest(w) AS w, unnest(range(len(w))) AS i FROM lists
), runs AS (
    SELECT lang, w AS a, lead(w) OVER piece AS b, lead(w, 2) OVER piece AS c FROM words WINDOW piece AS (PARTITION BY doc, j ORDER BY i)
), f AS MATERIALIZED (
    SELECT lang, phrase, m, count(*) AS a FROM (
        SELECT lang, a AS phrase, 1 AS m FROM runs
        UNION ALL SELECT lang, a || ' ' || b, 2 FROM runs WHERE b IS NOT NULL
        UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3 FROM runs WHERE c IS NOT NULL) AS every
    GROUP BY lang, phrase, m HAVING count(*) >= 10
), cuts AS (
    SELECT lang, phrase, m, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
    FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) AS each_cut
), scored AS (
    SELECT c.lang, c.phrase, c.m, c.a, k, l.a AS l, r.a AS r, (1000000 * c.a::HUGEINT * c.a) // (l.a::HUGEINT * r.a) AS score
    FROM cuts AS c JOIN f AS l ON l.lang = c.lang AND l.phrase = c.x JOIN f AS r ON r.lang = c.lang AND r.phrase = c.y
), best AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) AS ordered WHERE o = 1
), around AS (
    SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest([1, 2]) AS s FROM f WHERE m = 3) AS both_ends GROUP BY 1, 2
), ranked AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
    FROM best AS b LEFT JOIN around AS o ON o.lang = b.lang AND o.phrase = b.phrase AND b.m = 2
    WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a
)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked AS r JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) AS t ON t.lang = r.lang WHERE rank <= 2000
"""
