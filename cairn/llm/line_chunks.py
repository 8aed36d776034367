"""Removal of repeated runs of lines by content-defined chunks, with DataFrame functions only.

A text is a list of lines.  A polynomial over the hashes of the last ``WINDOW`` lines says after which lines a chunk ends,
so the same lines give the same chunks wherever they stand.  A line of at least ``LONG`` words is a chunk by
itself.

`remove_repeated_runs` counts whole chunks first.  A chunk seen before goes as a whole, and only the runs of lines inside
the first copy of each chunk, and those that cross from one chunk to the next, are looked at line by line, so that a
repeated run goes whole wherever it starts and ends.  `remove_repeated_chunks` takes out repeated chunks and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, unused
from cairn.session import forget

#: Lines that decide on a boundary, and one in how many lines ends a chunk on average.
WINDOW, DIVISOR = 2, 3
#: Words that make a line a passage of its own.
LONG = 50
#: Bits that say which documents may have to be moved; more documents than bits only move more of them.
MARKS = 1 << 23
#: Rolling hash: sum of BASE ** k times the line hash modulo MODULUS, small enough for 64 bits.
BASE, MODULUS = 1_000_003, 2_147_483_647


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once per row, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def chunks_of(text: Column) -> Column:
    """Array of chunks, each an array of lines; joined by line ends they give the text back.

    A null text has null chunks, an empty text one chunk of one empty line.
    """

    def measured(lines: Column) -> Column:
        return F.transform(lines, lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(MODULUS)).alias("h"), (_words(x) >= LONG).alias("long")))

    def boundary(known: Column) -> Callable[[Column], Column]:
        def ends_after(i: Column) -> Column:
            rolling = F.lit(0).cast("long")
            for k in range(WINDOW):
                before = F.coalesce(F.get(known, i - k)["h"], F.lit(0).cast("long"))
                rolling = F.pmod(rolling * F.lit(BASE) + before, F.lit(MODULUS))
            isolated = F.get(known, i)["long"] | F.coalesce(F.get(known, i + 1)["long"], F.lit(True))
            return isolated | (F.pmod(rolling, F.lit(DIVISOR)) == 0)

        return ends_after

    def sliced(lines: Column, ends: Column) -> Column:
        def chunk(end: Column, j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.get(ends, j - 1) + 1)
            return F.slice(lines, start + 1, end - start + 1)

        return F.transform(ends, chunk)

    def divided(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        return _let(measured(lines), lambda known: _let(F.filter(places, boundary(known)), lambda ends: sliced(lines, ends)))

    return F.when(text.isNotNull(), _let(F.split(text, "\n", -1), divided))


def _exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, pos, chunk, h) of the chunks that count: two lines with letters, or a long one.

    ``h`` has 128 bits, so that chunks of unlike bytes practically never share it.
    """
    rows = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    rows = rows.select("id", "digest", F.posexplode(chunks_of(F.col("text"))).alias("pos", "lines"))
    counts = (F.size(F.filter("lines", lambda x: F.trim(x) != "")) >= 2) | ((F.size("lines") == 1) & (_words(F.get("lines", F.lit(0))) >= LONG))
    rows = rows.filter(counts).select("id", "digest", "pos", F.array_join("lines", "\n").alias("chunk"))
    return rows.withColumn("h", F.struct(F.xxhash64("chunk").alias("a"), F.xxhash64(F.lit(1), "chunk").alias("b")))


def remove_repeated_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``df`` with chunks that occur before (by key, then place) taken out of ``text``.

    All columns and rows stay; ``removed``, if given, names a new column with the number of chunks
    taken out.  Null and empty texts stay as they are, and a text may become empty.
    Rows equal in key and text get the same result, as if they were one row.  Null
    keys come first.  Equal hashes are believed only after their bytes were compared:
    a hash with unlike bytes removes nothing.

    Small rows (hash, key, place) are counted map-side and joined; texts move twice, once
    to compare the bytes of repeated chunks and once to be cut.  Both joins are sort-merge
    joins at every size: the key lists grow with the table, so no plan hangs on their being small.
    """
    found = cut(_exploded(df, key, text).select("id", "digest", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b")))
    place = F.struct("id", "digest", "pos")
    # a text written under one key twice is one occurrence, so places are compared, not counted
    groups = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    groups = groups.filter(~F.col("first").eqNullSafe(F.col("last")))
    hits = cut(found.join(groups.select("a", "b", "first"), ["a", "b"]).withColumn("later", ~F.col("first").eqNullSafe(place)).drop("first"))
    holders = hits.groupBy("id", "digest").agg(F.collect_set("pos").alias("at"))

    # bytes of the repeated chunks, one smallest and one largest per hash
    texts = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text")).alias("t")
    texts = texts.join(holders.hint("merge").alias("h"), F.expr("t.id <=> h.id AND t.digest = h.digest")).select("t.id", "t.digest", "t.text", "h.at")
    picked = _let(chunks_of(F.col("text")), lambda chunks: F.transform("at", lambda p: F.array_join(F.get(chunks, p), "\n")))
    parts = texts.select(F.explode(picked).alias("chunk"))
    parts = parts.select(F.xxhash64("chunk").alias("a"), F.xxhash64(F.lit(1), "chunk").alias("b"), "chunk")
    same = parts.groupBy("a", "b").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).filter("low = high").select("a", "b")
    gone = hits.filter("later").join(same, ["a", "b"], "left_semi").groupBy("id", "digest").agg(F.collect_set("pos").alias("gone"))
    gone = cut(gone)

    digest, out = (unused(df, n) for n in ("digest__", "gone__"))
    docs = df.withColumn(digest, F.xxhash64(text))
    gone = gone.select(F.col("id").alias("key__"), F.col("digest").alias("mark__"), F.col("gone").alias(out))
    docs = docs.alias("d").join(gone.hint("merge").alias("g"), F.col(f"d.`{key}`").eqNullSafe(F.col("g.key__")) & (F.col(f"d.`{digest}`") == F.col("g.mark__")), "left")
    docs = docs.select("d.*", f"g.`{out}`")

    def rest(chunks: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), F.col(out))
        return F.array_join(F.flatten(F.transform(left, lambda j: F.get(chunks, j))), "\n")

    cleaned = _let(chunks_of(F.col(text)), rest)
    columns = [F.when(F.col(out).isNull(), F.col(text)).otherwise(cleaned).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    if removed:
        columns.append(F.coalesce(F.size(F.col(out)), F.lit(0)).alias(removed))
    return docs.select(columns)


def _filled_chunks(text: Column) -> Column:
    """Chunks of the lines with letters, as (pos, to, lines, rows, bridge).

    ``pos`` and ``to`` are the numbers of the first and last line, ``lines`` all lines between them, blank ones too; ``rows`` has number and
    length flag of each line with letters; ``bridge`` has the lines from the last one to the first of the next chunk, if any.
    """

    def known(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.pmod(F.xxhash64(x), F.lit(MODULUS)).alias("h"), (F.trim(x) != "").alias("full"), (_words(x) >= LONG).alias("long")))
        return F.filter(numbered, lambda n: n["full"])

    def ends(rows: Column) -> Column:
        def ends_after(i: Column) -> Column:
            rolling = F.lit(0).cast("long")
            for k in range(WINDOW):
                before = F.coalesce(F.get(rows, i - k)["h"], F.lit(0).cast("long"))
                rolling = F.pmod(rolling * F.lit(BASE) + before, F.lit(MODULUS))
            alone = F.get(rows, i)["long"] | F.coalesce(F.get(rows, i + 1)["long"], F.lit(True))
            return alone | (F.pmod(rolling, F.lit(DIVISOR)) == 0)

        places = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), ends_after)
        return F.when(F.size(rows) > 0, places).otherwise(F.array().cast("array<int>"))

    def between(lines: Column, a: Column, b: Column) -> Column:
        return F.slice(lines, a + 1, b - a + 1)

    def chunk(lines: Column, rows: Column, stops: Column) -> Callable[[Column, Column], Column]:
        def one(end: Column, j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.get(stops, j - 1) + 1)
            pos, to, after = F.get(rows, start)["at"], F.get(rows, end)["at"], F.get(rows, end + 1)["at"]
            inside = F.transform(F.slice(rows, start + 1, end - start + 1), lambda n: F.struct(n["at"].alias("at"), n["long"].alias("long")))
            bridge = F.when(after.isNotNull(), F.struct(to.alias("pos"), after.alias("to"), between(lines, to, after).alias("lines")))
            return F.struct(pos.alias("pos"), to.alias("to"), between(lines, pos, to).alias("lines"), inside.alias("rows"), bridge.alias("bridge"))

        return one

    def divided(lines: Column) -> Column:
        return _let(known(lines), lambda rows: _let(ends(rows), lambda stops: F.transform(stops, chunk(lines, rows, stops))))

    return _let(F.split(text, "\n", -1), divided)


def _run_hash(lines: Column) -> list[Column]:
    return [F.xxhash64(lines).alias("a"), F.xxhash64(F.lit(1), lines, F.size(lines)).alias("b")]


def _inside(chunk: Column) -> Column:
    """(off, end, a, b) of the smallest runs that count within a chunk: neighbouring lines with letters, and long lines."""
    rows, base = chunk["rows"], chunk["pos"]

    def run(start: Column, to: Column) -> Column:
        lines = F.slice(chunk["lines"], start - base + 1, to - start + 1)
        return F.struct((start - base).alias("off"), (to - base).alias("end"), *_run_hash(lines))

    firsts = F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0)))
    pairs = F.transform(firsts, lambda n, j: run(n["at"], F.get(rows, j + 1)["at"]))
    return F.concat(pairs, F.transform(F.filter(rows, lambda n: n["long"]), lambda n: run(n["at"], n["at"])))


def _mark(key: Column, digest: Column) -> Column:
    return F.pmod(F.xxhash64(key, digest), F.lit(MARKS)) + 1


def _split_by(docs: DataFrame, keys: DataFrame, key: Column, digest: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose (key, digest) may be an (id, digest) of ``keys``, and rows whose is not.

    What is broadcast is a bitmap of ``MARKS`` bits, however many keys there are.
    """
    bucket, bits, found = (unused(docs, n) for n in ("bucket__", "bits__", "found__"))
    own = _mark(F.col("id"), F.col("digest"))
    marked = keys.groupBy(F.bitmap_bucket_number(own).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias(bits))
    mark = _mark(key, digest)
    place = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    both = docs.withColumn(bucket, F.bitmap_bucket_number(mark)).join(F.broadcast(marked), bucket, "left").withColumn(found, is_set).drop(bucket, bits)
    return both.filter(F.col(found)).drop(found), both.filter(~F.col(found)).drop(found)


def remove_repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``df`` without the runs of lines in ``text`` that occur before, by key, then digest of the text, then line.

    A run counts that begins and ends in a line with letters and has two such lines or more, or is one line of at least
    ``LONG`` words.  A repeated run is covered by its pairs of neighbouring lines, each of them a repeated
    run itself, so chunks and pairs decide and no run has to be extended.  A pair of equal lines that overlaps its own
    first occurrence loses only its second line.  Every line taken out is left somewhere, but not always beside the same lines:
    where other runs take the first occurrence of a run apart, later ones still go.

    The pairs inside a chunk that was seen before occur in its first copy too, so only first copies list theirs.  Chunks and pairs are
    counted by hash and place, small rows that are added up before they are shuffled; texts are shuffled
    only where their (key, digest) may be among those wanted, which a bitmap of ``MARKS`` bits says, once to compare bytes and
    once to be cut.  Equal hashes are believed only after their bytes were compared: a hash with unlike bytes removes nothing.

    All columns and rows stay; ``removed``, if given, names a new column with the number of stretches of lines taken out.  Null and
    empty texts stay as they are, and a text may become empty.  Rows equal in key and text get the same result, as if
    they were one row.  Null keys come first.
    """
    rows = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), F.explode(_filled_chunks(F.col(text))).alias("c"))
    bridge = F.when(F.col("c.bridge").isNotNull(), F.struct(F.col("c.bridge.pos").alias("pos"), F.col("c.bridge.to").alias("to"), *_run_hash(F.col("c.bridge.lines"))))
    found = cut(rows.select("id", "digest", F.col("c.pos").alias("pos"), F.col("c.to").alias("to"), *_run_hash(F.col("c.lines")), _inside(F.col("c")).alias("inside"), bridge.alias("bridge")))

    place = F.struct("id", "digest", "pos", "to")
    chunks = found.filter(F.size("inside") > 0)
    groups = cut(chunks.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("inside").alias("inside")))
    later = ~F.col("first").eqNullSafe(place)
    again = groups.filter(~F.col("first").eqNullSafe(F.col("last"))).select("a", "b", "first")
    hits = chunks.select("id", "digest", "pos", "to", "a", "b").join(again, ["a", "b"])
    hits = hits.select("id", "digest", "pos", "to", "a", "b", later.alias("later"), F.lit(False).alias("own"))

    inner = groups.select(F.col("first.id").alias("id"), F.col("first.digest").alias("digest"), F.col("first.pos").alias("base"), F.explode("inside").alias("r"))
    inner = inner.select("id", "digest", (F.col("base") + F.col("r.off")).alias("pos"), (F.col("base") + F.col("r.end")).alias("to"), "r.a", "r.b")
    pairs = inner.union(found.filter("bridge IS NOT NULL").select("id", "digest", "bridge.pos", "bridge.to", "bridge.a", "bridge.b"))
    twice = pairs.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    own = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.digest") == F.col("digest")) & (F.col("first.to") == F.col("pos")) & (F.col("first.pos") < F.col("pos"))
    more = pairs.join(twice.select("a", "b", "first"), ["a", "b"])
    hits = cut(hits.union(more.select("id", "digest", "pos", "to", "a", "b", later.alias("later"), own.alias("own"))))
    forget(found, groups)

    # bytes of the repeated runs, one smallest and one largest per hash
    holders = hits.groupBy("id", "digest").agg(F.collect_set(F.struct("pos", "to")).alias("at"))
    texts = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    texts = _split_by(texts, hits, F.col("id"), F.col("digest"))[0].alias("t")
    texts = texts.join(holders.hint("merge").alias("h"), F.expr("t.id <=> h.id AND t.digest = h.digest")).select("t.text", "h.at")
    picked = _let(F.split("text", "\n", -1), lambda lines: F.transform("at", lambda p: F.slice(lines, p["pos"] + 1, p["to"] - p["pos"] + 1)))
    parts = texts.select(F.explode(picked).alias("lines")).select(*_run_hash(F.col("lines")), F.array_join("lines", "\n").alias("run"))
    same = parts.groupBy("a", "b").agg(F.min("run").alias("low"), F.max("run").alias("high")).filter("low = high").select("a", "b")
    gone = hits.filter("later").join(same, ["a", "b"], "left_semi")
    span = F.sequence(F.col("pos") + F.col("own").cast("int"), F.col("to"))
    gone = cut(gone.groupBy("id", "digest").agg(F.array_distinct(F.flatten(F.collect_set(span))).alias("gone")))

    digest, out = (unused(df, n) for n in ("digest__", "gone__"))
    touched, rest = _split_by(df.withColumn(digest, F.xxhash64(text)), gone, F.col(f"`{key}`"), F.col(f"`{digest}`"))
    gone = gone.select(F.col("id").alias("key__"), F.col("digest").alias("mark__"), F.col("gone").alias(out))
    docs = touched.alias("d").join(gone.hint("merge").alias("g"), F.col(f"d.`{key}`").eqNullSafe(F.col("g.key__")) & (F.col(f"d.`{digest}`") == F.col("g.mark__")), "left")
    docs = docs.select("d.*", f"g.`{out}`")

    def left(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out))
        return F.array_join(F.transform(numbers, lambda j: F.get(lines, j)), "\n")

    cleaned = _let(F.split(F.col(text), "\n", -1), left)
    columns = [F.when(F.col(out).isNull(), F.col(text)).otherwise(cleaned).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    as_is = [F.col(f"`{c}`") for c in df.columns]
    if removed:
        # a stretch starts at a line whose line before is not taken out
        starts = F.size(F.array_except(F.col(out), F.transform(F.col(out), lambda j: j + 1)))
        columns.append(F.coalesce(F.when(F.col(out).isNotNull(), starts), F.lit(0)).alias(removed))
        as_is.append(F.lit(0).alias(removed))
    return docs.select(columns).union(rest.select(as_is))
