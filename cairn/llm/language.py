"""Language identification by fusing evidence.

Four sources speak about a row's language: the letters of its text (byte trigrams), the language its
markup declares, the suffix of its address, and the host it comes from.  Text models
are counted from rows with a declared language.  The text's own posteriors are then summed by declared
value, suffix, domain and host; from these sums come how reliable a declaration or suffix is and
a prior for every host, drawn to its domain's and that one to the whole table's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, release_kept, slices, small_batches, strings, unused

#: A language is a tag that more than one row and at least this share of the declaring rows declare, so there
#: are 200 at most and their models a bounded broadcast; ``languages`` names others.
LEAST = 1 / 200
#: Languages named where no row declares any.
LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 15
#: Added to every trigram count, to declared and suffix counts, and rows' worth of the wider prior in a host's.
SMOOTH, TRUST, PULL = 0.5, 1.0, 10.0
#: Neighbouring trigrams say much the same: a text counts as a third of its trigrams, 60 at most.
SHARE, MOST = 1 / 3, 60.0
#: Rows below this posterior, or whose trigrams are less likely than chance, are rejected.
CONFIDENCE = 0.5
#: So are rows whose mean log likelihood lies more than ``REACH`` spreads below what is usual in their language.  The spread of
#: a mean over n trigrams is that of one, times the root of 1 / n + 1 / ``ALIKE``: however long, a text keeps a manner of its own.
#: On a third of sf0.1 no row of a language that has a model is that far off, and 98.6 % or more of the rows of one that has none are.
REACH, ALIKE = 12.0, 30.0
_UNIT = 1_000_000  # posteriors are summed as whole millionths, so that sums do not depend on their order
_PART = 1 << 18  # bytes of text that a task holds as arrays at a time, some 50 bytes for each
#: Letters of ASCII in lower case, other ASCII as space, other bytes as they are.
_FOLD = bytes(b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else 32 if b < 128 else b for b in range(256))


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every byte trigram with at most one space, ``_PART`` bytes of text at a time."""
    parts: list[tuple[int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        raw = b" " + t.lower().encode().translate(_FOLD) + b" "
        for a in range(0, max(1, len(raw) - 2), _PART):  # parts share two bytes, so no trigram is lost
            parts.append((i, raw[a:a + _PART + 2]))
            size += len(parts[-1][1])
            if size > _PART:
                yield _coded(parts)
                parts, size = [], 0
    if parts:
        yield _coded(parts)


def _coded(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"  ".join(p for _, p in parts), dtype=np.uint8)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat([i for i, _ in parts], [len(p) + 2 for _, p in parts])[:len(raw) - 2]
    space = raw == 32
    good = space[:-2].astype(np.int8) + space[1:-1] + space[2:] < 2
    x = raw.astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return owner[good], code[good].astype(np.int64)


def declared_languages(df: DataFrame, declared: str) -> tuple[str, ...]:
    """The languages that a table declares, in the order of their tags (see ``LEAST``)."""
    tags = df.select(_tag(F.col(declared)).alias("tag")).filter(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("n"))
    rows = tags.collect()  # tags of two or three letters: 18,252 at most
    least = max(2, LEAST * sum(r["n"] for r in rows))
    return tuple(sorted(r["tag"] for r in rows if r["n"] >= least)) or LANGUAGES


def usual(counts: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of a trigram's log probability in each language's own texts; 0 for a language without texts."""
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    mean = (share * model).sum(axis=1)
    return mean, np.sqrt(np.maximum((share * model**2).sum(axis=1) - mean**2, 0.0))


def far_off(mean: np.ndarray, n: np.ndarray, common: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Whether mean log likelihoods of texts of n trigrams lie too far below what is usual in their language."""
    return mean < common - REACH * spread * np.sqrt(1 / np.maximum(n, 1) + 1 / ALIKE) - 1e-9


def train(df: DataFrame, text: str, declared: str, languages: tuple[str, ...] = LANGUAGES) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities and counts (language x bucket) from all rows with a declared language.

    Counts are summed in the tasks first; what reaches the driver is one number per language and bucket.
    """
    number = {lang: i for i, lang in enumerate(languages)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_kept()
        n = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for b in slices(batch, "text", _PART):
                lang = b["lang"].map(number).to_numpy()
                for owner, code in trigrams(strings(b["text"])):
                    n += np.bincount(lang[owner] * BUCKETS + code, minlength=n.size).reshape(n.shape)
        lang, code = np.nonzero(n)
        yield pd.DataFrame({"lang": lang, "code": code, "n": n[lang, code]})

    rows = df.select(F.col(text).cast("string").alias("text"), _tag(F.col(declared)).alias("lang")).filter(F.col("lang").isin(*languages))
    with small_batches(df.sparkSession):
        got = rows.mapInPandas(counted, "lang long, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(languages), BUCKETS))
    n[got["lang"].astype(int), got["code"].astype(int)] = got["n"]
    return np.log((n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)), n


def _tag(declared: Column) -> Column:
    """Primary part of a language tag in lower case; empty is no declaration."""
    tag = F.lower(F.regexp_extract(F.trim(declared.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(tag != "", tag)


def evidence(model: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log likelihood of each text's trigrams for each language, and their number."""
    sums, n = np.zeros((len(texts), len(model))), np.zeros(len(texts))
    for owner, code in trigrams(texts):
        n += np.bincount(owner, minlength=len(texts))
        for k, logs in enumerate(model):
            sums[:, k] += np.bincount(owner, weights=logs[code], minlength=len(texts))
    return sums / np.maximum(n, 1)[:, None], n


def softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def said_by_text(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log likelihoods with neighbouring trigrams taken for one voice."""
    return mean * np.minimum(n * SHARE, MOST)[:, None]


def fuse(mean: np.ndarray, n: np.ndarray, counts: dict[str, np.ndarray], known: dict[str, np.ndarray], total: np.ndarray, kinds: dict[str, int]) -> np.ndarray:
    """Posteriors (row x language) from the text and, for each kind of evidence, the expected rows of each
    language that share the row's value (the row itself among them)."""
    logs = said_by_text(mean, n)
    own, prior = softmax(logs), total / total.sum()
    others = {k: np.maximum(c - own, 0.0) * known[k][:, None] for k, c in counts.items()}
    for k in ("declared", "suffix"):
        rate = (others[k] + TRUST) / (total + TRUST * kinds[k])
        logs = logs + np.where(known[k][:, None], np.log(rate), 0.0)
    wide = (others["domain"] + PULL * prior) / (others["domain"].sum(axis=1, keepdims=True) + PULL)
    near = (others["host"] + PULL * wide) / (others["host"].sum(axis=1, keepdims=True) + PULL)
    return softmax(logs + np.log(near))


def identify(df: DataFrame, text: str = "text", declared: str = "lang", host: str | None = "source", domain: str | None = None,
             suffix: str | None = None, languages: tuple[str, ...] | None = None, into: tuple[str, str, str] = ("language", "confidence", "accepted")) -> DataFrame:
    """``df`` with the most probable language, its posterior, and whether the row is accepted.

    Languages are those that the table declares (`declared_languages`) unless ``languages`` names them.
    A row is rejected (``accepted`` false, the language still named) when its text has no letters, when its
    posterior is below ``CONFIDENCE``, when its trigrams are less likely in the language
    than evenly drawn ones, or far less likely than that language's own usually are (`far_off`).  Null or unknown evidence of any kind says nothing; a null text counts as
    empty.  Every row, repeated ones too, keeps its place; ties go to the first language listed.  A table
    without declared languages has even models and rejects by confidence.  The names ``into`` must be new.

    Evidence is summed map-side; the join with hosts, whose number grows with the data, is left to
    Spark's size checks and skew splitting.
    """
    if {c.lower() for c in into} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {into} exist")
    languages = tuple(languages) if languages else declared_languages(df, declared)
    model, counts = train(df, text, declared, languages)
    common, spread = usual(counts, model)
    kinds = ("declared", "suffix", "domain", "host")
    null = F.lit(None).cast("string")
    named = {"declared": _tag(F.col(declared)), "suffix": F.col(suffix) if suffix else null, "domain": F.col(domain) if domain else null, "host": F.col(host) if host else null}
    named = {k: v.cast("string") for k, v in named.items()}

    @F.pandas_udf("array<long>")
    def own_posteriors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_kept()
        for batch in batches:
            out = []
            for b in slices(batch.to_frame("text"), "text", _PART):
                out += list(np.rint(softmax(said_by_text(*evidence(model, strings(b["text"])))) * _UNIT).astype(np.int64))
            yield pd.Series(out, dtype=object)

    with small_batches(df.sparkSession):
        own = cut(df.select(*[c.alias(k) for k, c in named.items()], own_posteriors(F.col(text).cast("string")).alias("p")))
    sums = [F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0)) for i in range(len(languages))]
    total = np.array(own.agg(*sums).head()) / _UNIT + 1.0
    tables = {k: cut(own.filter(F.col(k).isNotNull()).groupBy(k).agg(F.array(*sums).alias("rows"))) for k in kinds}
    values = {k: tables[k].count() + 1 for k in ("declared", "suffix")}

    @F.pandas_udf("language string, confidence double, accepted boolean")
    def fused(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        release_kept()
        for batch in batches:
            frame = pd.concat(batch, axis=1, keys=["text", *kinds])
            for b in slices(frame, "text", _PART):
                mean, n = evidence(model, strings(b["text"]))
                known = {k: b[k].notna().to_numpy() for k in kinds}
                counts = {k: np.array([r if r is not None else [0] * len(languages) for r in b[k]], dtype=float) / _UNIT for k in kinds}
                p = fuse(mean, n, counts, known, total, values)
                top = p.argmax(axis=1)
                best, rows = p.max(axis=1), np.arange(len(p))
                said = mean[rows, top]
                accepted = (n > 0) & (best >= CONFIDENCE) & (said >= -np.log(BUCKETS)) & ~far_off(said, n, common[top], spread[top])
                yield pd.DataFrame({"language": [languages[i] for i in top], "confidence": best, "accepted": accepted})

    names = {k: unused(df, f"{k}__") for k in kinds}
    out = df.withColumns({names[k]: c for k, c in named.items()})
    for k, t in tables.items():
        t = t.select(F.col(k).alias(f"{names[k]}v"), F.col("rows").alias(f"{names[k]}n"))
        out = out.join(t, F.col(names[k]) == F.col(f"{names[k]}v"), "left")
    found = unused(df, "found__")
    out = out.withColumn(found, fused(F.col(text).cast("string"), *[F.col(f"{names[k]}n") for k in kinds]))
    picked = [F.col(f"{found}.{a}").alias(b) for a, b in zip(("language", "confidence", "accepted"), into)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *picked)


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, domain, suffix) of web pages: markup taken off, parts of the address apart."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-zA-Z0-9#]+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.when(host != "", host)
    domain = F.substring_index(host, ".", -2)
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    return pages.select("page_id", bare.alias("text"), declared.alias("declared"), host.alias("host"), domain.alias("domain"), F.substring_index(host, ".", -1).alias("suffix"))
