"""Quality classifier by co-training two views.

One classifier reads the text's content (shares of kinds of words, hashed words), the other what
is known about the page (source, language, length, layout).  Both start from labelled rows.  In
every round each of them names the unlabelled rows of the whole table that it is sure of, and these train
the other one.  Both are then calibrated on labelled rows kept aside, and the two
calibrated views together score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, slices, small_batches, strings
from cairn.llm.near_text import word_hashes

#: Bound of the labelled rows that the classifiers are fitted on; pseudo-labels have none.
LABELLED = 12_000
#: Every fifth labelled row is kept aside for calibration.
ASIDE = 5
#: Rounds of exchange, and the calibrated probability from which a row counts as sure.
ROUNDS, SURE = 3, 0.97
#: The views, each with the one that teaches it.
VIEWS = {"content": "page", "page": "content"}
WORDS, SOURCES, LANGS = 128, 64, 16
#: Penalty on coefficients; weight of a class's pseudo-labels against its labelled rows, all together and one by one at most.
RIDGE, WEIGHT = 1.0, 0.5
STEPS, CLOSE = 25, 1e-6  # Newton steps at most, and the step at which they end
_SEGMENT = 1 << 20
_STATS = 14
_DRAWS = 1_000_003  # rows are drawn by a hash modulo this


def text_view(texts: list[str]) -> np.ndarray:
    """Content features of each text: shares of its words and bytes, zeros where there is no word."""
    parts: list[tuple[int, bytes]] = []
    for i, t in enumerate(texts):
        raw = t.encode()
        parts += [(i, raw[a:a + _SEGMENT]) for a in range(0, max(1, len(raw)), _SEGMENT)]
    sums = np.zeros((len(texts), _STATS + WORDS))
    start = 0
    while start < len(parts):
        end, size = start, 0
        while end < len(parts) and (end == start or size + len(parts[end][1]) <= _SEGMENT):
            size += len(parts[end][1])
            end += 1
        group = parts[start:end]
        np.add.at(sums, [i for i, _ in group], _summed([p for _, p in group]))
        start = end
    words, size = np.maximum(sums[:, :1], 1), np.maximum(sums[:, 1:2], 1)
    shares = np.concatenate([sums[:, 2:9] / words, sums[:, 9:_STATS] / size], axis=1)
    hashed = sums[:, _STATS:] / words
    more = np.concatenate([np.log1p(sums[:, :1]) / 10, size / words / 10, np.sqrt((hashed ** 2).sum(axis=1, keepdims=True))], axis=1)
    return np.concatenate([shares, np.sqrt(shares), more, np.sqrt(hashed)], axis=1).astype(np.float32)


def _summed(raws: list[bytes]) -> np.ndarray:
    """Per text: words, bytes, words by kind (7), bytes by kind (5), words by hash."""
    data = b" ".join(raws) + b" "
    raw = np.frombuffer(data, dtype=np.uint8)
    hashes, starts = word_hashes(data)
    inside = raw > 32
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])
    owner = np.searchsorted(bounds, starts, "right") - 1
    upper, letter = (raw >= 65) & (raw <= 90), ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    digit, wide = (raw >= 48) & (raw <= 57), raw >= 128
    count = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    n_upper, n_letter = count(upper), count(letter)
    caps, letters = n_upper[ends] - n_upper[starts], n_letter[ends] - n_letter[starts]
    last, length = raw[ends - 1], ends - starts
    repeat = np.zeros(len(starts), bool)
    repeat[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    kinds = [np.isin(last, list(b".,")), last == 33, np.isin(last, list(b"*%$#&@^~|<>=_")), (caps == letters) & (letters > 1), repeat, letters == 0, length > 14]
    n = len(raws)
    by_word = [np.bincount(owner, minlength=n), np.diff(bounds)] + [np.bincount(owner[k], minlength=n) for k in kinds]
    totals = [np.add.reduceat(x.astype(np.int64), bounds[:-1]) for x in (upper, letter, digit, wide, ~(letter | digit) & inside)]
    hashed = np.bincount(owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    return np.concatenate([np.stack([*by_word, *totals], axis=1), hashed], axis=1)


def page_view(source, lang, chars, lines) -> np.ndarray:
    """Metadata features: hashed source and language, logarithms of length, lines and length of a line."""
    def spot(value, n: int) -> int:
        return zlib.crc32(str(value).encode()) % n

    out = np.zeros((len(source), SOURCES + LANGS + 9), dtype=np.float32)
    rows = np.arange(len(source))
    out[rows, [spot(s, SOURCES) for s in source]] = 1
    out[rows, [SOURCES + spot(x, LANGS) for x in lang]] = 1
    c, n = np.log1p(np.asarray(chars, float)), np.log1p(np.asarray(lines, float))
    for i, x in enumerate((c / 10, n / 5, (c - n) / 10)):
        out[:, SOURCES + LANGS + 3 * i:SOURCES + LANGS + 3 * i + 3] = np.stack([x, x ** 2, x ** 3], axis=1)
    return out


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def _with_constant(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Curvature of the likelihood with its slope as last column; those of separate rows add up."""
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return np.concatenate([(x * (weight * p * (1 - p))[:, None]).T @ x, (x.T @ (weight * (y - p)))[:, None]], axis=1)


def _step(beta: np.ndarray, sums: np.ndarray, ridge: float) -> tuple[np.ndarray, bool]:
    """Coefficients after a Newton step, and whether it was small; the constant is not drawn to 0."""
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-6
    step = np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1] - penalty * beta)
    size = np.abs(step).max()
    return beta + step * min(1.0, 5.0 / max(1e-12, size)), size < CLOSE


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of a logistic regression by Newton steps; the last one is the constant."""
    x = _with_constant(x)
    beta = np.zeros(x.shape[1])
    for _ in range(STEPS):
        beta, done = _step(beta, _sums(x, y, np.ones(len(x)), beta), ridge)
        if done:
            break
    return beta


def linear(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


@dataclass
class View:
    """A classifier with its calibration (slope and constant on its own score)."""

    beta: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of good quality."""
        return np.clip(linear(linear(x, self.beta)[:, None], self.scale), -20, 20)


def _calibrated(beta: np.ndarray, aside: tuple[np.ndarray, np.ndarray]) -> View:
    return View(beta, fit(linear(aside[0], beta)[:, None], aside[1], ridge=0.1))


def _features(df: DataFrame, key: str, text: str, source: Column, lang: Column) -> DataFrame:
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in slices(batch, "text", _SEGMENT):
                texts = strings(b["text"])
                page = page_view(b["source"].fillna(""), b["lang"].fillna(""), [len(t) for t in texts], [t.count("\n") + 1 for t in texts])
                yield pd.DataFrame({"id": b["id"], "content": list(text_view(texts)), "page": list(page)})

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), source.cast("string").alias("source"), lang.cast("string").alias("lang"))
    return rows.mapInPandas(measured, "id long, content array<float>, page array<float>")


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x) for x in column]).astype(float)


def train(rows: DataFrame) -> tuple[View, View, np.ndarray] | float:
    """Both views and the weights that combine them, from rows (id, content, page, label or null).

    Where the labels do not hold both classes, the share of good ones instead (0.5 without labels).
    """
    drawn = F.xxhash64("id")
    known = rows.filter("label IS NOT NULL")
    n, good = known.agg(F.count("*"), F.coalesce(F.avg("label"), F.lit(0.5))).head()
    share = min(1.0, LABELLED / max(n, 1))
    some = known.filter(F.pmod(drawn, F.lit(_DRAWS)) < int(share * _DRAWS) + 1).orderBy(drawn, "id", "content", "page").limit(2 * LABELLED).toPandas().sort_values("id", kind="stable")
    y = some["label"].to_numpy(float)
    aside = np.arange(len(some)) % ASIDE == 0
    if min([*(np.bincount(part.astype(int), minlength=2).min() for part in (y[aside], y[~aside]))]) < 2:
        return float(good)
    views = {name: _matrix(some[name]) for name in VIEWS}
    held = {name: (x[aside], y[aside]) for name, x in views.items()}
    data = {name: _with_constant(x[~aside]) for name, x in views.items()}
    y = y[~aside]
    betas = {name: fit(x[~aside], y) for name, x in views.items()}
    models = {name: _calibrated(betas[name], held[name]) for name in VIEWS}
    unknown = rows.filter("label IS NULL").select(*VIEWS)
    for _ in range(ROUNDS):
        counts = {(r["teacher"], r["said"]): r["n"] for r in _sure_counts(unknown, models).collect()}
        if not counts:
            break
        weights = {(t, c): WEIGHT * min(1.0, (y == c).sum() / n) for (t, c), n in counts.items()}
        open_ = {pupil for pupil, teacher in VIEWS.items() if any(t == teacher for t, _ in weights)}
        for _ in range(STEPS):
            told = _sums_of_sure(unknown, models, {p: betas[p] for p in open_}, weights)
            for pupil in sorted(open_):
                betas[pupil], done = _step(betas[pupil], _sums(data[pupil], y, np.ones(len(y)), betas[pupil]) + told[pupil], RIDGE)
                if done:
                    open_.remove(pupil)
            if not open_:
                break
        models = {name: _calibrated(betas[name], held[name]) for name in VIEWS}
    both = np.stack([models[name].score(held[name][0]) for name in VIEWS], axis=1)
    return models["content"], models["page"], fit(both, held["page"][1], ridge=0.1)


def _said(model: View, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class that a view gives each row, and whether it is sure of it."""
    odds = model.score(x)
    return (odds > 0).astype(int), np.abs(odds) >= logit(np.array(SURE))


def _sure_counts(unknown: DataFrame, models: dict[str, View]) -> DataFrame:
    """(teacher, said, n): how many unlabelled rows each view is sure of, by class."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = {(name, c): 0 for name in models for c in (0, 1)}
        for b in batches:
            for name, model in models.items():
                if len(b):
                    said, sure = _said(model, _matrix(b[name]))
                    for c in (0, 1):
                        n[name, c] += int((sure & (said == c)).sum())
        yield pd.DataFrame([(*pair, k) for pair, k in n.items()], columns=["teacher", "said", "n"])

    parts = unknown.mapInPandas(counted, "teacher string, said int, n long")
    return parts.groupBy("teacher", "said").agg(F.sum("n").alias("n")).filter("n > 0")


def _sums_of_sure(unknown: DataFrame, models: dict[str, View], betas: dict[str, np.ndarray], weights: dict[tuple[str, int], float]) -> dict[str, np.ndarray]:
    """`_sums` for each pupil over all unlabelled rows that its teacher is sure of.

    A task hands on one matrix per pupil, whatever its rows; Spark adds them cell by cell.
    """
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {name: np.zeros((len(beta), len(beta) + 1)) for name, beta in betas.items()}
        for b in batches:
            for pupil, total in totals.items():
                if len(b):
                    teacher = VIEWS[pupil]
                    said, sure = _said(models[teacher], _matrix(b[teacher]))
                    if sure.any():
                        weight = np.array([weights.get((teacher, c), 0.0) for c in (0, 1)])[said[sure]]
                        total += _sums(_with_constant(_matrix(b[pupil][sure])), said[sure], weight, betas[pupil])
        for pupil, total in totals.items():
            yield pd.DataFrame({"pupil": pupil, "row": np.arange(len(total)), "sums": list(total)})

    parts = unknown.mapInPandas(summed, "pupil string, row int, sums array<double>")
    cells = parts.select("pupil", "row", F.posexplode("sums").alias("at", "x")).groupBy("pupil", "row", "at").agg(F.sum("x").alias("x")).toPandas()
    out = {name: np.zeros((len(beta), len(beta) + 1)) for name, beta in betas.items()}
    for pupil, part in cells.groupby("pupil"):
        out[pupil][part["row"], part["at"]] = part["x"]
    return out


def score_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = "source", lang: str | None = "lang", label: str = "quality") -> DataFrame:
    """(key, score, kept) of every row of ``df``: the probability of good quality, and whether it is at least 0.5.

    ``labels`` holds ``key`` and a 0/1 ``label`` for some rows; keys labelled both ways or null count as
    unlabelled.  Null texts count as empty, null metadata as a value of its own.  Repeated rows
    get equal scores; null keys are scored too.  Without labels of both classes every row gets their mean (0.5
    without any).  Extra columns are not read; an empty table gives no rows.

    The labelled rows fitted on are bounded (``LABELLED`` drawn by hash); the exchange takes every unlabelled
    row that a view is sure of, and features and scores cover the whole table.  Texts are read once,
    features once for each Newton step.
    """
    null = F.lit(None).cast("string")
    with small_batches(df.sparkSession, 2000):
        rows = cut(_features(df, key, text, F.col(source) if source else null, F.col(lang) if lang else null))
    said = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
    said = said.filter("label = other").select("id", F.col("label").cast("int").alias("label"))
    made = train(cut(rows.join(said, "id", "left")))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if isinstance(made, float):
                p = np.full(len(b), made)
            elif len(b):
                content, page, weights = made
                both = np.stack([content.score(_matrix(b["content"])), page.score(_matrix(b["page"]))], axis=1)
                p = 1 / (1 + np.exp(-linear(both, weights)))
            else:
                continue
            yield pd.DataFrame({"id": b["id"], "score": p, "kept": p >= 0.5})

    return rows.mapInPandas(scored, "id long, score double, kept boolean").withColumnRenamed("id", key)
