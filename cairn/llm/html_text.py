"""Main text of web pages by a recurrent labeller of blocks.

A page is a sequence of leaf blocks.  A block is a vector of its tag path (names of the open elements with their class, id
and role words, hashed), of its words (hashed) and of a few shares.  A bidirectional LSTM reads the
whole sequence, so each block is judged in the light of all before and behind it.

The model is trained on the driver, in numpy, on at most ``SAMPLE`` pages of the table and ``DRAWN`` drawn ones.
Labels of the table's pages come from their landmarks (an article or main element and what it holds); drawn pages lay
blocks of the sampled pages and stock phrases out in many forms, with and without landmarks and telling class
words, and are labelled by construction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import kept_by_worker, small_batches
from cairn.llm.html_blocks import Block, leaf_blocks
from cairn.llm.html_layouts import draw_page, landmark_label

#: Pages of the table that the model is fitted on, their longest, and pages drawn beside them.
SAMPLE, SAMPLE_CHARS, DRAWN = 192, 1 << 18, 900
#: Buckets of path and word vectors, shares beside them, and cells of the LSTM in each direction.
PATH, WORD, SHARES, CELLS = 160, 64, 8, 24
EPOCHS, BATCH, RATE, SEED = 20, 24, 0.006, 11
#: Blocks and pages that an LSTM pass takes at a time; a longer page goes alone.
CELLS_AT_ONCE = 1 << 14

_STOPS = ".,;:!?"


def _bucket(word: str, buckets: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % buckets, 1.0 if h >> 31 else -1.0


def _path_vector(path) -> np.ndarray:
    out = np.zeros(PATH, dtype=np.float32)
    tokens = {f"{kind}:{w}" for level in path for kind, w in zip(("tag", *["mark"] * len(level)), level)}
    if path:
        tokens |= {f"own:{w}" for w in path[-1]}
    if len(path) > 1:
        tokens |= {f"in:{w}" for w in path[-2]}
    for t in tokens:
        at, sign = _bucket(t, PATH)
        out[at] += sign
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    paths = kept_by_worker(("html paths", PATH), dict)
    words = kept_by_worker(("html words", WORD), dict)
    out = np.zeros((len(blocks), PATH + WORD + SHARES), dtype=np.float32)
    for i, b in enumerate(blocks):
        v = paths.get(b.path)
        if v is None:
            if len(paths) > 5000:
                paths.clear()
            v = paths[b.path] = _path_vector(b.path)
        out[i, :PATH] = v
        split = b.text.lower().split(" ")
        if len(words) > 200_000:
            words.clear()
        codes = [words.get(w) for w in split]
        for k, c in enumerate(codes):
            if c is None:
                at, sign = _bucket(split[k], WORD)
                codes[k] = words[split[k]] = 2 * at + (sign > 0)
        counts = np.bincount(codes, minlength=2 * WORD).astype(np.float32)
        balance = counts[1::2] - counts[::2]
        out[i, PATH:PATH + WORD] = balance / max(1.0, float(np.sqrt(balance @ balance)))
        chars, stops = len(b.text), sum(map(b.text.count, _STOPS))
        out[i, PATH + WORD:] = (
            np.log1p(chars) / 5, np.log1p(len(split)) / 4, min(1.0, b.linked / chars), min(1.0, 8 * stops / chars), b.text[-1] in _STOPS,
            i / len(blocks), np.log1p(len(blocks)) / 5, len(b.path) / 10)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one per direction, and a logistic unit over both; rows are blocks, padded at the end of a page."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, inputs: int, cells: int, rng) -> Labeller:
        w = {"out": rng.normal(0, 0.2, (2 * cells, 1)), "bias": np.zeros(1)}
        for d in "fb":
            w |= {f"x{d}": rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * cells)), f"h{d}": rng.normal(0, 1 / np.sqrt(cells), (cells, 4 * cells)), f"b{d}": np.zeros(4 * cells)}
            w[f"b{d}"][cells:2 * cells] = 1.0  # remember at first
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    @staticmethod
    def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Index that turns each page around within its own length."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def _run(self, pre: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        steps, n, cells = pre.shape[0], pre.shape[1], pre.shape[2] // 4
        h = c = np.zeros((n, cells), dtype=np.float32)
        out = np.empty((steps, n, cells), dtype=np.float32)
        for t in range(steps):
            z = pre[t] + h @ self.w[f"h{d}"]
            gates, g = _sigmoid(z[:, :3 * cells]), np.tanh(z[:, 3 * cells:])
            i, f, o = gates[:, :cells], gates[:, cells:2 * cells], gates[:, 2 * cells:]
            before, c = c, f * c + i * g
            tanh = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, tanh))
            h = out[t] = o * tanh
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text of each block of each page."""
        order = np.argsort([len(p) for p in pages], kind="stable")
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= CELLS_AT_ONCE:
                end += 1
            group = order[at:end]
            at = end
            lengths = np.array([len(pages[k]) for k in group])
            if not lengths[-1]:
                continue
            logits = self._logits([pages[k] for k in group], lengths)[0]
            for j, k in enumerate(group):
                out[k] = _sigmoid(logits[:lengths[j], j])
        return out

    def _logits(self, pages, lengths, keep: dict | None = None):
        steps, n = int(lengths.max()), len(pages)
        pre = {d: np.zeros((steps, n, len(self.w[f"b{d}"])), dtype=np.float32) for d in "fb"}
        for j, p in enumerate(pages):
            for d in "fb":
                pre[d][:len(p), j] = p @ self.w[f"x{d}"] + self.w[f"b{d}"]
        turn = self._turned(lengths, steps)
        columns = np.arange(n)
        states = {d: [] if keep is not None else None for d in "fb"}
        forward = self._run(pre["f"], "f", states["f"])
        backward = self._run(pre["b"][turn, columns], "b", states["b"])[turn, columns]
        both = np.concatenate([forward, backward], axis=2)
        if keep is not None:
            keep |= {"turn": turn, "states": states, "both": both}
        return (both @ self.w["out"])[:, :, 0] + self.w["bias"], keep

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        lengths = np.array([len(p) for p in pages])
        logits, kept = self._logits(pages, lengths, {})
        steps, n = logits.shape
        want, mask = np.zeros((steps, n), dtype=np.float32), np.arange(steps)[:, None] < lengths
        for j, y in enumerate(labels):
            want[:len(y), j] = y
        p = _sigmoid(logits)
        weight = mask / lengths / n  # each page counts alike
        loss = float(-(weight * (want * np.log(p + 1e-9) + (1 - want) * np.log(1 - p + 1e-9))).sum())
        slope = (weight * (p - want)).astype(np.float32)
        both, cells = kept["both"], kept["both"].shape[2] // 2
        grad = {"out": np.einsum("tnc,tn->c", both, slope)[:, None], "bias": np.array([slope.sum()], dtype=np.float32)}
        back, columns = slope[:, :, None] * self.w["out"][:, 0], np.arange(n)
        for d, part in (("f", back[:, :, :cells]), ("b", back[:, :, cells:])):
            if d == "b":
                part = part[kept["turn"], columns]
            dz, dh_w = np.empty((steps, n, 4 * cells), dtype=np.float32), np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros((n, cells), dtype=np.float32), np.zeros((n, cells), dtype=np.float32)
            for t in reversed(range(steps)):
                h, before, i, f, o, g, tanh = kept["states"][d][t]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tanh * tanh)
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dh_w += h.T @ dz[t]
                dh, dc = dz[t] @ self.w[f"h{d}"].T, dc * f
            if d == "b":
                dz = dz[kept["turn"], columns]
            dx = np.zeros_like(self.w[f"x{d}"])
            for j, x in enumerate(pages):
                dx += x.T @ dz[:len(x), j]
            grad |= {f"x{d}": dx, f"h{d}": dh_w, f"b{d}": dz.sum(axis=(0, 1))}
        return loss, grad

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, rng) -> float:
        """Adam over batches of pages of similar length; the last epoch's mean loss."""
        first, second, turn, loss = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0, 0.0
        for epoch in range(epochs):
            order = np.argsort([len(p) + rng.random() * 8 for p in pages])
            batches = [order[s:s + BATCH] for s in range(0, len(order), BATCH)]
            losses = []
            for b in rng.permutation(len(batches)):
                inputs = [pages[k] * (rng.random(pages[k].shape) > 0.1) for k in batches[b]]  # a tenth of the evidence is missing
                loss, grad = self.gradients(inputs, [labels[k] for k in batches[b]])
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                turn += 1
                rate = RATE * (0.2 if epoch >= 0.7 * epochs else 1.0) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
                for k, g in grad.items():
                    g = g / max(1.0, norm)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def fit(pages: list[str], drawn: int = DRAWN, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller from sampled pages, whose landmarks label them, and drawn ones."""
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(leaf_blocks, pages) if b]
    labelled = [(b, y) for b in parsed if (y := landmark_label(b)) is not None]
    pool = [b.text for blocks in parsed for b in blocks]
    labelled += [draw_page(rng, pool) for _ in range(drawn)]
    x, y = [vectors(b) for b, _ in labelled], [np.array(labels, dtype=np.float32) for _, labels in labelled]
    model = Labeller.fresh(PATH + WORD + SHARES, CELLS, rng)
    model.train(x, y, epochs, rng)
    return model


def sampled(df: DataFrame, html: str = "html", most: int = SAMPLE) -> list[str]:
    """At most ``most`` different pages of at most ``SAMPLE_CHARS`` characters, those with the smallest hashes.

    Hashes are drawn first, so that tasks send whole pages to the driver for those alone.
    """
    page = F.col(f"`{html}`")
    some = df.select(page.alias("page"), F.xxhash64(page).alias("h")).filter((F.length(page) > 0) & (F.length(page) <= SAMPLE_CHARS))
    least = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(most).collect()]
    picked = some.filter(F.col("h").isin(least)).groupBy("h").agg(F.min("page").alias("page"))
    return [r["page"] for r in picked.orderBy("h").collect()]


def main_text(blocks: list[Block], scores: np.ndarray) -> str:
    return "\n\n".join(b.text for b, p in zip(blocks, scores) if p >= 0.5)


def extract(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", model: Labeller | None = None) -> DataFrame:
    """Columns ``keep``, then ``text``, the blocks of main text joined by blank lines, and ``n_chars``, its characters.

    ``model`` is fitted on the table if not given.  A null, empty or unreadable page has an empty text; markup that is
    left open is read as browsers do; very long pages are read whole, in memory that grows with their blocks; repeated rows
    get the same text each; other columns do not matter, whatever their names.  An empty table gives no rows.
    """
    weights = (model or fit(sampled(df, html))).w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights)
        for batch in batches:
            pages = [leaf_blocks(p) for p in batch["page__"].to_pylist()]
            scores = labeller.scores([vectors(p) for p in pages])
            texts = [main_text(p, s) for p, s in zip(pages, scores)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    columns = df.select(*[F.col(f"`{c}`") for c in keep])
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema] + ["text string", "n_chars bigint"])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("page__")).mapInArrow(run, shape)
