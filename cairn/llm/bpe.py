"""Byte-pair encoding by a queue of merge ranks, and decoding by joining vocabulary strings.

A word is a doubly linked list of symbols.  Every neighbouring pair that may merge
lies in a heap by (rank, place); a popped entry whose symbols have changed since is
stale and skipped.  Cost is n log n for a word of n bytes, so a word of a million
letters is no trouble.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import kept_by_worker, runs, strings

#: Words remembered by one worker; beyond that it forgets all and starts again.
MEMO = 600_000
#: Fixed value: how byte-level BPE cuts text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others take the letters from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def latin_words() -> re.Pattern:
    """``WORDS`` for texts of Latin-1 characters alone, its classes listed for the standard library's matcher, which is quicker."""
    kinds = (r"\p{L}", r"\p{N}", r"\s")
    letters, digits, white = ("".join(re.escape(c) for c in map(chr, range(256)) if regex.match(kind, c)) for kind in kinds)
    listed = WORDS.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{digits}]").replace(r"\S", f"[^{white}]")
    for kind, chars in zip(kinds, (letters, digits, white)):
        listed = listed.replace(kind, f"[{chars}]")
    return re.compile(listed)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Known(dict):
    """Ids of words as bytes, made when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        return self.make(word)


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file (as JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not plain or model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE files without normalizer are read")
        vocab, letters = model["vocab"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.strings[i] = bytes(of_letter[c] for c in token)
        self.first = [vocab[c] for c in letters]
        self.left, self.right, self.merged, self.rank = [], [], [], {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] * self.size + vocab[b]] = len(self.left)
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.merged.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.strings[i] = content.encode()
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.words, self.latin = regex.compile(WORDS), latin_words()
        self.memo = _Known(self._word)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        size, rank, left, right, merged = self.size, self.rank, self.left, self.right, self.merged
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := rank.get(ids[i] * size + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            r, i = entry >> 40, entry & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] != left[r] or j < 0 or ids[j] != right[r]:
                continue  # stale: a neighbour has merged meanwhile
            ids[i], ids[j] = merged[r], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (q := rank.get(ids[i] * size + ids[k])) is not None:
                    heappush(heap, q << 40 | i)
            h = before[i]
            if h >= 0 and (q := rank.get(ids[h] * size + ids[i])) is not None:
                heappush(heap, q << 40 | h)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        found = pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of added tokens in it become those tokens."""
        parts = self.cut.split(text) if self.cut and any(a in text for a in self.added) else [text]
        out: list[bytes] = []
        known, words_in = self.memo.__getitem__, self.latin if _latin(text) else self.words
        for part in parts:
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
                continue
            for words in runs(words_in, part):
                out.append(b"".join(map(known, words)))
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids) -> str:
        """Vocabulary strings end to end; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def _lists(ids: pa.ListArray) -> list[list[int]]:
    """Rows without a null list as Python lists."""
    ends = ids.offsets.to_numpy()
    values = ids.flatten().to_numpy(zero_copy_only=False).tolist()
    return [values[a:z] for a, z in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist())]


def _shared(df: DataFrame, path: str):
    """The vocabulary file (a few MB, whatever the data) for the workers."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row of ``df``, encoded with the vocabulary at ``path``.

    A null or empty text has no ids.  Repeated rows and null keys each keep their
    row; other columns are not read.  An empty table gives an empty result.
    """
    source = _shared(df, path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_by_worker(("bpe", path), lambda: Bpe(source.value))
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids = [bpe.encode(t) for t in strings(part["t"].to_pylist())]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(np.concatenate(ids).astype("i4")))
                yield pa.RecordBatch.from_arrays([part["k"], lists], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(encoded, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", into: str = "decoded") -> DataFrame:
    """(key, ids, ``into``) with the text of the ids; null ids count as none, ids outside the vocabulary raise."""
    source = _shared(df, path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_by_worker(("bpe", path), lambda: Bpe(source.value))
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                lists = [[] if x is None else x for x in part["ids"].to_pylist()] if part["ids"].null_count else _lists(part["ids"])
                if any(x and min(x) < 0 for x in lists):
                    raise ValueError("negative token id")
                texts = pa.array([bpe.decode(x) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([part["k"], part["ids"], texts], names=["k", "ids", "t"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
    return rows.mapInArrow(decoded, f"k {kind}, ids array<int>, t string").toDF(key, "ids", into)
