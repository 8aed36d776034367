"""Encoding with the tokenizers library, remembering what it said about each run of letters.

Text is cut only where the library's own word splitting cuts in any case (before or
between white space, after a word that a stop follows), every distinct piece goes through the library once per
worker, and pieces are sent to it many at a time, parted by an added token.
"""

from __future__ import annotations

import json
import re
from struct import pack

import numpy as np

from cairn.llm.bpe import byte_letters
from cairn.llm.common import runs

#: Pieces remembered by one worker; beyond that it forgets those longer than ``KEEP``, or all.
MEMO, KEEP = 500_000, 9
_LETTERS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
#: A word of Latin letters before a stop or comma that ends its run: the letters are a piece, the rest another.
PLAIN = rf"{_LETTERS}(?=[.,!?]*(?:[ \n]|\Z))"
#: The same before any ASCII marks but those that added tokens begin with: byte level parts letters from all of them.
MARKED = rf"{_LETTERS}(?=[!-/:;=?@\[-`{{}}~]*(?:[ \n]|\Z))"


_STOPPED = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,!?]+)")
#: White space to Python's split alone.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Library:
    """Exact ids of whole texts for a tokenizer file (as JSON text), added tokens read as such."""

    def __init__(self, source: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        spec["truncation"] = spec["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        pre = spec["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [pre])
        model = spec["model"]
        byte_level = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        # with word ends, white space removed and nothing added in front, white space parts all words
        parted = bool(model.get("end_of_word_suffix")) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed"
        added = [t for t in spec["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]))]
        lowers = parted and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps[-1]["type"] == "ByteLevel"
        parted = lowers and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        safe = bool(added) and len(added) == len(spec["added_tokens"]) and model["type"] == "BPE" and not model.get("dropout")
        self.pieces = None
        if safe and byte_level:
            # one line end between a run and a word of letters is a piece, and the word another
            word = MARKED if all(t["content"].startswith("<|") for t in added) else PLAIN
            self.pieces = re.compile(rf"(?: |^|(?<=\n)){word}|\n(?={word})|\s*\S+|\s+")
        elif safe and parted:
            self.pieces = re.compile(rf"(?<![^ \n\t\r]){PLAIN}|[^ \n\t\r]+")
        # a run of Latin-1 letters is one word of the model: it may be asked without the steps before it
        self.word = re.compile(r"{}[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+\Z".format(" ?" if byte_level else ""))
        self.lower = parted and not byte_level
        self.blank = " " if byte_level else ""
        self.letters = byte_letters()
        if added:
            self.mark, self.mark_id = added[0]["content"], added[0]["id"]
        self.memo: dict[str, bytes] = {}
        self.most = memo

    def _learn(self, new: list[str]) -> None:
        if self.lower:  # a word and the stops after it are asked for apart
            parts = {p: m for p in new if (m := _STOPPED.fullmatch(p))}
            inner = {x for m in parts.values() for x in m.groups()}.difference(self.memo)
            self._learn_plain(list(inner.union(new).difference(parts)))
            for p, m in parts.items():
                self.memo[p] = self.memo[m[1]] + self.memo[m[2]]
        else:
            self._learn_plain(new)

    def _learn_plain(self, new: list[str]) -> None:
        words = [p for p in new if (p.removeprefix(self.blank).isalpha() if p.isascii() else self.word.match(p))]
        self._ask(words)
        new = list(set(new).difference(words))
        with_mark = [p for p in new if self.mark in p]
        plain = [p for p in new if self.mark not in p]
        for p in with_mark:
            self.memo[p] = np.array(self._ids(p), dtype="<u4").tobytes()
        for start in range(0, len(plain), 2000):
            part = plain[start:start + 2000]
            ids = np.array(self._ids(self.mark.join(part)), dtype="<u4")
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(ends) != len(part):
                raise RuntimeError("the tokenizer did not keep the parting token")
            raw, begin = ids.tobytes(), 0
            for p, end in zip(part, ends):
                self.memo[p] = raw[4 * begin:4 * end]
                begin = end + 1

    def _ask(self, words: list[str]) -> None:
        """Words straight to the model, each byte as the letter that stands for it."""
        tokenize, blank = self.tokenizer.model.tokenize, self.letters[32]
        letters = dict(enumerate(self.letters))
        for w in words:
            inner = w.lower() if self.lower else w
            inner = inner.replace(" ", blank) if inner.isascii() else inner.encode().decode("latin-1").translate(letters)
            self.memo[w] = pack(f"<{len(found := tokenize(inner))}I", *[t.id for t in found])

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.pieces is None:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out, group, size = [], [], 0
        for t in texts:
            pieces = None
            if self.lower and "<|" not in t and _latin(t):
                t = t.lower()  # as the tokenizer does first; fewer pieces to remember
                pieces = None if _SEPARATORS.search(t) else t.split()
            if len(t) > 1 << 20:  # a very long text: its pieces are taken in parts
                out += self._group(group)
                group, size = [], 0
                out.append(b"".join(b"".join(self._group([part])) for part in runs(self.pieces, t)))
                continue
            group.append(self.pieces.findall(t) if pieces is None else pieces)
            size += len(t)
            if size > 1 << 20:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[list[str]]) -> list[bytes]:
        new = set().union(*texts).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.most:  # short words are the ones that come again
                short = {p: ids for p, ids in self.memo.items() if len(p) <= KEEP}
                self.memo = short if 2 * len(short) < self.most else {}
                new = set().union(*texts).difference(self.memo)
            self._learn(list(new))
        known = self.memo.__getitem__
        return [b"".join(map(known, pieces)) for pieces in texts]
