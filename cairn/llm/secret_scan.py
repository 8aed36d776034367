"""Secret scan: fixed patterns, and literals assigned to sensitive names.

Besides the patterns, every ``name = value`` or ``name: value`` of source code, JSON, YAML,
INI or shell lines, and every XML element, is read as a pair of a name and an expression.
A target may be an attribute, a subscript (``a["name"]``, ``name[]``) or a declaration with
its type (``name: str =``, ``const name string =``).  An expression is a chain of string
literals, earlier names and bare words joined by ``+``, in brackets and over lines too; names
that hold literals are followed through the text, also by ``+=``, ``{name}`` and ``$name``, so a
secret put together from parts or handed on under another name is found where its parts are
written.  A called function is no value; the literals after its first argument are.  A literal
counts by its target's name, its length and how random it looks; one of several words does not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import strings

# The base patterns, by kind in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs are maximal, so the length may stand in the pattern
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")

#: How telling the words of a target's name are.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.9, "private": 0.5, "access": 0.4, "api": 0.4,
             "key": 0.5, "signing": 0.4, "encryption": 0.4, "client": 0.1}
#: Words that say the value is no secret but its place, kind or age.
HARMLESS = {"name", "file", "path", "url", "uri", "type", "count", "length", "size", "limit", "expiry", "ttl", "hint", "label", "field", "id"}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|none|null|true|false|undefined|changeme|example.*|your[-_ ].*|<.*>|\$\{.*\}|%\(.*|todo.*)$")
THRESHOLD = 1.3
MIN_LENGTH = 8

_SIGN = re.compile(r":=|=>|[=:]")
_BACKWARDS = re.compile(r"[\w.$-]*+")
_TYPE = re.compile(r"[ \t]*(?:&[ \t]*)?(?:'\w+[ \t]+)?(?:mut[ \t]+)?[A-Za-z_][\w.]*+(?:[<\[][^\n=]*[>\]])?[?!]?[ \t]*(?:\|[^\n=]*)?$")
_DECLARED = re.compile(r"\b(?:const|var)[ \t]+([\w.]++)[ \t]+\*?(?:string|String|str|text|bytes)[ \t]*$")
_LEAD = re.compile(r"\s*+(?:\(\s*+)*+(?=[rbufRBUF]{0,2}[\"'`])")
_TRIPLE = re.compile(r"[ \t]*+[rbufRBUF]{0,2}+(\"\"\"|\'\'\')")
_KEY = re.compile(r"[ \t]*+[:=]")
_BLOCK = re.compile(r"[ \t]++[|>][-+]?[ \t]*+\n([ \t]++)(?=\S)")
_LINE = re.compile(r"\S++(?=[ \t\r]*+(?:\n|\Z))")
_ARGUMENTS = re.compile(r"""\((?:[^()"'\n]++|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')*+\)""")
_LITERAL = re.compile(r""",[ \t]*+(?:\w++[ \t]*+=[ \t]*+)?(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')[ \t]*+(?=[,)])""")
_REFERENCE = re.compile(r"\$?\{([A-Za-z_][\w.]*+)\}|\$([A-Za-z_]\w*+)")
_ELEMENT = re.compile(r"<([\w.:-]++)(?:\s[^<>]*+)?>\s*+([^<>\s]++)\s*+</\1\s*+>")
_PART = re.compile(r"""[ \t]*+(?:[rbuf]?"((?:[^"\\\n]|\\.)*+)"|[rbuf]?'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|(?=([A-Za-z0-9_$.+/=~!@%^&-])))""")
_RUN = re.compile(r"[A-Za-z0-9_$.+/=~!@%^&-]++")
_WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*+")
_PLUS = re.compile(r"[ \t]*+(?:\+|\.\.|&)[ \t]*+")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def name_score(name: str) -> float:
    """0 for a harmless name up to about 1.5 for one that says secret."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    joined = "".join(words[-2:])
    return min(1.5, max(sum(SENSITIVE.get(w, 0.0) for w in set(words)), SENSITIVE.get(joined, 0.0)))


def literal_score(value: str) -> float:
    """0 for words and placeholders up to 1 for a long value with many different letters and digits."""
    if len(value) < MIN_LENGTH or PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, bits / 5 + 0.15 * (classes - 1)) * (1.0 if classes > 1 else 0.5)  # letters of one kind are mostly words


class _Value:
    """Text of an expression as a graph of its parts, so that a value built from values is never written out.

    ``n`` and ``counts`` are the length and the characters of the whole; ``spans`` are literals, ``parts`` other values.
    """

    __slots__ = ("n", "counts", "spans", "parts", "short", "edges")

    def __init__(self, counts: list[Counter], spans: list[tuple[int, int]], parts: list[_Value], order: list) -> None:
        self.counts = Counter()
        for c in counts:
            self.counts.update(c)
        for p in parts:
            self.counts.update(p.counts)
        self.n, self.spans, self.parts = sum(self.counts.values()), spans, parts
        if self.n > 1 << 60:  # a value that doubles itself: only the shares of the characters matter
            self.counts = Counter({k: max(1, c >> 20) for k, c in self.counts.items()})
            self.n = sum(self.counts.values())
        pieces = [p if isinstance(p, str) else p.short if isinstance(p, _Value) else None for p in order]
        head, last, lead, trail, blank = "", "", 0, 0, True
        for p in order:
            h, z, a, b, none = p.edges if isinstance(p, _Value) else _edges(p)
            head, last, lead = (head + h)[:16], z or last, lead + a if blank else lead
            trail, blank = trail + b if none else b, blank and none
        self.edges = head, last, lead, trail, blank
        joined = None if any(p is None for p in pieces) else "".join(pieces)
        self.short = joined if joined is not None and len(joined) <= 4096 else None

    def score(self) -> float:
        """`literal_score` of the text; that of a text over 4096 characters from its characters and ends."""
        if self.short is not None:
            return literal_score(self.short)
        head, last, lead, trail, _ = self.edges
        one = len({c.lower() for c in self.counts}) == 1
        told = PLACEHOLDER.match(head + last)
        if self.counts[" "] > lead + trail or told and (one or len(set((head + last).lower())) > 1):
            return 0.0
        bits = -sum(c / self.n * math.log2(c / self.n) for c in self.counts.values())
        letters = "".join(self.counts)
        classes = sum(bool(re.search(p, letters)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
        return min(1.0, bits / 5 + 0.15 * (classes - 1)) * (1.0 if classes > 1 else 0.5)


def _edges(part: str | tuple[str, str]) -> tuple[str, str, int, int, bool]:
    """First 16 characters, last one, blanks before and after the text, and whether there is nothing else; a pair is a long bare word's ends."""
    if isinstance(part, tuple):
        return *part, 0, 0, False
    before, after = part[:len(part) - len(part.lstrip())], part[len(part.rstrip()):]
    return part[:16], part[-1:], before.count(" "), after.count(" "), not part.strip()


def _target(segment: str) -> str:
    """The name that ``segment``, the text between two signs of assignment, ends with; empty if it is none."""
    head = segment.rstrip()
    if head[-1:] == "]":
        at = head.rfind("[")
        inner = head[at + 1:-1].strip() if at >= 0 else ""
        if len(inner) > 2 and inner[0] == inner[-1] and inner[0] in "\"'`":
            head = inner[:-1]
        else:
            head = head[:max(at, 0)].rstrip()
    elif head[-1:] in "\"'`":
        head = head[:-1]
    elif declared := _DECLARED.search(head[head.rfind("\n") + 1:]):
        head = declared[1]
    name = _BACKWARDS.match(head[::-1])[0][::-1]
    return name if name.strip("-.$0123456789") else ""


def _quoted(literal: str, span: tuple[int, int], values: dict[str, _Value]) -> tuple[list, list[tuple[int, int]], list[_Value]]:
    """Order, spans and parts of a literal whose references to known names stand for their values."""
    if "{" not in literal and "$" not in literal:
        return [literal], [span], []
    order, parts, done = [], [], 0
    for m in _REFERENCE.finditer(literal):
        known = values.get(m[1] or m[2])
        if known is not None:
            order += [literal[done:m.start()], known]
            parts.append(known)
            done = m.end()
    order = [o for o in [*order, literal[done:]] if o != ""] or [literal]
    return order, [span] if any(isinstance(o, str) for o in order) else [], parts


def named_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, in order and without repeats.

    Names, literals and chains of any length count whole.  Work is done only at signs of assignment, and each looks
    back no further than the sign before it.  A value refers to the values it is made of, so chains of chains stay small.
    A bare word ends at a ``+`` that joins it to another operand: a known name, or a quoted literal.
    """
    values: dict[str, _Value] = {}
    wanted: list[_Value] = []
    stop = 0  # end of the bare run seen last
    tail = (0, 0, Counter())  # start, end and characters of the long bare word seen last
    closed = {'"""': True, "'''": True}  # whether such a quote may still end further on
    before, kind, told = 0, "", ""  # end, kind and target of the sign before
    for sign in _SIGN.finditer(text):
        at = sign.start()
        segment = text[before:at]
        grows = segment[-1:] == "+"
        name = _target(segment[:-1] if grows else segment)
        if sign[0] == "=" and kind == ":" and told and "\n" not in segment and _TYPE.match(segment):
            name = told  # a declaration: what stood after its colon was the type
            typed = values.pop(name, None)
            if wanted and wanted[-1] is typed:
                wanted.pop()
        before, kind, told = sign.end(), sign[0], name
        if not name:
            continue
        counts, spans, parts, order, here = [], [], [], [], sign.end()
        if grows and name in values:
            order.append(values[name])
            parts.append(values[name])
        own = len(order)
        lead = _LEAD.match(text, here)
        bracket = lead is not None and "(" in lead[0]
        over = lead is not None and "\n" in lead[0]
        if lead and (over or bracket):
            here = lead.end()
        elif block := _BLOCK.match(text, here) if sign[0] == ":" else None:
            here, indent = block.end(), "\n" + block[1]
            while line := _LINE.match(text, here):
                order.append(line[0])
                counts.append(Counter(line[0]))
                spans.append(line.span())
                here = text.find("\n", line.end())
                if here < 0 or not text.startswith(indent, here):
                    break
                here += len(indent)
            else:
                order, spans = [], []
            here = len(text)  # nothing follows a block
        while True:
            if triple := _TRIPLE.match(text, here):
                end = text.find(triple[1], triple.end()) if closed[triple[1]] else -1
                closed[triple[1]] = end >= 0
                if end < 0:
                    break
                literal, span, here = text[triple.end():end], (triple.end(), end), end + 3
            elif not (part := _PART.match(text, here)):
                break
            elif part[4] is None:
                which = next(i for i in (1, 2, 3) if part[i] is not None)
                literal, span, here = part[which], part.span(which), part.end()
                if over and _KEY.match(text, here):
                    order, spans, counts, parts = [], [], [], []  # the next key, not a value on the next line
                    break
            else:
                literal = None
                start = part.start(4)
                if start >= stop:
                    stop = _RUN.match(text, start).end()
                word = _WORD.match(text, start)
                end = stop
                if word and text[word.end():word.end() + 1] == "+" and (len(order) > own or word[0] in values):
                    end = word.end()
                elif text[stop - 1] == "+" and text[stop:stop + 1] in ("'", '"', "`") and stop - 1 > start:
                    end = stop - 1
                if len(order) > own and text.find("=", start, end) >= 0:
                    break  # the next assignment
                if word and word.end() == end and text[end:end + 1] == "(":
                    call = _ARGUMENTS.match(text, end)
                    if not call:
                        break
                    for m in _LITERAL.finditer(text, end, call.end()):
                        which = 1 if m[1] is not None else 2
                        order.append(m[which])
                        counts.append(Counter(m[which]))
                        spans.append(m.span(which))
                    here = call.end()
                else:
                    value = text[start:end] if end - start <= 4096 else None
                    known = values.get(value[1:] if value[:1] == "$" and value[1:] in values else value) if value is not None else None
                    if known is not None:
                        order.append(known)
                        parts.append(known)
                    elif len(order) == own:
                        order.append(value if value is not None else (text[start:start + 16], text[end - 1]))
                        spans.append((start, end))
                        if value is None:  # its end is that of the word before where both are of one run
                            if tail[1] == end:
                                tail[2].subtract(text[tail[0]:start])
                                tail = (start, end, +tail[2])
                            else:
                                tail = (start, end, Counter(text[start:end]))
                        counts.append(Counter(value) if value is not None else tail[2])
                    here = end
            if literal is not None:
                found, where, inner = _quoted(literal, span, values)
                order += found
                spans += where
                parts += inner
                counts.append(Counter("".join(o for o in found if isinstance(o, str))))
            plus = _PLUS.match(text, here)
            if plus:
                here = plus.end()
            if bracket and (more := _LEAD.match(text, here)):
                here = more.end()
            elif not plus:
                break
        if not order:
            values.pop(name, None)
            continue
        value = values[name] = _Value(counts, spans, parts, order)
        if (score := name_score(name)) >= 0.5:
            literal = value.score()
            if score + literal >= THRESHOLD and literal > 0.4:
                wanted.append(value)
    found, seen = set(), set()
    while wanted:
        value = wanted.pop()
        if id(value) not in seen:
            seen.add(id(value))
            found.update(s for s in value.spans if s[1] > s[0])
            wanted += value.parts
    return sorted(found)


def element_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the contents of XML elements with a sensitive name."""
    out = []
    for m in _ELEMENT.finditer(text):
        if (score := name_score(m[1])) >= 0.5:
            literal = literal_score(m[2])
            if score + literal >= THRESHOLD and literal > 0.4:
                out.append(m.span(2))
    return out


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all spans by start, then kind; offsets are code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    named = set(named_spans(text)) if "=" in text or ":" in text else set()
    if "</" in text:
        named.update(element_spans(text))
    out += [(s, e, 3) for s, e in named]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_secrets(df: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``df`` with an array of (kind, start, end) of every secret in the whole text.

    Null and empty texts have an empty array.  Every row, repeated ones included, is
    scanned by itself, so nothing is shuffled; other columns stay, and a column
    already called ``into`` raises.
    """
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {into} exists")

    @F.pandas_udf(_SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans_of(t)] for t in strings(batch)])

    return df.withColumn(into, scan(F.col(text).cast("string")))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``mark``; overlapping spans are replaced as one.

    Rows and columns stay as they are otherwise; null texts stay null.  Spans are ranges of
    code points, so the text is cut with ``substring``, once for each run of spans.
    """
    if text not in df.columns:
        raise ValueError(f"no column {text}")

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else replaced(t, mark) for t in batch], dtype=object)

    return df.withColumn(text, cleaned(F.col(text)))


def replaced(text: str, mark: str) -> str:
    out, done = [], 0
    for s, e, _ in spans_of(text):
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join([*out, text[done:]]) if out else text


def counts_and_lists(spans: str = "spans") -> dict:
    """Columns with the number of spans by base kind and lists of spans as text."""
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(spans, lambda x: x["kind"] != KINDS[3])
    def number(kind: str):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{k}": number(k) for k in KINDS}
    return counts | {"base_sha256": F.sha2(listed(base).cast("binary"), 256), "spans": listed(F.col(spans))}


