"""Brute-force versions of the text operators, in plain Python."""

import collections
import itertools
import math
import re

import numpy as np
import xxhash

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if {"assign": len(m[m.re.groups]) >= 8, "access": len(m[0]) >= 16, "hex": len(m[0]) >= 32}[kind]:
                out.append((m.start(), n, m.end()))
    return [(kind, s, e) for s, n, e in sorted(out) for kind in [list(BASE)[n]]]


def chunks(text, window=2, divisor=3, long=50, base=1_000_003, modulus=2_147_483_647):
    lines = text.split("\n")
    hashes = []
    for line in lines:
        h = xxhash.xxh64(line.encode(), seed=42).intdigest()
        hashes.append((h - (1 << 64) if h >> 63 else h) % modulus)
    is_long = [line.count(" ") + 1 >= long for line in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        rolling = 0
        for k in range(window):
            rolling = (rolling * base + (hashes[i - k] if i >= k else 0)) % modulus
        if is_long[i] or i + 1 == len(lines) or is_long[i + 1] or rolling % divisor == 0:
            out.append(now)
            now = []
    return out


def without_repeated_chunks(rows):
    """{(key, text): text left} of (key, text) rows without nulls in the text."""
    seen = collections.defaultdict(set)
    order = lambda k: (k is not None, k if k is not None else 0)
    for key, text in rows:
        for at, lines in enumerate(chunks(text)):
            if sum(x.strip(" ") != "" for x in lines) >= 2 or len(lines) == 1 and lines[0].count(" ") >= 49:
                seen["\n".join(lines)].add((order(key), _signed(text), at))
    out = {}
    for key, text in rows:
        parts = chunks(text)
        kept = [p for at, p in enumerate(parts) if not (o := seen.get("\n".join(p))) or (order(key), _signed(text), at) == min(o)]
        out[key, text] = "\n".join(itertools.chain.from_iterable(kept))
    return out


def without_repeated_runs(rows, long=50):
    """{(key, text): text left} by brute force over all runs of lines, of any length."""
    order = lambda k: (k is not None, k if k is not None else 0)
    first, places = {}, []
    for key, text in set(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        for i in full:
            for j in full:
                if j > i or j == i and lines[i].count(" ") >= long - 1:
                    place = (order(key), _signed(text), i, j)
                    run = "\n".join(lines[i:j + 1])
                    first[run] = min(first.get(run, place), place)
                    places.append((run, place, key, text))
    gone = {}
    for run, place, key, text in places:
        if first[run] != place:
            start = max(place[2], first[run][3] + 1) if first[run][:2] == place[:2] else place[2]
            gone.setdefault((key, text), set()).update(range(start, place[3] + 1))
    return {(k, t): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((k, t), ())) for k, t in rows}


def _signed(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, a):
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def text_classes(texts):
    """Class number (its first text) of each text by equality or shared five-word shingles."""
    split = [re.findall(rb"[^\x00-\x20]+", t.encode()) for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    where, groups = collections.defaultdict(list), Groups(len(texts))
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in where[x]).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
        for x in s:
            where[x].append(i)
    first = {}
    for i, t in enumerate(texts):
        groups.join(i, first.setdefault(t, i))
    return [groups.find(i) for i in range(len(texts))]


def vector_links(ids, vectors, labels):
    """(number of links, smallest id of the component) of each row."""
    n = len(ids)
    good = [lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v, lab in zip(vectors, labels)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good)]
    links, groups = [0] * n, Groups(n)
    for i, j in itertools.combinations(range(n), 2):
        if good[i] and good[j] and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
            links[i] += 1
            links[j] += 1
            groups.join(i, j)
    least = {}
    for i in range(n):
        r = groups.find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return links, [least[groups.find(i)] for i in range(n)]


def co_trained(content, page, label, rounds, sure, weight, ridge, aside):
    """Scores of all rows by co-training on whole arrays; rows by id, ``label`` is -1 where there is none."""
    def regress(x, y, w, ridge):
        x = np.column_stack([x, np.ones(len(x))])
        beta, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(x @ beta).clip(-30, 30)))
            step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
            beta = beta + step * min(1, 5 / np.abs(step).max().clip(1e-12))
        return beta

    at = lambda x, beta: x @ beta[:-1] + beta[-1]
    views, known = [content.astype(float), page.astype(float)], np.flatnonzero(label >= 0)
    held, used, free = known[::aside], np.setdiff1d(known, known[::aside]), np.flatnonzero(label < 0)
    rows, said, share = [used, used], [label[used], label[used]], [np.ones(len(used))] * 2
    odds = None
    for turn in range(rounds + 1):
        if turn:
            rows, said, share = [], [], []
            for teacher in (1, 0):
                hit = free[np.abs(odds[teacher][free]) >= np.log(sure / (1 - sure))]
                told = (odds[teacher][hit] > 0).astype(int)
                w = np.array([weight * min(1, (label[used] == c).sum() / max(1, (told == c).sum())) for c in (0, 1)])[told]
                rows.append(np.append(used, hit))
                said.append(np.append(label[used], told))
                share.append(np.append(np.ones(len(used)), w))
        raw = [at(x, regress(x[r], s, w, ridge)) for x, r, s, w in zip(views, rows, said, share)]
        odds = [at(o[:, None], regress(o[held][:, None], label[held], np.ones(len(held)), 0.1)).clip(-20, 20) for o in raw]
    both = np.column_stack(odds)
    return 1 / (1 + np.exp(-at(both, regress(both[held], label[held], np.ones(len(held)), 0.1))))


def languages(rows: list[tuple], names: list[str]) -> list[tuple[str, float, bool]]:
    """Language, posterior and acceptance of (text, declared, host, domain, suffix) rows, one trigram after the other."""
    from cairn.llm import language as op

    def codes(text):
        folded = (text or "").lower().encode()
        raw = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in folded) + b" "
        for i in range(len(raw) - 2):
            if raw[i:i + 3].count(32) < 2:
                yield (int.from_bytes(raw[i:i + 3], "big") * 2654435761 % 2**32) >> 17

    def normal(logs):
        p = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(p) for x in p]

    counts = [collections.Counter() for _ in names]
    for text, declared, *_ in rows:
        tag = (declared or "").lower()[:2]
        if tag in names:
            counts[names.index(tag)].update(codes(text))
    sizes = [sum(c.values()) for c in counts]
    logs = [lambda c, k=k: math.log((counts[k][c] + op.SMOOTH) / (sizes[k] + op.SMOOTH * op.BUCKETS)) for k in range(len(names))]
    common = [sum(n * logs[k](c) for c, n in counts[k].items()) / max(sizes[k], 1) for k in range(len(names))]
    spread = [math.sqrt(max(0, sum(n * logs[k](c) ** 2 for c, n in counts[k].items()) / max(sizes[k], 1) - common[k] ** 2)) for k in range(len(names))]
    means, lengths, own = [], [], []
    for text, *_ in rows:
        found = list(codes(text))
        mean = [sum(map(f, found)) / max(len(found), 1) for f in logs]
        means.append(mean)
        lengths.append(len(found))
        own.append(normal([m * min(len(found) * op.SHARE, op.MOST) for m in mean]))
    rounded = [[round(p * 1e6) / 1e6 for p in o] for o in own]
    total = [sum(o[k] for o in rounded) + 1 for k in range(len(names))]
    keys = [((d or "").lower()[:2] or None, s, g, h) for _, d, h, g, s in rows]
    tables = [collections.defaultdict(lambda: [0.0] * len(names)) for _ in range(4)]
    for key, o in zip(keys, rounded):
        for table, value in zip(tables, key):
            if value is not None:
                table[value] = [a + b for a, b in zip(table[value], o)]
    out = []
    for key, mean, n, o in zip(keys, means, lengths, own):
        others = [[max(a - b, 0) for a, b in zip(t[v], o)] if v is not None else None for t, v in zip(tables, key)]
        score = [m * min(n * op.SHARE, op.MOST) for m in mean]
        for rest, table in zip(others[:2], tables[:2]):
            if rest is not None:
                score = [s + math.log((r + op.TRUST) / (t + op.TRUST * (len(table) + 1))) for s, r, t in zip(score, rest, total)]
        prior = [t / sum(total) for t in total]
        for rest in others[2:]:
            rest = rest or [0.0] * len(names)
            prior = [(r + op.PULL * p) / (sum(rest) + op.PULL) for r, p in zip(rest, prior)]
        p = normal([s + math.log(x) for s, x in zip(score, prior)])
        k = p.index(max(p))
        low = common[k] - op.REACH * spread[k] * math.sqrt(1 / max(n, 1) + 1 / op.ALIKE) - 1e-9
        out.append((names[k], p[k], n > 0 and p[k] >= op.CONFIDENCE and mean[k] >= -math.log(op.BUCKETS) and mean[k] >= low))
    return out
