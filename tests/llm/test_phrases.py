"""Phrase mining against plain Python."""

import collections
import re

import numpy as np
import pytest

from cairn.llm import phrases


def brute(rows, least=10, top=2000, longest=3):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        longer = [p for p, a in counts.items() if a >= least and len(p) > 2]
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and 100 * counts[q] >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q in longer):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, "p", 3) for t, lang in rows], "text string, lang string, phrase string, Words int")


def corpus(n=120, seed=1):
    rng = np.random.default_rng(seed)
    words = ["Straße", "the", "The", "of", "new", "york", "city", "ÉTÉ", "x y", "日本", "a'b", "q\x00r"]
    rows = []
    for i in range(n):
        picked = [words[k] for k in rng.zipf(1.5, 60) % len(words)]
        picked[7:10] = ["new", "york", "city"]
        gaps = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", " ; ", "!\x0b", "?:"]
        text = "".join(w + gaps[k] for w, k in zip(picked, np.minimum(rng.zipf(1.7, 60) - 1, len(gaps) - 1)))
        rows.append((text, ["en", "de", None, "und", ""][i % 5]))
    return rows


ODD = [(None, "en"), ("", "de"), (" .,;\t\n", "en"), (None, None), ("single", "xx"), (".. . Lead", "xx"), ("  blank\tstart ", "xx")]


def test_equals_plain_python(spark):
    rows = corpus() + ODD + [("long " * 3 + "hot pair, " * 4000, "en"), ("word" * 5000 + " end", "en")]
    rows += rows[:30]  # repeated rows
    got = phrases.collocations(frame(spark, rows).repartition(5))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    few = phrases.collocations(frame(spark, rows), top=3, least=4, longest=4)
    assert sorted(map(tuple, few.collect())) == brute(rows, least=4, top=3, longest=4)


def test_small_chunks_and_shared_fingerprints(spark, monkeypatch):
    rows = corpus(60, seed=2)
    want = brute(rows)
    monkeypatch.setattr(phrases, "CHUNK", 700)
    monkeypatch.setattr(phrases, "RANGE", 3000)
    monkeypatch.setattr(phrases, "GATHER", 50)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect())) == want
    # moduli so small that many runs of words share a fingerprint: counts stay exact
    monkeypatch.setattr(phrases, "PRIMES", (17, 13))
    monkeypatch.setattr(phrases, "LETTER", (3, 5))
    monkeypatch.setattr(phrases, "WORD", (5, 6))
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect())) == want


def test_plain_form():
    body, words = phrases.plain_form([b"A  b.c\td ", b"", b"e"])
    assert (body, words) == (b"a b\nc d\ne\n", 5)
    assert phrases.plain_form([b" ..", b""]) == (b"", 0)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en")], [("few words only", "en")]])
def test_nothing_found(spark, rows):
    assert phrases.collocations(frame(spark, rows)).count() == 0
