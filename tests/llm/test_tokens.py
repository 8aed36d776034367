"""Encoding, decoding, token files and packing against the tokenizers library."""

import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cairn.llm import bpe, packing, token_file  # noqa: E402
from cairn.llm.library import Library  # noqa: E402
from cairn.session import new_path  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "  two  spaces\n\n\tand tabs ", "<|endoftext|>a <|endoftext|>  b<|endoftext|>", "<|startoftext|>x", "été ÉTÉ Straße ÀÇ áb  ́c",
    "　日本語  ١٢ ½", "I'll we've 'S don't", "\x1c\x1d\x00 x\x7f", "\U0001f600‍\U0001f600", "aaaa" * 3000, "ΑΣ ΣΑΣ. İI", "word. word, word! word...\nword?", "x" * 9 + ".,", "1234 12.5 a1b2",
]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no key"), (7, "same key"), (3, ODD[3])]


def frame(spark, rows=ROWS):
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 1, "z", [5]) for r in rows], "doc_id long, text string, row int, Ids string, start array<int>")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_library_pieces_equal_whole_texts(path):
    tokenizer, own = Tokenizer.from_file(path), Library(open(path, encoding="utf-8").read())
    texts = [*ODD, " ".join(ODD), "\n".join(ODD), "long text. " * 120_000]
    for t, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_library_parts_words_from_marks_and_line_ends():
    tokenizer, own = Tokenizer.from_file(BYTE), Library(open(BYTE, encoding="utf-8").read())
    texts = ["one two###\ntwo one.%%%\none two;\n two\n\none \none\r\ntwo it's' <two|endoftext|>", "two#<|endoftext|>\none\u00a0\ntwo-", "\none\n", "one_\t\ntwo two\u0301"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    marks = ["###", ".%%%", "$$$", "&&&", "-"]
    own.memo.clear()
    own.encode([f"word{m}\nword word{m}" for m in marks])
    assert set(own.memo) == {"word", " word", "\n", *marks}  # before, each mark and line end made words of its own


def test_library_forgets_without_harm():
    tokenizer, own = Tokenizer.from_file(BYTE), Library(open(BYTE, encoding="utf-8").read(), memo=5)
    for t, got in zip(ODD, [own.encode([t])[0] for t in ODD]):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_equals_library(spark):
    tokenizer = Tokenizer.from_file(BYTE)
    rows = bpe.decode(bpe.encode(frame(spark), BYTE), BYTE).collect()
    assert len(rows) == len(ROWS)
    want = sorted((str(k), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids), t or "") for k, t in ROWS)
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert bpe.encode(frame(spark, []), BYTE).count() == 0


def test_words_of_latin_texts_are_those_of_all_texts():
    import random

    import regex

    draw = random.Random(3)
    listed, plain = bpe.latin_words(), regex.compile(bpe.WORDS)
    letters = [*map(chr, range(256)), *"'strevmdl  \n\t\x1c\x85\xa0" * 8]
    for _ in range(5000):
        text = "".join(draw.choices(letters, k=draw.randrange(16)))
        assert listed.findall(text) == plain.findall(text), repr(text)


def test_bpe_remembers_words_and_splits_them_by_the_text(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    own, tokenizer = bpe.Bpe(open(BYTE, encoding="utf-8").read()), Tokenizer.from_file(BYTE)
    for text in ("it's a\x1cfine\x85 day  \n", "it's a fine day", "caf\u00e9 \u00b2\u00bd 12", "\u4f60\u597d it's \u2003 a", ""):
        assert own.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.memo) <= 3


def test_bpe_decodes_broken_bytes_like_the_library():
    own, tokenizer = bpe.Bpe(open(BYTE, encoding="utf-8").read()), Tokenizer.from_file(BYTE)
    ids = own.encode("日本\U0001f600é").tolist()
    for cut in range(len(ids)):
        for part in (ids[cut:], ids[:cut], ids[cut:cut + 1]):
            assert own.decode(part) == tokenizer.decode(part, skip_special_tokens=False)


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        bpe.Bpe(open(WORD, encoding="utf-8").read())


def test_token_folder_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 200)
    tokenizer, folder = Tokenizer.from_file(WORD), new_path(spark, "tokens")
    token_file.write_tokens(frame(spark), folder, WORD, end=1, shards=3)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = token_file.read_tokens(spark, folder).orderBy("start").collect()
    start = 0
    assert len(got) == len(rows)
    for (k, t), r in zip(rows, got):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (k, start, len(ids), ids)
        start += len(ids)
    one = token_file.read_tokens(spark, folder, docs=[11]).collect()
    assert [r["doc_id"] for r in one] == [11]


def test_token_folder_with_dictionary(spark):
    rows = [(i, f"some words of document {i % 50} and {i * 7 % 31} more of them") for i in range(600)]
    folder = new_path(spark, "tokens")
    token_file.write_tokens(frame(spark, rows), folder, WORD, end=1)
    assert len(spark.read.parquet(f"{folder}/dictionary").head()["bytes"]) > 0
    assert token_file.read_tokens(spark, folder).count() == 600


def test_empty_token_folder(spark):
    folder = new_path(spark, "tokens")
    token_file.write_tokens(frame(spark, []), folder, WORD, end=1)
    assert token_file.read_tokens(spark, folder).count() == 0


def check_packing(rows, got, capacity=1024):
    tokenizer = Tokenizer.from_file(BYTE)
    want = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in rows)
    sequences, total, padding = {}, 0, 0
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert total == sum(map(len, want))
    if len({k for k, _ in rows}) == len(rows):
        ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in rows}
        done = dict.fromkeys(ids, 0)
        for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["start"])):
            own = ids[r["doc_id"]]
            assert r["start"] == done[r["doc_id"]] and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
            done[r["doc_id"]] += r["length"]
        assert done == {k: len(v) for k, v in ids.items()}
    return padding / max(total, 1)


def test_packing_odd_rows(spark):
    check_packing(ROWS, packing.pack(frame(spark), BYTE, 0).collect())
    assert packing.pack(frame(spark, []), BYTE, 0).count() == 0


def test_packing_one_length_and_many(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    rows = [(i, "one two three") for i in range(700)] + [(1000 + i, "word " * (i * 37 % 2500)) for i in range(300)]
    got = packing.pack(frame(spark, rows), BYTE, 0).collect()
    assert check_packing(rows, got) < 0.02


def test_packing_plan_is_whole():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 400):
        lengths = rng.integers(1, 64, n)
        demand = {int(s): int(c) for s, c in zip(*np.unique(lengths, return_counts=True))}
        made = packing.plan(demand, 64)
        fill = {}
        for s, c in demand.items():
            first, place = packing.locate(made, np.full(c, s), np.arange(c))
            for f, p in zip(first.tolist(), place.tolist()):
                for x in range(p, p + s):
                    spot = (f + x // 64, x % 64)
                    assert spot not in fill and f + x // 64 < made.sequences
                    fill[spot] = s
        assert len(fill) == sum(s * c for s, c in demand.items())


def test_dictionary_samples_lie_anywhere_in_a_text(spark):
    numbers = " ".join(str(i) for i in range(20_000))
    rows = [(i, f"{i} {numbers}") for i in range(40)] + [(50, "short"), (51, ""), (None, numbers)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.select("text", token_file.sample_window().alias("window")).collect()
    assert all(r["window"] in r["text"] and len(r["window"]) == min(len(r["text"]), token_file.WINDOW) for r in got)
    starts = [r["text"].index(r["window"]) for r in got if len(r["text"]) > token_file.WINDOW]
    assert min(starts) < 30_000 and max(starts) > 80_000 and len(set(starts)) > 30


def test_equal_keys_lie_in_order_of_text_over_shards(spark):
    rows = [(7, f"text {i % 30}") for i in range(60)]
    folder = new_path(spark, "ties")
    token_file.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, WORD, end=1, shards=4)
    got = token_file.read_tokens(spark, folder).orderBy("start").collect()
    encode = Tokenizer.from_file(WORD).encode
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[*encode(t, add_special_tokens=False).ids, 1] for _, t in sorted(rows)]
    assert spark.read.parquet(f"{folder}/shards").count() > 1
