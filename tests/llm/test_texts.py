"""Secrets, line chunks, near duplicates, language and quality."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import language, line_chunks, near_text, quality, secret_scan
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "q", 3) for r in rows], "doc_id long, text string, lang string, source string, spans__ string, Node int")


def short(rows):
    return [(k, t, "en", "s") for k, t in rows]


# ---- secrets


def test_base_spans_stay():
    rng = random.Random(1)
    bits = ["token", "API_KEY", "apikey", "=", ":", " ", "'", '"', "abcdefgh", "AKIA", "ABCDEF123456", "0123456789abcdef", "x", "PASSWORD", "ſecret", "\n", "é", "=="]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        got = [(secret_scan.KINDS[k], s, e) for s, e, k in secret_scan.spans_of(text) if k < 3]
        assert got == plain.base_spans(text), text


@pytest.mark.parametrize("text, found", [
    ('a = "Zx9$kq"\nb = "7Lm2pQ"\ndb_password = a + b', ["Zx9$kq", "7Lm2pQ"]),
    ('key = "pQ7xZ2mK9w"\nclientSecret: key', ["pQ7xZ2mK9w"]),
    ('{"apiKey": "q8Zr5tYp0aWx"}', ["q8Zr5tYp0aWx"]),
    ("export DB_PASSWD=Tr0ub4dor&3x", ["Tr0ub4dor&3x"]),
    ('password_file = "/etc/ssl/private.pem"', []),
    ('token_count = "123456789012"', []),
    ('title = "pQ7xZ2mK9w"', []),
    ("the secret: something nice happened", []),
    ('password = "changeme"', []),
    ("", []),
])
def test_named_literals(text, found):
    assert [text[s:e] for s, e in secret_scan.named_spans(text)] == found


KEY = "pQ7xZ2mK9w"


@pytest.mark.parametrize("text, found", [
    (f'db_password: str = "{KEY}"', [KEY]),
    (f'password: SecretString = "{KEY}"', [KEY]),
    (f'let client_secret: &str = "{KEY}";', [KEY]),
    (f'const client_secret string = "{KEY}"', [KEY]),
    (f'const apiToken: string | null = "{KEY}"', [KEY]),
    (f'config["password"] = "{KEY}"', [KEY]),
    (f"os.environ['DB_PASSWORD'] = '{KEY}'", [KEY]),
    (f'char password[] = "{KEY}";', [KEY]),
    (f'const char *password = "{KEY}";', [KEY]),
    (f'db_password = """{KEY}"""', [KEY]),
    (f'db_password = (\n    "{KEY}"\n    "Zx9$kq"\n)', [KEY, "Zx9$kq"]),
    (f'{{"apiKey":\n  "{KEY}"}}', [KEY]),
    (f'client_secret: |\n  {KEY}\nother: x', [KEY]),
    (f'client_secret: >-\n  {KEY}\n  Zx9kq\nother: x', [KEY, "Zx9kq"]),
    ('db_password = "Zx9$kq"\ndb_password += "7Lm2pQ"', ["Zx9$kq", "7Lm2pQ"]),
    ('a = "Zx9$kq"\nb = "7Lm2pQ"\ndb_password = f"{a}{b}"', ["Zx9$kq", "7Lm2pQ"]),
    ('A=Zx9kq4\nB=7Lm2pQ\nexport DB_PASSWORD="${A}$B"', ["Zx9kq4", "7Lm2pQ"]),
    (f"KEY={KEY}\nexport DB_PASSWORD=$KEY", [KEY]),
    (f'client_secret = os.getenv("X", "{KEY}")', [KEY]),
    (f'client_secret = os.environ.get("CLIENT_SECRET_NAME", default="{KEY}")', [KEY]),
    ('client_secret = os.getenv("CLIENT_SECRET_NAME")', []),
    ("password = make_password(length)", []),
    (f'password:\n"{KEY}": "some value"', []),
    (f"{'x' * 200}_one = 'nothing'\n{'y' * 200}_one = '{KEY}'\ndb_password = {'x' * 200}_one + 'abc'", []),
    (f"{'x' * 300}_password = '{KEY}'", [KEY]),
    ("client_secret: |\n  several words here\nother: x", []),
])
def test_forms_of_assignment(text, found):
    assert [text[s:e] for s, e in secret_scan.named_spans(text)] == found


def test_elements_and_hard_forms():
    text = f'<config><password>{KEY}</password><note id="1">{KEY}</note>\n<api-token scope="x">\n{KEY} </api-token></config>'
    spans = [(s, e) for s, e, k in secret_scan.spans_of(text) if k == 3]
    assert spans == [(text.index(KEY), text.index(KEY) + 10), (text.rindex(KEY), text.rindex(KEY) + 10)]
    for hard in ('="""' * 60_000, "x='''\n" * 20_001, "x=a(" * 60_000, 'x=a("' * 60_000, "x=(" * 60_000, "a: |\n " * 40_000, "<a" * 60_000, "<a>x" * 60_000, "a[" * 60_000 + "]=" * 9,
                 "x: a[ = " * 20_000, "var a " * 60_000 + "=1", 'a="${a}${a}"\n' * 20_000, "x=\n" * 60_000, "=(\n" * 60_000):
        assert secret_scan.spans_of(hard) is not None


def test_secret_columns_and_redaction(spark):
    rows = short([(1, 'my token = "abcdefgh12345678"'), (2, None), (3, ""), (None, "plain"), (1, "AKIA" + "A1" * 8), (1, "AKIA" + "A1" * 8), (4, "é" * 70_000 + " secret=abcdefghij " + "0a" * 20)])
    d = frame(spark, rows)
    found = secret_scan.find_secrets(d).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "named"] == plain.base_spans(r["text"] or "")
    got = secret_scan.redact(d)
    assert got.columns == d.columns
    texts = [r["text"] for r in got.collect()]
    assert texts[1] is None and texts[2] == "" and texts[3] == "plain" and texts[4] == texts[5] == "[SECRET]" and texts[0].count("[SECRET]") == 1
    assert secret_scan.find_secrets(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        secret_scan.find_secrets(d, into="NODE")


def test_secrets_of_a_hard_line_are_linear():
    assert secret_scan.spans_of('"=' * 60_000) is not None


def drawn(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))


def test_long_values_and_chains_are_found_whole():
    long, parts = drawn(1, 5000), [drawn(10 + i, 9) for i in range(20)]
    cases = [(f'private_key = "{long}"', [long]), (f"private_key = {long}", [long]), (f"k = '{long}'\nclient_secret = k", [long]),
             ("db_password = " + " + ".join(f'"{p}"' for p in parts), parts), ("db_password=" + "+".join(f'"{p}"' for p in parts), parts),
             ('a="Zx9$kq"\nb="7Lm2pQ"\ndb_password=a+b', ["Zx9$kq", "7Lm2pQ"]), ('a="Zx9$kq"\nclient_secret=a+"7Lm2pQ"', ["Zx9$kq", "7Lm2pQ"]),
             ("client_secret=ab3D+ef6H/ij9L+mn2P==", ["ab3D+ef6H/ij9L+mn2P=="])]
    for text, found in cases:
        assert [text[s:e] for s, e in secret_scan.named_spans(text)] == found, text[:60]
        assert not any(p in secret_scan.replaced(text, "[SECRET]") for p in found)
    grown = 'a="Zx9$kq7L"\n' + "a=a+a\n" * 200 + "db_password=a"
    assert [grown[s:e] for s, e in secret_scan.named_spans(grown)] == ["Zx9$kq7L"]
    for value, counts in ((long + "  ", True), (long[:2500] + " " + long[2500:], False), ("example" + long, False), ("x" * 5000, False), ("x" * 20 + long + "x", True)):
        assert bool(secret_scan.named_spans(f'private_key = "{value}"')) == counts
    for hard in ("key=" * 60_000, "x=a +" * 60_000, "x= +" * 60_000, 'a="b' * 60_001, "a=a+a\n" * 20_000):
        assert secret_scan.named_spans(hard) is not None


# ---- line chunks


def lines_table():
    rng = random.Random(3)
    shared = [f"shared line {i}" for i in range(12)]
    rows = []
    for d in range(40):
        own = [f"line {rng.randint(0, 10 ** 6)} of {d}" for _ in range(rng.randint(0, 6))]
        rows.append((d, "\n".join(own + (shared if d % 3 else []) + own[::-1])))
    passage = " ".join(f"w{i}" for i in range(60))
    rows += [(50, f"a\n{passage}\nb"), (51, f"c\n{passage}\nd"), (52, passage), (53, "\n\n\n\n"), (54, "\n\n\n\n"), (55, ""), (9, "\n".join(shared)), (9, "\n".join(shared)), (None, "\n".join(shared)),
             (60, "\n".join(f"x{i % 7} y{i % 11}" for i in range(3000)))]
    return rows


def test_repeated_chunks_go(spark):
    rows = lines_table()
    d = frame(spark, short([*rows, (70, None)]))
    got = line_chunks.remove_repeated_chunks(d, removed="gone")
    assert got.columns == [*d.columns, "gone"]
    want = plain.without_repeated_chunks(rows)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted([(str(k), want[k, t]) for k, t in rows] + [("70", "None")])
    assert any(want[k, t] != t for k, t in rows) and want[52, dict(rows)[52]] == "" and want[53, "\n\n\n\n"] == "\n\n\n\n"
    assert line_chunks.remove_repeated_chunks(frame(spark, [])).count() == 0


def test_repeated_chunks_on_the_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    want = plain.without_repeated_chunks(rows)
    assert {(r["doc_id"], r["text"]) for r in line_chunks.remove_repeated_chunks(d).collect()} == {(k, want[k, t]) for k, t in rows}


def test_line_chunks_run_no_python(spark):
    d = line_chunks.remove_repeated_chunks(frame(spark, short(lines_table())))
    assert not {"Python", "Pandas", "Arrow"} & set(d._jdf.queryExecution().executedPlan().toString().split("\n")[0].split())
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()


def runs_table():
    rng, rows = random.Random(8), []
    for n in (3, 4, 5, 6, 8, 12):  # passages of 12 words a line between lines found nowhere else
        for p in range(6):
            passage = [" ".join(f"p{n}.{p}.{i}.{w}" for w in range(12)) for i in range(n)]
            for d in range(2):
                edge = [f"edge {rng.random()}" for _ in range(6)]
                rows.append((1000 * n + 10 * p + d, "\n".join(edge[:3] + passage + edge[3:])))
    rows += [(i, "\n".join(rng.choice(["a", "b", "c d", "", " "]) for _ in range(rng.randint(1, 8)))) for i in range(30)]
    rows += [(i, "\n".join(rng.choice("abcdefghijklmnop") for _ in range(12))) for i in range(100, 110)]
    passage = " ".join(f"w{i}" for i in range(60))
    rows += [(200, f"u\n{passage}\nv"), (201, passage), (202, ""), (203, "q\nq\nq\nq"), (204, "k1\n\n\nk2"), (205, "k1\n\nk2"), (206, "z\nk1\n\nk2"), (207, "same\nrow"), (207, "same\nrow"), (None, "same\nrow")]
    return rows


def test_repeated_runs_equal_brute_force(spark):
    rows = runs_table()
    got = line_chunks.remove_repeated_runs(frame(spark, short([*rows, (300, None)])), removed="gone")
    want = plain.without_repeated_runs(rows)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted([(str(k), want[k, t]) for k, t in rows] + [("300", "None")])
    later = [(k, t) for k, t in rows if k is not None and k >= 3000 and k % 2]
    assert len(later) == 36 and all(want[k, t].count("\n") == 5 for k, t in later)  # of each passage nothing is left
    assert want[203, "q\nq\nq\nq"] == "q\nq"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert line_chunks.remove_repeated_runs(frame(spark, [])).count() == 0


@pytest.mark.parametrize("marks", [1 << 23, 8])
def test_repeated_runs_of_random_lines(spark, monkeypatch, marks):
    monkeypatch.setattr(line_chunks, "MARKS", marks)
    rng, rows = random.Random(5), []
    lines = [*"abcdefgh", "", " ", "i j", "long " * 60, "other " * 49 + "x"]
    for i in range(150):
        rows.append((i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))))
    rows += [(i, rng.choice(rows)[1]) for i in range(150, 220)]  # copies
    rows += [(i, rng.choice(rows)[1] + "\n" + rng.choice(rows)[1]) for i in range(220, 260)]  # texts end to end
    long = "\n".join(f"line {k}" for k in range(5000))
    want = plain.without_repeated_runs(rows) | {(900, long): long, (901, long + "\nend"): "end"}
    rows += [(900, long), (901, long + "\nend"), *rows[:5]]  # a very long text, repeated rows
    frame_ = spark.createDataFrame([(k, t, 1, 2, "s") for k, t in rows], "doc_id long, text string, bits__ int, Bucket__ int, found__ string")
    got = line_chunks.remove_repeated_runs(frame_)
    assert got.columns == frame_.columns
    found = sorted((r["doc_id"], r["text"]) for r in got.collect())
    assert [f for f in found if f[0] != 901] == sorted((k, want[k, t]) for k, t in rows if k != 901)
    assert [t for k, t in found if k == 901] in (["end"], ["line 4999\nend"])


# ---- near duplicates


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = 1 + np.log(rng.integers(1, 9, 400)), 1 + np.log(rng.integers(1, 9, 400))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(400))
    s = near_text.signatures([(h, a), (h, b), (h[:0], a[:0]), (h[:1], a[:1])], 4000)
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    assert (s[2] == 0).all() and (s[3] == h[0]).all()


def near_table():
    rng = random.Random(4)
    words = [f"v{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 150)))) for i in range(60)]
    for i in range(60):  # one group around a text, its copies often unlike each other
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(120)] = rng.choice(words)
        rows.append((100 + i, " ".join(w)))
    chain = list(base[::-1])
    for i in range(30):  # a chain: each differs from the next only
        chain[4 * i] = f"z{i}"
        rows.append((300 + i, " ".join(chain)))
    rows += [(400, ""), (401, ""), (402, " \n"), (403, "two words"), (404, "two  words"), (405, "two words"), (5, "other text, same key"), (407, "two words"), (407, "two words"), (None, rows[0][1]), (500, " ".join(words * 20))]
    return rows


@pytest.mark.parametrize("rounds", [1, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_text, "ROUNDS", rounds)
    rows = near_table()
    d = frame(spark, short([*rows, (600, None), (601, None)]))
    got = near_text.near_duplicates(d).collect()
    classes = plain.text_classes([t for _, t in rows])
    least = {}
    for (k, _), c in zip(rows, classes):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    want = sorted([(str(k), str(least.get(c))) for (k, _), c in zip(rows, classes)] + [("600", "600"), ("601", "601")])
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == want
    kept = near_text.first_of_each(d)
    assert kept.columns == d.columns
    assert kept.count() == len(set(classes)) + 2
    assert near_text.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_on_the_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in d.collect())
    classes = plain.text_classes([t for _, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in near_text.near_duplicates(d).collect()}
    assert got == {k: rows[c][0] for (k, _), c in zip(rows, classes)}


@pytest.mark.parametrize("times", [20, 1000])
def test_pairs_whose_unlike_parts_repeat(spark, times):
    rows = []
    for n in range(20):  # 90 shared shingles, and 4 + 7 others on each side, of which 7 occur many times: Jaccard 0.804
        shared = [f"s{n}.{i}" for i in range(94)]
        for side in "ab":
            rows.append((2 * n + (side == "b"), " ".join(shared + [f"{side}{n}.{i}" for i in range(7)] * times + [f"{side}{n}.{i}" for i in range(4)])))
    sets = [set(s.tolist()) for s in near_text.shingles([t for _, t in rows[:2]])]
    assert len(sets[0] & sets[1]) == 90 and len(sets[0] | sets[1]) == 112
    got = {r["doc_id"]: r["class_id"] for r in near_text.near_duplicates(frame(spark, short(rows))).collect()}
    assert got == {k: k // 2 * 2 for k, _ in rows}


# ---- language


def speech(rng, lang, n):
    sounds = {"en": ["the", "ing", "th", "ow"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "oi", "é", "que"], "es": ["ción", "os", "ñ", "ado"]}[lang]
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, speech(rng, lang, rng.randint(3, 80)), lang.upper() + "-XX" if i % 2 else lang, f"host{i % 5}") for i, lang in enumerate(["en", "de", "fr", "es"] * 30)]
    odd = [(200, speech(rng, "de", 60), "en", "host1"), (201, speech(rng, "fr", 40), None, None), (202, None, "en", "host1"), (203, "", None, None), (204, "12 345 --", "de", "host2"),
           (205, "日本語の文章です " * 5, None, None), (None, speech(rng, "es", 30), "xx", ""), (207, speech(rng, "en", 50_000), "en", "host1"), (208, speech(rng, "en", 4), "en", "host1"), (208, "same", "en", "host1")]
    d = frame(spark, rows + odd)
    got = language.identify(d).collect()
    assert len(got) == len(rows) + len(odd) and got[0].asDict().keys() == {*d.columns, "language", "confidence", "accepted"}
    by = {(r["doc_id"], r["text"]): r for r in got}
    for k, t, lang, _ in rows:
        assert by[k, t]["language"] == lang[:2].lower() and by[k, t]["accepted"]
    want = {200: ("de", True), 201: ("fr", True), 202: (None, False), 203: (None, False), 204: (None, False), 205: (None, False), 207: ("en", True)}
    for k, t, *_ in odd:
        if k in want:
            lang, accepted = want[k]
            assert by[k, t]["accepted"] == accepted and lang in (None, by[k, t]["language"]), k
    assert by[None, odd[6][1]]["language"] == "es"
    assert language.identify(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        language.identify(d, into=("Lang", "c", "a"))


def test_host_prior_decides_short_texts(spark):
    rng = random.Random(6)
    rows = [(i, speech(rng, "de" if i % 2 else "fr", 40), "de" if i % 2 else "fr", "h-de" if i % 2 else "h-fr") for i in range(80)]
    rows += [(100, "ab", None, "h-de"), (101, "ab", None, "h-fr")]
    got = {r["doc_id"]: r["language"] for r in language.identify(frame(spark, rows)).collect()}
    assert got[100] == "de" and got[101] == "fr"


def same_languages(got, want):
    assert [(r["language"], r["accepted"]) for r in got] == [(w[0], w[2]) for w in want]
    assert max(abs(r["confidence"] - w[1]) for r, w in zip(got, want)) < 1e-6


def test_languages_of_documents_by_plain_python(spark):
    got = language.identify(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("doc_id").collect()
    same_languages(got, plain.languages([(r["text"], r["lang"], r["source"], None, None) for r in got], ["de", "en", "es", "fr"]))


def test_languages_of_pages_by_plain_python(spark):
    rows = language.page_rows(spark.read.parquet(f"{SF}/pages.parquet"))
    rng = random.Random(8)  # one host in four has an own suffix and one domain has many hosts
    odd = [(10_000 + i, speech(rng, lang, 1 + i % 7), lang if i % 3 else None, f"h{i % 4}.example.{tld}", f"example.{tld}", tld)
           for i in range(60) for lang, tld in [(("de", "de"), ("fr", "fr"), ("es", "org"))[i % 3]]]
    odd += [(20_000, None, None, None, None, None), (20_001, "", "de", "h1.example.de", "example.de", "de")]
    every = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    names = language.declared_languages(every, "declared")
    got = language.identify(every, declared="declared", host="host", domain="domain", suffix="suffix").orderBy("page_id").collect()
    same_languages(got, plain.languages([(r["text"], r["declared"], r["host"], r["domain"], r["suffix"]) for r in got], list(names)))
    none = language.identify(every.limit(0), declared="declared", host="host", domain="domain", suffix="suffix")
    assert none.count() == 0


@pytest.mark.parametrize("out", ["de", "en", "es", "fr"])
def test_a_language_without_model_is_rejected(spark, out):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    left = tuple(x for x in language.LANGUAGES if x != out)
    found = language.identify(documents, languages=left).groupBy((F.col("lang") == out).alias("foreign")).agg(F.avg(F.col("accepted").cast("int")).alias("kept"))
    kept = {r["foreign"]: r["kept"] for r in found.collect()}
    assert kept[True] <= 0.1 and kept[False] >= 0.995


def test_languages_come_from_the_declared_tags(spark):
    rng = random.Random(12)
    rows = [(i, speech(rng, lang, 40), tag, "h") for i, (lang, tag) in enumerate([("en", "pt-BR"), ("de", "nl")] * 150)]
    rows += [(900, speech(rng, "en", 40), None, None), (901, speech(rng, "fr", 40), "qq", None)]
    d = frame(spark, rows)
    assert language.declared_languages(d, "lang") == ("nl", "pt")
    got = {r["doc_id"]: r for r in language.identify(d).collect()}
    assert all(got[i]["language"] == ("nl" if i % 2 else "pt") and got[i]["accepted"] for i in range(300))
    assert got[900]["language"] == "pt" and language.declared_languages(d.limit(0), "lang") == language.LANGUAGES


def test_trigrams_of_parts_are_those_of_the_whole(monkeypatch):
    texts = ["Grüße, Jürgen! ok", "", "a", "x" * 40, "The end"]
    whole = [np.concatenate(p) for p in zip(*language.trigrams(texts))]
    monkeypatch.setattr(language, "_PART", 5)
    parts = [np.concatenate(p) for p in zip(*language.trigrams(texts))]
    assert sorted(zip(*whole)) == sorted(zip(*parts))


def test_page_rows(spark):
    pages = spark.createDataFrame([
        (1, "https://user@WWW.a.example.org:80/x?y", '<html data-x="1" lang="de-AT"><script>var a="</p>"</script><p>Guten&nbsp;Tag</p><!-- no --></html>'), (2, None, None), (3, "no address", "plain")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in language.page_rows(pages).collect()}
    assert (got[1]["host"], got[1]["domain"], got[1]["suffix"], got[1]["declared"]) == ("www.a.example.org", "example.org", "org", "de-AT")
    assert got[1]["text"].split() == ["Guten", "Tag"] and got[2]["host"] is None and got[3]["host"] is None and got[3]["text"] == "plain"


# ---- quality


def test_quality_on_held_out_labels(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_quality(d, labels.filter("doc_id % 3 <> 0"))
    rows = got.join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.95
    assert got.count() == d.count()


def test_quality_equals_plain_co_training(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    some = labels.filter("doc_id % 3 <> 0")
    said = {r["doc_id"]: r["quality"] for r in some.collect()}
    rows = sorted(d.collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] or "" for r in rows]
    content = quality.text_view(texts)
    page = quality.page_view([r["source"] or "" for r in rows], [r["lang"] or "" for r in rows], [len(t) for t in texts], [t.count("\n") + 1 for t in texts])
    label = np.array([said.get(r["doc_id"], -1) for r in rows])
    want = plain.co_trained(content, page, label, quality.ROUNDS, quality.SURE, quality.WEIGHT, quality.RIDGE, quality.ASIDE)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(d, some).collect()}
    assert np.abs(np.array([got[r["doc_id"]] for r in rows]) - want).max() < 1e-6


def test_quality_of_odd_rows(spark):
    good, bad = "this is a fine sentence with words", "BUY!! NOW!! ###"
    rows = [(i, (good if i % 2 else bad) + f" {i * 7919}", "en", f"s{i % 3}") for i in range(60)]
    odd = [(100, None, None, None), (101, "", "en", ""), (None, good, "en", "s1"), (7, good + " 55433", "en", "s1"), (103, "long " * 300_000, "en", "s2")]
    d = frame(spark, rows + odd)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 0, 0), (2, None, 0), (41, 5, 0), (900, 1, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, text int")
    got = quality.score_quality(d, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None and 40 <= r["doc_id"] < 60}
    assert all(kept == bool(k % 2) for k, kept in by.items())
    assert {r["score"] for r in quality.score_quality(d, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score_quality(d, labels.filter("quality = 1 AND doc_id > 3")).collect()} == {1.0}
    assert quality.score_quality(frame(spark, []), labels).count() == 0


def test_sums_of_segments_are_those_of_the_whole(monkeypatch):
    texts = ["aa bb aa aa\nCC 12 !!", "", "   ", "x " * 50]
    whole = quality.text_view(texts)
    monkeypatch.setattr(quality, "_SEGMENT", 10 ** 6)
    assert np.allclose(whole, quality.text_view(texts))
    assert not np.isnan(whole).any()


def test_trigrams_hold_little_text_at_a_time():
    sizes = [len(code) for _, code in language.trigrams(["ab " * 700_000, "x", "word " * 300_000])]
    assert len(sizes) > 4 and max(sizes) <= 1 << 19
