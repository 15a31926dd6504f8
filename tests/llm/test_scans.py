"""Secret scan, token counts and shards against brute force, with the awkward rows each must take."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest

from vacantia.llm import secrets, sharding, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")

AWKWARD = ["", None, " ", "\n", "a  b", " x", "x \n y", "don't  'S 12 ½ ²", "<|endoftext|> a<|endoftext|>", "été x",
           "漢字  x", "z" * 5000, "tab\tx\x1cy", "9" * 400, "The\n\nend. \n", "thnt thnt", "thnt thnt", "é" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(AWKWARD)] + [(1, "again", "clash", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, size int")


def test_token_counts_are_those_of_the_library(docs):
    library = token_counts.open_tokenizer(PATH)
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in
                 token_counts.count_tokens(docs, PATH).collect())
    want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), n, n > 512) for r in docs.collect()
                  for n in [len(library.encode(r.text or "", add_special_tokens=False).ids)])
    assert got == want


def test_random_texts_count_alike():
    rng = random.Random(3)
    counter = token_counts._Counter(PATH, token_counts.whole_tokens(PATH))
    parts = ["the", " ", "  ", "\n", "'s", "'ll", "42", "é", "Thntblere", ".", "!?", "\t", "x", "ß", " a", "°", " ", "ñ,"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_odd_characters_send_their_stretch_only(monkeypatch):
    rng = random.Random(4)
    counter = token_counts._Counter(PATH, token_counts.whole_tokens(PATH))
    parts = ["the", " ", "  ", "\n", "'s", "42", "é", "thntblere", ".", "“", "”", "漢字", "\u3000", "\xa0", "🙂", " a", "\u2028", "\t", "x\u0301", "٣"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids), repr(text)
    counter.clear()
    assert list(token_counts._stretches("he said “yes” and went")) == ["he", " said “yes” and", " went"]
    assert counter.count("he said “yes” and went") == len(counter.tokenizer.encode("he said “yes” and went", add_special_tokens=False).ids) and set(counter) == {"he", " went"}


def test_whole_tokens_encode_alone():
    library = token_counts.open_tokenizer(PATH)
    whole = token_counts.whole_tokens(PATH)
    assert len(whole) > 40_000
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(1).sample(sorted(whole), 500))


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans_by_brute_force(spark):
    rng = random.Random(5)
    parts = ["PassWord", "token", " = ", ":", '"', "'", "abcdef0123456789" * 2, "abcdef01", "AKIA", "ABCDEFGH1234", "x", " ",
             "api_key", "apikey", "secret", "é", "ſecret=", "0f" * 20, "G", "pwd=", "Xk9$vQ2!mZ7p"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 10))) for _ in range(600)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secrets.find_secrets(docs).collect():
        want = brute_base(texts[row.doc_id] or "")
        digest = hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in want).encode()).hexdigest()
        assert row.base_sha256 == digest, texts[row.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert {f"{n}:{s}:{e}" for s, _, n, e in want} <= set(row.spans.split(","))


@pytest.mark.parametrize("value", ["password1", "qwertyuiop", "aaaaaaaaaaaa", "2024-05-17", "abcabcabcabc", "P4ssw0rd", "changeme", "12345678"])
def test_guessable_values_cost_little(value):
    assert secrets.guess_cost(value) < secrets.GUESSES


def test_random_values_cost_much_and_split_is_the_cheapest():
    assert secrets.guess_cost("Xk9$vQ2!mZ7p") >= secrets.GUESSES
    assert secrets.guess_cost("") == 0

    def cheapest(value, spans):
        best = math.inf if value else 0.0
        for start, end, cost in spans:
            if start == 0:
                best = min(best, cost + 0.5 + cheapest(value[end:], [(s - end, e - end, c) for s, e, c in spans if s >= end]))
        return min(best, 1.0 + cheapest(value[1:], [(s - 1, e - 1, c) for s, e, c in spans if s >= 1])) if value else best
    for value in ("admin2024!", "qwe123xx", "tokentoken", "Zr4love99"):
        assert secrets.guess_cost(value) == pytest.approx(cheapest(value, secrets.spans_of(value)))


def test_context_values_and_redaction(spark):
    text = "say pwd: Xk9$vQ2!mZ7p and pwd: changeme, token = 24be64439e3e49cf46b2d7c90f3602a3 end"
    docs = spark.createDataFrame([(1, text, len(text)), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert spans == {1: "guess:9:21,assign:41:81,hex:49:81", 2: "", 3: ""}
    rows = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs, length="n_chars").collect()}
    assert rows[1] == ("say pwd: [secret] and pwd: changeme, [secret] end", 49)
    assert rows[2] == (None, None) and rows[3] == ("clean", 5)


@pytest.mark.parametrize("text, spans, left", [
    ("password: Tr0ub4dor&3xyz! end", "assign:0:19,guess:10:25", "[secret] end"),
    ("dbPassword=x#9Kq!vT2p", "guess:11:21", "dbPassword=[secret]"),
    ("DBPwd=x#9Kq!vT2p", "guess:6:16", "DBPwd=[secret]"),
    ("dbpassword=     Tr0ub4dor&3xyz!", "assign:2:25,guess:16:31", "db[secret]"),
    ("pwd: AKIAABCDEFGH1234#x9", "access:5:21,guess:5:24", "pwd: [secret]"),
    ("pwd=password=Xk9aaVQ2mZ7p", "assign:4:25", "pwd=[secret]"),
    ("pwd=a&" + "0123456789abcdef" * 2 + "&secret=Xk9aaVQ2mZ7p", None, "pwd=[secret]"),
    ("compass=x#9Kq!vT2p", "", "compass=x#9Kq!vT2p")])
def test_values_beyond_fixed_shapes_and_camel_case_names(spark, text, spans, left):
    found = secrets.scan(text)
    assert spans is None or secrets.joined(found) == spans
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(docs).first().text == left


def test_shards(spark):
    rows = [(i if i % 3 else None, "t" * (i % 7) if i % 5 else None, i) for i in range(700)] + [(1, "x", 9)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    placed = sharding.assign(docs, "doc_id", [1.0] * 16, [1.0] * 17, "text").collect()
    assert len(placed) == len(rows)
    slots = {}
    for r in placed:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.size, r.text_crc32) for r in placed) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert len({(r.doc_id, r.shard) for r in placed}) == len({r.doc_id for r in placed})
    assert sharding.assign(docs.limit(0), "doc_id", [1.0], [1.0, 1.0], "text").count() == 0


def test_shard_shares_follow_weights(spark):
    ids = spark.range(20000)
    shares = {r.s: r["count"] for r in ids.select(sharding.rendezvous(ids.id, [1.0, 3.0, 0.0, 2.0]).alias("s")).groupBy("s").count().collect()}
    assert 2 not in shares
    assert all(abs(shares[s] / 20000 - w / 6) < 0.02 for s, w in ((0, 1), (1, 3), (3, 2)))


def test_empty_tables_and_very_long_texts(spark):
    layout = "doc_id long, text string, spans string, n_tokens int"
    none = spark.createDataFrame([], layout)
    assert secrets.find_secrets(none).count() == token_counts.count_tokens(none, PATH).count() == secrets.redact(none).count() == 0
    long = ["password=" + "Xk9$vQ2!mZ7p" * 20_000, "z" * 400_000, "key: " * 60_000, "0f" * 150_000, "pass=x " * 40_000, "é " * 100_000]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(long)], layout)
    found = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert found[0].n_assign == 0 and found[0].spans.startswith("guess:") and found[3].n_hex == 1 and found[1].spans == ""
    library = token_counts.open_tokenizer(PATH)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()} == {
        i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(long)}
