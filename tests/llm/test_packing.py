"""Packing: an exact round trip of all ids, little padding, and the index against brute-force BM25."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vacantia.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_round_trip(rows, docs, least_fill):
    library = Tokenizer.from_file(PATH)
    want = {}
    for key, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(key, []).append(np.array(ids, dtype="<u4"))
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    got = sorted((key, *p) for key, parts in pieces.items() for p in parts if key is not None)
    for key, codes in want.items():
        parts = sorted(pieces[key])
        assert sum(p[1] for p in parts) == sum(map(len, codes))
        if len(codes) == 1:
            at = 0
            for start, length, crc, total in parts:
                assert start == at and total == len(codes[0]) and crc == zlib.crc32(codes[0][start:start + length])
                at += length
    assert got
    total = sum(p[1] for parts in sequences.values() for p in parts)
    assert total >= least_fill * packing.WINDOW * len(sequences)


def test_round_trip(spark, monkeypatch):
    rng = random.Random(1)
    words = ["the", "İx", "don't", "ré", "straße", "42", "<|endoftext|>", "thntblere", "!?", "漢字", "a\x1cb", "ΣΑΣ"]
    docs = [(i, rng.choice([" ", "\n", " ", "  "]).join(rng.choices(words, k=rng.choice([0, 3, 50, 900, 4000]))))
            for i in range(120)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, "same"), (503, "same"), (None, "nameless")]
    df = spark.createDataFrame([(k, t, "x", 7) for k, t in docs], "doc_id long, text string, ids string, length int")
    check_round_trip(packing.pack(df, PATH).collect(), docs, 0.99)
    monkeypatch.setattr(packing, "SHARD", 20_000)
    check_round_trip(packing.pack(df, PATH).collect(), docs, 0.9)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_neighbours_are_bm25():
    rng = np.random.default_rng(2)
    units = [rng.integers(0, 60, rng.integers(5, 40)).astype("<u4") for _ in range(80)]
    held = np.array([sum(t in u for u in units) for t in range(60)])
    idf = np.log1p((len(units) - held + 0.5) / (held + 0.5))
    mean = np.mean([len(u) for u in units])

    def weight(t, u):
        times = (units[u] == t).sum()
        return idf[t] * times * (packing.K1 + 1) / (times + packing.K1 * (1 - packing.B + packing.B * len(units[u]) / mean))
    shard = packing.Shard(units, idf, mean)
    for u in range(0, 80, 7):
        shard.take(u)
    for seed in range(10):
        terms = sorted(set(units[seed].tolist()), key=lambda t: (-weight(t, seed), t))[:packing.TERMS]
        score = {u: sum(weight(t, u) for t in terms) for u in range(80) if u % 7 and any(t in units[u] for t in terms)}
        got = shard.neighbours(seed).tolist()
        assert set(got) == set(score)
        assert np.allclose([score[u] for u in got], sorted(score.values(), reverse=True))


def test_windows_fill_with_neighbours():
    """Units of two topics: a window does not change topic while its topic has units left."""
    units = [np.full(300, 1 + i % 2, dtype="<u4") for i in range(40)]
    rows = packing.fill(np.full(40, 300), packing.Shard(units, np.ones(3), 300.0))
    topics = [u % 2 for u, *_ in rows]
    assert sum(a != b for a, b in zip(topics, topics[1:])) == 1
    assert sum(r[2] for r in rows) == 40 * 300


def test_words_encode_as_the_library_does():
    library = Tokenizer.from_file(PATH)
    words = packing._Words(PATH)
    rng = random.Random(8)
    parts = ["the", "Thnt", "é", "É", "İ", "ß", "ñ", "42", "½", "'s", "don't", "'LL", ".", ",", "!!", "°", "<|endoftext|>", "<|x", "Σ", "e\u0301",
             "漢", "_", "ª", "\u00ad", "-", "x\u0345", "ing", "tion", "ǅ"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(4000)]
    for text, code in zip(texts, words.encode(texts)):
        assert np.frombuffer(code, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_merging_agrees_with_the_library_on_the_table():
    import pyarrow.parquet as pq

    library = Tokenizer.from_file(PATH)
    words = packing._Words(PATH)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    every = sorted({w for t in texts if t for w in t.split()} | {n.removesuffix(packing.END) for n in library.get_vocab()})
    for word, code, want in zip(every, words.encode(every), library.encode_batch(every, add_special_tokens=False)):
        assert code == np.array(want.ids, dtype="<u4").tobytes() or word.split() != [word], repr(word)


def test_simple_texts_are_encoded_as_the_library_does():
    rng = random.Random(9)
    parts = ["the", "'s", "'re", "'", " ", "  ", "\n", "\"'s", "'sam", "9", "42", "é", "É", "ñ", ".", "...", "x_y", "don't", "'LL", "ss'd",
             "\t", "'t'", "7's", "Ā", "漢", "“", "<|", "İ", "½"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [None, "", " "]
    library, words = Tokenizer.from_file(PATH), packing._Words(PATH)
    for text, code in zip(texts, words.encode(texts)):
        assert np.frombuffer(code, dtype="<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_a_worker_keeps_one_operators_memory():
    from vacantia.llm import common
    first = common.remembered("a", lambda: [1])
    assert common.remembered("a", lambda: [2]) is first
    common.remembered("b", lambda: [3])
    assert list(common._REMEMBERED) == ["b"]
