"""Language identification: sums over all segmentations by brute force, and held-out accuracy."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from vacantia.llm import language as lang

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, pieces, p, unknown):
    """Sum over all cuts of the marked word; a character without a piece has the unknown probability."""
    marked = "▁" + word

    def rest(at):
        if at == len(marked):
            return 1.0
        total = sum(p[q] * rest(at + len(q)) for q in pieces if marked.startswith(q, at))
        return total if marked[at] in pieces else total + unknown * rest(at + 1)
    return rest(0)


PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "é"]


def test_forward_sums_all_segmentations():
    vocabulary = lang.Vocabulary(PIECES)
    rng = np.random.default_rng(1)
    probability = np.r_[rng.random((len(PIECES), 2)) / 8, [[1e-7, 1e-7]]]
    model = lang.Model(["x", "y"], vocabulary, probability)
    words = ["", "a", "ab", "ababa", "bab", "éa", "axb", "zz", "ab" * 15, "ab" * 40, "a"]
    got = model.log_likelihoods(words)
    for k in range(2):
        p = dict(zip(PIECES, probability[:, k]))
        for word, value in zip(words, got[:, k]):
            if len(word) < 12:
                assert value == pytest.approx(np.log(all_segmentations(word, PIECES, p, 1e-7)))
    assert model._long("ab" * 15) == pytest.approx(got[8])
    assert np.isfinite(got).all()


def test_expected_counts_weigh_segmentations():
    vocabulary = lang.Vocabulary(PIECES)
    probability = np.r_[np.linspace(0.02, 0.2, len(PIECES)), 1e-7]
    got = lang.expected_counts(lang.Lattice(["ab"], vocabulary), np.array([3.0]), probability)
    p = dict(zip(PIECES, probability))
    cuts = [["▁", "a", "b"], ["▁a", "b"], ["▁", "ab"]]
    weight = [np.prod([p[q] for q in c]) for c in cuts]
    for i, piece in enumerate(PIECES):
        assert got[i] == pytest.approx(3 * sum(w * c.count(piece) for w, c in zip(weight, cuts)) / sum(weight))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang.learn(docs, PATH)
    rows = {r.doc_id: r for r in lang.predict(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    unseen = [k for k, r in rows.items() if r.held_out]
    assert np.mean([rows[k].lang_pred == truth[k] for k in unseen]) > 0.97
    # labels, sources and keys are no inputs
    blind = docs.selectExpr("doc_id + 7 AS doc_id", "text", "'zz' AS lang", "'s' AS source")
    assert {r.doc_id - 7: (r.lang_pred, r.score) for r in lang.predict(blind, model).collect()} == {
        k: (r.lang_pred, r.score) for k, r in rows.items()}


def test_awkward_rows(spark):
    texts = [(1, "the and of that", "en"), (2, "der und die nicht", "de"), (3, None, "de"), (4, "", "en"), (5, "42 ² -- _", None),
             (None, "the of", None), (6, "und der " * 3000, None), (6, "x" * 900, None), (7, "漢字", None), (8, "İé²", "en"), (9, "tüß", "de")]
    docs = spark.createDataFrame([(k, t, v, True) for k, t, v in texts], "doc_id long, text string, lang string, held_out boolean")
    model = lang.learn(docs, PATH)
    rows = [(r.doc_id, r.lang_pred, r.score) for r in lang.predict(docs, model).collect()]
    assert len(rows) == len(texts) and all(0 <= r[2] <= 1 for r in rows)
    assert {k for k, p, _ in rows if p == "und"} == {3, 4, 5}
    assert lang.keep_identified(docs, model).columns == docs.columns
    assert lang.predict(docs.limit(0), lang.learn(docs.limit(0), PATH)).count() == 0
    nothing = lang.learn(docs.limit(0), PATH)
    assert {r.lang_pred for r in lang.predict(docs, nothing).collect()} == {"und"}


def test_repeated_texts_are_learned_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lang, "fit", lambda texts, vocabulary: seen.update(texts))
    distinct = [f"text number {i}" for i in range(9)]
    rows = [(None, t, name) for t in distinct for name in ("a", "b")] + [(None, t, "a") for t in distinct * 40]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    lang.learn(docs, PATH, sample=6)
    assert seen["a"] == seen["b"] and len(set(seen["a"])) == len(seen["a"]) == 6
    lang.learn(docs, PATH)
    assert seen == {"a": distinct, "b": distinct}


def test_memory_that_overflows_changes_nothing(monkeypatch):
    model = lang.fit({"a": ["one two three"], "b": ["eins zwei drei"]}, lang.Vocabulary(lang.vocabulary(PATH)))
    texts = ["one eins two", "zwei drei " * 5, "three", "uno dos tres", None, "quatre cinq"]
    want = lang._Memory(model).scores(texts)
    monkeypatch.setattr(lang, "REMEMBERED", 4)
    small = lang._Memory(model)
    assert [small.scores([t])[0] for t in texts] == want
