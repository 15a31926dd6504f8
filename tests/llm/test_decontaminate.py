"""Benchmark decontamination against semi-global edit distance over every text and window."""

import random

import numpy as np
import pytest

from vacantia.llm import decontaminate as d


def distance(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def word(rng):
    return "".join(rng.choices(["th", "on", "er", "ing", "é", "re", "a", "st"], k=rng.randint(1, 3)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        chars[i:i + 1] = rng.choice([[], [rng.choice("abcdeé")], [chars[i], rng.choice("xyz")]])
    return "".join(chars)


def test_against_edit_distance():
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.choice([8, 14, 30, 50]))) for i in range(8)] + [(8, None), (9, "short"), (10, "")]
    texts = ["", None, sentence(rng, 40)]
    for _ in range(60):
        _, source = rng.choice(items[:8])
        part = source if rng.random() < 0.7 else source[rng.randrange(len(source) // 2):]
        part = edited(rng, part, rng.choice([0, 1, 3, len(part) // 12, len(part) // 9, len(part) // 7])) if part else part
        texts.append(sentence(rng, rng.randint(0, 20)) + rng.choice([". ", " ", "\n"]) + part.upper() + " " + sentence(rng, rng.randint(0, 9)))
    index = d.Index(items)
    want = set()
    for row, text in enumerate(texts):
        plain = d.normal(text or "")
        for item, part, edits, _ in index.patterns:
            if distance(part, plain) <= edits:
                want.add((row, item))
    got = index.matches(texts)
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(want) > 20
    for row, item, start, end, edits in got:
        assert 0 <= start < end <= len(texts[row])
    assert {r[4] for r in got} > {0}


def test_spans_of_exact_leaks(spark):
    item = "The Énd of THE road, they said; was nearer than anyone had thought it could be when the long walk began."
    text = "İx before. " + item.replace(" ", "  ") + " After it."
    docs = spark.createDataFrame([(5, text, 1), (5, text, 2), (None, text, 3), (6, "clean " * 2000, 4), (7, None, 5), (8, "", 6)],
                                 "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "y"), (None, item, "z"), (3, "tiny", "w")],
                                  "item_id int, text string, doc_id string")
    rows = d.find(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in sorted(rows, key=str)] == [(5, 1, 0), (5, 1, 0), (None, 1, 0)]
    assert text[rows[0].start:rows[0].end] == item.replace(" ", "  ")[:-1]
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench).collect()) == [6, 7, 8]
    assert d.find(docs, bench.limit(0)).count() == 0 and d.find(docs.limit(0), bench).count() == 0


def test_blocks_see_every_item(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 3)
    rng = random.Random(9)
    items = [(i, sentence(rng, 20)) for i in range(10)]
    docs = spark.createDataFrame([(i, "so " + t + " end") for i, t in items] + [(99, sentence(rng, 60))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.find(docs, bench).collect()) == [(i, i) for i in range(10)]
    assert [r.doc_id for r in d.drop_contaminated(docs, bench).collect()] == [99]


@pytest.mark.parametrize("most", [0, 2, 5])
def test_banded_distance(most):
    rng = random.Random(most)
    code = lambda t: np.array([ord(c) for c in t], dtype=np.int64)
    for _ in range(200):
        pattern = "".join(rng.choices("ab", k=rng.randint(1, 12)))
        text = "".join(rng.choices("ab", k=rng.randint(0, 20)))
        want = distance(pattern, text)
        got = d.banded_distance(code(pattern), code(text), most, -len(pattern), len(text))
        assert (got[0] if got else None) == (want if want <= most else None)


@pytest.mark.parametrize("most", [0, 2, 5])
def test_scan_distance(most):
    rng = random.Random(most)
    for _ in range(300):
        pattern = "".join(rng.choices("ab", k=rng.randint(1, 12)))
        text = "".join(rng.choices("ab", k=rng.randint(0, 20)))
        want, got = distance(pattern, text), d.scan_distance(pattern, text, most)
        assert (got[0] if got else None) == (want if want <= most else None)
        if got:
            assert distance(pattern, text[:got[1]]) == want


def chinese(rng, n):
    return "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))


def test_any_script_against_edit_distance():
    rng = random.Random(3)
    items = [(i, chinese(rng, 60)) for i in range(3)] + [(3, "при" + sentence(rng, 12) + " привет мир и все остальные")]
    texts = [chinese(rng, 80) + edited(rng, items[i % 4][1], n) + chinese(rng, 30) for i in range(8) for n in (0, 2, 5, 9)] + [chinese(rng, 300)]
    index = d.Index(items)
    want = {(row, item) for row, t in enumerate(texts) for item, part, edits, _ in index.patterns if distance(part, d.normal(t)) <= edits}
    assert {(r[0], r[1]) for r in index.matches(texts)} == want and len(want) >= 16


def test_memory_and_time_stay_bounded_for_any_text():
    import time
    import tracemalloc
    rng = random.Random(4)
    index = d.Index([(i, chinese(rng, 100)) for i in range(1000)])
    text = chinese(rng, 100_000)
    tracemalloc.start()
    assert index.matches([text]) == []
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    start = time.perf_counter()
    repetitive = d.Index([(i, "a " * rng.randint(20, 50) + f"b{i} " + "a " * 20) for i in range(40)])
    found = repetitive.matches(["a " * 100_000, "b a " * 3000])
    assert {r[1] for r in found if r[0] == 0} == set(range(40)) and time.perf_counter() - start < 30


def test_repetitive_texts_against_edit_distance():
    rng = random.Random(6)
    items = [(i, "".join(rng.choices(["a ", "ab ", "ba "], weights=[8, 1, 1], k=30))) for i in range(12)]
    texts = ["".join(rng.choices(["a ", "ab ", "ba ", "c "], weights=[8, 1, 1, 1], k=rng.randint(0, 120))) for _ in range(40)]
    index = d.Index(items)
    want = {(row, item) for row, t in enumerate(texts) for item, part, edits, _ in index.patterns if distance(part, d.normal(t)) <= edits}
    assert {(r[0], r[1]) for r in index.matches(texts)} == want and 20 < len(want) < 480


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "The answer."), (2, "forty-two"), (3, "no"), (3, "The  ANSWER"), (None, "clean text"), (4, " .")],
                                  "item_id int, text string")
    docs = spark.createDataFrame([(1, "so the\nanswer is"), (2, "breathe answers"), (3, "No, forty two"), (4, "clean text"), (5, None), (6, "")],
                                 "doc_id long, text string")
    rows = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in d.find(docs, bench).collect())
    assert rows == [(1, 1, 3, 13, 0), (1, 3, 3, 13, 0), (3, 2, 4, 13, 0), (3, 3, 0, 2, 0)]
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench).collect()) == [2, 4, 5, 6]
