"""Ranked search against scoring every document, and its range maxima against plain maxima."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vacantia.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(key, Counter(parts(t))) for key, t in docs if parts(t)]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        rows = []
        for key, c in held:
            m = 75 + (25 * c.total() * n_docs) // length
            score = sum(ranked.weight(n_docs, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in parts(text) if t in c)
            if score > 0:
                rows.append((-score, key is None, key if key is not None else 0))
        found += [(item, rank, key if not null else None, -s) for rank, (s, null, key) in enumerate(sorted(rows)[:k], 1)]
    return sorted(found, key=repr)


def answers(index, queries, k=20):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(index, queries, k=k).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    common = [f"w{i}" for i in range(8)]
    rare = [f"Rare{i}É" for i in range(60)]
    texts = [" ".join(rng.choices(common + rare[:20], k=rng.randint(0, 30)) + rng.sample(rare, 3)) for _ in range(500)]
    texts += ["w1 w2 same-Text rare5É"] * 90 + [None, "", " .,;", "漢字 w1", "w1 " * 20_000, "long" * 5000]
    rows = [(i if i % 37 else None, t) for i, t in enumerate(texts)] + [(7, "w1 again"), (7, "w1 again")]
    rng.shuffle(rows)
    items = [(i, " ".join(rng.choices(common, k=3) + rng.choices(rare, k=2))) for i in range(25)]
    items += [(100, "w1 w2 same text rare5É"), (100, "w1 w1 w1"), (101, None), (102, ""), (None, "漢字"), (103, "absent"),
              (104, "w1 again"), (104, "w1 again"), (105, "LONG" * 5000)]
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, score string, rank int")
    return rows, items, docs.repartition(3), spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, query int")


@pytest.mark.parametrize("pruned", [True, False])
def test_answers_are_those_of_scoring_every_document(corpus, pruned, monkeypatch):
    rows, items, docs, queries = corpus
    index = ranked.build_index(docs, queries=queries if pruned else None)
    assert answers(index, queries) == brute(rows, items, 20)
    assert answers(index, queries, 3) == brute(rows, items, 3)


def test_many_small_blocks_of_documents_and_of_queries_answer_alike(spark, corpus):
    rows, items, docs, queries = corpus
    builder = ranked._Builder(None)
    found = [b for i in range(0, len(rows), 40) for b in
             builder.add([k for k, _ in rows[i:i + 40]], [t for _, t in rows[i:i + 40]])]
    assert not found and builder.block()["total"] == sum(len(parts(t)) for _, t in rows)
    old = ranked.QUERY_BYTES
    ranked.QUERY_BYTES = 5000
    try:
        assert answers(ranked.build_index(docs, queries=queries), queries) == brute(rows, items, 20)
    finally:
        ranked.QUERY_BYTES = old


def test_blocks_end_at_their_bounds(monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 10)
    builder = ranked._Builder(None)
    blocks = list(builder.add(list(range(35)), [f"a b{i}" for i in range(35)]))
    assert [b["keys"] for b in blocks] == [list(range(i, i + 10)) for i in (0, 10, 20)] and builder.keys == list(range(30, 35))
    assert all(sum(b["dfs"]) == 20 and b["dfs"][b["terms"].index(b"a")] == 10 for b in blocks)


def test_range_maxima_are_plain_maxima():
    rng = np.random.default_rng(3)
    builder = ranked._Builder(None)
    list(builder.add(list(range(300)), [" ".join(f"t{j}" for j in rng.integers(0, 12, 30)) for _ in range(300)]))
    b = builder.block()
    block = ranked.Block(b["keys"], b["lengths"], b["terms"], b["dfs"], b["docs"], b["tfs"], 300, b["total"])
    for start, end in zip(block.start, block.end):
        for _ in range(40):
            lo, hi = sorted(rng.integers(start, end + 1, 2))
            best, place = block.largest(np.array([lo]), np.array([hi]))
            want = block.impact[lo:hi].max(initial=0)
            assert best[0] == want
            if hi > lo:
                assert place[0] == lo + block.impact[lo:hi].argmax()


def test_search_splits_fewer_intervals_than_there_are_documents(monkeypatch):
    rng = random.Random(2)
    builder = ranked._Builder(None)
    list(builder.add(list(range(5000)), [" ".join(rng.choices([f"t{int(rng.paretovariate(0.7))}" for _ in range(40)], k=20)) for _ in range(5000)]))
    b = builder.block()
    block = ranked.Block(b["keys"], b["lengths"], b["terms"], b["dfs"], b["docs"], b["tfs"], 5000, b["total"])
    scored = []
    offer = ranked.Best.offer
    monkeypatch.setattr(ranked.Best, "offer", lambda self, s, d, *a: (scored.append(len(d)), offer(self, s, d, *a)))
    best = ranked.Best(20)
    block.search([(b"t900", 5000), (b"t40", 3000), (b"t1", 20), (b"t2", 40)], best)
    assert len(best.rows) == 20 and sum(scored) < 1500


def test_empty_tables(spark, corpus):
    _, items, docs, queries = corpus
    assert answers(ranked.build_index(docs.limit(0), queries=queries), queries) == []
    assert answers(ranked.build_index(docs, queries=queries.limit(0)), queries.limit(0)) == []
    assert answers(ranked.build_index(docs.where("text IS NULL")), queries) == []
