"""The set-similarity join against all pairs by brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from vacantia.llm import common, jaccard
from vacantia.llm.common import components
from vacantia.llm.shingles import powers, shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted(((k, len(s), low.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def got(spark, rows, **columns):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, th string, n int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()), key=repr)


def corpus(seed, n):
    """Families of copies with edits, around the threshold, sharing passages and boilerplate."""
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 40))] for _ in range(4)]
    rows, key = [], 0
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        if rng.random() < 0.5:
            base += rng.choice(passages)
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((key, rng.choice([" ", "\n", "\t "]).join(copy)))
            key += 1
    rng.shuffle(rows)
    return rows


def test_awkward_rows(spark):
    rows = [(1, ""), (2, None), (3, "  \n"), (4, "one two"), (5, "ONE two"), (6, "a b c d e"), (7, "a b c d e"),
            (7, "a b c d e"), (None, "a B c d e"), (None, "alone here"), (8, "é É"), (9, "a b c"),
            (10, " ".join(map(str, range(30000)))), (11, " ".join(map(str, range(1, 30000)))), (12, "x " * 3000), (13, "x " * 9)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:0]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpora(spark, seed):
    rows = corpus(seed, 260)
    assert got(spark, rows) == brute(rows)


def test_index_alone_finds_every_link(spark, monkeypatch):
    """Without leaders, with tiny buckets and short lists, the index has to find all."""
    monkeypatch.setattr(jaccard, "LEADERS", 0)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 3)
    monkeypatch.setattr(jaccard, "COMMON", 4)
    monkeypatch.setattr(jaccard, "BUCKET", 2000)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "UNIT_BUCKET", 50)
    rows = corpus(7, 200)
    assert got(spark, rows) == brute(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(500, 7), (3, 3), (None, 2)]
    edges += [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(200)]
    rng.shuffle(edges)
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((i, find(i)) for i in list(root))
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted((r.node, r.root) for r in components(df).collect()) == want


def test_shingles_of_a_slice_do_not_depend_on_neighbours():
    texts = ["a b c d e f", "", None, "x", "a b c d e f" * 3]
    column = pa.array(texts)
    each = [next(shingle_sets(pa.array([t], pa.string()))) for t in texts]
    for got_set, want in zip(shingle_sets(column.slice(1)), each[1:]):
        assert np.array_equal(got_set, want)


def test_parity_bound_never_cuts_a_link():
    rng = np.random.default_rng(3)
    for _ in range(400):
        common = rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)
        x, y = (np.unique(np.r_[common, rng.integers(0, 1 << 63, rng.integers(1, 90), dtype=np.uint64)]) for _ in range(2))
        assert jaccard.shared_at_most(jaccard.parity(x), len(x), jaccard.parity(y), len(y)) >= len(np.intersect1d(x, y))


def test_columns_of_any_name_come_back(spark):
    names = ["_th", "_k", "_h", "_stays", "__th", "__k", "__stays", "___th"]
    same = "one two three four five six seven"
    rows = [(1, same, *range(8)), (2, same, *range(10, 18)), (3, "other words that nothing else has at all", *range(20, 28))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    assert sorted(tuple(r) for r in jaccard.keep_one(docs).collect()) == [rows[0], rows[2]]


def test_hot_shingles_are_dealt_out_and_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    common = " ".join(f"c{i}" for i in range(6))
    texts = [common + " " + " ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.choice([1, 2, 9]))) for _ in range(400)]
    texts += [common + f" x{i // 3} y z" for i in range(90)] + ["all else is other here"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {r.doc_id: r.component_id for r in jaccard.link(docs).collect()}
    monkeypatch.setattr(jaccard, "LONG_LIST", 20)
    monkeypatch.setattr(jaccard, "HOT", 10)
    seen = []
    real = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *a: (seen.append(a[-2:]), real(*a))[1])
    assert {r.doc_id: r.component_id for r in jaccard.link(docs).collect()} == want
    hot, salts = seen[0]
    assert 0 < len(hot) < 10 and salts > 10
    from tests_llm_brute import jaccard_groups
    assert want == jaccard_groups(list(enumerate(texts)))


def test_few_edges_are_one_partition(spark):
    """Components of few edges come without an exchange, however many shuffle partitions there are."""
    edges = spark.range(60).selectExpr("id as a", "id + 1 as b")
    found = components(edges)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert {r.root for r in found.collect()} == {0}


@pytest.mark.parametrize("small", [3, 1 << 16])
def test_components_in_any_number_of_partitions(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(7, 7), (None, 3)], "a long, b long")
    assert sorted((r.node, r.root) for r in components(edges).collect()) == [(i, i // 10 * 10) for i in range(40)]


def test_tables_of_the_driver_are_not_sent_to_tasks():
    """What the driver has computed for itself, 16 MB of powers, is no part of the functions that tasks receive."""
    powers(10)
    sent = cloudpickle.dumps(lambda column: list(shingle_sets(column)))
    assert len(sent) < 1 << 17
    column = pa.array(["a b c d e f", None, "a"])
    assert [s.tolist() for s in cloudpickle.loads(sent)(column)] == [s.tolist() for s in shingle_sets(column)]
