"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from vacantia.llm import vectors


def brute(rows):
    ok = [v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
          for _, v, label in rows]
    unit = [np.array(v, dtype=float) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok)]
    links = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
             for i in range(len(rows))]
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(keys) if keys else None
        out.append((key, len(links[i]), low, key is not None and key == low))
    return out


def corpus(rng, groups, dims=16):
    rows = []
    for g in range(groups):
        base = rng.normal(size=dims)
        for _ in range(rng.choice([1, 1, 3, 25])):
            v = base + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.12]) * np.linalg.norm(base) / 4
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([0.5, 2])], int(g % 3)))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [2048, 7])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = corpus(rng, 60)
    rows += [(900, rows[0][1], None), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1),
             (905, [float("inf")] + [1.0] * 15, 1), (906, [1.0, 2.0], 1), (907, [], 1), (None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    # other lengths, among them one component and more than most
    rows += [(1100 + i, v, 1) for i, v in enumerate([[1.0, 2.0], [2.0, 4.0], [2.0, 1.0], [3.0], [-3.0], [5.0], [1.0, 2.0, 0.0], [1.0] * 40, [2.0] * 40])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in vectors.near_duplicates(frame).collect()]
    want = brute(rows)
    assert len(got) == len(want)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 500 and 0.9 * there <= found <= there
    if found == there:
        assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("pivots, block", [(128, 2048), (128, 50), (512, 2048)])
def test_recall_on_the_table(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    monkeypatch.setattr(vectors, "BLOCK", block)
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    there = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None])).sum() - len(rows)
    found = sum(r.n_links for r in vectors.near_duplicates(frame).collect())
    assert 0.99 * there <= found <= there


def test_empty_and_tiny(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(2, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (3, [0.0, 1.0], 1)]
    got = sorted(tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_pivots_grow_with_the_table():
    counts = [vectors.pivots_for(n) for n in (0, 10 ** 5, 10 ** 7, 10 ** 8, 10 ** 12)]
    assert counts[0] == counts[1] == vectors.PIVOTS and counts == sorted(counts) and counts[-1] == vectors.MOST_PIVOTS
    assert counts[2] > vectors.PIVOTS and all(c % 64 == 0 for c in counts)
