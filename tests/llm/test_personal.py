"""Fixed shapes by plain expressions, messages against sums over all labellings, and labels that spread in a document."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from vacantia.llm import personal

TRAINING = [f"call me +1 ({200 + i}) 555-{1000 + i} or write who.{i}@mail{i % 9}.example.com, card {4000000000000002 + 0 * i} "
            f"host 10.0.{i % 250}.{i % 99} in {1900 + i} room {i} at {i}:30" for i in range(120)]


def brute(text):
    """Every kind by scanning with its plain expression."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


@pytest.fixture(scope="module")
def model():
    return personal.fit(TRAINING)


def test_fixed_shapes_by_brute_force():
    rng = random.Random(12)
    parts = ["a.b", "@", "x-y.com", ".", "+1", " (743) ", "555-3824", "4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "256.1.1.1",
             " ", "-", "1", "999", "00012", "é", "٣", "@@", "+", "--", "0" * 14, "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert personal.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "1 " * 100_000,
                                  "+1 555 123 4567 " * 12_000, "x1" * 100_000, "a.b@c.de " * 20_000])
def test_long_texts_take_time_in_proportion(model, text):
    base, inferred = personal.scan([text], model)[0]
    assert len(base) in (0, 12_000, 20_000, 25_000)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(5)
    model = personal.Model(rng.normal(size=(personal.WEIGHTS, 5)), rng.normal(size=(4, 5, 5)))
    graph = personal.Graph([0] * 5, [(i, i + 1) for i in range(5)], [-1, 2, -1, -1, -1], [[1, 2], [3, 4], [5, 6], [7, 8], [1, 9]],
                           [(0, 1, 0), (0, 2, 1), (2, 3, 2), (2, 4, 3)])
    unary, want = model.unary(graph), np.zeros((5, 5))
    for labels in itertools.product(range(5), repeat=5):
        mass = np.exp(sum(unary[i, k] for i, k in enumerate(labels))
                      + sum(model.potentials[k, labels[a], labels[b]] for a, b, k in graph.edges))
        want[range(5), labels] += mass
    assert model.marginals(graph) == pytest.approx(want / want.sum(axis=1, keepdims=True))


def test_learning_raises_the_likelihood_of_labels(model):
    graph = personal.Graph()
    for i, text in enumerate(TRAINING[:30]):
        graph.add(i, text, personal.base_spans(text))
    truth = np.maximum(np.array(graph.label), 0)
    assert set(truth.tolist()) >= {0, 1, 2, 3, 4}
    graph.label = [-1] * len(truth)
    assert (model.marginals(graph).argmax(axis=1) == truth).mean() > 0.97


@pytest.mark.parametrize("text, spans", [
    ("call +1 (743) 555-3824 now; later (743) 555-3824, or 743-555-3824. Room 12345678, 2024-05-17",
     "phone:5:22,like_phone:34:48,like_phone:53:65"),
    ("4111 1111 1111 1111 not 4111.1111.1111.1112 but 4111.1111.1111.1111", "card:0:19,like_card:48:67"),
    ("(743) 555-3824 stands alone", ""), ("version 1.2 of 2024, 12 items", ""), ("1.2.3.4 and 1.2.3.5", "ip:0:7,ip:12:19")])
def test_labels_spread_to_like_tokens_of_the_document_only(model, text, spans):
    assert personal.joined(*personal.scan([text], model)[0]) == spans


def test_texts_without_a_fixed_shape_are_inferred_on(model):
    text = "call me 1 (200) 555-1000 or write, call me 1 (200) 555-1000 or write"
    base, inferred = personal.scan(["", text, "no digits"], model)[1]
    assert base == [] and [text[s:e] for s, _, e in inferred] == ["1 (200) 555-1000"] * 2
    assert {personal.KINDS[k] for _, k, _ in inferred} == {"phone"}


def test_like_tokens_make_edges_in_proportion(model):
    text = "call +1 743 555 3824 " + "x (743) 555-3824 " * 5000
    graph = personal.Graph()
    graph.add(0, text, personal.base_spans(text))
    assert len(graph.edges) < 4 * len(graph.span)
    assert len(personal.scan([text], model)[0][1]) == 5000


def test_queries_rows_and_awkward_tables(spark, model):
    texts = TRAINING[:40] + ["", None, "no digits", "call é+1 743 555 3824 now, or (743) 555-3824, or 743-555-3824"] + ["a.b@c.de"] * 60
    rows = [(i if i % 7 else None, t, "clash", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_card int").repartition(3)
    found = personal.find_personal(docs, personal.learn(docs)).collect()
    got = sorted((repr((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in found))
    want = []
    for key, text, *_ in rows:
        base = brute(text or "")
        joined = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append(repr((key, *(sum(k == n for _, n, _ in base) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest())))
    assert got == sorted(want)
    spans = {r.doc_id: r.spans for r in personal.find_personal(docs, model).collect()}
    assert spans[43] == "phone:6:21,like_phone:30:44,like_phone:49:61" and spans[41] == spans[40] == ""
    assert personal.find_personal(docs.limit(0), personal.learn(docs.limit(0))).collect() == []
