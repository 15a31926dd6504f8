"""Resampling against plain tokens and checksums, and composed checksums against those of whole texts."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from vacantia.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(text):
    return WORD.findall((text or "").translate(LOWER))


def runs(text, longest):
    words = parts(text)
    return [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest, buckets, share, least):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for run in runs(t, longest):
                out[zlib.crc32(run.encode()) % buckets] += 1
        return out
    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for key, text in docs:
        found = [gain[zlib.crc32(run.encode()) % buckets] for run in runs(text, longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(found), weight, score, None, len(parts(text)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[:share * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(40)] + ["É", "ÉTÉ", "漢字", "I'm", "a_b", "x-y", "9.5", "W1"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " \n", "w1" * 3000, "w1 \t\n w2,,w3 " * 4000, "same words here " * 9] + ["same words here " * 9] * 60
    rows = [(i if i % 29 else None, t) for i, t in enumerate(texts)] + [(5, "w1 w2"), (5, "w1 w2")]
    target = [" ".join(rng.choices(words[:9], k=30)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, score string, n_words int")
    return rows, target, docs.repartition(3), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")


@pytest.mark.parametrize("longest, buckets, share, least", [(1, 10_000, 10, 20), (1, 7, 100, 0), (3, 500, 33, 5)])
def test_rows_by_brute_force(corpus, longest, buckets, share, least):
    rows, target, docs, wanted = corpus
    assert got(resampling.resample(docs, wanted, share, longest=longest, buckets=buckets, least=least)) == \
        brute(rows, target, longest, buckets, share, least)


def test_composed_checksums_are_those_of_whole_texts():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(n)) for n in [0, 1, 2, 7, 255, 256, 70_001] for _ in range(20)]
    made = resampling.compose(*(np.array(x) for x in zip(*((zlib.crc32(a), zlib.crc32(b), len(b)) for a, b in pairs))))
    assert made.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("room", [0, 5, 60_000])
def test_scans_find_every_word_whatever_the_dictionary_holds(monkeypatch, room):
    monkeypatch.setattr(resampling, "DICTIONARY", room)
    rng = random.Random(room)
    scanner = resampling.Scanner()
    for _ in range(12):
        texts = [rng.choice(["", None, " ".join(rng.choices("the of Ab É z9 漢字 -- , a1".split() + ["q" * 60], k=30))]) for _ in range(20)]
        crc, owner, words = resampling.features(scanner, texts, 2)
        want = sorted((i, zlib.crc32(run.encode())) for i, t in enumerate(texts) for run in runs(t, 2))
        assert sorted(zip(owner.tolist(), crc.tolist())) == want
        assert words.tolist() == [len(parts(t)) for t in texts]
        assert len(scanner.words) <= room


def test_empty_tables(spark, corpus):
    rows, target, docs, wanted = corpus
    assert got(resampling.resample(docs.limit(0), wanted)) == []
    assert got(resampling.resample(docs, wanted.limit(0))) == brute(rows, [], 1, 10_000, 10, 20)
