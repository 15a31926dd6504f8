"""Repeated sentence runs against brute force."""

import random

import pytest

from vacantia.llm import sentences as sn


def brute(rows):
    """Covered sentence indexes of every distinct (key, text)."""
    docs = sorted({(k is None, k or 0, i): (k, t) for i, (k, t) in enumerate(dict.fromkeys(rows))}.items())
    first, covered = {}, {}
    for _, (key, text) in docs:
        found = sn.sentences(text or "")
        for size, least in sn.RUNS.items():
            for at in range(len(found) - size + 1):
                run = tuple(s[2] for s in found[at:at + size])
                if sum(len(s.split()) for s in run) >= least:
                    place = (key, text, at)
                    if first.setdefault(run, place) != place:
                        covered.setdefault((key, text), set()).update(range(at, at + size))
    return covered


def make(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "the"]
    pool = [" ".join(rng.choices(words, k=rng.choice([1, 4, 9, 15, 45]))) for _ in range(40)]
    rows = []
    for k in range(90):
        body = []
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(36)
            body += pool[at:at + rng.randint(1, 4)] if rng.random() < 0.6 else [" ".join(rng.choices(words, k=8))]
        rows.append((k, "".join(s.capitalize() + rng.choice([". ", ".\n", "\n", "!  ", "? "]) for s in body)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = make(seed)
    rows += [(200, None), (201, ""), (202, " \n . "), (None, rows[3][1]), (None, rows[3][1]), (7, rows[7][1]), (300, "long one. " * 4000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int")
    want = brute(rows)
    got, texts = {}, {hash_of(spark, t): t for _, t in rows if t is not None}
    for r in sn.repeated_spans(docs).collect():
        text = texts[r.th]
        inside = [i for i, (s, e, _) in enumerate(sn.sentences(text)) if r.start <= s and e <= r.end]
        assert len(inside) == r.n_sentences and r.first_key is not None
        assert got.setdefault((r.doc_id, text), set()).isdisjoint(inside)
        got[r.doc_id, text].update(inside)
    assert got == want and len(want) > 5
    cleaned = sn.remove_repeats(docs).collect()
    assert len(cleaned) == len(rows)
    left = sorted((r.doc_id is None, r.doc_id or 0, [s[2] for s in sn.sentences(r.text or "")]) for r in cleaned)
    assert left == sorted((k is None, k or 0, [s[2] for i, s in enumerate(sn.sentences(t or "")) if i not in want.get((k, t), ())]) for k, t in rows)


def hash_of(spark, text, known={}):
    if text not in known:
        known[text] = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t)").first()[0]
    return known[text]


def test_passages_of_over_fifty_words_are_found_in_other_documents():
    rng = random.Random(5)
    for cuts in range(1, 12):
        passage = [" ".join(f"p{rng.randrange(999)}" for _ in range(max(1, 52 // cuts))) + "." for _ in range(cuts)]
        passage[-1] = passage[-1][:-1] + " end" * max(0, 51 - 52 // cuts * cuts) + "."
        text = " ".join(passage)
        found = sn.runs(["Before it. " + text + " After it.", "Other start.\n" + text + "\nOther end."])
        hashes = [set(found["hash"][found["row"] == row]) for row in (0, 1)]
        assert hashes[0] & hashes[1], cuts


def shared(a, b):
    found = sn.runs([a, b])
    return set(found["hash"][found["row"] == 0]) & set(found["hash"][found["row"] == 1])


def test_passages_of_over_fifty_words_in_many_short_lines_are_found():
    rng = random.Random(6)
    for lines in range(12, 52):
        passage = [f"p{rng.randrange(999)}" for _ in range(51)]
        text = "\n".join(" ".join(passage[51 * i // lines:51 * (i + 1) // lines]) for i in range(lines))
        assert shared("Before it.\n" + text + "\nAfter it.", "Other start\n" + text + "\nother end"), lines


@pytest.mark.parametrize("whole", [(13, 9), (30,), (8, 8), (1, 2, 3, 4, 6), (12, 12), (39,)])
def test_passages_that_start_and_end_inside_a_sentence_are_found(whole):
    rng = random.Random(7)
    words = lambda n: " ".join(f"p{rng.randrange(999)}" for _ in range(n))
    rest = 51 - sum(whole)
    text = " ".join([words(rest // 2) + ".", *(words(n) + "." for n in whole), words(rest - rest // 2)])
    assert shared("Here begins " + text + " and goes on.", "Elsewhere is " + text + " but not so.")


def test_scripts_without_spaces():
    same = "这是第一个重复的句子。这是第二个重复的句子！「还有一个。」"
    assert [s[2] for s in sn.sentences(same)] == ["这是第一个重复的句子。", "这是第二个重复的句子！", "「还有一个。」"]
    assert shared("开头不同，" + same + "结尾", "另外一段，" + same + "别的话")
    assert sn.n_words("สวัสดี hello") == 7 and sn.n_words("it's été") == 2
    assert [s[2] for s in sn.sentences("यह एक है। वह दो है।")] == ["यह एक है।", "वह दो है।"]


def test_spans_of_short_lines_are_removed(spark):
    lines = "\n".join(f"row{i} cell{i}" for i in range(26))
    docs = spark.createDataFrame([(1, "First here.\n" + lines), (2, "Second there.\n" + lines + "\nlast")], "doc_id long, text string")
    (span,) = sn.repeated_spans(docs).collect()
    assert (span.doc_id, span.n_sentences, span.first_key) == (2, 26, 1)
    assert {r.doc_id: r.text.split() for r in sn.remove_repeats(docs).collect()}[2] == ["Second", "there.", "last"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sn.repeated_spans(docs).count() == 0 and sn.remove_repeats(docs).count() == 0


@pytest.mark.parametrize("line", ["Terms of use apply to all content of this site and of its many parts today.", "Two words."])
def test_one_shared_sentence_of_boilerplate_is_no_run(line):
    assert not shared(f"Here is one text. {line} It ends here.", f"Another begins. {line} Other end.")


def test_columns_of_any_name_come_back(spark):
    names = ["_th", "_k", "_h", "_stays", "_spans", "__th", "__k", "__spans", "___th"]
    lines = "\n".join(f"row{i} cell{i}" for i in range(26))
    rows = [(1, "First here.\n" + lines, *range(9)), (2, "Second there.\n" + lines, *range(10, 19)), (3, "clean", *range(20, 29))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    got = sorted(tuple(r) for r in sn.remove_repeats(docs).collect())
    assert [(r[0], *r[2:]) for r in got] == [(r[0], *r[2:]) for r in rows] and got[1][1].strip() == "Second there."


def test_hot_runs_stay_where_they_lie(spark):
    same = "One sentence of this passage comes first here. " + "And then another one follows with many more words in it."
    rows = [(i, f"Text {i} begins. {same} Its end {i}.") for i in range(3000)] + [(9000 + i, f"only {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sn.repeated_spans(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 3000)) and {r.first_key for r in got} == {0}
