"""The pipeline's stages against brute force over a small table."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests_llm_brute import jaccard_groups
from vacantia.llm import decontaminate, jaccard, secrets

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in documents.collect()}
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), documents.schema)
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == documents.columns
    identified, single, clean, redacted = kept
    assert set(identified) == {k for k, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    groups = jaccard_groups([(k, r.text) for k, r in identified.items()])
    assert set(single) == {k for k in identified if groups[k] == k}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {k for k, r in single.items() if any(i in decontaminate.normal(r.text) for i in items)}
    assert set(clean) == set(single) - leaked and leaked
    for k, r in redacted.items():
        assert (r.text == clean[k].text) == (not secrets.scan(clean[k].text))
        assert r.n_chars == len(r.text) and not [s for s in secrets.scan(r.text) if s[1] < 3]
    assert set(redacted) == set(clean) and any(r.text != clean[k].text for k, r in redacted.items())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {k: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in redacted.items()}


def test_keep_one_with_awkward_rows(spark):
    same = "a b c d e f g h"
    rows = [(3, same, 1), (2, same, 2), (2, same, 3), (None, same, 4), (None, "only null keys here twice", 5), (None, "only null keys here twice", 6),
            (9, "", 7), (9, "", 8), (8, None, 9), (8, None, 10), (7, "another text that stays here", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int")
    kept = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in jaccard.keep_one(docs).collect())
    assert kept == sorted([(False, 2, same), (True, None, "only null keys here twice"), (False, 9, ""), (False, 9, ""), (False, 8, ""),
                           (False, 8, ""), (False, 7, "another text that stays here")])
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_stages_take_empty_tables_and_awkward_rows(spark):
    layout = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], layout)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the text of no one", "en", None, 18), (3, "same words here and there", "en", "s", 25),
            (3, "same words here and there", "en", "s", 25), (4, "thé " * 50_000, "fr", "s", 200_000)]
    docs = spark.createDataFrame(rows, layout)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), layout)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 3), (False, 4), (True, None)]
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).select("doc_id").distinct().count() == 3
