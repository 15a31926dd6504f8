"""Substring deduplication by sliding sentence spans."""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import bitmap, free_name, join_counted, maybe, maybe_rows, pieces, tidy
from vacantia.llm.shingles import mix
from vacantia.session import cut_lineage

# Words that a run of consecutive sentences must have: a single sentence, which may be boilerplate, needs more than a run of
# several. A sentence has a word at least, so no run that is as short as it can be has more sentences than this.
SINGLE, SEVERAL = 30, 16
RUNS = {1: SINGLE} | {n: SEVERAL for n in range(2, SEVERAL + 1)}

# Stops of scripts without spaces need no white space after them.
_END = re.compile(r"[.!?؟۔।॥։።]+(?=\s)|\n|[。！？｡︒]+[」』”’）】》]*")
# In scripts without spaces (Thai to Tibetan, Burmese, Khmer, Kana, Han) every character counts as a word.
_BARE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNIT = re.compile(f"[{_BARE}]|[^ {_BARE}]+")
_ODD = mix(np.arange(1, 1 + max(RUNS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words in lower case) of the sentences of a text: they end after . ! ? before white space, at lines, and
    after the stops of other scripts."""
    found, start = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        part = text[start:end]
        words = part.lower().split()
        if words:
            bare = part.strip()
            at = start + part.index(bare[0])
            found.append((at, at + len(bare), " ".join(words)))
        start = end
    return found


def n_words(plain: str) -> int:
    """Words of a sentence with single spaces; a character counts as one where the script has no spaces."""
    return plain.count(" ") + 1 if plain.isascii() else len(_UNIT.findall(plain))


def runs(texts: list[str | None], sizes: dict[int, int] = RUNS) -> dict[str, np.ndarray]:
    """Runs of the texts as columns: row, first sentence, sentences, start, end, hash, length.

    From and up to every sentence, the shortest run with enough words. Longer runs are unions of these, and where a longer
    one repeats, these repeat in it.
    """
    row, start, end, code, words, length = [], [], [], [], [], []
    for number, text in enumerate(texts):
        for s, e, plain in sentences(text or ""):
            row.append(number)
            start.append(s)
            end.append(e)
            code.append(xxhash.xxh64_intdigest(plain))
            words.append(n_words(plain))
            length.append(len(plain) + 1)
    row, start, end, words, length = (np.array(x, dtype=np.int64) for x in (row, start, end, words, length))
    code = np.array(code, dtype=np.uint64)
    first = np.searchsorted(row, row)  # index of the text's first sentence
    parts = []
    for size, least in sizes.items():
        whole = len(row) - size + 1
        if whole <= 0:
            continue
        total = sum(words[k:whole + k] for k in range(size))
        spare = total - np.maximum(words[:whole], words[size - 1:])  # without its first sentence, or its last
        at = np.flatnonzero((row[:whole] == row[size - 1:]) & (total >= least) & (spare < sizes.get(size - 1, 1)))
        mixed = mix(sum(mix(code[at + k]) * _ODD[k] for k in range(size)) + np.uint64(size))
        parts.append((row[at], at - first[at], np.full(len(at), size), start[at], end[at + size - 1], mixed.view(np.int64),
                      sum(length[at + k] for k in range(size))))
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * 7
    return dict(zip(("row", "first", "n", "start", "end", "hash", "size"), columns))


def _runs(docs: DataFrame, key: str, text: str, wanted: np.ndarray | None = None) -> DataFrame:
    """The runs of all documents, or those whose hash may be in a bitmap; ``k`` is the key and ``th`` the text's hash."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                found = runs(piece.column(1).to_pylist())
                if wanted is not None:
                    hit = maybe(wanted, found["hash"])
                    found = {name: column[hit] for name, column in found.items()}
                at = pa.array(found.pop("row"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(at), piece.column(2).take(at), *map(pa.array, found.values())],
                    names=["k", "th", *found])
    return docs.select(key, text, F.xxhash64(text).alias("th")).mapInArrow(
        tidy(work), f"k {kind}, th long, first long, n long, start long, end long, hash long, size long")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, th, start, end, n_sentences, first_key): sentences that a non-first repeated run covers.

    Runs of two or more consecutive sentences with ``SEVERAL`` words, and single sentences with ``SINGLE``, are compared in
    lower case with single spaces. A passage that repeats is found where it holds whole sentences of so many words; one
    inside a long sentence, or with fewer whole words between two cut sentences, is not. The first occurrence of a run is the one with the smallest (key, text hash, place),
    null keys last; every sentence under any other occurrence is covered, and touching runs make one span. ``start`` and
    ``end`` are code points, ``th`` the hash of the text, ``first_key`` a document that keeps the span's text (for spans of
    several runs, the smallest). Rows that repeat key and text are one document with one result. Null, empty and white
    texts have no runs. Other columns are not read.

    Runs are compared by counts and minima per hash, which are combined before the shuffle; the runs that repeat are then
    read again behind a bitmap, so only they are joined, and those of the most common runs where they lie.
    """
    docs = docs.select(key, text)
    name = ["hash", "size"]
    repeated = cut_lineage(
        _runs(docs, key, text).groupBy(*name).agg(F.count("*").alias("c"), F.min("k").alias("low")).where("c > 1"))
    again = cut_lineage(_runs(docs, key, text, bitmap(repeated, "hash")).distinct())
    found = cut_lineage(join_counted(again, repeated, name, "c"))
    first = cut_lineage(found.where("k <=> low").groupBy(*name).agg(F.min(F.struct("th", "start")).alias("f"), F.first("c").alias("c"))
                        .select(*name, F.col("f.th").alias("first_th"), F.col("f.start").alias("first_start"), "c"))
    covered = join_counted(found.drop("c"), first, name, "c").where("NOT (k <=> low AND th = first_th AND start = first_start)")
    # touching runs of a document become one span
    doc = Window.partitionBy("k", "th").orderBy("first", "n")
    reach = F.max(F.col("first") + F.col("n")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = (covered.groupBy("k", "th", "first", "n", "start", "end").agg(F.min("low").alias("low"))
             .withColumn("reach", reach)
             .withColumn("span", F.sum(F.when(F.col("reach") >= F.col("first"), 0).otherwise(1)).over(
                 doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return spans.groupBy("k", "th", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max(F.col("first") + F.col("n")) - F.min("first")).alias("n_sentences"), F.min("low").alias("first_key")).select(
        F.col("k").alias(key), "th", "start", "end", "n_sentences", "first_key")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the covered sentences, all columns kept; see ``repeated_spans``.

    Only texts that lose something go through the join; the others pass by a bitmap of text hashes.
    """
    spans = cut_lineage(repeated_spans(docs, key, text))
    marks = bitmap(spans, "th")
    own, held, other, same = (free_name(docs, n) for n in ("__th", "__spans", "__k", "__h"))
    hashed = docs.withColumn(own, F.xxhash64(text))
    lists = spans.groupBy(F.col(key).alias(other), F.col("th").alias(same)).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias(held))
    touched = maybe_rows(hashed, own, marks)
    kept = F.aggregate(
        held, F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("done")),
        lambda a, s: F.struct(F.concat(a["text"], F.substring(F.col(text), (a["done"] + 1).cast("int"), (s["start"] - a["done"]).cast("int"))).alias("text"),
                              s["end"].alias("done")),
        lambda a: F.trim(F.concat(a["text"], F.substring(F.col(text), (a["done"] + 1).cast("int"), F.lit(2 ** 31 - 1)))))
    joined = touched.join(lists, F.col(key).eqNullSafe(F.col(other)) & (F.col(own) == F.col(same)), "left")
    changed = joined.withColumn(text, F.when(F.col(held).isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
    return maybe_rows(hashed, own, marks, wanted=False).select(*docs.columns).union(changed)
