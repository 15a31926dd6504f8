"""Ranked lexical search: the best documents of each query, by best-first search over document intervals.

The index is a stored table with one row per block of documents: keys and lengths, and for each term its posting list in
key order. Within a block every posting has an integer impact, and a sparse table of range maxima covers each list. A
query starts with the interval of the whole block. An interval's bound is the sum, over the query's terms, of the largest
impact in it times the term's weight. The interval with the highest bound is split at the document with the largest single
contribution, which is scored and leaves; both rests get bounds of their own. Search ends where no bound can reach the
best documents found, so the answer is exact.
"""

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vacantia.llm.common import bitmap, maybe, pieces, tidy
from vacantia.session import cut_lineage

# A block of the index holds at most so many documents, postings and bytes of text, but one document at least.
BLOCK_DOCS, BLOCK_POSTINGS, BLOCK_BYTES = 1 << 15, 1 << 19, 1 << 25
# Distinct query texts are searched in blocks of about this many bytes; the driver and each task hold one.
QUERY_BYTES = 1 << 24
# Intervals of one query that are split in one step.
STEP = 32
# Words of which a task remembers whether a query may ask for them.
REMEMBERED = 200_000

# Bytes of terms: letters, digits and all beyond ASCII, with A-Z in lower case; everything else is a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def placed(key) -> tuple:
    """Sorts keys, null ones last."""
    return (True,) if key is None else (False, key)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count adds per unit of weight, in a document of n terms."""
    m = 75 + (25 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Index:
    """A stored index: its blocks, how many documents have a term, and how many terms all have."""

    blocks: DataFrame
    documents: int
    length: int


class _Builder:
    """Collects the postings of one block; ``words`` is a bitmap of the terms to keep, or None for all."""

    def __init__(self, words: np.ndarray | None):
        self.words = words
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self):
        self.terms: list[bytes] = []
        self.keys, self.lengths, self.docs, self.found, self.bytes, self.postings = [], [], [], [], 0, 0
        self.known = {t: -1 for t, code in self.known.items() if code < 0} if len(self.known) < REMEMBERED else {}

    def _codes(self, new: list[bytes]):
        """Number the terms not met before, -1 for those that no query asks for."""
        keep = [True] * len(new)
        if self.words is not None and new:
            keep = maybe(self.words, np.array([zlib.crc32(t) for t in new], dtype=np.int64)).tolist()
        for term, wanted in zip(new, keep):
            self.known[term] = len(self.terms) if wanted else -1
            if wanted:
                self.terms.append(term)

    def add(self, keys: list, texts: list[str | None]):
        for key, text in zip(keys, texts):
            terms = terms_of(text)
            if not terms:
                continue
            counts = Counter(terms)
            known = self.known
            new = [t for t in counts if t not in known]
            if new:
                self._codes(new)
            codes = np.fromiter(map(known.__getitem__, counts), dtype=np.int64, count=len(counts))
            tf = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
            kept = codes >= 0
            self.docs.append(np.stack([codes[kept], np.full(kept.sum(), len(self.keys)), tf[kept]]))
            self.keys.append(key)
            self.lengths.append(len(terms))
            self.postings += int(kept.sum())
            self.bytes += len(text)
            if len(self.keys) >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS or self.bytes >= BLOCK_BYTES:
                yield self.block()
                self.clear()

    def block(self) -> dict:
        order = sorted(range(len(self.keys)), key=lambda i: placed(self.keys[i]))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        code, doc, tf = np.concatenate(self.docs, axis=1)
        by = np.lexsort((place[doc], code))
        return {
            "keys": [self.keys[i] for i in order], "lengths": np.array(self.lengths, dtype="<i8")[order].tobytes(),
            "total": sum(self.lengths), "terms": self.terms,
            "dfs": np.bincount(code, minlength=len(self.terms)).tolist(),
            "docs": place[doc][by].astype("<u4").tobytes(), "tfs": tf[by].astype("<u4").tobytes()}


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", queries: DataFrame | None = None,
                query_text: str = "text") -> Index:
    """Index every document whole, in a table in the shared folder.

    With ``queries``, posting lists are kept only for terms that a bitmap of the queries' terms does not rule out; without,
    for all terms. Documents without a term (null and empty texts too) are in no list and count nowhere. Every row is a
    document of its own, repeated and null keys included; null keys come last in key order. Other columns are not read.
    """
    words = None
    if queries is not None:
        asked = queries.select(F.col(query_text).alias("text")).mapInArrow(tidy(_query_terms), "crc long")
        words = bitmap(asked.distinct(), "crc")
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"keys array<{kind}>, lengths binary, total long, terms array<binary>, dfs array<int>, docs binary, "
              "tfs binary")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    types = pa.schema([
        ("keys", pa.list_(to_arrow_type(docs.schema[key].dataType))), ("lengths", pa.binary()), ("total", pa.int64()),
        ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())])

    def run(batches):
        builder = _Builder(words)
        for batch in batches:
            for piece in pieces(batch, "text"):
                for block in builder.add(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    yield pa.RecordBatch.from_pylist([block], schema=types)
        if builder.keys:
            yield pa.RecordBatch.from_pylist([builder.block()], schema=types)
    blocks = cut_lineage(rows.mapInArrow(tidy(run), schema))
    total = blocks.agg(F.sum(F.size("keys")).alias("n"), F.sum("total").alias("l")).first()
    return Index(blocks, int(total.n or 0), int(total.l or 0))


def _query_terms(batches):
    for batch in batches:
        for piece in pieces(batch, "text"):
            found = {t for text in piece.column(0).to_pylist() for t in terms_of(text)}
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(t) for t in found], pa.int64())], names=["crc"])


class Block:
    """A block opened for search: impacts and their range maxima, over all posting lists laid end to end.

    An entry of the sparse table is an impact and, below it, the posting's place counted from the end, so that the first
    of equal impacts wins. Ranges never cross from one list into the next, so one table serves every list.
    """

    def __init__(self, keys: list, lengths: bytes, terms: list[bytes], dfs: list[int], docs: bytes, tfs: bytes,
                 documents: int, length: int):
        self.keys = keys
        self.order = [placed(k) for k in keys]
        self.docs = np.frombuffer(docs, dtype="<u4").astype(np.int64)
        n = np.frombuffer(lengths, dtype="<i8")
        self.impact = impacts(np.frombuffer(tfs, dtype="<u4").astype(np.int64), n[self.docs], documents, length)
        size = np.array(dfs, dtype=np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.code = {t: i for i, t in enumerate(terms)}
        # lists in one array that is sorted throughout: the list's number, then the document
        self.entries = (np.repeat(np.arange(len(size)), size) << 32) | self.docs
        here = (self.impact << 32) | (len(self.docs) - 1 - np.arange(len(self.docs)))
        self.levels = [here]
        for j in range(int(size.max(initial=1)).bit_length() - 1):
            half = 1 << j
            above = here.copy()
            np.maximum(here[:-half], here[half:], out=above[:-half])
            self.levels.append(above)
            here = above
        self.table = np.stack(self.levels)

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact in each range of postings and the place of its first posting; 0 where a range is empty."""
        width = hi - lo
        held = width > 0
        level = np.where(held, np.frexp(np.maximum(width, 1))[1] - 1, 0)
        lo, last = np.where(held, lo, 0), np.where(held, hi - (1 << level), 0)
        best = np.maximum(self.table[level, lo], self.table[level, last])
        return np.where(held, best >> 32, 0), len(self.docs) - 1 - (best & 0xFFFFFFFF)

    def search(self, query: list[tuple[bytes, int]], best: "Best") -> None:
        """Offer to ``best`` every document that can be among its k; ``query`` is terms with their weights."""
        held = [(self.code[t], w) for t, w in query if w > 0 and t in self.code]
        if not held:
            return
        code, w = np.array(held, dtype=np.int64).T
        lo, hi = self.start[code][None, :], self.end[code][None, :]
        peak, place = self.largest(lo, hi)
        bound = (peak * w).sum(axis=1)
        first = np.zeros(1, dtype=np.int64)  # an interval's first document
        while len(bound):
            least, limit = best.floor(self.order)
            alive = (bound > least) | ((bound == least) & (first < limit))
            if not alive.all():
                lo, hi, peak, place, bound, first = (x[alive] for x in (lo, hi, peak, place, bound, first))
                if not len(bound):
                    return
            if len(bound) > STEP:
                at = np.lexsort((first, -bound))
                now, later = at[:STEP], at[STEP:]
            else:
                now, later = slice(None), slice(0, 0)
            a, b, top = lo[now], hi[now], (peak[now] * w).argmax(axis=1)
            split = self.docs[place[now][np.arange(len(a)), top]]
            # where the split document stands, or would stand, in each list
            at = np.searchsorted(self.entries, (code << 32)[None, :] | split[:, None])
            at = np.minimum(np.maximum(at, a), b)
            inside = at < b
            here = np.where(inside, at, 0)
            inside &= self.docs[here] == split[:, None]
            best.offer((np.where(inside, self.impact[here], 0) * w).sum(axis=1), split, self.keys, self.order)
            new_lo, new_hi = np.concatenate([a, at + inside]), np.concatenate([at, b])
            new_first = np.concatenate([first[now], split + 1])
            new_peak, new_place = self.largest(new_lo, new_hi)
            new_bound = (new_peak * w).sum(axis=1)
            some = new_bound > 0
            lo, hi, peak, place, bound, first = (
                np.concatenate([x[later], y[some]]) for x, y in (
                    (lo, new_lo), (hi, new_hi), (peak, new_peak), (place, new_place), (bound, new_bound), (first, new_first)))


class Best:
    """The k best (score, key) pairs offered so far, higher scores first and then smaller keys, null keys last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self, order: list) -> tuple[int, int]:
        """The score to reach, and before which place of a block's key order an equal score still counts."""
        if len(self.rows) < self.k:
            return 0, 0
        score, key, _ = self.rows[-1]
        return -score, bisect_right(order, key)

    def offer(self, scores: np.ndarray, docs: np.ndarray, keys: list, order: list) -> None:
        least = -self.rows[-1][0] if len(self.rows) == self.k else 1
        rows = [(-s, order[d], keys[d]) for s, d in zip(scores.tolist(), docs.tolist()) if s >= least]
        if rows:
            self.rows = sorted(self.rows + rows, key=lambda r: r[:2])[:self.k]


def _opened(batches, documents: int, length: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys, lengths, _, terms, dfs, docs, tfs = (c[i].as_py() for c in batch.columns)
            if terms:
                yield Block(keys, lengths, terms, dfs, docs, tfs, documents, length)


def search(index: Index, queries: DataFrame, item: str = "item_id", text: str = "text", key: str = "doc_id",
           k: int = 20) -> DataFrame:
    """The k best documents of every query with a score above 0: (item, rank, key, score), ranked from 1.

    Equal scores are ranked by ascending key. Every row of ``queries`` is an item of its own: repeated rows repeat their
    answer, null items keep it, null texts and texts without a term have none. Equal texts are searched once. Texts are
    searched in blocks of bounded size against the whole index; a task keeps the k best of each query over all its blocks
    of documents.
    """
    spark = queries.sparkSession
    kind = index.blocks.schema["keys"].dataType.elementType.simpleString()
    asked = cut_lineage(queries.select(F.col(item).alias("item"), F.col(text).alias("text"),
                                       F.xxhash64(text).alias("query")).where("text IS NOT NULL"))
    texts = asked.groupBy("query").agg(F.min("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    frequency = cut_lineage(index.blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
                            .groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df")))
    found = spark.createDataFrame([], f"query long, key {kind}, score long")
    for number in range(blocks):
        part = [(r.query, Counter(terms_of(r.text)))
                for r in texts.where(F.pmod("query", F.lit(blocks)) == number).collect()]
        wanted = spark.createDataFrame([(bytearray(t),) for t in set().union(*(c for _, c in part))], "term binary")
        df = {bytes(r.term): r.df for r in frequency.join(F.broadcast(wanted), "term").collect()}
        weighted = [(query, [(t, n * weight(index.documents, df[t])) for t, n in counts.items() if t in df])
                    for query, counts in part]
        found = found.union(_candidates(index, [(q, w) for q, w in weighted if w], k, kind))
    ranked = (cut_lineage(found)
              .withColumn("rank", F.row_number().over(
                  Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last())))
              .where(F.col("rank") <= k))
    return asked.select("item", "query").join(ranked, "query").select(
        F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _candidates(index: Index, weighted: list[tuple[int, list[tuple[bytes, int]]]], k: int, kind: str) -> DataFrame:
    documents, length = index.documents, index.length
    key_type = to_arrow_type(index.blocks.schema["keys"].dataType.elementType)

    def run(batches):
        best = [Best(k) for _ in weighted]
        for block in _opened(batches, documents, length):
            for (_, terms), rows in zip(weighted, best):
                block.search(terms, rows)
        rows = [(query, r[2], -r[0]) for (query, _), b in zip(weighted, best) for r in b.rows]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("query", "key", "score"), zip(*rows))), schema=pa.schema(
                [("query", pa.int64()), ("key", key_type), ("score", pa.int64())]))
    return index.blocks.mapInArrow(tidy(run), f"query long, key {kind}, score long")
