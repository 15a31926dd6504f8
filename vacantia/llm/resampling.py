"""Importance resampling towards a target: documents whose hashed word runs look like the target's are drawn more often.

Words are found by an Aho-Corasick automaton over words bounded by delimiters. A match emits what the word carries: its
CRC-32 alone, its CRC-32 behind one space, and its length. The CRC of a run of adjacent words is composed from these, so no
run is ever built as text; modulo the number of buckets it is the run's bucket. Documents are weighted by the mean gain of
their buckets and drawn by the Gumbel top-k trick with a hash of the key as noise.
"""

import hashlib
import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vacantia.llm.common import pieces, tidy
from vacantia.operators.ranking import number_rows
from vacantia.session import cut_lineage

# Words a task's automaton holds at most; others are split off and their payload is computed where they stand. The automaton
# is built anew while at least this share of the words passed it by, which only changes the way a word takes.
DICTIONARY, RENEW = 60_000, 0.1
# Longest word in the automaton, in characters.
LONGEST = 40

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _shift_tables(bits: int = 40) -> np.ndarray:
    """For each k, tables by byte that append 2^k zero bytes to a CRC-32 register; shape (bits, 4, 256)."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    one = np.zeros((4, 256), dtype=np.uint32)
    for place in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        one[place] = byte[register & 255] ^ (register >> np.uint32(8))
    tables = [one]
    while len(tables) < bits:
        tables.append(_shifted(_shifted(np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None],
                                        tables[-1]), tables[-1]))
    return np.stack(tables)


def _shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24])


_SHIFT = _shift_tables()


def compose(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts laid end to end, from the CRC-32 of both parts and the second part's length in bytes."""
    crc, left, k = first.astype(np.uint32), length.astype(np.int64), 0
    while left.any():
        crc = np.where(left & 1, _shifted(crc, _SHIFT[k]), crc)
        left, k = left >> 1, k + 1
    return crc ^ second


def _payload(word: str) -> tuple[int, int, int]:
    """CRC-32 of a word, CRC-32 of it behind a space, and the latter's length in bytes."""
    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data), zlib.crc32(b" " + data), len(data) + 1


class Scanner:
    """Finds the payloads of all words of texts, and learns words as they come."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.automaton = None
        self.payload = np.zeros((0, 3), dtype=np.int64)
        self.width = np.zeros(0, dtype=np.int64)

    def _learn(self, new: set[str]):
        """Take words into the automaton as far as there is room."""
        for word in sorted(new)[:DICTIONARY - len(self.words)]:
            self.words[word] = len(self.words)
        automaton = ahocorasick.Automaton()
        for word, code in self.words.items():
            automaton.add_word(f" {word} ", code)
        automaton.make_automaton()
        self.automaton = automaton
        self.payload = np.array([_payload(w) for w in self.words], dtype=np.int64).reshape(-1, 3)
        self.width = np.array([len(w) for w in self.words], dtype=np.int64)

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Payloads (rows of three numbers) of all words in order, and the text each word is in.

        Null and empty texts have none.
        """
        # every delimiter is a space; a line end, which no word borders on, parts the texts
        plain = [(t or "").encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass") for t in texts]
        line = "".join(f" {t} \n" for t in plain)
        ends_of_texts = np.cumsum([len(t) + 3 for t in plain])
        found = list(self.automaton.iter(line)) if self.words else []
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        end, code = pairs[:, 0], pairs[:, 1]
        start = end - self.width[code] - 1
        # stretches that no match covers, from a closing delimiter to the next opening one
        left, right = np.r_[0, end], np.r_[start, len(line)]
        missed, before, at = [], [], []
        for i in np.flatnonzero(left < right).tolist():
            lo = int(left[i])
            words = line[lo:right[i]].split()
            if words:
                place = lo
                for word in words:
                    place = line.index(word, place)
                    missed.append(word)
                    before.append(i)
                    at.append(place)
                    place += len(word)
        payload = self.payload[code]
        where = start + 1
        if missed:
            payload = np.insert(payload, before, np.array([_payload(w) for w in missed], dtype=np.int64), axis=0)
            where = np.insert(where, before, at)
        if len(missed) > RENEW * len(payload) and len(self.words) < DICTIONARY:
            new = {w for w in missed if len(w) <= LONGEST}
            if new:
                self._learn(new)
        return payload, np.searchsorted(ends_of_texts, where, side="right")


def features(scanner: Scanner, texts: list[str | None], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``longest`` words joined by one space, the text of each run, and words per text."""
    payload, text = scanner.scan(texts)
    words = np.bincount(text, minlength=len(texts))
    crc = payload[:, 0].astype(np.uint32)
    crcs, owners = [crc], [text]
    for size in range(1, longest):
        if len(text) <= size:
            break
        crc = compose(crc[:-1], payload[size:, 1].astype(np.uint32), payload[size:, 2])
        crcs.append(crc)
        owners.append(np.where(text[size:] == text[:-size], text[size:], -1))
    owner, crc = np.concatenate(owners), np.concatenate(crcs)
    return crc[owner >= 0], owner[owner >= 0], words


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall in each bucket; null and empty texts have none.

    Tasks count for themselves, so at most ``buckets`` rows per task are shuffled and ``buckets`` reach the driver.
    """
    def run(batches):
        scanner, counts = Scanner(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                crc, _, _ = features(scanner, piece.column(0).to_pylist(), longest)
                counts += np.bincount(crc % buckets, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])
    out = np.zeros(buckets, dtype=np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more common each bucket is in the target, with one feature added to each."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(seed: int, key: str | None) -> int:
    """Thousandths of a Gumbel variate that the key decides; a null key counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int, key: str = "doc_id", text: str = "text",
          longest: int = 1) -> DataFrame:
    """Per document: (key, n_words, n_features, weight, score); weight is the floored mean gain, 0 without features."""
    kind = docs.schema[key].dataType.simpleString()
    schema = pa.schema([("key", to_arrow_type(docs.schema[key].dataType)), *(
        (n, pa.int64()) for n in ("n_words", "n_features", "weight", "score"))])

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for piece in pieces(batch, "text"):
                crc, owner, words = features(scanner, piece.column(2).to_pylist(), longest)
                n = np.bincount(owner, minlength=piece.num_rows)
                total = np.zeros(piece.num_rows, dtype=np.int64)
                np.add.at(total, owner, gain[crc % len(gain)])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                extra = [noise(seed, k) for k in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(schema.field(0).type), *(pa.array(x, pa.int64()) for x in (words, n, weight, weight + np.array(extra, dtype=np.int64)))],
                    schema=schema)
    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), f"key {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, share: int = 10, seed: int = 2024, least: int = 20, key: str = "doc_id",
             text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """Every document with (key, n_features, weight, score, rank); ``rank`` counts from 1 over the drawn, else it is null.

    Of the N documents with at least ``least`` words, floor(share * N / 100) are drawn: the highest scores, equal ones by
    smaller key, null keys last. Every row is a document of its own, repeated and null keys included. An empty target or
    empty documents give the gains of no features. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    weighed = cut_lineage(weigh(docs, gain, seed, key, text, longest))
    able = weighed.where(F.col("n_words") >= least)
    drawn = share * able.count() // 100
    columns = ["key", "n_features", "weight", "score"]
    ranked = number_rows(able.select(*columns), "rank", seq="key", leading=F.col("score"))
    return (ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*columns, "rank")
            .union(weighed.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long")))
            .withColumnRenamed("key", key))
