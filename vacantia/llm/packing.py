"""Lexical retrieval packing: windows of tokens filled from a sharded BM25 index.

Documents are tokenised and cut into full windows; what is left of each, less than a window, is a unit to pack. Units are
range-sorted by their rarest token into shards of a bounded number of tokens, each with an inverted index of BM25 weights
whose document frequencies are those of all units. A seed opens a window, its unused neighbours by score fill it, and the
last of them is cut where the window is full: its rest is the next seed. So only the last window of a shard is padded.
"""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import pieces, remembered, tidy
from vacantia.session import cut_lineage

WINDOW = 2048
# Tokens of a shard: some 250 windows. A task packs its shards one after the other, some 64 MB of ids in all.
SHARD, PARTITION = 1 << 19, 1 << 25
# Query terms of a seed: those with the highest weight in it.
TERMS = 16
K1, B = 1.2, 0.75

# Remembered words of the texts that are encoded word by word, some 20 MB; then the memory is emptied.
REMEMBERED = 100_000

# Fixed names of the tokenizer file: how a vocabulary entry marks the end of a pre-token, and what pre-tokens are.
END = "</w>"
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile("[\x21-\x7e\xa1-\u024f]+")
_SEPARATOR = re.compile("[\x1c-\x1f]")
# Texts of these characters only are cut into pre-tokens by the class of their bytes, many texts at once.
_SIMPLE = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]*")
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
# What follows an apostrophe that begins a pre-token of its own.
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def byte_names() -> dict[int, str]:
    """The visible character that stands for each byte: itself if it is one, else the next free one from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words:
    """Token ids of texts, as little-endian 32-bit numbers.

    The tokenizer drops white space and joins nothing across it. Simple texts (ASCII and Latin letters, the usual marks) are
    cut into pre-tokens here, all texts of a piece at once, and merged by ``tiktoken`` with the tokenizer's own vocabulary
    and ranks, a space standing for the end of a pre-token. Of other texts, plain words are merged in the same way and the
    rest go to the tokenizer; each word's ids are remembered.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        byte = {c: b for b, c in byte_names().items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {}
        for name, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if name not in special:
                ends = name.endswith(END)
                ranks[bytes(byte[c] for c in name.removesuffix(END)) + b" " * ends] = rank
        self.merges = tiktoken.Encoding("words", pat_str=r"\S+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends[[rank for name, rank in ranks.items() if name.endswith(b" ")]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new):
        plain, cut, counts = [], [], []
        for word in new:
            if not _PLAIN.fullmatch(word) or "<|" in word:
                self.known[word] = self._whole(word)
                continue
            low = word.lower()
            if low.isalpha():
                parts = [low]
            elif low[:-1].isalpha() and low[-1] in ".,":
                parts = [low[:-1], low[-1]]
            else:
                parts = _PRETOKEN.findall(low)
            plain.append(word)
            cut += parts
            counts.append(len(parts))
        if not plain:
            return
        ids = np.array(self.merges.encode_ordinary(" ".join(cut) + " "), dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1  # one for each pre-token
        ends = 4 * np.r_[0, ends[np.cumsum(counts) - 1]]
        code = ids.tobytes()
        self.known.update(zip(plain, map(code.__getitem__, map(slice, ends[:-1].tolist(), ends[1:].tolist()))))

    def encode(self, texts):
        """Ids of each text. The separators U+001C to U+001F are white space to Python only; texts with them go whole."""
        simple = [not t or (_SIMPLE.fullmatch(t) is not None and "<|" not in t) for t in texts]
        many = iter(self._simple([t or "" for t, s in zip(texts, simple) if s]))
        one = iter(self._by_words([t for t, s in zip(texts, simple) if not s]))
        return [next(many if s else one) for s in simple]

    def _by_words(self, texts):
        lists = [t.split() if not _SEPARATOR.search(t) else [] for t in texts]
        needed = set().union(*lists)
        new = needed.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, needed
        self._learn(new)
        known = self.known.__getitem__
        return [self._whole(t) if not words else b"".join(map(known, words)) for t, words in zip(texts, lists)]

    def _simple(self, texts):
        data = [t.lower().encode() for t in texts]
        last = np.cumsum([len(d) + 1 for d in data])
        line = np.frombuffer(b"\n".join([*data, b""]), dtype=np.uint8)
        starts = pretoken_starts(line)
        if not len(starts):
            return [b""] * len(texts)
        # every pre-token gets one space behind it, and white space goes
        inside = _CLASS[line] != _SPACE
        kept = line[inside]
        at = (np.cumsum(inside) - 1)[starts]
        spaced = np.insert(kept, at[1:], 32).tobytes().decode() + " "
        ids = self.merges.encode_to_numpy(spaced)
        ends = np.flatnonzero(self.ends[ids]) + 1  # one for each pre-token
        upto = 4 * np.r_[0, ends][np.r_[0, np.searchsorted(starts, last)]]
        code = ids.astype("<u4", copy=False).tobytes()
        return [code[lo:hi] for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist())]


def pretoken_starts(line: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the bytes of simple texts in lower case.

    A pre-token is a run of letters, one digit, or a run of marks; a contraction is one where its apostrophe does not
    follow another mark.
    """
    kind = _CLASS[line]
    before = np.r_[np.uint8(_SPACE), kind[:-1]]
    begins = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT))
    for at in np.flatnonzero((line == ord("'")) & (before != _MARK)).tolist():
        rest = line[at + 1:at + 3].tobytes()
        size = next((len(c) for c in _CONTRACTIONS if rest.startswith(c)), 0)
        if size:
            begins[at + 1] = False
            if at + 1 + size < len(line):
                begins[at + 1 + size] = kind[at + 1 + size] != _SPACE
    return np.flatnonzero(begins)


def _cut(docs: DataFrame, path: str, key: str, text: str, end: int, kept: str) -> DataFrame:
    """Full windows (with their sequence) and the rest of each document (with its ids as numbers of the type ``kept``).

    Ids of full windows: odd sequence numbers, from the task and the place in it; the rows are written out before use.
    """
    kind = docs.schema[key].dataType.simpleString()
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        words, serial = remembered(("packing", path), lambda: _Words(path)), TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch, text):
                at, start, length, crc, total, sequence, ids, rare = ([] for _ in range(8))
                for row, code in enumerate(words.encode(piece.column(1).to_pylist())):
                    code += last
                    n = len(code) // 4
                    for s in range(0, n, WINDOW):
                        part = code[4 * s:4 * (s + WINDOW)]
                        at.append(row)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        if len(part) == 4 * WINDOW:
                            sequence.append(2 * serial + 1)
                            serial += 1
                            ids.append(None)
                            rare.append(None)
                        else:
                            sequence.append(None)
                            numbers = np.frombuffer(part, dtype="<u4")
                            ids.append(numbers.astype(kept).tobytes())
                            rare.append(int(numbers.max()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(at, pa.int64())),
                     *(pa.array(v, pa.int64()) for v in (start, length, crc, total, sequence, rare)),
                     pa.array(ids, pa.binary())],
                    names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "rare", "ids"])
    return docs.select(key, text).mapInArrow(
        tidy(run), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, rare long,"
             " ids binary")


def _frequencies(units: DataFrame, vocabulary: int, kept: str) -> tuple[np.ndarray, int, float]:
    """Units that hold each token, their number and mean length; as many numbers as the vocabulary has, whatever the input."""
    def run(batches):
        held = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                held[np.unique(np.frombuffer(value.as_buffer(), dtype=kept))] += 1
        token = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(held[token])], names=["token", "n"])
    rows = units.select("ids").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(vocabulary, dtype=np.int64)
    held[rows.column("token").to_numpy()] = rows.column("n").to_numpy()
    count, mean = units.agg(F.count("*"), F.avg("length")).first()
    return held, count, float(mean or 1)


class Shard:
    """An inverted index of the units of one shard, from which used units drop out."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float):
        sets = [np.unique(u, return_counts=True) for u in units]
        sizes = np.array([len(t) for t, _ in sets], dtype=np.int64)
        unit = np.repeat(np.arange(len(units)), sizes)
        token = np.concatenate([np.zeros(0, dtype=np.int64), *(t for t, _ in sets)]).astype(np.int64)
        times = np.concatenate([np.zeros(0), *(c for _, c in sets)])
        length = np.array([len(u) for u in units], dtype=np.float64)
        weight = idf[token] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[unit] / mean))
        # each unit's query: its heaviest terms, lower tokens first among equals
        order = np.lexsort((token, -weight, unit))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        top = order[rank < TERMS]
        self.query = np.split(token[top], np.cumsum(np.minimum(sizes, TERMS))[:-1]) if len(units) else []
        order = np.argsort(token, kind="stable")
        self.unit, self.weight = unit[order], weight[order]
        self.tokens, self.first = np.unique(token[order], return_index=True)
        self.first = np.r_[self.first, len(order)]
        self.free = np.ones(len(units), dtype=bool)

    def take(self, unit: int) -> None:
        self.free[unit] = False

    def neighbours(self, unit: int) -> np.ndarray:
        """Unused units that share a query term with the unit, highest BM25 score first, lower units first among equals."""
        at = np.searchsorted(self.tokens, self.query[unit])
        found = [slice(self.first[k], self.first[k + 1]) for k in at]
        units = np.concatenate([self.unit[s] for s in found])
        other, back = np.unique(units, return_inverse=True)
        score = np.bincount(back, weights=np.concatenate([self.weight[s] for s in found]), minlength=len(other))
        free = self.free[other]
        other, score = other[free], score[free]
        return other[np.lexsort((other, -score))]


def fill(lengths: np.ndarray, shard: Shard, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (unit, start in it, length, window number, offset) of all units of a shard, windows full but for the last."""
    out, number, offset, next_seed = [], 0, 0, 0
    queue: list[int] = []
    total = len(lengths)
    while True:
        # the next unit: a neighbour of the window's seed, else the first unused one
        unit = next((u for u in iter(lambda: queue.pop() if queue else None, None) if shard.free[u]), None)
        if unit is None:
            while next_seed < total and not shard.free[next_seed]:
                next_seed += 1
            if next_seed == total:
                return out
            unit = next_seed
        shard.take(unit)
        if offset == 0:
            queue = shard.neighbours(unit)[::-1].tolist()
        start, left = 0, int(lengths[unit])
        while left:
            part = min(left, window - offset)
            out.append((unit, start, part, number, offset))
            start, left, offset = start + part, left - part, offset + part
            if offset == window:
                number, offset = number + 1, 0
                # what is left of the cut unit seeds the next window
                queue = shard.neighbours(unit)[::-1].tolist() if left else []


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Columns: key, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset``, gapless from 0 in each sequence. A document is its ids by the tokenizer file and then
    ``end``. Null and empty texts are that one id. Every row is packed, repeated and null keys included; other columns
    are not read. An empty table gives no rows. Ties go to the unit that comes first by (rarest token, key, start).
    """
    kind = docs.schema[key].dataType.simpleString()
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end + 1)
    kept = "<u2" if vocabulary <= 1 << 16 else "<u4"
    cut = cut_lineage(_cut(docs, path, key, text, end, kept))
    units = cut.where("sequence_id IS NULL").select(key, "start", "length", "doc_tokens", "rare", "ids")
    held, count, mean = _frequencies(units, vocabulary, kept)
    idf = np.log1p((count - held + 0.5) / (held + 0.5))
    tokens = units.agg(F.sum("length")).first()[0] or 0
    partitions = max(1, round(tokens / PARTITION))

    def shards(batches):
        """Runs of rows with about SHARD tokens, in order."""
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                ends = np.cumsum(batch.column(batch.schema.get_field_index("length")).to_numpy())
                cut = int(np.searchsorted(ends, SHARD - size)) + 1
                part, batch = batch.slice(0, cut), batch.slice(cut)
                held.append(part)
                size += int(ends[part.num_rows - 1])
                if size >= SHARD:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for table in shards(batches):
            ids = [np.frombuffer(v.as_buffer(), dtype=kept) for v in table.column("ids")]
            lengths = np.array([len(i) for i in ids], dtype=np.int64)
            rows = fill(lengths, Shard(ids, idf, mean))
            unit, start, length, number, offset = (np.array(c, dtype=np.int64) for c in zip(*rows))
            crc = [zlib.crc32(ids[u][s:s + n].astype("<u4")) for u, s, n, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [table.column(key).combine_chunks().take(pa.array(unit)),
                 pa.array(start + table.column("start").to_numpy()[unit]), pa.array(length), pa.array(crc, pa.int64()),
                 table.column("doc_tokens").combine_chunks().take(pa.array(unit)), pa.array(2 * (base + number)), pa.array(offset)],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base += int(number[-1]) + 1

    order = ["rare", key, "start"]
    packed = (units.withColumn("_row", F.monotonically_increasing_id())
              .repartitionByRange(partitions, *order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
              .mapInArrow(tidy(run), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long,"
                               " sequence_id long, offset long"))
    whole = cut.where("sequence_id IS NOT NULL").select(
        key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed)
