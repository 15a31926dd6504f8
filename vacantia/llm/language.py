"""Language identification with unigram piece models, summing over all segmentations of a text.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all ways
to cut it into pieces, computed by a forward pass; a text's is the product over its words. Probabilities are learned by
expectation maximisation on a bounded sample of labelled texts, with forward-backward counts over all segmentations.
"""

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import pieces as text_pieces, remembered, tidy
from vacantia.llm.shingles import powers, mix
from vacantia.session import cut_lineage

# Labelled texts that are learned from, per language.
SAMPLE = 200
ROUNDS = 3
# Added to the expected count of every piece.
PRIOR = 0.01
# Probability of a character that no piece covers.
UNKNOWN = 1e-7
# A forward pass in plain numbers holds for words up to this length; longer ones use logarithms.
PLAIN = 40
UNDECIDED = "und"

# Words whose lattices are built at once.
BATCH = 5_000
# Remembered words per Python worker, some 20 MB; then the memory is emptied.
REMEMBERED = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> tuple[str, ...]:
    """The lower-case pieces of letters of a sentencepiece model; a leading mark stands for the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)
                          and not model.is_unknown(i) and not model.is_byte(i))
    return tuple(p for p in found if p == p.lower() and p.removeprefix("▁").isalpha())


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hashes(codes: np.ndarray, start: np.ndarray, length: int, sums: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(codes))
    return mix(((sums[start + length] - sums[start]) * inverse[start]) ^ np.uint64(length))


def _sums(codes: np.ndarray) -> np.ndarray:
    power, _ = powers(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[:len(codes)], out=sums[1:])
    return sums


def _codes(marked: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4"),
            np.array([len(m) for m in marked], dtype=np.int64))


class Vocabulary:
    """Pieces by the hash of their characters."""

    def __init__(self, names: Sequence[str]):
        self.names = tuple(names)
        codes, lengths = _codes(self.names)
        sums, at = _sums(codes), np.cumsum(lengths) - lengths
        hashes = np.zeros(len(self.names), dtype=np.uint64)
        for length in np.unique(lengths):
            which = lengths == length
            hashes[which] = _hashes(codes, at[which], int(length), sums)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[hashes >> np.uint64(44)] = True
        self.lengths = [int(n) for n in np.unique(lengths)]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        found = np.full(len(hashes), -1)
        may = np.flatnonzero(self.known[hashes >> np.uint64(44)])
        if len(may):
            at = np.minimum(np.searchsorted(self.sorted, hashes[may]), len(self.sorted) - 1)
            same = self.sorted[at] == hashes[may]
            found[may[same]] = self.order[at[same]]
        return found


class Lattice:
    """All pieces in marked words, as arcs between the places of each word; piece -1 is an unknown character."""

    def __init__(self, words: Sequence[str], vocabulary: Vocabulary):
        marked = ["\u2581" + w for w in words]
        codes, self.lengths = _codes(marked)
        sums = _sums(codes)
        first = np.cumsum(self.lengths) - self.lengths
        word = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(codes)) - first[word]
        self.first = first + np.arange(len(words))  # node of each word's start; a word of n characters has n + 1 nodes
        self.last = self.first + self.lengths
        starts, ends, pieces, after = [], [], [], []

        def arcs(at, length, piece):
            node = self.first[word[at]] + place[at]
            starts.append(node)
            ends.append(node + length)
            pieces.append(piece)
            after.append(place[at] + length)
        for length in sorted({1, *vocabulary.lengths}):
            at = np.flatnonzero(place + length <= self.lengths[word])
            piece = vocabulary.find(_hashes(codes, at, length, sums))
            known = piece >= 0
            arcs(at[known], length, piece[known])
            if length == 1:
                arcs(at[~known], 1, piece[~known])
        self.start, self.end, self.piece, after = (np.concatenate(x) for x in (starts, ends, pieces, after))
        order = np.argsort(after, kind="stable")
        self.start, self.end, self.piece, after = (x[order] for x in (self.start, self.end, self.piece, after))
        self.steps = np.flatnonzero(np.r_[True, after[1:] != after[:-1], True]) if len(after) else np.zeros(1, dtype=np.int64)
        self.nodes = len(codes) + len(words)

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Sum over all segmentations from a word's start to each place."""
        alpha = np.zeros((self.nodes, probability.shape[1]))
        alpha[self.first] = 1
        for lo, hi in zip(self.steps[:-1], self.steps[1:]):
            np.add.at(alpha, self.end[lo:hi], alpha[self.start[lo:hi]] * probability[self.piece[lo:hi]])
        return alpha

    def backward(self, probability: np.ndarray) -> np.ndarray:
        """Sum over all segmentations from each place to a word's end."""
        beta = np.zeros((self.nodes, probability.shape[1]))
        beta[self.last] = 1
        # arcs that end later come first: what they add to their start is complete before it is used
        for lo, hi in zip(self.steps[-2::-1], self.steps[:0:-1]):
            np.add.at(beta, self.start[lo:hi], beta[self.end[lo:hi]] * probability[self.piece[lo:hi]])
        return beta


def expected_counts(lattice: Lattice, times: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, unknown characters last, in words of one language that occur so many times."""
    column = probability[:, None]
    alpha, beta = lattice.forward(column)[:, 0], lattice.backward(column)[:, 0]
    word = np.searchsorted(lattice.first, lattice.start, side="right") - 1
    use = alpha[lattice.start] * probability[lattice.piece] * beta[lattice.end] * times[word] / alpha[lattice.last[word]]
    return np.bincount(lattice.piece % len(probability), weights=use, minlength=len(probability))


class Model:
    """Piece probabilities, one column per language and unknown characters in the last row."""

    def __init__(self, names: Sequence[str], vocabulary: Vocabulary, probability: np.ndarray):
        self.names, self.vocabulary, self.probability = list(names), vocabulary, probability

    def log_likelihoods(self, words: Sequence[str]) -> np.ndarray:
        """For each word the logarithm of its probability in each language, over all its segmentations."""
        out = np.zeros((len(words), len(self.names)))
        short = np.array([len(w) < PLAIN for w in words], dtype=bool)
        if short.any():
            lattice = Lattice([w for w, s in zip(words, short) if s], self.vocabulary)
            out[short] = np.log(lattice.forward(self.probability)[lattice.last])
        for at in np.flatnonzero(~short):
            out[at] = self._long(words[at])
        return out

    def _long(self, word: str) -> np.ndarray:
        """The same for one word whose sums plain numbers would not hold."""
        lattice, logs = Lattice([word], self.vocabulary), np.log(self.probability)
        alpha = np.full((lattice.nodes, len(self.names)), -np.inf)
        alpha[0] = 0
        for lo, hi in zip(lattice.steps[:-1], lattice.steps[1:]):
            alpha[lattice.end[lo]] = np.logaddexp.reduce(alpha[lattice.start[lo:hi]] + logs[lattice.piece[lo:hi]], axis=0)
        return alpha[-1]


def fit(texts: dict[str, list[str]], vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """A model of the languages of the labelled texts, in the order of their names.

    Words of PLAIN characters and more are not learned from: plain numbers would not hold their sums.
    """
    columns = []
    for name in sorted(texts):
        counts = Counter(w for t in texts[name] for w in words(t) if len(w) < PLAIN)
        lattice, times = Lattice(list(counts), vocabulary), np.array(list(counts.values()), dtype=np.float64)
        column = np.r_[np.full(len(vocabulary.names), 1 / len(vocabulary.names)), UNKNOWN]
        for _ in range(rounds if counts else 0):
            got = expected_counts(lattice, times, column)[:-1] + PRIOR
            column = np.r_[got / got.sum(), UNKNOWN]
        columns.append(column)
    probability = np.stack(columns, axis=1) if columns else np.zeros((len(vocabulary.names) + 1, 0))
    return Model(sorted(texts), vocabulary, probability)


class _Memory:
    """Rows of log-likelihoods of the words seen; words without a letter have row 0, which is 0."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {}
        self.table = np.zeros((1, len(self.model.names)))

    def _learn(self, new: list[str]):
        if len(self.place) + len(new) > REMEMBERED:
            self._clear()
        self.place.update((w, 0) for w in new if not any(map(str.isalpha, w)))
        new = [w for w in new if w not in self.place]
        for at in range(0, len(new), BATCH):
            part = new[at:at + BATCH]
            self.place.update(zip(part, range(len(self.table), len(self.table) + len(part))))
            self.table = np.concatenate([self.table, self.model.log_likelihoods(part)])

    def scores(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        lists = [words(t) if t and self.model.names else [] for t in texts]
        needed = set().union(*lists)
        new = [w for w in needed if w not in self.place]
        if len(self.place) + len(new) > REMEMBERED:
            new = list(needed)
        self._learn(sorted(new))
        out, place = [], self.place.__getitem__
        for found in lists:
            at = np.fromiter(map(place, found), dtype=np.int64, count=len(found))
            if not at.any():
                out.append((UNDECIDED, 0.0))
                continue
            total = self.table[at].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.names[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _memory(model: Model, name: int) -> _Memory:
    """One memory per Python worker, for the model last used."""
    return remembered(("language", name), lambda: _Memory(model))


def learn(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", label: str = "lang",
          sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled texts per language that are not held out, those with the smallest text hashes.

    Texts that repeat under a label count once. The number of languages is taken to be small; null texts and labels are not
    learned from.
    """
    rows = (docs.where(~held_out(F.col(key)) & F.col(label).isNotNull() & F.col(text).isNotNull())
            .select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("h")))
    distinct = cut_lineage(rows.select("label", "h").distinct())
    counts = {r.label: r["count"] for r in distinct.groupBy("label").count().collect()}
    # hashes are even, so a share of their range holds enough; what it holds is some times the sample for every label
    least = F.lit(-(1 << 63))
    for name, n in counts.items():
        share = min(1.0, (4 * sample + 100) / n)
        most = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
        least = F.when(F.col("label") == name, F.lit(most)).otherwise(least)
    chosen = {(r.label, r.h) for r in distinct.where(F.col("h") <= least)
              .withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h")))
              .where(F.col("rank") <= sample).collect()}
    found = rows.where(F.col("h").isin(sorted({h for _, h in chosen}))).groupBy("label", "h").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for r in found.collect():
        if (r.label, r.h) in chosen:
            texts.setdefault(r.label, []).append(r.text)
    return fit({name: sorted(t) for name, t in texts.items()}, Vocabulary(vocabulary(path)))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is 1 modulo 3; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ``held_out``, ``lang_pred`` and ``score``, the language's share of the likelihood of the whole text.

    Texts that are null or have no letter are ``und`` with score 0, as is everything if no language was learned. Equal
    likelihoods go to the name that comes first. Every row gives one row, null and repeated keys included; other columns
    are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    name = hash(model.probability.tobytes())

    def work(batches):
        memory = _memory(model, name)
        for batch in batches:
            for piece in text_pieces(batch, text):
                found = memory.scores(piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], names=[key, "held_out", "lang_pred", "score"])
    return docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text)).mapInArrow(
        tidy(work), f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose language is decided with at least this score, all columns kept."""
    name = hash(model.probability.tobytes())

    def work(batches):
        memory = _memory(model, name)
        for batch in batches:
            for piece in text_pieces(batch, text):
                found = memory.scores(piece.column(piece.schema.get_field_index(text)).to_pylist())
                yield piece.filter(pa.array([f[0] != UNDECIDED and f[1] >= least for f in found], pa.bool_()))
    return docs.mapInArrow(tidy(work), docs.schema)
