"""Personal data: fixed shapes, and a skip-chain conditional random field that makes labels consistent in a document.

Nodes of the field are the tokens that hold a digit or an at sign, numbers side by side being one; a label is one of the
kinds or none. Neighbours share a chain potential. A token also shares a skip potential with a token of its document that is written alike or
is similar: the same digits whatever stands between them, the same last digits of a number, or the same name before the at
sign. Labels of tokens inside a fixed shape are observed, the others are inferred by loopy belief propagation. So a number
that has the shape of a phone once is found where it stands without its country code, too. Potentials are learned here, by
pseudo-likelihood on a bounded sample whose labels are the fixed shapes.
"""

import hashlib
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import map_pieces

KINDS = ("email", "ip", "card", "phone")
# Distinct texts that are learned from, those with the smallest hashes, and their greatest length in characters.
SAMPLE, SAMPLE_CHARS = 2000, 20_000
# Rounds of learning, strength of the prior, and rounds of messages.
ROUNDS, PRIOR, MESSAGES = 150, 1e-3, 12
# Observations share this many weights per label, by hash.
WEIGHTS = 1 << 13
# Prior mean of the skip potentials for equal labels.
AGREE = 5.0
# Probability from which on an inferred label makes a span.
SURE = 0.9
# Digits that make two numbers similar when they end them.
TAIL = 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEPARATORS = str.maketrans("", "", " -")
_NO_DIGITS = re.compile("[^0-9]+")

_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NUMERIC = re.compile(r"[0-9+().\-/]+")
_WRAP_LEFT, _WRAP_RIGHT = "\"'([{<*#$&%,;:", "\"')]}>*#$&%,;:.!?"
_BEFORE, _AFTER = re.compile(r"([^\W\d_]+)[^\w\n]{0,3}$"), re.compile(r"[^\w\n]{0,3}([^\W\d_]+)")
CHAIN, SAME, TAILS, NAME = range(4)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The fixed shapes of a text as (start, kind number, end) in code points, sorted; each kind leftmost, not overlapping."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        # the name is the whole run before the sign; only the sign ends it, so no other start can match
        start = at
        while start > done and _LOCAL.fullmatch(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
        # a name in the next match may not reach back over this sign
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].translate(_SEPARATORS)
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


@dataclass
class Graph:
    """Nodes and edges of the fields of many texts; label 0 is none, -1 is not observed.

    Tokens that are alike are linked with one of them only, the first observed or else the first, so edges grow with the
    tokens and not with their pairs.
    """

    text: list[int] = field(default_factory=list)
    span: list[tuple[int, int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, number: int, text: str, base: Sequence[tuple[int, int, int]]) -> None:
        """Add the field of one text, whose fixed shapes are given."""
        tokens = []
        for m in _TOKEN.finditer(text):
            start, end = m.span()
            while start < end and text[start] in _WRAP_LEFT:
                start += 1
            while start < end and text[end - 1] in _WRAP_RIGHT:
                end -= 1
            if start < end:
                tokens.append((start, end))
        first, at, reach = len(self.span), 0, []
        alike: dict[tuple, list[int]] = {}
        for lo, hi in _chunks(text, tokens):
            whole = text[lo:min(hi, lo + 64)]
            numeric = bool(_NUMERIC.fullmatch(text[lo:text.find(" ", lo, hi) if text.find(" ", lo, hi) > 0 else hi]))
            digits = _NO_DIGITS.sub("", text[lo:hi]) if numeric else ""
            keys = []
            if len(digits) >= TAIL:
                keys = [(SAME, digits), (TAILS, digits[-TAIL:])]
            elif not numeric:
                token = text[lo:hi].lower()
                name = token.partition("@")[0]
                keys = [(SAME, token)] + ([(NAME, name)] if len(name) >= 4 else [])
            while at < len(base) and base[at][0] < hi:
                reach.append(base[at])
                at += 1
            reach = [b for b in reach if b[2] > lo]
            node = len(self.span)
            self.text.append(number)
            self.span.append((lo, hi))
            self.label.append(1 + reach[0][1] if reach else -1)
            self.features.append(_observations(whole, digits, lo > 0 and text[lo - 1] == "+", text[max(lo - 24, 0):lo], text[hi:hi + 24]))
            gap = text[max(self.span[node - 1][1], lo - 8):lo] if node > first else None
            if gap is not None and gap.strip(_WRAP_LEFT + _WRAP_RIGHT) in (" ", ""):
                self.edges.append((node - 1, node, CHAIN))
            for key in keys:
                alike.setdefault(key, []).append(node)
        for key, nodes in alike.items():
            centre = next((n for n in nodes if self.label[n] >= 0), nodes[0])
            self.edges += [(centre, n, key[0]) for n in nodes if n != centre]


def _chunks(text: str, tokens: list[tuple[int, int]]):
    """Numbers that stand side by side, one space apart, are one node; every other token is one by itself."""
    chunk, before = None, False
    for start, end in tokens:
        numeric = bool(_NUMERIC.fullmatch(text, start, end))
        if chunk and numeric and before and text[chunk[1]:min(start, chunk[1] + 8)].strip("()+") == " ":
            chunk = (chunk[0], end)
        else:
            if chunk:
                yield chunk
            chunk = (start, end)
        before = numeric
    if chunk:
        yield chunk


def _shape(text: str) -> str:
    return re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]+", "9", text))


def _feature(name: str, value) -> int:
    return zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % WEIGHTS


def _observations(whole: str, digits: str, plus: bool, before: str, after: str) -> list[int]:
    left, right = _BEFORE.search(before), _AFTER.match(after)
    parts = whole.split(".")
    ip = len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts)
    return [_feature("bias", ""), _feature("s", _shape(whole[:32])), _feature("c", re.sub("[0-9]", "9", _shape(whole) if not digits else whole)),
            _feature("n", min(len(digits), 25)), _feature("p", (bool(digits), plus or whole.startswith("+"))),
            _feature("l", luhn(digits) if 14 <= len(digits) <= 19 else None), _feature("i", ip and _octets(whole)),
            _feature("e", bool(_DOMAIN.fullmatch(whole.partition("@")[2])) if "@" in whole else None),
            _feature("w", left[1].lower() if left else None), _feature("v", right[1].lower() if right else None)]


class Model:
    """Weights per observation and label, and a potential per kind of edge and pair of labels."""

    def __init__(self, weights: np.ndarray, potentials: np.ndarray):
        self.weights, self.potentials = weights, potentials

    def unary(self, graph: Graph) -> np.ndarray:
        scores = self.weights[np.array(graph.features, dtype=np.int64).reshape(len(graph.span), -1)].sum(axis=1)
        label = np.array(graph.label, dtype=np.int64)
        seen = label >= 0
        scores[seen] = -1e3
        scores[seen, label[seen]] = 0.0
        return scores

    def marginals(self, graph: Graph, rounds: int = MESSAGES) -> np.ndarray:
        """Label probabilities of every node by sum-product messages along all edges, both ways in each round.

        In the first round observed nodes alone send, so that what is known is heard before what is guessed. They hear
        nothing, as their labels are given.
        """
        unary = self.unary(graph)
        if graph.edges:
            a, b, kind = np.array(graph.edges, dtype=np.int64).T
            forth, psi = np.zeros((2, len(a), unary.shape[1])), self.potentials[kind]
            known = np.array(graph.label) >= 0
            sends, hears = np.stack([known[a], known[b]])[:, :, None], np.stack([~known[b], ~known[a]])[:, :, None]
            for number in range(rounds):
                belief = unary.copy()
                np.add.at(belief, b, forth[0])
                np.add.at(belief, a, forth[1])
                forth = np.stack([_log_sum((belief[a] - forth[1])[:, :, None] + psi, 1),
                                  _log_sum((belief[b] - forth[0])[:, None, :] + psi, 2)])
                forth -= forth.max(axis=2, keepdims=True)
                forth *= hears if number else hears & sends
            unary = unary.copy()
            np.add.at(unary, b, forth[0])
            np.add.at(unary, a, forth[1])
        return np.exp(unary - _log_sum(unary, 1)[:, None])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(texts: Sequence[str], rounds: int = ROUNDS) -> Model:
    """Learn by pseudo-likelihood: each token's label given its observations and its neighbours' labels.

    Tokens in a fixed shape have its kind for label, all others none. Every token counts twice, once without its
    observations, so that the neighbours are learned from as well. Without tokens all weights are those of the prior.
    """
    graph = Graph()
    for i, text in enumerate(texts):
        graph.add(i, text, base_spans(text))
    size = len(KINDS) + 1
    agree = np.zeros((NAME + 1, size, size))
    agree[SAME:, range(size), range(size)] = AGREE
    model = Model(np.zeros((WEIGHTS, size)), agree.copy())
    model.weights[_feature("bias", ""), 0] = 2.0
    if not graph.span:
        return model
    label = np.maximum(np.array(graph.label), 0)
    observed = np.array(graph.features, dtype=np.int64)
    edges = np.array(graph.edges, dtype=np.int64).reshape(-1, 3)
    node = np.r_[edges[:, 1], edges[:, 0]]
    other = np.r_[label[edges[:, 0]], label[edges[:, 1]]]
    kind = np.r_[edges[:, 2], edges[:, 2]]
    back = np.repeat([False, True], len(edges))
    truth = np.eye(size)[label]
    steps = [np.full_like(model.weights, 1e-6), np.full_like(agree, 1e-6)]
    for _ in range(rounds):
        from_edges = np.zeros((len(label), size))
        np.add.at(from_edges, node, np.where(back[:, None], model.potentials[kind, :, other], model.potentials[kind, other]))
        slope = []
        for scores in (from_edges + model.weights[observed].sum(axis=1), from_edges):
            slope.append(truth - np.exp(scores - _log_sum(scores, 1)[:, None]))
        to_weights = -PRIOR * len(label) * model.weights
        for column in range(observed.shape[1]):
            np.add.at(to_weights, observed[:, column], slope[0])
        to_edges = -PRIOR * len(label) * (model.potentials - agree)
        both = (slope[0] + slope[1])[node]
        np.add.at(to_edges, (kind[~back], other[~back]), both[~back])
        np.add.at(to_edges.transpose(0, 2, 1), (kind[back], other[back]), both[back])
        for value, change, step in ((model.weights, to_weights, steps[0]), (model.potentials, to_edges, steps[1])):
            step += change ** 2
            value += 0.3 * change / np.sqrt(step)
    return model


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE, longest: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``sample`` distinct texts of at most ``longest`` characters that hold a digit or an at sign."""
    rows = (docs.where(F.col(text).rlike("[0-9@]") & (F.length(text) <= longest))
            .select(F.col(text).alias("text"), F.xxhash64(text).alias("h")))
    chosen = [r.h for r in rows.select("h").distinct().orderBy("h").limit(sample).collect()]
    texts = rows.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    return fit([r.text for r in texts])


def scan(texts: Sequence[str | None], model: Model, sure: float = SURE) -> list[tuple[list, list]]:
    """For each text its fixed shapes and the inferred spans, both as sorted (start, kind number, end) in code points."""
    graph, found = Graph(), []
    for i, text in enumerate(texts):
        held = bool(text and _TOKEN.search(text))
        found.append((base_spans(text) if held else [], []))
        if held:
            graph.add(i, text, found[i][0])
    if graph.span:
        label = _consistent(graph, model.marginals(graph), sure)
        for (start, end), number, kind in zip(graph.span, graph.text, label):
            if kind:
                found[number][1].append((start, kind - 1, end))
        for (_, spans), text in zip(found, texts):
            spans[:] = [_bracketed(text, s) for s in spans]
    return found


def _consistent(graph: Graph, marginals: np.ndarray, sure: float) -> list[int]:
    """The sure labels of the nodes that were not observed, 0 for all others."""
    best = marginals.argmax(axis=1)
    keep = (marginals[np.arange(len(best)), best] >= sure) & (np.array(graph.label) < 0)
    return np.where(keep, best, 0).tolist()


def _bracketed(text: str, span: tuple[int, int, int]) -> tuple[int, int, int]:
    """Take in the bracket that a span's first token lost."""
    start, kind, end = span
    inside = text[start:end]
    if start and text[start - 1] == "(" and inside.count(")") > inside.count("("):
        start -= 1
    return start, kind, end


def joined(base: Sequence, inferred: Sequence = ()) -> str:
    rows = sorted([(s, k, KINDS[k], e) for s, k, e in base] + [(s, len(KINDS) + k, f"like_{KINDS[k]}", e) for s, k, e in inferred])
    return ",".join(f"{name}:{start}:{end}" for start, _, name, end in rows)


def find_personal(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of the fixed shapes, digest of their spans, and all spans, inferred ones named ``like_<kind>``.

    Every row gives one row, repeated and null keys included; null texts count as empty and have none. Every
    document with a token is inferred on, whether it holds a fixed shape or not. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def work(batch):
        rows = scan(batch.column(1).to_pylist(), model)
        count = [[sum(s[1] == k for s in base) for base, _ in rows] for k in range(len(KINDS))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in count),
             pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
             pa.array([joined(*r) for r in rows], pa.string())],
            names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return map_pieces(docs.select(key, text), text, f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
                      + ", base_sha256 string, spans string", work)
