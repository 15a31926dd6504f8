"""Secret scan: fixed credential shapes, and a guess-cost estimate of values in credential context."""

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from vacantia.llm.common import map_pieces

KINDS = ("assign", "access", "hex", "guess")

# Fixed shapes.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_VALUE, _ACCESS_LENGTH = 8, 16

# Words that open a credential context, and what may be a value there. Those of the assignment shape may follow anything, as
# there; others start after any character but a letter, or as a part of a camel-case name.
_CONTEXT = re.compile(
    r"""(?:(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"""
    r"""(?:pass(?:phrase|code)?|pwd|auth(?:orization)?|credentials?|bearer|access[_-]?key|private[_-]?key|session[_-]?key)"""
    r"""|password|passwd|secret|token|api[_-]?key)["']?\x20*(?:=>|:=|[:=])\x20*"""
    r"""(?:bearer\x20|basic\x20)?["']?([^\s"'<>,;]{6,})""", re.A | re.I)
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer")

# A value is a secret from this many powers of ten of guesses on.
GUESSES = 8.0

# Fixed word list, most common first: a word's place is its number of guesses.
_WORDS = """password admin welcome letmein secret token login master dragon monkey shadow sunshine princess football
baseball superman batman trustno iloveyou hello freedom whatever access default changeme change example sample test
testing demo guest root user username user name pass passwd key apikey value string null none true false undefined
todo replace placeholder your here insert enter put my the this that some any env secret private public client server
data base database mysql postgres oracle redis config local host localhost prod production dev development staging
internal service system manager account bearer basic auth hidden masked redacted omitted unknown summer winter spring
autumn january february march april june july august september october november december monday friday sunday love
money happy summer computer internet google apple office company home family michael jordan jennifer thomas charlie
andrew daniel george hunter ginger pepper cheese cookie banana orange purple yellow silver golden""".split()
_RANK = {w: i + 1 for i, w in reversed(list(enumerate(_WORDS)))}
_LONGEST = max(map(len, _RANK))
_PLAIN = str.maketrans("430157@$!", "aeoistasi")

_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (y, x + y * 0.5) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(
    r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d")


def _next_to(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q) and abs(p[0] - q[0]) <= 1 and 0 < abs(p[1] - q[1]) + abs(p[0] - q[0]) <= 1.5


def _runs(value: str, holds) -> list[tuple[int, int]]:
    """Longest runs in which each character holds with the one before."""
    found, start = [], 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not holds(i):
            if i - start >= 3:
                found.append((start, i))
            start = i
    return found


def spans_of(value: str) -> list[tuple[int, int, float]]:
    """Guessable spans (start, end, powers of ten of guesses): words, dates, repeats, walks and their parts."""
    low = value.lower()
    plain = low.translate(_PLAIN)
    found = []
    for start in range(len(value)):
        for end in range(start + 2, min(len(value), start + _LONGEST) + 1):
            rank = _RANK.get(low[start:end])
            swapped = None if rank else _RANK.get(plain[start:end])
            if rank or swapped:
                part = value[start:end]
                upper = sum(c.isupper() for c in part)
                extra = 0 if not upper else math.log10(2) if upper == 1 and part[0].isupper() or upper == len(part) \
                    else math.log10(sum(math.comb(len(part), k) for k in range(1, upper + 1)))
                found.append((start, end, math.log10(rank or swapped) + extra + (math.log10(4) if swapped else 0)))
        date = _DATE.match(value, start)
        if date:
            found.append((start, date.end(), math.log10(120) if date.end() - start == 4 else math.log10(365 * 120)))
    for start, end in _runs(low, lambda i: low[i] == low[i - 1]):
        found += [(start, stop, math.log10(95 * (stop - start))) for stop in {end, end - 1} if stop - start >= 3]
    for size in (2, 3, 4):
        start = 0
        while start + 2 * size <= len(low):
            end = start + size
            while low[end:end + size] == low[start:start + size] and end + size <= len(low):
                end += size
            if end > start + size:
                found.append((start, end, min(size * 1.0, 3.0) + math.log10((end - start) // size)))
                start = end - size + 1
            else:
                start += 1
    for start, end in _runs(low, lambda i: _next_to(low[i - 1], low[i])):
        found += [(s, e, math.log10(47 * 6) + 0.35 * (e - s)) for s in (start, start + 1) for e in (end, end - 1)
                  if e - s >= 3]
    step = [ord(b) - ord(a) for a, b in zip(low, low[1:])]
    for start, end in _runs(low, lambda i: abs(step[i - 1]) == 1 and (i < 2 or step[i - 2] == step[i - 1])):
        found.append((start, end, math.log10(26 * 2 * (end - start))))
    return found


def guess_cost(value: str) -> float:
    """Powers of ten of guesses of the cheapest split of a value into guessable spans and brute-force characters.

    A brute-force character costs one power, and every guessable span half a power for its place among the others.
    An empty value costs 0.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in spans_of(value):
        ending.setdefault(end, []).append((start, cost + 0.5))
    best = [0.0] * (len(value) + 1)
    for end in range(1, len(value) + 1):
        best[end] = min([best[end - 1] + 1.0, *(best[s] + c for s, c in ending.get(end, ()))])
    return best[-1]


def scan(text: str | None, guesses: float = GUESSES) -> list[tuple[int, int, int]]:
    """All spans (start, kind number, end) of a text in code points, by start and then kind.

    The three fixed shapes always stay. A ``guess`` span is a value in credential context that costs 10^guesses or more and
    that fixed ones do not cover whole. Null and empty texts have none.
    """
    if not text:
        return []
    found = []
    low = text.lower()
    hinted = (":" in text or "=" in text) and any(h in low for h in _HINTS)
    if hinted:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= _ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if hinted:
        fixed = sorted((s, e) for s, _, e in found)
        at, reach = 0, 0
        for m in _CONTEXT.finditer(text):
            while at < len(fixed) and fixed[at][0] <= m.start(1):
                reach = max(reach, fixed[at][1])
                at += 1
            end, after = max(reach, m.start(1)), at
            while after < len(fixed) and fixed[after][0] <= end < m.end(1):
                end = max(end, fixed[after][1])
                after += 1
            if end < m.end(1) and guess_cost(m.group(1)) >= guesses:
                found.append((m.start(1), 3, m.end(1)))
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans, mark: str = "[secret]") -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    parts, done = [], 0
    for start, _, end in spans:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of the fixed shapes, digest of their spans, and all spans.

    Every row gives one row, repeated and null keys included; null texts count as empty. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def work(batch):
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        count = [[sum(s[1] == k for s in spans) for spans in rows] for k in range(3)]
        base = [hashlib.sha256(joined(s for s in spans if s[1] < 3).encode()).hexdigest() for spans in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(base, pa.string()),
             pa.array([joined(s) for s in rows], pa.string())],
            names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return map_pieces(docs.select(key, text), text,
                      f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work)


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """The documents with secrets replaced in their text, all columns kept; ``length`` names a column of lengths to renew.

    Texts without a span, and null ones, stay as they are.
    """
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length else None

    def work(batch):
        old = batch.column(at).to_pylist()
        spans = [scan(t) for t in old]
        if not any(spans):
            return batch
        columns = list(batch.columns)
        new = [redacted(t, s) if s else t for t, s in zip(old, spans)]
        columns[at] = pa.array(new, batch.schema.field(at).type)
        if size is not None:
            kept = batch.column(size).to_pylist()
            columns[size] = pa.array([len(n) if s else k for n, s, k in zip(new, spans, kept)],
                                     batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return map_pieces(docs, text, docs.schema, work)
