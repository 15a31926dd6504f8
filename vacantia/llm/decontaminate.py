"""Benchmark decontamination: q-gram lemma over diagonal bands, then banded alignment."""

import re
from collections.abc import Iterable, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vacantia.llm.common import pieces, tidy
from vacantia.llm.shingles import mix
from vacantia.session import cut_lineage

# Characters of a q-gram.
Q = 8
# Edits allowed, as a share of a pattern's characters.
EDITS = 0.1
# An item up to this length is one pattern; a longer one is cut into windows of this length, each half over the last.
WINDOW = 128
# Shorter items are looked for as whole words without edits; documents are dropped for those of so many characters or more.
LEAST, SHORT = 24, 8
# Items that one pass over the documents looks for.
BLOCK = 4096

_WORD = re.compile(r"\w+")
_HASH_BITS = 22


def normal(text: str) -> str:
    """Words in lower case with single spaces between."""
    return " ".join(_WORD.findall(text.lower()))


def _places(text: str, start: int, end: int) -> tuple[int, int]:
    """Where characters ``start`` to ``end`` of the normal text lie in the text."""
    low, back = text.lower(), None
    if len(low) != len(text):
        back = [i for i, c in enumerate(text) for _ in c.lower()]
    spans = [m.span() for m in _WORD.finditer(low)]
    words = np.array(spans, dtype=np.int64)
    begins = np.cumsum(words[:, 1] - words[:, 0] + 1) - (words[:, 1] - words[:, 0] + 1)

    def place(at):
        k = int(np.searchsorted(begins, at, side="right")) - 1
        found = min(int(words[k, 0] + at - begins[k]), int(words[k, 1]))
        return back[found] if back else found
    return place(start), place(end - 1) + 1


_ODD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, Q + 1)], dtype=np.uint64)


def _grams(text: str) -> np.ndarray:
    """The q-grams of a text as 64-bit numbers: their bytes if all characters are of Latin-1, else a hash of them."""
    try:
        data = text.encode("latin-1")
        wide = None
    except UnicodeEncodeError:
        wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        data = np.where(wide < 256, wide, 0).astype(np.uint8).tobytes()
    whole = len(data) - Q + 1
    if whole <= 0:
        return np.zeros(0, dtype="<u8")
    grams = np.ndarray((whole,), dtype="<u8", buffer=data, strides=(1,))
    if wide is None:
        return grams
    beyond = np.cumsum(np.r_[0, wide >= 256])
    at = np.flatnonzero(beyond[Q:] > beyond[:-Q])
    grams = grams.copy()
    spread = mix(wide.astype(np.uint64))
    grams[at] = mix(sum(spread[at + k] * _ODD[k] for k in range(Q)))
    return grams


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)


def banded_distance(pattern: np.ndarray, region: np.ndarray, most: int, low: int, high: int) -> tuple[int, int] | None:
    """Least edits of the whole pattern against any part of the region, and where that part ends.

    Only diagonals (place in region less place in pattern) from ``low`` to ``high`` are filled in. None if it takes more
    than ``most`` edits.
    """
    width = high - low + 1
    far = len(pattern) + len(region) + 1
    steps = np.arange(width)
    # row[k]: cost of the pattern's first i characters ending at region place i + low + k
    ends = steps + low
    row = np.where((ends >= 0) & (ends <= len(region)), 0, far)
    padded = np.full(len(region) + 2 * (abs(low) + abs(high) + len(pattern)) + 2, -1, dtype=np.int64)
    shift = abs(low) + abs(high) + len(pattern)
    padded[shift:shift + len(region)] = region
    delete = np.full(width, far)
    for i in range(1, len(pattern) + 1):
        start = i + low - 1 + shift  # region character just before place i + low
        change = row + (padded[start:start + width] != pattern[i - 1])
        delete[:-1] = row[1:] + 1
        row = np.minimum(change, delete)
        ends = steps + low + i
        row[(ends < 0) | (ends > len(region))] = far
        row = np.minimum.accumulate(row - steps) + steps
        row[(ends < 0) | (ends > len(region))] = far
        if row.min() > most:
            return None
    at = int(row.argmin())
    return (int(row[at]), at + low + len(pattern)) if row[at] <= most else None


def scan_distance(pattern: str, region: str, most: int) -> tuple[int, int] | None:
    """The same as ``banded_distance`` over all diagonals, for regions in which bands would repeat the work.

    A column of the edit matrix is kept as bits of where it rises and falls, so a character costs a few operations.
    """
    size = len(pattern)
    held: dict[str, int] = {}
    for i, c in enumerate(pattern):
        held[c] = held.get(c, 0) | 1 << i
    whole, top = (1 << size) - 1, 1 << (size - 1)
    up, down, cost, best, at = whole, 0, size, size, 0
    for place, c in enumerate(region, 1):
        equal = held.get(c, 0)
        zero = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | ~(zero | up) & whole, up & zero
        if rise & top:
            cost += 1
        elif fall & top:
            cost -= 1
            if cost < best:
                best, at = cost, place
        rise, fall = rise << 1 & whole, fall << 1 & whole
        up, down = fall | ~(zero | rise) & whole, rise & zero
        if not best:
            break
    return (best, at) if best <= most else None


# Hits that are counted at a time, and bands of one pattern and text beyond which the text is scanned once instead.
CHUNK, BANDS = 1 << 21, 12
# A pattern that has one q-gram at more places than this is repetitive: its bands would hold little but repeats.
REPEATS = 4


class Index:
    """Patterns of benchmark items and their q-grams."""

    def __init__(self, items: Iterable[tuple[int, str | None]]):
        self.patterns: list[tuple[int, str, int, int]] = []  # item, text, edits, shared q-grams needed
        short: dict[str, list] = {}
        for item, text in items:
            whole = normal(text or "")
            if len(whole) < LEAST:
                if whole:
                    short.setdefault(whole, []).append(item)
                continue
            starts = [0] if len(whole) <= WINDOW else [*range(0, len(whole) - WINDOW, WINDOW // 2), len(whole) - WINDOW]
            for start in starts:
                part = whole[start:start + WINDOW]
                edits = min(int(len(part) * EDITS), len(part) // Q - 1)
                self.patterns.append((item, part, edits, len(part) + 1 - Q * (edits + 1)))
        self.short = None
        if short:
            self.short = ahocorasick.Automaton()
            for whole, named in short.items():
                self.short.add_word(f" {whole} ", (whole, named))
            self.short.make_automaton()
        grams = [_grams(p[1]) for p in self.patterns]
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.lexsort((owner, flat))
        flat, self.owner, self.place = flat[order], owner[order].astype(np.int64), place[order].astype(np.int64)
        self.keys, self.first = np.unique(flat, return_index=True)
        self.first = np.r_[self.first, len(flat)]
        # a pattern's places of one q-gram stand side by side: where they begin, and how many they are
        edge = np.flatnonzero(np.r_[len(flat) > 0, (flat[1:] != flat[:-1]) | (self.owner[1:] != self.owner[:-1])])
        self.times, self.times_owner = np.diff(np.r_[edge, len(flat)]), self.owner[edge]
        self.times_first = np.r_[np.searchsorted(edge, self.first[:-1]), len(edge)]
        most = np.zeros(len(self.patterns), dtype=np.int64)
        np.maximum.at(most, self.times_owner, self.times)
        self.repetitive = most > REPEATS
        self.known = np.zeros(1 << _HASH_BITS, dtype=bool)
        self.known[_slot(self.keys)] = True
        self.need = np.array([p[3] for p in self.patterns], dtype=np.int64)
        self.band = np.array([p[2] + 1 for p in self.patterns], dtype=np.int64)

    def _hits(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the texts have q-grams of the patterns: row, place in the text, number of the q-gram."""
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        grams = _grams("\0".join(texts) + "\0")
        if not len(grams) or not len(self.keys):
            return (np.zeros(0, dtype=np.int64),) * 3
        at = np.flatnonzero(self.known[_slot(grams)])
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[key] == grams[at]
        at, key = at[same], key[same]
        row = np.searchsorted(starts, at, side="right") - 1
        return row, at - starts[row], key

    def _pairs(self, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Pairs (row times patterns plus pattern) that share enough q-grams anywhere, each place of the pattern counting once."""
        found = np.unique(row * len(self.keys) + key)
        row, key = np.divmod(found, len(self.keys))
        pairs, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for part, entry in self._expanded(self.times_first, key):
            new = row[part] * len(self.patterns) + self.times_owner[entry]
            both, back = np.unique(np.r_[pairs, new], return_inverse=True)
            counts = np.bincount(back, weights=np.r_[counts, self.times[entry]], minlength=len(both)).astype(np.int64)
            pairs = both
        return pairs[counts >= self.need[pairs % len(self.patterns)]] if len(pairs) else pairs

    def _expanded(self, first: np.ndarray, key: np.ndarray):
        """Each q-gram's entries, some CHUNK at a time: (index of the q-gram, entry)."""
        sizes = first[key + 1] - first[key]
        ends = np.cumsum(sizes)
        start = 0
        while start < len(key):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, side="right")))
            n = sizes[start:end]
            entry = np.repeat(first[key[start:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(np.arange(start, end), n), entry
            start = end

    def _regions(self, texts: Sequence[str]) -> list[tuple[int, int, list[int] | None]]:
        """(row, pattern, bands) of pairs with enough shared q-grams; None for bands if the whole text is to be scanned.

        Band b covers 2 (edits + 1) diagonals from b (edits + 1); each diagonal lies in two bands.
        """
        row, place, key = self._hits(texts)
        pairs = self._pairs(row, key)
        if not len(pairs):
            return []
        loose = self.repetitive[pairs % len(self.patterns)]
        out = [(*divmod(p, len(self.patterns)), None) for p in pairs[loose].tolist()]
        pairs = pairs[~loose]
        groups: dict[int, set[int]] = {}
        held = np.zeros(0, dtype=np.int64)  # (pair, band, place of the pattern) met so far
        rows = np.unique(pairs // max(len(self.patterns), 1)) if len(pairs) else pairs
        near = np.flatnonzero(np.isin(row, rows))
        row, place, key = row[near], place[near], key[near]
        span = 2 * int(max(map(len, texts))) + 4 * WINDOW
        parts = []
        for part, entry in self._expanded(self.first, key):
            pair = row[part] * len(self.patterns) + self.owner[entry]
            slot = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            keep = pairs[slot] == pair if len(pairs) else np.zeros(len(pair), dtype=bool)
            slot, part, entry = slot[keep], part[keep], entry[keep]
            spot = self.place[entry]
            band = (place[part] - spot) // self.band[self.owner[entry]] + WINDOW
            both = np.r_[slot * span + band, slot * span + band - 1]
            parts.append(np.unique(both * WINDOW + np.r_[spot, spot]))
            if sum(map(len, parts)) > 2 * CHUNK:
                parts = [np.unique(np.concatenate(parts))]
        held = np.unique(np.concatenate(parts)) // WINDOW if parts else held
        edge = np.flatnonzero(np.r_[len(held) > 0, held[1:] != held[:-1]])
        slot, band = np.divmod(held[edge], span)
        counts = np.diff(np.r_[edge, len(held)])
        enough = counts >= self.need[pairs[slot] % len(self.patterns)] if len(pairs) else counts > 0
        for s, b in zip(slot[enough].tolist(), (band[enough] - WINDOW).tolist()):
            groups.setdefault(s, set()).add(b)
        for s, bands in groups.items():
            out.append((*divmod(int(pairs[s]), len(self.patterns)), sorted(bands) if len(bands) <= BANDS else None))
        return sorted(out, key=lambda r: r[:2])

    def _found(self, plain: str, part: str, edits: int, bands: list[int] | None) -> tuple[int, int] | None:
        """Edits of a pattern in a text and where it ends there: without edits, else the first band that holds it."""
        at = plain.find(part)
        if at >= 0:
            return 0, at + len(part)
        if bands is None:
            return scan_distance(part, plain, edits)
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        for band in bands:
            low, high = band * (edits + 1) - edits, (band + 2) * (edits + 1) + edits
            start = max(0, low)
            region = plain[start:max(0, high) + len(part)]
            found = banded_distance(code, np.frombuffer(region.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64),
                                    edits, low - start, high - start)
            if found:
                return found[0], start + found[1]
        return None

    def matches(self, texts: Sequence[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of the items found in each text, places in code points of the text.

        A match reaches from the first to the last window found, each where it is found first; edits are those of its worst
        window.
        """
        plain = [normal(t) if t else "" for t in texts]
        best: dict[tuple[int, int], list[int]] = {}
        for row, pattern, bands in self._regions(plain):
            item, part, edits, _ = self.patterns[pattern]
            found = self._found(plain[row], part, edits, bands)
            if found:
                cost, end = found
                span = best.setdefault((row, item), [end, end, 0])
                span[0], span[1] = min(span[0], max(0, end - len(part))), max(span[1], end)
                span[2] = max(span[2], cost)
        if self.short is not None:
            for row, text in enumerate(plain):
                for end, (whole, named) in self.short.iter(f" {text} "):
                    for item in named:
                        best.setdefault((row, item), [end - len(whole) - 1, end - 1, 0])
        return [(row, item, *_places(texts[row], start, end), worst)
                for (row, item), (start, end, worst) in sorted(best.items(), key=lambda b: b[0])]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterable[list[tuple[int, str]]]:
    """The benchmark in blocks of at most about BLOCK items; only one block is on the driver at a time."""
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where(
        "item IS NOT NULL AND text <> ''")
    total = items.count()
    blocks = -(-total // BLOCK)
    if blocks <= 1:
        yield [tuple(r) for r in items.collect()] if total else []
        return
    cut = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [tuple(r) for r in cut.where(F.col("block") == block).drop("block").collect()]


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """Rows (key, item, start, end, edits): benchmark items that documents hold, places in code points.

    Texts are compared as lower-case words with single spaces. An item is held if one of its windows of up to 128
    characters occurs with edits on at most a tenth of them. By the q-gram lemma such a region shares at least
    m + 1 - q (e + 1) q-grams with the window on diagonals at most e apart, so bands with fewer are skipped without loss.
    Items with fewer than 24 characters are found where all their words stand, without edits. Null and empty texts hold
    nothing and items without an id or a word are not looked for; of a repeated item every row is one; repeated rows and null keys are reported like others, and other columns are not read.
    """
    kind, number = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    schema = f"`{key}` {kind}, `{item}` {number.simpleString()}, start long, end long, edits long"
    item_type = to_arrow_type(number)
    parts = []
    for block in _blocks(benchmark, item, item_text):
        index = Index(block)

        def run(batches, index=index):
            for batch in batches:
                for piece in pieces(batch, text):
                    rows = index.matches(piece.column(1).to_pylist())
                    keys = piece.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array([r[1] for r in rows], item_type),
                         *(pa.array([r[k] for r in rows], pa.int64()) for k in range(2, 5))],
                        names=[key, item, "start", "end", "edits"])
        found = docs.select(key, text).mapInArrow(tidy(run), schema)
        parts.append(cut_lineage(found) if parts else found)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, all columns kept; see ``find``.

    Items of fewer than SHORT characters in words, such as a bare "yes", are no evidence and drop nothing. Null and empty
    texts stay, and so do all rows if the benchmark is empty; repeated rows stay or go together.
    """
    for block in _blocks(benchmark, item, item_text):
        index = Index([(i, t) for i, t in block if len(normal(t)) >= SHORT])

        def run(batches, index=index):
            for batch in batches:
                for piece in pieces(batch, text):
                    at = piece.schema.get_field_index(text)
                    held = {r[0] for r in index.matches(piece.column(at).to_pylist())}
                    yield piece.filter(pc.invert(pa.array([i in held for i in range(piece.num_rows)], pa.bool_())))
        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
