"""Exact set-similarity join of documents on word shingles, with skipping by relations between sets.

Documents with equal sets are one node from the start. Nodes are then joined in two steps.

*Answers by similar sets.* Every node is compared with a leader for each of its few smallest shingles. Nodes linked to
one leader are in one component, whatever else they link with, so no pair inside a component is looked at again: what
a set reaches follows from what its leader reaches.

*Index lists.* For the links that remain, every node posts its prefix (the shingles of which two similar sets must share
one) to an inverted index in hash-range buckets. Lists are ordered by set size and carry positions; a scan leaves a list
where sizes grow too far and skips entries whose position leaves too few shingles to share. Shingles found in many
prefixes are put last in the global order by a bitmap of fixed size, so that common passages stay out of most prefixes.
Any fixed order is exact, so the bitmap's false hits cost nothing but order. Lists that are long all the same belong to
families of near copies: their entries first learn their component, and blocks of them are compared in memory by bitmaps,
so that only pairs across components that may be similar leave a block.

Candidate pairs first meet a bound from parity bitmaps, a few bytes for each of a set's shingles at most: every odd bit of
two bitmaps' difference is a shingle that only one of the sets has. Pairs that pass are verified on whole sets. Names of
shingles and of sets are 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import HOT, bitmap, components, free_name, join_counted, kept, kept_few, lean, maybe, maybe_rows, pieces, tidy
from vacantia.llm.shingles import fingerprint, shingle_sets

# Bytes of text that are hashed at once.
PIECE = 1 << 19
# Similarity in percent of the union.
PERCENT = 75
# Smallest shingles by which a node meets its leaders.
LEADERS = 4
# A shingle in more prefixes than this is ordered last.
COMMON = 32
# Index lists up to this length are paired inside their bucket; longer ones learn components first.
SHORT_LIST = 64
# Lists up to this length meet in their bucket, whatever share of all entries they have.
LONG_LIST = 20_000
# Entries of a long list that are compared in one place, and entries of a bucket of such blocks.
BLOCK = 4096
UNIT_BUCKET = 20_000
# Partners of each node in a block that are tried before all others.
NEAREST = 2
# Prefix entries of an index bucket, on average (5 MB).
BUCKET = 1 << 18

# Columns of a posting. A bucket fixes the upper bits of a shingle's hash; its lower half tells shingles apart in there,
# where a rare clash only adds a candidate.
_TOKENS = (("token", "<u4"), ("count", "<u4"))
_POSTINGS = (("token", "<u4"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4"))


def _least(n, percent):
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def parity(s: np.ndarray) -> bytes:
    """Bitmap of twice as many bits as shingles, rounded up to a power of two: which places an odd number falls on."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & np.uint64(size - 1), minlength=size).astype(np.uint8) & 1).tobytes()


def shared_at_most(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """A bound on the shingles two sets share, from their parity bitmaps."""
    x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return (nx + ny - int(np.bitwise_count(x ^ y).sum())) // 2


def profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: key, hash of the text, size of its set, node (null for an empty set), smallest shingles, bitmap."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, PIECE):
                n, node, mins, bits = [], [], [], []
                for s in shingle_sets(piece.column(1)):
                    n.append(len(s))
                    node.append(fingerprint(s) if len(s) else None)
                    mins.append(s[:LEADERS].view(np.int64))
                    bits.append(parity(s) if len(s) else b"")
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(mins, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=[key, "th", "n", "node", "mins", "bits"])
    return docs.select(key, text, F.xxhash64(text).alias("th")).mapInArrow(
        tidy(run), f"`{key}` {kind}, th long, n long, node long, mins array<long>, bits binary")


def _new_sets(batches, text, wanted=None):
    """(node, set) of the rows of a task, each text and set once per task; ``wanted`` is a bitmap of text hashes."""
    texts, nodes = set(), set()
    for batch in batches:
        for piece in pieces(batch, text, PIECE):
            hashes = piece.column(1).to_numpy()
            new = np.zeros(len(hashes), dtype=bool)
            hit = maybe(wanted, hashes) if wanted is not None else np.ones(len(hashes), dtype=bool)
            for i in np.flatnonzero(hit):
                h = int(hashes[i])
                if h not in texts:
                    texts.add(h)
                    new[i] = True
            if not new.any():
                continue
            for s in shingle_sets(piece.column(0).filter(pa.array(new))):
                if len(s):
                    node = fingerprint(s)
                    if node not in nodes:
                        nodes.add(node)
                        yield node, s


def _verified(docs: DataFrame, text: str, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole sets are similar; sets are read again only for the texts concerned."""
    def hopeful(batches):
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            keep = [(100 + percent) * shared_at_most(x.as_buffer(), m, y.as_buffer(), n) >= percent * (m + n)
                    for x, m, y, n in zip(batch.column(3), na, batch.column(5), nb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    pairs = kept_few(
        pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
        .select("a", "b", "na", "xa", "nb", "xb").mapInArrow(tidy(hopeful), "a long, b long"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = bitmap(ends.join(nodes, "node"), "th")

    def sets(batches):
        rows = []
        for node, s in _new_sets(batches, text, wanted):
            rows.append((node, s.tobytes()))
            if len(rows) >= 256:
                yield _table(rows)
                rows = []
        if rows:
            yield _table(rows)

    def _table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                           pa.array([r[1] for r in rows], pa.binary())], names=["node", "s"])

    def similar(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # one exchange of the sets serves the copies of a set, and both joins
    found = (docs.select(text, F.xxhash64(text).alias("th")).mapInArrow(tidy(sets), "node long, s binary")
             .groupBy("node").agg(F.first("s").alias("s")))
    left = found.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = found.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(similar), "a long, b long")


def _prefix(n, percent):
    return n - _least(n, percent) + 1


def _packed(columns, held, hashes, buckets, hot, salts):
    """Rows (bucket, bytes): entries cut by the range of their shingle's hash, each bucket's columns one after the other.

    Entries of a hot shingle, which has a list of its own, go to one of ``salts`` buckets above the others.
    """
    flat = [np.concatenate([h[k] for h in held]) for k in range(len(columns))]
    hashes = np.concatenate(hashes)
    to = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    if len(hot):
        lists = np.isin(to << 32 | (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64), hot)
        to[lists] += buckets * (1 + flat[1][lists] % salts)
    order = np.argsort(to, kind="stable")
    flat, to = [f[order] for f in flat], to[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    ends = np.r_[starts[1:], len(to)]
    return pa.RecordBatch.from_arrays(
        [pa.array(to[starts].astype(np.int64)),
         pa.array([b"".join(f[s:e].tobytes() for f in flat) for s, e in zip(starts, ends)], pa.binary())],
        names=["bucket", "entries"])


def _unpacked(columns, group: pa.Table) -> list[np.ndarray]:
    """The columns of all entries of a bucket."""
    width = sum(np.dtype(kind).itemsize for _, kind in columns)
    parts = [[] for _ in columns]
    for value in group.column("entries"):
        data = value.as_buffer()
        count, at = len(data) // width, 0
        for part, (_, kind) in zip(parts, columns):
            part.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
            at += count * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


def _posted(docs, text, buckets, columns, entries, hot=(), salts=1):
    """Send the entries of each set of a task to their buckets; ``entries`` gives their hashes and their columns."""
    hot = np.array([bucket << 32 | token for bucket, token in hot], dtype=np.int64)

    def run(batches):
        held, hashes, size = [], [], 0
        for node, s in _new_sets(batches, text):
            token, row = entries(node, s)
            held.append(row)
            hashes.append(token)
            size += len(token)
            if size >= BUCKET:
                yield _packed(columns, held, hashes, buckets, hot, salts)
                held, hashes, size = [], [], 0
        if held:
            yield _packed(columns, held, hashes, buckets, hot, salts)
    return docs.select(text, F.xxhash64(text).alias("th")).mapInArrow(tidy(run), "bucket long, entries binary")


def _common(docs: DataFrame, text: str, buckets: int, percent: int) -> tuple[np.ndarray, list[int]]:
    """Bitmap of the shingles that many prefixes hold, each prefix being the smallest hashes of its set, and the hot ones.

    Tasks count before they send, so a shingle is one entry per task and batch, however many sets hold it. Hot shingles,
    those with more than one in HOT of all entries, are fewer than HOT.
    """
    def run(batches):
        held, size = [], 0
        for _, s in _new_sets(batches, text):
            held.append(s[:_prefix(len(s), percent)])
            size += len(held[-1])
            if size >= BUCKET:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def counted(held):
        token, times = np.unique(np.concatenate(held), return_counts=True)
        return _packed(_TOKENS, [(token.astype("<u4"), times.astype("<u4"))], [token], buckets, (), 1)

    def count(group: pa.Table) -> pa.Table:
        token, times = _unpacked(_TOKENS, group)
        found, at = np.unique(token, return_inverse=True)
        total = np.bincount(at, weights=times, minlength=len(found)).astype(np.int64)
        many = total > COMMON
        bucket = np.full(int(many.sum()), group.column("bucket")[0].as_py(), dtype=np.int64)
        return pa.table({"token": found[many].astype(np.int64), "bucket": bucket, "n": total[many]})

    posted = docs.select(text, F.xxhash64(text).alias("th")).mapInArrow(tidy(run), "bucket long, entries binary")
    found = kept(posted.groupBy("bucket").applyInArrow(lean(count), "token long, bucket long, n long"))
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") > max(total // HOT, LONG_LIST)).select("token", "bucket").collect()
    return bitmap(found, "token"), [(r.bucket, r.token) for r in hot]


def _candidates(docs: DataFrame, text: str, buckets: int, percent: int, common: np.ndarray, hot: list, salts: int) -> DataFrame:
    """Rows (a, b) of candidate pairs from short lists, and rows (a, token, n, pos) of long ones, with null b.

    The entries of hot shingles are dealt over ``salts`` buckets, from which they only go on to the long lists.
    """
    def entries(node, s):
        n, late = len(s), maybe(common, s.view(np.int64))
        token = np.concatenate([s[~late], s[late]])[:_prefix(n, percent)]
        return token, (token.astype("<u4"), np.full(len(token), node, dtype="<i8"), np.full(len(token), n, dtype="<u4"),
                       np.arange(len(token), dtype="<u4"))

    def pair(group: pa.Table) -> pa.Table:
        token, node, n, pos = _unpacked(_POSTINGS, group)
        order = np.lexsort((node, n, token))
        token, node = token[order].astype(np.int64), node[order]
        n, pos = n[order].astype(np.int64), pos[order].astype(np.int64)
        # the same set may come from several tasks
        new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        token, node, n, pos = token[new], node[new], n[new], pos[new]
        bucket = group.column("bucket")[0].as_py()
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.r_[starts, len(token)])
        lists = np.repeat(np.arange(len(starts)), length)
        long = (length > SHORT_LIST) | (bucket >= buckets)
        short = (length > 1) & ~long
        last = np.repeat(starts + length, length)
        at = np.flatnonzero(short[lists])
        a, b = [], []
        for step in range(1, SHORT_LIST):
            # the rest of a list is skipped where it ends or its sets are too large
            at = at[at + step < last[at]]
            at = at[percent * n[at + step] <= 100 * n[at]]
            if not len(at):
                break
            other = at + step
            room = np.minimum(n[at] - pos[at], n[other] - pos[other])
            fits = (100 + percent) * room >= percent * (n[at] + n[other])
            a.append(node[at[fits]])
            b.append(node[other[fits]])
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        rest, none = np.flatnonzero(long[lists]), len(pairs)
        # tokens of different buckets must not meet, and those of a salted one must
        name = token[rest] + (np.int64(bucket % buckets) << 32)
        return pa.table({
            "a": np.r_[pairs[:, 0], node[rest]],
            "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(rest), pa.int64())]),
            "token": pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(name)]),
            "n": np.r_[np.zeros(none, dtype=np.int64), n[rest]],
            "pos": np.r_[np.zeros(none, dtype=np.int64), pos[rest]]})

    return _posted(docs, text, buckets, _POSTINGS, entries, hot, salts).groupBy("bucket").applyInArrow(
        lean(pair), "a long, b long, token long, n long, pos long")


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while bits.shape[1] > size:
        bits = bits[:, :bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2:]
    return bits


def _unlike_roots(part: dict[str, np.ndarray], bits: list[bytes], split: bool, percent: int):
    """Pairs of a list's entries, or across its two blocks, of different components that every bound lets pass."""
    words = np.array([len(b) // 8 for b in bits])
    for size in np.unique(words):
        exact, larger = np.flatnonzero(words == size), np.flatnonzero(words >= size)
        table = np.concatenate([_folded(np.frombuffer(b"".join(bits[i] for i in larger[words[larger] == w]), dtype="<u8")
                                        .reshape(-1, w), size) for w in np.unique(words[larger])])
        larger = np.concatenate([larger[words[larger] == w] for w in np.unique(words[larger])])
        n, room, root = part["n"][larger], part["n"][larger] - part["pos"][larger], part["root"][larger]
        for k, i in enumerate(exact):
            size_i, room_i = part["n"][i], part["n"][i] - part["pos"][i]
            # each pair once: entries of one bitmap size in order, and all of larger bitmaps
            fits = (np.arange(len(larger)) > k) & (root != part["root"][i])
            fits &= (100 * np.minimum(n, size_i) >= percent * np.maximum(n, size_i))
            fits &= (100 + percent) * np.minimum(room, room_i) >= percent * (n + size_i)
            if split:
                fits &= part["block"][larger] != part["block"][i]
            at = np.flatnonzero(fits)
            if len(at):
                odd = np.bitwise_count(table[at] ^ table[k]).sum(axis=1, dtype=np.int64)
                passed = (100 + percent) * ((n[at] + size_i - odd) // 2) >= percent * (n[at] + size_i)
                at, odd = at[passed], odd[passed]
                yield np.full(len(at), part["a"][i]), part["a"][larger[at]], odd / (n[at] + size_i)


def _nearest_of(node: np.ndarray, unlike: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest of their node."""
    order = np.lexsort((unlike, node))
    start = np.flatnonzero(np.r_[len(node) > 0, node[order][1:] != node[order][:-1]])
    rank = np.arange(len(node)) - np.repeat(start, np.diff(np.r_[start, len(node)]))
    keep = np.zeros(len(node), dtype=bool)
    keep[order[rank < most]] = True
    return keep


def _across(entries: DataFrame, nodes: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """Candidate pairs (a, b) of different components in long lists, or only the ``nearest`` of each node in a block.

    A list is cut into blocks of about BLOCK entries, and each pair of blocks is compared in one place by bitmaps, so no
    list meets in one task and only pairs that pass leave it.
    """
    cut = entries.groupBy("token").count().select("token", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    units = kept_few(
        entries.join(cut, "token").withColumn("block", F.pmod(F.xxhash64("a", F.lit(5)), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("a", "token", "n", "pos", F.col("ra").alias("root"), "block", F.least("block", "other").alias("u"),
                F.greatest("block", "other").alias("v")))
    buckets = max(1, units.count() // UNIT_BUCKET)

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("token", "ascending"), ("u", "ascending"), ("v", "ascending"), ("n", "ascending")])
        columns = {c: group.column(c).to_numpy() for c in ("a", "token", "n", "pos", "root", "block", "u", "v")}
        bits = group.column("bits").to_pylist()
        edge = np.flatnonzero(np.r_[True, np.any([columns[c][1:] != columns[c][:-1] for c in ("token", "u", "v")], axis=0)])
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for start, end in zip(edge, np.r_[edge[1:], len(bits)]):
            part = {c: v[start:end] for c, v in columns.items()}
            found = list(_unlike_roots(part, bits[start:end], part["u"][0] != part["v"][0], percent))
            if not found:
                continue
            x, y, unlike = (np.concatenate(c) for c in zip(*found))
            if nearest:
                keep = _nearest_of(x, unlike, nearest) | _nearest_of(y, unlike, nearest)
                x, y = x[keep], y[keep]
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return (units.join(nodes.select(F.col("node").alias("a"), "bits"), "a")
            .withColumn("bucket", F.pmod(F.xxhash64("token", "u", "v"), F.lit(buckets)))
            .groupBy("bucket").applyInArrow(lean(compare), "a long, b long"))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document: key, ``th`` (hash of its text), ``n_shingles``, ``root`` and ``component_id``.

    Words are runs of characters other than ASCII white space, with A-Z in lower case; the set holds the distinct runs of
    five words, or the whole sequence if it is shorter. Two documents link when 100 * intersection >= percent * union.
    ``component_id`` is the smallest key reachable by links, and ``root`` names the component whatever its keys are. A document without words (null, empty or white text) has 0
    shingles, links with nothing and is its own component. Repeated rows and keys each keep a row; a null key counts in
    a component but never names one, and a component of null keys only has a null id. Other columns are not read.
    An empty table gives no rows.
    """
    docs = docs.select(key, text)
    rows = kept(profile(docs, key, text))
    nodes = kept_few(rows.where("n > 0").dropDuplicates(["node"]).select("node", "n", "th", "mins", "bits"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * (100 - percent) / 100 / BUCKET) + 1)

    # each node against the leaders of its smallest shingles
    met = nodes.select("node", "n", F.explode("mins").alias("token"))
    leaders = (met.groupBy("token").agg(F.min(F.struct("node", "n")).alias("l"), F.count("*").alias("c")).where("c > 1")
               .select("token", F.col("l.node").alias("a"), F.col("l.n").alias("na"), "c"))
    stars = kept_few(
        join_counted(met, kept_few(leaders), ["token"], "c").where("node <> a")
        .where(f"100 * least(n, na) >= {percent} * greatest(n, na)")
        .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    near = kept_few(components(_verified(docs, text, nodes, stars, percent)))

    # the index finds what is left
    common, hot = _common(docs, text, buckets, percent)
    salts = nodes.count() // LONG_LIST + 1
    found = kept_few(_candidates(docs, text, buckets, percent, common, hot, salts))

    def rooted(df, end, root):
        named = near.select(F.col("node").alias(end), F.col("root").alias("_r"))
        return df.join(named, end, "left").withColumn(root, F.coalesce("_r", end)).drop("_r")

    def linked(pairs):
        more = kept_few(_verified(docs, text, nodes, pairs, percent))
        if more.isEmpty():
            return near
        return kept_few(components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))

    def mixed(entries):
        several = entries.groupBy("token").agg(F.min("ra").alias("low"), F.max("ra").alias("high")).where("low <> high")
        return kept_few(entries.join(several.select("token"), "token", "left_semi"))
    long_lists = found.where("b IS NULL").select("a", "token", "n", "pos")
    # families first: what the nearest of each node link makes most other pairs of a family needless
    near = linked(kept_few(_across(mixed(rooted(long_lists, "a", "ra")), nodes, percent, NEAREST).distinct()))
    across = _across(mixed(rooted(long_lists, "a", "ra")), nodes, percent)
    pairs = rooted(rooted(found.where("b IS NOT NULL").select("a", "b").distinct(), "a", "ra"), "b", "rb")
    near = linked(kept_few(pairs.where("ra <> rb").select("a", "b").union(across).distinct()))

    known = rows.join(near, "node", "left").select(
        key, "th", "n", F.coalesce("root", "node").alias("root"))
    lowest = known.where("root IS NOT NULL").groupBy("root").agg(F.min(key).alias("low"))
    return known.join(lowest, "root", "left").select(
        key, "th", F.col("n").alias("n_shingles"), "root", F.when(F.col("root").isNull(), F.col(key)).otherwise(F.col("low")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, all columns kept: the one with the smallest (key, text hash), null keys last.

    Of rows that repeat that key and text one stays. Documents without words all stay. Texts whose hash is surely not
    concerned pass by a bitmap; only the others are joined.
    """
    rows = kept(link(docs, key, text, percent).where("root IS NOT NULL").select(F.col(key).alias("k"), "th", "root"))
    order = F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("th").alias("th"))
    first = (rows.groupBy("root").agg(F.min(order).alias("f"), F.count("*").alias("c")).where("c > 1")
             .select("root", F.col("f.k").alias("fk"), F.col("f.th").alias("fth")))
    # every key and text of a component with more than one row: one of them stays, once
    concerned = kept(rows.join(first, "root").groupBy("k", "th").agg(
        F.max((F.col("k").eqNullSafe(F.col("fk")) & (F.col("th") == F.col("fth"))).cast("int")).alias("stays")))
    marks = bitmap(concerned, "th")
    own, other, stays, same = (free_name(docs, n) for n in ("__th", "__k", "__stays", "__h"))
    hashed = docs.withColumn(own, F.xxhash64(text))
    known = concerned.select(F.col("k").alias(other), F.col("th").alias(same), F.col("stays").alias(stays))
    touched = maybe_rows(hashed, own, marks).join(
        known, F.col(key).eqNullSafe(F.col(other)) & (F.col(own) == F.col(same)), "left").where(f"coalesce({stays}, 1) = 1")
    staying = touched.where(f"{stays} = 1").dropDuplicates([key, own])
    return (maybe_rows(hashed, own, marks, wanted=False).select(*docs.columns)
            .union(touched.where(f"{stays} IS NULL").select(*docs.columns)).union(staying.select(*docs.columns)))
