"""Embedding near-duplicates by a pivot-permutation index."""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import components, lean, tidy
from vacantia.session import cut_lineage

COSINE = 0.98
# The pivots are chosen among this many vectors. There are as many as the table's size asks for, between these bounds.
SAMPLE, PIVOTS, MOST_PIVOTS = 4096, 128, 1024
# No two pivots are nearer than this, so that a dense group does not take them all.
APART = 0.8
# A vector is described by its nearest pivots, and candidates share at least so many of them.
NEAREST, SHARED = 6, 3
# Vectors of a list that one block compares with each other; longer lists become pairs of blocks.
BLOCK = 2048
# List entries of a bucket, on average.
BUCKET = 20_000


def choose_pivots(sample: np.ndarray, most: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Unit vectors of a sample, in its order, that are not too near an earlier one."""
    chosen: list[np.ndarray] = []
    for v in sample:
        if len(chosen) < most and (not chosen or (np.array(chosen) @ v).max() < apart):
            chosen.append(v)
    return np.array(chosen).reshape(len(chosen), sample.shape[1] if sample.ndim > 1 else 0)


def unit(flat: np.ndarray, dims: int) -> np.ndarray:
    rows = flat.reshape(-1, dims).astype(np.float64)
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(vectors: np.ndarray, pivots: np.ndarray, count: int = NEAREST) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first; the lower number first among equals."""
    near = vectors @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :count]


def pivots_for(count: int) -> int:
    """Pivots for so many vectors: enough that a list has some 64 entries on average, in whole words of 64 bits."""
    triples = count * math.comb(NEAREST, SHARED) / 64
    return min(MOST_PIVOTS, max(PIVOTS, 64 * math.ceil((6 * triples) ** (1 / 3) / 64)))


def drawn_pivots(dims: int, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors in random directions that the length decides."""
    rows = np.random.default_rng(dims).normal(size=(count, dims))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _masks(top: np.ndarray, pivots: int) -> np.ndarray:
    """Words of bits per row: which pivots it has."""
    masks = np.zeros((len(top), -(-pivots // 64)), dtype=np.uint64)
    for column in top.T:
        masks[np.arange(len(top)), column >> 6] |= np.uint64(1) << (column & 63).astype(np.uint64)
    return masks


def compare(x, y, code, pivots, cosine, share=SHARED):
    """Links between two blocks of a list: (i, j, counts here) for pairs with enough cosine.

    A pair meets in a list for each triple of pivots that it shares; it counts where the triple is its smallest.
    """
    (vx, mx), (vy, my) = x, y
    i, j = np.nonzero(vx @ vy.T >= cosine)
    last = int(code) % pivots
    both = np.zeros(len(i), dtype=np.int64)
    for k in range(last // 64 + 1):
        below = np.uint64((1 << min(64, last + 1 - 64 * k)) - 1)
        both += np.bitwise_count(mx[i, k] & my[j, k] & below)
    return i, j, both == share


def _local_roots(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``count`` nodes reaches over the links."""
    root = np.arange(count)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _linked(group: pa.Table, values: np.ndarray, pivots: np.ndarray, cosine: float):
    """(nodes, links counted here, local roots) of the sorted lists of one length."""
    node, w, code, a, b, block = (group.column(c).to_numpy() for c in ("node", "w", "code", "a", "b", "block"))
    names = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    number, share = len(pivots), min(SHARED, len(pivots))
    masks = _masks(nearest(values, pivots), number)
    edge = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (code[1:] != code[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    for start, end in zip(edge, np.r_[edge[1:], len(node)]):
        if end - start < 2:
            continue
        part, size = slice(start, end), end - start
        v, m = values[part], masks[part]
        if a[start] == b[start]:
            i, j, here = compare((v, m), (v, m), code[start], number, cosine, share)
            other = i != j
            i, j, here = i[other], j[other], here[other]
            links = np.bincount(i[here], weights=w[part][j[here]], minlength=size)
        else:
            left = int(np.searchsorted(block[part], b[start]))
            i, j, here = compare((v[:left], m[:left]), (v[left:], m[left:]), code[start], number, cosine, share)
            j = j + left
            links = (np.bincount(i[here], weights=w[part][j[here]], minlength=size)
                     + np.bincount(j[here], weights=w[part][i[here]], minlength=size))
        if len(i):
            linked = np.unique(np.r_[i, j])
            root = _local_roots(size, i, j)
            yield node[part][linked], links[linked].astype(np.int64), node[part][root[linked]]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE) -> DataFrame:
    """Per vector: key, ``n_links`` (other vectors of its label with enough cosine), ``component_id`` and ``kept``.

    Vectors without a label, null, empty, zero, or with null or non-finite components link with nothing: 0 links, their own
    component, kept. Vectors of different lengths never link; each length has its own lists. ``component_id`` is the
    smallest key reachable by links; null keys count but name no component and are not kept. Repeated rows are vectors of
    their own. Other columns are not read.

    Equal vectors are one class with a weight. Pivots of the commonest length are chosen from its SAMPLE classes
    with the smallest hashes, and are more for larger tables; those of other lengths are random directions. Every class is
    posted to a list per label, length and triple of its nearest pivots, so two classes meet in a list exactly if they
    share three or more. Lists of one entry go before vectors are joined; a long list is cut into blocks and compared block
    by block in different tasks. Every pair found is verified in double precision, and counted in one list only. Links are
    summed per class inside a block and leave it as trees, never as pairs.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usual = (rows.where("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("d")).count()
             .orderBy(F.desc("count"), "d").first())
    dims = usual[0] if usual else 1
    good = (F.col("label").isNotNull() & (F.size("v") > 0)
            & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("v", lambda x: x != 0))
    rows = rows.select("key", "label", "v", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", "v")).alias("node"))
    classes = cut_lineage(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("d", F.size("v")))

    same = classes.where(F.col("d") == dims)
    picked = same.orderBy("node").limit(SAMPLE).select("v").collect()
    sample = unit(np.array([r[0] for r in picked], dtype=np.float64), dims) if picked else np.zeros((0, dims))
    usual_pivots = choose_pivots(sample, pivots_for(same.count()))

    def pivots_of(length):
        return usual_pivots if length == dims else drawn_pivots(length)

    def by_length(lengths, flat):
        """(rows, unit vectors, pivots) of each length, rows being ordered by length."""
        edge = np.flatnonzero(np.r_[len(lengths) > 0, lengths[1:] != lengths[:-1]])
        at = 0
        for start, end in zip(edge, np.r_[edge[1:], len(lengths)]):
            length = int(lengths[start])
            values = flat[at:at + (end - start) * length]
            at += len(values)
            yield slice(start, end), unit(values, length), pivots_of(length)

    def post(batches):
        for batch in batches:
            batch = batch.sort_by("d")
            for part, values, pivots in by_length(batch.column(3).to_numpy(), batch.column(2).flatten().to_numpy()):
                share, number = min(SHARED, len(pivots)), len(pivots)
                top = np.sort(nearest(values, pivots), axis=1)
                codes = np.stack([sum(top[:, c].astype(np.int64) * number ** (share - 1 - at) for at, c in enumerate(combo))
                                  for combo in itertools.combinations(range(top.shape[1]), share)], axis=1)
                at = pa.array(np.repeat(np.arange(part.start, part.stop), codes.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(codes.ravel())],
                    names=["node", "label", "d", "code"])

    kind = classes.schema["label"].dataType.simpleString()
    posted = cut_lineage(classes.select("node", "label", "v", "d").mapInArrow(
        tidy(post), f"node long, label {kind}, d int, code long"))
    lists = posted.groupBy("label", "d", "code").count().where("count > 1").select(
        "label", "d", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # entry of block b goes to all pairs (b, other); a list of one block is the pair (0, 0)
    entries = (posted.join(lists, ["label", "d", "code"])
               .withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("node", "label", "d", "code", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")))
    entries = cut_lineage(entries)
    buckets = max(1, entries.count() // BUCKET)

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("d", "label", "code", "a", "b", "block", "node")]).combine_chunks()
        out = [(np.zeros(0, dtype=np.int64),) * 3]
        for part, values, pivots in by_length(group.column("d").to_numpy(), group.column("v").combine_chunks().flatten().to_numpy()):
            out += _linked(group.slice(part.start, part.stop - part.start), values, pivots, cosine)
        return pa.table(dict(zip(("node", "links", "root"), map(np.concatenate, zip(*out)))))

    found = cut_lineage(entries.join(classes.select("node", "w", "v"), "node")
                        .withColumn("bucket", F.pmod(F.xxhash64("label", "d", "code", "a", "b"), F.lit(buckets)))
                        .groupBy("bucket").applyInArrow(lean(link), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (rows.select("key", "node").join(classes.select("node", "w"), "node", "left").join(links, "node", "left")
             .join(rooted, "node", "left").select("key", "node", "w", "links", F.coalesce("root", "node").alias("root")))
    known = cut_lineage(known)
    lowest = known.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("low"))
    out = known.join(lowest, "root", "left").select(
        F.col("key").alias(key), F.coalesce(F.col("w") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
