"""Pieces that several corpus operators share."""

import ctypes
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.runs import observed
from vacantia.session import cut_lineage

# A bitmap that the driver gathers and sends to the tasks has this many bits (1 MB), whatever the input's size.
BITMAP_BITS = 1 << 23
# Rows of text are handed to Python code in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
# Rows of a derived table that make a partition of their own; a table of fewer is one partition.
SMALL = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REMEMBERED: dict = {}


def remembered(name: Hashable, make: Callable[[], object]):
    """What a task keeps from one batch to the next, such as an open tokenizer; objects bound their own memory."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function, after which the Python worker gives its memory back.

    Workers outlive their tasks, and more of them wait than run at a time: what each kept would add up over the stages.
    """
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _REMEMBERED.clear()
            give_back()
    return tidied


def lean(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same function of a group, after which the Python worker gives its memory back; groups are large."""
    def leaned(group: pa.Table) -> pa.Table:
        try:
            return work(group)
        finally:
            give_back()
    return leaned


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text each; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for start, end in zip(starts, np.r_[starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def map_pieces(df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply a function to pieces of Arrow batches, one call for about PIECE_BYTES of text."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column):
                yield work(piece)
    return df.mapInArrow(tidy(run), schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the DataFrame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# A key with more than one in this many rows is a hot one: there are fewer of them than this.
HOT = 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Equi-join with a table that has one row per key and says how many rows have it.

    Rows of hot keys never meet in one task: those keys, fewer than HOT, are broadcast to where the rows are. All other keys
    are joined by shuffle, as one holds a thousandth of the rows at most. Keys are not null.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > total // HOT
    hot = F.broadcast(counted.where(is_hot))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counted.where(~is_hot), keys)
    return rows.join(hot, keys).unionByName(rest)


def bitmap(df: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the hash values in a long column, by their lowest bits; nulls set none.

    The driver receives at most ``bits / 64`` rows. A set bit says "maybe": callers join exactly afterwards.
    """
    at = F.col(column).bitwiseAND(bits - 1)
    rows = (df.where(F.col(column).isNotNull())
            .groupBy(F.shiftright(at, 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(({column} & 63) as int))")).alias("mask")).toArrow())
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return words


def maybe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hash values may be in the bitmap."""
    at = hashes.astype(np.int64, copy=False).view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def maybe_rows(df: DataFrame, key: str, words: np.ndarray, wanted: bool = True) -> DataFrame:
    """The rows whose key may be in the bitmap, or those whose key surely is not (null keys are not)."""
    def run(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            hit = maybe(words, pc.fill_null(keys, 0).to_numpy(zero_copy_only=False))
            hit &= pc.is_valid(keys).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit if wanted else ~hit))
    return df.mapInArrow(tidy(run), df.schema)


def settle(spark: SparkSession) -> None:
    """Let the driver clear what planning left behind; after hundreds of jobs its heap would have grown to the limit.

    Shuffle files that nothing refers to any more are removed by this, too.
    """
    spark._jvm.System.gc()
    give_back()


def kept(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for one of many steps of a job: the driver is settled after it."""
    out = cut_lineage(df)
    settle(df.sparkSession)
    return out


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of about ``rows`` short rows in no more partitions than it fills.

    Aggregates and joins of tables that are one partition need no exchange; with hundreds of shuffle partitions, each exchange
    of a small table would make as many tasks and files as it has rows. Larger tables keep a partition per SMALL rows.
    """
    return df.coalesce(max(1, -(-rows // SMALL)))


def kept_few(df: DataFrame) -> DataFrame:
    """``kept`` for a table of short rows, which is read in no more partitions than it fills."""
    seen = Observation()
    out = kept(df.observe(seen, F.count("*").alias("n")))
    return few(out, observed(seen).get("n", 0))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between long ids: one row (node, root) per node of an edge.

    Large-star and small-star steps alternate until nothing changes. Both are a minimum per node, which is combined
    before the shuffle, and an equi-join with it, whose hot nodes AQE splits; each round is written to the shared
    folder. Few edges are one partition, in which a round needs no exchange. ``root`` is the smallest node of the component.
    Self-loops and nulls are dropped.
    """
    def tidy_edges(df):
        return (df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .where("u <> v").distinct())

    spark = edges.sparkSession

    def written(df):
        """The edges, written out, with their number and a sum of their hashes, observed on the way."""
        seen = Observation()
        out = cut_lineage(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")))
        settle(spark)
        got = observed(seen)
        return few(out, got.get("n", 0)), (got.get("n", 0), got.get("h"))

    now, seen = written(tidy_edges(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
                                   .where("u IS NOT NULL AND v IS NOT NULL")))
    while seen[0]:
        both = few(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), seen[0])
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour of u moves to the smallest node around u
        large = tidy_edges(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # smaller neighbours of u and u itself hang on the smallest of them
        small = large.join(least, "u")
        before = seen
        now, seen = written(tidy_edges(few(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                                           .union(small.select("u", F.col("m").alias("v"))), seen[0])))
        if before == seen:
            break
    rooted = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return few(rooted.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), seen[0])
