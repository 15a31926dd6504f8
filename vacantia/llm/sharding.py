"""Weighted rendezvous hashing of stable record keys, with gapless slots inside each shard."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vacantia.session import cut_lineage

# Digits of the digest that make the uniform number: 12 hex digits are 48 bits, exact in a double.
_DIGITS = 12


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score for the key is highest; ``weights[s]`` is the share of shard ``s``.

    A score is ``-weight / ln(u)`` with ``u`` from the digest of key and shard number alone, so adding a shard moves
    only the records that the new shard wins, and removing one moves only its own. A null key is a key of its own;
    equal scores go to the lower shard. Shards of weight 0 get nothing.
    """
    live = [(s, float(w)) for s, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    text = F.coalesce(key.cast("string"), F.lit("\u0000"))
    scores = []
    for shard, weight in live:
        digest = F.md5(F.concat(text, F.lit(f"/{shard}")))
        number = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
        uniform = (number + F.lit(0.5)) / F.lit(float(16 ** _DIGITS))
        scores.append(F.struct((-F.lit(weight) / F.log(uniform)).alias("score"), F.lit(-shard).alias("shard")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def assign(records: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float], payload: str) -> DataFrame:
    """Shard, shard after growth and slot of every record.

    Returns the key, ``size`` (UTF-8 bytes of the payload plus 1), ``text_crc32``, ``shard``, ``grown_shard`` and
    ``slot``: the record's place in its shard by (key, size, checksum), gapless from 0. Nulls: a null payload counts no
    bytes and has the checksum of an empty one; null keys are one key. Repeated records each get a slot. Other columns
    are not read. An empty table gives no rows.

    The narrow rows are range-sorted by shard and key; a running row id ends the sort key, so equal keys split too.
    Slots come from the place inside a partition and one offset per (partition, shard), which are about as many rows as
    there are partitions.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    narrow = records.select(
        F.col(key), (F.octet_length(body) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"), rendezvous(F.col(key), weights).alias("_shard"),
        rendezvous(F.col(key), grown).alias("_grown"), F.monotonically_increasing_id().alias("_row"))
    order = ["_shard", key, "_size", "_crc", "_row"]
    placed = cut_lineage(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos")))
    held = placed.groupBy("_shard", "_part").agg(F.count("*").alias("n"), F.min("_pos").alias("first"))
    before = F.sum("n").over(Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = held.select("_shard", "_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_base"))
    return placed.join(bases, ["_shard", "_part"]).select(
        F.col(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"),
        (F.col("_pos") + F.col("_base")).alias("slot"), F.col("_grown").alias("grown_shard"))
