"""Global positions, ranks and duplicate removal without a single-task window."""

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.exprs import text
from vacantia.session import cut_lineage


def number_rows(df: DataFrame, name: str, seq: str = "seq", leading: Column | None = None,
                tie_break: list[Column] | None = None) -> DataFrame:
    """Number all rows 1..n by (leading descending, seq ascending), nulls last.

    Rows are range-partitioned and sorted, and written out with their place; a running row id ends the order, so rows of
    one value split too. A number is the place inside the partition and one offset for each partition, of which the driver
    sees as many as there are partitions.
    """
    lead = F.lit(0) if leading is None else leading
    order = [F.col("_lead").desc_nulls_last(), F.col(seq).asc_nulls_last(), *(tie_break or []), F.col("_row").asc()]
    placed = cut_lineage(
        df.withColumn("_lead", lead).withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order).drop("_lead", "_row")
        .withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first")).orderBy("_part").collect()
    before = [0, *accumulate(r.n for r in parts)]
    # a local table: rows given one by one would start a Python worker on every core
    offsets = df.sparkSession.createDataFrame(pa.table(
        {"_part": pa.array([r._part for r in parts], pa.int32()),
         "_offset": pa.array([start - r.first + 1 for r, start in zip(parts, before)], pa.int64())}))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos")).drop("_part", "_pos", "_offset")
    )


def rank_by_score(scored: DataFrame) -> DataFrame:
    """Rank over all rows by score, arrival order among equals."""
    return number_rows(scored, "rank", leading=F.col("skill_score"))


def best_per_url(ranked: DataFrame) -> DataFrame:
    """Highest score and first rank of each exact url."""
    return ranked.filter("url <> ''").groupBy("url").agg(
        F.max("skill_score").alias("skill_score"), F.min("rank").alias("rank"))


def deduplicate(postings: DataFrame, order: str = "seq") -> DataFrame:
    """One row per title, company and url, compared in lower case.

    The group keeps its first position and its last row. Both are numbers that are aggregated by hash with partial results,
    so a heavily copied posting costs one small row per map task; the kept rows are then found by ``order``, which is unique.
    """
    fingerprint = F.lower(F.concat_ws("|", text(F.col("title")), text(F.col("company")), text(F.col("url"))))
    groups = postings.groupBy(fingerprint.alias("fingerprint")).agg(
        F.min(order).alias("position"), F.max(order).alias(order)).drop("fingerprint")
    return groups.join(postings, order).select("position", *postings.columns)


def deduplicate_first(postings: DataFrame, order: str = "seq") -> DataFrame:
    """The fallback form: company and title in lower case with the exact url; keeps the first row."""
    first = F.struct(*postings.columns)
    return (
        postings.groupBy(F.lower(text(F.col("company"))).alias("_c"), F.lower(text(F.col("title"))).alias("_t"),
                         text(F.col("url")).alias("_u"))
        .agg(F.min_by(first, order).alias("kept")).select("kept.*")
    )
