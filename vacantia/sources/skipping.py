"""Choosing stored files before a scan: ranges of dates and ids, and key filters, per file.

A key filter is a Bloom filter, cut into bitmaps of 32,768 bits. It has ten bits per row of its file, so it grows with the
file, and a lookup reads the bitmaps that its keys fall into. A set of bits says "maybe"; the join that follows is exact.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.exprs import as_timestamp

# Without the bucket, which is a partition column.
LAYOUTS = {
    "files": "file string, rows long, undated long, min_id long, max_id long, min_posted timestamp, max_posted timestamp, slots int",
    "keys": "file string, slot int, bits binary",
}
BITMAP = 32_768  # fixed by bitmap_construct_agg
BITS_PER_ROW, PROBES = 10, 4


def file_statistics(jobs: DataFrame) -> DataFrame:
    """One row per file of placed jobs."""
    return jobs.groupBy("bucket", "file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("posted_at").isNull()).alias("undated"),
        F.min("id").alias("min_id"), F.max("id").alias("max_id"),
        F.min("posted_at").alias("min_posted"), F.max("posted_at").alias("max_posted"),
        F.ceil(F.count(F.lit(1)) * BITS_PER_ROW / BITMAP).cast("int").alias("slots"))


def _probes(slots: Column) -> Column:
    """The bits of an external id in a filter of so many bitmaps."""
    return F.array(*[F.pmod(F.xxhash64("external_id", F.lit(i)), slots.cast("long") * BITMAP) for i in range(PROBES)])


def key_filters(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """The bitmaps of the filters that hold the external ids of each file; ids that are null are in none."""
    bits = (jobs.filter("external_id IS NOT NULL").select("bucket", "file", "external_id")
            .join(files.select("file", "slots"), "file")
            .select("bucket", "file", F.explode(_probes(F.col("slots"))).alias("bit")))
    return bits.groupBy("bucket", "file", (F.expr("bit div 32768")).cast("int").alias("slot")).agg(
        F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bits"))


def files_holding(keys: DataFrame, files: DataFrame, filters: DataFrame) -> list[str]:
    """The files that may hold one of the keys (external_id, bucket)."""
    probes = (keys.filter("external_id IS NOT NULL").join(files.select("bucket", "file", "slots"), "bucket")
              .select("file", "external_id", F.posexplode(_probes(F.col("slots"))).alias("probe", "bit")))
    found = probes.select("file", "external_id", "probe", (F.expr("bit div 32768")).cast("int").alias("slot"),
                          (F.col("bit") % BITMAP).cast("int").alias("at")).join(filters.select("file", "slot", "bits"), ["file", "slot"])
    byte = F.conv(F.hex(F.substring("bits", F.expr("at div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = found.withColumn("byte", byte).filter("(shiftright(byte, at % 8) & 1) = 1")
    whole = hit.groupBy("file", "external_id").agg(F.count_distinct("probe").alias("n")).filter(F.col("n") == PROBES)
    return [r.file for r in whole.select("file").distinct().collect()]


def recent_files(files: DataFrame, since, undated: bool = True) -> list[str]:
    """The files with a posting from ``since`` on, and those with undated ones if they count."""
    wanted = F.col("max_posted") >= as_timestamp(since)
    if undated:
        wanted = wanted | (F.col("undated") > 0)
    return [r.file for r in files.filter(wanted).select("file").collect()]
