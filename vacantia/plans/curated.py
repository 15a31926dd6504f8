"""Curated ingest: landed list pages to an upsert batch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.operators.ranking import number_rows
from vacantia.operators.upsert import Upserted, upsert
from vacantia.session import cut_lineage
from vacantia.sources.board_pages import first_landed
from vacantia.sources.curated import curated_postings


def landed_lists(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_idx, md) of each list address, from the first candidate address that has landed.

    ``sources`` is (source_idx, address), ``pages`` is (url, body).
    """
    candidates = sources.select("source_idx", F.posexplode(text.raw_list_urls(F.col("address")))
                                .alias("ordinal", "url"))
    return first_landed(candidates, pages, "source_idx").select("source_idx", F.col("body").alias("md"))


def curated_batch(lists: DataFrame, as_of, **options) -> DataFrame:
    """Upsert records in list order, numbered."""
    records = curated_postings(lists, as_of, **options)
    arrival = F.struct("source_idx", "parser_idx", "row_idx")
    return number_rows(cut_lineage(records.withColumn("_arrival", arrival)), "seq", seq="_arrival").drop("_arrival")


def ingest(lists: DataFrame, jobs: DataFrame, companies: DataFrame, job_skills: DataFrame, as_of,
           **options) -> Upserted:
    return upsert(jobs, companies, job_skills, curated_batch(lists, as_of, **options), as_of)
