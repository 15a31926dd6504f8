"""Incremental ingest: landed payload files stream into the table store."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.functions.text import external_id
from vacantia.operators.ranking import number_rows
from vacantia.operators.runs import observed
from vacantia.plans.upkeep import upsert_batch
from vacantia.session import cut_lineage
from vacantia.sources.tables import TableStore

LANDED = "payload_id long, token string, company string, host string, path string, body string"


def landed_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed payloads (Parquet) as a stream."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_stream(payloads: DataFrame, parser: Callable[[DataFrame], DataFrame],
                  to_records: Callable[[DataFrame], DataFrame], store: TableStore, checkpoint: str,
                  as_of) -> StreamingQuery:
    """Parse and upsert every micro-batch; a replayed batch changes nothing.

    Batch number and stream id are published with the version, so a batch that was written
    before a failure is recognised and skipped.  The id lies in the checkpoint: a stream that
    starts over with a new one numbers its batches anew and is not mistaken for the old one.
    """
    def stream_id(spark: SparkSession) -> str:
        return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]

    def apply(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("pages"))
        # a landed file can be one row group, which one task reads; the parser runs on all cores and once
        records = to_records(cut_lineage(parser(counted.repartition(batch.sparkSession.sparkContext.defaultParallelism))))
        upsert_batch(store, records, as_of, batch_id, stream_id(batch.sparkSession), lambda: observed(seen).get("pages"))

    return (
        payloads.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def board_records(postings: DataFrame) -> DataFrame:
    """Parsed postings as upsert records, numbered in order of arrival."""
    found = number_rows(postings.filter("url <> '' AND title <> ''").withColumnRenamed("seq", "arrival"), "seq", seq="arrival")
    return found.select(
        "seq", F.col("source").alias("provider"), external_id([], F.col("url")).alias("external_id"), "url",
        "company", "title", "location", F.coalesce("level", F.lit("unknown")).alias("level"), "posted_at")
