"""Changes of a table store: each step reads one snapshot and publishes a version made from it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.operators import joins, maintenance, runs
from vacantia.operators.upsert import insert_only, prepared, upsert
from vacantia.schemas import CRAWL_RUNS
from vacantia.sources.tables import ConcurrentWrite, Snapshot, TableStore, job_bucket, key_bucket

# How often a change is made anew when another writer was faster.
ATTEMPTS = 3


def _repeated(change: Callable[[], int]) -> int:
    for attempt in range(ATTEMPTS):
        try:
            return change()
        except ConcurrentWrite:
            if attempt == ATTEMPTS - 1:
                raise


def _reserving(store: TableStore, base: Snapshot) -> Callable[[str, DataFrame], int]:
    return lambda table, rows: store.reserve_ids(table, rows.count(), base)


def _run_log(store: TableStore, base: Snapshot, seen: Observation, as_of, pages, notes) -> DataFrame:
    found = runs.run_rows(store.spark, seen, as_of, pages, notes)
    n = found.count()
    first = store.reserve_ids("crawl_runs", n, base)
    # as many rows as there are providers
    ids = F.row_number().over(Window.orderBy("provider")).cast("long") + F.lit(first)
    return found.withColumn("id", ids).select(*CRAWL_RUNS.fieldNames())


def upsert_batch(store: TableStore, incoming: DataFrame, as_of, batch_id: int | None = None, stream: str = "",
                 pages: Callable[[], int] | None = None, notes: str | None = None) -> int:
    """Upsert a batch once; a batch of the stream that is already published is left alone.

    Only the buckets of the batch's ids, and of the legacy ids that may be stored, are read and rewritten. The run log
    takes the batch's counts, observed while it is resolved, in the same version. Where another writer changed one of the
    buckets meanwhile, the batch is resolved again.
    """
    batch = prepared(incoming)

    def change() -> int:
        if batch_id is not None and store.has_batch(batch_id, stream):
            return store.version()
        base, seen = store.snapshot(), Observation()
        own = {r.b for r in batch.filter("external_id <> ''").select(
            key_bucket(F.col("external_id"), base.buckets).alias("b")).distinct().collect()}
        legacy = batch.filter("legacy_external_id IS NOT NULL").select(F.col("legacy_external_id").alias("external_id"))
        touched = sorted(own | base.buckets_holding(legacy, but=own))
        result = upsert(base.read("jobs", touched), base.read("companies"), base.read("job_skills", touched), batch, as_of,
                        ids=_reserving(store, base), seen=seen)
        placed = result.jobs.withColumn("bucket", job_bucket(base.buckets))
        replace = {"jobs": (placed, touched), "job_skills": (result.job_skills, touched)}
        append = {"crawl_runs": _run_log(store, base, seen, as_of, pages() if pages else None, notes)}
        if not result.created.isEmpty():
            append["companies"] = result.created
        return store.commit(base, as_of, replace=replace, append=append, batch_id=batch_id, stream=stream)
    return _repeated(change)


def insert_batch(store: TableStore, incoming: DataFrame, as_of) -> int:
    """Add the jobs that are not stored yet; nothing stored is rewritten."""
    def change() -> int:
        base = store.snapshot()
        result = insert_only(base.read("jobs"), base.read("companies"), incoming, as_of, ids=_reserving(store, base))
        placed = result.jobs.withColumn("bucket", job_bucket(base.buckets))
        append = {"jobs": placed, "job_skills": result.job_skills}
        if not result.companies.isEmpty():
            append["companies"] = result.companies
        return store.commit(base, as_of, append=append)
    return _repeated(change)


def _without(store: TableStore, as_of, gone: Callable[[DataFrame], DataFrame]) -> int:
    """Leave out the chosen jobs and their skills; no data file is written."""
    def change() -> int:
        base = store.snapshot()
        jobs = gone(base.read("jobs", placed=True))
        ids = jobs.select(F.col("id").alias("job_id"))
        skills = base.read("job_skills", placed=True).join(ids, "job_id", "left_semi")
        return store.commit(base, as_of, delete={"jobs": jobs, "job_skills": skills})
    return _repeated(change)


def prune(store: TableStore, as_of, days: int = V.RETENTION_DAYS, provider: str | None = None) -> int:
    return _without(store, as_of, lambda jobs: jobs.filter(maintenance.is_stale(days, as_of, provider)))


def cleanup(store: TableStore, as_of, provider: str = "github") -> int:
    return _without(store, as_of, lambda jobs: maintenance.duplicates_removed(jobs, provider))


def delete_jobs(store: TableStore, ids: DataFrame, as_of) -> int:
    """Leave out the listed jobs (one column, id) and their skills."""
    return _without(store, as_of, lambda jobs: jobs.join(ids.select("id"), "id", "left_semi"))


def backfill(store: TableStore, scraped: DataFrame, as_of, provider: str = "github") -> int:
    """Date undated jobs: rows that get a date are left out where they lie and added anew."""
    def change() -> int:
        base = store.snapshot()
        dated = joins.backfilled(base.read("jobs", placed=True), scraped, provider).filter("scraped_at IS NOT NULL")
        return store.commit(base, as_of, append={"jobs": dated.withColumn("posted_at", F.col("scraped_at"))},
                            delete={"jobs": dated})
    return _repeated(change)
