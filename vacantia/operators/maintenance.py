"""Retention, duplicate cleanup, deletion and integrity checks of the stored tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import as_timestamp
from vacantia.operators.joins import with_company_name


def is_stale(days: int, as_of, provider: str | None = None) -> Column:
    """Active, and posted (or, when undated, updated) before the retention window; never null."""
    if days <= 0:
        raise ValueError("retention days must be positive")
    cutoff = as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    stale = F.col("active") & (F.coalesce("posted_at", "updated_at") < cutoff)
    if provider:
        stale = stale & (F.col("provider") == provider)
    return F.coalesce(stale, F.lit(False))


def prune(jobs: DataFrame, days: int = V.RETENTION_DAYS, as_of=None, provider: str | None = None) -> DataFrame:
    """The jobs that stay."""
    return jobs.filter(~is_stale(days, as_of, provider))


def prune_summary(jobs: DataFrame, days: int = V.RETENTION_DAYS, as_of=None, provider: str | None = None,
                  dry_run: bool = False) -> DataFrame:
    cutoff = as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    return jobs.filter(is_stale(days, as_of, provider)).agg(F.count(F.lit(1)).alias("matched")).select(
        cutoff.alias("cutoff_utc"), "matched",
        (F.lit(0).cast("long") if dry_run else F.col("matched")).alias("deleted"),
        F.lit(provider).cast("string").alias("provider"), F.lit(dry_run).alias("dry_run"))


def prune_sample(jobs: DataFrame, companies: DataFrame, days: int = V.RETENTION_DAYS, as_of=None,
                 provider: str | None = None, n: int = V.SAMPLE_SIZE) -> DataFrame:
    """The ``n`` oldest stale jobs, undated ones first, with their company."""
    oldest = jobs.filter(is_stale(days, as_of, provider)).orderBy(F.asc_nulls_first("posted_at"), "id").limit(n)
    return with_company_name(oldest, companies).select(
        "id", "provider", "company", "title", "posted_at", "updated_at", "url")


def _aggregator_rows(jobs: DataFrame, provider: str) -> Column:
    return (F.col("provider") == provider) & F.col("url").startswith(V.AGGREGATOR_PREFIX)


_TWIN = ["provider", "company_id", "title"]


def _direct_twins(jobs: DataFrame, provider: str) -> DataFrame:
    """Provider, company and title of jobs that link elsewhere than the aggregator.

    Reduced to distinct keys before the join, so a posting with many copies is one row; such a
    row is never the aggregator row itself, as their links differ.
    """
    return jobs.filter((F.col("provider") == provider) & ~F.col("url").startswith(V.AGGREGATOR_PREFIX)).select(
        *_TWIN).distinct()


def duplicates_removed(jobs: DataFrame, provider: str = "github") -> DataFrame:
    """Aggregator rows that have a direct counterpart."""
    return jobs.filter(_aggregator_rows(jobs, provider)).join(_direct_twins(jobs, provider), _TWIN, "left_semi")


def duplicates_kept(jobs: DataFrame, provider: str = "github") -> DataFrame:
    """Aggregator rows without a direct counterpart."""
    return jobs.filter(_aggregator_rows(jobs, provider)).join(_direct_twins(jobs, provider), _TWIN, "left_anti")


def cleanup(jobs: DataFrame, provider: str = "github") -> DataFrame:
    """The jobs table without aggregator rows that have a direct counterpart."""
    others = jobs.filter(~F.coalesce(_aggregator_rows(jobs, provider), F.lit(False)))
    return others.unionByName(duplicates_kept(jobs, provider))


def cleanup_summary(jobs: DataFrame, provider: str = "github") -> DataFrame:
    twins = _direct_twins(jobs, provider).withColumn("direct", F.lit(True))
    return jobs.filter(_aggregator_rows(jobs, provider)).join(twins, _TWIN, "left").agg(
        F.count_if(F.col("direct")).alias("removed"), F.count_if(F.col("direct").isNull()).alias("kept"))


def delete_job(jobs: DataFrame, job_skills: DataFrame, job_id: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without one job."""
    return jobs.filter(F.col("id") != job_id), job_skills.filter(F.col("job_id") != job_id)


def delete_jobs(jobs: DataFrame, job_skills: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the listed jobs (one column, id)."""
    gone = ids.select("id")
    return (jobs.join(gone, "id", "left_anti"),
            job_skills.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti"))


def integrity_report(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Violations per rule (rule, violations); a repeated key counts once."""
    def repeated(df, keys):
        for key in keys:
            df = df.filter(F.col(key).isNotNull())
        return df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))

    required = ("provider", "url", "company_id", "title", "is_remote", "level", "active")
    rows = jobs.agg(
        F.count_if(~F.col("provider").isin(*V.PROVIDERS)).alias("provider-unknown"),
        F.count_if(~F.col("level").isin(*V.LEVELS)).alias("level-unknown"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}-missing") for c in required if c in jobs.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("violations")) for c in rows.columns])
    report = rows.select(F.inline(pairs))
    for rule, df, keys in (("job-key-repeated", jobs, ["provider", "external_id"]),
                           ("company-slug-repeated", companies, ["slug"]),
                           ("job-skill-repeated", job_skills, ["job_id", "skill"])):
        report = report.unionByName(repeated(df, keys).select(F.lit(rule).alias("rule"), "violations"))
    return report
