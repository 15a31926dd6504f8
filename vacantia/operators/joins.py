"""Joins between jobs, companies, skills, directories and date sources.

Sides are not hinted: Spark broadcasts a side only below its size threshold and otherwise
joins by shuffle, where AQE splits skewed partitions.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.exprs import strip, text


def jobs_with_companies(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with company_slug and company_name; jobs without a company vanish."""
    named = companies.select(
        F.col("id").alias("company_id"), F.col("slug").alias("company_slug"), F.col("name").alias("company_name"))
    return jobs.join(named, "company_id")


def with_company_name(few: DataFrame, companies: DataFrame) -> DataFrame:
    """Add the company name, or null, to a limited sample."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return few.join(names, "company_id", "left")


def having_any_skill(jobs: DataFrame, job_skills: DataFrame, skills: str | list) -> DataFrame:
    """Jobs with at least one of the skills, ignoring case; a blank list is no filter."""
    names = skills.split(",") if isinstance(skills, str) else skills
    wanted = sorted({s.strip().lower() for s in names if s.strip()})
    if not wanted:
        return jobs
    hits = job_skills.filter(F.lower("skill").isin(*wanted)).select(F.col("job_id").alias("id"))
    return jobs.join(hits, "id", "left_semi")


def job_details(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame,
                job_id: int | None = None) -> DataFrame:
    """The full record of a job, or of all jobs, with its skills.

    A job lists a skill at most once, so the array is bounded by the skill vocabulary.
    """
    if job_id is not None:
        jobs, job_skills = jobs.filter(F.col("id") == job_id), job_skills.filter(F.col("job_id") == job_id)
    skills = job_skills.groupBy(F.col("job_id").alias("id")).agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    return jobs_with_companies(jobs, companies).join(skills, "id", "left").select(
        "id", F.col("company_slug").alias("company"), "company_name", "title", "level", "is_remote", "posted_at",
        "url", "description", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


def directory_facts(directory: DataFrame) -> DataFrame:
    """Priority and token per company, compared in lower case; the last entry that has one wins."""
    company = F.lower(strip(text(F.col("company"))))
    return directory.withColumn("company_key", company).filter("company_key <> ''").groupBy("company_key").agg(
        F.expr("max_by(priority, ordinal) FILTER (WHERE priority IS NOT NULL)").alias("company_priority"),
        F.expr("max_by(token, ordinal) FILTER (WHERE token <> '')").alias("company_token"))


def with_directory(postings: DataFrame, directory: DataFrame) -> DataFrame:
    keyed = postings.withColumn("company_key", F.lower(strip(text(F.col("company")))))
    return keyed.join(directory_facts(directory), "company_key", "left").drop("company_key")


def with_best_rank(postings: DataFrame, best: DataFrame) -> DataFrame:
    """Score and rank of the exact url; a row without one scores 0 and has no rank."""
    bare = postings.drop("skill_score", "rank")
    return bare.join(best, "url", "left").withColumn("skill_score", F.coalesce("skill_score", F.lit(0)))


def inferred_dates(history: DataFrame) -> DataFrame:
    """(external_id, inferred_at): merge date, else add date, else last touch.

    ``history`` holds external_id with merged_at, added_at and touched_at.
    """
    return history.groupBy("external_id").agg(
        F.coalesce(F.min("merged_at"), F.min("added_at"), F.max("touched_at")).cast("timestamp").alias("inferred_at")
    ).filter("inferred_at IS NOT NULL")


def infer_posted_at(jobs: DataFrame, merged: DataFrame | None = None, added: DataFrame | None = None,
                    touched: DataFrame | None = None) -> DataFrame:
    """Three optional date sources (external_id, dated_at), consulted in this order."""
    found = []
    for name, source, pick in (("_merged", merged, F.min), ("_added", added, F.min), ("_touched", touched, F.max)):
        if source is not None:
            one = source.filter("dated_at IS NOT NULL").groupBy("external_id").agg(pick("dated_at").alias(name))
            jobs = jobs.join(one, "external_id", "left")
            found.append(name)
    inferred = F.coalesce(*found) if found else F.lit(None).cast("timestamp")
    return jobs.withColumn("inferred_at", inferred).drop(*found)


def last_dated(scraped: DataFrame) -> DataFrame:
    """(external_id, scraped_at): the last dated row of each id in arrival order."""
    return scraped.filter("posted_at IS NOT NULL AND external_id <> ''").groupBy("external_id").agg(
        F.max_by("posted_at", "seq").alias("scraped_at"))


def backfilled(jobs: DataFrame, scraped: DataFrame, provider: str = "github") -> DataFrame:
    """Undated jobs of the provider with the date a fresh scrape gives them, or null."""
    undated = jobs.filter((F.col("provider") == provider) & F.col("posted_at").isNull())
    return undated.join(last_dated(scraped), "external_id", "left")


def backfill_summary(jobs: DataFrame, scraped: DataFrame, provider: str = "github") -> DataFrame:
    return backfilled(jobs, scraped, provider).agg(
        F.lit(provider).alias("provider"), F.count(F.lit(1)).alias("checked"),
        F.count("scraped_at").alias("updated"), F.count_if(F.col("scraped_at").isNull()).alias("missing"))


def backfill_sample(jobs: DataFrame, scraped: DataFrame, companies: DataFrame, n: int = 10,
                    provider: str = "github") -> DataFrame:
    """The first ``n`` updated jobs by id."""
    updated = backfilled(jobs, scraped, provider).filter("scraped_at IS NOT NULL").orderBy("id").limit(n)
    return with_company_name(updated, companies).select(
        "id", "company", "title", "url", F.col("scraped_at").alias("assigned_posted_at"))


def apply_backfill(jobs: DataFrame, scraped: DataFrame, provider: str = "github") -> DataFrame:
    """The jobs table with undated rows of the provider dated where possible; only those rows are joined."""
    mine = F.coalesce((F.col("provider") == provider) & F.col("posted_at").isNull(), F.lit(False))
    dated = backfilled(jobs, scraped, provider).withColumn("posted_at", F.col("scraped_at")).select(*jobs.columns)
    return jobs.filter(~mine).unionByName(dated)

