"""Counts and quality metrics; every report is one conditional aggregate over its input."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.classify import entry_decision, is_engineering
from vacantia.functions.dates import within_days
from vacantia.functions.exprs import not_blank


def jobs_per_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies with jobs, most jobs first; jobs are counted before they meet the names."""
    counts = jobs.groupBy("company_id").agg(F.count(F.lit(1)).alias("jobs"))
    return (
        counts.join(companies, counts["company_id"] == companies["id"])
        .select(F.col("name").alias("company"), "slug", "jobs").orderBy(F.desc("jobs"), "slug")
    )


def totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("posted_at").isNull()).alias("undated"))


def _excluded(reason: str) -> Column:
    decision = entry_decision(F.col("title"), F.col("description"))
    return F.count_if(decision["reason"] == reason)


def exclusion_counts(jobs: DataFrame) -> DataFrame:
    """Rows the entry decision would exclude, by reason."""
    return jobs.agg(
        _excluded("title-senior-term").alias("excluded_by_title"),
        _excluded("description-3plus-years").alias("excluded_by_yoe"))


def provider_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("posted_at").isNull()).alias("undated"))


def ingestion_metrics(jobs: DataFrame) -> DataFrame:
    """The full metrics record, in one pass: per provider, then over the few providers."""
    per_provider = jobs.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("posted_at").isNull()).alias("undated"),
        _excluded("title-senior-term").alias("excluded_by_title"),
        _excluded("description-3plus-years").alias("excluded_by_yoe"))
    return _metrics_record(per_provider)


def _metrics_record(per_provider: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("total"), F.lit(0))
    return per_provider.agg(
        total.alias("total"),
        total.alias("kept"),
        F.coalesce(F.sum("excluded_by_title"), F.lit(0)).alias("excluded_by_title"),
        F.coalesce(F.sum("excluded_by_yoe"), F.lit(0)).alias("excluded_by_yoe"),
        F.when(total > 0, F.sum("undated") / total * 100).otherwise(0.0).alias("percent_undated"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("provider", F.struct("total", "undated"))))).alias("by_provider"))


def metric_flags(jobs: DataFrame) -> DataFrame:
    """What the metrics count of each stored job, with its place."""
    reason = entry_decision(F.col("title"), F.col("description"))["reason"]
    return jobs.select(
        "bucket", "file", "pos", "provider", F.col("posted_at").isNull().alias("undated"),
        F.coalesce(reason == "title-senior-term", F.lit(False)).alias("by_title"),
        F.coalesce(reason == "description-3plus-years", F.lit(False)).alias("by_yoe"))


def metric_rows(flags: DataFrame, sign: int = 1) -> DataFrame:
    """Metrics per bucket and provider, or what they lose (sign -1)."""
    return flags.groupBy("bucket", "provider").agg(*[(sign * value).cast("long").alias(name) for name, value in (
        ("total", F.count(F.lit(1))), ("undated", F.count_if("undated")), ("excluded_by_title", F.count_if("by_title")),
        ("excluded_by_yoe", F.count_if("by_yoe")))])


def maintained_metrics(metrics: DataFrame) -> DataFrame:
    """The metrics record from the stored counts alone; equal to a recount of the jobs."""
    counts = ("total", "undated", "excluded_by_title", "excluded_by_yoe")
    per_provider = metrics.groupBy("provider").agg(*[F.sum(c).alias(c) for c in counts]).filter("total <> 0")
    return _metrics_record(per_provider)


def last_ingest(crawl_runs: DataFrame) -> DataFrame:
    return crawl_runs.agg(F.max("finished_at").alias("last_ingest_at"))


def entry_filter_counts(postings: DataFrame) -> DataFrame:
    """Kept and excluded per source at ingest."""
    keep = entry_decision(F.col("title"), F.col("description_snippet"))["decision"] == "keep"
    return postings.groupBy("source").agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("excluded"))


def _long(df: DataFrame, stage: str, by: list, metrics: dict) -> DataFrame:
    """Conditional counts as rows (stage, source, metric, n)."""
    wide = df.groupBy(*by).agg(*[value.cast("long").alias(name) for name, value in metrics.items()])
    source = F.col(by[0]) if by else F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in metrics])
    return wide.select(F.lit(stage).alias("stage"), source.alias("source"), F.inline(pairs))


def fetch_diagnostics(postings: DataFrame, recent_days: int, as_of) -> DataFrame:
    """Per source: raw rows, with snippet, non-empty and engineering titles, dated, recent."""
    rows = F.count(F.lit(1))
    named = postings.withColumn("source", F.lower("source"))
    return _long(named, "fetched", ["source"], {
        "raw": rows,
        "with_snippet": F.count_if(not_blank(F.col("description_snippet"))),
        "titled": F.count_if(not_blank(F.col("title"))),
        "engineering": F.count_if(is_engineering(F.col("title"))),
        "dated": F.count("posted_at"),
        "recent": F.count_if(within_days(F.col("posted_at"), recent_days, as_of)),
    })


def filter_diagnostics(scored: DataFrame, threshold: int = 0) -> DataFrame:
    """Per source after the basic filters: rows, rows with a match, rows below the score."""
    return _long(scored.withColumn("source", F.lower("source")), "filtered", ["source"], {
        "kept": F.count_if(F.col("skill_score") >= threshold),
        "matched": F.count_if((F.col("skill_score") > 0) & (F.col("skill_score") >= threshold)),
        "dropped_by_score": F.count_if(F.col("skill_score") < threshold),
    })


def curated_diagnostics(records: DataFrame) -> DataFrame:
    """How curated rows got their date."""
    origin = F.col("date_origin")
    return _long(records, "curated", ["provider"], {
        "parsed": F.count_if(origin == "scraped"),
        "inferred": F.count_if(origin == "inferred"),
        "fallback": F.count_if(origin == "fallback"),
        "undated": F.count_if(origin == "fallback"),
        "total": F.count(F.lit(1)),
    })


def match_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(F.col("skill_score") > 0).alias("matched"), F.count(F.lit(1)).alias("total"))


def top_titles(scored: DataFrame, n: int = 5) -> DataFrame:
    """Best scored titles, arrival order among equals."""
    return scored.orderBy(F.desc("skill_score"), "seq").limit(n).select("seq", "title", "skill_score")


def crawl_run(postings: DataFrame, errors: DataFrame, started_at, finished_at) -> DataFrame:
    """Run log rows per source: boards read, postings found, rejected rows."""
    found = postings.groupBy(F.col("source").alias("provider")).agg(
        F.count_distinct("token").cast("int").alias("pages_fetched"),
        F.count(F.lit(1)).cast("int").alias("jobs_discovered"))
    bad = errors.groupBy(F.col("source").alias("provider")).agg(F.count(F.lit(1)).cast("int").alias("errors"))
    return found.join(bad, "provider", "full").select(
        "provider", F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(finished_at).cast("timestamp").alias("finished_at"),
        F.coalesce("pages_fetched", F.lit(0)).alias("pages_fetched"),
        F.coalesce("jobs_discovered", F.lit(0)).alias("jobs_discovered"),
        F.coalesce("errors", F.lit(0)).alias("errors"), F.lit(None).cast("string").alias("notes"))
