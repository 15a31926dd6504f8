"""Orders and pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V


def order_by(order: str | None = None) -> list[Column]:
    """Sort columns of a named order; an unknown name means newest first."""
    orders = {
        "id_asc": [F.asc("id")],
        "id_desc": [F.desc("id")],
        "posted_at_asc": [F.asc_nulls_first("posted_at"), F.asc("id")],
        "posted_at_desc": [F.desc_nulls_last("posted_at"), F.desc("id")],
    }
    return orders.get(order, orders[V.DEFAULT_ORDER])


def page(df: DataFrame, limit: int = V.PAGE_LIMIT, offset: int = 0, order: str | None = None) -> DataFrame:
    if not 1 <= limit <= V.PAGE_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {V.PAGE_LIMIT_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order_by(order)).offset(offset).limit(limit)


def page_header(df: DataFrame, limit: int = V.PAGE_LIMIT, page_no: int = 0) -> DataFrame:
    """One row: total, limit, offset, page count and the neighbouring pages (pages count from 0)."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long")
    last = F.col("total_pages") - 1
    here = F.lit(page_no).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", pages).select(
        "total", F.lit(limit).cast("long").alias("limit"), (here * limit).alias("offset"), "total_pages",
        F.greatest(F.lit(0), here - 1).cast("long").alias("prev_page"), F.least(last, here + 1).alias("next_page"),
        (here > 0).alias("has_prev"), (here + 1 < F.col("total_pages")).alias("has_next"))


def compact(jobs: DataFrame) -> DataFrame:
    """The list projection of jobs joined with their companies."""
    return jobs.select(
        "id", F.col("company_slug").alias("company"), "company_name", "title", "level", "is_remote", "posted_at", "url")


def latest(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(limit)


def slice_by_id(jobs: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A slice of the stored table; the order is fixed to the id."""
    return jobs.orderBy("id").offset(skip).limit(limit)


def by_ids(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored jobs with the requested ids (one column, id)."""
    return jobs.join(wanted.select("id"), "id", "left_semi")
