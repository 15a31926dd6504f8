"""Snippet budget of greenhouse boards: junior software roles first."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.classify import is_engineering
from vacantia.functions.dates import greenhouse_date
from vacantia.functions.exprs import matches
from vacantia.sources.snippets import choose_snippets


def _juniorish(title: Column) -> Column:
    return matches(title, V.JUNIOR_POSITIVE) | matches(title, V.BUDGET_JUNIOR_BONUS)


def budget_order(title: Column, seq: Column) -> Column:
    """Sort key as a struct: phase, junior, machine learning, senior, engineering, length, arrival."""
    low = F.lower(title)
    junior, senior, engineering = _juniorish(low), matches(low, V.SENIOR_BLOCK), is_engineering(low)
    return F.struct(
        (~(junior & ~senior & engineering)).cast("int").alias("phase"),
        (~junior).cast("int").alias("not_junior"),
        (matches(low, V.BUDGET_ML) & ~junior).cast("int").alias("machine_learning"),
        senior.cast("int").alias("senior"),
        (~engineering).cast("int").alias("not_engineering"),
        F.length(low).alias("title_length"),
        seq.alias("seq"),
    )


def is_junior_engineering(title: Column) -> Column:
    return matches(title, V.JUNIOR_POSITIVE) & is_engineering(title) & ~matches(title, V.SENIOR_BLOCK)


def budgeted_snippets(postings: DataFrame, page_facts: DataFrame, cap: int | None = V.SNIPPET_CAP) -> DataFrame:
    """Chosen rows per board with their snippet and place in the budget."""
    ordered = postings.withColumn("priority", budget_order(F.col("title"), F.col("seq")))
    return choose_snippets(ordered, page_facts, [F.col("priority")], cap)


def attach_budgeted(postings: DataFrame, page_facts: DataFrame, cap: int | None = V.SNIPPET_CAP) -> DataFrame:
    """Snippets by budget, and page dates for undated rows whose page was read.

    Pages are read until a board's budget is spent: up to the row that takes the last slot. Without a cap all are read.
    """
    chosen = budgeted_snippets(postings, page_facts, cap)
    snippets = chosen.select("seq", F.col("snippet").alias("description_snippet"))
    used_up = F.lit(False) if cap is None else F.col("budget_rank") == cap
    spent = chosen.filter(used_up).select("token", F.col("priority").alias("last_priority"))
    undated = postings.filter("posted_at IS NULL AND url <> ''").select("seq", "token", "title", "url")
    page_dates = (
        undated.join(page_facts.select("url", "page_date").filter("page_date IS NOT NULL"), "url")
        .join(spent, "token", "left")
        .filter(F.col("last_priority").isNull()
                | (budget_order(F.col("title"), F.col("seq")) <= F.col("last_priority")))
        .select("seq", greenhouse_date(F.col("page_date")).alias("dated_by_page"))
    )
    return (
        postings.drop("description_snippet").join(snippets, "seq", "left").join(page_dates, "seq", "left")
        .withColumn("posted_at", F.coalesce("posted_at", "dated_by_page")).drop("dated_by_page")
    )
