"""Choices of rows to enrich, bounded where a cap is given, and the enrichment itself from landed pages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.classify import is_engineering, is_remote_us
from vacantia.functions.dates import date_in_text
from vacantia.functions.exprs import filled, matches, not_blank, strip, text
from vacantia.operators.filters import keeps_basic, keeps_recent


def _has_snippet() -> Column:
    return not_blank(F.col("description_snippet"))


def quota_candidates(postings: DataFrame, as_of, junior_only: bool = False, us_remote_only: bool = False,
                     recent_days: int = 0, caps: dict | None = None, cap: int | None = V.SNIPPET_CAP) -> DataFrame:
    """Per provider, the first rows without a snippet, as many as its quota still lacks; without a cap all of them.

    Candidates are first limited to the largest cap: a constant bound, which Spark applies per
    map task before the shuffle, so a provider with most of the rows stays cheap.  The limit
    by deficit then sees at most that many rows per provider.
    """
    source = F.lower(text(F.col("source")))
    named = postings.withColumn("source_key", source).filter("source_key <> ''")
    have = named.groupBy("source_key").agg(F.count_if(_has_snippet()).alias("have"))
    likely = named.filter(~_has_snippet() & keeps_basic(junior_only) & keeps_recent(recent_days, as_of))
    if us_remote_only:
        likely = likely.filter(is_remote_us(F.col("location"), F.col("description_snippet")))
    if cap is None and not caps:
        return likely.drop("source_key")
    cap = V.SNIPPET_CAP if cap is None else cap
    quota = F.lit(cap)
    for name, value in (caps or {}).items():
        quota = F.when(F.col("source_key") == name.lower(), value).otherwise(quota)
    largest = max([cap, *(caps or {}).values()])
    turn = Window.partitionBy("source_key").orderBy("seq")
    return (
        likely.withColumn("turn", F.row_number().over(turn))
        .filter(F.col("turn") <= largest)
        .join(have, "source_key")
        .filter(F.col("turn") <= F.greatest(quota - F.col("have"), F.lit(0)))
        .drop("source_key", "have", "turn")
    )


def junior_candidates(postings: DataFrame, as_of, us_remote_only: bool = False, recent_days: int = 0,
                      cap: int | None = V.JUNIOR_TOP_UP_CAP) -> DataFrame:
    """The ``cap`` rows most worth a snippet, junior titles first, then shorter ones; without a cap all that may get one."""
    title = strip(text(F.col("title")))
    pool = postings.filter(
        ~_has_snippet() & filled(F.col("url")).isNotNull() & (title != "") & is_engineering(title)
        & ~matches(title, V.STRICT_SENIOR) & keeps_recent(recent_days, as_of))
    if us_remote_only:
        place = F.lower(text(F.col("location")))
        pool = pool.filter(
            is_remote_us(F.col("location"), F.col("description_snippet")) | (place == "")
            | (place.contains("remote") & (place.contains("united states") | place.contains("us"))))
    if cap is None:
        return pool
    low = F.lower(text(F.col("title")))
    return pool.orderBy(matches(low, V.STRICT_JUNIOR_TITLE).desc(), F.length(low), "seq").limit(max(cap, 0))


def add_snippets(postings: DataFrame, chosen: DataFrame, page_facts: DataFrame) -> DataFrame:
    """Give the chosen rows the snippet of their landed page; the others stay as they are."""
    found = chosen.select("seq", "url").join(page_facts.select("url", "top_up_snippet"), "url").filter(
        "top_up_snippet IS NOT NULL").select("seq", "top_up_snippet")
    return (
        postings.join(found, "seq", "left")
        .withColumn("description_snippet", F.coalesce("top_up_snippet", "description_snippet"))
        .drop("top_up_snippet")
    )


def backfill_targets(postings: DataFrame, cap: int | None = V.DATE_BACKFILL_CAP) -> DataFrame:
    """The first ``cap`` undated rows that have a link, or all of them."""
    undated = postings.filter("posted_at IS NULL AND url <> ''")
    return undated if cap is None else undated.orderBy("seq").limit(max(cap, 0))


def found_dates(targets: DataFrame, page_facts: DataFrame | None, as_of) -> DataFrame:
    """(seq, source, found_at) for targets whose snippet, else landed page, names a date."""
    own = filled(strip(text(F.col("description_snippet"))))
    date = date_in_text(own, as_of)
    if page_facts is not None:
        targets = targets.join(page_facts.select("url", "text_date"), "url", "left")
        date = F.when(own.isNotNull(), date).otherwise(F.col("text_date"))
    return targets.select("seq", "source", date.alias("found_at")).filter("found_at IS NOT NULL")


def backfill_dates(postings: DataFrame, page_facts: DataFrame | None, as_of,
                   cap: int | None = V.DATE_BACKFILL_CAP) -> DataFrame:
    found = found_dates(backfill_targets(postings, cap), page_facts, as_of).select("seq", "found_at")
    return (
        postings.join(found, "seq", "left")
        .withColumn("posted_at", F.coalesce("posted_at", "found_at")).drop("found_at")
    )
