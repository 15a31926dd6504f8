"""The browse query over the stored tables."""

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import as_timestamp
from vacantia.operators import filters, joins, paging
from vacantia.sources.tables import Snapshot


@dataclass(frozen=True)
class Search:
    limit: int = V.PAGE_LIMIT
    offset: int = 0
    level: str | None = None
    remote: bool | None = None
    provider: str | None = None
    company: str | None = None
    q: str | None = None
    days: int | None = None
    order: str = V.DEFAULT_ORDER
    skills_any: str | None = None
    us_remote_only: bool = False
    experimental: bool = False
    entry_only: bool = False
    include_undated: bool = True


class Page(NamedTuple):
    items: DataFrame
    header: DataFrame


def matching_jobs(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame, search: Search, as_of) -> DataFrame:
    """All jobs a search matches.  Only the tests whose argument is set enter the plan."""
    found = jobs.filter(filters.provider_gate(search.provider, search.experimental))
    since = filters.posted_since(search.days, as_of)
    if since is not None:
        found = found.filter(since)
    if not search.include_undated:
        found = found.filter(filters.include_undated(False))
    if search.skills_any:
        found = joins.having_any_skill(found, job_skills, search.skills_any)
    found = joins.jobs_with_companies(found, companies)
    for test in filters.equality(search.level, search.remote, search.company, search.us_remote_only):
        found = found.filter(test)
    if search.q:
        found = found.filter(filters.keyword(search.q))
    return filters.entry_filter(found) if search.entry_only else found


def browse(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame, search: Search, as_of) -> Page:
    """One page in compact form, and its header with the exact total."""
    found = matching_jobs(jobs, companies, job_skills, search, as_of)
    items = paging.compact(paging.page(found, search.limit, search.offset, search.order))
    return Page(items, paging.page_header(found, search.limit, search.offset // search.limit))


def stored_jobs(snapshot: Snapshot, search: Search, as_of) -> DataFrame:
    """The stored jobs a search can match, from no more files than its keyword or its days ask for."""
    if search.q:
        return snapshot.mentioning(search.q)
    if search.days and search.days > 0:
        since = snapshot.store.spark.range(1).select(
            as_timestamp(as_of) - F.make_dt_interval(F.lit(search.days))).first()[0]
        return snapshot.posted_since(str(since), undated=False)
    return snapshot.read("jobs")


def browse_stored(snapshot: Snapshot, search: Search, as_of) -> Page:
    """``browse`` over a version of the store."""
    return browse(stored_jobs(snapshot, search, as_of), snapshot.read("companies"), snapshot.read("job_skills"), search, as_of)


# Files that the first step of a page reads; each further step reads twice as many.
FIRST_FILES = 8


def seek(snapshot: Snapshot, search: Search, as_of, after: tuple | None = None) -> DataFrame:
    """The page after the row (posted_at, id), newest first and undated last; the first page without one.

    Files are read in order of their newest date until the page is full and no unread file can hold a row that belongs in
    it. So a late page costs what the first one does. ``offset`` and ``order`` of the search are not used.
    """
    spark, limit = snapshot.store.spark, search.limit
    companies, skills = snapshot.read("companies"), snapshot.read("job_skills")
    files = snapshot.index("files").select("file", "rows", "undated", "min_posted", "max_posted")
    posted, last_id = after if after else (None, None)

    def rows_of(names, test):
        found = matching_jobs(snapshot.read("jobs", files=names), companies, skills, search, as_of).filter(test)
        return paging.compact(paging.page(found, limit, 0)).collect()

    def newest_first(rows):
        return sorted(rows, key=lambda r: (r.posted_at, r.id), reverse=True)[:limit]

    page, done = [], False
    if not after or posted is not None:
        test = F.col("posted_at").isNotNull()
        dated = files.filter("max_posted IS NOT NULL")
        if posted is not None:
            moment = F.lit(posted)
            test = (F.col("posted_at") < moment) | ((F.col("posted_at") == moment) & (F.col("id") < last_id))
            dated = dated.filter(F.col("min_posted") <= moment)
        dated = dated.orderBy(F.desc("max_posted"), "file")
        taken, step = 0, FIRST_FILES
        while not done:
            chunk = dated.offset(taken).limit(step + 1).collect()
            page = newest_first(page + rows_of([r.file for r in chunk[:step]], test)) if chunk else page
            done = len(chunk) <= step or (len(page) == limit and page[-1].posted_at > chunk[step].max_posted)
            taken, step = taken + step, step * 2
    if len(page) < limit:
        # undated rows come by descending id; their files are few or all, as the index says
        test = F.col("posted_at").isNull()
        if after and posted is None:
            test = test & (F.col("id") < last_id)
        names = [r.file for r in files.filter("undated > 0").select("file").collect()]
        page += rows_of(names, test)[:limit - len(page)] if names else []
    shape = paging.compact(matching_jobs(snapshot.read("jobs"), companies, skills, search, as_of)).schema
    return spark.createDataFrame(page, shape)
