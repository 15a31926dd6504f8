"""Joins, aggregates, quotas, ranking, paging and exports."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.base import AS_OF, found, query, table, view
from queries.classifiers import BASIC_JUNIOR, ENGINEERING, ENTRY_KEEP, ENTRY_TERMS, SOFT_SCORE, entry_sql
from queries.source_queries import all_landed, lists
from vacantia.functions import fixed_values as V
from vacantia.operators import aggregates, joins, maintenance, paging, quotas, ranking, scoring, sinks
from vacantia.plans import browse as browsing
from vacantia.plans import scan
from vacantia.session import own_folder
from vacantia.sources import boards, greenhouse_budget
from vacantia.sources.curated import curated_postings
from vacantia.sources.snippets import read_pages


def jobs(spark, sf):
    return view(spark, sf, "jobs_fx")


def companies(spark, sf):
    return view(spark, sf, "companies_fx")


def skills(spark, sf):
    return view(spark, sf, "job_skills_fx")


def postings(spark, sf):
    return view(spark, sf, "postings_fx")


def scored(spark, sf):
    return scoring.score(postings(spark, sf), V.DEFAULT_SKILLS)


def scratch(spark, name):
    """A new folder for one run, below the shared folder."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- joins -----------------------------------------------------------------------------

@query("j1_jobs_companies", """
SELECT j.id, c.slug AS company_slug, c.name AS company_name FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id""")
def j1(spark, sf):
    return joins.jobs_with_companies(jobs(spark, sf), companies(spark, sf)).select(
        "id", "company_slug", "company_name")


@query("j2_having_any_skill", """
SELECT id FROM jobs_fx j WHERE EXISTS (SELECT 1 FROM job_skills_fx s WHERE s.job_id = j.id AND lower(s.skill) IN ('sql', 'react'))""")
def j2(spark, sf):
    return joins.having_any_skill(jobs(spark, sf), skills(spark, sf), " SQL, React,").select("id")


@query("j3_job_details", """
SELECT j.id, c.slug AS company, j.title, j.description, coalesce(array_to_string(s.skills, '|'), '') AS skills FROM jobs_fx j
JOIN companies_fx c ON c.id = j.company_id LEFT JOIN (SELECT job_id, list(skill ORDER BY skill) AS skills FROM job_skills_fx GROUP BY job_id) s ON s.job_id = j.id""")
def j3(spark, sf):
    return joins.job_details(jobs(spark, sf), companies(spark, sf), skills(spark, sf)).select(
        "id", "company", "title", "description", F.array_join("skills", "|").alias("skills"))


DIRECTORY_FACTS = """SELECT lower(trim(company)) AS company_key, arg_max(priority, ordinal) FILTER (WHERE priority IS NOT NULL) AS company_priority,
 arg_max(token, ordinal) FILTER (WHERE token <> '') AS company_token FROM directory_fx WHERE trim(coalesce(company, '')) <> '' GROUP BY 1"""


@query("j4_directory_facts", f"""
SELECT p.seq, f.company_priority, f.company_token FROM postings_fx p LEFT JOIN ({DIRECTORY_FACTS}) f ON f.company_key = lower(trim(p.company))""")
def j4(spark, sf):
    return joins.with_directory(postings(spark, sf), view(spark, sf, "directory_fx")).select(
        "seq", "company_priority", "company_token")


RANKED = f"""SELECT *, row_number() OVER (ORDER BY skill_score DESC, seq) AS rank FROM (SELECT *, {SOFT_SCORE} AS skill_score FROM postings_fx)"""


@query("j5_best_rank", f"""
WITH r AS ({RANKED}), b AS (SELECT url, max(skill_score) AS skill_score, min(rank) AS rank FROM r WHERE url <> '' GROUP BY url)
SELECT p.seq, b.skill_score, b.rank FROM postings_fx p LEFT JOIN b ON b.url = p.url""")
def j5(spark, sf):
    best = ranking.best_per_url(ranking.rank_by_score(scored(spark, sf)))
    return joins.with_best_rank(postings(spark, sf), best).select(
        "seq", F.col("skill_score").cast("long").alias("skill_score"), "rank")


LAST_DATED = "SELECT external_id, arg_max(posted_at, seq) AS scraped_at FROM scraped_dates_fx WHERE posted_at IS NOT NULL GROUP BY external_id"


@query("j6_backfill_summary", f"""
SELECT 'github' AS provider, count(*) AS checked, count(l.scraped_at) AS updated, count(*) - count(l.scraped_at) AS missing
FROM jobs_fx j LEFT JOIN ({LAST_DATED}) l ON l.external_id = j.external_id WHERE j.provider = 'github' AND j.posted_at IS NULL""")
def j6(spark, sf):
    return joins.backfill_summary(jobs(spark, sf), view(spark, sf, "scraped_dates_fx"))


@query("j6_apply_backfill", f"""
SELECT j.id, CASE WHEN j.provider = 'github' AND j.posted_at IS NULL THEN l.scraped_at ELSE j.posted_at END AS posted_at
FROM jobs_fx j LEFT JOIN ({LAST_DATED}) l ON l.external_id = j.external_id""")
def j6_apply(spark, sf):
    return joins.apply_backfill(jobs(spark, sf), view(spark, sf, "scraped_dates_fx")).select("id", "posted_at")


TWIN = "EXISTS (SELECT 1 FROM dup_jobs_fx o WHERE o.provider = j.provider AND o.company_id = j.company_id AND o.title = j.title AND o.id <> j.id AND o.url NOT LIKE 'https://simplify.jobs/%')"
AGGREGATOR = "j.provider = 'github' AND j.url LIKE 'https://simplify.jobs/%'"


@query("j7_duplicates_removed", f"SELECT j.id FROM dup_jobs_fx j WHERE {AGGREGATOR} AND {TWIN}")
def j7(spark, sf):
    return maintenance.duplicates_removed(view(spark, sf, "dup_jobs_fx")).select("id")


@query("j7_cleanup_summary", f"""
SELECT count(*) FILTER (WHERE {TWIN}) AS removed, count(*) FILTER (WHERE NOT {TWIN}) AS kept FROM dup_jobs_fx j WHERE {AGGREGATOR}""")
def j7_summary(spark, sf):
    return maintenance.cleanup_summary(view(spark, sf, "dup_jobs_fx"))


@query("x3_kept_difference", f"SELECT j.id FROM dup_jobs_fx j WHERE NOT ({AGGREGATOR} AND {TWIN})")
def x3(spark, sf):
    return maintenance.cleanup(view(spark, sf, "dup_jobs_fx")).select("id")


@query("j8_infer_posted_at", """
SELECT j.id, coalesce(h.merged_at, h.added_at, h.touched_at) AS inferred_at FROM jobs_fx j LEFT JOIN history_fx h ON h.external_id = j.external_id""")
def j8(spark, sf):
    history = view(spark, sf, "history_fx")
    parts = [history.select("external_id", F.col(c).alias("dated_at")) for c in ("merged_at", "added_at", "touched_at")]
    return joins.infer_posted_at(jobs(spark, sf), *parts).select("id", "inferred_at")


@query("e2_date_sources", """
SELECT j.id, h.added_at AS inferred_at FROM jobs_fx j LEFT JOIN history_fx h ON h.external_id = j.external_id""")
def e2(spark, sf):
    added = view(spark, sf, "history_fx").select("external_id", F.col("added_at").alias("dated_at"))
    return joins.infer_posted_at(jobs(spark, sf), added=added).select("id", "inferred_at")


# ---- aggregates ------------------------------------------------------------------------

@query("a1_jobs_per_company", """
SELECT c.name AS company, c.slug, count(*) AS jobs FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id GROUP BY c.id, c.name, c.slug""")
def a1(spark, sf):
    return aggregates.jobs_per_company(jobs(spark, sf), companies(spark, sf))


@query("a2_totals", "SELECT count(*) AS total, count(*) - count(posted_at) AS undated FROM jobs_fx")
def a2(spark, sf):
    return aggregates.totals(jobs(spark, sf))


REASONS = f"SELECT *, {entry_sql()} AS reason FROM jobs_fx"


@query("a3_exclusion_counts", f"""
SELECT count(*) FILTER (WHERE reason = 'title-senior-term') AS excluded_by_title,
 count(*) FILTER (WHERE reason = 'description-3plus-years') AS excluded_by_yoe FROM ({REASONS})""")
def a3(spark, sf):
    return aggregates.exclusion_counts(jobs(spark, sf))


METRICS = f"""
SELECT count(*) AS total, count(*) AS kept, count(*) FILTER (WHERE reason = 'title-senior-term') AS excluded_by_title,
 count(*) FILTER (WHERE reason = 'description-3plus-years') AS excluded_by_yoe,
 round((count(*) - count(posted_at)) / count(*) * 100, 6) AS percent_undated FROM ({REASONS})"""


@query("a4_ingestion_metrics", METRICS)
def a4(spark, sf):
    return aggregates.ingestion_metrics(jobs(spark, sf)).drop("by_provider").withColumn(
        "percent_undated", F.round("percent_undated", 6))


@query("a4_by_provider", """
SELECT provider, count(*) AS total, count(*) - count(posted_at) AS undated FROM jobs_fx GROUP BY provider""")
def a4_providers(spark, sf):
    report = aggregates.ingestion_metrics(jobs(spark, sf))
    return report.select(F.explode("by_provider").alias("provider", "n")).select("provider", "n.*")


@query("a4_provider_counts", """
SELECT provider, count(*) AS total, count(*) FILTER (WHERE posted_at IS NULL) AS undated FROM jobs_fx GROUP BY provider""")
def a4_counts(spark, sf):
    return aggregates.provider_counts(jobs(spark, sf))


@query("a5_entry_filter_counts", f"""
SELECT source, count(*) FILTER (WHERE reason NOT IN ('title-senior-term', 'description-3plus-years')) AS kept,
 count(*) FILTER (WHERE reason IN ('title-senior-term', 'description-3plus-years')) AS excluded
FROM (SELECT source, {entry_sql('title', 'description_snippet')} AS reason FROM postings_fx) GROUP BY source""")
def a5(spark, sf):
    return aggregates.entry_filter_counts(postings(spark, sf))


@query("a6_fetch_diagnostics", f"""
WITH c AS (SELECT source, count(*) AS raw, count(*) FILTER (WHERE trim(description_snippet) <> '') AS with_snippet, count(*) FILTER (WHERE trim(title) <> '') AS titled,
 count(*) FILTER (WHERE {ENGINEERING}) AS engineering, count(posted_at) AS dated, count(*) FILTER (WHERE posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) AS recent
 FROM postings_fx GROUP BY source)
SELECT 'fetched' AS stage, source, metric, n FROM c UNPIVOT (n FOR metric IN (raw, with_snippet, titled, engineering, dated, recent))""")
def a6(spark, sf):
    return aggregates.fetch_diagnostics(postings(spark, sf), 365, AS_OF)


@query("a6_filter_diagnostics", f"""
WITH s AS (SELECT source, {SOFT_SCORE} AS score FROM postings_fx), c AS (SELECT source, count(*) FILTER (WHERE score >= 2) AS kept,
 count(*) FILTER (WHERE score >= 2 AND score > 0) AS matched, count(*) FILTER (WHERE score < 2) AS dropped_by_score FROM s GROUP BY source)
SELECT 'filtered' AS stage, source, metric, n FROM c UNPIVOT (n FOR metric IN (kept, matched, dropped_by_score))""")
def a6_filter(spark, sf):
    return aggregates.filter_diagnostics(scored(spark, sf), 2)


@query("a6_curated_diagnostics", """
WITH u AS (SELECT DISTINCT doc_id % 3 AS kind, doc_id % 90 AS n FROM md_doc_fx WHERE doc_id % 3 <> 1), c AS (SELECT count(*) AS total FROM u)
SELECT 'curated' AS stage, 'github' AS source, 'parsed' AS metric, total AS n FROM c UNION ALL SELECT 'curated', 'github', 'total', total FROM c
UNION ALL SELECT 'curated', 'github', m, 0 FROM c, (VALUES ('inferred'), ('fallback'), ('undated')) v(m)""")
def a6_curated(spark, sf):
    return aggregates.curated_diagnostics(
        curated_postings(lists(spark, sf), "2025-09-18 15:30:00", scrape=True))


@query("a6_crawl_run", f"""
SELECT p.source AS provider, count(DISTINCT company) AS pages_fetched, count(*) AS jobs_discovered,
 count(*) FILTER (WHERE trim(title) = '') AS errors, TIMESTAMP '{AS_OF}' AS started_at FROM postings_fx p GROUP BY p.source""")
def a6_run(spark, sf):
    found_rows = postings(spark, sf).withColumn("token", F.col("company"))
    run = aggregates.crawl_run(found_rows, found_rows.filter("trim(title) = ''"), AS_OF, AS_OF)
    return run.select("provider", "started_at", *[F.col(c).cast("long").alias(c) for c in (
        "pages_fetched", "jobs_discovered", "errors")])


@query("a7_best_per_url", f"""
SELECT url, max(skill_score) AS skill_score, min(rank) AS rank FROM ({RANKED}) WHERE url <> '' GROUP BY url""")
def a7(spark, sf):
    return ranking.best_per_url(ranking.rank_by_score(scored(spark, sf))).select(
        "url", F.col("skill_score").cast("long").alias("skill_score"), "rank")


@query("a8_skill_score", f"SELECT seq, {SOFT_SCORE} AS skill_score FROM postings_fx")
def a8(spark, sf):
    return scored(spark, sf).select("seq", F.col("skill_score").cast("long").alias("skill_score"))


@query("a9_deduplicate", """
SELECT min(seq) AS position, max(seq) AS seq, arg_max(url, seq) AS url, arg_max(source, seq) AS source FROM postings_fx
GROUP BY lower(title), lower(company), lower(url)""")
def a9(spark, sf):
    return ranking.deduplicate(postings(spark, sf)).select("position", "seq", "url", "source")


@query("a9_deduplicate_first", """
SELECT min(seq) AS seq, url, arg_min(source, seq) AS source FROM postings_fx GROUP BY lower(title), lower(company), url""")
def a9_first(spark, sf):
    return ranking.deduplicate_first(postings(spark, sf)).select("seq", "url", "source")


@query("a10_match_rate", f"""
SELECT count(*) FILTER (WHERE s > 0) AS matched, count(*) AS total FROM (SELECT {SOFT_SCORE} AS s FROM postings_fx)""")
def a10(spark, sf):
    return aggregates.match_rate(scored(spark, sf))


@query("a10_top_titles", f"""
SELECT seq, title, {SOFT_SCORE} AS skill_score FROM postings_fx ORDER BY skill_score DESC, seq LIMIT 5""")
def a10_top(spark, sf):
    return aggregates.top_titles(scored(spark, sf)).withColumn("skill_score", F.col("skill_score").cast("long"))


def gh_postings(spark, sf):
    return boards.greenhouse(view(spark, sf, "gh_landed_fx"))


BUDGET = f"""WITH p AS (SELECT payload_id * 2147483648 + pos AS seq, token, CASE pos WHEN 0 THEN 'https://boards.example.com/g/' ELSE 'https://boards.example.com/h/' END || payload_id AS url,
 CASE pos WHEN 0 THEN 'Software Engineer I' ELSE 'Staff Engineer' END AS title, pos FROM (SELECT *, unnest(range(0, 2)) AS pos FROM gh_landed_fx)),
b AS (SELECT p.*, row_number() OVER (PARTITION BY token ORDER BY pos, seq) AS budget_rank FROM p JOIN board_page_fx w ON w.url = p.url)"""


@query("wn3_snippet_budget", f"{BUDGET} SELECT seq, token, budget_rank FROM b WHERE budget_rank <= 30")
def wn3(spark, sf):
    chosen = greenhouse_budget.budgeted_snippets(gh_postings(spark, sf), read_pages(view(spark, sf, "board_page_fx")))
    return chosen.select(F.col("seq").cast("long").alias("seq"), "token", F.col("budget_rank").cast("long").alias("budget_rank"))


@query("a11_junior_snippets", f"{BUDGET} SELECT count(*) AS n FROM b WHERE budget_rank <= 30 AND pos = 0")
def a11(spark, sf):
    chosen = greenhouse_budget.budgeted_snippets(gh_postings(spark, sf), read_pages(view(spark, sf, "board_page_fx")))
    return chosen.agg(F.count_if(greenhouse_budget.is_junior_engineering(F.col("title"))).alias("n"))


# ---- quotas and ranking ----------------------------------------------------------------

HAS = "trim(coalesce(description_snippet, '')) <> ''"


@query("wn1_provider_quota", f"""
WITH h AS (SELECT source, count(*) FILTER (WHERE {HAS}) AS have FROM bare_postings_fx GROUP BY source),
t AS (SELECT p.*, h.have, row_number() OVER (PARTITION BY p.source ORDER BY seq) AS turn FROM bare_postings_fx p JOIN h ON h.source = p.source
 WHERE NOT ({HAS}) AND {BASIC_JUNIOR})
SELECT seq, source FROM t WHERE turn <= greatest(CASE source WHEN 'lever' THEN 12 ELSE 30 END - have, 0)""")
def wn1(spark, sf):
    return quotas.quota_candidates(view(spark, sf, "bare_postings_fx"), AS_OF, junior_only=True,
                                   caps={"lever": 12}).select("seq", "source")


@query("wn2_junior_top_up", f"""
SELECT seq FROM bare_postings_fx WHERE NOT ({HAS}) AND trim(title) <> '' AND {ENGINEERING} AND NOT {found('title', V.STRICT_SENIOR)}
ORDER BY {found('title', V.STRICT_JUNIOR_TITLE)} DESC, length(title), seq LIMIT 150""")
def wn2(spark, sf):
    return quotas.junior_candidates(view(spark, sf, "bare_postings_fx"), AS_OF).select("seq")


@query("wn4_date_backfill", f"""
WITH t AS (SELECT * FROM postings_fx WHERE posted_at IS NULL AND url <> '' ORDER BY seq LIMIT 120)
SELECT source, count(*) AS n FROM t WHERE contains(coalesce(description_snippet, ''), 'Posted ') GROUP BY source""")
def wn4(spark, sf):
    targets = quotas.backfill_targets(postings(spark, sf))
    return quotas.found_dates(targets, None, AS_OF).groupBy("source").agg(F.count("seq").alias("n"))


@query("wn5_rank", f"SELECT seq, skill_score, rank FROM ({RANKED})")
def wn5(spark, sf):
    return ranking.rank_by_score(scored(spark, sf)).select(
        "seq", F.col("skill_score").cast("long").alias("skill_score"), "rank")


@query("wn6_prune_sample", f"""
SELECT j.id, j.provider, c.name AS company, j.title, j.posted_at, j.updated_at, j.url FROM jobs_fx j LEFT JOIN companies_fx c ON c.id = j.company_id
WHERE j.active AND coalesce(j.posted_at, j.updated_at) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY j.posted_at NULLS FIRST, j.id LIMIT 10""")
def wn6(spark, sf):
    return maintenance.prune_sample(jobs(spark, sf), companies(spark, sf), 30, AS_OF)


@query("wn7_backfill_sample", f"""
SELECT j.id, c.name AS company, j.title, j.url, l.scraped_at AS assigned_posted_at FROM jobs_fx j JOIN ({LAST_DATED}) l ON l.external_id = j.external_id
LEFT JOIN companies_fx c ON c.id = j.company_id WHERE j.provider = 'github' AND j.posted_at IS NULL ORDER BY j.id LIMIT 10""")
def wn7(spark, sf):
    return joins.backfill_sample(jobs(spark, sf), view(spark, sf, "scraped_dates_fx"), companies(spark, sf))


# ---- orders, pages, browse -------------------------------------------------------------

def _order_query(name, clause):
    @query(f"o1_{name}", f"SELECT id, posted_at FROM jobs_fx ORDER BY {clause} LIMIT 40 OFFSET 5")
    def ordered(spark, sf):
        return paging.page(jobs(spark, sf), 40, 5, name).select("id", "posted_at")


for _name, _clause in (("posted_at_desc", "posted_at DESC NULLS LAST, id DESC"),
                       ("posted_at_asc", "posted_at ASC NULLS FIRST, id ASC"),
                       ("id_asc", "id ASC"), ("id_desc", "id DESC")):
    _order_query(_name, _clause)


@query("o1_unknown_order", "SELECT id FROM jobs_fx ORDER BY posted_at DESC NULLS LAST, id DESC LIMIT 25")
def o1_unknown(spark, sf):
    return paging.page(jobs(spark, sf), order="newest").select("id")


@query("o2_page", "SELECT id FROM jobs_fx ORDER BY posted_at DESC NULLS LAST, id DESC LIMIT 100 OFFSET 300")
def o2(spark, sf):
    return paging.page(jobs(spark, sf), 100, 300).select("id")


@query("o3_page_header", """
WITH t AS (SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25)) AS BIGINT) AS total_pages FROM jobs_fx)
SELECT total, 25 AS "limit", 175 AS "offset", total_pages, 6 AS prev_page, least(total_pages - 1, 8) AS next_page, true AS has_prev, 8 < total_pages AS has_next FROM t""")
def o3(spark, sf):
    return paging.page_header(jobs(spark, sf), 25, 7)


FOUND = f"""FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id WHERE j.provider IN ('greenhouse', 'github')
 AND EXISTS (SELECT 1 FROM job_skills_fx s WHERE s.job_id = j.id AND lower(s.skill) IN ('python', 'sql', 'aws')) AND {ENTRY_TERMS} AND {ENTRY_KEEP}"""
SEARCH = browsing.Search(skills_any="python, sql, aws", entry_only=True, limit=50, offset=50)


@query("p2_browse", f"""
SELECT j.id, c.slug AS company, c.name AS company_name, j.title, j.level, j.is_remote, j.posted_at, j.url {FOUND}
ORDER BY j.posted_at DESC NULLS LAST, j.id DESC LIMIT 50 OFFSET 50""")
def p2(spark, sf):
    return browsing.browse(jobs(spark, sf), companies(spark, sf), skills(spark, sf), SEARCH, AS_OF).items


@query("p2_browse_total", f"SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages {FOUND}")
def p2_total(spark, sf):
    header = browsing.browse(jobs(spark, sf), companies(spark, sf), skills(spark, sf), SEARCH, AS_OF).header
    return header.select("total", "total_pages")


@query("p2_browse_filters", f"""
SELECT j.id FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id WHERE j.provider IN ('greenhouse', 'github', 'ashby', 'workday', 'lever')
 AND j.is_remote AND j.level = 'mid' AND j.posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY AND (j.title ILIKE '%engineer%' OR c.name ILIKE '%engineer%')""")
def p2_filters(spark, sf):
    search = browsing.Search(level="mid", us_remote_only=True, days=900, q="engineer", experimental=True)
    return browsing.matching_jobs(jobs(spark, sf), companies(spark, sf), skills(spark, sf), search, AS_OF).select("id")


@query("p5_company_listing", """
SELECT c.name AS company, c.slug, count(j.id) AS jobs FROM companies_fx c JOIN jobs_fx j ON j.company_id = c.id GROUP BY c.id, c.name, c.slug""")
def p5(spark, sf):
    return aggregates.jobs_per_company(jobs(spark, sf), companies(spark, sf))


# ---- scan run and exports --------------------------------------------------------------

LANDED_PROFILE = scan.with_preset(scan.Profile(recent_days=4000, providers="all"), "apply-now")
NO_US = scan.Profile(junior_only=True, relax=True, min_score=1)
SCAN = f"""
WITH t AS (SELECT seq FROM postings_fx WHERE posted_at IS NULL AND url <> ''),
e AS (SELECT p.* REPLACE (CASE WHEN p.posted_at IS NULL AND t.seq IS NOT NULL THEN CASE WHEN contains(description_snippet, 'Posted 2001-07-04') THEN TIMESTAMP '2001-07-04 00:00:00'
  WHEN contains(description_snippet, '12 days ago') THEN TIMESTAMP '{AS_OF}' - INTERVAL 12 DAY END ELSE p.posted_at END AS posted_at) FROM postings_fx p LEFT JOIN t ON t.seq = p.seq),
k AS (SELECT *, {SOFT_SCORE} AS skill_score FROM e WHERE {BASIC_JUNIOR}),
r AS (SELECT *, row_number() OVER (ORDER BY skill_score DESC, seq) AS rank FROM k WHERE skill_score >= 1),
b AS (SELECT url, max(skill_score) AS skill_score, min(rank) AS rank FROM r GROUP BY url),
u AS (SELECT min(rank) AS position, arg_max(seq, rank) AS seq, arg_max(title, rank) AS title, arg_max(company, rank) AS company, arg_max(url, rank) AS url,
 arg_max(source, rank) AS source, max(struct_pack(rank := rank, at := posted_at)).at AS posted_at FROM r GROUP BY lower(title), lower(company), lower(url))
SELECT u.position, u.seq, u.title, u.company, u.url, u.source AS provider, b.skill_score, b.rank, f.company_priority, f.company_token, u.posted_at,
 CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(u.posted_at)) / 86400000000.0) AS BIGINT) AS posted_days_ago
FROM u JOIN b ON b.url = u.url LEFT JOIN ({DIRECTORY_FACTS}) f ON f.company_key = lower(trim(u.company))"""
SCAN_COLUMNS = ["position", "seq", "title", "company", "url", "provider", "rank", "company_priority", "company_token",
                "posted_at", "posted_days_ago"]


@query("p1_scan_run", SCAN)
def p1(spark, sf):
    result = scan.scan(postings(spark, sf), view(spark, sf, "directory_fx"), None, NO_US, AS_OF)
    return result.unique.select(*SCAN_COLUMNS, F.col("skill_score").cast("long").alias("skill_score"))


LANDED_DAY = "2025-09-20 00:00:00"
# Boards of the directory by provider, and what their payloads hold that the filters let through.
LANDED_SCAN = f"""
WITH d AS (SELECT ordinal, lower(ats) AS provider, company, token FROM directory_fx WHERE token <> ''),
g AS (SELECT 'greenhouse' AS provider, 'https://boards.example.com/g/' || payload_id AS url, 'Software Engineer I' AS title, company_id, TIMESTAMP '2025-09-15 10:00:00' AS posted_at FROM gh_payload_fx
UNION ALL SELECT 'lever', 'https://boards.example.com/l/' || payload_id, 'Associate Software Engineer', company_id, make_timestamp((1700000000000 + payload_id) * 1000) FROM lever_payload_fx
UNION ALL SELECT 'workday', 'https://tok' || company_id || '/en-US/careers/job/R' || payload_id, 'Engineer II', company_id, TIMESTAMP '2025-09-15 14:00:00' FROM workday_payload_fx
UNION ALL SELECT 'ashby', 'https://boards.example.com/a/' || payload_id, 'New Grad Engineer', company_id, TIMESTAMP '2025-09-15 10:00:00' FROM ashby_payload_fx),
w AS (SELECT 'workable' AS provider, 'https://apply.workable.com/' || token || '/' || token || '/j/A1/' AS url, 'Junior Developer' AS title, token, CAST(NULL AS TIMESTAMP) AS posted_at FROM workable_page_fx),
l AS (SELECT provider, url, title, concat('tok', CAST(company_id AS VARCHAR)) AS token, posted_at FROM g UNION ALL SELECT * FROM w
UNION ALL SELECT 'ashby', 'https://jobs.ashbyhq.com/tok' || (page_id % 50) || '/1/', 'Engineer I', 'tok' || (page_id % 50), TIMESTAMP '2025-09-15 00:00:00' FROM ashby_answer_fx
 WHERE page_id % 50 NOT IN (SELECT company_id FROM ashby_payload_fx))
SELECT DISTINCT l.title, d.company, l.url, l.provider, CAST(floor((epoch_us(TIMESTAMP '{LANDED_DAY}') - epoch_us(l.posted_at)) / 86400000000.0) AS BIGINT) AS posted_days_ago
FROM l JOIN d ON d.provider = l.provider AND d.token = l.token"""


def landed_by_provider(spark, sf):
    found = all_landed(spark, sf)
    workable = found.pop("workable")
    parts = [rows.select("payload_id", F.lit(name).alias("provider"), "token", "body") for name, rows in found.items()]
    payloads = reduce(DataFrame.unionByName, parts)
    answers = view(spark, sf, "ashby_answer_fx").select("page_id", "token", "body")
    shape = ["page_id", "provider", "token", "url", "html"]
    pages = [rows.withColumn("provider", F.lit(name)).select(shape) for name, rows in (
        ("workable", workable), ("ashby", view(spark, sf, "ashby_page_fx")))]
    return scan.Landed(payloads, answers, reduce(DataFrame.unionByName, pages))


def listed_directory(spark, sf):
    """The directory; workday boards go by their host, which is the token here."""
    listed = view(spark, sf, "board_directory_fx")
    return listed.withColumn("host", F.when(F.col("provider") == "workday", F.col("token")))


@query("p1_scan_landed", LANDED_SCAN)
def p1_landed(spark, sf):
    """The run over the directory's boards, from landed payloads and pages, with budgets, top-ups and page dates."""
    result = scan.scan_directory(landed_by_provider(spark, sf), listed_directory(spark, sf), view(spark, sf, "board_page_fx"),
                                 LANDED_PROFILE, LANDED_DAY)
    return result.unique.select("title", "company", "url", "provider", "posted_days_ago")


@query("p1_skipped_entries", """
SELECT ordinal, company FROM directory_fx WHERE ats IS NULL OR lower(ats) NOT IN ('greenhouse', 'lever', 'workday', 'ashby', 'workable')""")
def p1_skipped(spark, sf):
    result = scan.scan_directory(landed_by_provider(spark, sf), listed_directory(spark, sf), view(spark, sf, "board_page_fx"),
                                 LANDED_PROFILE, LANDED_DAY)
    return result.skipped.select("ordinal", "company")


@query("a6_scan_summary", f"""
WITH s AS ({LANDED_SCAN.strip()}) SELECT 'summary' AS stage, 'unique' AS metric, count(*) AS n FROM s""")
def a6_summary(spark, sf):
    result = scan.scan_directory(landed_by_provider(spark, sf), listed_directory(spark, sf), view(spark, sf, "board_page_fx"),
                                 LANDED_PROFILE, LANDED_DAY)
    return result.diagnostics.filter("metric = 'unique'").select("stage", "metric", "n")


@query("p1_saved_records", f"""
SELECT seq, title, company, url, provider, CASE WHEN contains(lower(url), '/p/') THEN regexp_extract(url, '([^/]*)$', 1) END AS external_id FROM ({SCAN})""")
def p1_saved(spark, sf):
    result = scan.scan(postings(spark, sf), view(spark, sf, "directory_fx"), None, NO_US, AS_OF)
    records, _ = scan.to_upsert_records(result.unique, NO_US)
    seen = result.unique.select(F.col("position").alias("p"), F.col("seq").alias("s"))
    return records.join(seen, records["seq"] == seen["p"]).select(
        F.col("s").alias("seq"), "title", "company", "url", "provider", "external_id")


@query("e3_profile_preset", f"""
SELECT seq FROM (SELECT *, {SOFT_SCORE} AS skill_score FROM postings_fx WHERE posted_at IS NULL OR posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)
WHERE trim(title) <> ''""")
def e3(spark, sf):
    profile = scan.with_preset(scan.Profile(), "research")
    return scan.keep_and_score(postings(spark, sf), profile, AS_OF).select("seq")


@query("w1_raw_json", "SELECT seq, title, company, url, source, location, posted_at, description_snippet FROM postings_fx")
def w1(spark, sf):
    folder, rows = scratch(spark, "w1"), postings(spark, sf)
    sinks.write_json(rows, folder)
    return spark.read.schema(rows.schema).json(folder).drop("level")


@query("w2_enriched_json", f"""
SELECT p.seq, p.source AS provider, f.company_priority, f.company_token,
 CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(p.posted_at)) / 86400000000.0) AS BIGINT) AS posted_days_ago
FROM postings_fx p LEFT JOIN ({DIRECTORY_FACTS}) f ON f.company_key = lower(trim(p.company))""")
def w2(spark, sf):
    rows = scan.export_rows(postings(spark, sf), view(spark, sf, "directory_fx"), AS_OF).select(
        "seq", "provider", "company_priority", "company_token", "posted_days_ago")
    folder = scratch(spark, "w2")
    sinks.write_json(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query("w3_csv_projection", """
SELECT CAST(seq AS VARCHAR) AS seq, '' AS missing, coalesce(location, '') AS location, coalesce(strftime(posted_at, '%Y-%m-%dT%H:%M:%S'), '') AS posted_at, title FROM postings_fx""")
def w3(spark, sf):
    return sinks.csv_projection(postings(spark, sf), "seq, missing, location,posted_at,title")

