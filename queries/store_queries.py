"""Upserts, maintenance, curated ingest and streaming."""

from pyspark.sql import functions as F

from queries.base import AS_OF, CURATED_AS_OF, incoming, query, table, view
from queries.report_queries import METRICS, scratch
from queries.scalars import SLUG
from queries.source_queries import lists
from vacantia.operators import aggregates, filters, joins, maintenance, upsert
from vacantia.plans import browse
from vacantia.plans import curated as curated_plan
from vacantia.plans import upkeep
from vacantia.sources import boards
from vacantia.sources.tables import TableStore
from vacantia.streaming import dedupe, ingest

BATCH = f"""b AS (SELECT *, {SLUG.format('company')} AS slug, title IS NOT NULL AS complete FROM incoming_fx WHERE external_id IS NOT NULL),
k AS (SELECT provider, external_id, min(seq) FILTER (WHERE complete OR legacy_external_id IS NOT NULL) AS first_seq, min(seq) FILTER (WHERE complete) AS first_complete,
 arg_min_null(legacy_external_id, seq) FILTER (WHERE complete OR legacy_external_id IS NOT NULL) AS legacy FROM b GROUP BY provider, external_id),
x AS (SELECT k.*, j.id AS exact_id FROM k LEFT JOIN jobs_fx j ON j.provider = k.provider AND j.external_id = k.external_id),
w AS (SELECT j.id AS claimed_id, x.provider, x.external_id, x.first_seq AS claimed_at, row_number() OVER (PARTITION BY j.id ORDER BY x.first_seq) AS place
 FROM x JOIN jobs_fx j ON j.provider = x.provider AND j.external_id = x.legacy WHERE x.exact_id IS NULL),
r AS (SELECT b.*, CASE WHEN x.exact_id IS NOT NULL AND NOT coalesce(b.seq > t.claimed_at, false) THEN x.exact_id WHEN b.seq >= x.first_seq THEN w.claimed_id END AS state_id, x.first_complete
 FROM b JOIN x ON x.provider = b.provider AND x.external_id = b.external_id
 LEFT JOIN w ON w.place = 1 AND w.provider = b.provider AND w.external_id = b.external_id LEFT JOIN w t ON t.place = 1 AND t.claimed_id = x.exact_id),
a AS (SELECT * FROM r WHERE state_id IS NOT NULL OR seq >= first_complete),
cs AS (SELECT slug, company, min(a.seq) AS seq FROM a GROUP BY slug, company),
cm AS (SELECT cs.*, coalesce((SELECT min(id) FROM companies_fx c WHERE c.slug = cs.slug), (SELECT min(id) FROM companies_fx c WHERE c.name = cs.company)) AS company_id FROM cs),
cn AS (SELECT slug, company, (SELECT max(id) FROM companies_fx) + row_number() OVER (ORDER BY seq) AS new_id FROM cm WHERE company_id IS NULL),
m AS (SELECT cm.slug, cm.company, coalesce(cm.company_id, cn.new_id) AS company_id FROM cm LEFT JOIN cn ON cn.slug = cm.slug),
f AS (SELECT state_id, min(a.seq) AS first_seq, arg_max(provider, a.seq) AS provider, arg_max(external_id, a.seq) AS external_id, arg_max(url, a.seq) AS url,
 arg_max(title, a.seq) FILTER (WHERE title IS NOT NULL) AS title, arg_min(posted_at, a.seq) FILTER (WHERE posted_at IS NOT NULL) AS posted_at,
 arg_max(m.company_id, a.seq) AS company_id FROM a JOIN m ON m.slug = a.slug AND m.company = a.company
 GROUP BY state_id, CASE WHEN state_id IS NULL THEN provider END, CASE WHEN state_id IS NULL THEN external_id END)"""
UPSERTED = f"""WITH {BATCH}
SELECT j.id, coalesce(f.provider, j.provider) AS provider, coalesce(f.external_id, j.external_id) AS external_id, coalesce(f.url, j.url) AS url,
 coalesce(f.company_id, j.company_id) AS company_id, coalesce(f.title, j.title) AS title, coalesce(j.posted_at, f.posted_at) AS posted_at, j.level,
 CASE WHEN f.state_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE j.updated_at END AS updated_at, j.active
FROM jobs_fx j LEFT JOIN f ON f.state_id = j.id
UNION ALL SELECT (SELECT max(id) FROM jobs_fx) + row_number() OVER (ORDER BY first_seq), provider, external_id, url, company_id, title, posted_at, 'unknown',
 TIMESTAMP '{AS_OF}', true FROM f WHERE state_id IS NULL"""
JOB_COLUMNS = ["id", "provider", "external_id", "url", "company_id", "title", "posted_at", "level", "updated_at", "active"]


def skills(spark, sf):
    return view(spark, sf, "job_skills_fx").withColumn("score", F.lit(1))


def upserted(spark, sf, batch=None):
    rows = incoming(spark, sf) if batch is None else batch
    return upsert.upsert(view(spark, sf, "jobs_fx"), view(spark, sf, "companies_fx"), skills(spark, sf), rows, AS_OF)


@query("u1_upsert_jobs", UPSERTED)
def u1(spark, sf):
    return upserted(spark, sf).jobs.select(*JOB_COLUMNS)


@query("w4_stored_upsert", UPSERTED)
def w4(spark, sf):
    """The same through the table store: two published versions, then a read."""
    store = TableStore(spark, scratch(spark, "w4"))
    store.write({"jobs": upsert.conform(view(spark, sf, "jobs_fx"), upsert.JOBS),
                 "companies": upsert.conform(view(spark, sf, "companies_fx"), upsert.COMPANIES),
                 "job_skills": upsert.conform(skills(spark, sf), upsert.JOB_SKILLS)}, AS_OF)
    upkeep.upsert_batch(store, incoming(spark, sf), AS_OF, batch_id=1)
    return store.read("jobs").select(*JOB_COLUMNS)


def ingested(spark, sf):
    """A store that took the whole batch after the stored jobs."""
    store = TableStore(spark, scratch(spark, "ingested"))
    store.write({"jobs": upsert.conform(view(spark, sf, "jobs_fx"), upsert.JOBS),
                 "companies": upsert.conform(view(spark, sf, "companies_fx"), upsert.COMPANIES)}, AS_OF)
    upkeep.upsert_batch(store, incoming(spark, sf), AS_OF, batch_id=1)
    return store


@query("a6_last_ingest", f"SELECT TIMESTAMP '{AS_OF}' AS last_ingest_at")
def a6_last(spark, sf):
    return aggregates.last_ingest(ingested(spark, sf).read("crawl_runs"))


@query("a6_run_log", f"""
WITH {BATCH}, t AS (SELECT provider, count(*) FILTER (WHERE external_id IS NULL) AS lost FROM incoming_fx GROUP BY provider),
v AS (SELECT provider, count(*) FILTER (WHERE state_id IS NOT NULL OR seq >= first_complete) AS found,
 count(*) FILTER (WHERE state_id IS NULL AND NOT coalesce(seq >= first_complete, false)) AS bad FROM r GROUP BY provider)
SELECT t.provider, CAST(v.found AS INTEGER) AS jobs_discovered, CAST(v.bad + t.lost AS INTEGER) AS errors, TIMESTAMP '{AS_OF}' AS finished_at
FROM t JOIN v ON v.provider = t.provider""")
def a6_run_log(spark, sf):
    return ingested(spark, sf).read("crawl_runs").select("provider", "jobs_discovered", "errors", "finished_at")


@query("p4_metrics_report", f"""
WITH {BATCH}, z AS (SELECT coalesce(f.title, j.title) AS title, j.description, coalesce(j.posted_at, f.posted_at) AS posted_at
 FROM jobs_fx j LEFT JOIN f ON f.state_id = j.id UNION ALL SELECT title, NULL, posted_at FROM f WHERE state_id IS NULL),
q AS ({METRICS.replace("jobs_fx", "z")}) SELECT q.*, TIMESTAMP '{AS_OF}' AS last_ingest_at FROM q""")
def p4(spark, sf):
    """The report of the stored counts and the run log; no job is read."""
    store = ingested(spark, sf)
    return aggregates.maintained_metrics(store.read("metrics")).drop("by_provider").withColumn(
        "percent_undated", F.round("percent_undated", 6)).withColumn("last_ingest_at", aggregates.last_ingest(store.read("crawl_runs")).scalar())


@query("u1_rejects", f"""
WITH {BATCH} SELECT seq, 'missing-external-id' AS reason FROM incoming_fx WHERE external_id IS NULL
UNION ALL SELECT seq, 'incomplete' FROM r WHERE state_id IS NULL AND NOT coalesce(seq >= first_complete, false)""")
def u1_rejects(spark, sf):
    return upserted(spark, sf).rejects.select("seq", "reason")


@query("j9_legacy_match", f"""
WITH {BATCH} SELECT claimed_id AS state_id, provider, external_id FROM w WHERE place = 1""")
def j9(spark, sf):
    jobs = upsert.conform(view(spark, sf, "jobs_fx"), upsert.JOBS)
    rows = upsert.resolve(upsert.prepared(incoming(spark, sf)), jobs).filter("state_id IS NOT NULL")
    held = jobs.select(F.col("id").alias("state_id"), F.col("external_id").alias("held"))
    return rows.join(held, "state_id").filter("held <> external_id").select(
        "state_id", "provider", "external_id").distinct()


@query("j10_company_resolution", f"WITH {BATCH} SELECT slug, company, company_id FROM m")
def j10(spark, sf):
    jobs = upsert.conform(view(spark, sf, "jobs_fx"), upsert.JOBS)
    accepted = upsert.resolve(upsert.prepared(incoming(spark, sf)), jobs).filter("reason IS NULL")
    companies = upsert.conform(view(spark, sf, "companies_fx"), upsert.COMPANIES)
    mapping, _ = upsert.resolve_companies(accepted.select("slug", "company", "seq"), companies)
    return mapping.select("slug", "company", upsert.company_id(F.col("seq")).alias("company_id"))


@query("u2_created_companies", f"""
WITH {BATCH} SELECT id, name, slug FROM companies_fx UNION ALL SELECT new_id, company, slug FROM cn""")
def u2(spark, sf):
    return upserted(spark, sf).companies.select("id", "name", "slug")


TOUCHED = """t AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'python, go, ,python' ELSE '' END AS given FROM orders)"""


@query("u3_replace_skills", f"""
WITH {TOUCHED} SELECT s.job_id, s.skill FROM job_skills_fx s JOIN t ON t.job_id = s.job_id WHERE t.given IS NULL
UNION ALL SELECT job_id, unnest(['python', 'go']) FROM t WHERE given = 'python, go, ,python'
UNION ALL SELECT s.job_id, s.skill FROM job_skills_fx s WHERE s.job_id NOT IN (SELECT job_id FROM t)""")
def u3(spark, sf):
    given = F.expr("CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'python, go, ,python' ELSE '' END")
    touched = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.split(given, ",").alias("skills"))
    return upsert.replace_skills(skills(spark, sf), touched).select("job_id", "skill")


STALE = f"active AND coalesce(posted_at, updated_at) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"


@query("u4_prune", f"SELECT id FROM jobs_fx WHERE NOT ({STALE})")
def u4(spark, sf):
    return maintenance.prune(view(spark, sf, "jobs_fx"), 30, AS_OF).select("id")


@query("u4_prune_summary", f"""
SELECT TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS cutoff_utc, count(*) AS matched, 0 AS deleted, 'github' AS provider, true AS dry_run
FROM jobs_fx WHERE {STALE} AND provider = 'github'""")
def u4_summary(spark, sf):
    return maintenance.prune_summary(view(spark, sf, "jobs_fx"), 30, AS_OF, provider="github", dry_run=True)


@query("u5_delete_job", """
WITH g AS (SELECT max(id) AS id FROM jobs_fx) SELECT 'jobs' AS tab, count(*) AS n, sum(id)::BIGINT AS total FROM jobs_fx WHERE id <> (SELECT id FROM g)
UNION ALL SELECT 'skills', count(*), sum(job_id)::BIGINT FROM job_skills_fx WHERE job_id <> (SELECT id FROM g)""")
def u5(spark, sf):
    jobs = view(spark, sf, "jobs_fx")
    gone = jobs.agg(F.max("id").alias("id"))
    kept, kept_skills = maintenance.delete_jobs(jobs, skills(spark, sf), gone)

    def summary(df, name, column):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(column).alias("total")).select(
            F.lit(name).alias("tab"), "n", "total")
    return summary(kept, "jobs", "id").unionByName(summary(kept_skills, "skills", "job_id"))


@query("u6_insert_only", f"""
WITH b AS (SELECT * FROM incoming_fx WHERE title IS NOT NULL),
n AS (SELECT b.*, row_number() OVER (PARTITION BY provider, external_id ORDER BY seq) AS place FROM b WHERE external_id IS NOT NULL),
p AS (SELECT * EXCLUDE (place) FROM n WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM jobs_fx j WHERE j.provider = n.provider AND j.external_id = n.external_id)
 UNION ALL SELECT * FROM b WHERE external_id IS NULL)
SELECT (SELECT max(id) FROM jobs_fx) + row_number() OVER (ORDER BY seq) AS id, provider, external_id, title, url, posted_at FROM p""")
def u6(spark, sf):
    result = upsert.insert_only(view(spark, sf, "jobs_fx"), view(spark, sf, "companies_fx"), incoming(spark, sf), AS_OF)
    return result.jobs.select("id", "provider", "external_id", "title", "url", "posted_at")


# Jobs, companies and skills with some rows that break each rule.
BROKEN_JOBS = """SELECT CASE WHEN id % 101 = 0 THEN 'nobody' WHEN id % 103 = 0 THEN NULL ELSE provider END AS provider, CAST(id % 1000 AS VARCHAR(20)) AS external_id,
 CASE WHEN id % 107 = 0 THEN NULL ELSE url END AS url, CASE WHEN id % 109 = 0 THEN NULL ELSE company_id END AS company_id,
 CASE WHEN id % 113 = 0 THEN NULL ELSE title END AS title, CASE WHEN id % 127 = 0 THEN NULL ELSE is_remote END AS is_remote,
 CASE WHEN id % 131 = 0 THEN 'boss' WHEN id % 137 = 0 THEN NULL ELSE level END AS level, CASE WHEN id % 139 = 0 THEN NULL ELSE active END AS active FROM jobs_fx"""
BROKEN_COMPANIES = "SELECT id, CASE WHEN id % 7 = 0 THEN 'same-slug' WHEN id % 11 = 0 THEN 'other-slug' ELSE slug END AS slug FROM companies_fx"
BROKEN_SKILLS = "SELECT job_id, skill FROM job_skills_fx UNION ALL SELECT job_id, skill FROM job_skills_fx WHERE job_id % 5 = 0"


@query("u7_integrity", f"""
WITH j AS ({BROKEN_JOBS}), c AS ({BROKEN_COMPANIES}), s AS ({BROKEN_SKILLS})
SELECT 'job-key-repeated' AS rule, count(*) AS violations FROM (SELECT 1 FROM j WHERE provider IS NOT NULL GROUP BY provider, external_id HAVING count(*) > 1)
UNION ALL SELECT 'company-slug-repeated', count(*) FROM (SELECT 1 FROM c GROUP BY slug HAVING count(*) > 1)
UNION ALL SELECT 'job-skill-repeated', count(*) FROM (SELECT 1 FROM s GROUP BY job_id, skill HAVING count(*) > 1)
UNION ALL SELECT 'provider-unknown', count(*) FROM j WHERE provider = 'nobody' UNION ALL SELECT 'level-unknown', count(*) FROM j WHERE level = 'boss'
UNION ALL SELECT 'provider-missing', count(*) FROM j WHERE provider IS NULL UNION ALL SELECT 'url-missing', count(*) FROM j WHERE url IS NULL
UNION ALL SELECT 'company_id-missing', count(*) FROM j WHERE company_id IS NULL UNION ALL SELECT 'title-missing', count(*) FROM j WHERE title IS NULL
UNION ALL SELECT 'is_remote-missing', count(*) FROM j WHERE is_remote IS NULL UNION ALL SELECT 'level-missing', count(*) FROM j WHERE level IS NULL
UNION ALL SELECT 'active-missing', count(*) FROM j WHERE active IS NULL""")
def u7(spark, sf):
    for name in ("jobs_fx", "companies_fx", "job_skills_fx"):
        view(spark, sf, name).createOrReplaceTempView(name)
    return maintenance.integrity_report(*[spark.sql(text) for text in (BROKEN_JOBS, BROKEN_COMPANIES, BROKEN_SKILLS)])


CURATED = """
WITH m AS (SELECT min(doc_id) AS source_idx, doc_id % 3 AS kind, doc_id % 90 AS n FROM md_doc_fx WHERE doc_id % 3 <> 1 GROUP BY 2, 3),
u AS (SELECT *, 'https://boards.example.com/' || CASE kind WHEN 0 THEN 't/' ELSE 'h/' END || n AS url, CASE kind WHEN 0 THEN 'acme' ELSE 'delta' END AS slug FROM m)
SELECT row_number() OVER (ORDER BY source_idx) AS seq, 'github' AS provider, substr(sha1(url), 1, 16) AS external_id,
 substr(sha1('https://' || slug || '.example.com'), 1, 16) AS legacy_external_id, CASE kind WHEN 0 THEN 'Acme' ELSE 'Delta' END AS company, slug AS company_slug,
 CASE kind WHEN 0 THEN 'New Grad SWE' ELSE 'Software Engineer' END AS title, url, CASE kind WHEN 0 THEN 'Remote - US' ELSE 'Remote (US)' END AS location,
 true AS is_remote, CASE kind WHEN 0 THEN 'junior' ELSE 'unknown' END AS level,
 CASE kind WHEN 0 THEN TIMESTAMP '2025-09-17 00:00:00' ELSE TIMESTAMP '2025-09-04 00:00:00' END AS posted_at, 'scraped' AS date_origin FROM u"""
CURATED_COLUMNS = ["seq", "provider", "external_id", "legacy_external_id", "company", "company_slug", "title", "url",
                   "location", "is_remote", "level", "posted_at", "date_origin"]


@query("p3_curated_batch", CURATED)
def p3(spark, sf):
    return curated_plan.curated_batch(lists(spark, sf), CURATED_AS_OF, scrape=True).select(*CURATED_COLUMNS)


# Every other link of the lists has a date in the history.
LIST_HISTORY = """SELECT DISTINCT substr(sha1(concat('https://boards.example.com/', CASE doc_id % 3 WHEN 0 THEN 't/' ELSE 'h/' END, CAST(doc_id % 90 AS VARCHAR(20)))), 1, 16) AS external_id,
 CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2025-08-01 00:00:00' END AS merged_at, TIMESTAMP '2025-08-02 00:00:00' AS added_at, CAST(NULL AS TIMESTAMP) AS touched_at
 FROM md_doc_fx WHERE doc_id % 3 <> 1 AND doc_id % 90 % 2 = 0"""


@query("p3_curated_fallback", f"""
WITH c AS ({CURATED.strip()}), h AS (SELECT external_id, coalesce(min(merged_at), min(added_at)) AS at FROM ({LIST_HISTORY}) GROUP BY external_id)
SELECT c.* REPLACE (coalesce(h.at, TIMESTAMP '2025-09-18 00:00:00') AS posted_at, CASE WHEN h.at IS NULL THEN 'fallback' ELSE 'inferred' END AS date_origin)
FROM c LEFT JOIN h ON h.external_id = c.external_id""")
def p3_fallback(spark, sf):
    view(spark, sf, "md_doc_fx").createOrReplaceTempView("md_doc_fx")
    return curated_plan.curated_batch(lists(spark, sf), CURATED_AS_OF, history=spark.sql(LIST_HISTORY)).select(*CURATED_COLUMNS)


@query("p3_curated_ingest", f"""
WITH c AS ({CURATED.strip()}) SELECT external_id, title, url, level, posted_at, company_slug AS slug FROM c
UNION ALL SELECT j.external_id, j.title, j.url, j.level, j.posted_at, co.slug FROM jobs_fx j JOIN companies_fx co ON co.id = j.company_id""")
def p3_ingest(spark, sf):
    result = curated_plan.ingest(lists(spark, sf), view(spark, sf, "jobs_fx"), view(spark, sf, "companies_fx"),
                                 skills(spark, sf), CURATED_AS_OF, scrape=True)
    slugs = result.companies.select(F.col("id").alias("company_id"), "slug")
    return result.jobs.join(slugs, "company_id").select("external_id", "title", "url", "level", "posted_at", "slug")


# A third of the jobs link to the aggregator, some of them beside a direct twin.
LISTED_URL = "CASE WHEN id % 3 = 0 THEN concat('https://simplify.jobs/p/', CAST(id AS VARCHAR(20))) ELSE url END"


@query("p6_upkeep", f"""
WITH l AS (SELECT * REPLACE ({LISTED_URL} AS url) FROM jobs_fx),
d AS (SELECT external_id, arg_max(posted_at, seq) AS scraped_at FROM scraped_dates_fx WHERE posted_at IS NOT NULL GROUP BY external_id),
f AS (SELECT l.* REPLACE (CASE WHEN l.provider = 'github' AND l.posted_at IS NULL THEN d.scraped_at ELSE l.posted_at END AS posted_at)
 FROM l LEFT JOIN d ON d.external_id = l.external_id),
c AS (SELECT * FROM f WHERE NOT (provider = 'github' AND url LIKE 'https://simplify.jobs/%' AND EXISTS (SELECT 1 FROM f t
 WHERE t.provider = 'github' AND t.url NOT LIKE 'https://simplify.jobs/%' AND t.company_id = f.company_id AND t.title = f.title)))
SELECT id, posted_at FROM c WHERE NOT (active AND coalesce(posted_at, updated_at) < TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY)""")
def p6(spark, sf):
    """Backfill, duplicate cleanup, pruning and compaction, each a version of the store."""
    store = TableStore(spark, scratch(spark, "p6"))
    jobs = view(spark, sf, "jobs_fx").withColumn("url", F.expr(LISTED_URL))
    store.write({"jobs": upsert.conform(jobs, upsert.JOBS),
                 "job_skills": upsert.conform(skills(spark, sf), upsert.JOB_SKILLS)}, AS_OF)
    upkeep.backfill(store, view(spark, sf, "scraped_dates_fx"), AS_OF)
    upkeep.cleanup(store, AS_OF)
    upkeep.prune(store, AS_OF, days=900)
    store.compact(AS_OF)
    return store.read("jobs").select("id", "posted_at")


@query("st1_incremental_ingest", """
SELECT 'greenhouse' AS provider, CAST(payload_id AS VARCHAR) AS external_id, 'https://boards.example.com/h/' || payload_id AS url, 'Staff Engineer' AS title,
 'Austin, United States' AS location, 'unknown' AS level, TIMESTAMP '2025-09-15 10:00:00' AS posted_at FROM gh_payload_fx""")
def st1(spark, sf):
    """Payload files stream in micro-batches into the store; the store's jobs come out."""
    landed = view(spark, sf, "gh_landed_fx").withColumn("host", F.lit(None).cast("string")).withColumn(
        "path", F.lit(None).cast("string"))
    folder = scratch(spark, "st1")
    landed.repartition(2, "payload_id").write.parquet(f"{folder}/landed")
    store = TableStore(spark, f"{folder}/store")
    run = ingest.ingest_stream(ingest.landed_stream(spark, f"{folder}/landed", 1), boards.greenhouse,
                               ingest.board_records, store, f"{folder}/checkpoint", AS_OF)
    run.awaitTermination()
    return store.read("jobs").select("provider", "external_id", "url", "title", "location", "level", "posted_at")


@query("st2_first_sightings", "SELECT DISTINCT user_id, event_type FROM events")
def st2(spark, sf):
    """Events arrive in files, one a micro-batch, so sightings are known from the batches before."""
    events, folder = table(spark, sf, "events"), scratch(spark, "st2")
    events.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = (
        dedupe.first_sightings(stream, ["user_id", "event_type"], "ts", "36500 days").select("user_id", "event_type")
        .writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{folder}/out")


def filled_store(spark, sf, name):
    store = TableStore(spark, scratch(spark, name))
    store.write({"jobs": upsert.conform(view(spark, sf, "jobs_fx"), upsert.JOBS),
                 "companies": upsert.conform(view(spark, sf, "companies_fx"), upsert.COMPANIES),
                 "job_skills": upsert.conform(skills(spark, sf), upsert.JOB_SKILLS)}, AS_OF)
    return store.snapshot()


@query("f7_stored_search", """
SELECT j.id FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id WHERE j.title ILIKE '%front_nd dev%' OR c.name ILIKE '%front_nd dev%'""")
def f7_stored(spark, sf):
    snapshot = filled_store(spark, sf, "f7")
    found = joins.jobs_with_companies(snapshot.mentioning("FRONT_nd dev"), snapshot.read("companies"))
    return found.filter(filters.keyword("FRONT_nd dev")).select("id")


@query("f4_stored_recent", f"SELECT id FROM jobs_fx WHERE posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY")
def f4_stored(spark, sf):
    snapshot, since = filled_store(spark, sf, "f4"), F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 900 DAYS")
    first = str(spark.range(1).select(since).first()[0])
    return snapshot.posted_since(first, undated=False).filter(F.col("posted_at") >= since).select("id")


@query("o2_seek_page", """
SELECT j.id, j.title, j.posted_at FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id WHERE j.provider <> 'workable'
ORDER BY j.posted_at DESC NULLS LAST, j.id DESC LIMIT 50 OFFSET 150""")
def o2_seek(spark, sf):
    """The page after the last row of the pages before it."""
    snapshot, after = filled_store(spark, sf, "o2"), None
    search = browse.Search(limit=50, experimental=True)
    for _ in range(3):
        last = browse.seek(snapshot, search, AS_OF, after).orderBy(F.asc_nulls_first("posted_at"), "id").first()
        after = (last.posted_at, last.id)
    return browse.seek(snapshot, search, AS_OF, after).select("id", "title", "posted_at")
