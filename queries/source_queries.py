"""Sources: landed payloads, pages, lists, directories and stored tables."""

from pyspark.sql import functions as F

from queries.base import any_contains, query, table, view
from queries.scalars import SQUEEZE, UTC, WALL
from vacantia.functions import fixed_values as V
from vacantia.functions import text
from vacantia.operators import paging
from vacantia.plans.curated import landed_lists
from vacantia.sources import board_pages, curated, directory, registry

PLACE = "replace(replace(" + SQUEEZE.format("nullif({0}, '')") + ", 'United States of America', 'United States'), 'US-Remote', 'Remote - US')"
LEVEL = (f"CASE WHEN {any_contains('lower({0})', V.LEVEL_JUNIOR_TITLE)} THEN 'junior' "
         f"WHEN {any_contains('lower({0})', V.LEVEL_SENIOR_TITLE)} THEN 'senior' "
         f"WHEN {any_contains('lower({0})', V.LEVEL_MID_TITLE)} THEN 'mid' END")
SHAPE = ["seq", "token", "title", "company", "url", "source", "location", "posted_at", "level"]


def landed(spark, sf, name):
    """Payloads with their board: token and company by company id."""
    names = view(spark, sf, "companies_fx").select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    token = F.concat(F.lit("tok"), F.col("company_id").cast("string"))
    return view(spark, sf, name).join(names, "company_id").select(
        "payload_id", token.alias("token"), "company", token.alias("host"), F.lit("External").alias("path"), "body")


def board_sql(fx, source, path, count, url, title, location, posted):
    """Postings of a payload view; ``item`` is the JSON of one posting."""
    return f"""
WITH d AS (SELECT payload_id, company_id, unnest(range(0, {count})) AS pos, body FROM {fx}),
i AS (SELECT d.*, c.name AS company, json_extract(body, {path}) AS item FROM d JOIN companies_fx c ON c.id = d.company_id),
v AS (SELECT payload_id, company_id, pos, company, {url} AS url,
 {SQUEEZE.format(f"coalesce({js(*title)}, '')")} AS title, {js(*location)} AS place, {posted} AS posted_at FROM i WHERE item IS NOT NULL)
SELECT payload_id * 2147483648 + pos AS seq, concat('tok', CAST(company_id AS VARCHAR)) AS token, title, company, url, '{source}' AS source,
 {PLACE.format('place')} AS location, posted_at, {LEVEL.format('title')} AS level FROM v"""


def numbered(postings, *columns):
    """The arrival number as a long, which it fits here."""
    return postings.withColumn("seq", F.col("seq").cast("long")).select(*(columns or SHAPE))


def js(*keys):
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(item, '$.{k}'), '')" for k in keys) + ")"


@query("s1_greenhouse", board_sql(
    "gh_payload_fx", "greenhouse", "'$.jobs[' || pos || ']'", 2, js("absolute_url"), ["title"], ["location.name"],
    WALL.format(js("updated_at", "created_at"))))
def s1(spark, sf):
    return numbered(registry.fetch("greenhouse", landed(spark, sf, "gh_payload_fx")))


@query("s2_lever", board_sql(
    "lever_payload_fx", "lever", "'$[' || pos || ']'", 2, js("hostedUrl", "applyUrl"), ["text"],
    ["categories.location"],
    f"CASE WHEN {js('createdAt')} IS NOT NULL THEN make_timestamp(CAST({js('createdAt')} AS BIGINT) * 1000) "
    f"ELSE {WALL.format(js('updatedAt'))} END"))
def s2(spark, sf):
    return numbered(registry.fetch("lever", landed(spark, sf, "lever_payload_fx")))


@query("s3_workday", board_sql(
    "workday_payload_fx", "workday", "'$.jobPostings[' || pos || ']'", 2,
    "concat('https://tok', CAST(company_id AS VARCHAR), coalesce('/en-US/careers/job/' || json_extract_string(item, '$.bulletFields[0]'), ''))",
    ["title"], ["locationsText"],
    f"CASE WHEN {js('startDate')} IS NOT NULL THEN make_timestamp(CAST({js('startDate')} AS BIGINT) * 1000000) "
    f"ELSE {UTC.format(js('meta.postedDate'))} END"))
def s3(spark, sf):
    return numbered(registry.fetch("workday", landed(spark, sf, "workday_payload_fx")))


@query("s4_ashby", board_sql(
    "ashby_payload_fx", "ashby",
    "CASE payload_id % 3 WHEN 0 THEN '$[' WHEN 1 THEN '$.jobPostings[' ELSE '$.jobs[' END || pos || ']'", 3,
    f"coalesce({js('jobPostingUrl', 'jobUrl')}, 'https://jobs.ashbyhq.com/tok' || company_id || '/job/' || {js('slug')})",
    ["title", "jobTitle"], ["locationText"], WALL.format(js("publishedAt", "posting.updatedAt"))) + " WHERE title <> ''")
def s4(spark, sf):
    return numbered(registry.fetch("ashby", landed(spark, sf, "ashby_payload_fx")))


LINK_SHAPE = ["page_id", "title", "url", "location", "posted_text", "slug"]
BOARD = "'https://jobs.ashbyhq.com/tok' || (page_id % 50)"


@query("s5_ashby_answers", f"""
SELECT page_id, 'Engineer I' AS title, {BOARD} || '/1/' AS url, 'Remote (US)' AS location, '2025-09-15' AS posted_text, '1' AS slug FROM ashby_answer_fx
UNION ALL SELECT page_id, 'Deep Role', 'https://jobs.ashbyhq.com/tok/tok' || (page_id % 50) || '/3', NULL, '2025-09-16', '3' FROM ashby_answer_fx""")
def s5(spark, sf):
    return board_pages.ashby_answers(view(spark, sf, "ashby_answer_fx")).select(*LINK_SHAPE)


@query("s5_ashby_answer_postings", f"""
SELECT page_id * 2147483648 AS seq, 'Engineer I' AS title, {BOARD} || '/1/' AS url, 'Remote (US)' AS location, TIMESTAMP '2025-09-15 00:00:00' AS posted_at FROM ashby_answer_fx
UNION ALL SELECT page_id * 2147483648 + 1, 'Deep Role', 'https://jobs.ashbyhq.com/tok/tok' || (page_id % 50) || '/3', NULL, TIMESTAMP '2025-09-16 00:00:00' FROM ashby_answer_fx""")
def s5_postings(spark, sf):
    return numbered(board_pages.ashby_from_answers(view(spark, sf, "ashby_answer_fx")),
                    "seq", "title", "url", "location", "posted_at")


@query("s6_ashby_links", f"""
SELECT page_id, 'New Grad Engineer' AS title, {BOARD} || '/job/a' || page_id || '?x=1' AS url, 'a' || page_id AS slug FROM ashby_page_fx
UNION ALL SELECT page_id, 'Data Engineer', {BOARD} || '/job/n1', 'n1' FROM ashby_page_fx
UNION ALL SELECT page_id, 'Web Developer', {BOARD} || '/s1', 's1' FROM ashby_page_fx
UNION ALL SELECT page_id, '', {BOARD} || '/job/a' || page_id, 'a' || page_id FROM ashby_page_fx
UNION ALL SELECT page_id, '', {BOARD} || '/job/raw9', 'raw9' FROM ashby_page_fx""")
def s6(spark, sf):
    return board_pages.ashby_links(view(spark, sf, "ashby_page_fx")).select("page_id", "title", "url", "slug")


@query("s6_ashby_fallback", """
WITH t AS (SELECT DISTINCT page_id % 50 AS n FROM pages)
SELECT 'tok' || n AS token, CASE WHEN n < 10 THEN 'json' WHEN n < 25 THEN 'answer' ELSE 'page' END AS kind,
 (SELECT count(*) FROM pages WHERE page_id % 50 = n) * CASE WHEN n < 10 THEN 1 WHEN n < 25 THEN 2 ELSE 3 END AS n_postings FROM t""")
def s6_fallback(spark, sf):
    number = F.col("page_id") % 50
    pages = view(spark, sf, "ashby_page_fx")
    answers = view(spark, sf, "ashby_answer_fx").withColumn("body", F.when(number < 25, F.col("body")).otherwise("{}"))
    listing = F.when(number < 10, '[{"title":"Listed","url":"https://x.example.com/json/1"}]').otherwise("[]")
    payloads = pages.select(F.col("page_id").alias("payload_id"), "token", F.lit("Acme").alias("company"),
                            listing.alias("body"))
    kind = (F.when(F.col("url").contains("/json/"), "json").when(F.col("title").isin("Engineer I", "Deep Role"), "answer")
            .otherwise("page"))
    return board_pages.ashby_with_fallback(payloads, answers, pages).groupBy(
        "token", kind.alias("kind")).agg(F.count("seq").alias("n_postings"))


@query("s7_slug_candidates", """
SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN 'acme.co|acme-co|acmeco|acme' ELSE 'beta' END,
 CASE page_id % 4 WHEN 0 THEN '|Acme-HQ' WHEN 1 THEN '|org-1' WHEN 2 THEN CASE page_id % 3 WHEN 0 THEN '|beta|attr' ELSE '|attr' END ELSE '' END) AS slugs FROM slug_page_fx""")
def s7(spark, sf):
    return view(spark, sf, "slug_page_fx").select(
        "page_id", F.array_join(text.slug_candidates(F.col("token"), F.col("html")), "|").alias("slugs"))


@query("s8_workable", """
SELECT page_id * 2147483648 AS seq, 'tok' || (page_id % 50) AS token, 'Junior Developer' AS title, 'Acme' AS company,
 'https://apply.workable.com/tok' || (page_id % 50) || '/tok' || (page_id % 50) || '/j/A1/' AS url, 'workable' AS source, 'Remote - US' AS location,
 CAST(NULL AS TIMESTAMP) AS posted_at, 'junior' AS level FROM workable_page_fx
UNION ALL SELECT page_id * 2147483648 + 1, 'tok' || (page_id % 50), 'Data Engineer', 'Acme', 'https://h.example.com/jobs/' || page_id, 'workable', 'Remote OK', NULL, NULL FROM workable_page_fx""")
def s8(spark, sf):
    return numbered(registry.fetch("workable", view(spark, sf, "workable_page_fx")))


def lists(spark, sf):
    return view(spark, sf, "md_doc_fx").withColumnRenamed("doc_id", "source_idx")


ROW_SHAPE = ["source_idx", "row_idx", "company", "title", "location", "url", "company_href", "date", "age"]


@query("s9_markdown_tables", """
SELECT doc_id AS source_idx, 0 AS row_idx, 'Acme' AS company, 'New Grad SWE' AS title, 'Remote - US' AS location,
 'http://boards.example.com/t/' || (doc_id % 90) || '?utm_source=x' AS url, 'https://acme.example.com' AS company_href, 'Sep 17' AS date, '' AS age FROM md_doc_fx WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 1, 'Beta', 'Engineer I', 'Toronto, Canada', NULL, NULL, '3d', '' FROM md_doc_fx WHERE doc_id % 3 = 0""")
def s9(spark, sf):
    return curated.markdown_rows(lists(spark, sf)).select(*ROW_SHAPE)


@query("s10_html_tables", """
SELECT doc_id AS source_idx, 0 AS row_idx, 'Delta' AS company, 'Software Engineer' AS title, 'Remote in USA' AS location,
 'https://boards.example.com/h/' || (doc_id % 90) AS url, 'https://delta.example.com' AS company_href, '' AS date, '2w' AS age FROM md_doc_fx WHERE doc_id % 3 = 2""")
def s10(spark, sf):
    return curated.html_rows(lists(spark, sf)).select(*ROW_SHAPE)


@query("s11_bullets", """
SELECT doc_id AS source_idx, 2 AS parser_idx, 1 AS row_idx, 'Gamma' AS company, 'Junior Developer' AS title, 'https://boards.example.com/b/' || (doc_id % 90) AS row_url FROM md_doc_fx WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 2, 2, 'Solo', 'Solo', 'https://boards.example.com/s/1' FROM md_doc_fx WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 1, 0, 'Acme', 'New Grad SWE', 'https://boards.example.com/t/' || (doc_id % 90) FROM md_doc_fx WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 0, 0, 'Delta', 'Software Engineer', 'https://boards.example.com/h/' || (doc_id % 90) FROM md_doc_fx WHERE doc_id % 3 = 2""")
def s11(spark, sf):
    return curated.gated_rows(lists(spark, sf), only_remote=False, us_only=False).select(
        "source_idx", "parser_idx", "row_idx", "company", "title", "row_url")


def column_sql(kind):
    hit = " OR ".join(f"contains(lower(h), '{w}')" for w in V.LIST_COLUMNS[kind])
    return f"nullif(list_position([({hit}) FOR h IN string_split(header, '|')], true), 0) - 1 AS {kind}"


@query("s12_header_index", f"SELECT id, {', '.join(column_sql(k) for k in V.LIST_COLUMNS)} FROM header_fx")
def s12(spark, sf):
    cells = F.split("header", r"\|")
    return view(spark, sf, "header_fx").select("id", *[text.list_column(cells, k).alias(k) for k in V.LIST_COLUMNS])


@query("s13_directory", """
SELECT ordinal, lower(trim(coalesce(nullif(provider, ''), nullif(source, ''), nullif(ats, '')))) AS provider,
 coalesce(nullif(company, ''), nullif(name, ''), nullif(org, '')) AS company, coalesce(nullif(token, ''), nullif(board_token, '')) AS token,
 coalesce(nullif(host, ''), nullif(domain, '')) AS host, coalesce(nullif(path, ''), nullif(environment, ''), 'External') AS path, priority FROM raw_directory_fx""")
def s13(spark, sf):
    return directory.normalize_directory(view(spark, sf, "raw_directory_fx"))


@query("s14_skill_config", """
SELECT id, CASE id % 5 WHEN 0 THEN 'python|sql' WHEN 1 THEN 'react|node' WHEN 2 THEN 'k' || id ELSE '' END AS any_terms,
 CASE id % 5 WHEN 1 THEN 'aws' WHEN 2 THEN 'go' ELSE '' END AS all_terms FROM skill_config_fx""")
def s14(spark, sf):
    return directory.parse_skill_config(view(spark, sf, "skill_config_fx")).select(
        "id", F.array_join("any_terms", "|").alias("any_terms"), F.array_join("all_terms", "|").alias("all_terms"))


@query("s15_source_routing", """
SELECT ordinal, 'read' AS route FROM board_directory_fx WHERE provider IN ('greenhouse', 'lever')
UNION ALL SELECT ordinal, 'reject' FROM board_directory_fx WHERE coalesce(provider, '') NOT IN ('greenhouse', 'lever', 'workday', 'ashby', 'workable')""")
def s15(spark, sf):
    chosen, rejected = directory.route(view(spark, sf, "board_directory_fx"), "greenhouse, lever")
    return chosen.select("ordinal", F.lit("read").alias("route")).unionByName(
        rejected.select("ordinal", F.lit("reject").alias("route")))


RAW = "'https://raw.githubusercontent.com/owner' || source_idx || '/jobs/"


@query("s16_candidate_urls", f"""
SELECT source_idx, CASE source_idx % 4
 WHEN 0 THEN concat_ws(' ', {', '.join(f"{RAW}{b}/{f}'" for b in V.LIST_BRANCHES for f in V.LIST_FILES)})
 WHEN 1 THEN concat_ws(' ', {RAW}main/LIST.md', {RAW}master/LIST.md')
 WHEN 2 THEN concat_ws(' ', {RAW}dev/README.md', {RAW}main/README.md', {RAW}master/README.md')
 ELSE 'https://lists.example.com/' || source_idx END AS urls FROM list_source_fx""")
def s16(spark, sf):
    return view(spark, sf, "list_source_fx").select(
        "source_idx", F.array_join(text.raw_list_urls(F.col("address")), " ").alias("urls"))


@query("s16_first_landed", "SELECT source_idx, 'body ' || source_idx AS md FROM list_source_fx WHERE source_idx % 4 <> 3")
def s16_landed(spark, sf):
    return landed_lists(view(spark, sf, "list_source_fx"), view(spark, sf, "list_page_fx"))


@query("s17_latest", "SELECT id, title FROM jobs_fx ORDER BY id DESC LIMIT 10")
def s17(spark, sf):
    return paging.latest(view(spark, sf, "jobs_fx")).select("id", "title")


@query("s17_slice", "SELECT id, title FROM jobs_fx ORDER BY id LIMIT 100 OFFSET 50")
def s17_slice(spark, sf):
    return paging.slice_by_id(view(spark, sf, "jobs_fx"), 50, 100).select("id", "title")


@query("s17_by_ids", "SELECT id, title FROM jobs_fx WHERE id IN (SELECT event_id FROM events)")
def s17_by_ids(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return paging.by_ids(view(spark, sf, "jobs_fx"), wanted).select("id", "title")


@query("j11_payload_company", """
SELECT l.payload_id, l.provider, l.token, d.company FROM landed_fx l JOIN board_directory_fx d ON d.provider = l.provider AND d.token = l.token""")
def j11(spark, sf):
    return directory.with_company(view(spark, sf, "landed_fx"), view(spark, sf, "board_directory_fx")).select(
        "payload_id", "provider", "token", "company")


def all_landed(spark, sf):
    return {name: landed(spark, sf, fx) for name, fx in (
        ("greenhouse", "gh_payload_fx"), ("lever", "lever_payload_fx"), ("workday", "workday_payload_fx"),
        ("ashby", "ashby_payload_fx"))} | {"workable": view(spark, sf, "workable_page_fx")}


@query("x1_union_sources", """
SELECT 'greenhouse' AS source, 2 * count(*) AS n FROM gh_payload_fx UNION ALL SELECT 'lever', 2 * count(*) FROM lever_payload_fx
UNION ALL SELECT 'workday', 2 * count(*) FROM workday_payload_fx UNION ALL SELECT 'ashby', 2 * count(*) FROM ashby_payload_fx
UNION ALL SELECT 'workable', 2 * count(*) FROM workable_page_fx""")
def x1(spark, sf):
    parts = [registry.fetch(name, rows) for name, rows in all_landed(spark, sf).items()]
    return registry.union_sources(parts).groupBy("source").agg(F.count("seq").alias("n"))


@query("e1_registered_source", """
SELECT payload_id AS seq, 'tok' || company_id AS token, 'Custom' AS title, 'crawler' AS source FROM gh_payload_fx""")
def e1(spark, sf):
    registry.register("crawler", lambda rows: rows.select(
        F.col("payload_id").alias("seq"), "token", F.lit("Custom").alias("title"), F.lit("crawler").alias("source")))
    return registry.fetch("crawler", landed(spark, sf, "gh_payload_fx"))


@query("x2_ordered_parsers", """
SELECT doc_id AS source_idx, CASE doc_id % 3 WHEN 0 THEN 1 ELSE 0 END AS parser_idx, unnest(range(0, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 1 END)) AS row_idx
FROM md_doc_fx WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, 2, unnest(range(1, 3)) FROM md_doc_fx WHERE doc_id % 3 = 1""")
def x2(spark, sf):
    docs = lists(spark, sf)
    rows = curated.html_rows(docs).unionByName(curated.markdown_rows(docs)).unionByName(curated.bullet_rows(docs))
    return rows.select("source_idx", "parser_idx", "row_idx")

