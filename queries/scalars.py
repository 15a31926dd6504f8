"""Projections and scalar functions."""

from pyspark.sql import functions as F

from queries.base import AS_OF, CURATED_AS_OF, literal, query, table, view
from vacantia.functions import dates, text
from vacantia.functions import fixed_values as V
from vacantia.functions.html import snippet
from vacantia.operators import joins, paging, scoring
from vacantia.sources import curated

SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
SLUG = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
TIDY_COMPANY = r"trim(regexp_replace(regexp_replace(trim({0}), '^[^\w(\[]+', ''), '\s+', ' ', 'g'))"
LINK = literal(V.MARKDOWN_LINK)
# Offset dropped.
WALL = (r"CASE WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN "
        r"try_cast(regexp_replace({0}, '(Z|[+-]\d\d:\d\d)$', '') AS TIMESTAMP) END")
# Offset applied.
UTC = (r"CASE WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN "
       r"try_cast(regexp_replace({0}, '(Z|[+-]\d\d:\d\d)$', '') AS TIMESTAMP) - CASE WHEN regexp_matches({0}, 'T.*[+-]\d\d:\d\d$') "
       r"THEN to_minutes(CAST(concat(regexp_extract({0}, '([+-])\d\d:\d\d$', 1), '1') AS INTEGER) * "
       r"(CAST(regexp_extract({0}, '(\d\d):\d\d$', 1) AS INTEGER) * 60 + CAST(regexp_extract({0}, ':(\d\d)$', 1) AS INTEGER))) "
       r"ELSE to_minutes(0) END END")
CANONICAL = r"""(WITH p AS (SELECT id, url, company_href, lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
   regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host,
   regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
   list_last(regexp_extract_all({0}, '[?&]gh_jid=([^&#]*)', 1)) AS jid,
   regexp_extract({0}, '(#.*)$', 1) AS frag FROM link_fx)
 SELECT id, url, company_href, CASE WHEN {0} IS NULL OR (lower(host) = 'simplify.jobs' AND jid IS NULL
   AND split_part(ltrim(path, '/'), '/', 1) NOT IN ('p', 'c')) THEN NULL ELSE concat(CASE scheme WHEN '' THEN '' WHEN 'http' THEN 'https:' ELSE scheme || ':' END,
   CASE WHEN host = '' THEN '' ELSE '//' || host END, path, CASE WHEN jid IS NULL THEN '' ELSE '?gh_jid=' || jid END, CASE WHEN frag = '#' THEN '' ELSE frag END) END AS canonical FROM p)"""


@query("k1_collapse_blanks", f"""
SELECT id, {SQUEEZE.format('title')} AS title, {SQUEEZE.format('provider')} AS company FROM jobs_fx""")
def k1(spark, sf):
    return view(spark, sf, "jobs_fx").select(
        "id", text.normalize_title(F.col("title")).alias("title"),
        text.normalize_company(F.col("provider")).alias("company"))


@query("k2_canonical_location", f"""
SELECT id, replace(replace({SQUEEZE.format("nullif(location, '')")}, 'United States of America', 'United States'), 'US-Remote', 'Remote - US') AS location
FROM (SELECT id, location FROM jobs_fx UNION ALL SELECT -id, location FROM text_fx)""")
def k2(spark, sf):
    both = view(spark, sf, "jobs_fx").select("id", "location").unionByName(
        view(spark, sf, "text_fx").select((-F.col("id")).alias("id"), "location"))
    return both.select("id", text.canonical_location(F.col("location")).alias("location"))


@query("k3_curated_location", r"""
SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(location, '\s+', ' ', 'g')), '(,\s*)?remote(\s*,\s*remote)+', ' remote', 'gi'),
 '\bremote\s+in\s+usa\b', 'Remote (US)', 'gi') AS location FROM text_fx""")
def k3(spark, sf):
    return view(spark, sf, "text_fx").select("id", text.curated_location(F.col("location")).alias("location"))


@query("k4_curated_company", f"SELECT id, {TIDY_COMPANY.format('company')} AS company FROM text_fx")
def k4(spark, sf):
    return view(spark, sf, "text_fx").select("id", text.curated_company(F.col("company")).alias("company"))


@query("k5_slugify", f"SELECT id, {SLUG.format('company')} AS slug FROM text_fx")
def k5(spark, sf):
    return view(spark, sf, "text_fx").select("id", text.slugify(F.col("company")).alias("slug"))


@query("k6_company_token", f"""
SELECT id, coalesce(nullif({SLUG.format('company')}, ''), nullif({SLUG.format("regexp_extract(url, '^https?://([^/:?#]*)', 1)")}, ''), 'unknown') AS token
FROM text_fx""")
def k6(spark, sf):
    return view(spark, sf, "text_fx").select("id", text.company_token(F.col("company"), F.col("url")).alias("token"))


@query("k7_canonical_url", f"SELECT id, canonical FROM {CANONICAL.format('url')}")
def k7(spark, sf):
    return view(spark, sf, "link_fx").select("id", text.canonical_url(F.col("url")).alias("canonical"))


@query("k8_hashed_id", "SELECT id, url, substr(sha1(url), 1, 16) AS external_id FROM link_fx")
def k8(spark, sf):
    return view(spark, sf, "link_fx").select("id", "url", text.hashed_id(F.col("url")).alias("external_id"))


@query("k9_legacy_id", f"""
SELECT a.id, CASE WHEN b.canonical <> a.canonical THEN substr(sha1(b.canonical), 1, 16) END AS legacy_external_id
FROM {CANONICAL.format('url')} a JOIN {CANONICAL.format('company_href')} b ON a.id = b.id""")
def k9(spark, sf):
    links = view(spark, sf, "link_fx")
    return links.select("id", text.legacy_id(
        F.col("company_href"), text.canonical_url(F.col("url"))).alias("legacy_external_id"))


@query("k10_external_id", r"""
SELECT row_key, coalesce(CASE WHEN trim(job_id) <> '' THEN job_id END, CASE WHEN trim(greenhouse_id) <> '' THEN greenhouse_id END,
 nullif(regexp_extract(rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), ''), nullif(url, '')) AS external_id
FROM (SELECT id AS row_key, * FROM text_fx)""")
def k10(spark, sf):
    rows = view(spark, sf, "text_fx").withColumnRenamed("id", "row_key")
    return rows.select("row_key", text.external_id(rows.columns, F.col("url")).alias("external_id"))


@query("k11_markdown_link", f"""
SELECT id, CASE WHEN len(urls) > 0 THEN trim(urls[coalesce(nullif(list_position([contains(lower(x), 'apply') FOR x IN labels], true), 0), 1)])
  WHEN starts_with(bare, 'http') THEN bare END AS url,
 CASE WHEN len(urls) > 0 THEN trim(labels[coalesce(nullif(list_position([contains(lower(x), 'apply') FOR x IN labels], true), 0), 1)]) ELSE bare END AS label
FROM (SELECT id, trim(cell) AS bare, regexp_extract_all(cell, {LINK}, 1) AS labels, regexp_extract_all(cell, {LINK}, 2) AS urls FROM text_fx)""")
def k11(spark, sf):
    return view(spark, sf, "text_fx").select(
        "id", text.link_url(F.col("cell")).alias("url"), text.link_text(F.col("cell")).alias("label"))


@query("k12_greenhouse_date", f"""
WITH d AS (SELECT payload_id, unnest(range(0, 2)) AS pos, body FROM gh_payload_fx),
k AS (SELECT payload_id, pos, coalesce(json_extract_string(body, '$.jobs[' || pos || '].updated_at'), json_extract_string(body, '$.jobs[' || pos || '].created_at')) AS v FROM d)
SELECT payload_id, pos, {WALL.format('v')} AS posted_at FROM k""")
def k12(spark, sf):
    item = F.col("item")
    layout = "jobs array<struct<updated_at:string,created_at:string>>"
    return view(spark, sf, "gh_payload_fx").select(
        "payload_id", F.posexplode(F.from_json("body", layout)["jobs"]).alias("pos", "item")).select(
        "payload_id", F.col("pos").cast("long").alias("pos"),
        dates.greenhouse_date(item["updated_at"], item["created_at"]).alias("posted_at"))


@query("k13_lever_date", f"""
WITH d AS (SELECT payload_id, unnest(range(0, 2)) AS pos, body FROM lever_payload_fx),
k AS (SELECT payload_id, pos, coalesce(json_extract_string(body, '$[' || pos || '].createdAt'), json_extract_string(body, '$[' || pos || '].updatedAt')) AS v FROM d)
SELECT payload_id, pos, CASE WHEN regexp_matches(v, '^\\d+$') THEN make_timestamp(CAST(v AS BIGINT) * 1000) ELSE {WALL.format('v')} END AS posted_at FROM k""")
def k13(spark, sf):
    item = F.col("item")
    layout = "array<struct<createdAt:string,updatedAt:string,listedAt:string>>"
    return view(spark, sf, "lever_payload_fx").select(
        "payload_id", F.posexplode(F.from_json("body", layout)).alias("pos", "item")).select(
        "payload_id", F.col("pos").cast("long").alias("pos"),
        dates.lever_date(item["createdAt"], item["updatedAt"], item["listedAt"]).alias("posted_at"))


@query("k14_workday_date", f"""
SELECT payload_id, {UTC.format("json_extract_string(body, '$.jobPostings[0].meta.postedDate')")} AS first_posted,
 make_timestamp(CAST(json_extract_string(body, '$.jobPostings[1].startDate') AS BIGINT) * 1000000) AS second_posted FROM workday_payload_fx""")
def k14(spark, sf):
    layout = "jobPostings array<struct<postedOn:string,startDate:string,meta:struct<postedDate:string>>>"
    items = view(spark, sf, "workday_payload_fx").select(
        "payload_id", F.from_json("body", layout)["jobPostings"].alias("items"))

    def posted(n):
        item = F.col("items")[n]
        return dates.workday_date(item["postedOn"], item["startDate"], item["meta"]["postedDate"])
    return items.select("payload_id", posted(0).alias("first_posted"), posted(1).alias("second_posted"))


@query("k15_ashby_date", f"""
SELECT id, {WALL.format("coalesce(nullif(iso, ''), '2025-01-02')")} AS posted_at FROM text_fx""")
def k15(spark, sf):
    return view(spark, sf, "text_fx").select(
        "id", dates.ashby_date(F.col("iso"), F.lit(""), F.lit("2025-01-02")).alias("posted_at"))


@query("k16_page_posting_date", r"""
SELECT page_id, nullif(json_extract_string(nullif(regexp_extract(html, '<script type="application/ld\+json">(.*?)</script>', 1), ''), '$.datePosted'), '') AS date_text
FROM ats_page_fx""")
def k16(spark, sf):
    return view(spark, sf, "ats_page_fx").select(
        "page_id", dates.page_posting_date(F.col("html")).alias("date_text"))


@query("k17_curated_date", f"""
WITH c AS (SELECT TIMESTAMP '{CURATED_AS_OF}' AS now)
SELECT id, CASE WHEN regexp_matches(txt, '^\\d{{4}}-\\d+-\\d+$') THEN try_cast(txt AS TIMESTAMP)
 WHEN regexp_matches(txt, '^\\w{{3}} \\d+$') THEN (SELECT CASE WHEN d > now + INTERVAL 30 DAY THEN d - INTERVAL 1 YEAR ELSE d END
   FROM (SELECT try_strptime(txt || ' 2025', '%b %d %Y') AS d))
 WHEN regexp_matches(txt, '^\\d+ days? ago$') THEN date_trunc('day', now - to_days(CAST(regexp_extract(txt, '^\\d+') AS INTEGER)))
 WHEN regexp_matches(txt, '^\\d+d$') THEN date_trunc('day', now - to_days(CAST(regexp_extract(txt, '^\\d+') AS INTEGER)))
 WHEN regexp_matches(txt, '^\\d+w$') THEN date_trunc('day', now - to_days(7 * CAST(regexp_extract(txt, '^\\d+') AS INTEGER)))
 WHEN regexp_matches(txt, '^\\d+h$') THEN date_trunc('day', now) END AS posted_at FROM date_text_fx, c""")
def k17(spark, sf):
    return view(spark, sf, "date_text_fx").select(
        "id", dates.curated_date(F.col("txt"), CURATED_AS_OF).alias("posted_at"))


@query("k18_date_in_text", f"""
SELECT id, CASE WHEN contains(description, 'Posted 2001-07-04') THEN TIMESTAMP '2001-07-04 00:00:00'
 WHEN regexp_matches(description, '\\d+ days ago') THEN TIMESTAMP '{AS_OF}' - to_days(CAST(regexp_extract(description, '(\\d+) days ago', 1) AS INTEGER))
 END AS found_at FROM jobs_fx""")
def k18(spark, sf):
    return view(spark, sf, "jobs_fx").select(
        "id", dates.date_in_text(F.col("description"), AS_OF).alias("found_at"))


# The test pages hold four named references, at times without the semicolon, and are cut off inside a tag at times.
PAGE_TEXT = (r"regexp_replace({0}, '(?s)<script.*?(</script>|$)|<style.*?(</style>|$)|<!--.*?(-->|$)|<[^>]*(>|$)', ' ', 'g')")
for _name, _char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")):
    PAGE_TEXT = f"regexp_replace({PAGE_TEXT}, '&{_name};?', '{_char}', 'g')"


@query("k19_html_snippet", f"""
SELECT page_id, nullif(substring({SQUEEZE.format(PAGE_TEXT.format('html'))}, 1, 1200), '') AS snippet FROM pages""")
def k19(spark, sf):
    return table(spark, sf, "pages").select("page_id", snippet(F.col("html")).alias("snippet"))


@query("k20_first_per_url", r"""
WITH r AS (SELECT id AS source_idx, regexp_extract(md, '\((https?://boards[^)?]*)', 1) AS row_url FROM
 (SELECT doc_id AS id, md FROM md_doc_fx WHERE doc_id % 3 = 1))
SELECT row_url, min(source_idx) AS source_idx FROM r GROUP BY row_url
UNION ALL SELECT 'https://boards.example.com/s/1', min(doc_id) FROM md_doc_fx WHERE doc_id % 3 = 1""")
def k20(spark, sf):
    lists = view(spark, sf, "md_doc_fx").withColumnRenamed("doc_id", "source_idx")
    rows = curated.gated(curated.bullet_rows(lists), only_remote=False, us_only=False)
    return curated.first_per_url(rows).select("row_url", "source_idx")


@query("k21_naive_utc", f"SELECT id, {UTC.format('iso')} AS at FROM text_fx")
def k21(spark, sf):
    return view(spark, sf, "text_fx").select("id", dates.naive_utc(F.col("iso")).alias("at"))


@query("k22_posted_days_ago", f"""
SELECT id, CAST(floor((epoch_us(TIMESTAMP '1999-01-01 12:00:00') - epoch_us(posted_at)) / 86400000000.0) AS BIGINT) AS days_ago FROM jobs_fx""")
def k22(spark, sf):
    return view(spark, sf, "jobs_fx").select(
        "id", dates.posted_days_ago(F.col("posted_at"), "1999-01-01 12:00:00").alias("days_ago"))


@query("k23_matched_skills", f"""
SELECT seq, array_to_string(list_sort([t FOR t IN {list(V.DEFAULT_SKILLS)} IF contains(lower(coalesce(title, '') || ' ' || coalesce(description_snippet, '')), t)]), '|') AS skills
FROM postings_fx""")
def k23(spark, sf):
    return scoring.with_matched_skills(view(spark, sf, "postings_fx"), V.DEFAULT_SKILLS).select(
        "seq", F.array_join("skills", "|").alias("skills"))


@query("k24_curated_defaults", f"""
SELECT id, coalesce(nullif(skill, ''), '{V.CURATED_DEFAULT_TITLE}') AS title, coalesce(nullif(company, ''), 'tok') AS company FROM text_fx""")
def k24(spark, sf):
    return view(spark, sf, "text_fx").select(
        "id", text.with_default(F.col("skill"), V.CURATED_DEFAULT_TITLE).alias("title"),
        text.with_default(F.col("company"), "tok").alias("company"))


@query("k25_display_date", "SELECT id, coalesce(strftime(posted_at, '%b %-d, %Y'), '—') AS shown FROM jobs_fx")
def k25(spark, sf):
    return view(spark, sf, "jobs_fx").select("id", text.display_date(F.col("posted_at")).alias("shown"))


@query("k26_display_level", """
SELECT id, CASE level WHEN 'senior' THEN 'Senior' WHEN 'mid' THEN 'Mid' ELSE 'Junior' END AS shown FROM jobs_fx""")
def k26(spark, sf):
    return view(spark, sf, "jobs_fx").select("id", text.display_level(F.col("level")).alias("shown"))


@query("k27_shows_slug", """
SELECT id, regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') NOT IN ('', regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) AS shown
FROM (SELECT id, name, CASE WHEN id % 3 = 0 THEN replace(lower(name), '#', '-') ELSE slug END AS slug FROM companies_fx)""")
def k27(spark, sf):
    companies = view(spark, sf, "companies_fx").withColumn(
        "slug", F.expr("CASE WHEN id % 3 = 0 THEN replace(lower(name), '#', '-') ELSE slug END"))
    return companies.select("id", text.shows_slug(F.col("slug"), F.col("name")).alias("shown"))


@query("k28_compact_list", """
SELECT j.id, c.slug AS company, c.name AS company_name, j.title, j.level, j.is_remote, j.posted_at, j.url
FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id""")
def k28(spark, sf):
    return paging.compact(joins.jobs_with_companies(view(spark, sf, "jobs_fx"), view(spark, sf, "companies_fx")))


@query("k29_skill_label", """
SELECT id, nullif(trim(skill), '') AS label, nullif(trim(skill), '') AS pair_label FROM text_fx""")
def k29(spark, sf):
    rows = view(spark, sf, "text_fx").withColumn("pair", F.struct(F.col("skill").alias("label"), F.lit(2).alias("w")))
    return rows.select("id", text.skill_label(F.col("skill")).alias("label"),
                       text.skill_label(F.col("pair.label")).alias("pair_label"))


