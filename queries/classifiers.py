"""Classifiers and filters."""

from pyspark.sql import functions as F

from queries.base import AS_OF, any_contains, found, literal, query, view
from queries.scalars import PAGE_TEXT
from vacantia.functions import classify, dates
from vacantia.functions import fixed_values as V
from vacantia.functions.html import page_text
from vacantia.operators import filters, joins, scoring
from vacantia.sources import curated

T = "lower(coalesce(title, ''))"
D = "lower(coalesce(description, ''))"
L = "lower(coalesce(location, ''))"

ENGINEERING = (f"({found('title', V.CORE_SWE_HINTS)} OR ({found('title', V.GENERIC_ENGINEER)} "
               f"AND NOT {found('title', V.NON_SWE_ENGINEER)}))")


def junior_sql(relaxed, title="title", body="description"):
    by_title = f"({found(title, V.JUNIOR_TITLE)} OR {found(title, V.YEARS_0_TO_3)})"
    low = f"lower(coalesce({body}, ''))"
    years, phrase = found(body, V.YEARS_0_TO_3), any_contains(low, V.JUNIOR_DESC_POSITIVES)
    if not relaxed:
        return (f"(NOT {found(title, V.SENIOR_BLOCK)} AND NOT {found(title, V.ENGINEER_L2)} "
                f"AND NOT {found(title, V.LEVEL_THREE)} AND {by_title})")
    return f"""(CASE WHEN {found(title, V.SENIOR_BLOCK)} THEN false
 WHEN {found(title, V.ENGINEER_L2)} AND NOT ({years} OR {phrase}) THEN false
 WHEN {found(title, V.LEVEL_THREE)} AND NOT {years} THEN false
 WHEN {by_title} THEN true WHEN {low} = '' THEN false
 WHEN {found(body, V.DESC_4PLUS_YEARS)} THEN false
 WHEN {found(body, V.DESC_SENIOR_WORDS)} AND NOT {phrase} THEN false
 ELSE {phrase} OR {years} END)"""


def remote_us_sql(location="location", body="description"):
    def parts(x):
        low = f"lower(coalesce({x}, ''))"
        us, foreign = any_contains(low, V.US_MARKERS), any_contains(low, V.NON_US_MARKERS)
        remote = f"contains({low}, 'remote')"
        return (f"WHEN {remote} AND {foreign} AND NOT {us} THEN false WHEN {remote} AND {us} THEN true")
    return f"(CASE {parts(location)} {parts(body)} ELSE false END)"


def entry_sql(title="title", body="description"):
    many = (f"list_aggregate([CAST(n AS INTEGER) >= 3 FOR n IN regexp_extract_all(coalesce({body}, ''), "
            f"{literal('(?i)' + V.PLUS_YEARS)}, 1)], 'bool_or')")
    return f"""CASE WHEN trim(coalesce({title}, '')) = '' THEN 'no-title'
 WHEN {found(title, V.ENTRY_EXCLUSION_TITLE)} THEN 'title-senior-term'
 WHEN {many} THEN 'description-3plus-years'
 WHEN {found(title, V.ENTRY_INCLUSION_TITLE)} THEN 'title-junior-term' ELSE 'default' END"""


ENTRY_KEEP = f"({entry_sql()}) NOT IN ('title-senior-term', 'description-3plus-years')"
ENTRY_TERMS = " AND ".join(
    [f"lower(title) NOT LIKE '%{t}%'" for t in V.ENTRY_TITLE_TERMS]
    + [f"{D} NOT LIKE '%{n}{gap}+%{word}%'" for n in range(3, 16) for gap in ("", " ") for word in ("year", "yrs")])


def jobs(spark, sf):
    return view(spark, sf, "jobs_fx")


def postings(spark, sf):
    return view(spark, sf, "postings_fx")


@query("c1_infer_level", f"""
SELECT id, CASE WHEN {any_contains(T, V.LEVEL_JUNIOR_TITLE)} THEN 'junior' WHEN {any_contains(T, V.LEVEL_SENIOR_TITLE)} THEN 'senior'
 WHEN {any_contains(T, V.LEVEL_MID_TITLE)} THEN 'mid' END AS by_title,
 CASE WHEN {any_contains(T, V.LEVEL_JUNIOR_TITLE)} OR {any_contains(D, V.LEVEL_JUNIOR_DESC)} THEN 'junior' WHEN {any_contains(T, V.LEVEL_SENIOR_TITLE)} THEN 'senior'
 WHEN {any_contains(T, V.LEVEL_MID_TITLE)} THEN 'mid' END AS by_both FROM jobs_fx""")
def c1(spark, sf):
    return jobs(spark, sf).select("id", classify.infer_level(F.col("title")).alias("by_title"),
                                  classify.infer_level(F.col("title"), F.col("description")).alias("by_both"))


@query("c2_curated_level", f"""
SELECT id, CASE WHEN {any_contains(T, V.CURATED_JUNIOR_HINTS)} THEN 'junior' ELSE 'unknown' END AS level FROM jobs_fx""")
def c2(spark, sf):
    return jobs(spark, sf).select("id", classify.curated_level(F.col("title")).alias("level"))


@query("c3_engineering_title", f"SELECT id, {ENGINEERING} AS engineering FROM jobs_fx")
def c3(spark, sf):
    return jobs(spark, sf).select("id", classify.is_engineering(F.col("title")).alias("engineering"))


@query("c4_junior", f"SELECT id, {junior_sql(False)} AS strict, {junior_sql(True)} AS relaxed FROM jobs_fx")
def c4(spark, sf):
    args = F.col("title"), F.col("description")
    return jobs(spark, sf).select("id", classify.is_junior(*args).alias("strict"),
                                  classify.is_junior(*args, relaxed=True).alias("relaxed"))


@query("c5_remote_us", f"SELECT id, {remote_us_sql()} AS remote_us FROM jobs_fx")
def c5(spark, sf):
    return jobs(spark, sf).select(
        "id", classify.is_remote_us(F.col("location"), F.col("description")).alias("remote_us"))


@query("c6_curated_remote", f"""
SELECT id, {any_contains(L, V.CURATED_REMOTE_HINTS)} OR contains({T}, 'remote') AS remote FROM jobs_fx""")
def c6(spark, sf):
    return jobs(spark, sf).select("id", classify.is_curated_remote(F.col("location"), F.col("title")).alias("remote"))


@query("c7_curated_us", f"""
SELECT id, CASE WHEN {any_contains(L, V.CURATED_UNWANTED_REGIONS)} THEN false
 WHEN regexp_matches(regexp_replace({L}, '[^a-z]+', ' ', 'g'), {literal(V.CURATED_US_TOKENS)}) THEN true
 WHEN regexp_matches({L}, {literal(V.CURATED_US_PUNCTUATED)}) THEN true ELSE contains({L}, 'remote') END AS us FROM jobs_fx""")
def c7(spark, sf):
    return jobs(spark, sf).select("id", classify.is_curated_us(F.col("location")).alias("us"))


@query("c8_entry_decision", f"""
SELECT id, reason, CASE WHEN reason IN ('title-senior-term', 'description-3plus-years') THEN 'exclude' ELSE 'keep' END AS decision
FROM (SELECT id, {entry_sql()} AS reason FROM jobs_fx)""")
def c8(spark, sf):
    outcome = classify.entry_decision(F.col("title"), F.col("description"))
    return jobs(spark, sf).select("id", outcome.alias("o")).select("id", "o.decision", "o.reason")


@query("c9_provider_visibility", """
SELECT id, provider, provider IN ('greenhouse', 'github') AS visible,
 provider IN ('greenhouse', 'github', 'ashby', 'workday', 'lever') AS with_experimental FROM jobs_fx""")
def c9(spark, sf):
    provider = F.col("provider")
    return jobs(spark, sf).select(
        "id", "provider", classify.is_provider_visible(provider).alias("visible"),
        classify.is_provider_visible(provider, experimental=True).alias("with_experimental"))


ELIGIBLE = (f"{found('title', V.STRICT_ENGINEERING)} AND NOT {found('title', V.STRICT_SENIOR)} "
            f"AND NOT {found('title', V.STRICT_NON_ENG)}")


@query("c10_title_eligible", f"""
SELECT id, {ELIGIBLE} AND NOT {found('title', V.STRICT_MISFIT)} AS eligible,
 {ELIGIBLE} AND {found('title', V.STRICT_JUNIOR_TITLE)} AS junior_any_tech FROM jobs_fx""")
def c10(spark, sf):
    return jobs(spark, sf).select(
        "id", classify.is_title_eligible(F.col("title"), junior_only=False).alias("eligible"),
        classify.is_title_eligible(F.col("title"), junior_only=True, block_misfit=False).alias("junior_any_tech"))


@query("c11_remote_by_page", f"""
SELECT id, NOT {found('location', V.COUNTRY_BLOCK)} AND ({found('location', V.REMOTE_FLAG)} OR {found('description', V.REMOTE_FLAG)}) AS anywhere,
 NOT {found('location', V.COUNTRY_BLOCK)} AND NOT {found('location', V.HYBRID_FLAG)} AND CASE WHEN coalesce(trim(location), '') = ''
  THEN {found('description', V.REMOTE_FLAG)} AND {found('description', V.US_FLAG)} AND NOT {found('description', V.HYBRID_FLAG)}
  ELSE {found('location', V.LOCATION_US_REMOTE)} END AS us_no_hybrid FROM jobs_fx""")
def c11(spark, sf):
    args = F.col("description"), F.col("location")
    return jobs(spark, sf).select(
        "id", classify.is_remote_by_page(*args).alias("anywhere"),
        classify.is_remote_by_page(*args, us_only=True, exclude_hybrid=True).alias("us_no_hybrid"))


@query("c12_suggests_junior", f"""
SELECT id, {found('description', V.RELAX_PHRASES)} OR {any_contains(D, V.RELAX_YEAR_HINTS)} AS suggests FROM jobs_fx""")
def c12(spark, sf):
    return jobs(spark, sf).select("id", classify.suggests_junior(F.col("description")).alias("suggests"))


@query("c12_suggests_junior_page", f"""
SELECT page_id, {found('body', V.RELAX_PHRASES)} OR {any_contains("lower(coalesce(body, ''))", V.RELAX_YEAR_HINTS)} AS suggests
FROM (SELECT page_id, {PAGE_TEXT.format('html')} AS body FROM junior_page_fx)""")
def c12_page(spark, sf):
    pages = view(spark, sf, "junior_page_fx").select("page_id", page_text(F.col("html")).alias("body"))
    return pages.select("page_id", classify.suggests_junior(F.col("body")).alias("suggests"))


@query("c13_remote_flag", f"SELECT seq, {remote_us_sql('location', 'description_snippet')} AS is_remote FROM postings_fx")
def c13(spark, sf):
    return filters.with_remote_flag(postings(spark, sf)).select("seq", "is_remote")


@query("c14_detect_board", r"""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'ashby' WHEN 4 THEN 'workable' ELSE 'unknown' END AS provider,
 CASE page_id % 7 WHEN 0 THEN 'acme' WHEN 1 THEN 'beta' WHEN 3 THEN 'delta' WHEN 4 THEN 'eps' END AS token,
 CASE page_id % 7 WHEN 2 THEN 'gamma.wd1.myworkdayjobs.com' END AS host, CASE page_id % 7 WHEN 2 THEN 'External' END AS path,
 nullif(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '( Careers| - Careers).*| +$', ''), '') AS company FROM ats_page_fx""")
def c14(spark, sf):
    pages = view(spark, sf, "ats_page_fx")
    return pages.select(
        "page_id", classify.detect_board(F.col("html"), F.col("url")).alias("b"),
        classify.company_from_title(F.col("html")).alias("company")).select("page_id", "b.*", "company")


@query("c14_directory_stub", r"""
SELECT page_id, '{"company":"' || CASE WHEN page_id % 2 = 0 THEN 'Acme' ELSE '<NAME>' END || CASE page_id % 7 WHEN 0 THEN '","ats":"greenhouse","token":"acme"' WHEN 1 THEN '","ats":"lever","token":"beta"'
 WHEN 2 THEN '","ats":"workday","host":"gamma.wd1.myworkdayjobs.com","path":"External"' WHEN 3 THEN '","ats":"ashby","token":"delta"' WHEN 4 THEN '","ats":"workable","token":"eps"' END || ',"priority":"High"}' AS stub FROM ats_page_fx""")
def c14_stub(spark, sf):
    pages = view(spark, sf, "ats_page_fx")
    board = classify.detect_board(F.col("html"), F.col("url"))
    company = F.when(F.col("page_id") % 2 == 0, "Acme")
    return pages.select("page_id", board.alias("b"), company.alias("c")).select(
        "page_id", classify.directory_stub(F.col("b"), F.col("c")).alias("stub"))


@query("c14_detect_board_headers", r"""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'ashby' WHEN 4 THEN 'workable' WHEN 5 THEN 'workable' ELSE 'unknown' END AS provider,
 CASE page_id % 7 WHEN 0 THEN 'acme' WHEN 1 THEN 'beta' WHEN 3 THEN 'delta' WHEN 4 THEN 'eps' WHEN 5 THEN 'eps' END AS token,
 CASE page_id % 7 WHEN 2 THEN 'gamma.wd1.myworkdayjobs.com' END AS host, CASE page_id % 7 WHEN 2 THEN 'External' END AS path FROM header_page_fx""")
def c14_headers(spark, sf):
    pages = view(spark, sf, "header_page_fx").withColumn("html", F.replace("html", F.lit("\\n"), F.lit("\n")))
    return pages.select(
        "page_id", classify.detect_board(F.col("html"), F.col("url"), headers=True).alias("b")).select(
        "page_id", "b.*")


# ---- filters ---------------------------------------------------------------------------

BASIC_JUNIOR = f"({ENGINEERING} AND NOT {any_contains(T, V.BASIC_SENIOR_MARKERS)})"


@query("f1_basic_keep", f"""
SELECT id, trim(title) <> '' AS relaxed, {BASIC_JUNIOR} AS junior_only,
 {ENGINEERING} AND ({L} = '' OR (contains({L}, 'remote') AND (contains({L}, 'united states') OR contains({L}, 'us')))) AS us_remote_only FROM jobs_fx""")
def f1(spark, sf):
    return jobs(spark, sf).select(
        "id", filters.keeps_basic().alias("relaxed"), filters.keeps_basic(junior_only=True).alias("junior_only"),
        filters.keeps_basic(us_remote_only=True).alias("us_remote_only"))


@query("f2_recent", f"""
SELECT id, posted_at FROM jobs_fx WHERE TIMESTAMP '{AS_OF}' - posted_at <= INTERVAL 30 DAY""")
def f2(spark, sf):
    return jobs(spark, sf).filter(dates.within_days(F.col("posted_at"), 30, AS_OF)).select("id", "posted_at")


@query("f3_run_recency", f"""
SELECT id, posted_at IS NULL OR posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AS kept,
 coalesce(posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY, false) AS kept_dated FROM jobs_fx""")
def f3(spark, sf):
    return jobs(spark, sf).select("id", filters.keeps_recent(90, AS_OF).alias("kept"),
                                  filters.keeps_recent(90, AS_OF, require_date=True).alias("kept_dated"))


@query("f4_query_recency", f"""
SELECT id, posted_at FROM jobs_fx WHERE posted_at IS NOT NULL AND posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def f4(spark, sf):
    return jobs(spark, sf).filter(filters.posted_since(30, AS_OF)).select("id", "posted_at")


@query("f5_equality_filters", """
SELECT j.id, c.slug FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id
WHERE j.level = 'mid' AND j.is_remote AND j.provider = 'lever' AND c.slug = (SELECT min(slug) FROM companies_fx WHERE id IN
 (SELECT company_id FROM jobs_fx WHERE level = 'mid' AND is_remote AND provider = 'lever'))
UNION ALL SELECT -j.id, c.slug FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id WHERE j.level = 'mid' AND j.is_remote AND j.provider = 'lever'""")
def f5(spark, sf):
    named = joins.jobs_with_companies(jobs(spark, sf), view(spark, sf, "companies_fx"))
    found_rows = named.filter(filters.provider_gate("lever"))
    for test in filters.equality(level="mid", remote=True):
        found_rows = found_rows.filter(test)
    # The slug argument, taken from the data: the first company that has such jobs.
    first = found_rows.select(F.min("company_slug")).scalar()
    one = found_rows.filter(F.col("company_slug") == first)
    return one.select("id", F.col("company_slug").alias("slug")).unionByName(
        found_rows.select((-F.col("id")).alias("id"), F.col("company_slug").alias("slug")))


@query("f6_default_providers", """
SELECT id, provider FROM jobs_fx WHERE provider IN ('greenhouse', 'github')""")
def f6(spark, sf):
    return jobs(spark, sf).filter(filters.provider_gate("all")).select("id", "provider")


@query("f7_keyword", """
SELECT j.id FROM jobs_fx j JOIN companies_fx c ON c.id = j.company_id WHERE j.title ILIKE '%front_nd%' OR c.name ILIKE '%front_nd%'
 OR j.title ILIKE '%#00000001%' OR c.name ILIKE '%#00000001%'""")
def f7(spark, sf):
    named = joins.jobs_with_companies(jobs(spark, sf), view(spark, sf, "companies_fx"))
    return named.filter(filters.keyword("FRONT_nd") | filters.keyword("#00000001")).select("id")


@query("f8_entry_terms", f"SELECT id FROM jobs_fx WHERE {ENTRY_TERMS}")
def f8(spark, sf):
    return jobs(spark, sf).filter(filters.passes_entry_terms()).select("id")


@query("f9_entry_filter", f"SELECT id FROM jobs_fx WHERE {ENTRY_TERMS} AND {ENTRY_KEEP}")
def f9(spark, sf):
    return filters.entry_filter(jobs(spark, sf)).select("id")


@query("f10_entry_filter_ingest", f"""
SELECT seq FROM postings_fx WHERE ({entry_sql('title', 'description_snippet')}) NOT IN ('title-senior-term', 'description-3plus-years')""")
def f10(spark, sf):
    return filters.entry_filter_at_ingest(postings(spark, sf)).select("seq")


@query("f11_curated_gates", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://boards.example.com/t/' ELSE 'https://boards.example.com/h/' END || CAST(doc_id % 90 AS VARCHAR) AS row_url,
 CASE WHEN doc_id % 3 = 0 THEN 'Remote - US' ELSE 'Remote (US)' END AS location FROM md_doc_fx WHERE doc_id % 3 <> 1""")
def f11(spark, sf):
    lists = view(spark, sf, "md_doc_fx").withColumnRenamed("doc_id", "source_idx")
    return curated.gated_rows(lists).select(F.col("source_idx").alias("doc_id"), "row_url", "location")


@query("f12_save_gate", """
SELECT seq, trim(company) <> '' AND trim(source) <> '' AND trim(url) <> '' AND trim(title) <> '' AS saveable FROM postings_fx""")
def f12(spark, sf):
    good, bad = filters.split_saveable(postings(spark, sf))
    return good.select("seq", F.lit(True).alias("saveable")).unionByName(
        bad.select("seq", F.lit(False).alias("saveable")))


HITS = " + ".join(
    f"CAST(contains(lower(coalesce(title, '') || ' ' || coalesce(description_snippet, '')), '{t}') AS BIGINT)"
    for t in V.DEFAULT_SKILLS)
SOFT_SCORE = f"CASE WHEN {HITS} = 0 AND {ENGINEERING} THEN 1 ELSE {HITS} END"


@query("f13_min_score", f"""
SELECT seq, skill_score FROM (SELECT seq, {SOFT_SCORE} AS skill_score FROM postings_fx) WHERE skill_score >= 2""")
def f13(spark, sf):
    scored = scoring.score(postings(spark, sf), V.DEFAULT_SKILLS)
    return filters.min_score(scored, 2).select("seq", F.col("skill_score").cast("long").alias("skill_score"))


@query("f14_skill_gate", f"""
SELECT seq, {HITS} + 1 AS skill_score FROM postings_fx
WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(description_snippet, '')), 'engineer')""")
def f14(spark, sf):
    return scoring.score(postings(spark, sf), V.DEFAULT_SKILLS, ["engineer"], hard=True).select(
        "seq", F.col("skill_score").cast("long").alias("skill_score"))


@query("f15_include_undated", "SELECT id FROM jobs_fx WHERE posted_at IS NOT NULL")
def f15(spark, sf):
    return jobs(spark, sf).filter(filters.include_undated(False)).select("id")


RULES = {
    "junior_only": True, "us_remote_only": False,
    "include_titles": ["software engineer", "frontend", "backend", "full[- ]?stack", "web"],
    "exclude_titles": ["senior", "staff", "principal", "lead", "manager", "architect"],
    "include_keywords_any": ["engineer", "junior", "new grad"],
    "exclude_companies": ["Customer#000000001"],
}


@query("f16_rule_set", f"""
SELECT seq FROM postings_fx WHERE regexp_matches(title, 'software engineer|frontend|backend|full[- ]?stack|web', 'i')
 AND NOT regexp_matches(title, 'senior|staff|principal|lead|manager|architect', 'i')
 AND regexp_matches(lower(title || ' ' || coalesce(description_snippet, '')), 'engineer|junior|new grad')
 AND company <> 'Customer#000000001' AND {junior_sql(True, 'title', 'description_snippet')}""")
def f16(spark, sf):
    return postings(spark, sf).filter(filters.rule_set(RULES)).select("seq")


