"""Browse, metrics, scoring, ranking, quotas, exports; and every registered query by name."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from queries import base
from vacantia.sources.tables import TableStore  # noqa: E402
from vacantia.operators import aggregates, filters, joins, paging, quotas, ranking, scoring, sinks
from vacantia.plans import browse, scan

NOW = "2025-09-18 15:30:00"
JOBS = ("id long, provider string, external_id string, url string, company_id long, title string, location string, is_remote boolean, "
        "level string, posted_at timestamp, description string")
DAY = datetime(2025, 9, 1)


def job(n, provider, title, description, posted, level="junior"):
    return (n, provider, f"x{n}", f"u{n}", 1, title, "Remote", True, level, posted, description)


@pytest.fixture(scope="module")
def companies(rows):
    return rows("id long, name string, slug string", (1, "Acme", "acme"))


def names(df):
    return [r.title for r in df.collect()]


def test_entry_filter_page_and_total(rows, companies):
    jobs = rows(JOBS, job(1, "greenhouse", "Senior Software Engineer", "We need leaders with 5+ years of experience.", None),
                job(2, "greenhouse", "Associate Software Engineer", "Great for new grads.", None))
    skills = rows("job_id long, skill string", (2, "SQL"))
    found = browse.browse(jobs, companies, skills, browse.Search(entry_only=True), NOW)
    assert names(found.items) == ["Associate Software Engineer"] and found.header.first().total == 1
    assert browse.matching_jobs(jobs, companies, skills, browse.Search(skills_any="sql"), NOW).count() == 1


def test_coarse_terms_and_decision_differ(rows):
    jobs = rows(JOBS, job(1, "x", "Headless Dev", None, None), job(2, "x", "Dev", "20+ years", None),
                job(3, "x", "Dev", "13+ of a\nyear", None), job(4, "x", "Dev", "2+ years", None), job(5, "x", "Dev", "5+ yr", None))
    assert {r.id for r in jobs.filter(filters.passes_entry_terms()).collect()} == {2, 4, 5}
    assert {r.id for r in jobs.filter(filters.keeps_entry_level()).collect()} == {1, 3, 4}
    assert {r.id for r in filters.entry_filter(jobs).collect()} == {4}


def test_provider_visibility(rows, companies):
    jobs = rows(JOBS, job(1, "greenhouse", "New Grad SWE", None, DAY), job(2, "ashby", "New Grad Dev", None, DAY))
    none = rows("job_id long, skill string")

    def shown(**search):
        return sorted(names(browse.matching_jobs(jobs, companies, none, browse.Search(**search), NOW)))
    assert shown() == shown(provider="ALL") == ["New Grad SWE"]
    assert shown(experimental=True) == ["New Grad Dev", "New Grad SWE"]
    assert shown(provider="ashby") == ["New Grad Dev"]
    assert shown(days=0) == shown(days=-1) == shown(days=30) == ["New Grad SWE"] and shown(days=3) == []


def test_metrics(rows):
    jobs = rows(JOBS, job(1, "greenhouse", "Junior Engineer", None, DAY),
                job(2, "ashby", "Senior Engineer", "Looking for engineers with 4+ years experience.", None),
                job(3, "lever", "Software Engineer", "Need 3+ years of professional experience.", None))
    got = aggregates.ingestion_metrics(jobs).first()
    assert (got.total, got.kept, got.excluded_by_title, got.excluded_by_yoe) == (3, 3, 1, 1)
    assert got.percent_undated == pytest.approx(200 / 3)
    assert {k: v.asDict() for k, v in got.by_provider.items()} == {
        "greenhouse": {"total": 1, "undated": 0}, "ashby": {"total": 1, "undated": 1}, "lever": {"total": 1, "undated": 1}}
    none = aggregates.ingestion_metrics(jobs.limit(0)).first()
    assert (none.total, none.percent_undated, none.by_provider) == (0, 0.0, {})


def test_backfill(rows):
    jobs = rows(JOBS, job(1, "github", "New Grad SWE", None, None), job(2, "lever", "x", None, None))
    scraped = rows("seq long, external_id string, posted_at timestamp", (1, "x1", DAY), (2, "x1", datetime(2025, 9, 15)), (3, "x1", None), (4, "x2", DAY))
    assert joins.backfill_summary(jobs, scraped).first()[:] == ("github", 1, 1, 0)
    assert {r.id: r.posted_at for r in joins.apply_backfill(jobs, scraped).collect()} == {1: datetime(2025, 9, 15), 2: None}


def test_page_limits(rows):
    df = rows("id long, posted_at timestamp", (1, None), (2, DAY))
    assert [r.id for r in paging.page(df).collect()] == [2, 1]
    assert [r.id for r in paging.page(df, order="posted_at_asc").collect()] == [1, 2]
    assert paging.page_header(df.limit(0), 25, 0).first().total_pages == 1
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            paging.page(df, **bad)


POSTINGS = ("seq long, title string, company string, url string, source string, location string, posted_at timestamp, "
            "description_snippet string, level string")


def test_number_rows_over_many_buckets(spark):
    rng = random.Random(1)
    data = [(n, rng.randrange(4)) for n in rng.sample(range(10 ** 6), 500)]
    df = spark.createDataFrame(data, "seq long, skill_score int")
    got = {r.seq: r.rank for r in ranking.number_rows(df, "rank", leading=F.col("skill_score")).collect()}
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    assert got == {seq: n for n, (seq, _) in enumerate(order, 1)}


def test_dedupe_keeps_first_position_and_last_value(rows):
    df = rows("seq long, title string, company string, url string, v string",
              (1, "A", "C", "u", "first"), (2, "B", "C", "u", "other"), (3, "a", "c", "U", "last"))
    assert sorted((r.position, r.v) for r in ranking.deduplicate(df).collect()) == [(1, "last"), (2, "other")]
    assert sorted(r.v for r in ranking.deduplicate_first(df).collect()) == ["first", "last", "other"]


def test_scores(rows):
    df = rows(POSTINGS, (1, "Rapid Engineer", "c", "u", "s", None, None, "PostgreSQL", None), (2, "Engineer", "c", "u", "s", None, None, None, None),
              (3, "Chef", "c", "u", "s", None, None, None, None))

    def scores(*args, **kw):
        return {r.seq: r.skill_score for r in scoring.score(df, *args, **kw).collect()}
    assert scores(["api", "sql", "api"]) == {1: 2, 2: 1, 3: 0}
    assert scores([], ["rapid", "sql"]) == {1: 2, 2: 1, 3: 0}
    assert scores(["engineer"], ["sql"], hard=True) == {1: 2}


def test_quota_and_top_up(rows):
    df = rows(POSTINGS, *[(n, f"Engineer {n}", "c", f"u{n}", "Lever", None, None, "text" if n < 2 else None, None) for n in range(8)],
              (9, "New Grad Engineer", "c", "u9", "ashby", None, None, None, None), (10, "Chef", "c", "", "ashby", None, None, None, None))
    assert sorted(r.seq for r in quotas.quota_candidates(df, NOW, cap=5).collect()) == [2, 3, 4, 9, 10]
    assert sorted(r.seq for r in quotas.quota_candidates(df, NOW, cap=5, caps={"lever": 2}).collect()) == [9, 10]
    assert [r.seq for r in quotas.junior_candidates(df, NOW, cap=2).collect()] == [9, 2]
    assert quotas.junior_candidates(df, NOW, cap=0).count() == 0


def test_choices_without_a_cap_take_all(rows):
    df = rows(POSTINGS, *[(n, f"Engineer {n}", "c", f"u{n}", "Lever", None, None, None, None) for n in range(200)])
    assert quotas.quota_candidates(df, NOW, cap=None).count() == 200
    assert quotas.junior_candidates(df, NOW, cap=None).count() == 200
    assert quotas.backfill_targets(df, cap=None).count() == 200 and quotas.backfill_targets(df).count() == 120


def test_number_rows_keeps_nulls_and_equal_values(spark):
    data = [(None, 1), (5, None), (5, 1), (5, 1), (None, None)] + [(n, 2) for n in range(3000)]
    df = spark.createDataFrame(data, "seq long, skill_score int")
    got = sorted((r.rank, r.skill_score, r.seq) for r in ranking.number_rows(df, "rank", leading=F.col("skill_score")).collect())
    assert [g[0] for g in got] == list(range(1, 3006))
    assert [g[1:] for g in got[3000:]] == [(1, 5), (1, 5), (1, None), (None, 5), (None, None)]


def test_scan_run(rows, tmp_path, spark):
    df = rows(POSTINGS, (1, "Junior Developer", "Acme", "https://a/1", "lever", "Remote - US", None, "posted 2 days ago, python", None),
              (2, "Senior Developer", "Acme", "https://a/2", "lever", "Remote - US", None, "python", None),
              (3, "Software Engineer", "Acme", "https://a/3", "lever", "Remote - US", DAY, "python sql", None),
              (4, "junior developer", "ACME", "https://a/1", "lever", "Remote - US", None, "python sql api", None))
    directory = rows("ordinal long, company string, token string, priority string", (0, "acme", "t0", "High"), (1, "ACME ", "", "Low"))
    profile = scan.with_preset(scan.Profile(recent_days=30), "apply-now")
    result = scan.scan(df, directory, None, profile, NOW)
    got = result.unique.orderBy("position").collect()
    assert [(r.seq, r.position, r.rank, r.skill_score, r.company_priority, r.company_token) for r in got] == [
        (1, 1, 1, 3, "Low", "t0"), (3, 2, 2, 2, "Low", "t0")]
    assert got[0].posted_days_ago == 2
    scan.write_exports(result, str(tmp_path), "rank,title,nope,posted_at")
    lines = spark.read.option("header", True).csv(str(tmp_path / "jobs_csv")).collect()
    assert {r.title for r in lines} == {"Junior Developer", "Software Engineer"} and lines[0].nope is None
    records, bad = scan.to_upsert_records(result.unique, profile)
    assert {(r.external_id, r.level, tuple(r.skills)) for r in records.collect()} == {
        ("1", "unknown", ("python",)), ("3", "unknown", ("python", "sql"))} and bad.count() == 0


def test_scan_from_landed_payloads_and_pages(rows):
    body = ('[{"hostedUrl":"https://l/1","text":"Junior Developer","categories":{"location":"US-Remote"}},'
            '{"hostedUrl":"https://l/2","text":"Web Developer","categories":{"location":"Remote, Canada"}},'
            '{"hostedUrl":"https://l/3","text":"Data Engineer","categories":{"location":"Remote (US)"},"createdAt":1}]')
    landed = {"lever": rows("payload_id long, token string, company string, host string, path string, body string",
                            (1, "l", "Acme", None, None, body)), "ashby": None}
    page = "<p>python, remote usa</p>" + "<p>filler</p>" * 300 + "<p>{}</p>"
    pages = rows("url string, html string", ("https://l/1", page.format("Posted 5 days ago")), ("https://l/2", page.format("Posted 3 days ago")))
    directory = rows("ordinal long, company string, token string, priority string", (0, "Acme", "l", "High"))
    profile = scan.with_preset(scan.Profile(providers="lever", snippet_cap=1, junior_cap=0), "apply-now")
    result = scan.scan_landed(landed, directory, pages, profile, NOW)
    fetched = {r.title: (len(r.description_snippet or ""), r.posted_at) for r in result.fetched.collect()}
    # The whole text of a page is read, so a date at its end counts, with a snippet or without one.
    assert fetched == {"Junior Developer": (2136, datetime(2025, 9, 13, 15, 30)), "Web Developer": (0, datetime(2025, 9, 15, 15, 30)),
                       "Data Engineer": (0, datetime(1970, 1, 1, 0, 0, 0, 1000))}
    # The Canadian location blocks the second; the third is too old.
    assert [(r.title, r.skill_score, r.posted_days_ago, r.company_token) for r in result.unique.collect()] == [
        ("Junior Developer", 1, 5, "l")]


PAYLOADS, ANSWERS, PAGES = ("payload_id long, provider string, token string, body string", "page_id long, token string, body string",
                            "page_id long, provider string, token string, url string, html string")


def test_scan_reads_the_boards_of_the_directory(rows, spark, tmp_path):
    item = '{"title":"Junior Developer %s","jobPostingUrl":"https://x/%s","hostedUrl":"https://x/%s","absolute_url":"https://x/%s","text":"Junior Developer %s"}'
    one = lambda n: item % ((n,) * 5)
    payloads = rows(PAYLOADS, (1, "greenhouse", "g", '{"jobs":[%s]}' % one("g")), (2, "lever", "l", "[%s]" % one("l")),
                    (3, "lever", "other", "[%s]" % one("unlisted")), (4, "ashby", "empty", "[]"), (5, "ashby", "a-co", "[%s]" % one("slug")),
                    (6, "ashby", "full", "[%s]" % one("full")), (7, "workday", "w.example.com", '{"jobPostings":[{"title":"Junior Developer w"}]}'))
    answers = rows(ANSWERS, (8, "Named-HQ", '{"a":{"title":"Junior Developer answer","jobUrl":"https://jobs.ashbyhq.com/Named-HQ/7"}}'),
                   (9, "full", '{"title":"Junior Developer no","jobUrl":"https://jobs.ashbyhq.com/full/8"}'))
    pages = rows(PAGES, (10, "ashby", "empty", "u", '<script>{"organizationSlug":"Named-HQ"}</script><a href="/empty/job/1">Junior Developer hidden</a>'),
                 (11, "ashby", "bare", "u", '<a href="/bare/job/1">Junior Developer page</a>'),
                 (12, "workable", "k", "https://apply.workable.com/k", '<li><a href="/k/j/1">Junior Developer k</a></li>'))
    entries = [("greenhouse", "G", "g", None), ("lever", "L", "l", None), ("lever", "L again", "l", None), ("ashby", "A", "a.co", None),
               ("ashby", "E", "empty", None), ("ashby", "F", "full", None), ("ashby", "B", "bare", None), ("workable", "K", "k", None),
               ("workday", "W", None, "w.example.com"), ("elsewhere", "X", "l", None), (None, "Y", "l", None)]
    directory = rows("ordinal long, provider string, company string, token string, host string, path string, priority string",
                     *[(n, *e, "External", "High") for n, e in enumerate(entries)])
    facts = rows("url string, html string", ("https://x/l", "<p>python</p>"))
    landed = scan.Landed(payloads, answers, pages)
    result = scan.scan_directory(landed, directory, facts, scan.Profile(providers="all"), NOW)
    got = {r.title.split()[-1]: (r.company, r.provider, r.company_priority) for r in result.unique.collect()}
    assert got == {k: (c, p, "High") for k, c, p in (
        ("g", "G", "greenhouse"), ("l", "L", "lever"), ("slug", "A", "ashby"), ("answer", "E", "ashby"), ("full", "F", "ashby"),
        ("page", "B", "ashby"), ("k", "K", "workable"), ("w", "W", "workday"))}
    assert sorted(r.company for r in result.skipped.collect()) == ["X", "Y"]
    counts = {(r.stage, r.source, r.metric): r.n for r in result.diagnostics.collect()}
    assert counts["summary", None, "unique"] == counts["summary", None, "fetched"] == 8
    assert counts["fetched", "ashby", "raw"] == 4 and counts["fetched", "lever", "with_snippet"] == 1
    only = scan.scan_directory(landed, directory, facts, scan.Profile(providers="lever"), NOW)
    assert [r.title for r in only.unique.collect()] == ["Junior Developer l"]
    with pytest.raises(ValueError):
        scan.scan_directory(landed, directory, facts, scan.Profile(providers="none"), NOW)
    store = TableStore(spark, str(tmp_path / "s"))
    scan.save_run(result, scan.Profile(), store, NOW, pages=7)
    runs = {r.provider: r.jobs_discovered for r in store.read("crawl_runs").collect()}
    assert runs == {"greenhouse": 1, "lever": 1, "ashby": 4, "workable": 1, "workday": 1} and store.read("jobs").count() == 8


def test_skill_file_fills_profiles_without_own_skills(rows):
    file = rows("any_terms array<string>, all_terms array<string>", (["rust"], ["sql"]))
    assert scan.with_skill_file(scan.Profile(), file).skills_any == ("rust",) and scan.with_skill_file(scan.Profile(), file).skills_all == ("sql",)
    own = scan.Profile(skills_any=("go",))
    assert scan.with_skill_file(own, file) is own
    empty = rows("any_terms array<string>, all_terms array<string>", ([], []))
    assert scan.with_skill_file(scan.Profile(), empty) == scan.with_skill_file(scan.Profile(), empty.limit(0)) == scan.Profile()


def test_presets():
    assert scan.with_preset(scan.Profile(), "apply-now").recent_days == 14
    assert scan.with_preset(scan.Profile(recent_days=3, min_score=2), "apply-now").min_score == 2
    assert scan.with_preset(scan.Profile(), "research") == scan.Profile(recent_days=30)


def test_csv_cells(rows):
    df = rows("a string, t timestamp, n int", ("x", datetime(2025, 1, 2, 3, 4, 5), 1), (None, datetime(2025, 1, 2, 3, 4, 5, 250000), None))
    assert [tuple(r) for r in sinks.csv_projection(df, "t,a,b,n").collect()] == [
        ("2025-01-02T03:04:05", "x", "", "1"), ("2025-01-02T03:04:05.250000", "", "", "")]


def test_registered_queries():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 140
    assert set(base.QUERIES) == set(base.ORACLES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "company_name" in df.columns
