"""Skewed inputs give whole results, and plans have the shape that keeps them cheap."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from queries.base import incoming
from vacantia.operators import aggregates, joins, maintenance, quotas, ranking, scoring, upsert
from vacantia.plans.browse import Search, browse
from vacantia.sources import board_pages, curated, snippets
from vacantia.session import cut_lineage
from vacantia.sources.tables import TableStore

NOW = "2025-09-18 15:30:00"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """Postings of which two thirds are copies of one, from one source."""
    hot = F.col("seq") % 3 != 0
    return spark.range(6000).withColumnRenamed("id", "seq").select(
        "seq", F.when(hot, "Junior Developer").otherwise(F.concat(F.lit("Engineer "), "seq")).alias("title"),
        F.when(hot, "Acme").otherwise(F.concat(F.lit("C"), F.col("seq") % 7)).alias("company"),
        F.when(hot, "https://a/1").otherwise(F.concat(F.lit("https://a/x"), "seq")).alias("url"),
        F.when(hot, "lever").otherwise("ashby").alias("source"), F.lit("Remote - US").alias("location"),
        F.lit(None).cast("timestamp").alias("posted_at"), F.lit(None).cast("string").alias("description_snippet"),
        F.lit(None).cast("string").alias("level"))


def test_skewed_ranks_and_duplicates(skewed):
    ranked = ranking.number_rows(scoring.score(skewed, ["junior"]), "rank", leading=F.col("skill_score"))
    assert ranked.select(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()[:] == (6000, 1, 6000)
    assert "Window" not in plan_of(ranked) and "SortAggregate" not in plan_of(ranking.deduplicate(skewed))
    unique = ranking.deduplicate(skewed)
    assert unique.count() == 2001
    hot = unique.filter("title = 'Junior Developer'").first()
    assert (hot.position, hot.seq) == (1, 5999)


def test_skewed_upsert(spark, skewed):
    empty = [spark.createDataFrame([], s) for s in (upsert.JOBS, upsert.COMPANIES, upsert.JOB_SKILLS)]
    batch = skewed.select("seq", F.col("source").alias("provider"), F.col("url").alias("external_id"), "url", "title", "company")
    result = upsert.upsert(*empty, batch, NOW)
    assert result.jobs.agg(F.count("id"), F.max("id")).first()[:] == (2001, 2001)
    assert result.rejects.isEmpty() and result.companies.count() == 8


def test_windows_are_limited_before_the_shuffle(spark, skewed, rows):
    for df in (
        quotas.quota_candidates(skewed, NOW),
        curated.first_per_url(skewed.select(F.col("url").alias("row_url"), F.lit(0).alias("source_idx"),
                                            F.lit(0).alias("parser_idx"), F.col("seq").alias("row_idx"))),
        snippets.choose_snippets(skewed.withColumn("token", F.col("company")),
                                 rows("url string, snippet string", ("https://a/1", "x")), [F.col("seq")]),
    ):
        plan = plan_of(df)
        assert "WindowGroupLimit" in plan and plan.index("Partial") > 0
    assert quotas.quota_candidates(skewed, NOW).count() == 60


def test_no_cross_joins_and_no_python_in_the_hot_path(spark, skewed, rows):
    jobs = rows("id long, provider string, company_id long, title string, url string, posted_at timestamp, "
                "updated_at timestamp, active boolean, description string, level string, is_remote boolean")
    companies = rows("id long, name string, slug string")
    skills = rows("job_id long, skill string")
    page = browse(jobs, companies, skills, Search(entry_only=True, skills_any="sql"), NOW).items
    for df in (page, ranking.deduplicate(skewed), aggregates.ingestion_metrics(jobs), maintenance.cleanup(jobs)):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "EvalPython" not in plan
    assert "LeftSemi" in plan_of(page) and "TakeOrderedAndProject" in plan_of(page)


def test_filters_reach_the_stored_files(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    layouts = {"jobs": upsert.JOBS, "companies": upsert.COMPANIES, "job_skills": upsert.JOB_SKILLS}
    row = (1, "github", "x", "u", 1, "Dev", None, True, "mid", None, None, True, None, None, None, None)
    store.write({n: spark.createDataFrame([row] if n == "jobs" else [], s) for n, s in layouts.items()}, NOW)
    found = browse(*[store.read(n) for n in layouts], Search(level="mid", days=14, remote=True), NOW).items
    plan = plan_of(found)
    scan = next(part for part in plan.split("\n\n") if "provider" in part and "PushedFilters" in part)
    assert "PartitionFilters" in scan and "EqualTo(level,mid)" in scan and "GreaterThanOrEqual(posted_at" in scan
    assert "description" not in scan.split("ReadSchema")[1]


def test_backfill_moves_only_rows_it_may_change(rows):
    jobs = rows("id long, provider string, external_id string, posted_at timestamp, description string")
    plan = plan_of(joins.apply_backfill(jobs, rows("external_id string, posted_at timestamp, seq long")))
    assert "Union" in plan and plan.count("provider#") > 0


def test_documents_and_bodies_stay_out_of_shuffles(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = cut_lineage(rows("source_idx long, md string", (0, "- [Acme - Engineer](https://a.example.com/1)")))
        landed = "payload_id long, page_id long, token string, company string, html string, path string, body string"
        plans = [plan_of(curated.gated_rows(lists, only_remote=False, us_only=False)),
                 plan_of(board_pages.ashby_with_fallback(*[cut_lineage(rows(landed, (n, n, "t", "Acme", None, None, "{}"))) for n in range(3)]))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        moved = re.findall(r"\) Exchange[^\n]*\nInput[^\n]*", plan)
        assert moved and not any(re.search("(md|body|html)#", part) for part in moved), plan


def copied(monkeypatch, *modules):
    """The schemas of the copies that the modules write from now on."""
    seen = []
    for module in modules:
        monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(df.schema) or cut_lineage(df))
    return seen


def test_batch_is_numbered_before_its_texts_are_made(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT id div 3 AS l_orderkey, CAST(id % 3 + 1 AS INT) AS l_linenumber, id AS l_partkey, id % 7 AS l_suppkey,
                 TIMESTAMP_NTZ '2001-01-01 00:00:00' AS l_shipdate, 'x' AS l_comment FROM range(30)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = copied(monkeypatch, ranking)
    rows = incoming(spark, str(tmp_path)).orderBy("seq").collect()
    assert seen and not [f.name for schema in seen for f in schema if f.dataType.simpleString() == "string"]
    assert [r.seq for r in rows] == list(range(1, 31))
    assert (rows[4].external_id, rows[4].title, rows[4].url) == ("x1", None, "https://boards.example.com/u/1")


def test_insert_only_writes_no_second_copy_of_the_batch(spark, monkeypatch):
    batch = spark.sql("""SELECT id AS seq, 'lever' AS provider, CAST(id div 2 AS STRING) AS external_id, 'T' AS title, 'u' AS url,
                         concat('Co ', id % 3) AS company FROM range(12)""")
    jobs = spark.sql("SELECT 5L AS id, 'lever' AS provider, '1' AS external_id")
    companies = spark.sql("SELECT 9L AS id, 'Co 0' AS name, 'co-0' AS slug")
    seen = copied(monkeypatch, upsert)
    result = upsert.insert_only(jobs, companies, batch, "2001-08-01 00:00:00")
    assert not [schema for schema in seen if "reason" in schema.names]
    assert sorted((r.id, r.external_id) for r in result.jobs.collect()) == [(6, "0"), (7, "2"), (8, "3"), (9, "4"), (10, "5")]
    assert sorted(r.seq for r in result.rejects.collect()) == [1, 2, 3, 5, 7, 9, 11]
