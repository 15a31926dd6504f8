"""Parsers of landed payloads, pages, lists and directories."""

import json
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from vacantia.functions import html
from vacantia.functions.text import list_column
from vacantia.operators.filters import entry_filter_at_ingest
from vacantia.plans.curated import curated_batch
from vacantia.sources import board_pages, boards, curated, directory, greenhouse_budget, registry
from vacantia.sources.snippets import attach_snippets, read_pages

LANDED = "payload_id long, token string, company string, host string, path string, body string"


def landed(rows, *bodies, token="acme", host="h.example.com"):
    return rows(LANDED, *[(n, token, "Acme  Inc", host, "External", json.dumps(b)) for n, b in enumerate(bodies)])


def test_boards_skip_rows_without_token(rows):
    assert boards.greenhouse(landed(rows, {"jobs": [{"title": "x"}]}, token="")).count() == 0
    assert boards.workday(landed(rows, {"jobPostings": [{"title": "x"}]}, host=None)).count() == 0


def test_ashby_shapes(rows):
    item = {"title": "Engineer", "url": "https://a/1"}
    df = boards.ashby(landed(rows, [item], {"jobPostings": [], "jobs": [item]}, {"jobPostings": [item]}, {"x": 1}, "no"))
    assert df.count() == 3


def test_broken_payloads_give_nothing(rows):
    df = rows(LANDED, (0, "t", "A", "h", "p", "{broken"), (1, "t", "A", "h", "p", None))
    for parser in (boards.greenhouse, boards.lever, boards.workday, boards.ashby):
        assert parser(df).count() == 0


def test_snippets_under_a_budget(spark, rows):
    body = {"jobs": [{"absolute_url": f"https://b/{n}", "title": t} for n, t in enumerate(
        ["Senior Engineer", "Recruiter", "Software Engineer I", "Junior Developer", "Chef"])]}
    pages = rows("url string, html string", *[(f"https://b/{n}", f"<p>page {n} 3+ years</p>") for n in range(5)],
                 ("https://b/x", "<p>other</p>"))
    got = registry.fetch("greenhouse", landed(rows, body), read_pages(pages), cap=2)
    with_text = {r.title for r in got.filter("description_snippet IS NOT NULL").collect()}
    assert with_text == {"Software Engineer I", "Junior Developer"} and got.count() == 5
    assert {r.title for r in entry_filter_at_ingest(got).collect()} == {"Recruiter", "Chef"}
    plain = attach_snippets(boards.greenhouse(landed(rows, body)), read_pages(pages), cap=2)
    assert {r.title for r in plain.filter("description_snippet IS NOT NULL").collect()} == {
        "Senior Engineer", "Recruiter"}


def test_page_dates_stop_with_the_budget(rows):
    ld = '<script type="application/ld+json">{"@type":"JobPosting","datePosted":"2025-01-0%d"}</script><p>x</p>'
    body = {"jobs": [{"absolute_url": f"https://b/{n}", "title": "Engineer" + "x" * n} for n in range(3)]}
    pages = rows("url string, html string", *[(f"https://b/{n}", ld % (n + 1)) for n in range(3)])
    got = greenhouse_budget.attach_budgeted(boards.greenhouse(landed(rows, body)), read_pages(pages), cap=2)
    assert [r.posted_at for r in got.orderBy("seq").collect()] == [datetime(2025, 1, 1), datetime(2025, 1, 2), None]


def test_whole_page_text_dates_rows(rows):
    pages = rows("url string, html string", ("https://b/1", "<p>" + "word " * 400 + "on 2024-05-06</p>"))
    facts = read_pages(pages, "2025-01-01 00:00:00").first()
    assert facts.text_date == datetime(2024, 5, 6) and len(facts.snippet) == 1200


def test_board_page_links_prefer_stronger_finds(rows):
    page = ('<a href="/acme/job/1">One</a><script id="__NEXT_DATA__">{"a":{"jobUrl":"/acme/job/2","title":"Two"}}</script>'
            '<script>{"jobPostingUrl":"https://jobs.ashbyhq.com/acme/job/1","title":"Other"}</script>'
            r'"jobPostingUrl":"acme\/job\/3"')
    got = board_pages.ashby_links(rows("page_id long, token string, html string", (7, "acme", page)))
    assert [(r.title, r.url.rsplit("/", 1)[-1]) for r in got.orderBy("pos").collect()] == [
        ("", "3"), ("Two", "2"), ("One", "1")]


def test_workable_location_fallbacks(rows):
    page = ('<div><a href="/t/j/1">A</a><p class="big location">Austin</p></div><div><a href="/jobs/2">B</a>'
            '<span>Fully REMOTE</span></div><div><a href="/about">C</a></div>')
    got = board_pages.workable(rows("page_id long, token string, company string, url string, html string",
                                    (1, "t", None, "https://t.workable.com/", page)))
    assert [(r.title, r.url, r.location, r.company) for r in got.orderBy("seq").collect()] == [
        ("A", "https://t.workable.com/t/j/1", "Austin", "t"), ("B", "https://t.workable.com/jobs/2", "Fully REMOTE", "t")]


def lists(rows, *docs):
    return rows("source_idx long, md string", *enumerate(docs))


TABLE = "| Company | Role | Location | Date | Apply |\n|---|---|---|---|---|\n"


def test_markdown_date_is_scraped_or_falls_back(rows):
    row = "| ExampleCo | New Grad SWE | Remote - US | {} | [Apply](https://example.com) |\n"
    scraped = curated_batch(lists(rows, TABLE + row.format("2025-09-15")), "2025-09-30 10:00:00", scrape=True).first()
    assert scraped.posted_at == datetime(2025, 9, 15)
    fallback = curated_batch(lists(rows, TABLE + row.format("")), "2025-09-30 10:00:00", scrape=True).first()
    assert fallback.posted_at == datetime(2025, 9, 30) and fallback.date_origin == "fallback"


def test_markdown_grids(rows):
    doc = ("text | pipe\nCompany | Role\n\n|:--|---:|\n| A | B | C |\n| D |\nend\n" + TABLE + "| x |\n")
    grid = curated.markdown_grid(lists(rows, doc)).orderBy("table_idx", "row_idx").collect()
    assert [(g.table_idx, g.header, g.cells) for g in grid] == [
        (0, ["Company", "Role"], ["A", "B", "C"]), (0, ["Company", "Role"], ["D", ""]),
        (1, ["Company", "Role", "Location", "Date", "Apply"], ["x", "", "", "", ""])]


def test_bullets_only_without_table_rows(rows):
    bullet = "- [Beta — Dev](https://b.example.com/1)\n* [Solo](https://b.example.com/2)\n3. [G - H - I](https://b.example.com/3)\n"
    row = "| A | B | Remote | | [Apply](https://a.example.com/1) |\n"
    got = curated.gated_rows(lists(rows, TABLE + row + bullet, bullet), only_remote=False, us_only=False)
    assert sorted((r.source_idx, r.company, r.title) for r in got.collect()) == [
        (0, "A", "B"), (1, "Beta", "Dev"), (1, "G", "H - I"), (1, "Solo", "Solo")]


def test_first_url_wins_after_the_gates(rows):
    row = "| {} | Dev | {} | | [Apply](https://a.example.com/1?utm=2) |\n"
    docs = lists(rows, TABLE + row.format("Abroad", "Remote in Canada"), TABLE + row.format("Home", "Remote US"))
    assert [r.company for r in curated.first_per_url(curated.gated_rows(docs)).collect()] == ["Home"]


def test_html_table_without_th(rows):
    doc = ('<TABLE><tr><td>Company</td><td>Position</td><td>Location</td></tr><tr><td>↳ Acme</td>'
           '<td><a href="https://x/1">Info</a> Dev</td><td>Remote <b>US</b><a href="https://x/2">Apply</a></td></tr></TABLE>')
    got = curated.html_rows(lists(rows, doc)).first()
    assert (got.company, got.title, got.location, got.url) == ("Acme", "Info Dev", "Remote US Apply", "https://x/2")


def test_header_words(spark, rows):
    df = rows("h array<string>", (["Updated", "Last Update", "Language"],))
    assert df.select(list_column(F.col("h"), "date"), list_column(F.col("h"), "url")).first()[:] == (0, None)


def test_directory_and_skill_files(spark, tmp_path):
    entries = [{"name": "A", "ats": " Lever ", "board_token": "a"}, {"company": "B", "source": "workday", "domain": "b.com"},
               {"org": "C"}]
    (tmp_path / "companies.json").write_text(json.dumps(entries, indent=1))
    got = directory.read_directory(spark, str(tmp_path / "companies.json")).orderBy("ordinal").collect()
    assert [(r.provider, r.company, r.token, r.host, r.path) for r in got] == [
        ("lever", "A", "a", None, "External"), ("workday", "B", None, "b.com", "External"),
        (None, "C", None, None, "External")]
    (tmp_path / "one.json").write_text(json.dumps(entries[0]))
    assert directory.read_directory(spark, str(tmp_path / "one.json")).count() == 1
    (tmp_path / "skills.json").write_text('{\n "any": [" Python", ""],\n "skills_all": "a, ,B"}')
    skills = directory.read_skills(spark, str(tmp_path / "skills.json")).first()
    assert (skills.any_terms, skills.all_terms) == (["python"], ["a", "b"])


def test_enabled_sources():
    assert directory.enabled_sources("ALL") == directory.enabled_sources("*") == list(
        ("greenhouse", "lever", "workday", "ashby", "workable"))
    assert directory.enabled_sources(" Lever, ashby ") == ["lever", "ashby"]


def test_arrival_numbers_hold_any_payload_id_and_position(rows):
    ids = [-2 ** 63, -1, 0, 2 ** 43, 2 ** 43 + 1, 2 ** 63 - 1]
    body = json.dumps([{"title": f"Engineer {n}", "url": f"https://a/{n}"} for n in range(3)])
    df = boards.ashby(rows(LANDED, *[(i, "t", "A", "h", "p", body) for i in ids]))
    got = [(r.title, r.seq) for r in df.orderBy("seq").collect()]
    assert [t for t, _ in got] == [f"Engineer {n}" for _ in ids for n in range(3)]
    assert [s for _, s in got] == [i * 2 ** 31 + n for i in ids for n in range(3)]


def test_list_rows_are_numbered_whatever_their_source(rows):
    row = "| ExampleCo | New Grad SWE | Remote - US | | [Apply](https://example.com/{}) |\n"
    docs = rows("source_idx long, md string", *[(i, TABLE + row.format(f"{i}a") + row.format(f"{i}b")) for i in (2 ** 62, 3)])
    got = curated_batch(docs, "2025-09-30 10:00:00").orderBy("seq").collect()
    assert [(r.seq, r.url[-2:]) for r in got] == [(1, "3a"), (2, "3b"), (3, "4a"), (4, "4b")]


def test_board_links_of_odd_tokens_and_pages(rows):
    token = r"a.b+\E"
    pages = [(1, token, f'x "{token}/job/7" <!-- <script>{{"jobUrl":"/{token}/job/8"}}</script> --> <a href=" /{token}/job/9?x#y ">N <i>ine</i></a>'),
             (2, token, None), (3, token, ""), (4, "", '"/job/1"'), (5, "azb", '"a.b/job/7"')]
    got = board_pages.ashby_links(rows("page_id long, token string, html string", *pages)).collect()
    assert [(r.slug, r.title, r.url[-4:]) for r in sorted(got, key=lambda r: r.pos)] == [
        ("9", "N ine", "?x#y"), ("7", "", "ob/7"), ("8", "", "ob/8"), ("9", "", "ob/9")]
    assert {r.page_id for r in got} == {1}


def test_text_reader_equals_the_tree():
    import random

    from vacantia.functions.html import parse, visible_text
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<br>", "<br/>", "<div class='a'>", "</div>", "<script>", "</script>", "<style>", "</style>", "<template>",
             "</template>", " text ", "a&amp;b", "&lt;", "<!-- c -->", "</span>", "<b>", "</b>", "\n", "<img src=x>", "<!doctype html>", "&#x41"]
    for _ in range(3000):
        page = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert visible_text(page) == parse(page).text(), page


def test_pages_of_a_batch_become_python_objects_a_slice_at_a_time(spark):
    batch = pa.record_batch({"page_id": pa.array([*range(599), None], pa.int64()), "html": [None, *(f"<p>é{n}</p>" for n in range(599))]})
    slices = list(html.records([batch, batch.slice(0, 0)]))
    assert [len(s) for s in slices] == [256, 256, 88]
    assert [tuple(r) for s in slices for r in s] == list(zip(*(c.to_pylist() for c in batch.columns)))
    pages = spark.range(600).coalesce(1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("<p>a<b>"), "id", F.lit("</b></p>"))).alias("html"))
    assert [r.t for r in pages.orderBy("id").select(html.page_text(F.col("html")).alias("t")).collect()] == [
        f"a {n}" if n % 7 else None for n in range(600)]
    large = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("html"))
    sizes = large.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < 20 << 20
