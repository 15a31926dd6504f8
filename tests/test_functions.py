"""Scalar functions and classifiers against hand-written expectations and plain Python."""

import re
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantia.functions import classify, dates, html, text
from vacantia.functions import fixed_values as V

NOW = "2025-09-18 15:30:00"


def apply(spark, values, expression):
    df = spark.createDataFrame([(n, *v) if isinstance(v, tuple) else (n, v) for n, v in enumerate(values)],
                               "n int, " + ", ".join(f"c{i} string" for i in range(
                                   len(values[0]) if isinstance(values[0], tuple) else 1)))
    return [r[0] for r in df.orderBy("n").select(expression.alias("x")).collect()]


ENTRY_CASES = [
    ("Senior Software Engineer", None, "exclude"),
    ("Software Engineer (L2)", "We need builders with 3+ years of experience.", "exclude"),
    ("Software Engineer", "Ideal candidate has 2+ years experience.", "keep"),
    ("Associate Software Engineer", None, "keep"),
    ("Lead Intern", None, "exclude"),
    ("New Grad Software Engineer", None, "keep"),
    ("Headless CMS Developer", "12 + yrs", "exclude"),
    ("Engineer", "003+ years", "exclude"),
    ("Engineer", "v3+ years, 2+ years", "keep"),
    ("Senioré Engineer", None, "keep"),
    ("  ", "9+ years", "keep"),
]


def test_entry_decision(spark):
    decided = apply(spark, [c[:2] for c in ENTRY_CASES],
                    classify.entry_decision(F.col("c0"), F.col("c1"))["decision"])
    assert decided == [c[2] for c in ENTRY_CASES]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123459+ yearsYRS.\n", max_size=14), min_size=40, max_size=40))
def test_three_plus_years_is_the_numeric_rule(spark, texts):
    wanted = [any(int(n) >= 3 for n in re.findall(V.PLUS_YEARS, t, re.I)) for t in texts]
    got = apply(spark, texts, classify.entry_decision(F.lit("Engineer"), F.col("c0"))["decision"] == "exclude")
    assert got == wanted


@pytest.mark.parametrize("name", [n for n in vars(V) if isinstance(getattr(V, n), str) and "\\b" in getattr(V, n)])
def test_patterns_agree_with_python(spark, name):
    samples = ["Senior Engineer", "senioré", "sr. dev", "new  grad", "SWE I", "engineer ii", "level 1", "≤ 3 years",
               "up to 3 yrs", "0–2 years of experience", "ten 4+ years", "four – six years", "Remote, USA", "u.s.",
               "remote in the united states", "Posted 3 days ago", "Sept 5, 2024", "2024-02-30", "data scientist",
               "ml engineer", "naïve staff", "VP", "pre-sales engineer", "l1", "hybrid", "3+ yrs", "13 + YEARS"]
    pattern = re.compile(getattr(V, name), re.I)
    got = apply(spark, samples, F.col("c0").rlike("(?iU)" + getattr(V, name)))
    assert got == [bool(pattern.search(s)) for s in samples]


def test_curated_dates(spark):
    cases = {
        "Sep 17": datetime(2025, 9, 17), "2025-09-14": datetime(2025, 9, 14), "3 days ago": datetime(2025, 9, 15),
        "1d": datetime(2025, 9, 17), "12h": datetime(2025, 9, 18), "2w": datetime(2025, 9, 4), "n/a": None,
        "Feb 30": None, "Dec 31": datetime(2024, 12, 31), "sept 1": datetime(2025, 9, 1), "": None,
        "Feb 29": None, "October 10": datetime(2025, 10, 10), "Oct 25": datetime(2024, 10, 25),
        "99999999999d": None,
    }
    assert apply(spark, list(cases), dates.curated_date(F.col("c0"), NOW)) == list(cases.values())


def test_dates_in_text(spark):
    cases = {
        "on 2024-03-05 and 3 days ago": datetime(2024, 3, 5), "2024-02-30, May 3, 2024": None,
        "Posted March 3 2024": datetime(2024, 3, 3), "posted about 2 days ago": datetime(2025, 9, 16, 15, 30),
        "12 days ago": datetime(2025, 9, 6, 15, 30), "Feb 31, 2024": None, "soon": None, "": None,
    }
    assert apply(spark, list(cases), dates.date_in_text(F.col("c0"), NOW)) == list(cases.values())


def test_iso_dates_drop_or_apply_the_offset(spark):
    texts = ["2025-09-15T10:00:00-04:00", "2025-09-15T10:00:00Z", "2025-09-15", "20250915", "2025-09-15 10:00",
             "2025-09-15T10", "soon", "2025-13-01", "2025-09-15T10:00:00.5+0200"]
    ten = datetime(2025, 9, 15, 10)
    assert apply(spark, texts, dates.iso_wall_clock(F.col("c0"))) == [
        ten, ten, datetime(2025, 9, 15), datetime(2025, 9, 15), ten, ten, None, None,
        datetime(2025, 9, 15, 10, 0, 0, 500000)]
    assert apply(spark, texts, dates.iso_utc(F.col("c0"))) == [
        datetime(2025, 9, 15, 14), ten, datetime(2025, 9, 15), datetime(2025, 9, 15), ten, ten, None, None,
        datetime(2025, 9, 15, 8, 0, 0, 500000)]


def test_board_dates(spark):
    pairs = [("Posted Today", "1700000000"), ("1700000000000", None), ("", "2025-09-15T00:00:00+02:00")]
    assert apply(spark, pairs, dates.workday_date(F.col("c0"), F.col("c1"))) == [
        datetime(2023, 11, 14, 22, 13, 20), datetime(2023, 11, 14, 22, 13, 20), datetime(2025, 9, 14, 22)]
    assert apply(spark, pairs, dates.lever_date(F.col("c0"), F.col("c1"))) == [
        datetime(1970, 1, 20, 16, 13, 20), datetime(2023, 11, 14, 22, 13, 20), datetime(2025, 9, 15)]
    assert apply(spark, [("bad", "2025-01-01"), ("", "2025-01-01")],
                 dates.ashby_date(F.col("c0"), F.col("c1"))) == [None, datetime(2025, 1, 1)]


def test_canonical_urls(spark):
    cases = {
        "http://a.example.com/x?utm_source=1#top": "https://a.example.com/x#top",
        "https://a.example.com/x?gh_jid=1&a=2&gh_jid=3": "https://a.example.com/x?gh_jid=3",
        "https://a.example.com?gh_jid": "https://a.example.com?gh_jid=",
        "https://a.example.com/x?gh_jid=a%20b~*": "https://a.example.com/x?gh_jid=a+b~%2A",
        "https://simplify.jobs/p/1?x=2": "https://simplify.jobs/p/1",
        "https://SIMPLIFY.jobs/jobs/1?x=2": None,
        "https://simplify.jobs/jobs/1?gh_jid=2": "https://simplify.jobs/jobs/1?gh_jid=2",
        "https://simplify.jobs": None,
        "https://simplify.jobs:443/c/Acme": "https://simplify.jobs:443/c/Acme",
        "/relative?x=1": "/relative",
    }
    assert apply(spark, list(cases), text.canonical_url(F.col("c0"))) == list(cases.values())


def test_names_and_places(spark):
    assert apply(spark, ["  ↳ *Acme  Co "], text.curated_company(F.col("c0"))) == ["Acme Co"]
    assert apply(spark, ["(Beta) Labs", "[x] y", "Ünïcode"], text.curated_company(F.col("c0"))) == [
        "(Beta) Labs", "[x] y", "Ünïcode"]
    assert apply(spark, ["", None, " US-Remote ", "A,  United States of America"],
                 text.canonical_location(F.col("c0"))) == [None, None, "Remote - US", "A, United States"]
    assert apply(spark, ["Sr.\tEngineer \n II"], text.normalize_title(F.col("c0"))) == ["Sr. Engineer II"]
    assert apply(spark, ["--A & B--", "É"], text.slugify(F.col("c0"))) == ["a-b", ""]


def test_level_words(spark):
    titles = ["Senior Engineer II", "Senior Engineer in Test", "Sr. Dev", "Developer L2", "Platform Staff", "Analyst"]
    assert apply(spark, titles, classify.infer_level(F.col("c0"))) == [
        "junior", "junior", "senior", "mid", "senior", None]


def test_junior_strict_and_relaxed(spark):
    cases = [
        ("Software Engineer I", "", True, True), ("Senior Engineer I", "new grad", False, False),
        ("Engineer II", "0-2 years", False, True), ("Engineer II", "python", False, False),
        ("Engineer III", "entry level", False, False), ("Engineer III", "2 years", False, True),
        ("Developer", "5+ years", False, False), ("Developer", "work with senior staff", False, False),
        ("Developer", "junior, works with senior staff", False, True), ("Developer", "≤ 3 years", False, True),
        ("Developer", "python", False, False), ("Developer, 2 years", None, True, True),
    ]
    pairs = [c[:2] for c in cases]
    assert apply(spark, pairs, classify.is_junior(F.col("c0"), F.col("c1"))) == [c[2] for c in cases]
    assert apply(spark, pairs, classify.is_junior(F.col("c0"), F.col("c1"), relaxed=True)) == [c[3] for c in cases]


def test_remote_us(spark):
    cases = [
        ("Remote - US", None, True), ("Remote, Canada", "remote usa", False), ("Milwaukee, remote", None, False),
        ("Remote in Canada or USA", None, True), ("Office", "remote, united states", True), (None, None, False),
        ("Remote", "Remote within the USA", True),
    ]
    assert apply(spark, [c[:2] for c in cases], classify.is_remote_us(F.col("c0"), F.col("c1"))) == [
        c[2] for c in cases]


def test_curated_us(spark):
    places = ["Remote", "Remote in Canada", "NYC, US", "Austin (US)", "Berlin", "Remote - Indiana", "U.S.A. only"]
    assert apply(spark, places, classify.is_curated_us(F.col("c0"))) == [
        True, False, True, True, False, False, True]


def test_visible_providers():
    assert classify.visible_providers() == ["github", "greenhouse"]
    assert "ashby" in classify.visible_providers(True) and "workable" not in classify.visible_providers(True)


def test_provider_choices():
    assert classify.provider_choices() == ["all", "greenhouse", "github"]
    assert classify.provider_choices(True) == ["all", "greenhouse", "github", "ashby", "workday", "lever"]


def test_directory_stub_placeholders(spark):
    pages = ["see myworkdayjobs.com at x.myworkdayjobs.com", "jobs.ashbyhq.com", "boards.greenhouse.io", "nothing"]
    board = classify.detect_board(F.col("c0"), F.lit(None))
    assert apply(spark, pages, classify.directory_stub(board, F.lit(None).cast("string"))) == [
        '{"company":"<NAME>","ats":"workday","host":"<HOST>.myworkdayjobs.com","path":"<PATH>","priority":"High"}',
        '{"company":"<NAME>","ats":"ashby","token":"<TOKEN>","priority":"High"}', None, None]


def test_page_text(spark):
    page = ("<html><head><title>T &amp; x</title><style>p{}</style></head><body><p>a < b</p><!-- no -->"
            "<script>var t='</p>';</script><ul><li>one<li>two</ul>caf&eacute;<br>end</body>")
    assert apply(spark, [page, "", "<p> </p>", None], html.page_text(F.col("c0"))) == [
        "T & x a < b one two café end", None, None, None]
    assert apply(spark, ["<p>abc   def</p>"], html.snippet(F.col("c0"), 6)) == ["abc de"]


def test_page_posting_date(spark):
    block = '<script type="application/ld+json">{}</script>'
    pages = [
        block.format('{"@type":"Org"}') + block.format('[{"@type":"X"},{"@type":"Posting","datePublished":" 2025-01-02 "}]'),
        block.format("broken") + block.format('{"@type":"JobPosting","datePosted":"","dateCreated":"2024-05-06"}'),
        "<p>none</p>", None,
    ]
    assert apply(spark, pages, dates.page_posting_date(F.col("c0"))) == ["2025-01-02", "2024-05-06", None, None]


def test_matched_terms_and_labels(spark):
    assert apply(spark, ["rapid sql"], text.matched_terms(F.col("c0"), ["sql", "api", "go"])) == [["api", "sql"]]
    assert apply(spark, ["a"], text.matched_terms(F.col("c0"), [])) == [[]]
    assert apply(spark, ["unknown", None, "MID"], text.display_level(F.col("c0"))) == ["Junior", "Junior", "Mid"]
