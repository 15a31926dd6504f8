"""Predicates and filters.  Predicates are columns, so Catalyst sees one conjunction."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import classify
from vacantia.functions import fixed_values as V
from vacantia.functions.dates import within_days
from vacantia.functions.exprs import as_timestamp, contains_any, filled, matches, not_blank, strip, text


def keeps_basic(junior_only: bool = False, us_remote_only: bool = False) -> Column:
    """The run's basic test over title and location.

    Without either flag any non-blank title passes.  ``junior_only`` only blocks senior words:
    neutral engineering titles pass as well as junior ones.
    """
    if not junior_only and not us_remote_only:
        return not_blank(F.col("title"))
    ok = classify.is_engineering(F.col("title"))
    if junior_only:
        return ok & ~contains_any(F.lower(text(F.col("title"))), V.BASIC_SENIOR_MARKERS)
    place = F.lower(text(F.col("location")))
    return ok & ((place == "") | (place.contains("remote") & place.contains("us")) |
                 (place.contains("remote") & place.contains("united states")))


def keeps_recent(days: int, as_of, require_date: bool = False) -> Column:
    """Run recency: undated rows pass unless a date is required; 0 days is no filter."""
    if not days:
        return F.lit(True)
    recent = within_days(F.col("posted_at"), days, as_of)
    return recent if require_date else recent | F.col("posted_at").isNull()


def posted_since(days: int | None, as_of) -> Column | None:
    """Query recency: undated rows fail; no or non-positive days is no filter."""
    if days is None or days <= 0:
        return None
    return F.col("posted_at").isNotNull() & (
        F.col("posted_at") >= as_timestamp(as_of) - F.make_dt_interval(F.lit(days)))


def provider_gate(provider: str | None = None, experimental: bool = False) -> Column:
    """An explicit provider, else the visible ones; ``all`` is no explicit provider."""
    if provider and provider.lower() != "all":
        return F.col("provider") == provider
    return F.col("provider").isin(*classify.visible_providers(experimental))


def equality(level: str | None = None, remote: bool | None = None, company: str | None = None,
             us_remote_only: bool = False) -> list[Column]:
    """Conjuncts for the arguments that are set; ``company`` is a slug."""
    tests = []
    if us_remote_only:
        tests.append(F.col("is_remote"))
    if level:
        tests.append(F.col("level") == level)
    if remote is not None:
        tests.append(F.col("is_remote") == F.lit(remote))
    if company:
        tests.append(F.col("company_slug") == company)
    return tests


def keyword(q: str) -> Column:
    """Case-insensitive LIKE on title or company name; % and _ in ``q`` are wildcards."""
    return F.col("title").ilike(f"%{q}%") | F.col("company_name").ilike(f"%{q}%")


def passes_entry_terms() -> Column:
    """Coarse entry test: no listed title substring, no "N+ ... year" LIKE pattern.

    Two regular expressions say the same as one LIKE per number of years and wording: the
    number, a plus sign directly or after one space, then year or yrs anywhere later.
    """
    title, body = F.lower(F.col("title")), F.lower(text(F.col("description")))
    numbers = "|".join(str(n) for n in V.ENTRY_LIKE_YEARS)
    years = body.contains("+") & body.rlike(rf"(?s)(?:{numbers}) ?\+.*(?:year|yrs)")
    return ~contains_any(title, V.ENTRY_TITLE_TERMS) & ~years


def keeps_entry_level() -> Column:
    """Entry decision by title and description or snippet."""
    return classify.entry_decision(F.col("title"), F.col("description"))["decision"] == "keep"


def entry_filter(jobs: DataFrame) -> DataFrame:
    """Query-time entry filter: the coarse terms and the decision."""
    return jobs.filter(passes_entry_terms() & keeps_entry_level())


def entry_filter_at_ingest(postings: DataFrame) -> DataFrame:
    """Ingest-time entry filter: the decision alone, over the snippet."""
    decision = classify.entry_decision(F.col("title"), F.col("description_snippet"))["decision"]
    return postings.filter(decision == "keep")


def include_undated(include: bool = True) -> Column:
    return F.lit(True) if include else F.col("posted_at").isNotNull()


def saveable() -> Column:
    """Company, source, url and title all filled."""
    ok = not_blank(F.col("company"))
    for name in ("source", "url", "title"):
        ok = ok & not_blank(F.col(name))
    return ok


def split_saveable(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return postings.filter(saveable()), postings.filter(~saveable())


def min_score(scored: DataFrame, threshold: int = 0) -> DataFrame:
    return scored.filter(F.col("skill_score") >= threshold) if threshold > 0 else scored


def rule_set(rules: dict) -> Column:
    """A rules dictionary as one predicate over title, company, location and description_snippet.

    Any include title and any include keyword must match where given; no exclude title may match
    and the company must not be excluded.  junior_only and us_remote_only add those tests.
    """
    title, body = F.col("title"), F.col("description_snippet")

    def any_of(column, patterns):
        return matches(column, "(?:" + "|".join(patterns) + ")")

    ok = F.lit(True)
    if rules.get("include_titles"):
        ok = ok & any_of(title, rules["include_titles"])
    if rules.get("exclude_titles"):
        ok = ok & ~any_of(title, rules["exclude_titles"])
    if rules.get("include_keywords_any"):
        hay = F.lower(F.concat_ws(" ", text(title), text(body)))
        ok = ok & contains_any(hay, [k.lower() for k in rules["include_keywords_any"]])
    if rules.get("exclude_companies"):
        ok = ok & ~F.lower(strip(text(F.col("company")))).isin(*[c.lower() for c in rules["exclude_companies"]])
    if rules.get("junior_only"):
        ok = ok & classify.is_junior(title, body, relaxed=True)
    if rules.get("us_remote_only"):
        ok = ok & classify.is_remote_us(F.col("location"), body)
    return ok


def with_remote_flag(postings: DataFrame) -> DataFrame:
    """Remote flag as stored with a saved posting."""
    return postings.withColumn(
        "is_remote", classify.is_remote_us(filled(F.col("location")), filled(F.col("description_snippet"))))
