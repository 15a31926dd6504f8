"""Classifiers over title, description and location, as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import contains_any, filled, matches, not_blank, strip, text


def infer_level(title: Column, description: Column | None = None) -> Column:
    """junior, senior, mid or null; junior phrases win, then senior ones."""
    t = F.lower(text(title))
    junior = contains_any(t, V.LEVEL_JUNIOR_TITLE)
    if description is not None:
        junior = junior | contains_any(F.lower(text(description)), V.LEVEL_JUNIOR_DESC)
    return (
        F.when(junior, "junior")
        .when(contains_any(t, V.LEVEL_SENIOR_TITLE), "senior")
        .when(contains_any(t, V.LEVEL_MID_TITLE), "mid")
    )


def curated_level(value: Column) -> Column:
    return F.when(contains_any(F.lower(text(value)), V.CURATED_JUNIOR_HINTS), "junior").otherwise("unknown")


def is_engineering(title: Column) -> Column:
    """Names a software role; other engineer kinds count only next to a software hint."""
    return matches(title, V.CORE_SWE_HINTS) | (
        matches(title, V.GENERIC_ENGINEER) & ~matches(title, V.NON_SWE_ENGINEER))


def _names_years(value: Column, pattern: str) -> Column:
    """Search for a number of years, only in texts that name years at all."""
    low = F.lower(text(value))
    return (low.contains("year") | low.contains("yr")) & matches(value, pattern)


def is_junior(title: Column, description: Column, relaxed: bool = False) -> Column:
    """Junior by title, or with ``relaxed`` by what the description says."""
    blocked = matches(title, V.SENIOR_BLOCK)
    by_title = matches(title, V.JUNIOR_TITLE) | _names_years(title, V.YEARS_0_TO_3)
    if not relaxed:
        return ~blocked & ~matches(title, V.ENGINEER_L2) & ~matches(title, V.LEVEL_THREE) & by_title
    body = F.lower(text(description))
    few_years = _names_years(body, V.YEARS_0_TO_3)
    phrase = contains_any(body, V.JUNIOR_DESC_POSITIVES)
    return (
        F.when(blocked, False)
        .when(matches(title, V.ENGINEER_L2) & ~(few_years | phrase), False)
        .when(matches(title, V.LEVEL_THREE) & ~few_years, False)
        .when(by_title, True)
        .when(_names_years(body, V.DESC_4PLUS_YEARS), False)
        .when(matches(body, V.DESC_SENIOR_WORDS) & ~phrase, False)
        .otherwise(phrase | few_years)
    )


def is_remote_us(location: Column, description: Column) -> Column:
    """Remote and in the US; the location decides first, then the description."""
    def verdict(value):
        t = F.lower(text(value))
        remote, us = t.contains("remote"), contains_any(t, V.US_MARKERS)
        return F.when(remote & us, True).when(remote & contains_any(t, V.NON_US_MARKERS), False)
    return F.coalesce(verdict(location), verdict(description), F.lit(False))


def is_curated_remote(location: Column, title: Column) -> Column:
    return contains_any(F.lower(text(location)), V.CURATED_REMOTE_HINTS) | F.lower(text(title)).contains("remote")


def is_curated_us(location: Column) -> Column:
    """US-friendly: no foreign region named, and a US token or plain remote."""
    low = F.lower(text(location))
    words = F.regexp_replace(low, "[^a-z]+", " ")
    friendly = words.rlike(V.CURATED_US_TOKENS) | low.rlike(V.CURATED_US_PUNCTUATED) | low.contains("remote")
    return ~contains_any(low, V.CURATED_UNWANTED_REGIONS) & friendly


def entry_decision(title: Column, description: Column, snippet: Column | None = None) -> Column:
    """Struct (decision, reason); the snippet is read where the description is empty."""
    body = text(description) if snippet is None else F.coalesce(filled(description), text(snippet))
    # A plain search stays inside generated code, where extracting and casting the numbers would not;
    # texts without a plus sign skip it.
    many_years = body.contains("+") & matches(body, V.PLUS_3_YEARS)

    def outcome(decision, reason):
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    return (
        F.when(~not_blank(title), outcome("keep", "no-title"))
        .when(matches(title, V.ENTRY_EXCLUSION_TITLE), outcome("exclude", "title-senior-term"))
        .when(many_years, outcome("exclude", "description-3plus-years"))
        .when(matches(title, V.ENTRY_INCLUSION_TITLE), outcome("keep", "title-junior-term"))
        .otherwise(outcome("keep", "default"))
    )


def visible_providers(experimental: bool = False) -> list:
    shown = {"supported", "experimental"} if experimental else {"supported"}
    return sorted(name for name, status in V.PROVIDER_STATUS.items() if status in shown)


def provider_choices(experimental: bool = False) -> list:
    """Values of a provider filter: ``all``, the supported ones, then the experimental ones if asked for."""
    def named(wanted):
        return [name for name, status in V.PROVIDER_STATUS.items() if status == wanted]
    return ["all", *named("supported"), *(named("experimental") if experimental else [])]


def is_provider_visible(provider: Column, experimental: bool = False) -> Column:
    return F.coalesce(provider.isin(*visible_providers(experimental)), F.lit(False))


def is_title_eligible(title: Column, junior_only: bool, block_misfit: bool = True) -> Column:
    """The stricter, earlier title rule."""
    ok = matches(title, V.STRICT_ENGINEERING) & ~matches(title, V.STRICT_SENIOR) & ~matches(title, V.STRICT_NON_ENG)
    if block_misfit:
        ok = ok & ~matches(title, V.STRICT_MISFIT)
    if junior_only:
        ok = ok & matches(title, V.STRICT_JUNIOR_TITLE)
    return ok


def is_remote_by_page(page: Column, location: Column, us_only: bool = False, exclude_hybrid: bool = False) -> Column:
    """The earlier remote rule over page text and a location hint."""
    place = strip(text(location))
    blocked = matches(place, V.COUNTRY_BLOCK)
    if exclude_hybrid:
        blocked = blocked | matches(place, V.HYBRID_FLAG)
    if not us_only:
        return ~blocked & (matches(place, V.REMOTE_FLAG) | matches(page, V.REMOTE_FLAG))
    by_page = matches(page, V.REMOTE_FLAG) & matches(page, V.US_FLAG)
    if exclude_hybrid:
        by_page = by_page & ~matches(page, V.HYBRID_FLAG)
    return ~blocked & F.when(place == "", by_page).otherwise(matches(place, V.LOCATION_US_REMOTE))


def suggests_junior(page_text: Column) -> Column:
    low = F.lower(text(page_text))
    return matches(low, V.RELAX_PHRASES) | contains_any(low, V.RELAX_YEAR_HINTS)


def detect_board(page: Column, page_url: Column, headers: bool = False) -> Column:
    """Struct (provider, token, host, path) of the applicant-tracking system a page points to.

    ``headers`` reads redirect headers instead of HTML: case-insensitive, workable before ashby,
    and the workday address comes from the last Location line.
    """
    body = text(page)
    flag = "(?i)" if headers else ""
    stop = r"[^/ \r\n]" if headers else r'[^/" \r\n]'

    def hit(pattern):
        return body.rlike(flag + pattern)

    def pick(pattern):
        return filled(F.regexp_extract(body, "(?i)" + pattern if headers else pattern, 1))

    none = F.lit(None).cast("string")
    if headers:
        lines = F.regexp_extract_all(body, F.lit(r"(?im)^location: ([^\r\n]*)"), 1)
        address = F.try_element_at(lines, F.lit(-1))
        site = r"^https?://([^/]+)/.*", r"^https?://[^/]+/([^/?]+)"
        workable = pick(r"https?://([A-Za-z0-9-]+)\.workable\.com")
    else:
        address = filled(F.regexp_extract(body, r'(https?://[A-Za-z0-9.-]+\.myworkdayjobs\.com/[^" \r\n]+)', 1))
        site = r"^https?://([^/]+)/.*", r"^https?://[^/]+/([^/?]+)"
        workable = F.coalesce(
            filled(F.regexp_extract(text(page_url), r"https?://([^./]*)\.workable\.com", 1)),
            pick(r"https?://([A-Za-z0-9-]+)\.workable\.com"))
    host, path = (filled(F.regexp_extract(text(address), p, 1)) for p in site)

    def board(provider, token=none, host=none, path=none):
        return F.struct(F.lit(provider).alias("provider"), token.alias("token"), host.alias("host"),
                        path.alias("path"))

    workable_case = (hit(r"workable\.com"), board("workable", workable))
    ashby_case = (hit(r"jobs\.ashbyhq\.com|/api/org/.*/job-postings"),
                  board("ashby", pick(r"jobs\.ashbyhq\.com/(?:api/org/)?([A-Za-z0-9-]+)")))
    verdict = (
        F.when(hit(r"boards\.greenhouse\.io|boards-api\.greenhouse\.io"),
               board("greenhouse", pick(rf"boards\.greenhouse\.io/({stop}+)")))
        .when(hit(r"jobs\.lever\.co"), board("lever", pick(rf"jobs\.lever\.co/({stop}+)")))
        .when(hit(r"\.myworkdayjobs\.com"), board("workday", none, host, path))
    )
    for condition, outcome in ((workable_case, ashby_case) if headers else (ashby_case, workable_case)):
        verdict = verdict.when(condition, outcome)
    return verdict.otherwise(board("unknown"))


def company_from_title(page: Column) -> Column:
    """Company name guessed from the page title."""
    title = F.regexp_extract(text(page), r"<title>([^<\r\n]*)", 1)
    return filled(F.regexp_replace(title, r"( Careers| - Careers| – Careers| \| Careers).*| +$", ""))


def directory_stub(board: Column, company: Column) -> Column:
    """Directory entry (JSON) for a detected board; null where the board lacks what identifies it.

    Ashby and workday entries carry placeholders for what the page did not tell.
    """
    provider, token = board["provider"], board["token"]
    workday = provider == "workday"
    entry = F.to_json(F.struct(
        F.coalesce(filled(company), F.lit("<NAME>")).alias("company"),
        provider.alias("ats"),
        F.when(provider == "ashby", F.coalesce(token, F.lit("<TOKEN>"))).when(~workday, token).alias("token"),
        F.when(workday, F.coalesce(board["host"], F.lit("<HOST>.myworkdayjobs.com"))).alias("host"),
        F.when(workday, F.coalesce(board["path"], F.lit("<PATH>"))).alias("path"),
        F.lit("High").alias("priority")))
    return F.when(provider.isin("ashby", "workday") | ((provider != "unknown") & token.isNotNull()), entry)
