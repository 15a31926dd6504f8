"""The scan run: landed payloads to ranked, deduplicated, enriched postings."""

from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions import text
from vacantia.functions.classify import is_remote_us
from vacantia.functions.dates import naive_utc, posted_days_ago
from vacantia.functions.exprs import filled, strip
from vacantia.operators import aggregates, filters, joins, quotas, ranking, scoring, sinks
from vacantia.operators.upsert import Upserted, upsert
from vacantia.plans.upkeep import upsert_batch
from vacantia.session import cut_lineage
from vacantia.sources import registry
from vacantia.sources.board_pages import ashby_listed
from vacantia.sources.directory import enabled_sources, listed_boards, route, with_company
from vacantia.sources.snippets import read_pages
from vacantia.sources.tables import TableStore


@dataclass(frozen=True)
class Profile:
    """Arguments of a run. Caps bound how many rows are enriched; None, the default, uses every landed page."""

    relax: bool = False
    junior_only: bool = False
    us_remote_only: bool = False
    recent_days: int = 0
    require_date: bool = False
    min_score: int = 0
    skills_any: tuple = V.DEFAULT_SKILLS
    skills_all: tuple = ()
    skills_hard: bool = False
    snippet_cap: int | None = None
    junior_cap: int | None = None
    backfill_cap: int | None = None
    providers: str = "greenhouse"


def with_preset(profile: Profile, preset: str | None) -> Profile:
    """Presets fill arguments that still have their default."""
    if preset == "apply-now":
        return replace(profile, us_remote_only=True, junior_only=True, relax=True,
                       recent_days=profile.recent_days or 14, min_score=profile.min_score or 1)
    if preset == "research":
        return replace(profile, recent_days=profile.recent_days or 30)
    return profile


class ScanResult(NamedTuple):
    """All postings, those that passed the filters, the enriched unique ones, and what the run counted on its way."""

    fetched: DataFrame
    scored: DataFrame
    unique: DataFrame
    diagnostics: DataFrame
    skipped: DataFrame | None = None


class Landed(NamedTuple):
    """What has landed for a run. The ids of payloads, answers and pages come from one sequence.

    payloads: payload_id, provider, token, body. answers: page_id, token, body, query answers of ashby boards by slug. board_pages: page_id, provider, token, url, html.
    """

    payloads: DataFrame
    answers: DataFrame
    board_pages: DataFrame


def with_skill_file(profile: Profile, skills: DataFrame) -> Profile:
    """Skills of a file (one row, see ``read_skills``) for a profile that names none of its own."""
    if profile.skills_any != V.DEFAULT_SKILLS or profile.skills_all:
        return profile
    row = skills.first()
    if row is None or not (row.any_terms or row.all_terms):
        return profile
    return replace(profile, skills_any=tuple(row.any_terms), skills_all=tuple(row.all_terms))


def fetch_all(landed: dict[str, DataFrame], page_facts: DataFrame | None = None,
              cap: int | None = None) -> DataFrame:
    """Postings of all sources; landed holds one DataFrame per source name."""
    return registry.union_sources(
        [registry.fetch(name, rows, page_facts, cap) for name, rows in sorted(landed.items())])


def enrich(postings: DataFrame, page_facts: DataFrame | None, profile: Profile, as_of) -> DataFrame:
    """Junior top-up, then the quota per provider, then dates for undated rows.

    Each choice is joined back to the postings by their arrival number.
    """
    if page_facts is not None:
        juniors = quotas.junior_candidates(
            postings, as_of, profile.us_remote_only, profile.recent_days, profile.junior_cap)
        postings = quotas.add_snippets(postings, juniors, page_facts)
        chosen = quotas.quota_candidates(
            postings, as_of, profile.junior_only, profile.us_remote_only, profile.recent_days,
            cap=profile.snippet_cap)
        postings = quotas.add_snippets(postings, chosen, page_facts)
    return quotas.backfill_dates(postings, page_facts, as_of, profile.backfill_cap)


def keep_and_score(postings: DataFrame, profile: Profile, as_of) -> DataFrame:
    """Rows that pass the run's filters, with their skill score."""
    kept = postings.filter(filters.keeps_basic(profile.junior_only)
                           & filters.keeps_recent(profile.recent_days, as_of, profile.require_date))
    if profile.us_remote_only:
        kept = kept.filter(is_remote_us(F.col("location"), F.col("description_snippet")))
    scored = scoring.score(kept, profile.skills_any, profile.skills_all, profile.skills_hard)
    return filters.min_score(scored, profile.min_score)


def ranked_unique(scored: DataFrame) -> DataFrame:
    """Ranked rows without duplicates; each row carries the best score and rank of its exact url."""
    ranked = ranking.rank_by_score(scored)
    unique = ranking.deduplicate(ranked, order="rank").drop("skill_score", "rank")
    return joins.with_best_rank(unique, ranking.best_per_url(ranked))


def export_rows(unique: DataFrame, directory: DataFrame, as_of) -> DataFrame:
    """The enriched rows of the JSON and CSV exports."""
    return (
        joins.with_directory(unique.drop("token"), directory)
        .withColumn("provider", F.col("source"))
        .withColumn("posted_days_ago", posted_days_ago(F.col("posted_at"), as_of))
    )


def scan(postings: DataFrame, directory: DataFrame, page_facts: DataFrame | None, profile: Profile,
         as_of) -> ScanResult:
    """A whole run over fetched postings.

    Postings, scored and unique rows are read by several later steps, so each is written out once.
    """
    fetched = enrich(cut_lineage(postings), page_facts, profile, as_of)
    scored = cut_lineage(keep_and_score(fetched, profile, as_of))
    unique = cut_lineage(export_rows(ranked_unique(scored), directory, as_of))
    return ScanResult(fetched, scored, unique, run_diagnostics(fetched, scored, unique, profile, as_of))


def run_diagnostics(fetched: DataFrame, scored: DataFrame, unique: DataFrame, profile: Profile, as_of) -> DataFrame:
    """The run's counts as rows (stage, source, metric, n): per source as fetched and as filtered, then in all."""
    def total(df, metric):
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("summary").alias("stage"), F.lit(None).cast("string").alias("source"), F.lit(metric).alias("metric"), "n")
    days = profile.recent_days or V.RETENTION_DAYS
    return (aggregates.fetch_diagnostics(fetched, days, as_of)
            .unionByName(aggregates.filter_diagnostics(scored, profile.min_score))
            .unionByName(total(fetched, "fetched")).unionByName(total(scored, "kept")).unionByName(total(unique, "unique")))


def scan_landed(landed: dict[str, DataFrame], directory: DataFrame, pages: DataFrame, profile: Profile,
                as_of) -> ScanResult:
    """A run from landed payloads and pages; pages are parsed once, and postings see their whole text."""
    facts = cut_lineage(read_pages(pages, as_of, max_chars=None))
    chosen = {name: rows for name, rows in landed.items() if name in enabled_sources(profile.providers)}
    return scan(fetch_all(chosen, facts, profile.snippet_cap), directory, facts, profile, as_of)


def scan_directory(landed: Landed, directory: DataFrame, pages: DataFrame, profile: Profile, as_of) -> ScanResult:
    """A run over the boards that the directory names.

    Entries without a known provider are skipped and reported; of the others, those of enabled providers are read, each
    board once. Ashby boards without postings in their JSON fall back to query answers and then to their page.
    """
    chosen, skipped = route(directory, profile.providers)
    listed = cut_lineage(listed_boards(chosen))
    facts = cut_lineage(read_pages(pages, as_of, max_chars=None))

    def of(provider, rows):
        return with_company(rows.filter(F.col("provider") == provider), listed)
    parts = []
    for name in enabled_sources(profile.providers):
        if name == "ashby":
            mine = listed.filter("provider = 'ashby' AND token <> ''").select("token", "company")
            found = ashby_listed(mine, landed.payloads.filter("provider = 'ashby'"), landed.answers,
                                 landed.board_pages.filter("provider = 'ashby'"))
        elif name in V.REGISTERED_SOURCES:
            found = registry.get(name)(of(name, landed.board_pages if name == "workable" else landed.payloads))
        else:
            continue
        parts.append(registry.with_snippets(name, found, facts, profile.snippet_cap))
    if not parts:
        raise ValueError(f"no known source among {profile.providers!r}")
    result = scan(registry.union_sources(parts), directory, facts, profile, as_of)
    return result._replace(skipped=skipped)


def to_upsert_records(exported: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(records, refused rows): saved rows get their id, remote flag, level and matched skills."""
    good, bad = filters.split_saveable(exported)
    columns = good.columns
    posted = naive_utc(F.col("posted_at")) if dict(good.dtypes)["posted_at"] == "string" else F.col("posted_at")
    records = scoring.with_matched_skills(filters.with_remote_flag(good), (*profile.skills_any, *profile.skills_all))
    return records.select(
        F.col("position").alias("seq"),
        F.lower(strip(F.col("source"))).alias("provider"),
        text.external_id(columns, F.col("url")).alias("external_id"),
        strip(F.col("url")).alias("url"),
        strip(F.col("company")).alias("company"),
        strip(F.col("title")).alias("title"),
        "location", "is_remote",
        F.lower(F.coalesce(filled(F.col("level")), F.lit("unknown"))).alias("level"),
        posted.alias("posted_at"),
        filled(F.col("description_snippet")).alias("description"),
        "skills",
    ), bad


def save(exported: DataFrame, profile: Profile, jobs: DataFrame, companies: DataFrame, job_skills: DataFrame,
         as_of) -> Upserted:
    records, _ = to_upsert_records(exported, profile)
    return upsert(jobs, companies, job_skills, records, as_of)


def save_run(result: ScanResult, profile: Profile, store: TableStore, as_of, pages: int | None = None) -> int:
    """Upsert a run's unique rows into the store; the run log takes the counts in the same version."""
    records, _ = to_upsert_records(result.unique, profile)
    return upsert_batch(store, records, as_of, pages=(lambda: pages) if pages is not None else None, notes="scan")


def write_exports(result: ScanResult, folder: str, csv_columns=None) -> None:
    """Raw dump, enriched JSON and CSV under one folder."""
    sinks.write_json(result.fetched, f"{folder}/jobs_raw")
    sinks.write_json(result.unique, f"{folder}/jobs")
    sinks.write_csv(result.unique, f"{folder}/jobs_csv", csv_columns)
