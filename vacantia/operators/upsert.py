"""Batch upsert of postings into jobs, companies and job skills.

A batch behaves as if its rows arrived one after the other in ``seq`` order:

* a row updates the job with its (provider, external_id), else it re-keys the job stored under
  its legacy id (same provider first, then any provider if only one job has it), else it inserts;
* null never overwrites, ``posted_at`` is written once, later rows win otherwise;
* when several new ids name the same legacy job, the first one takes it and the others insert;
* rows of the old id that come after the re-keying open a new job, if they are complete.

Legacy ids are looked up in the stored table.  Groups are folded by aggregates with partial
results, so an id that holds much of the batch costs one row per map task.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vacantia.functions.exprs import as_timestamp, filled, strip
from vacantia.functions.text import skill_label, slugify
from vacantia.operators import runs
from vacantia.operators.graph import components
from vacantia.operators.ranking import number_rows
from vacantia.schemas import COMPANIES, INCOMING, JOB_SKILLS, JOBS
from vacantia.session import cut_lineage

# Takes as many ids of a table as there are rows; returns the one before the first.
Ids = Callable[[str, DataFrame], int]
LAST_WINS = ("url", "title", "location", "is_remote", "level", "description", "function", "seniority_score")
KEY = ["provider", "external_id"]
PREPARED = {"slug", "complete", "legacy_external_id"}


class Upserted(NamedTuple):
    """The three tables, the refused rows, and the companies among them that are new."""

    jobs: DataFrame
    companies: DataFrame
    job_skills: DataFrame
    rejects: DataFrame
    created: DataFrame


def conform(df: DataFrame, schema) -> DataFrame:
    """Cast to a layout; columns that are missing become null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def prepared(incoming: DataFrame) -> DataFrame:
    """Batch rows with the company reference and whether they could stand as a new job.

    Written out once: whatever made the batch, a parser for instance, runs a single time.
    """
    if "description_html" in incoming.columns:
        given = [c for c in ("description", "description_html") if c in incoming.columns]
        incoming = incoming.withColumn("description", F.coalesce(*given))
    if "company_token" in incoming.columns:
        incoming = incoming.withColumn(
            "company_slug", F.coalesce(*[filled(strip(F.col(c))) for c in ("company_slug", "company_token")
                                         if c in incoming.columns]))
    batch = conform(incoming, INCOMING)
    # columns of their own, so that each expression is evaluated once a row and not once a mention
    given, made = strip(F.col("company_slug")), slugify(F.col("company"))
    return cut_lineage(
        batch.withColumns({"_given": given, "_made": made})
        .withColumn("slug", F.coalesce(filled(F.col("_given")), filled(F.col("_made")))).drop("_given", "_made")
        .withColumn("company", F.coalesce(filled(F.col("company")), F.col("slug")))
        .withColumn("legacy_external_id", filled(F.col("legacy_external_id")))
        .withColumn("complete", F.col("title").isNotNull() & F.col("url").isNotNull() & F.col("slug").isNotNull())
    )


def resolve(batch: DataFrame, jobs: DataFrame) -> DataFrame:
    """Batch rows with state_id (the job they update, or null) and reason (why they are refused)."""
    keyed = batch.filter("external_id <> '' AND provider <> ''")
    can_start = F.expr("complete OR legacy_external_id IS NOT NULL")
    ids = cut_lineage(keyed.groupBy(*KEY).agg(
        F.min(F.when(can_start, F.col("seq"))).alias("first_seq"),
        F.min(F.when(F.col("complete"), F.col("seq"))).alias("first_complete"),
        F.min_by(F.when(can_start, F.col("legacy_external_id")),
                 F.when(can_start, F.col("seq"))).alias("legacy")))
    # The semi-join meets the stored keys first: with a small batch they are filtered in place
    # and never shuffled.
    held = jobs.select(*KEY, F.col("id").alias("exact_id")).join(ids.select(*KEY), KEY, "left_semi")
    keys = cut_lineage(ids.join(held, KEY, "left"))

    stored = jobs.select(F.col("id").alias("stored_id"), F.col("provider").alias("stored_provider"),
                         F.col("external_id").alias("legacy"))
    same_provider = F.col("stored_provider") == F.col("provider")
    claims = cut_lineage(
        keys.filter("exact_id IS NULL AND legacy IS NOT NULL").select(*KEY, "first_seq", "legacy")
        .join(stored, "legacy")
        .groupBy(*KEY, "first_seq")
        .agg(F.max(F.when(same_provider, F.col("stored_id"))).alias("scoped"),
             F.count(F.lit(1)).alias("holders"), F.min("stored_id").alias("any_holder"))
        .withColumn("claimed_id", F.coalesce("scoped", F.when(F.col("holders") == 1, F.col("any_holder"))))
    )
    winners = claims.filter("claimed_id IS NOT NULL").groupBy("claimed_id").agg(
        F.min(F.struct("first_seq", *KEY)).alias("w")).select(
        "claimed_id", F.col("w.provider").alias("provider"), F.col("w.external_id").alias("external_id"),
        F.col("w.first_seq").alias("claimed_at"))
    ambiguous = claims.filter("claimed_id IS NULL").select(*KEY, F.lit(True).alias("ambiguous"))

    resolved = (
        keys.join(winners.select(*KEY, "claimed_id"), KEY, "left")
        .join(ambiguous, KEY, "left")
        .join(winners.select(F.col("claimed_id").alias("exact_id"), "claimed_at"), "exact_id", "left")
        .drop("legacy")
    )
    moved = F.coalesce(F.col("seq") > F.col("claimed_at"), F.lit(False))
    # Rows without a key find nothing; in the join those of a provider would all meet in one task.
    has_key = F.coalesce(F.expr("external_id <> '' AND provider <> ''"), F.lit(False))
    found = batch.filter(has_key).join(resolved, KEY, "left").unionByName(batch.filter(~has_key), allowMissingColumns=True)
    return (
        found.withColumn("state_id", F.when(~moved, F.col("exact_id")))
        .withColumn("state_id", F.coalesce("state_id", F.when(F.col("seq") >= F.col("first_seq"), F.col("claimed_id"))))
        .withColumn("reason", F.when(F.col("seq").isNull(), "missing-seq")
                    .when(F.coalesce(F.col("external_id"), F.lit("")) == "", "missing-external-id")
                    .when(F.coalesce(F.col("provider"), F.lit("")) == "", "missing-provider")
                    .when(F.col("state_id").isNotNull(), None)
                    .when(F.col("ambiguous") & F.col("legacy_external_id").isNotNull(), "ambiguous-legacy-id")
                    .when(moved & ~F.col("complete"), "incomplete")
                    .when(F.col("first_complete").isNull() | (F.col("seq") < F.col("first_complete")), "incomplete"))
        .drop("exact_id", "first_seq", "first_complete", "claimed_id", "claimed_at", "ambiguous")
    )


def _last(column: str) -> Column:
    return F.expr(f"max_by({column}, seq) FILTER (WHERE {column} IS NOT NULL)").alias(column)


def fold(rows: DataFrame) -> DataFrame:
    """One record per job: last non-null value of each column, first non-null date."""
    is_new = F.col("state_id").isNull()
    return (
        rows.withColumn("new_provider", F.when(is_new, F.col("provider")))
        .withColumn("new_external_id", F.when(is_new, F.col("external_id")))
        .withColumn("company_ref", F.when(
            F.col("slug").isNotNull(), F.struct("slug", "company", F.col("seq").alias("at"))))
        .groupBy("state_id", "new_provider", "new_external_id")
        .agg(F.min("seq").alias("first_seq"), *[_last(c) for c in KEY], *[_last(c) for c in LAST_WINS],
             F.expr("min_by(posted_at, seq) FILTER (WHERE posted_at IS NOT NULL)").alias("posted_at"),
             _last("skills"), _last("company_ref"))
        .drop("new_provider", "new_external_id")
    )


def next_ids(df: DataFrame, table: DataFrame, seq: str, taken: int | None = None) -> DataFrame:
    """Give rows ids in ``seq`` order, above the largest stored one or above those taken."""
    largest = F.coalesce(table.select(F.max("id")).scalar(), F.lit(0).cast("long")) if taken is None else F.lit(taken)
    return number_rows(df, "_n", seq=seq).withColumn("id", F.col("_n") + largest).drop("_n")


# Rounds in which certain pairs settle others at once; what is left then are chains of references.
CLAIM_ROUNDS = 2


def _first_claims(pairs: DataFrame) -> DataFrame:
    """Of (slug, company, seq) those that create a company: in order, each slug and each name at most once.

    A pair that comes first for both its slug and its name is certain; it settles all other pairs with either, so names and
    slugs with many pairs are done in the first round. What a few rounds leave are chains, in which each pair waits for the
    one before: those are cut into components, and each is gone through in order.
    """
    chosen = pairs.limit(0)
    for _ in range(CLAIM_ROUNDS):
        if pairs.isEmpty():
            return chosen
        slugs = pairs.groupBy("slug").agg(F.min("seq").alias("slug_seq"))
        names = pairs.groupBy("company").agg(F.min("seq").alias("name_seq"))
        first = cut_lineage(pairs.join(slugs, "slug").join(names, "company")
                            .filter("seq = slug_seq AND seq = name_seq").select("slug", "company", "seq"))
        chosen = chosen.union(first)
        pairs = cut_lineage(pairs.join(first.select("slug"), "slug", "left_anti")
                            .join(first.select("company"), "company", "left_anti").select("slug", "company", "seq"))
    return chosen if pairs.isEmpty() else chosen.union(_chained_claims(pairs))


def _chained_claims(pairs: DataFrame) -> DataFrame:
    """The same by components of the graph of slugs and names, a component's pairs in order.

    Rows stream through a task sorted by component; it remembers what the current component has taken, and no pairs.
    """
    edges = pairs.withColumn("a", F.xxhash64(F.lit("slug"), "slug")).withColumn("b", F.xxhash64(F.lit("name"), "company"))
    rooted = edges.join(components(edges).withColumnRenamed("node", "a"), "a").select("slug", "company", "seq", "root")

    def run(batches):
        now, slugs, names = None, set(), set()
        for batch in batches:
            keep = []
            for i, (slug, name, root) in enumerate(zip(batch["slug"], batch["company"], batch["root"])):
                if root != now:
                    now, slugs, names = root, set(), set()
                if slug not in slugs and name not in names:
                    slugs.add(slug)
                    names.add(name)
                    keep.append(i)
            yield batch.iloc[keep][["slug", "company", "seq"]]
    kind = pairs.schema["seq"].dataType.simpleString()
    return cut_lineage(rooted.repartition("root").sortWithinPartitions("root", "seq").mapInPandas(
        run, f"slug string, company string, seq {kind}"))


def resolve_companies(refs: DataFrame, companies: DataFrame, ids: Ids | None = None) -> tuple[DataFrame, DataFrame]:
    """What each (slug, company) reference finds, and the companies to create.

    As if references came one by one in ``seq`` order: each matches by slug, else by name, among the stored companies and
    those created so far, else it creates one. So a slug that is created later takes over from a match by name: the mapping
    has ``slug_id``, ``slug_from`` (the first seq that finds it; null if stored) and ``name_id``; see ``company_id``.
    ``seq`` is the pair's first reference.
    """
    seen = refs.groupBy("slug", "company").agg(F.min("seq").alias("seq"))
    by_slug = companies.select("slug", F.col("id").alias("stored_slug"))
    by_name = companies.groupBy(F.col("name").alias("company")).agg(F.min("id").alias("stored_name"))
    matched = cut_lineage(seen.join(by_slug, "slug", "left").join(by_name, "company", "left"))
    makers = _first_claims(matched.filter("stored_slug IS NULL AND stored_name IS NULL").select("slug", "company", "seq"))
    created = next_ids(makers, companies, "seq", ids and ids("companies", makers)).select("id", F.col("company").alias("name"), "slug", "seq")
    new_slugs = created.select("slug", F.col("id").alias("new_slug"), F.col("seq").alias("slug_from"))
    new_names = created.select(F.col("name").alias("company"), F.col("id").alias("new_name"))
    mapping = matched.join(new_slugs, "slug", "left").join(new_names, "company", "left").select(
        "slug", "company", "seq", F.coalesce("stored_slug", "new_slug").alias("slug_id"), "slug_from",
        F.coalesce("stored_name", "new_name").alias("name_id"))
    return mapping, conform(created, COMPANIES)


def company_id(seq: Column) -> Column:
    """The company that a reference made at ``seq`` finds, from the columns of the mapping."""
    by_slug = F.col("slug_id").isNotNull() & F.coalesce(F.col("slug_from") <= seq, F.lit(True))
    return F.when(by_slug, F.col("slug_id")).otherwise(F.col("name_id"))


def _with_company(rows: DataFrame, mapping: DataFrame, seq: str) -> DataFrame:
    found = rows.join(mapping.drop("seq"), ["slug", "company"], "left")
    return found.withColumn("company_id", company_id(F.col(seq))).drop("slug_id", "slug_from", "name_id")


def _updated(jobs: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Stored jobs with their changes; updated_at moves only where a value differs."""
    columns = [*KEY, "company_id", *LAST_WINS]
    renamed = changes.select(
        F.col("state_id").alias("id"), *[F.col(c).alias(f"new_{c}") for c in (*columns, "posted_at")])
    joined = jobs.join(renamed, "id", "left")
    values = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in columns}
    values["posted_at"] = F.coalesce("posted_at", "new_posted_at")
    changed = F.lit(False)
    for name, value in values.items():
        changed = changed | ~value.eqNullSafe(F.col(name))
    values["updated_at"] = F.when(changed, as_of).otherwise(F.col("updated_at"))
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in jobs.columns])


def _skill_rows(given: DataFrame) -> DataFrame:
    labels = F.array_distinct(F.transform("skills", skill_label))
    return given.select("job_id", F.explode(F.filter(labels, lambda s: s.isNotNull())).alias("skill"), F.lit(1).alias("score"))


def replace_skills(job_skills: DataFrame, touched: DataFrame) -> DataFrame:
    """Replace the skills of touched jobs (job_id, skills); null keeps them, an empty list clears them."""
    given = touched.filter("skills IS NOT NULL")
    kept = job_skills.join(given.select("job_id"), "job_id", "left_anti").select("job_id", "skill", "score")
    return kept.unionByName(_skill_rows(given))


def upsert(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame, incoming: DataFrame, as_of,
           ids: Ids | None = None, seen: Observation | None = None) -> Upserted:
    """New versions of the three tables, and the refused rows (seq, provider, external_id, reason).

    The batch, its resolved and its folded form are written out once, as every result is made
    from them; the stored tables are read by the joins alone. ``ids`` hands out ids where others write too, and ``seen``
    observes how many rows each provider has and how many are refused.
    """
    now = as_timestamp(as_of)
    jobs, companies = conform(jobs, JOBS), conform(companies, COMPANIES)
    job_skills = conform(job_skills, JOB_SKILLS)
    batch = incoming if PREPARED <= set(incoming.columns) else prepared(incoming)
    resolved = resolve(batch, jobs)
    rows = cut_lineage(resolved.withColumn("_named", runs.named()).observe(seen, *runs.counts("_named")).drop("_named")
                       if seen else resolved)
    accepted = rows.filter("reason IS NULL")
    mapping, created = resolve_companies(
        accepted.filter("slug IS NOT NULL").select("slug", "company", "seq"), companies, ids)
    folded = fold(accepted).withColumn("slug", F.col("company_ref.slug")).withColumn(
        "company", F.col("company_ref.company")).withColumn("at", F.col("company_ref.at")).drop("company_ref")
    folded = cut_lineage(_with_company(folded, mapping, "at").drop("at"))

    updated = _updated(jobs, folded.filter("state_id IS NOT NULL"), now)
    opened = folded.filter("state_id IS NULL")
    fresh = next_ids(opened, jobs, "first_seq", ids and ids("jobs", opened))
    inserted = conform(
        fresh.withColumn("is_remote", F.coalesce("is_remote", F.lit(False)))
        .withColumn("level", F.coalesce("level", F.lit("unknown")))
        .withColumn("active", F.lit(True)).withColumn("created_at", now).withColumn("updated_at", now), JOBS)
    touched = folded.filter("state_id IS NOT NULL").select(F.col("state_id").alias("job_id"), "skills").unionByName(
        fresh.select(F.col("id").alias("job_id"), "skills"))
    return Upserted(
        jobs=updated.unionByName(inserted),
        companies=companies.unionByName(created),
        job_skills=replace_skills(job_skills, touched),
        rejects=rows.filter("reason IS NOT NULL").select("seq", *KEY, "reason"),
        created=created,
    )


def insert_only(jobs: DataFrame, companies: DataFrame, incoming: DataFrame, as_of, ids: Ids | None = None) -> Upserted:
    """What to add to the three tables (the first complete row of each key not stored yet), and the refused rows.

    Only the prepared batch is written out. Which rows are accepted is found from its keys and flags, once for the companies
    and once for the rows themselves, which costs less than another copy of all rows.
    """
    now = as_timestamp(as_of)
    batch = prepared(incoming)
    stored = jobs.select(*KEY, F.lit(True).alias("stored"))
    # Rows without an external id are no duplicates of each other.
    keyed = batch.filter("complete AND provider <> '' AND seq IS NOT NULL")
    first = keyed.filter("external_id IS NOT NULL").groupBy(*KEY).agg(F.min("seq").alias("first_seq"))
    marked = batch.join(first, KEY, "left").join(stored, KEY, "left").withColumn(
        "reason", F.when(F.col("seq").isNull(), "missing-seq")
        .when(~F.col("complete") | F.coalesce(F.col("provider") == "", F.lit(True)), "incomplete")
        .when(F.col("stored") | (F.col("seq") > F.col("first_seq")), "duplicate-key"))
    accepted = marked.filter("reason IS NULL")
    mapping, created = resolve_companies(accepted.select("slug", "company", "seq"), conform(companies, COMPANIES), ids)
    fresh = next_ids(_with_company(accepted, mapping, "seq"), jobs, "seq", ids and ids("jobs", accepted))
    added = conform(
        fresh.withColumn("is_remote", F.coalesce("is_remote", F.lit(False)))
        .withColumn("level", F.coalesce("level", F.lit("unknown")))
        .withColumn("active", F.lit(True)).withColumn("created_at", now).withColumn("updated_at", now), JOBS)
    given = fresh.select(F.col("id").alias("job_id"), "skills")
    return Upserted(
        jobs=added, companies=created, job_skills=_skill_rows(given.filter("skills IS NOT NULL")),
        rejects=marked.filter("reason IS NOT NULL").select("seq", *KEY, "reason"), created=created)
