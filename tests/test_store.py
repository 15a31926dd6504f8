"""Upserts, the table store, maintenance, streaming."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantia import schemas
from vacantia.operators import aggregates, graph, joins, maintenance, upsert
from vacantia.plans import browse, upkeep
from vacantia.sources import boards, tables, text_index
from vacantia.sources.tables import TableStore
from vacantia.streaming import dedupe, ingest

NOW = "2025-10-05 00:00:00"


def empty(spark):
    return [spark.createDataFrame([], s) for s in (schemas.JOBS, schemas.COMPANIES, schemas.JOB_SKILLS)]


def batch(spark, *records, start=0):
    base = {f.name: None for f in schemas.INCOMING.fields}
    rows = [base | {"provider": "github", "url": "https://e.com", "title": "New Grad SWE", "company": "Example"} | r
            | {"seq": start + n} for n, r in enumerate(records)]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.INCOMING.fields) for r in rows], schemas.INCOMING)


def run(spark, tables, rows, now=NOW):
    result = upsert.upsert(*tables, rows, now)
    return [result.jobs, result.companies, result.job_skills], result.rejects


def test_posted_at_is_written_once(spark):
    tables = empty(spark)
    for n, posted in enumerate((None, datetime(2025, 9, 15), datetime(2025, 10, 1))):
        tables, _ = run(spark, tables, batch(spark, {"external_id": "abc123", "posted_at": posted}, start=n))
    assert [r.posted_at for r in tables[0].collect()] == [datetime(2025, 9, 15)]


def simulate(records, jobs):
    """The upsert, one row after the other, in plain Python."""
    jobs = {k: dict(v) for k, v in jobs.items()}
    rejects, next_id = [], max(jobs, default=0) + 1

    def find(provider, external):
        return [i for i, j in jobs.items() if j["external_id"] == external and provider in (None, j["provider"])]

    for r in records:
        if not r["external_id"]:
            rejects.append(r["seq"])
            continue
        hit = find(r["provider"], r["external_id"])
        if not hit and r["legacy_external_id"]:
            hit = find(r["provider"], r["legacy_external_id"]) or find(None, r["legacy_external_id"])
            if len(hit) > 1:
                rejects.append(r["seq"])
                continue
        if hit:
            job = jobs[hit[0]]
            job.update(provider=r["provider"], external_id=r["external_id"])
            for c in ("url", "title"):
                job[c] = r[c] if r[c] is not None else job[c]
            job["posted_at"] = job["posted_at"] or r["posted_at"]
        elif r["title"] is None:
            rejects.append(r["seq"])
        else:
            jobs[next_id] = {c: r[c] for c in ("provider", "external_id", "url", "title", "posted_at")}
            next_id += 1
    return jobs, rejects


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_one_by_one(spark, seed):
    pick = random.Random(seed)
    stored, _ = run(spark, empty(spark), batch(spark, *[
        {"external_id": f"old{n}", "provider": pick.choice(["github", "lever"])} for n in range(12)]))
    before = {r.id: {c: r[c] for c in ("provider", "external_id", "url", "title", "posted_at")}
              for r in stored[0].collect()}
    records = []
    for n in range(60):
        fresh = pick.random() < 0.6
        records.append({
            "external_id": None if pick.random() < 0.05 else (f"new{pick.randrange(14)}" if fresh else f"old{pick.randrange(6)}"),
            # Only ids from the stored table serve as legacy ids, and those above 6 get no rows of their own.
            "legacy_external_id": f"old{6 + pick.randrange(6)}" if fresh and pick.random() < 0.5 else None,
            "provider": pick.choice(["github", "github", "lever"]),
            "title": None if pick.random() < 0.2 else f"T{n}", "url": f"https://e.com/{n}",
            "posted_at": datetime(2025, 1, 1 + n % 28) if pick.random() < 0.5 else None})
    rows = batch(spark, *records)
    after, rejects = run(spark, stored, rows)
    wanted, refused = simulate([r.asDict() for r in rows.orderBy("seq").collect()], before)
    got = {r.id: {c: r[c] for c in ("provider", "external_id", "url", "title", "posted_at")} for r in after[0].collect()}
    assert got == wanted
    assert sorted(r.seq for r in rejects.collect()) == refused


def test_later_rows_of_a_rekeyed_id_open_a_new_job(spark):
    stored, _ = run(spark, empty(spark), batch(spark, {"external_id": "o"}))
    after, _ = run(spark, stored, batch(
        spark, {"external_id": "o", "title": "A"}, {"external_id": "n1", "legacy_external_id": "o", "title": "B"},
        {"external_id": "n2", "legacy_external_id": "o", "title": "C"}, {"external_id": "o", "title": "D"}))
    assert sorted((r.id, r.external_id, r.title) for r in after[0].collect()) == [
        (1, "n1", "B"), (2, "n2", "C"), (3, "o", "D")]


def test_upsert_is_idempotent_and_splits(spark):
    a = batch(spark, {"external_id": "1", "skills": ["x", " y ", ""]}, {"external_id": "2", "company": "Zed", "posted_at": datetime(2025, 1, 1)})
    b = batch(spark, {"external_id": "1", "title": "Later", "skills": []}, {"external_id": "3", "company": "Zed"}, start=10)
    once, _ = run(spark, empty(spark), a.unionByName(b))
    step, _ = run(spark, empty(spark), a)
    step, _ = run(spark, step, b)
    for x, y in zip(once, step):
        assert sorted(map(str, x.drop("updated_at").collect())) == sorted(map(str, y.drop("updated_at").collect()))
    again, _ = run(spark, step, b, "2026-01-01 00:00:00")
    assert sorted(map(str, again[0].collect())) == sorted(map(str, step[0].collect()))
    assert step[2].count() == 0 and {r.slug for r in step[1].collect()} == {"example", "zed"}


def test_companies_match_by_slug_then_name(spark):
    tables = empty(spark)
    tables[1] = spark.createDataFrame([(5, "Acme Inc", "acme", None, None, None), (6, "Named", "other", None, None, None)], schemas.COMPANIES)
    after, _ = run(spark, tables, batch(
        spark, {"external_id": "1", "company": "ACME"}, {"external_id": "2", "company": "Named"},
        {"external_id": "3", "company": "New", "company_slug": "n-1"}, {"external_id": "4", "company": "New", "company_slug": "n-2"}))
    assert {r.external_id: r.company_id for r in after[0].collect()} == {"1": 5, "2": 6, "3": 7, "4": 7}


def test_rejects_have_reasons(spark):
    stored, _ = run(spark, empty(spark), batch(spark, {"external_id": "o", "provider": "lever"}, {"external_id": "o", "provider": "ashby"}))
    _, rejects = run(spark, stored, batch(
        spark, {"external_id": ""}, {"external_id": "1", "title": None}, {"external_id": "2", "legacy_external_id": "o"},
        {"external_id": "3", "provider": None}))
    assert {r.seq: r.reason for r in rejects.collect()} == {
        0: "missing-external-id", 1: "incomplete", 2: "ambiguous-legacy-id", 3: "missing-provider"}


def test_store_versions_and_replays(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.read("jobs").count() == 0
    rows = batch(spark, {"external_id": "1", "posted_at": datetime(2025, 1, 1)}, {"external_id": "2"})
    assert upkeep.upsert_batch(store, rows, NOW, batch_id=0) == 1
    assert upkeep.upsert_batch(store, rows, NOW, batch_id=0) == 1
    assert upkeep.prune(store, NOW, days=30) == 2
    assert [r.external_id for r in store.read("jobs").collect()] == ["2"]
    assert store.read("companies").count() == 1


def test_stream_equals_one_shot(spark, rows, tmp_path):
    body = '{"jobs":[{"absolute_url":"https://b.example.com/%d","title":"Engineer I"}]}'
    landed = rows(ingest.LANDED, *[(n, "t", "Acme", None, None, body % (n % 7)) for n in range(12)])
    landed.repartition(3).write.parquet(str(tmp_path / "landed"))
    store = TableStore(spark, str(tmp_path / "store"))

    def ingest_all(checkpoint):
        stream = ingest.landed_stream(spark, str(tmp_path / "landed"), files_per_batch=1)
        ingest.ingest_stream(stream, boards.greenhouse, ingest.board_records, store, str(tmp_path / checkpoint), NOW).awaitTermination()
    ingest_all("cp")
    ingest_all("cp")
    result = upsert.upsert(*empty(spark), ingest.board_records(boards.greenhouse(landed)), NOW)
    columns = ["provider", "external_id", "url", "title"]
    assert sorted(map(tuple, store.read("jobs").select(columns).collect())) == sorted(
        map(tuple, result.jobs.select(columns).collect()))
    assert store.version() == 3
    # A stream that starts over is applied again, and changes nothing.
    before = sorted(map(str, store.read("jobs").collect()))
    ingest_all("cp2")
    assert store.version() == 6 and sorted(map(str, store.read("jobs").collect())) == before


def test_stream_parses_a_payload_once_and_on_all_cores(spark, rows, tmp_path):
    body = '{"jobs":[{"absolute_url":"https://b.example.com/%d","title":"Engineer I"}]}'
    rows(ingest.LANDED, *[(n, "t", "Acme", None, None, body % n) for n in range(40)]).repartition(1).write.parquet(str(tmp_path / "landed"))
    seen_file, plans = str(tmp_path / "seen"), []

    def parser(landed):
        def seen(batches):
            for part in batches:
                with open(seen_file, "a") as out:
                    out.write("x" * len(part))
                yield part
        plans.append(landed._jdf.queryExecution().optimizedPlan().toString())
        return boards.greenhouse(landed.mapInPandas(seen, landed.schema))
    store = TableStore(spark, str(tmp_path / "store"))
    ingest.ingest_stream(ingest.landed_stream(spark, str(tmp_path / "landed")), parser, ingest.board_records, store,
                         str(tmp_path / "cp"), NOW).awaitTermination()
    assert store.read("jobs").count() == 40 and store.read("crawl_runs").first().pages_fetched == 40
    with open(seen_file) as file:
        assert len(file.read()) == 40
    assert [f"Repartition {spark.sparkContext.defaultParallelism}, true" in p for p in plans] == [True]


def test_posting_lists_by_brute_force_and_no_row_per_trigram(spark, rows):
    names = ["Acme Labs", "İstanbul 𝒳yz", "ab", "", None]
    titles = ["Engineer", "engineering", "aaaa", "ÉÉÉ dev", "x", None]
    jobs = rows("bucket int, file string, pos long, title string, company_id long", *[
        (n % 2, f"f{n % 3}", n, titles[n % 6], n % 6 if n % 11 else None) for n in range(60)]).repartition(4)
    companies = rows("id long, name string", *enumerate(names))
    made = text_index.posting_lists(jobs, companies)
    low = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in {*names, *titles} if t], "t string").select("t", F.lower("t")).collect()}
    want = {(r.bucket, r.file, field, low[t][i:i + 3], r.pos) for r in jobs.collect()
            for field, t in (("title", r.title), ("company", names[r.company_id] if (r.company_id or 0) < 5 and r.company_id is not None else None))
            if t for i in range(len(low[t]) - 2)}
    got = [(r.bucket, r.file, r.field, r.gram, p) for r in made.collect() for p in r.rows]
    assert len(got) == len(set(got)) and set(got) == want
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_stream_dedupe(spark, rows, tmp_path):
    events = rows("source string, id string, ts timestamp", ("a", "1", datetime(2025, 1, 1)), ("a", "1", datetime(2025, 1, 1, 0, 5)),
                  ("b", "1", datetime(2025, 1, 1)))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = dedupe.first_sightings(stream, ["source", "id"], "ts").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


JOBS = "id long, provider string, company_id long, title string, url string, posted_at timestamp, updated_at timestamp, active boolean"


def test_prune_partitions_the_table(spark, rows):
    old, new = datetime(2025, 1, 1), datetime(2025, 10, 1)
    jobs = rows(JOBS, (1, "github", 1, "a", "u", old, new, True), (2, "github", 1, "a", "u", None, old, True),
                (3, "github", 1, "a", "u", old, old, False), (4, "lever", 1, "a", "u", new, old, True),
                (5, "lever", 1, "a", "u", None, None, True), (6, "lever", 1, "a", "u", old, old, None))
    kept = maintenance.prune(jobs, 30, NOW)
    assert {r.id for r in kept.collect()} == {3, 4, 5, 6}
    assert maintenance.prune_summary(jobs, 30, NOW).first().deleted == 2
    assert maintenance.prune(jobs, 30, NOW, provider="lever").count() == 6
    with pytest.raises(ValueError):
        maintenance.is_stale(0, NOW)


def test_cleanup_keeps_rows_with_null_keys(spark, rows):
    jobs = rows(JOBS, (1, "github", 1, "a", "https://simplify.jobs/1", None, None, True), (2, "github", 1, "a", "https://d/1", None, None, True),
                (3, "github", None, "a", "https://simplify.jobs/2", None, None, True), (4, None, 1, "a", None, None, None, True),
                (5, "lever", 1, "a", "https://simplify.jobs/3", None, None, True))
    assert {r.id for r in maintenance.cleanup(jobs).collect()} == {2, 3, 4, 5}
    assert maintenance.cleanup_summary(jobs).first()[:] == (1, 1)


def test_delete_and_integrity(spark, rows):
    jobs = rows("id long, provider string, external_id string, url string, company_id long, title string, is_remote boolean, level string, active boolean",
                (1, "github", "x", "u", 1, "t", True, "mid", True), (2, "github", "x", None, 1, "t", True, "boss", True),
                (3, "nobody", None, "u", 1, "t", True, "mid", True))
    skills = rows("job_id long, skill string", (1, "a"), (1, "a"), (2, "b"))
    companies = rows("id long, slug string", (1, "a"))
    report = {r.rule: r.violations for r in maintenance.integrity_report(jobs, companies, skills).collect()}
    assert {k for k, v in report.items() if v} == {"provider-unknown", "level-unknown", "url-missing", "job-key-repeated", "job-skill-repeated"}
    left, left_skills = maintenance.delete_job(jobs, skills, 1)
    assert left.count() == 2 and left_skills.count() == 1


def test_insert_only(spark):
    stored, _ = run(spark, empty(spark), batch(spark, {"external_id": "1"}))
    result = upsert.insert_only(stored[0], stored[1], batch(
        spark, {"external_id": "1"}, {"external_id": "2"}, {"external_id": "2"}, {"external_id": None}, {"external_id": "3", "title": None}), NOW)
    added = result.jobs
    assert sorted((r.id, r.external_id) for r in added.collect()) == [(2, "2"), (3, None)]
    assert {r.seq: r.reason for r in result.rejects.collect()} == {0: "duplicate-key", 2: "duplicate-key", 4: "incomplete"}
    assert added.select(F.count_distinct("company_id")).first()[0] == 1


def test_insert_only_returns_companies_skills_and_rows_without_seq(spark):
    jobs, companies, _ = empty(spark)
    rows = [(1, "github", "a", "u", "T", "Acme", ["go", "sql"]), (None, "github", "b", "u", "T", "Acme", None), (2, "github", "c", "u", "T", "Beta", None)]
    frame = spark.createDataFrame(rows, "seq long, provider string, external_id string, url string, title string, company string, skills array<string>")
    result = upsert.insert_only(jobs, companies, frame, NOW)
    names = {r.id: r.name for r in result.companies.collect()}
    assert {(r.external_id, names[r.company_id]) for r in result.jobs.collect()} == {("a", "Acme"), ("c", "Beta")}
    assert sorted((r.job_id, r.skill) for r in result.job_skills.collect()) == [(1, "go"), (1, "sql")]
    assert [(r.seq, r.reason) for r in result.rejects.collect()] == [(None, "missing-seq")]


def one_by_one(stored, refs):
    """Companies found by references that come one after the other."""
    held, found = list(stored), []
    for slug, name in refs:
        hit = next((c for c in held if c[1] == slug), None) or next((c for c in held if c[2] == name), None)
        if hit is None:
            hit = (max([c[0] for c in held], default=0) + 1, slug, name)
            held.append(hit)
        found.append(hit[0])
    return found, held


@pytest.mark.parametrize("stored, refs", [
    ([], [("a", "X"), ("b", "X"), ("b", "Y")]),
    ([(7, "x", "X")], [("b", "Y"), ("b", "X")]),
    ([(7, "x", "X")], [("b", "X"), ("b", "Y"), ("b", "X"), ("c", "Y"), ("c", "Z"), ("c", "Y")]),
    *[([(1, "s0", "n9"), (2, "s1", "n1")], [(f"s{rng.randrange(8)}", f"n{rng.randrange(8)}") for _ in range(40)])
      for rng in map(random.Random, range(3))],
])
def test_companies_are_found_as_if_one_by_one(spark, stored, refs):
    companies = spark.createDataFrame([(i, n, s) for i, s, n in stored], "id long, name string, slug string")
    frame = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(refs)], "seq long, slug string, company string")
    mapping, created = upsert.resolve_companies(frame, companies)
    found = upsert._with_company(frame, mapping, "seq")
    want, held = one_by_one(stored, refs)
    assert [r.company_id for r in found.orderBy("seq").collect()] == want
    assert sorted((r.id, r.slug, r.name) for r in created.collect()) == held[len(stored):]


def test_overlapping_writers_and_broken_logs(spark, tmp_path):
    company = [spark.createDataFrame([(k, f"n{k}", f"s{k}")], "id long, name string, slug string") for k in range(3)]
    company = [upsert.conform(c, schemas.COMPANIES) for c in company]
    store, other = TableStore(spark, str(tmp_path / "s")), TableStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.read("companies").count() == 0
    store.write({"companies": company[0]}, NOW)
    # the other writer made its tables from the version before this one's
    seen = other.snapshot()
    store.write({"companies": company[1]}, NOW)
    with pytest.raises(tables.ConcurrentWrite):
        other.write({"companies": company[2]}, NOW, base=seen)
    assert [r.id for r in store.read("companies").collect()] == [1] and store.version() == 2
    # a writer that died before it filled its log file leaves no version, and its number is not used again
    (tmp_path / "s" / "_log" / "000000000003.json").touch()
    assert store.version() == 2 and store.write({"companies": company[2]}, NOW) == 4
    assert [r.id for r in store.read("companies").collect()] == [2]
    for path in (tmp_path / "s" / "_log").iterdir():
        path.unlink()
    (tmp_path / "s" / "_log").rmdir()
    with pytest.raises(ValueError):
        store.read("companies")


def rows_of(store, *columns, table="jobs"):
    return sorted(map(tuple, store.read(table).select(*columns).collect()), key=repr)


def folders(tmp_path, table="jobs"):
    return {str(p.relative_to(tmp_path)) for p in (tmp_path / "s" / table).rglob("*.parquet")}


def ids_in(buckets, bucket, n, spark):
    """External ids whose bucket is the given one."""
    found = spark.range(4000).select(F.concat(F.lit("e"), "id").alias("e")).filter(tables.key_bucket(F.col("e"), buckets) == bucket)
    return [r.e for r in found.limit(n).collect()]


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), buckets=4)
    own = {b: ids_in(4, b, 3, spark) for b in range(4)}
    upkeep.upsert_batch(store, batch(spark, *[{"external_id": e, "skills": ["go"]} for b in own for e in own[b]]), NOW)
    before = folders(tmp_path), folders(tmp_path, "job_skills")
    upkeep.upsert_batch(store, batch(spark, {"external_id": own[2][0], "title": "Changed", "legacy_external_id": "not stored"}), NOW)
    for table, old in zip(("jobs", "job_skills"), before):
        named = {f"s/{table}/write={w}/bucket={b}" for b, writes in store.snapshot().held(table).items() for w in writes}
        kept = {f for f in old if any(f.startswith(n) for n in named)}
        assert {f for f in old if "bucket=2" not in f} == kept and not any("bucket=2" in f for f in kept)
    assert store.read("jobs").count() == 12 and store.read("jobs").filter("title = 'Changed'").count() == 1
    assert rows_of(store, "job_id", "skill", table="job_skills") == [(i, "go") for i in sorted(range(1, 13), key=lambda i: repr((i, "go")))]


def test_rekeyed_jobs_move_to_their_bucket_with_their_skills(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), buckets=8)
    old, new = ids_in(8, 1, 1, spark)[0], ids_in(8, 5, 1, spark)[0]
    upkeep.upsert_batch(store, batch(spark, {"external_id": old, "skills": ["go", "sql"]}), NOW)
    upkeep.upsert_batch(store, batch(spark, {"external_id": new, "legacy_external_id": old}), NOW)
    assert rows_of(store, "id", "external_id") == [(1, new)]
    assert set(store.snapshot().held("jobs")) == {5} == set(store.snapshot().held("job_skills"))
    assert rows_of(store, "job_id", "skill", table="job_skills") == [(1, "go"), (1, "sql")]


def beaten(store, monkeypatch, faster):
    """Another writer commits after the first upsert has read the store."""
    real, calls = upkeep.upsert, []

    def late(*args, **kw):
        result = real(*args, **kw)
        if not calls:
            calls.append(1)
            faster()
        return result
    monkeypatch.setattr(upkeep, "upsert", late)
    return calls


@pytest.mark.parametrize("same", [True, False])
def test_no_row_is_lost_when_writers_overlap(spark, tmp_path, monkeypatch, same):
    store, other = (TableStore(spark, str(tmp_path / "s"), buckets=4) for _ in range(2))
    a, b = ids_in(4, 1, 2, spark)
    c = ids_in(4, 3, 1, spark)[0]
    upkeep.upsert_batch(store, batch(spark, {"external_id": "one"}), NOW)
    theirs = b if same else c
    beaten(store, monkeypatch, lambda: upkeep.upsert_batch(other, batch(spark, {"external_id": theirs}), NOW))
    upkeep.upsert_batch(store, batch(spark, {"external_id": a}), NOW)
    assert sorted(r.external_id for r in store.read("jobs").collect()) == sorted(["one", theirs, a])
    assert store.read("jobs").select(F.count_distinct("id")).first()[0] == 3
    assert store.version() == 3 and store.vacuum() == 0


def test_prune_beside_an_upsert_of_the_same_bucket(spark, tmp_path, monkeypatch):
    store, other = (TableStore(spark, str(tmp_path / "s"), buckets=1) for _ in range(2))
    upkeep.upsert_batch(store, batch(spark, {"external_id": "old", "posted_at": datetime(2024, 1, 1)}, {"external_id": "new"}), NOW)
    beaten(store, monkeypatch, lambda: upkeep.prune(other, NOW, days=30))
    upkeep.upsert_batch(store, batch(spark, {"external_id": "new", "title": "T"}), NOW)
    assert rows_of(store, "external_id", "title") == [("new", "T")]


def test_a_replayed_batch_that_another_writer_published_is_left_alone(spark, tmp_path, monkeypatch):
    store, other = (TableStore(spark, str(tmp_path / "s")) for _ in range(2))
    rows = batch(spark, {"external_id": "a"})
    beaten(store, monkeypatch, lambda: upkeep.upsert_batch(other, rows, NOW, batch_id=7))
    upkeep.upsert_batch(store, rows, NOW, batch_id=7)
    assert store.version() == 1 and store.read("crawl_runs").count() == 1


def filled(spark, tmp_path, **options):
    store = TableStore(spark, str(tmp_path / "s"), **options)
    days = [None if n % 9 == 0 else datetime(2025, 1 + n % 9, 1 + n % 27) for n in range(90)]
    upkeep.upsert_batch(store, batch(spark, *[
        {"external_id": f"e{n}", "posted_at": day, "skills": ["go"], "provider": ["github", "lever"][n % 2],
         "title": ["Senior Engineer", "Engineer I"][n % 2], "description": ["5+ years", None][n % 2]} for n, day in enumerate(days)]), NOW)
    return store


def test_deletions_write_no_data_file_until_compaction(spark, tmp_path):
    store = filled(spark, tmp_path, buckets=4)
    data = [folders(tmp_path), folders(tmp_path, "job_skills")]
    want = [r.id for r in maintenance.prune(store.read("jobs"), 60, NOW).orderBy("id").collect()]
    upkeep.prune(store, NOW, days=60)
    assert [r.id for r in store.read("jobs").orderBy("id").collect()] == want and 0 < len(want) < 90
    assert [r.job_id for r in store.read("job_skills").orderBy("job_id").collect()] == want
    upkeep.delete_jobs(store, store.read("jobs").limit(1), NOW)
    assert store.read("jobs").count() == store.read("job_skills").count() == len(want) - 1
    assert [folders(tmp_path), folders(tmp_path, "job_skills")] == data
    left = rows_of(store, "id", "external_id", "posted_at")
    version = store.compact(NOW)
    assert version == store.version() and rows_of(store, "id", "external_id", "posted_at") == left
    assert not any(store.snapshot().deletes["jobs"].values()) and store.compact(NOW) == version
    assert store.vacuum(keep=1) > 0 and rows_of(store, "id", "external_id", "posted_at") == left


def same_metrics(store):
    got = aggregates.maintained_metrics(store.read("metrics")).first().asDict(recursive=True)
    want = aggregates.ingestion_metrics(store.read("jobs")).first().asDict(recursive=True)
    assert got == want
    return got


def test_maintained_metrics_equal_a_recount(spark, tmp_path, rows):
    store = filled(spark, tmp_path, buckets=4)
    first = same_metrics(store)
    assert first["total"] == 90 and first["excluded_by_title"] == 45
    upkeep.upsert_batch(store, batch(spark, {"external_id": "e1", "title": "Staff Engineer"}, {"external_id": "x"}), NOW)
    same_metrics(store)
    upkeep.prune(store, NOW, days=100)
    same_metrics(store)
    upkeep.backfill(store, rows("seq long, external_id string, posted_at timestamp", (1, "e18", datetime(2025, 10, 1)), (2, "e0", None)), NOW)
    same_metrics(store)
    upkeep.insert_batch(store, batch(spark, {"external_id": "e1"}, {"external_id": "y"}, {"external_id": None}), NOW)
    last = same_metrics(store)
    store.compact(NOW, share=0.0)
    assert same_metrics(store) == last != first
    upkeep.delete_jobs(store, store.read("jobs"), NOW)
    assert same_metrics(store)["total"] == 0


def test_backfill_through_the_store_equals_the_operator(spark, tmp_path, rows):
    store = filled(spark, tmp_path, buckets=4)
    scraped = rows("seq long, external_id string, posted_at timestamp", (1, "e0", datetime(2025, 9, 1)), (2, "e18", datetime(2025, 9, 2)),
                   (3, "e9", datetime(2025, 9, 3)), (4, "e1", datetime(2025, 9, 4)))
    want = sorted((r.id, r.posted_at) for r in joins.apply_backfill(store.read("jobs"), scraped).filter("posted_at IS NOT NULL").collect())
    upkeep.backfill(store, scraped, NOW)
    assert sorted((r.id, r.posted_at) for r in store.read("jobs").filter("posted_at IS NOT NULL").collect()) == want
    assert store.read("jobs").count() == 90


def test_lookups_and_recent_pages_read_fewer_files(spark, tmp_path):
    store = filled(spark, tmp_path, buckets=4, rows_per_file=5)
    snapshot = store.snapshot()
    whole = len(snapshot.read("jobs").inputFiles())
    assert whole > 16
    recent = snapshot.posted_since("2025-09-01 00:00:00", undated=False)
    assert 0 < len(recent.inputFiles()) <= whole // 2
    late = "posted_at >= '2025-09-01'"
    assert recent.filter(late).count() == store.read("jobs").filter(late).count() > 0
    ids = spark.createDataFrame([("e7",), ("e40",), ("none",), (None,)], "external_id string")
    found = snapshot.holding(ids)
    assert len(found.inputFiles()) <= 4 and sorted(r.external_id for r in found.collect()) == ["e40", "e7"]
    assert snapshot.buckets_holding(spark.createDataFrame([("none",)], "external_id string")) <= {0, 1, 2, 3}
    every = spark.range(90).select(F.concat(F.lit("e"), "id").alias("external_id"))
    assert snapshot.holding(every).count() == 90
    upkeep.prune(store, NOW, days=60)
    assert store.snapshot().holding(every).count() == store.read("jobs").count() < 90


def test_runs_are_logged_in_the_batch_s_version(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    upkeep.upsert_batch(store, batch(spark, {"external_id": "1"}, {"external_id": "2", "provider": "lever"}, {"external_id": ""},
                                     {"external_id": "3", "provider": "elsewhere"}), "2025-10-01 00:00:00")
    upkeep.upsert_batch(store, batch(spark, {"external_id": "4"}), NOW, pages=lambda: 5, notes="again")
    upkeep.upsert_batch(store, batch(spark).limit(0), "2026-01-01 00:00:00")
    assert rows_of(store, "id", "provider", "jobs_discovered", "errors", "pages_fetched", "notes", table="crawl_runs") == [
        (1, "github", 1, 1, None, None), (2, "lever", 1, 0, None, None), (3, "other", 1, 0, None, None), (4, "github", 1, 0, 5, "again")]
    assert aggregates.last_ingest(store.read("crawl_runs")).first()[0] == datetime(2025, 10, 5)


def test_legacy_ids_are_looked_up_only_in_buckets_the_batch_leaves_out(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path, buckets=4)
    asked = []
    found = tables.skipping.files_holding
    monkeypatch.setattr(tables.skipping, "files_holding", lambda keys, *rest: asked.append(
        {r.bucket for r in keys.collect()}) or found(keys, *rest))
    few = batch(spark, {"external_id": "n1", "legacy_external_id": "e7"}, {"external_id": "n2", "legacy_external_id": "e8"}, start=1000)
    own = {r[0] for r in few.select(tables.key_bucket(F.col("external_id"), 4)).collect()}
    old = {r[0] for r in few.select(tables.key_bucket(F.col("legacy_external_id"), 4)).collect()}
    before = {r.external_id: r.id for r in store.read("jobs").filter("external_id IN ('e7', 'e8')").collect()}
    upkeep.upsert_batch(store, few, NOW)
    assert asked == ([old - own] if own != {0, 1, 2, 3} else [])
    assert {r.external_id: r.id for r in store.read("jobs").filter("external_id IN ('n1', 'n2')").collect()} == {
        "n1": before["e7"], "n2": before["e8"]}
    asked.clear()
    many = batch(spark, *[{"external_id": f"m{n}", "legacy_external_id": f"e{n}"} for n in range(9, 60)], start=2000)
    upkeep.upsert_batch(store, many, NOW)
    assert not asked
    assert store.read("jobs").count() == 90 and store.read("jobs").filter("external_id LIKE 'm%'").count() == 51


def test_rows_without_a_key_enter_no_join(spark):
    some = batch(spark, {"external_id": "1"}, {"external_id": None}, {"external_id": ""}, {"external_id": "2", "provider": None},
                 {"external_id": "3", "provider": ""})
    resolved = upsert.resolve(upsert.prepared(some), upsert.conform(empty(spark)[0], schemas.JOBS))
    assert sorted((r.seq, r.reason) for r in resolved.filter("seq > 0").collect()) == [
        (1, "missing-external-id"), (2, "missing-external-id"), (3, "missing-provider"), (4, "missing-provider")]
    assert [(r.reason, r.state_id) for r in resolved.filter("seq = 0").collect()] == [(None, None)]
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Union") or "Union" in "".join(plan.splitlines()[:4])


def test_skills_lie_beside_the_jobs_a_commit_has_written(spark, tmp_path, rows):
    store = filled(spark, tmp_path, buckets=4)
    base = store.snapshot()
    skills = rows("job_id long, skill string, score int", *[(r.id, "go", 1) for r in store.read("jobs").collect()], (10**6, "go", 1))
    store.commit(base, NOW, replace={"jobs": (base.read("jobs"), range(4)), "job_skills": (skills, range(4))})
    now = store.snapshot()
    jobs = {r.id: r.bucket for r in now.read("jobs", placed=True).collect()}
    placed = {r.job_id: r.bucket for r in now.read("job_skills", placed=True).collect()}
    assert len(placed) == 91 and {k: b for k, b in placed.items() if k in jobs} == jobs


def test_text_search_reads_candidates_only(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), buckets=4, rows_per_file=4)
    titles = ["Front-End Engineer", "frontend dev", "Back End", "İstanbul Engineer", "QA", "x", None and "", "100% Remote_Dev"]
    records = [{"external_id": f"e{n}", "title": titles[n % 8] or "Other", "company": f"Company {n % 5}"} for n in range(80)]
    upkeep.upsert_batch(store, batch(spark, *records), NOW)
    upkeep.upsert_batch(store, batch(spark, {"external_id": "e2", "title": "FRONT again"}, {"external_id": "z", "company": "Frontier Inc"}, start=90), NOW)
    upkeep.delete_jobs(store, store.read("jobs").filter("external_id = 'e1'"), NOW)
    snapshot = store.snapshot()
    companies, skills = snapshot.read("companies"), snapshot.read("job_skills")
    for q in ("front", "FRONT-end", "nt_end", "istan", "İstan", "QA", "ny 3", "mote_d", "100%mote", "nothing here", "%", "on%ier"):
        search = browse.Search(q=q, limit=200, provider="github")
        want = sorted(r.id for r in browse.matching_jobs(snapshot.read("jobs"), companies, skills, search, NOW).collect())
        got = browse.matching_jobs(browse.stored_jobs(snapshot, search, NOW), companies, skills, search, NOW)
        assert sorted(r.id for r in got.collect()) == want, q
    whole, few = snapshot.read("jobs").inputFiles(), snapshot.mentioning("Frontier").inputFiles()
    assert len(whole) > 12 and len([f for f in few if "/s/jobs/" in f]) == 1
    assert browse.browse_stored(snapshot, browse.Search(q="again", provider="github"), NOW).header.first().total == 1


@pytest.mark.parametrize("undated", [0, 40])
def test_seek_pages_equal_offset_pages(spark, tmp_path, undated):
    store = TableStore(spark, str(tmp_path / "s"), buckets=2, rows_per_file=10)
    pick = random.Random(undated)
    days = [datetime(2025, 1, 1 + pick.randrange(20)) for _ in range(130)] + [None] * undated
    upkeep.upsert_batch(store, batch(spark, *[{"external_id": f"e{n}", "posted_at": d, "title": f"Engineer {n % 3}"} for n, d in enumerate(days)]), NOW)
    upkeep.prune(store, "2025-02-03 00:00:00", days=30)
    snapshot = store.snapshot()
    tables_ = [snapshot.read(t) for t in ("jobs", "companies", "job_skills")]
    for q in (None, "engineer 1"):
        after, number = None, 0
        while number < 12:
            search = browse.Search(q=q, limit=17, provider="github")
            want = browse.browse(*tables_, browse.Search(q=q, limit=17, offset=17 * number, provider="github"), NOW).items.collect()
            got = browse.seek(snapshot, search, NOW, after).collect()
            assert [tuple(r) for r in got] == [tuple(r) for r in want]
            if not got:
                break
            after, number = (got[-1].posted_at, got[-1].id), number + 1
        assert number >= 2


def test_a_late_page_reads_as_few_files_as_the_first(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "s"), buckets=1, rows_per_file=5)
    days = [datetime(2025, 1 + n % 9, 1 + n % 28) for n in range(300)]
    upkeep.upsert_batch(store, batch(spark, *[{"external_id": f"e{n}", "posted_at": d} for n, d in enumerate(days)]), NOW)
    snapshot, read = store.snapshot(), []
    real = tables.Snapshot.read
    monkeypatch.setattr(tables.Snapshot, "read", lambda self, t, **kw: (read.append(len(list(kw["files"]))) if kw.get("files") else None, real(self, t, **kw))[1])
    monkeypatch.setattr(browse, "FIRST_FILES", 4)
    search = browse.Search(limit=10, provider="github")
    browse.seek(snapshot, search, NOW)
    first, middle = sum(read), sorted(days)[150]
    read.clear()
    browse.seek(snapshot, search, NOW, (middle, 10 ** 9))
    assert first <= 12 and sum(read) <= first + 4


@pytest.mark.parametrize("seed", range(3))
def test_components_by_brute_force(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(120), pick.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 500)]
    edges += [(1000, n) for n in range(1001, 1200)] + [(7, 7), (None, 3)]
    pick.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in edges:
        if u is not None and u != v:
            root[max(find(u), find(v))] = min(find(u), find(v))
    want = {n: find(n) for n in list(root)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_chain_of_renames_takes_a_bounded_number_of_jobs(spark, monkeypatch):
    # each pair shares its slug with the pair before and its name with the next, so all wait for the first
    refs = [(f"s{n // 2}", f"n{(n + 1) // 2}") for n in range(10_000)]
    writes = []
    for module in (upsert, graph):
        monkeypatch.setattr(module, "cut_lineage", lambda df, real=module.cut_lineage: (writes.append(1), real(df))[1])
    frame = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(refs)], "seq long, slug string, company string")
    _, created = upsert.resolve_companies(frame, spark.createDataFrame([], "id long, name string, slug string"))
    _, held = one_by_one([], refs[:400])
    got = sorted((r.id, r.slug, r.name) for r in created.collect())
    assert got[:len(held) - 1] == held[:len(held) - 1] and len(got) == 5000
    assert len(writes) < 60


def test_first_sightings_are_kept_over_batches_and_restarts(spark, tmp_path):
    import time

    layout = "source string, id string, ts timestamp, n int"
    at = lambda hour, minute=0: datetime(2025, 1, 1, hour, minute)
    # the last row of each batch moves the watermark for the next one
    batches = [
        ([("a", "1", at(1), 1), ("a", "1", at(0, 30), 2), ("b", "1", at(1), 3)], {2, 3}),
        ([("a", "1", at(2), 4), ("c", "1", at(5), 5)], {5}),
        ([("a", "2", at(3), 6), ("a", "3", at(4, 30), 7), ("b", "1", at(4, 30), 8)], {7, 8}),  # 6 is behind the watermark
        ([("c", "1", at(6), 9), ("a", "1", at(9), 10), ("z", "1", at(9), 11)], {10, 11}),
        ([("z", "1", at(8, 30), 12), ("y", "1", at(8, 30), 13)], {13}),
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", dedupe.ROCKSDB)
    try:
        want = set()
        for rows_, new in batches:
            spark.createDataFrame(rows_, layout).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            # every batch is a restart from the checkpoint
            dedupe.first_sightings_kept(stream, ["source", "id"], "ts", "1 hour", 3).writeStream.format("parquet").option(
                "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
            want |= new
            assert {r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
            time.sleep(1.1)  # files are taken in the order of their times
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
