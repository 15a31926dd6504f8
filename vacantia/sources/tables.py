"""Stored tables: Parquet folders in hash buckets, and a log of versions.

A row's bucket is a hash of its job's external id, so a batch meets its stored jobs, and those it re-keys, in the buckets of
its own ids. Every commit writes folders of its own, which no other uses, and publishes them by one log file that names, for
each table and bucket, the writes that make it up. Files of buckets that a commit does not touch stay as they are.

Deletions write no data: they list positions (file, row) that reads leave out, until ``compact`` rewrites a bucket.

A commit starts from a snapshot. If others have committed since, it is published on top of theirs as long as they changed
none of the buckets it read or changes; else it fails with ConcurrentWrite, and the caller reads again. Log files are
written under a temporary name and renamed without overwriting, so a lost job leaves at most folders that no version names.
"""

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import schemas
from vacantia.functions.exprs import as_timestamp
from vacantia.operators.aggregates import metric_flags, metric_rows
from vacantia.session import cut_lineage
from vacantia.sources import skipping, text_index

LAYOUTS = {
    "companies": schemas.COMPANIES,
    "jobs": schemas.JOBS,
    "job_skills": schemas.JOB_SKILLS,
    "crawl_runs": schemas.CRAWL_RUNS,
    "metrics": schemas.METRICS,
}
# The other tables are small beside these and make one bucket.
BUCKETED = ("jobs", "job_skills", "metrics")
# Buckets of a new store, and rows per file; a store keeps its number of buckets.
BUCKETS, ROWS_PER_FILE = 16, 1_000_000
# What is kept beside the files of jobs to choose them by.
INDEXES = {**skipping.LAYOUTS, "grams": text_index.LAYOUT}
# Share of deleted rows from which on a bucket is rewritten by ``compact``.
COMPACT_SHARE = 0.2

_FOLDERS = (*LAYOUTS, *(f"_deleted/{t}" for t in LAYOUTS), *(f"_{kind}/jobs" for kind in INDEXES))
_LOG = "version long, stream string, batch_id long, committed_at timestamp"
_PLACE = [T.StructField("write", T.StringType()), T.StructField("bucket", T.IntegerType())]


class ConcurrentWrite(RuntimeError):
    """Another writer changed what this commit was made from; read again and repeat."""


def key_bucket(external_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(external_id), F.lit(buckets)).cast("int")


def job_bucket(buckets: int) -> Column:
    """Jobs without an external id, which nothing looks up, are spread by their url and title."""
    other = F.concat(F.lit("\0"), F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")))
    return key_bucket(F.coalesce("external_id", other), buckets)


@dataclass(frozen=True)
class Snapshot:
    """One version of the store: which writes make up each bucket, which deletions hold, and the largest ids."""

    store: "TableStore"
    version: int = 0
    buckets: int = BUCKETS
    parts: dict = field(default_factory=dict)
    deletes: dict = field(default_factory=dict)
    rows: dict = field(default_factory=dict)
    top: dict = field(default_factory=dict)

    def held(self, table: str) -> dict[int, list[str]]:
        """The writes of each bucket that has rows."""
        return {int(b): writes for b, writes in self.parts.get(table, {}).items() if writes}

    def read(self, table: str, buckets: Iterable[int] | None = None, files: Iterable[str] | None = None,
             placed: bool = False) -> DataFrame:
        """A table, or some of its buckets or files; ``placed`` adds bucket, file and pos of each row."""
        held, deletes = self.held(table), self.deletes.get(table, {})
        wanted = set(held) if buckets is None else set(buckets) & set(held)
        root = f"{self.store.root}/{table}"
        if files is not None:
            chosen = {b: [] for b in wanted}
            for f in files:
                bucket = int(f.split("/bucket=")[1].split("/")[0])
                if bucket in wanted:
                    chosen[bucket].append(f"{root}/{f}")
        else:
            chosen = {b: [f"{root}/write={w}/bucket={b}" for w in held[b]] for b in wanted}
        clean = [p for b, paths in sorted(chosen.items()) if not deletes.get(str(b)) for p in paths]
        marked = [p for b, paths in sorted(chosen.items()) if deletes.get(str(b)) for p in paths]
        columns = LAYOUTS[table].fieldNames()
        place = ["bucket", F.substring_index("_metadata.file_path", f"/{table}/", -1).alias("file"),
                 F.col("_metadata.row_index").alias("pos")]
        out = self._load(table, clean).select(*columns, *(place if placed else []))
        if marked:
            gone = self._deleted(table, [b for b in sorted(chosen) if deletes.get(str(b))])
            left = self._load(table, marked).select(*columns, *place).join(gone, ["file", "pos"], "left_anti")
            left = left.select(*columns, *(["bucket", "file", "pos"] if placed else []))
            out = out.unionByName(left) if clean else left
        return out

    def _load(self, table: str, paths: list[str]) -> DataFrame:
        spark, layout = self.store.spark, T.StructType([*LAYOUTS[table].fields, *_PLACE])
        if not paths:
            meta = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("row_index", T.LongType())])
            return spark.createDataFrame([], T.StructType([*layout.fields, T.StructField("_metadata", meta)]))
        return spark.read.schema(layout).option("basePath", f"{self.store.root}/{table}").parquet(*paths)

    def _deleted(self, table: str, buckets: Iterable[int]) -> DataFrame:
        root = f"{self.store.root}/_deleted/{table}"
        paths = [f"{root}/write={w}/bucket={b}" for b in buckets for w in self.deletes.get(table, {}).get(str(b), [])]
        return self.store.spark.read.schema("file string, pos long, write string, bucket int").option(
            "basePath", root).parquet(*paths).select("file", "pos")

    def index(self, kind: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """File statistics (``files``), filter bits (``keys``) or posting lists (``grams``) of the stored jobs."""
        held = self.held("jobs")
        root = f"{self.store.root}/_{kind}/jobs"
        paths = [f"{root}/write={w}/bucket={b}" for b in (held if buckets is None else set(buckets) & set(held)) for w in held[b]]
        layout = INDEXES[kind]
        if not paths:
            return self.store.spark.createDataFrame([], f"{layout}, write string, bucket int")
        return self.store.spark.read.schema(f"{layout}, write string, bucket int").option("basePath", root).parquet(*paths)

    def posted_since(self, since, undated: bool = True) -> DataFrame:
        """Jobs of the files that can hold a posting from ``since`` on, or an undated one; not filtered themselves."""
        return self.read("jobs", files=skipping.recent_files(self.index("files"), since, undated))

    def mentioning(self, q: str) -> DataFrame:
        """Jobs that may match a LIKE text in title or company name, from the files that hold one; all if it is too short."""
        wanted = text_index.asked(self.store.spark, q)
        if not wanted:
            return self.read("jobs")
        places = cut_lineage(text_index.candidates(self.index("grams"), wanted))
        files = [r.file for r in places.select("file").distinct().collect()]
        return self.read("jobs", files=files, placed=True).join(places, ["file", "pos"], "left_semi").drop("bucket", "file", "pos")

    def holding(self, external_ids: DataFrame) -> DataFrame:
        """The stored jobs with one of the ids (one column, external_id), from the files whose filter may hold one."""
        keys = external_ids.select("external_id").distinct().withColumn("bucket", key_bucket(F.col("external_id"), self.buckets))
        found = skipping.files_holding(keys, self.index("files"), self.index("keys"))
        return self.read("jobs", files=found).join(keys.select("external_id"), "external_id", "left_semi")

    def buckets_holding(self, external_ids: DataFrame, but: Iterable[int] = ()) -> set[int]:
        """Buckets in which one of the ids may be stored; those in ``but`` are known already and not looked through.

        An id is tried against every file of its bucket, so ids and files together must not grow with a batch that has rows in
        every bucket anyway.
        """
        left = sorted(set(self.held("jobs")) - set(but))
        if not left:
            return set()
        keys = external_ids.select("external_id").withColumn("bucket", key_bucket(F.col("external_id"), self.buckets)).filter(
            F.col("bucket").isin(left)).distinct()
        found = skipping.files_holding(keys, self.index("files", left), self.index("keys", left))
        return {int(f.split("/bucket=")[1].split("/")[0]) for f in found}


class TableStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.root, self.buckets, self.rows_per_file = spark, root.rstrip("/"), buckets, rows_per_file

    # ---- reading -------------------------------------------------------------------------

    def _at(self, name: str):
        """The Hadoop file system of the store, and a path below its root."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        system, path = self._at(folder)
        return sorted(f.getPath().getName() for f in system.listStatus(path)) if system.exists(path) else []

    def _numbers(self, folder: str) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names(folder) if n.endswith(".json") and not n.startswith(".")]

    def _content(self, folder: str, number: int) -> dict:
        """A numbered file, or nothing if it was never filled."""
        system, path = self._at(f"{folder}/{number:012d}.json")
        stream = system.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.strip() else {}

    def log(self) -> DataFrame:
        """Published versions; none for a store that does not exist. Tables without a log are an error, not an empty store."""
        if self._names("_log"):
            return self.spark.read.schema(_LOG).option("mode", "DROPMALFORMED").json(f"{self.root}/_log").filter(
                "version IS NOT NULL")
        for name in LAYOUTS:
            if self._names(name):
                raise ValueError(f"{self.root} has tables but no log")
        return self.spark.createDataFrame([], _LOG)

    def snapshot(self) -> Snapshot:
        """The newest version."""
        for number in sorted(self._numbers("_log"), reverse=True):
            row = self._content("_log", number)
            if row:
                return Snapshot(self, row["version"], row["buckets"], row["parts"], row["deletes"], row["rows"], row["top"])
        self.log()
        return Snapshot(self, 0, self.buckets)

    def version(self) -> int:
        return self.snapshot().version

    def has_batch(self, batch_id: int, stream: str = "") -> bool:
        """Whether a batch of a stream is published; batch numbers count per stream."""
        return not self.log().filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).isEmpty()

    def read(self, table: str) -> DataFrame:
        return self.snapshot().read(table)

    # ---- writing -------------------------------------------------------------------------

    def write(self, tables: dict[str, DataFrame], as_of, batch_id: int | None = None, stream: str = "",
              base: Snapshot | None = None) -> int:
        """Replace whole tables. Skills are laid beside their jobs, where both are stored."""
        base = base or self.snapshot()
        replace = {name: (df, None) for name, df in tables.items()}
        if "job_skills" in tables:
            jobs = tables.get("jobs", base.read("jobs"))
            replace["job_skills"] = (beside_jobs(tables["job_skills"], jobs.withColumn("bucket", job_bucket(base.buckets)),
                                                 base.buckets), None)
        return self.commit(base, as_of, replace=replace, batch_id=batch_id, stream=stream)

    def commit(self, base: Snapshot, as_of, replace: dict | None = None, append: dict | None = None,
               delete: dict | None = None, batch_id: int | None = None, stream: str = "") -> int:
        """Publish changes of a snapshot together, and the metrics they change.

        ``replace`` gives tables as (rows, buckets that they make up; None for the whole table), ``append`` rows to add and
        ``delete`` rows to leave out, read with their place. Rows of bucketed tables may bring their ``bucket``; skills without
        one are laid beside the jobs that the commit has written before them.
        """
        own = f"v{base.version + 1}-{uuid.uuid4().hex[:12]}"
        change = _Change(own)
        if not self._names("_log"):
            self._create("_log", 0, self._row(0, base, {}, {"parts": {}, "deletes": {}, "rows": {}, "top": {}}, as_of, None, ""))
        try:
            self._refuse_conflicts(base, change)
            # the companies that jobs will name
            named = replace["companies"][0] if "companies" in (replace or {}) else base.read("companies")
            if "companies" in (append or {}):
                named = named.unionByName(append["companies"])
            gone = {t: cut_lineage(metric_flags(df) if t == "jobs" else df.select("bucket", "file", "pos"))
                    for t, df in (delete or {}).items()}
            for table, (df, buckets) in (replace or {}).items():
                whole = range(base.buckets) if table in BUCKETED else [0]
                self._put(change, base, own, table, df, whole if buckets is None else buckets, named)
            for table, df in (append or {}).items():
                self._put(change, base, own, table, df, None, named)
            for table, df in gone.items():
                self._delete(change, own, table, df)
            self._count(change, own, gone.get("jobs"))
            return self._publish(base, change, as_of, batch_id, stream)
        except ConcurrentWrite:
            self._discard(own)
            raise

    def _put(self, change: "_Change", base: Snapshot, own: str, table: str, df: DataFrame, buckets: Iterable[int] | None,
             companies: DataFrame | None = None) -> None:
        """Write rows into a folder of the commit, laid out by bucket."""
        layout = LAYOUTS[table].fieldNames()
        if table not in BUCKETED:
            df = df.withColumn("bucket", F.lit(0))
        elif "bucket" not in df.columns and table == "job_skills" and "jobs" in change.written:
            df = beside_jobs(df, self._fresh("jobs", own, change.written["jobs"]), base.buckets)
        elif "bucket" not in df.columns:
            df = df.withColumn("bucket", job_bucket(base.buckets) if table == "jobs" else key_bucket(F.col("job_id"), base.buckets))
        keys = ["bucket", "provider"] if table == "jobs" else ["bucket"]
        order = [*keys, "posted_at"] if table == "jobs" else keys
        (df.select(*layout, "bucket").hint("rebalance", "bucket").sortWithinPartitions(*order).write.option("maxRecordsPerFile", self.rows_per_file)
         .partitionBy(*keys).mode("append").parquet(f"{self.root}/{table}/write={own}"))
        change.put(table, self._rows(f"{table}/write={own}"), buckets)
        if not change.written[table]:
            self._remove(f"{table}/write={own}")
        if "id" in layout and change.written[table]:
            change.top[table] = self._fresh(table, own, change.written[table]).agg(F.max("id")).first()[0]
        if table == "jobs":
            self._describe(change, own, companies if companies is not None else base.read("companies"))

    def _rows(self, folder: str) -> dict[int, int]:
        """Rows by bucket of a folder written; file footers answer this, and the driver gets one row a bucket."""
        if not any(n.startswith("bucket=") for n in self._names(folder)):
            return {}
        rows = self.spark.read.schema("bucket int").parquet(f"{self.root}/{folder}").groupBy("bucket").count()
        return {r["bucket"]: r["count"] for r in rows.collect()}

    def _fresh(self, table: str, own: str, buckets: Iterable[int]) -> DataFrame:
        """What this commit has written to a table."""
        return Snapshot(self, parts={table: {str(b): [own] for b in buckets}}).read(table, placed=True)

    def _describe(self, change: "_Change", own: str, companies: DataFrame) -> None:
        """File statistics, key filters and posting lists of the jobs written, for choosing files before a scan."""
        fresh = self._fresh("jobs", own, change.written["jobs"])
        if change.written["jobs"]:
            skipping.file_statistics(fresh).write.partitionBy("bucket").mode("append").parquet(f"{self.root}/_files/jobs/write={own}")
            files = self.spark.read.schema(f"{skipping.LAYOUTS['files']}, bucket int").parquet(f"{self.root}/_files/jobs/write={own}")
            for kind, rows in (("keys", skipping.key_filters(fresh, files)), ("grams", text_index.posting_lists(fresh, companies))):
                rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("append").parquet(f"{self.root}/_{kind}/jobs/write={own}")

    def _delete(self, change: "_Change", own: str, table: str, df: DataFrame) -> None:
        folder = f"_deleted/{table}/write={own}"
        df.select("file", "pos", "bucket").hint("rebalance", "bucket").write.partitionBy("bucket").mode(
            "append").parquet(f"{self.root}/{folder}")
        change.delete(table, self._rows(folder))
        if not change.deletes[table]:
            self._remove(folder)

    def _count(self, change: "_Change", own: str, gone: DataFrame | None) -> None:
        """Metrics of the jobs written take the place of their buckets' or add to them; deleted jobs are taken off."""
        rows = []
        if change.written.get("jobs"):
            rows.append(metric_rows(metric_flags(self._fresh("jobs", own, change.written["jobs"]))))
        if change.deletes.get("jobs"):
            rows.append(metric_rows(gone, sign=-1))
        for part in rows:
            part.write.partitionBy("bucket").mode("append").parquet(f"{self.root}/metrics/write={own}")
        if rows or "jobs" in change.replaced:
            change.put("metrics", self._rows(f"metrics/write={own}"), change.replaced.get("jobs"))

    def _publish(self, base: Snapshot, change: "_Change", as_of, batch_id: int | None, stream: str) -> int:
        while True:
            newest = self.snapshot()
            self._refuse_conflicts(base, change)
            version = 1 + max(self._numbers("_log"))
            if self._create("_log", version, self._row(version, base, change.changed(), change.on(newest), as_of, batch_id, stream)):
                return version

    def _row(self, version: int, base: Snapshot, changed: dict, state: dict, as_of, batch_id: int | None, stream: str) -> dict:
        moment = self.spark.range(1).select(as_timestamp(as_of).cast("string")).first()[0]
        return {"version": version, "stream": stream, "batch_id": batch_id, "committed_at": moment, "buckets": base.buckets,
                "changed": changed, **state}

    def _refuse_conflicts(self, base: Snapshot, change: "_Change") -> None:
        mine = change.changed()
        for number in self._numbers("_log"):
            if number > base.version:
                other = self._content("_log", number).get("changed", {})
                both = [t for t, buckets in mine.items() if set(buckets) & set(other.get(t, []))]
                if both:
                    raise ConcurrentWrite(f"version {number} of {self.root} changed {', '.join(both)} meanwhile")

    def _create(self, folder: str, number: int, row: dict) -> bool:
        """Create a numbered file with its content at once; False if the number is taken."""
        system, path = self._at(f"{folder}/{number:012d}.json")
        if system.exists(path):
            return False
        _, draft = self._at(f"{folder}/.{number:012d}-{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            system.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, path, options)
            return True
        except Py4JJavaError as error:
            system.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise

    def _discard(self, own: str) -> None:
        """Remove the folders of a commit that was not published."""
        for folder in _FOLDERS:
            self._remove(f"{folder}/write={own}")

    def _remove(self, folder: str) -> None:
        system, path = self._at(folder)
        system.delete(path, True)

    def reserve_ids(self, table: str, n: int, base: Snapshot) -> int:
        """Take ``n`` ids that no other writer gets; returns the one before the first.

        Reservations are numbered files. A writer that dies leaves a gap.
        """
        if not n:
            return base.top.get(table, 0)
        while True:
            taken = self._numbers(f"_ids/{table}")
            last = self._content(f"_ids/{table}", max(taken)).get("last", 0) if taken else 0
            first = max(last, base.top.get(table) or 0)
            if self._create(f"_ids/{table}", 1 + max(taken, default=0), {"last": first + n}):
                return first

    # ---- upkeep --------------------------------------------------------------------------

    def compact(self, as_of, share: float = COMPACT_SHARE) -> int:
        """Rewrite the buckets of which more than this share of rows is deleted; returns the version then current."""
        base = self.snapshot()
        replace = {}
        for table in ("jobs", "job_skills"):
            full = [int(b) for b, (n, gone) in base.rows.get(table, {}).items() if gone > share * n]
            if full:
                rows = base.read(table, full, placed=True)
                replace[table] = (rows.drop("file", "pos"), full)
        return self.commit(base, as_of, replace=replace) if replace else base.version

    def vacuum(self, keep: int = 10) -> int:
        """Remove folders that none of the newest ``keep`` versions names. Run it while nobody writes; returns how many."""
        named = set()
        for number in sorted(self._numbers("_log"))[-keep:]:
            row = self._content("_log", number)
            for kind in ("parts", "deletes"):
                for table, buckets in row.get(kind, {}).items():
                    named |= {(f"_deleted/{table}" if kind == "deletes" else table, w) for writes in buckets.values() for w in writes}
        named |= {(f, w) for t, w in list(named) if t == "jobs" for f in (f"_{kind}/jobs" for kind in INDEXES)}
        removed = 0
        for folder in _FOLDERS:
            for name in self._names(folder):
                if name.startswith("write=") and (folder, name[len("write="):]) not in named:
                    self._remove(f"{folder}/{name}")
                    removed += 1
        return removed


def beside_jobs(job_skills: DataFrame, jobs: DataFrame, buckets: int) -> DataFrame:
    """Skills with the bucket of their job (id, bucket); those of no job are spread by its id."""
    placed = jobs.select(F.col("id").alias("job_id"), "bucket")
    return job_skills.select(*schemas.JOB_SKILLS.fieldNames()).join(placed, "job_id", "left").withColumn(
        "bucket", F.coalesce("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")))


class _Change:
    """What a commit changes, by table and bucket, to be laid over any snapshot that it does not conflict with."""

    def __init__(self, own: str):
        self.own = own
        self.written, self.replaced, self.deletes, self.top = {}, {}, {}, {}

    def put(self, table: str, rows: dict[int, int], replaced: Iterable[int] | None) -> None:
        self.written[table] = rows
        if replaced is not None:
            self.replaced[table] = sorted({*replaced, *rows})

    def delete(self, table: str, rows: dict[int, int]) -> None:
        self.deletes[table] = rows

    def changed(self) -> dict[str, list[int]]:
        """Buckets whose content others may not have changed; appended runs and metrics depend on no other row."""
        tables = {*self.written, *self.replaced, *self.deletes} - {"crawl_runs", "metrics"}
        return {t: sorted({*self.written.get(t, ()), *self.replaced.get(t, ()), *self.deletes.get(t, ())}) for t in sorted(tables)}

    def on(self, newest: Snapshot) -> dict:
        """The newest version's state with this change."""
        parts, deletes, rows = (json.loads(json.dumps(x)) for x in (newest.parts, newest.deletes, newest.rows))
        for table, buckets in self.replaced.items():
            for b in map(str, buckets):
                for state in (parts, deletes, rows):
                    state.get(table, {}).pop(b, None)
        for number, state, found in ((0, parts, self.written), (1, deletes, self.deletes)):
            for table, counts in found.items():
                for b, n in counts.items():
                    state.setdefault(table, {}).setdefault(str(b), []).append(self.own)
                    rows.setdefault(table, {}).setdefault(str(b), [0, 0])[number] += n
        top = {t: max(v for v in (newest.top.get(t), self.top.get(t)) if v is not None) for t in {*newest.top, *self.top}}
        return {"parts": parts, "deletes": deletes, "rows": rows, "top": top}
