"""Registration of queries with their oracle SQL, and access to the posting-shaped views."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.extra_views import EXTRA_VIEWS
from queries.views import VIEWS
from vacantia.operators.ranking import number_rows
from vacantia.session import configure

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
ALL_VIEWS = {**VIEWS, **EXTRA_VIEWS}
LANDED_VIEWS = {name for name in ALL_VIEWS if name.endswith(("_payload_fx", "_page_fx")) or name in ("md_doc_fx", "postings_fx")}
AS_OF = "2001-08-01 00:00:00"
CURATED_AS_OF = "2025-09-18 15:30:00"

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a query and, where there is one, its oracle."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add


def _needed(sql, seen):
    for name in re.findall(r"\b\w+_fx\b", sql):
        if name not in seen:
            _needed(ALL_VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql):
    """Put the views a text uses in front of it."""
    views = [f"{name} AS ({ALL_VIEWS[name].strip()})" for name in _needed(sql, [])]
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body


_FRAMES = {}


def _remembered(read):
    """Keep the plan of a table or view per application; the data is not kept."""
    def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, read.__name__, sf_dir, name)
        if key not in _FRAMES:
            _FRAMES[key] = read(spark, sf_dir, name)
        return _FRAMES[key]
    return get


@_remembered
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _utc(configure(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def _utc(df: DataFrame) -> DataFrame:
    """Naive timestamps of the files as UTC timestamps."""
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c)
                       for c, t in df.dtypes])


@_remembered
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "incoming_fx":
        return incoming(spark, sf_dir)
    text = ALL_VIEWS[name]
    for base in TABLES:
        if re.search(rf"\b{base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    for inner in dict.fromkeys(re.findall(r"\b\w+_fx\b", text)):
        view(spark, sf_dir, inner).createOrReplaceTempView(inner)
    rows = _utc(configure(spark).sql(text))
    # Every test table is one file with one row group; what stands for landed payloads and pages lies in many files.
    return rows.repartition(spark.sparkContext.defaultParallelism) if name in LANDED_VIEWS else rows


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert batch; its arrival order comes from a range-partitioned sort, not from one global window."""
    head, tail = VIEWS["incoming_fx"].split(" AS seq,")
    order = re.search(r"ORDER BY ([^)]*)\)", head).group(1).split(", ")
    # the columns of the table are numbered, as they are short; what is made of them is made after that, in all tasks
    lines = table(spark, sf_dir, "lineitem").select(*order)
    numbered = number_rows(lines, "seq", seq=order[0], tie_break=[F.col(c) for c in order[1:]])
    texts = tail[:tail.rindex("FROM lineitem")]
    return _utc(spark.sql(f"SELECT seq, {texts} FROM {{numbered}}", numbered=numbered))


def literal(text):
    """A SQL string literal."""
    return "'" + str(text).replace("'", "''") + "'"


def any_contains(expr, phrases):
    return "(" + " OR ".join(f"contains({expr}, {literal(p)})" for p in phrases) + ")"


def found(expr, pattern):
    return f"regexp_matches(coalesce({expr}, ''), {literal(pattern)}, 'i')"
