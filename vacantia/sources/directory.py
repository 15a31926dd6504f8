"""Company directory, skill list and landed-payload routing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import filled, first_filled, strip, text

_ALIASES = {
    "provider": ("provider", "source", "ats"),
    "company": ("company", "name", "org"),
    "token": ("token", "board_token"),
    "host": ("host", "domain"),
    "path": ("path", "environment"),
}
DIRECTORY_JSON = ", ".join(
    f"{name} string" for name in (*[n for names in _ALIASES.values() for n in names], "priority"))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Directory file: one JSON array, or one object, with alias keys; ordinal is the file order."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"array<struct<{DIRECTORY_JSON.replace(' string', ':string')}>>")
    return normalize_directory(
        raw.select(F.posexplode(entries).alias("ordinal", "entry")).select(
            F.col("ordinal").cast("long"), "entry.*"))


def normalize_directory(raw: DataFrame) -> DataFrame:
    """Resolve the alias keys of directory entries (ordinal plus any of the alias columns)."""
    def alias(name):
        present = [F.col(c) for c in _ALIASES[name] if c in raw.columns]
        return first_filled(*present) if present else F.lit(None).cast("string")
    priority = F.col("priority") if "priority" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        "ordinal",
        filled(F.lower(strip(alias("provider")))).alias("provider"),
        alias("company").alias("company"),
        alias("token").alias("token"),
        alias("host").alias("host"),
        F.coalesce(alias("path"), F.lit("External")).alias("path"),
        priority.alias("priority"),
    )


def parse_skill_config(df: DataFrame, body: str = "body") -> DataFrame:
    """Skill configurations (JSON text) as any_terms and all_terms arrays.

    A value is a list or a comma-separated text; labels are trimmed, lower-cased, blanks dropped.
    """
    keys = {"any_terms": ("any", "skills_any"), "all_terms": ("all", "skills_all")}
    layout = ", ".join(f"`{k}` string" for names in keys.values() for k in names)
    parsed = df.withColumn("_config", F.from_json(body, layout))

    def terms(names):
        # Read as text, a list keeps its JSON form; an empty list counts as absent.
        value = first_filled(*[F.nullif(F.col("_config")[n], F.lit("[]")) for n in names])
        items = F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<string>"), F.split(value, ","))
        clean = F.transform(items, lambda s: F.lower(strip(text(s))))
        return F.coalesce(F.filter(clean, lambda s: s != ""), F.array().cast("array<string>"))

    return parsed.select(*df.columns, *[terms(names).alias(out) for out, names in keys.items()])


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """One row with any_terms and all_terms of a skill file."""
    return parse_skill_config(spark.read.text(path, wholetext=True), "value").drop("value")


def enabled_sources(providers: str = "greenhouse") -> list:
    """Source names of a comma-separated argument; ``all`` or ``*`` enables every one."""
    names = [p.strip().lower() for p in (providers or "all").split(",") if p.strip()]
    if names in (["all"], ["*"]):
        return list(V.REGISTERED_SOURCES)
    return names


def route(directory: DataFrame, providers: str = "greenhouse") -> tuple[DataFrame, DataFrame]:
    """Directory entries to read, and entries whose provider is missing or unknown."""
    known = F.coalesce(F.col("provider").isin(*V.REGISTERED_SOURCES), F.lit(False))
    chosen = directory.filter(F.col("provider").isin(*V.REGISTERED_SOURCES)
                              & F.col("provider").isin(*enabled_sources(providers)))
    return chosen, directory.filter(~known)


def listed_boards(chosen: DataFrame) -> DataFrame:
    """One entry per provider and board (token, else host): the first that lists it."""
    board = F.coalesce(filled(F.col("token")), filled(F.col("host")))
    entry = F.struct("ordinal", "company", "token", "host", "path")
    first = chosen.withColumn("board", board).filter("board IS NOT NULL").groupBy("provider", "board").agg(
        F.min_by(entry, "ordinal").alias("e"))
    return first.select("provider", "e.*")


def with_company(landed: DataFrame, directory: DataFrame) -> DataFrame:
    """Landed payloads of directory companies, by provider and board token."""
    board = directory.select(
        "provider", F.coalesce("token", "host").alias("board_token"), "company", "host", "path")
    return landed.withColumnRenamed("token", "board_token").join(
        board, ["provider", "board_token"]).withColumnRenamed("board_token", "token")
