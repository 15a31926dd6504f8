"""Record layouts."""

from pyspark.sql import types as T

STRING_ARRAY = T.ArrayType(T.StringType())


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


POSTINGS = _struct(
    ("seq", T.DecimalType(38, 0)),
    ("title", T.StringType()),
    ("company", T.StringType()),
    ("url", T.StringType()),
    ("source", T.StringType()),
    ("location", T.StringType()),
    ("posted_at", T.TimestampType()),
    ("description_snippet", T.StringType()),
    ("level", T.StringType()),
    ("keywords", STRING_ARRAY),
)

COMPANIES = _struct(
    ("id", T.LongType()),
    ("name", T.StringType()),
    ("slug", T.StringType()),
    ("website", T.StringType()),
    ("ats_provider", T.StringType()),
    ("ats_token", T.StringType()),
)

JOBS = _struct(
    ("id", T.LongType()),
    ("provider", T.StringType()),
    ("external_id", T.StringType()),
    ("url", T.StringType()),
    ("company_id", T.LongType()),
    ("title", T.StringType()),
    ("location", T.StringType()),
    ("is_remote", T.BooleanType()),
    ("level", T.StringType()),
    ("posted_at", T.TimestampType()),
    ("description", T.StringType()),
    ("active", T.BooleanType()),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
    ("function", T.StringType()),
    ("seniority_score", T.IntegerType()),
)

JOB_SKILLS = _struct(
    ("job_id", T.LongType()),
    ("skill", T.StringType()),
    ("score", T.IntegerType()),
)

CRAWL_RUNS = _struct(
    ("id", T.LongType()),
    ("provider", T.StringType()),
    ("started_at", T.TimestampType()),
    ("finished_at", T.TimestampType()),
    ("pages_fetched", T.IntegerType()),
    ("jobs_discovered", T.IntegerType()),
    ("errors", T.IntegerType()),
    ("notes", T.StringType()),
)

# Counts that add up over buckets and over changes; rows that went away count negative.
METRICS = _struct(
    ("provider", T.StringType()),
    ("total", T.LongType()),
    ("undated", T.LongType()),
    ("excluded_by_title", T.LongType()),
    ("excluded_by_yoe", T.LongType()),
)

# One row per record handed to the upsert.
INCOMING = _struct(
    ("seq", T.LongType()),
    ("provider", T.StringType()),
    ("external_id", T.StringType()),
    ("legacy_external_id", T.StringType()),
    ("url", T.StringType()),
    ("company", T.StringType()),
    ("company_slug", T.StringType()),
    ("title", T.StringType()),
    ("location", T.StringType()),
    ("is_remote", T.BooleanType()),
    ("level", T.StringType()),
    ("posted_at", T.TimestampType()),
    ("description", T.StringType()),
    ("function", T.StringType()),
    ("seniority_score", T.IntegerType()),
    ("skills", STRING_ARRAY),
)

DIRECTORY = _struct(
    ("ordinal", T.LongType()),
    ("provider", T.StringType()),
    ("company", T.StringType()),
    ("token", T.StringType()),
    ("host", T.StringType()),
    ("path", T.StringType()),
    ("priority", T.StringType()),
)

# A table row harvested from a curated list, before any gate.
LIST_ROW = _struct(
    ("parser_idx", T.IntegerType()),
    ("row_idx", T.IntegerType()),
    ("company", T.StringType()),
    ("title", T.StringType()),
    ("location", T.StringType()),
    ("url", T.StringType()),
    ("company_href", T.StringType()),
    ("date", T.StringType()),
    ("age", T.StringType()),
)
