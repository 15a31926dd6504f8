"""Landed applicant-tracking payloads, parsed into postings with native JSON expressions.

A landed payload is a row (payload_id, token, company, body); workday adds host and path.
The arrival order of a posting is its payload's id, then its position in the payload.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, text
from vacantia.functions.classify import infer_level
from vacantia.functions.exprs import arrival, filled, first_filled

_GREENHOUSE = (
    "jobs array<struct<absolute_url:string,title:string,location:struct<name:string>,updated_at:string,"
    "created_at:string,opened_at:string,internal_job_updated_at:string>>"
)
_LEVER = (
    "array<struct<hostedUrl:string,applyUrl:string,text:string,categories:struct<location:string>,"
    "createdAt:string,updatedAt:string,listedAt:string>>"
)
_WORKDAY = (
    "jobPostings array<struct<title:string,locationsText:string,bulletFields:array<string>,postedOn:string,"
    "postedDate:string,startDate:string,datePosted:string,meta:struct<postedDate:string>>>"
)
_ASHBY = (
    "array<struct<title:string,jobTitle:string,jobPostingUrl:string,jobPostUrl:string,url:string,jobUrl:string,"
    "slug:string,location:string,locationText:string,createdAt:string,publishedAt:string,updatedAt:string,"
    "liveAt:string,posting:struct<publishedAt:string,updatedAt:string>>>"
)


def _postings(landed: DataFrame, items: Column, source: str, url: Column, title: Column, location: Column,
              posted_at: Column) -> DataFrame:
    exploded = landed.select("*", F.posexplode(items).alias("pos", "item"))
    return exploded.select(
        arrival(F.col("payload_id"), F.col("pos")).alias("seq"),
        "token",
        text.normalize_title(F.coalesce(title, F.lit(""))).alias("title"),
        text.normalize_company(F.coalesce("company", "token")).alias("company"),
        url.alias("url"),
        F.lit(source).alias("source"),
        text.canonical_location(location).alias("location"),
        posted_at.alias("posted_at"),
        F.lit(None).cast("string").alias("description_snippet"),
    ).withColumn("level", infer_level(F.col("title")))


def _with_token(landed: DataFrame) -> DataFrame:
    return landed.filter("token <> ''")


def greenhouse(landed: DataFrame) -> DataFrame:
    item = F.col("item")
    return _postings(
        _with_token(landed), F.from_json("body", _GREENHOUSE)["jobs"], "greenhouse",
        url=F.coalesce(item["absolute_url"], F.lit("")),
        title=item["title"],
        location=item["location"]["name"],
        posted_at=dates.greenhouse_date(
            item["updated_at"], item["created_at"], item["opened_at"], item["internal_job_updated_at"]),
    )


def lever(landed: DataFrame) -> DataFrame:
    item = F.col("item")
    return _postings(
        _with_token(landed), F.from_json("body", _LEVER), "lever",
        url=F.coalesce(first_filled(item["hostedUrl"], item["applyUrl"]), F.lit("")),
        title=item["text"],
        location=item["categories"]["location"],
        posted_at=dates.lever_date(item["createdAt"], item["updatedAt"], item["listedAt"]),
    )


def workday(landed: DataFrame) -> DataFrame:
    """Postings of workday boards; the site host stands in for the token."""
    item = F.col("item")
    site = F.concat(F.lit("https://"), F.col("token"))
    bullets = item["bulletFields"]
    return _postings(
        landed.withColumn("token", F.col("host")).filter("token <> ''"),
        F.from_json("body", _WORKDAY)["jobPostings"], "workday",
        url=F.when(F.size(bullets) > 0, F.concat(site, F.lit("/en-US/careers/job/"), bullets[0])).otherwise(site),
        title=item["title"],
        location=item["locationsText"],
        posted_at=dates.workday_date(
            item["postedOn"], item["postedDate"], item["startDate"], item["datePosted"], item["meta"]["postedDate"]),
    )


def ashby_items(body: Column) -> Column:
    """The posting list, bare or under one of two keys; an empty first key gives way to the second."""
    wrapped = F.from_json(body, f"jobPostings {_ASHBY}, jobs {_ASHBY}")
    return F.when(F.ltrim(body).startswith("["), F.from_json(body, _ASHBY)).otherwise(
        F.coalesce(F.when(F.size(wrapped["jobPostings"]) > 0, wrapped["jobPostings"]), wrapped["jobs"]))


def ashby(landed: DataFrame) -> DataFrame:
    item = F.col("item")
    board = F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("token"), F.lit("/job/"), filled(item["slug"]))
    posting = item["posting"]
    return _postings(
        _with_token(landed), ashby_items(F.col("body")), "ashby",
        url=F.coalesce(
            first_filled(item["jobPostingUrl"], item["jobPostUrl"], item["url"], item["jobUrl"]), board, F.lit("")),
        title=first_filled(item["title"], item["jobTitle"]),
        location=first_filled(item["location"], item["locationText"]),
        posted_at=dates.ashby_date(
            item["createdAt"], item["publishedAt"], item["updatedAt"], item["liveAt"], posting["publishedAt"],
            posting["updatedAt"]),
    ).filter("title <> ''")
