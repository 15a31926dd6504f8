"""Description snippets for parsed postings, under a budget per board."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.dates import date_in_text, page_posting_date
from vacantia.functions.exprs import squeeze
from vacantia.functions.html import page_text


def read_pages(pages: DataFrame, as_of=None, max_chars: int | None = V.SNIPPET_CHARS) -> DataFrame:
    """Landed pages (url, html) reduced to what postings need, before any shuffle.

    snippet: start of the text with collapsed blanks, or all of it without ``max_chars``; top_up_snippet: the same as is;
    page_date: date text of its linked data; text_date: date its whole text names.
    """
    text = F.col("text")

    def start(column):
        return column if max_chars is None else F.substring(column, 1, max_chars)
    never = F.lit(None).cast("timestamp")
    return (
        pages.filter("url <> ''")
        .withColumn("text", page_text(F.col("html")))
        .select("url", start(squeeze(text)).alias("snippet"),
                start(text).alias("top_up_snippet"),
                page_posting_date(F.col("html")).alias("page_date"),
                (never if as_of is None else date_in_text(text, as_of)).alias("text_date"))
    )


def choose_snippets(postings: DataFrame, page_facts: DataFrame, order: list[Column],
                    cap: int | None = V.SNIPPET_CAP) -> DataFrame:
    """The first ``cap`` postings per board, in the given order, whose page has text; without a cap all of them.

    The constant bound lets Spark limit each board before the shuffle, so one very large
    board does not end up in one task.
    """
    readable = postings.filter("url <> ''").join(page_facts, "url").filter("snippet IS NOT NULL")
    if cap is None:
        return readable
    budget = Window.partitionBy("token").orderBy(*order)
    return (
        readable
        .withColumn("budget_rank", F.row_number().over(budget))
        .filter(F.col("budget_rank") <= cap)
    )


def attach_snippets(postings: DataFrame, page_facts: DataFrame, cap: int | None = V.SNIPPET_CAP) -> DataFrame:
    """Give the first ``cap`` readable postings per board their snippet; keep all rows."""
    chosen = choose_snippets(postings, page_facts, [F.col("seq")], cap).select(
        "seq", F.col("snippet").alias("description_snippet"))
    return postings.drop("description_snippet").join(chosen, "seq", "left")
