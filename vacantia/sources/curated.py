"""Curated posting lists: Markdown and HTML tables, and bullet lists as the fallback.

A landed list is a row (source_idx, md).
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import classify, dates, text
from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import as_timestamp, filled, midnight, strip
from vacantia.functions.html import parse
from vacantia.schemas import LIST_ROW
from vacantia.session import cut_lineage

HTML_TABLE, MARKDOWN_TABLE, BULLET = 0, 1, 2
_GRID = "source_idx long, table_idx int, row_idx int, header array<string>, cells array<string>"
_CELLS = ("source_idx", "table_idx", "row_idx", "header", "cells")
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_ROW_COLUMNS = [f.name for f in LIST_ROW.fields]


# ---- Markdown tables -------------------------------------------------------------------

def _cells(line):
    bare = line.strip()
    return [c.strip() for c in bare.removeprefix("|").removesuffix("|").split("|")]


def _is_separator(line):
    return "---" in line and not line.strip().strip("|:- ").strip()


def _markdown_grids(md):
    """(header, rows) per table: a piped line with a separator within the next two lines."""
    lines = [line.rstrip() for line in md.splitlines()]
    at = 0
    while at < len(lines):
        below = next((j for j in (at + 1, at + 2) if j < len(lines) and _is_separator(lines[j])), None)
        if "|" not in lines[at] or below is None:
            at += 1
            continue
        end = below + 1
        while end < len(lines) and lines[end].strip().startswith("|"):
            end += 1
        yield _cells(lines[at]), [_cells(line) for line in lines[below + 1:end]]
        at = end


def _markdown_batches(batches):
    for batch in batches:
        out, counter = [], {}
        for source_idx, md in zip(batch["source_idx"], batch["md"]):
            for table, (header, rows) in enumerate(_markdown_grids(md or "")):
                for row in rows:
                    counter[source_idx] = counter.get(source_idx, -1) + 1
                    padded = row + [""] * (len(header) - len(row))
                    out.append((source_idx, table, counter[source_idx], header, padded))
        yield pd.DataFrame(out, columns=_CELLS)


def markdown_grid(lists: DataFrame) -> DataFrame:
    """Table rows of the lists with their header, short rows padded."""
    return lists.select("source_idx", "md").filter(F.col("md").contains("|")).mapInPandas(_markdown_batches, _GRID)


def markdown_rows(lists: DataFrame) -> DataFrame:
    """Table rows with their columns found by header; tables without a known header are skipped."""
    grid = markdown_grid(lists)
    for kind in V.LIST_COLUMNS:
        grid = grid.withColumn(f"at_{kind}", text.list_column(F.col("header"), kind))

    def cell(kind, default=None):
        at = F.col(f"at_{kind}")
        if default is not None:
            at = F.coalesce(at, F.lit(default))
        return F.coalesce(F.get(F.col("cells"), at), F.lit(""))

    known = F.greatest(*[F.col(f"at_{kind}") for kind in V.LIST_COLUMNS]).isNotNull()
    company, title = cell("company", 0), cell("title", 0)
    return grid.filter(known).select(
        "source_idx",
        F.lit(MARKDOWN_TABLE).alias("parser_idx"),
        "row_idx",
        text.curated_company(text.unlinked(company)).alias("company"),
        text.unlinked(title).alias("title"),
        cell("location").alias("location"),
        F.coalesce(filled(text.link_url(cell("url"))), text.link_url(title)).alias("url"),
        text.link_url(company).alias("company_href"),
        cell("date").alias("date"),
        cell("age").alias("age"),
    )


# ---- HTML tables -----------------------------------------------------------------------

def _column_places(header):
    places = {}
    for at, cell in enumerate(header):
        low = cell.lower()
        for kind, words in V.LIST_COLUMNS.items():
            if any(w in low for w in words):
                places.setdefault(kind, at)
    return places


def _apply_link(node):
    """Address of the anchor that says "apply", else of the first anchor."""
    anchors = [a for a in node.find_all("a") if a.attrs.get("href") is not None]
    chosen = next((a for a in anchors if "apply" in a.text("").lower()), anchors[0] if anchors else None)
    return chosen.attrs["href"] if chosen is not None else None


def _html_table_rows(md):
    for table in parse(md).find_all("table"):
        rows = list(table.find_all("tr"))
        header = [th.text("") for th in table.find_all("th")]
        if not header and rows:
            header = [td.text("") for td in rows[0].find_all("td")]
        places = _column_places(header)
        if not places:
            continue
        for tr in rows[1:] if len(rows) > 1 else rows:
            cells = list(tr.find_all("td", "th"))
            texts = [c.text() for c in cells]

            def value(kind, default=None, texts=texts):
                at = places.get(kind, default)
                return texts[at] if at is not None and at < len(texts) else ""

            if not cells:
                continue
            company_link = url = None
            if places.get("company", len(cells)) < len(cells):
                anchor = next(cells[places["company"]].find_all("a"), None)
                company_link = ((anchor.attrs.get("href") or "").strip() or None) if anchor is not None else None
            if places.get("url", len(cells)) < len(cells):
                url = _apply_link(cells[places["url"]])
            yield (value("company", 0), value("title", 0), value("location"), url or _apply_link(tr), company_link,
                   value("date"), value("age"))


def _html_batches(batches):
    for batch in batches:
        out = [
            (source_idx, HTML_TABLE, row_idx, *row)
            for source_idx, md in zip(batch["source_idx"], batch["md"])
            for row_idx, row in enumerate(_html_table_rows(md))
        ]
        yield pd.DataFrame(out, columns=["source_idx", *_ROW_COLUMNS])


def html_rows(lists: DataFrame) -> DataFrame:
    """Rows of HTML tables embedded in the lists."""
    layout = "source_idx long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LIST_ROW.fields)
    return (
        lists.select("source_idx", "md").filter(F.lower("md").contains("<table"))
        .mapInPandas(_html_batches, layout)
        .withColumn("company", text.curated_company(F.col("company")))
    )


# ---- bullets ---------------------------------------------------------------------------

def bullet_rows(lists: DataFrame) -> DataFrame:
    """Links of bullet and numbered lists; the label holds company and title."""
    line = F.regexp_replace("line", r"(?U)^\s+", "")
    label = strip(F.regexp_extract("item", V.MARKDOWN_LINK, 1))
    dash = F.when(label.contains("—"), "—").when(label.contains(" - "), " - ")
    company = strip(F.expr("if(dash IS NULL, label, substring_index(label, dash, 1))"))
    title = strip(F.expr("if(dash IS NULL, label, substring(label, instr(label, dash) + length(dash)))"))
    blank, none = F.lit(""), F.lit(None).cast("string")
    return (
        lists.select("source_idx", F.posexplode(F.split("md", _LINE_ENDS))
                     .alias("row_idx", "line"))
        .withColumn("item", line)
        .filter(F.col("item").rlike(r"(?U)^(?:[-*] |\d+\.\s)") & F.col("item").rlike(V.MARKDOWN_LINK))
        .withColumn("label", label)
        .withColumn("dash", dash)
        .select(
            "source_idx", F.lit(BULLET).alias("parser_idx"), "row_idx", company.alias("company"),
            title.alias("title"), blank.alias("location"),
            strip(F.regexp_extract("item", V.MARKDOWN_LINK, 2)).alias("url"), none.alias("company_href"),
            blank.alias("date"), blank.alias("age"))
    )


# ---- rows to postings ------------------------------------------------------------------

def gated(rows: DataFrame, only_remote: bool = True, us_only: bool = True) -> DataFrame:
    """Rows with a posting link, remote and in the US where asked; cleaned up."""
    kept = (
        rows.withColumn("row_url", text.canonical_url(filled(F.col("url"))))
        .filter("row_url <> ''")
        .withColumn("location", text.curated_location(F.col("location")))
        .withColumn("is_remote", classify.is_curated_remote(F.col("location"), F.col("title")))
    )
    if only_remote:
        kept = kept.filter("is_remote")
    if us_only:
        kept = kept.filter(classify.is_curated_us(F.col("location")))
    return kept


def first_per_url(rows: DataFrame, key: str = "row_url") -> DataFrame:
    """Keep the first row of each url over all sources.

    Rank 1 is a constant bound, so every map task forwards one row per url at most.
    """
    order = Window.partitionBy(key).orderBy("source_idx", "parser_idx", "row_idx")
    return rows.withColumn("sight", F.row_number().over(order)).filter("sight = 1").drop("sight")


def gated_rows(lists: DataFrame, only_remote: bool = True, us_only: bool = True) -> DataFrame:
    """All gated rows; bullets count only for lists whose tables gave none.

    Table rows are written out once, as the gate for bullets reads them again. Bullets are parsed before the gate, so that
    only their rows are joined and no document.
    """
    tables = cut_lineage(gated(html_rows(lists).unionByName(markdown_rows(lists)), only_remote, us_only))
    bullets = gated(bullet_rows(lists), only_remote, us_only)
    return tables.unionByName(bullets.join(tables.select("source_idx").distinct(), "source_idx", "left_anti")
                              .select(*bullets.columns))


def scraped_date(date, age, as_of):
    def one(value):
        plain = F.regexp_replace(text.unlinked(value), r"^[*_ ]+|[*_ ]+$", "")
        return dates.curated_date(plain, as_of)
    return F.coalesce(one(date), one(age))


def curated_postings(lists: DataFrame, as_of, only_remote: bool = True, us_only: bool = True,
                     provider: str = "github", scrape: bool = False, history: DataFrame | None = None) -> DataFrame:
    """Upsert records of curated lists.

    The date is the scraped one, else the one inferred from the repository history, else the
    run's midnight; ``date_origin`` tells which.
    """
    rows = first_per_url(gated_rows(lists, only_remote, us_only))
    company = text.curated_company(F.col("company"))
    never = F.lit(None).cast("timestamp")
    records = rows.select(
        "source_idx", "parser_idx", "row_idx",
        F.lit(provider).alias("provider"),
        text.hashed_id(F.col("row_url")).alias("external_id"),
        F.nullif(text.legacy_id(F.col("company_href"), F.col("row_url")),
                 text.hashed_id(F.col("row_url"))).alias("legacy_external_id"),
        text.with_default(company, text.company_token(company, F.col("row_url"))).alias("company"),
        text.company_token(company, F.col("row_url")).alias("company_slug"),
        text.with_default(F.col("title"), V.CURATED_DEFAULT_TITLE).alias("title"),
        F.col("row_url").alias("url"),
        "location", "is_remote",
        classify.curated_level(F.concat_ws(" ", "title", "location")).alias("level"),
        (scraped_date(F.col("date"), F.col("age"), as_of) if scrape else never).alias("scraped_at"),
    )
    if history is not None:
        from vacantia.operators.joins import inferred_dates
        records = records.join(inferred_dates(history), "external_id", "left")
    else:
        records = records.withColumn("inferred_at", never)
    run_day = midnight(as_timestamp(as_of))
    return (
        records.withColumn("posted_at", F.coalesce("scraped_at", "inferred_at", run_day))
        .withColumn("date_origin", F.when(F.col("scraped_at").isNotNull(), "scraped")
                    .when(F.col("inferred_at").isNotNull(), "inferred").otherwise("fallback"))
        .drop("scraped_at", "inferred_at")
    )
