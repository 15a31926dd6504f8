"""Text search over stored jobs: trigram posting lists of title and company name.

A posting list names the rows of one file that hold a trigram in one field. Rows that hold all trigrams of a search text are
candidates; only they are read, and the LIKE test on them is exact. A search without three letters in a row asks for every
row.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that a task gathers before it writes lists.
ENTRIES = 1 << 20
LAYOUT = "file string, field string, gram string, rows array<long>"


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case; shorter texts and null have none."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def posting_lists(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """The lists of placed jobs, by bucket, file, field and trigram; a long list lies in several rows, each with other places.

    Jobs meet their company's name, come together by file, and are gathered into lists in their task; no row is made for each
    trigram of each job.
    """
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    fields = jobs.select("bucket", "file", "pos", "title", "company_id").join(names, "company_id", "left").repartition("file")
    return fields.select("bucket", "file", "pos", F.lower("title").alias("title"), F.lower("company").alias("company")).mapInArrow(
        _gathered, f"bucket int, {LAYOUT}")


def _gathered(batches):
    """Lists (bucket, file, field, gram, rows) of the rows (bucket, file, pos, title, company) of a task, texts in lower case."""
    held, size = {}, 0
    for batch in batches:
        for bucket, file, pos, *texts in zip(*(c.to_pylist() for c in batch.columns)):
            for field, text in zip(("title", "company"), texts):
                if text and len(text) >= 3:
                    held.setdefault((bucket, file, field), []).append((pos, text))
                    size += len(text)
            if size >= ENTRIES:
                yield from _rows(held)
                held, size = {}, 0
    yield from _rows(held)


def _rows(held):
    for (bucket, file, field), places in held.items():
        found, starts, rows = _lists(*zip(*sorted(places)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket] * len(found), pa.int32()), pa.array([file] * len(found), pa.string()),
             pa.array([field] * len(found), pa.string()), pa.array(found, pa.string()),
             pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(rows, pa.int64()))],
            names=["bucket", "file", "field", "gram", "rows"])


def _lists(places, texts):
    """Sorted distinct trigrams of texts, where the list of each starts, and the places of all lists in ascending order.

    A trigram is one number of its three code points, so places are sorted by it as a whole and not gathered one by one.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.zeros(len(points), bool)
    ends = np.cumsum(lengths)
    last[ends - 1] = last[ends - 2] = True
    begins = np.flatnonzero(~last)
    codes = points[begins] << 42 | points[begins + 1] << 21 | points[begins + 2]
    owners = np.repeat(np.arange(len(texts)), lengths - 2)
    order = np.argsort(codes, kind="stable")
    codes, owners = codes[order], owners[order]
    fresh = np.append(True, codes[1:] != codes[:-1])
    kept = fresh | np.append(True, owners[1:] != owners[:-1])
    codes, owners, fresh = codes[kept], owners[kept], fresh[kept]
    grams = codes[fresh]
    letters = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    starts = np.append(np.flatnonzero(fresh), len(codes))
    return [letters[i:i + 3] for i in range(0, len(letters), 3)], starts, np.array(places, np.int64)[owners]


def asked(spark: SparkSession, q: str) -> list[str]:
    """The trigrams that every match of a LIKE text holds: those of its parts between wildcards."""
    parts = [p for p in re.split("[%_]", q) if len(p) >= 3]
    if not parts:
        return []
    rows = spark.createDataFrame([(p,) for p in parts], "part string").select(F.explode(grams(F.col("part"))).alias("gram"))
    return sorted({r.gram for r in rows.collect()})


def candidates(lists: DataFrame, wanted: list[str]) -> DataFrame:
    """Places (file, pos) of the rows that hold all trigrams in one field."""
    hits = lists.filter(F.col("gram").isin(wanted)).select("file", "field", "gram", F.explode("rows").alias("pos"))
    whole = hits.groupBy("file", "field", "pos").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
    return whole.select("file", "pos").distinct()
