"""Exports: JSON dumps and CSV with caller-chosen columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def csv_projection(df: DataFrame, columns=None) -> DataFrame:
    """The chosen columns in order, as text: null and unknown columns are empty, times are ISO."""
    def cell(name):
        if name not in df.columns:
            return F.lit("")
        kind = dict(df.dtypes)[name]
        if kind.startswith("timestamp"):
            micros = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            # A whole second is written without a fraction.
            value = F.regexp_replace(micros, r"\.000000$", "")
        elif kind.startswith("array"):
            value = F.to_json(name)
        else:
            value = F.col(name).cast("string")
        return F.coalesce(value, F.lit(""))

    chosen = [c.strip() for c in columns.split(",") if c.strip()] if isinstance(columns, str) else columns
    return df.select(*[cell(c).alias(c) for c in (chosen or V.CSV_COLUMNS)])


def write_csv(df: DataFrame, path: str, columns=None) -> None:
    """One header per file; quotes inside a cell are doubled."""
    csv_projection(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").option(
        "escape", '"').csv(path)
