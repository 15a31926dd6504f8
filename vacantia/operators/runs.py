"""The run log: what a run found, counted while its rows pass."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import as_timestamp

# Rows of a provider that is not listed count under this name.
OTHER = "other"


def named() -> Column:
    """The provider as it is counted."""
    known = F.lower(F.trim("provider"))
    return F.when(known.isin(*V.PROVIDERS), known).otherwise(OTHER)


def counts(counted: str) -> list[Column]:
    """Rows and refused rows of each provider, as metrics to observe on resolved rows; ``counted`` is a column made by ``named``.

    Metrics share no work with each other, so the name is made once a row and only compared here.
    """
    out = []
    for name in (*V.PROVIDERS, OTHER):
        mine = F.col(counted) == name
        out += [F.count_if(mine).alias(f"found_{name}"), F.count_if(mine & F.col("reason").isNotNull()).alias(f"errors_{name}")]
    return out


def observed(seen: Observation) -> dict:
    """The metrics; none where Spark proved the rows to be empty and left the observation out of the plan."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def run_rows(spark: SparkSession, seen: Observation, as_of, pages: int | None = None, notes: str | None = None) -> DataFrame:
    """Log rows (without id) of the providers that the observed rows have; one provider takes all pages."""
    got = observed(seen)
    names = [n for n in (*V.PROVIDERS, OTHER) if got.get(f"found_{n}")]
    rows = [(n, pages if len(names) == 1 else None, got[f"found_{n}"] - got[f"errors_{n}"], got[f"errors_{n}"], notes) for n in names]
    found = spark.createDataFrame(rows, "provider string, pages_fetched int, jobs_discovered int, errors int, notes string")
    return found.withColumn("started_at", as_timestamp(as_of)).withColumn("finished_at", as_timestamp(as_of))
