"""Session settings shared by every job."""

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan relies on: naive timestamps mean UTC, AQE splits skewed join
# partitions and coalesces small ones, and a page far down a sorted result is sorted on the
# executors and not gathered on the driver. Python workers get pages in batches of few bytes,
# as each holds a batch and what it makes of it.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "vacantia", master: str | None = None, **conf: str) -> SparkSession:
    # Call sites of column operations are costly to record for large expressions.
    builder = SparkSession.builder.appName(app).config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Where that is not set, it is a folder below the warehouse, which executors share as well. A cluster whose warehouse is
    a local folder has no such place, and the job is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_shared"


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark)}/vacantia-{spark.sparkContext.applicationId}"


def drop_copies(spark: SparkSession) -> None:
    """Remove the intermediate copies of this application; results that still read them must have been stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a DataFrame that several branches read to the shared folder, and read it back.

    The Parquet copy outlives lost executors, and each branch reads only its columns.
    """
    spark = df.sparkSession
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
