"""What the operators of this package share: tables, scratch tables, packing of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts or token lists that go to Python at once.
ROWS_AT_ONCE = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's number of rows in an Arrow batch, which fits rows of numbers, to one that fits whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and runs on one machine, as in tests, a temporary
    one is made; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def store(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts the lineage as a checkpoint does, survives lost executors, keeps columns
    apart so that later steps read only theirs, and tells Spark the table's size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
