"""Change events as streams: each event once, usage in fixed windows, an index kept in step."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history, search


def read_changes(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def once(changes: DataFrame, keys: list[str], time: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once, as long as repeats come within ``late`` of each other."""
    return changes.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def usage(changes: DataFrame, limit: float, minutes: int = 120, late: str = "1 day") -> DataFrame:
    """user_id, start, used and over of windows of fixed length that begin at the epoch."""
    sums = changes.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.sum("value").alias("used"))
    return sums.select("user_id", F.col("w.start").alias("start"), "used", (F.col("used") > limit).alias("over"))


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends rows whose key the target folder lacks, batch by batch; a batch that comes again adds nothing."""
    def batch(rows: DataFrame, _: int) -> None:
        fresh = rows.dropDuplicates(keys)
        try:
            had = rows.sparkSession.read.schema(rows.schema).parquet(target).select(*keys)
            fresh = fresh.join(had, keys, "left_anti")
        except AnalysisException as e:  # the first batch finds no folder
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed(index: DataFrame, prev: DataFrame, curr: DataFrame, fields: list[str]) -> DataFrame:
    """Postings brought from one version to the next; the same version again changes nothing."""
    delta = history.diff(prev, curr).where("change_type <> 'moved'").select(F.col("id").alias("doc_id")).distinct()
    fresh = search.postings(curr.join(delta.select(F.col("doc_id").alias("id")), "id", "left_semi"), fields)
    return history.patched_index(index, delta, fresh)
