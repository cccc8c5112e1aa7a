"""A corpus and its index kept in step with streams of versions of its sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring
from ..operators.versioned import Versioned
from ..session import discard, stored

SECTIONS = "id string, title string, doc_no string, type string, content string, path string, seq long, removed boolean"
POSTINGS = "term string, field string, doc_id string, tf long, len long"


def refresh_batch(store: Versioned, rows: DataFrame, batch: int, fields: list[str], source: str = "refresh") -> None:
    """Takes a batch of versions of sections (``SECTIONS``): the newest of each, if newer than what is there, with its postings.

    Sections and postings change in one version of the store, so none is seen without the
    other. A batch that comes again, also after a loss between writing and commit, changes
    nothing; so do older versions that come late. A removed section stays as a row without
    texts, so that its older versions stay away, and has no postings.
    """
    spark = rows.sparkSession
    if (last := store.taken(source)) is not None and last >= batch:
        return
    schema = spark.createDataFrame([], SECTIONS).schema
    columns = [f.name for f in schema]
    # versions are dealt once, as the store's buckets are; what follows stays in its task
    newest = store.deal(rows.where("id IS NOT NULL"), F.col("id")).groupBy("_bucket", "_part", "id").agg(F.max(F.struct("seq", F.coalesce("removed", F.lit(False)).alias("removed"), *[c for c in columns if c not in ("id", "seq", "removed")])).alias("s"))
    newest = newest.select("id", "s.*").select(*columns)
    there = store.read("sections", schema)
    # what only got a new number or path keeps its postings; texts that are there are met by their hashes alone
    told = F.sha2(F.to_json(F.struct("title", "doc_no", "type", "content", "removed")), 256)
    old = there.select("id", F.col("seq").alias("_seq"), told.alias("_old"))
    later = newest.join(old, "id", "left").where("_seq IS NULL OR seq > _seq")
    later = later.withColumn("_changed", F.col("_old").isNull() | (F.col("_old") != told)).drop("_seq", "_old")
    later = stored(later, "later")  # sections, postings and the keys of both read it
    blank = lambda c: F.when(~F.col("removed"), F.col(c)).alias(c)
    fresh = later.select("id", *[blank(c) for c in ("title", "doc_no", "type", "content", "path")], "seq", "removed")
    changed = later.where("_changed")
    postings = scoring.term_counts(changed.where("NOT removed"), fields)
    store.replace({
        "sections": (fresh.select(*columns), fresh.select(F.col("id").alias("k0")), ["id"]),
        "postings": (postings, changed.select(F.col("id").alias("k0")), ["doc_id"]),
    }, source, batch, beside=True, dealt=True)
    discard(later)


def refresh(store: Versioned, streams: list[DataFrame], fields: list[str], checkpoint: str, source: str = "refresh") -> StreamingQuery:
    """Keeps a store in step with several streams of versions, all that is there now; deltas of a batch are merged by section."""
    merged = reduce(lambda a, b: a.unionByName(b), streams)
    batch = lambda rows, number: refresh_batch(store, rows, number, fields, source)
    return merged.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
