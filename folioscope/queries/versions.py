"""Queries over tables that change by versions, and a corpus kept in step with streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, tables
from ..operators.versioned import Versioned
from ..session import shared_folder, stored
from ..streaming import refresh
from . import TABLES, VIEWS, query
from .searches import terms_sql

CHANGED = "NOT (p.title = c.title AND p.content = c.content AND p.path = c.path)"


def upserted(v):
    """The earlier version, then the later one on it, of which every fifth section is deleted instead, and again, which must change nothing."""
    store = Versioned(v.spark, shared_folder(v.spark, "versioned"), buckets=16)
    store.upsert("sections", v.prev, ["id"])
    later = v.curr.withColumn("gone", F.pmod(F.substring("id", 2, 20).cast("long"), F.lit(5)) == 0)
    first = store.upsert("sections", later, ["coalesce(id, '')"], deleted="gone")
    again = store.upsert("sections", later, ["coalesce(id, '')"], deleted="gone")
    return store, first, again


@query("s15_upsert", "prev", "curr", sql="SELECT id, title, md5(content) AS content, path FROM curr WHERE CAST(substring(id, 2) AS BIGINT) % 5 <> 0 UNION ALL SELECT id, title, md5(content), path FROM prev WHERE id NOT IN (SELECT id FROM curr)")
def _(v):
    store, _, _ = upserted(v)
    return store.read("sections", v.prev.schema).select("id", "title", F.md5("content").alias("content"), "path")


@query("s15_ledgers", "prev", "curr", sql=f"""WITH_CLAUSE j AS (SELECT p.id IS NULL AS fresh, CAST(substring(c.id, 2) AS BIGINT) % 5 = 0 AS gone, p.id IS NOT NULL AND {CHANGED} AS changed FROM curr c LEFT JOIN prev p ON p.id = c.id)
SELECT 1 AS run, count(*) FILTER (fresh AND NOT gone) AS inserted, count(*) FILTER (changed AND NOT gone) AS updated, count(*) FILTER (gone AND NOT fresh) AS deleted, count(*) FILTER (gone AND fresh OR NOT gone AND NOT fresh AND NOT changed) AS unchanged, 2 AS version FROM j
UNION ALL SELECT 2, 0, 0, 0, count(*), 2 FROM j""".replace("WITH_CLAUSE", ","))
def _(v):
    store, first, again = upserted(v)
    return first.withColumn("run", F.lit(1)).unionByName(again.withColumn("run", F.lit(2))).withColumn("version", F.lit(store.version()))


@query("st2_streams", "curr", sql=f"""SELECT term, field, doc_id, CAST(count(*) AS BIGINT) AS tf, any_value(n) AS len FROM (
SELECT field, doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT 'title' AS field, id AS doc_id, {terms_sql('title')} AS t FROM curr UNION ALL SELECT 'content', id, {terms_sql('content')} FROM curr) x) y GROUP BY term, field, doc_id""")
def _(v):
    # one stream brings the earlier version in two files at most, the other what the later one changed, and removals
    one, other = shared_folder(v.spark, "stream-a"), shared_folder(v.spark, "stream-b")
    shape = lambda df, seq, removed: df.select("id", "title", F.lit(None).cast("string").alias("doc_no"), F.lit(None).cast("string").alias("type"), "content", "path", F.lit(seq).cast("long").alias("seq"), F.lit(removed).alias("removed"))
    shape(v.prev, 1, False).coalesce(2).write.parquet(one)
    # versions are told apart by hashes, and the ids of what changed are written, so that texts stay where they are read
    hashed = lambda df: df.select("id", F.sha2(F.to_json(F.struct("title", "content", "path")), 256).alias("hash"))
    changed = stored(hashed(v.curr).join(hashed(v.prev), ["id", "hash"], "left_anti").select("id"), "changed")
    lost = stored(v.prev.select("id").join(v.curr.select("id"), "id", "left_anti"), "lost")
    shape(v.curr.join(changed, "id", "left_semi"), 2, False).unionByName(shape(v.prev.join(lost, "id", "left_semi"), 2, True)).repartition(3, "id").write.parquet(other)
    store = Versioned(v.spark, shared_folder(v.spark, "corpus"), buckets=16)
    read = lambda path: v.spark.readStream.schema(refresh.SECTIONS).option("maxFilesPerTrigger", 2).parquet(path)
    refresh.refresh(store, [read(one), read(other)], ["title", "content"], shared_folder(v.spark, "refresh-state")).awaitTermination()
    return store.read("postings", v.spark.createDataFrame([], refresh.POSTINGS).schema)


#: Edits by place: a title alone; marks, two letters, and a line at the end; two letters on a first line; a first and a last line with 30 lines between.
VIEWS["edited"] = (("corpus",), """SELECT id, CASE WHEN ord % 6 = 0 THEN concat(title, '!') ELSE title END AS title,
CASE ord % 6 WHEN 1 THEN concat(content, ' --') WHEN 2 THEN concat(content, ' ab') WHEN 3 THEN concat(content, chr(10), 'one whole line') WHEN 4 THEN concat('xy', chr(10), content) WHEN 5 THEN concat('top', chr(10), content, repeat(concat(chr(10), 'z'), 30)) ELSE content END AS content FROM corpus """)
PLANTED = """, e AS (SELECT id, ord % 6 AS k, string_split(content, chr(10)) AS a FROM corpus WHERE content IS NOT NULL),
h AS (
  SELECT id, 0 AS hunk, len(a) - 1 AS old_at, len(a) - 1 AS new_at, a[greatest(len(a) - 2, 1):len(a) - 1] AS before, [a[len(a)]] AS removed, [a[len(a)] || CASE k WHEN 1 THEN ' --' ELSE ' ab' END] AS added, CAST([] AS VARCHAR[]) AS after FROM e WHERE k IN (1, 2)
  UNION ALL SELECT id, 0, len(a), len(a), a[greatest(len(a) - 1, 1):], [], ['one whole line'], [] FROM e WHERE k = 3
  UNION ALL SELECT id, 0, 0, 0, [], [], [CASE k WHEN 4 THEN 'xy' ELSE 'top' END], a[1:2] FROM e WHERE k IN (4, 5)
  UNION ALL SELECT id, 1, len(a), len(a) + 1, a[greatest(len(a) - 1, 1):], [], list_transform(range(30), lambda x: 'z'), [] FROM e WHERE k = 5)
"""


def held_fast(v):
    """Texts whose edits at both ends have a line between them that is there once, for edits of the last kind."""
    kind = F.pmod(F.substring("id", 2, 20).cast("long"), F.lit(6))
    lines = v.corpus.where(kind == 5).select("id", F.explode(F.split("content", "\n")).alias("line")).groupBy("id", "line").count().where("count = 1").select("id").distinct()
    return kind, lines


@query("h4_placed_hunks", "corpus", sql=PLANTED + """SELECT id, hunk, old_at, new_at, array_to_string(before, chr(10)) AS before, array_to_string(removed, chr(10)) AS removed, array_to_string(added[:20], chr(10)) AS added, array_to_string(after, chr(10)) AS after, greatest(len(added) - 20, 0) AS more_added FROM h
WHERE id NOT IN (SELECT id FROM e WHERE k = 5) OR id IN (SELECT id FROM (SELECT id, unnest(a) AS line FROM e) x GROUP BY id, line HAVING count(*) = 1)""")
def _(v):
    kind, lines = held_fast(v)
    # without a line that is there once, both edits of a text are one hunk
    taken = v.corpus.where(kind != 5).unionByName(v.corpus.join(lines, "id", "left_semi").where(kind == 5)).select("id", "title", "content")
    shown = history.shown_hunks(history.placed_hunks(taken, v.edited))
    join = lambda c: F.array_join(c, "\n").alias(c)
    return shown.select("id", "hunk", "old_at", "new_at", join("before"), join("removed"), join("added"), join("after"), "more_added")


@query("h5_kinds", "corpus", sql="SELECT id, CASE ord % 6 WHEN 0 THEN NULL WHEN 1 THEN 'lint' WHEN 2 THEN 'typo' WHEN 4 THEN 'typo' ELSE 'semantic' END AS kind FROM corpus WHERE content IS NOT NULL")
def _(v):
    return history.change_kinds(v.corpus.where("content IS NOT NULL").select("id", "title", "content"), v.edited)


def resumed(v):
    """The history in three runs, the second twice and with what the first had already."""
    store = Versioned(v.spark, shared_folder(v.spark, "history"), buckets=4)
    last = v.history.agg(F.max("commit_seq")).first()[0]
    for upto in (last // 3, last // 2, last // 2, last):
        history.resume(store, v.history.where(F.col("commit_seq") <= upto).select("doc_id", "commit_hash", "commit_seq", "change_type"))
    return store


@query("h13_resumed", "history", sql="SELECT DISTINCT doc_id, commit_hash, commit_seq, change_type FROM history")
def _(v):
    return resumed(v).read("entries", v.history.select("doc_id", "commit_hash", "commit_seq", "change_type").schema)


@query("h13_counts", "history", sql="SELECT change_type, CAST(count(DISTINCT (doc_id, commit_hash)) AS BIGINT) AS n FROM history GROUP BY change_type")
def _(v):
    return resumed(v).read("counts", v.history.groupBy("change_type").agg(F.count("*").alias("n")).schema)


@query("s14_files")
def _(v):
    return tables.merkle_roots(tables.file_manifest(v.spark, {t: f"{v._dir}/{t}.parquet" for t in TABLES}))
