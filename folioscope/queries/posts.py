"""Queries over posts, which are documents with planted headings, lists and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution, posts
from . import VIEWS, query

#: By doc_id modulo 5: a summary among chapters; three topics, an empty one, and items before them; topics under chapters
#: without a summary; one topic; a summary alone. Texts lose their number signs, so headings are the planted ones.
VIEWS["posts"] = ((), """
SELECT doc_id AS post_id, concat('Topic ', doc_id) AS title, CASE doc_id % 5
WHEN 0 THEN concat('Hello', chr(10), '## Summary', chr(10), t, chr(10), '### Nested', chr(10), 'more [here](http://x.y/z)', chr(10), '## Background', chr(10), 'See A.1.', doc_id, '.')
WHEN 1 THEN concat('Edits:', chr(10), '- **Edit A** - left out, as a topic says it', chr(10), '* **Empty** — *not* told below', chr(10), '- **Only Listed** – in A.3.', doc_id, chr(10),
  '### **Edit A**', chr(10), '> ', t, chr(10), '- see A.2.', doc_id, ' in **bold**', chr(10), '###  `Edit` B', chr(10), t, t, chr(10), '### Empty', chr(10), ' ', chr(10), '## Chapter', chr(10), t, ' A.4.', doc_id)
WHEN 2 THEN concat('## Part', chr(10), '### One', chr(10), 'first', chr(10), '## Other', chr(10), '### Two', chr(10), t)
WHEN 3 THEN concat('### Alone', chr(10), t, ' A.5.', doc_id)
ELSE concat('## summary', chr(10), t) END AS body FROM (SELECT doc_id, replace(coalesce(text, ''), '#', '') AS t FROM {documents}) x""")

FLAT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^[ \t]*(?:>[ \t]?|[-*][ \t]+|#{1,6}[ \t]+)+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g'))"""
SHORT = """CASE WHEN len(f) <= 600 THEN f WHEN strpos(reverse(f[1:600]), ' ') BETWEEN 1 AND 239 THEN concat(trim(f[1:600 - strpos(reverse(f[1:600]), ' ')]), '…') ELSE concat(trim(f[1:600]), '…') END"""
#: What the headings planted above must give, from the documents themselves.
TOLD = f"""
WITH t AS (SELECT doc_id, doc_id % 5 AS k, replace(coalesce(text, ''), '#', '') AS t FROM documents),
b AS (
  SELECT doc_id, 0 AS n, concat('Topic ', doc_id) AS title, concat(t, chr(10), '### Nested', chr(10), 'more [here](http://x.y/z)') AS x, 'summary' AS origin FROM t WHERE k = 0
  UNION ALL SELECT doc_id, 0, 'Edit A', concat('> ', t, chr(10), '- see A.2.', doc_id, ' in **bold**'), 'topic' FROM t WHERE k = 1
  UNION ALL SELECT doc_id, 1, 'Edit B', concat(t, t), 'topic' FROM t WHERE k = 1
  UNION ALL SELECT doc_id, 2, 'Empty', NULL, 'item' FROM t WHERE k = 1
  UNION ALL SELECT doc_id, 3, 'Only Listed', NULL, 'item' FROM t WHERE k = 1
  UNION ALL SELECT doc_id, 0, 'One', 'first', 'topic' FROM t WHERE k = 2
  UNION ALL SELECT doc_id, 1, 'Two', t, 'topic' FROM t WHERE k = 2),
d AS (SELECT doc_id, n, title, origin, CASE WHEN title = 'Empty' THEN '*not* told below' WHEN title = 'Only Listed' THEN concat('in A.3.', doc_id) ELSE {SHORT} END AS description FROM (SELECT *, {FLAT} AS f FROM b) y),
told AS (SELECT doc_id AS post_id, CASE WHEN origin = 'summary' THEN 'summary' ELSE 'topics' END AS mode, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS bullet, title, description, origin FROM d WHERE description <> ''),
posts_told AS (SELECT * FROM told UNION ALL SELECT doc_id, 'none', NULL, NULL, NULL, NULL FROM t WHERE doc_id NOT IN (SELECT post_id FROM told))
"""


@query("h8_posts", sql=TOLD + "SELECT * FROM posts_told")
def _(v):
    return posts.post_bullets(posts.parse_posts(v.posts))


@query("h8_harvested", sql=TOLD + """SELECT post_id, r AS ref, CASE WHEN mode = 'none' THEN NULL WHEN r LIKE 'A.3.%' THEN bullet ELSE 0 END AS bullet FROM (
SELECT post_id, mode, max(CASE WHEN title = 'Only Listed' THEN bullet END) AS bullet, unnest(CASE post_id % 5 WHEN 0 THEN ['A.1.' || post_id] WHEN 1 THEN ['A.2.' || post_id, 'A.3.' || post_id, 'A.4.' || post_id] WHEN 3 THEN ['A.5.' || post_id] ELSE [] END) AS r FROM posts_told GROUP BY post_id, mode) x""")
def _(v):
    found = posts.harvested(v.posts, posts.parse_posts(v.posts))
    # numbers that texts may have by chance aren't planted
    return found.where(F.col("ref").rlike(r"^A\.[1-5]\.[0-9]+$") & F.endswith(F.col("ref"), F.concat(F.lit("."), F.col("post_id").cast("string"))))


@query("h8_attributed", sql="SELECT n_regionkey AS set_id, concat('N', n_nationkey) AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS bullet, 100 AS score, 'ref' AS via FROM nation")
def _(v):
    # a post for each region, with a topic for each nation that names its section far beyond the description's end
    number = F.concat(F.lit("A."), (F.col("n_regionkey") + 1).cast("string"), F.lit("."), (F.col("n_nationkey") + 1).cast("string"))
    topic = F.concat(F.lit("### Topic "), F.col("n_nationkey").cast("string"), F.lit("\n"), F.repeat(F.lit("words and "), 100), F.lit("in "), number, F.lit(" at last\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", topic.alias("topic")))), lambda s: s["topic"]), "")
    # the 25 nations of the given table; each post is a region's
    told = v.nation.groupBy(F.col("n_regionkey").alias("post_id")).agg(F.lit("Weekly").alias("title"), body.alias("body"))
    parsed = posts.parse_posts(told)
    bullets = posts.post_bullets(parsed).select(F.col("post_id").alias("set_id"), "bullet", "title", "description")
    refs = posts.harvested(told, parsed).where("bullet IS NOT NULL").select(F.col("post_id").alias("set_id"), "ref", "bullet")
    nodes = v.nation.select(F.col("n_regionkey").alias("set_id"), F.concat(F.lit("N"), "n_nationkey").alias("id"), number.alias("doc_no"), F.col("n_name").alias("title"))
    return attribution.attributed(bullets, nodes, v.docs.select("doc_no", "title"), harvested=refs)
