"""Queries over edges, trees, joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import filters, graph, hierarchy, tables
from ..session import stored
from . import TABLES, query


@query("j1_edges_of_docs", "edges", "docs", sql="SELECT d.type, e.edge_type, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN docs d ON e.to_id = d.id AND e.to_type = 'doc' GROUP BY ALL")
def _(v):
    ends = v.edges.where("to_type = 'doc'").select(F.col("to_id").alias("id"), "edge_type")
    return ends.join(v.docs.select("id", "type"), "id").groupBy("type", "edge_type").agg(F.count("*").alias("n"))


@query("j2_labels", "edges", "docs", "entities", sql="""SELECT e.edge_type, e.from_id, e.to_id, coalesce(CASE e.from_type WHEN 'entity' THEN f.name ELSE g.title END, e.from_id) AS from_label, coalesce(CASE e.to_type WHEN 'entity' THEN t.name ELSE h.title END, e.to_id) AS to_label
FROM edges e LEFT JOIN entities f ON f.id = e.from_id LEFT JOIN docs g ON g.id = e.from_id LEFT JOIN entities t ON t.id = e.to_id LEFT JOIN docs h ON h.id = e.to_id""")
def _(v):
    return graph.labelled(v.edges, v.entities, v.docs).select("edge_type", "from_id", "to_id", "from_label", "to_label")


@query("j3_constraints", "corpus", "history", sql="SELECT id FROM corpus WHERE id IN (SELECT doc_id FROM history WHERE change_type = 'added') AND id IN (SELECT doc_id FROM history WHERE change_type = 'removed' AND date >= '2024-01-05')")
def _(v):
    return filters.constrained(v.corpus.select("id"), "id", filters.changed_ids(v.history, change_type="added"), filters.changed_ids(v.history, change_type="removed", since="2024-01-05"), None)


@query("j4_missing", "prev", "curr", sql="SELECT 'gone' AS what, id FROM prev WHERE id NOT IN (SELECT id FROM curr) UNION ALL SELECT 'new', id FROM curr WHERE id NOT IN (SELECT id FROM prev)")
def _(v):
    gone = v.prev.join(v.curr.select("id"), "id", "left_anti").select(F.lit("gone").alias("what"), "id")
    return gone.unionByName(v.curr.join(v.prev.select("id"), "id", "left_anti").select(F.lit("new").alias("what"), "id"))


@query("j5_versions", "prev", "curr", sql="SELECT coalesce(p.id, c.id) AS id, p.id IS NOT NULL AS before, c.id IS NOT NULL AS after, p.content IS DISTINCT FROM c.content AS differs FROM prev p FULL JOIN curr c ON p.id = c.id")
def _(v):
    return tables.version_pairs(v.prev, v.curr).select("id", F.col("p").isNotNull().alias("before"), F.col("c").isNotNull().alias("after"), (~F.col("p.content").eqNullSafe(F.col("c.content"))).alias("differs"))


@query("j6_prefixes", "docs", sql="SELECT d.id, p.doc_no AS prefix, p.title AS owner FROM docs d JOIN docs p ON p.depth = 2 AND (d.doc_no = p.doc_no OR starts_with(d.doc_no, concat(p.doc_no, '.')))")
def _(v):
    owners = v.docs.where("depth = 2").select(F.col("doc_no").alias("prefix"), F.col("title").alias("owner"))
    return hierarchy.under_prefixes(v.docs.select("id", "doc_no"), owners).select("id", "prefix", "owner")


@query("j7_first_and_last", "edges", sql="SELECT to_id, min(from_id) AS first_party, max(from_id) AS last_party FROM edges WHERE edge_type = 'responsible_party_for' GROUP BY to_id")
def _(v):
    rows = v.edges.where("edge_type = 'responsible_party_for'")
    first = graph.picked(rows, "to_id", "from_id", F.col("from_id"), last=False).withColumnRenamed("from_id", "first_party")
    return first.join(graph.picked(rows, "to_id", "from_id", F.col("from_id")).withColumnRenamed("from_id", "last_party"), "to_id")


@query("j8_glossary_terms", "corpus", sql=r"""SELECT DISTINCT c.id, t.term FROM (SELECT id, list_filter(string_split_regex(lower(content), '[^a-z]+'), lambda w: w <> '') AS w FROM corpus) c,
(SELECT unnest(['apache license', 'the', 'all rights reserved', 'licensed under the']) AS term) t WHERE contains(concat(' ', array_to_string(c.w, ' '), ' '), concat(' ', t.term, ' '))""")
def _(v):
    terms = v.spark.createDataFrame([("apache license",), ("the",), ("all rights reserved",), ("licensed under the",)], "term string")
    return tables.glossary_hits(v.corpus.select("id", "content"), terms).select("id", "term")


@query("j9_by_id_or_number", "docs", sql="SELECT r.asked, d.id FROM (SELECT unnest(['C1', 'A.1', 'A.2.6', 'S3', 'nothing']) AS asked) r JOIN docs d ON d.id = r.asked OR d.doc_no = r.asked")
def _(v):
    asked = v.spark.createDataFrame([(x,) for x in ("C1", "A.1", "A.2.6", "S3", "nothing")], "asked string")
    by_id = asked.join(v.docs.select("id"), F.col("asked") == F.col("id"))
    return by_id.unionByName(asked.join(v.docs.select("id", "doc_no"), F.col("asked") == F.col("doc_no")).select("asked", "id")).distinct()


@query("j10_two_hops", "edges", "entities", sql="""SELECT e.from_id AS entity_id, e.to_id AS doc_id, e.edge_type FROM edges e WHERE e.from_type = 'entity' AND e.to_type = 'doc'
AND e.from_id IN (SELECT from_id FROM edges JOIN entities ON entities.id = from_id AND entity_type = 'supplier' WHERE edge_type = 'located_in' AND to_id = 'N3')
UNION ALL SELECT e.to_id, e.from_id, e.edge_type FROM edges e WHERE e.from_type = 'doc' AND e.to_type = 'entity' AND e.to_id IN (SELECT from_id FROM edges JOIN entities ON entities.id = from_id AND entity_type = 'supplier' WHERE edge_type = 'located_in' AND to_id = 'N3')""")
def _(v):
    return graph.two_hops(v.edges, v.entities, "N3", "supplier")


@query("j11_by_slug", "entities", sql="SELECT e.id, l.label FROM (SELECT name AS label FROM entities WHERE entity_type <> 'part') l JOIN entities e ON e.entity_type <> 'part' AND e.slug = concat(trim(regexp_replace(lower(l.label), '[^a-z0-9]+', '-', 'g'), '-'), '-', lower(e.id))")
def _(v):
    own = v.entities.where("entity_type <> 'part'")
    left = own.select(F.col("name").alias("label"), text.slugify(F.col("name")).alias("key"))
    right = own.select("id", F.expr("substring(slug, 1, length(slug) - length(id) - 1)").alias("key"))
    return right.join(left, "key").select("id", "label")


@query("j12_parent_child", "docs", sql="SELECT c.id, p.id AS parent, p.title AS parent_title FROM docs c JOIN docs p ON c.parent_id = p.id")
def _(v):
    return v.docs.select("id", F.col("parent_id").alias("parent")).join(v.docs.select(F.col("id").alias("parent"), F.col("title").alias("parent_title")), "parent")


@query("a1_counts", "docs", sql="SELECT type, depth, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (content = '') AS BIGINT) AS bare FROM docs GROUP BY type, depth")
def _(v):
    return v.docs.groupBy("type", "depth").agg(F.count("*").alias("n"), F.count_if(F.col("content") == "").alias("bare"))


@query("a2_describe", "docs", "edges", "entities", sql="""SELECT 'doc' AS part, type AS a, CAST(NULL AS VARCHAR) AS b, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY type UNION ALL
SELECT 'edge', edge_type, NULL, count(*) FROM edges GROUP BY edge_type UNION ALL SELECT 'entity', entity_type, subtype, count(*) FROM entities GROUP BY entity_type, subtype""")
def _(v):
    parts = ((v.docs, "doc", "type", None), (v.edges, "edge", "edge_type", None), (v.entities, "entity", "entity_type", "subtype"))
    rows = [df.groupBy(F.lit(p).alias("part"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b")).agg(F.count("*").alias("n")) for df, p, a, b in parts]
    return reduce(lambda x, y: x.unionByName(y), rows)


@query("a3_type_graph", "edges", "entities", sql="SELECT f.entity_type AS from_kind, e.edge_type, t.entity_type AS to_kind, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN entities f ON f.id = e.from_id AND e.from_type = 'entity' JOIN entities t ON t.id = e.to_id AND e.to_type = 'entity' GROUP BY ALL")
def _(v):
    between = v.edges.where("from_type = 'entity' AND to_type = 'entity'")
    f = v.entities.select(F.col("id").alias("from_id"), F.col("entity_type").alias("from_kind"))
    t = v.entities.select(F.col("id").alias("to_id"), F.col("entity_type").alias("to_kind"))
    return between.join(f, "from_id").join(t, "to_id").groupBy("from_kind", "edge_type", "to_kind").agg(F.count("*").alias("n"))


@query("a4_edge_types", "edges", sql="SELECT edge_type, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY edge_type")
def _(v):
    return v.edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("a5_value_sets", "corpus", sql="SELECT type, array_to_string(list_sort(list(DISTINCT split_part(doc_no, '.', 1))), ' ') AS sources FROM corpus GROUP BY type")
def _(v):
    return v.corpus.groupBy("type").agg(F.array_join(F.array_sort(F.collect_set(F.split_part("doc_no", F.lit("."), F.lit(1)))), " ").alias("sources"))


@query("a6_most_specific", "history", sql="SELECT doc_id, coalesce(min(change_type) FILTER (change_type <> 'modified'), min(change_type)) AS kind FROM history GROUP BY doc_id")
def _(v):
    return v.history.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("change_type") != "modified", F.col("change_type"))), F.min("change_type")).alias("kind"))


@query("a7_longest_label", "entities", sql="SELECT subtype, label, array_to_string(rest, '|') AS aliases FROM (SELECT subtype, l[1] AS label, l[2:4] AS rest FROM (SELECT subtype, list(name ORDER BY -len(name), name) AS l FROM (SELECT DISTINCT subtype, name FROM entities WHERE entity_type = 'part') GROUP BY subtype))")
def _(v):
    names = v.entities.where("entity_type = 'part'").groupBy("subtype").agg(tables.longest_first(F.collect_set("name")).alias("l"))
    return names.select("subtype", F.get("l", F.lit(0)).alias("label"), F.array_join(F.slice("l", 2, 3), "|").alias("aliases"))


@query("a7_labels_and_aliases", "entities", sql="SELECT subtype, name, row_number() OVER (PARTITION BY subtype ORDER BY -len(name), name) = 1 AS is_label FROM (SELECT DISTINCT subtype, name FROM entities WHERE entity_type = 'part') x")
def _(v):
    names = v.entities.where("entity_type = 'part'").select("subtype", "name").distinct()
    first = F.row_number().over(Window.partitionBy("subtype").orderBy(-F.length("name"), "name")) == 1
    return names.withColumn("is_label", first)


@query("a8_degrees", "edges", sql="SELECT t AS node_type, i AS node_id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT from_type AS t, from_id AS i FROM edges UNION ALL SELECT to_type, to_id FROM edges) GROUP BY ALL")
def _(v):
    return graph.degrees(v.edges)


@query("a10_length_percentiles", "corpus", sql="SELECT type, CAST(l[1 + least(CAST(floor(len(l) * 0.5) AS INT), len(l) - 1)] AS INT) AS p50, CAST(l[1 + least(CAST(floor(len(l) * 0.9) AS INT), len(l) - 1)] AS INT) AS p90 FROM (SELECT type, list(len(content) ORDER BY len(content)) AS l FROM corpus GROUP BY type)")
def _(v):
    return tables.at_fractions(v.corpus.select("type", F.length("content").alias("n")), "type", "n", {"p50": 0.5, "p90": 0.9})


@query("a13_by_commit", "history", sql="SELECT commit_hash, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, array_to_string(list_sort(list(DISTINCT concat(doc_id, ':', change_type))), ' ') AS changes FROM history GROUP BY commit_hash")
def _(v):
    change = F.concat_ws(":", "doc_id", "change_type")
    return v.history.groupBy("commit_hash").agg(F.countDistinct("doc_id").alias("docs"), F.array_join(F.array_sort(F.collect_set(change)), " ").alias("changes"))


@query("a14_latest_edit", "history", sql="SELECT doc_id, max(date) AS latest FROM history GROUP BY doc_id")
def _(v):
    return v.history.groupBy("doc_id").agg(F.max_by("date", F.struct("commit_seq", "event_id")).alias("latest"))


@query("a15_by_relationship", "edges", sql="SELECT edge_type, CAST(count(DISTINCT to_id) AS BIGINT) AS n, min(to_id) AS first_id, max(to_id) AS last_id FROM edges WHERE from_type = 'entity' AND to_type = 'doc' AND from_id = 'S1' GROUP BY edge_type")
def _(v):
    own = graph.entity_docs(v.edges.where("from_type = 'entity'"), "S1")
    return own.groupBy("edge_type").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("a17_usage_windows", "history", sql="SELECT user_id, time_bucket(INTERVAL '120 minutes', ts, TIMESTAMP '1970-01-01') AS start, round(sum(value), 4) AS used FROM history GROUP BY ALL")
def _(v):
    return v.history.groupBy("user_id", F.window("ts", "120 minutes").alias("w")).agg(F.round(F.sum("value"), 4).alias("used")).select("user_id", F.col("w.start").alias("start"), "used")


@query("a18_facets", "entities", sql="SELECT CASE WHEN subtype IS NULL THEN entity_type ELSE concat(entity_type, ':', subtype) END AS facet, CAST(count(*) AS BIGINT) AS n FROM entities GROUP BY 1")
def _(v):
    return v.entities.groupBy(F.concat_ws(":", "entity_type", "subtype").alias("facet")).agg(F.count("*").alias("n"))


@query("a19_conversation_totals", sql="SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(sum(len(text)) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def _(v):
    return v.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


@query("a20_slug_list", "entities", sql="SELECT slug FROM entities WHERE entity_type = 'supplier' ORDER BY slug LIMIT 100")
def _(v):
    return v.entities.where("entity_type = 'supplier'").select("slug").orderBy("slug").limit(100)


@query("w2_first_write", "entities", sql="SELECT subtype, id FROM (SELECT subtype, id, row_number() OVER (PARTITION BY subtype ORDER BY name, id) AS n FROM entities WHERE subtype IS NOT NULL) WHERE n = 1")
def _(v):
    return tables.first_by(v.entities.where("subtype IS NOT NULL").select("subtype", "id", "name"), ["subtype"], F.col("name"), F.col("id")).select("subtype", "id")


@query("w4_lag_lead", "history", sql="SELECT event_id, lag(change_type) OVER w AS before, lead(commit_seq) OVER w - commit_seq AS gap FROM history WINDOW w AS (PARTITION BY doc_id ORDER BY commit_seq, event_id)")
def _(v):
    w = Window.partitionBy("doc_id").orderBy("commit_seq", "event_id")
    return v.history.select("event_id", F.lag("change_type").over(w).alias("before"), (F.lead("commit_seq").over(w) - F.col("commit_seq")).alias("gap"))


@query("w6_commit_sequence", "commits", sql="SELECT day, commit_seq FROM commits")
def _(v):
    days = v.events.select(F.col("ts").cast("date").alias("day")).distinct()
    return days.withColumn("commit_seq", F.row_number().over(Window.partitionBy().orderBy("day")))  # one row a day


@query("w7_siblings", "docs", sql="SELECT id, n FROM (SELECT id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY ord, id) AS INT) AS n FROM docs WHERE parent_id IS NOT NULL) WHERE n <= 6")
def _(v):
    n = F.row_number().over(Window.partitionBy("parent_id").orderBy("ord", "id"))
    return v.docs.where("parent_id IS NOT NULL").select("id", n.alias("n")).where("n <= 6")


@query("o1_natural_order", "docs", sql="SELECT id FROM docs WHERE depth = 3 ORDER BY array_to_string(list_transform(string_split(doc_no, '.'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 10, '0') ELSE x END), '.'), id LIMIT 50")
def _(v):
    return v.docs.where("depth = 3").orderBy(text.natural_key(F.col("doc_no")), "id").limit(50).select("id")


@query("o1_whole_order", "docs", sql="SELECT id, array_to_string(list_transform(string_split(doc_no, '.'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 10, '0') ELSE x END), '.') AS key FROM docs ORDER BY key, id")
def _(v):
    return v.docs.select("id", text.natural_key(F.col("doc_no")).alias("key")).orderBy("key", "id")


@query("o2_flag_then_number", "docs", "curr", sql="SELECT id FROM docs ORDER BY (id LIKE 'S%') DESC, array_to_string(list_transform(string_split(doc_no, '.'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 10, '0') ELSE x END), '.'), id LIMIT 40")
def _(v):
    return v.docs.orderBy(F.col("id").startswith("S").desc(), text.natural_key(F.col("doc_no")), "id").limit(40).select("id")


@query("o2_whole_order", "docs", sql="SELECT id, id LIKE 'S%' AS flag, array_to_string(list_transform(string_split(doc_no, '.'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 10, '0') ELSE x END), '.') AS key FROM docs ORDER BY flag DESC, key, id")
def _(v):
    return v.docs.select("id", F.col("id").startswith("S").alias("flag"), text.natural_key(F.col("doc_no")).alias("key")).orderBy(F.desc("flag"), "key", "id")


@query("o5_entity_hits", "entities", sql="SELECT id, name FROM (SELECT *, CASE WHEN lower(name) = 'a' THEN 3 WHEN starts_with(lower(name), 'a') THEN 2 WHEN contains(lower(name), 'a') THEN 1 ELSE 0 END AS s FROM entities) WHERE s > 0 ORDER BY s DESC, len(name), id LIMIT 6")
def _(v):
    scored = v.entities.withColumn("s", filters.name_score(F.col("name"), "a")).where("s > 0")
    return scored.orderBy(F.desc("s"), F.length("name"), "id").limit(6).select("id", "name")


@query("o7_newest_first", "history", sql="SELECT event_id, date FROM history ORDER BY commit_seq DESC, event_id DESC LIMIT 30")
def _(v):
    return v.history.orderBy(F.desc("commit_seq"), F.desc("event_id")).limit(30).select("event_id", "date")


@query("o7_whole_history", "history", sql="SELECT event_id, date, commit_seq FROM history ORDER BY commit_seq DESC, event_id DESC")
def _(v):
    return v.history.select("event_id", "date", "commit_seq").orderBy(F.desc("commit_seq"), F.desc("event_id"))


@query("u1_bag_union", "edges", sql="SELECT edge_type, CAST(2 * count(*) AS BIGINT) AS n FROM edges GROUP BY edge_type")
def _(v):
    return v.edges.unionByName(v.edges).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("u2_intersection", "prev", "curr", sql="SELECT id, title FROM prev INTERSECT SELECT id, title FROM curr")
def _(v):
    return v.prev.select("id", "title").intersect(v.curr.select("id", "title"))


@query("u3_difference", "prev", "curr", sql="SELECT id, path FROM prev EXCEPT SELECT id, path FROM curr")
def _(v):
    return v.prev.select("id", "path").exceptAll(v.curr.select("id", "path"))


@query("u4_two_routes", "edges", sql="SELECT to_id AS id FROM edges WHERE edge_type = 'supplies' AND from_id = 'S1' UNION SELECT to_id FROM edges WHERE edge_type = 'responsible_party_for' AND from_id = 'S1'")
def _(v):
    route = lambda t: v.edges.where((F.col("edge_type") == t) & (F.col("from_id") == "S1")).select(F.col("to_id").alias("id"))
    return route("supplies").unionByName(route("responsible_party_for")).distinct()


@query("u5_three_tiers", "prev", "curr", sql="SELECT coalesce(p.id, c.id) AS id, CASE WHEN p.id IS NOT NULL AND c.id IS NOT NULL THEN 0 WHEN p.id IS NOT NULL THEN 1 ELSE 2 END AS tier FROM prev p FULL JOIN curr c ON p.id = c.id")
def _(v):
    both = tables.version_pairs(v.prev, v.curr)
    return both.select("id", F.when(F.col("p").isNotNull() & F.col("c").isNotNull(), 0).when(F.col("p").isNotNull(), 1).otherwise(2).alias("tier"))


CHAIN = """, c1 AS (SELECT id, 1 AS hop, parent_id AS ancestor_id FROM docs WHERE parent_id IS NOT NULL),
c2 AS (SELECT c1.id, 2 AS hop, d.parent_id AS ancestor_id FROM c1 JOIN docs d ON d.id = c1.ancestor_id WHERE d.parent_id IS NOT NULL),
c3 AS (SELECT c2.id, 3 AS hop, d.parent_id AS ancestor_id FROM c2 JOIN docs d ON d.id = c2.ancestor_id WHERE d.parent_id IS NOT NULL),
chain AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) """


@query("g1_ancestors", "docs", sql=CHAIN + "SELECT id, hop, ancestor_id FROM chain")
def _(v):
    return hierarchy.parent_chain(v.docs)


@query("g2_number_ancestors", "docs", sql="SELECT d.id, p.id AS ancestor_id, p.doc_no AS ancestor_no FROM docs d JOIN docs p ON starts_with(d.doc_no, concat(p.doc_no, '.'))")
def _(v):
    return hierarchy.number_ancestors(v.docs)


@query("g3_subtree", "docs", sql=CHAIN + "SELECT 'N4' AS id UNION ALL SELECT id FROM chain WHERE ancestor_id = 'N4'")
def _(v):
    return hierarchy.subtree(v.docs, "N4")


@query("g4_closest_flagged", "docs", sql=CHAIN + "SELECT id, min(hop) AS hop, arg_min(ancestor_id, hop) AS ancestor_id FROM chain WHERE ancestor_id IN (SELECT id FROM docs WHERE depth = 1 OR type = 'BUILDING') GROUP BY id")
def _(v):
    return hierarchy.closest_flagged(v.docs, v.docs.where("depth = 1 OR type = 'BUILDING'").select("id"))


@query("g6_display_parent", "docs", sql=r"""SELECT d.id, coalesce(p.id, d.parent_id) AS display_parent_id FROM (SELECT *, CASE WHEN regexp_matches(doc_no, '\.0\.6\.[^.]+$') THEN regexp_replace(doc_no, '\.0\.6\.[^.]+$', '') WHEN contains(doc_no, '.') THEN regexp_replace(doc_no, '\.[^.]+$', '') END AS k FROM docs) d LEFT JOIN docs p ON p.doc_no = d.k""")
def _(v):
    return hierarchy.display_parent(v.docs)


@query("g7_children", "docs", sql="SELECT parent_id, array_to_string(list(id ORDER BY ord, id), ' ') AS ids FROM docs WHERE parent_id IS NOT NULL GROUP BY parent_id")
def _(v):
    return hierarchy.children(v.docs).select("parent_id", F.array_join("children", " ").alias("ids"))


@query("g9_edges_of_node", "edges", sql="SELECT edge_type, 'outbound' AS direction, to_type AS other_type, to_id AS other_id FROM edges WHERE from_type = 'entity' AND from_id = 'S1' UNION ALL SELECT edge_type, 'inbound', from_type, from_id FROM edges WHERE to_type = 'entity' AND to_id = 'S1'")
def _(v):
    return graph.touching(v.edges, "entity", "S1")


STEP = """, st AS (SELECT DISTINCT * FROM (SELECT from_type AS a, from_id AS b, to_type AS c, to_id AS d FROM edges UNION ALL SELECT to_type, to_id, from_type, from_id FROM edges)),
h0 AS (SELECT 'entity' AS node_type, 'S1' AS node_id, 0 AS depth),
h1 AS (SELECT DISTINCT c AS node_type, d AS node_id, 1 AS depth FROM h0 JOIN st ON a = node_type AND b = node_id WHERE (c, d) NOT IN (SELECT (node_type, node_id) FROM h0)),
h2 AS (SELECT DISTINCT c AS node_type, d AS node_id, 2 AS depth FROM h1 JOIN st ON a = node_type AND b = node_id WHERE (c, d) NOT IN (SELECT (node_type, node_id) FROM h0 UNION ALL SELECT (node_type, node_id) FROM h1)),
hops AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) """


@query("g10_traverse", "edges", sql=STEP + "SELECT node_type, node_id, depth FROM hops")
def _(v):
    return graph.reach(stored(v.edges, "edges"), v.spark.createDataFrame([("entity", "S1")], "node_type string, node_id string"), 2)


@query("g11_subgraph", "edges", sql=STEP + "SELECT edge_type, CAST(count(*) AS BIGINT) AS n FROM edges WHERE (from_type, from_id) IN (SELECT (node_type, node_id) FROM hops WHERE depth < 2) AND (to_type, to_id) IN (SELECT (node_type, node_id) FROM hops WHERE depth < 2) GROUP BY edge_type")
def _(v):
    near = graph.reach(v.edges, v.spark.createDataFrame([("entity", "S1")], "node_type string, node_id string"), 1)
    return graph.induced(v.edges, near).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("g12_neighbourhood", "edges", sql="""SELECT DISTINCT id FROM (SELECT 'N1' AS id UNION ALL SELECT 'N2' UNION ALL SELECT from_id FROM edges WHERE from_type = 'entity' AND to_type = 'entity' AND to_id IN ('N1', 'N2') UNION ALL SELECT to_id FROM edges WHERE from_type = 'entity' AND to_type = 'entity' AND from_id IN ('N1', 'N2'))""")
def _(v):
    seeds = v.spark.createDataFrame([("entity", "N1"), ("entity", "N2")], "node_type string, node_id string")
    return graph.reach(v.edges.where("from_type = 'entity' AND to_type = 'entity'"), seeds, 1).select(F.col("node_id").alias("id"))


@query("g15_entity_docs", "edges", sql="SELECT from_id AS entity_id, to_id AS doc_id, edge_type FROM edges WHERE from_type = 'entity' AND to_type = 'doc' AND edge_type = 'responsible_party_for' UNION ALL SELECT to_id, from_id, edge_type FROM edges WHERE from_type = 'doc' AND to_type = 'entity' AND edge_type = 'responsible_party_for'")
def _(v):
    return graph.entity_docs(v.edges, edge_type="responsible_party_for")


@query("g16_around", "docs", sql="SELECT 'parent' AS relation, parent_id AS id FROM docs WHERE id = 'N4' UNION ALL SELECT 'child', id FROM docs WHERE parent_id = 'N4' UNION ALL (SELECT 'sibling', id FROM docs WHERE parent_id = (SELECT parent_id FROM docs WHERE id = 'N4') AND id <> 'N4' ORDER BY ord, id LIMIT 4)")
def _(v):
    return hierarchy.around(v.docs, "N4", 2)


@query("g18_integrity", "docs", "edges", "entities", sql="""SELECT concat('dangling ', t) AS problem, CAST(count(*) AS BIGINT) AS n FROM (SELECT from_type AS t, from_id AS i FROM edges UNION ALL SELECT to_type, to_id FROM edges) WHERE (t, i) NOT IN (SELECT ('doc', id) FROM docs UNION ALL SELECT ('entity', id) FROM entities) GROUP BY t
UNION ALL SELECT 'orphan parent', count(*) FROM docs WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM docs) UNION ALL SELECT 'slug given twice', count(*) FROM (SELECT slug FROM entities GROUP BY slug HAVING count(*) > 1)""")
def _(v):
    return hierarchy.integrity(v.docs, v.edges, v.entities)


@query("g18_unresolved", "cards", "card_edges", sql="""SELECT 'link to nothing' AS problem, CAST(count(*) AS BIGINT) AS n FROM (
SELECT o_orderkey AS i, o_orderkey + 1 AS k FROM orders WHERE o_orderstatus <> 'P' UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P') WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'evidence of nothing', CAST(count(*) AS BIGINT) FROM card_edges WHERE source IS NOT NULL AND source NOT IN (SELECT doc_no FROM cards)
UNION ALL SELECT 'number given twice', CAST(count(*) AS BIGINT) FROM (SELECT doc_no FROM cards GROUP BY doc_no HAVING count(*) > 1)""")
def _(v):
    return hierarchy.unresolved(v.cards, v.card_edges)


@query("g19_entity_nodes", "edges", "entities", sql="""SELECT e.id, e.entity_type, CAST(coalesce(d.n, 0) AS BIGINT) AS degree, least(coalesce(d.n, 0), 8) * 0.8::DOUBLE + 4 AS size FROM entities e LEFT JOIN (SELECT i, count(*) AS n FROM (SELECT from_id AS i FROM edges WHERE from_type = 'entity' AND to_type = 'entity' UNION ALL SELECT to_id FROM edges WHERE from_type = 'entity' AND to_type = 'entity') GROUP BY i) d ON d.i = e.id""")
def _(v):
    d = graph.degrees(v.edges.where("from_type = 'entity' AND to_type = 'entity'")).select(F.col("node_id").alias("id"), "degree")
    nodes = v.entities.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return nodes.select("id", "entity_type", "degree", (F.least("degree", F.lit(8)) * 0.8 + 4).alias("size"))


@query("s14_manifest")
def _(v):
    return reduce(lambda a, b: a.unionByName(b), [tables.fingerprint(getattr(v, t), t) for t in TABLES])


@query("s15_reconcile", "prev", "curr", sql="SELECT coalesce(c.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'I' WHEN c.id IS NULL THEN 'D' WHEN p.title = c.title AND p.content = c.content AND p.path = c.path THEN '=' ELSE 'U' END AS op FROM prev p FULL JOIN curr c ON p.id = c.id")
def _(v):
    return tables.reconcile(v.prev, v.curr, ["id"])


@query("s16_append_new", "history", sql="SELECT DISTINCT doc_id, commit_hash, change_type FROM history WHERE commit_seq > 20 AND (doc_id, commit_hash, change_type) NOT IN (SELECT (doc_id, commit_hash, change_type) FROM history WHERE commit_seq <= 22)")
def _(v):
    keys = ["doc_id", "commit_hash", "change_type"]
    return tables.new_rows(v.history.where("commit_seq <= 22"), v.history.where("commit_seq > 20"), keys).select(*keys)


@query("s18_ledger", "prev", "curr", sql="SELECT CAST(count(*) FILTER (p.id IS NULL) AS BIGINT) AS inserted, CAST(count(*) FILTER (p.id IS NOT NULL AND c.id IS NOT NULL AND NOT (p.title = c.title AND p.content = c.content AND p.path = c.path)) AS BIGINT) AS updated, CAST(count(*) FILTER (c.id IS NULL) AS BIGINT) AS deleted, CAST(count(*) FILTER (p.title = c.title AND p.content = c.content AND p.path = c.path) AS BIGINT) AS unchanged FROM prev p FULL JOIN curr c ON p.id = c.id")
def _(v):
    return tables.ledger(tables.reconcile(v.prev, v.curr, ["id"]))
