"""Requests in all modes, links of participants in two passes, and statistics at all levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, search
from ..plans import reports, requests
from ..session import stored
from . import VIEWS, query
from .searches import PREFIX_INDEX, terms_sql

#: A request for each supplier, in turn: everything of the supplier; its duties; its urgent ones in one region; customers of its nation
#: changed lately; building customers of its nation (some that say "the"); words of a document, quoted; such words at a customer; nothing known.
VIEWS["requests"] = ((), """
SELECT s_suppkey AS request_id,
  CASE WHEN s_suppkey % 8 = 5 THEN concat('"', regexp_extract(text, '[A-Za-z]+', 0), '" ', replace(substring(text, 1, 40), '"', '')) WHEN s_suppkey % 8 = 6 THEN substring(text, 1, 60) END AS q,
  CASE WHEN s_suppkey % 8 < 3 THEN concat(lower(replace(s_name, '#', '-')), '-s', s_suppkey) WHEN s_suppkey % 8 = 3 THEN concat(lower(n_name), '-n', n_nationkey)
    WHEN s_suppkey % 8 = 6 THEN concat(lower(replace(c_name, '#', '-')), '-c', c_custkey) WHEN s_suppkey % 16 = 7 THEN 'nobody' END AS entity,
  CASE WHEN s_suppkey % 8 IN (1, 2) THEN split('responsible_party_for,supplies', ',') END AS edge_types,
  CASE WHEN s_suppkey % 8 = 2 THEN '1-URGENT' WHEN s_suppkey % 8 = 4 THEN 'BUILDING' END AS target_type,
  CASE WHEN s_suppkey % 8 = 3 THEN 'customer' END AS via_entity_type,
  CASE WHEN s_suppkey % 16 = 3 THEN '2024-02-01' END AS since, CASE WHEN s_suppkey % 16 = 3 THEN '100d' END AS until,
  CASE WHEN s_suppkey % 16 = 11 THEN 'modified' END AS change_type, CASE WHEN s_suppkey % 8 = 3 THEN 300 END AS recent_commits,
  CASE WHEN s_suppkey % 16 = 4 THEN 'the' END AS status,
  CASE s_suppkey % 8 WHEN 2 THEN concat('A.', n_regionkey + 1) WHEN 4 THEN concat('N', n_nationkey) WHEN 5 THEN 'A.99.nowhere' END AS ancestor,
  CASE WHEN s_suppkey % 8 = 3 THEN 'in' END AS direction, CASE s_suppkey % 8 WHEN 1 THEN 5 WHEN 4 THEN 90 END AS k
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey LEFT JOIN {documents} ON doc_id = s_suppkey LEFT JOIN {customer} ON c_custkey = s_suppkey""")
VIEWS["changes"] = (("history",), "SELECT replace(doc_id, 'D', 'C') AS doc_id, date, commit_seq, change_type FROM history")

MODES = """modes AS (SELECT r.*, e.id AS entity_id, least(greatest(coalesce(k, 10), 1), 50) AS kk,
 CASE WHEN (r.entity IS NOT NULL AND e.id IS NULL) OR coalesce(r.entity, q, target_type) IS NULL THEN 'error' WHEN e.id IS NOT NULL AND via_entity_type IS NOT NULL THEN 'entity_chain'
  WHEN e.id IS NOT NULL AND edge_types IS NULL AND q IS NULL THEN 'entity_broad' WHEN e.id IS NOT NULL AND q IS NULL THEN 'entity_narrow' WHEN e.id IS NOT NULL THEN 'hybrid_graph' WHEN q IS NOT NULL THEN 'search' ELSE 'type_list' END AS mode
 FROM requests r LEFT JOIN (SELECT slug, min(id) AS id FROM entities GROUP BY slug) e ON e.slug = r.entity)"""
LEGS = PREFIX_INDEX.replace("FROM corpus", "FROM docs").replace(f"item_id AS query_id, unnest({terms_sql('text')}) AS term FROM benchmark", f"request_id AS query_id, unnest({terms_sql('q')}) AS term FROM modes WHERE mode IN ('search', 'hybrid_graph')")
assert "benchmark" not in LEGS
ANSWERED = f""", {MODES}
{LEGS},
unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
near AS (SELECT request_id, 'C' || u.vec_id AS doc_id, round(list_sum(list_transform(range(1, len(u.e) + 1), lambda i: u.e[i] * w.e[i])) / sqrt(list_sum(list_transform(u.e, lambda x: x * x))) / sqrt(list_sum(list_transform(w.e, lambda x: x * x))), 9) AS score
  FROM modes JOIN unit w ON w.vec_id = request_id CROSS JOIN unit u WHERE mode IN ('search', 'hybrid_graph')),
near_best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) <= 200),
legs AS (SELECT request_id, doc_id, 'lexical' AS source, round(score, 9) AS score FROM sc JOIN modes ON request_id = query_id UNION ALL SELECT request_id, doc_id, 'semantic', score FROM near_best),
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY l.request_id, source ORDER BY l.score DESC, doc_id) AS n, kk FROM legs l JOIN modes m ON m.request_id = l.request_id JOIN docs d ON d.id = l.doc_id WHERE m.target_type IS NULL OR m.target_type = d.type),
fused AS (SELECT request_id, doc_id AS id, sum(1.0 / (60 + n)) AS score FROM ranked WHERE n <= least(kk * 4, 200) GROUP BY ALL),
said AS (SELECT f.* FROM fused f JOIN modes m USING (request_id) JOIN docs d USING (id) WHERE m.mode = 'hybrid_graph' OR regexp_matches(d.title, '(?i)(?:^|[^A-Za-z0-9_])' || regexp_extract(q, '"([^"]+)"', 1) || '(?:[^A-Za-z0-9_]|$)') OR regexp_matches(d.content, '(?i)(?:^|[^A-Za-z0-9_])' || regexp_extract(q, '"([^"]+)"', 1) || '(?:[^A-Za-z0-9_]|$)')),
ends AS (SELECT from_id AS eid, 'out' AS way, edge_type, to_type AS ot, to_id AS oid FROM edges WHERE from_type = 'entity' UNION ALL SELECT to_id, 'in', edge_type, from_type, from_id FROM edges WHERE to_type = 'entity'),
linked AS (SELECT DISTINCT request_id, mode, CASE WHEN mode = 'entity_broad' THEN edge_type END AS relation, oid AS id FROM modes JOIN ends ON eid = entity_id AND ot = 'doc' JOIN docs d ON d.id = oid
  WHERE mode IN ('entity_broad', 'entity_narrow', 'hybrid_graph') AND coalesce(direction, way) = way AND (edge_types IS NULL OR list_contains(edge_types, edge_type)) AND (target_type IS NULL OR target_type = d.type)),
chained AS (SELECT DISTINCT request_id, mode, NULL AS relation, b.oid AS id FROM modes JOIN ends a ON a.eid = entity_id AND a.ot = 'entity' JOIN entities e ON e.id = a.oid AND e.entity_type = via_entity_type JOIN ends b ON b.eid = a.oid AND b.ot = 'doc' JOIN docs d ON d.id = b.oid
  WHERE mode = 'entity_chain' AND coalesce(direction, a.way) = a.way AND coalesce(direction, b.way) = b.way),
found AS (SELECT request_id, mode, relation, id, NULL AS score FROM linked WHERE mode <> 'hybrid_graph' UNION ALL SELECT *, NULL FROM chained
  UNION ALL SELECT request_id, mode, NULL, d.id, NULL FROM modes JOIN docs d ON d.type = target_type WHERE mode = 'type_list'
  UNION ALL SELECT request_id, mode, NULL, s.id, s.score FROM said s JOIN modes m USING (request_id) WHERE mode = 'search' OR (request_id, s.id) IN (SELECT request_id, id FROM linked)),
newest AS (SELECT max(commit_seq) AS newest FROM changes),
changed AS (SELECT DISTINCT f.request_id, f.id FROM found f JOIN modes m USING (request_id) JOIN changes c ON c.doc_id = f.id, newest WHERE (since IS NULL OR date >= CAST(since AS DATE)) AND (until IS NULL OR date <= DATE '2024-06-30' - 100) AND (m.change_type IS NULL OR c.change_type = m.change_type) AND (recent_commits IS NULL OR commit_seq >= newest - recent_commits)),
kept AS (SELECT f.*, d.ord, m.kk FROM found f JOIN modes m USING (request_id) JOIN docs d ON d.id = f.id
  WHERE (coalesce(since, until, change_type) IS NULL AND recent_commits IS NULL OR (f.request_id, f.id) IN (SELECT request_id, id FROM changed))
  AND (status IS NULL OR regexp_matches(d.title || chr(10) || d.content, '(?i)(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)'))
  AND (ancestor IS NULL OR ancestor = 'A.99.nowhere' OR d.doc_no = ancestor OR starts_with(d.doc_no, ancestor || '.') OR d.id = ancestor OR d.parent_id = ancestor OR d.parent_id IN (SELECT id FROM docs p WHERE p.parent_id = ancestor))),
answered AS (SELECT m.request_id, m.mode, relation, CAST(n - 1 AS INT) AS rank, id, score FROM modes m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY request_id, relation ORDER BY round(score, 12) DESC NULLS LAST, CASE WHEN score IS NULL THEN ord END, id) AS n FROM kept) x ON x.request_id = m.request_id AND (n <= x.kk OR x.mode = 'entity_broad'))
"""
NEEDS = ("docs", "entities", "edges", "changes", "requests")


def answered(v):
    # the views stand for tables that a corpus has; as such they are written once for all legs
    tables = v.kept("requests", "docs", "entities", "edges", "changes")
    asked = tables["requests"].where("q IS NOT NULL").select(F.col("request_id").alias("query_id"))
    q = v.embeddings.join(asked, F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("q_vector"))
    vectors = v.embeddings.select(F.concat(F.lit("C"), "vec_id").alias("doc_id"), "embedding")
    near = search.semantic(vectors, q, 200).select(F.col("query_id").alias("request_id"), "doc_id", "score")
    return tables, requests.answer(*tables.values(), near)


@query("r16_requests", *NEEDS, sql=ANSWERED + "SELECT request_id, mode, relation, rank, id, round(score, 9) AS score FROM answered")
def _(v):
    return answered(v)[1].withColumn("score", F.round("score", 9))


@query("r17_answers", *NEEDS, sql=ANSWERED + r"""SELECT a.request_id, rank, a.id, d.doc_no, d.title, d.parent_id, md5(d.content) AS content,
 CASE WHEN a.id IS NULL THEN NULL WHEN p.id IS NULL THEN '' WHEN g.id IS NULL THEN p.doc_no WHEN r.id IS NULL THEN concat_ws('>', g.doc_no, p.doc_no) ELSE concat_ws('>', r.doc_no, g.doc_no, p.doc_no) END AS ancestors,
 CASE WHEN q IS NOT NULL AND a.id IS NOT NULL THEN len(CASE WHEN s > 0 THEN '…' ELSE '' END || substr(d.content, s + 1, 160) || CASE WHEN len(d.content) > s + 160 THEN '…' ELSE '' END) END AS snippet_chars, CASE WHEN a.id IS NOT NULL THEN (SELECT count(*) FROM docs c WHERE c.parent_id = a.id) END AS n_params
FROM (SELECT a.*, q, CASE WHEN instr(lower(d.content), lower(regexp_extract(q, '[A-Za-z0-9]+', 0))) > 0 THEN greatest(instr(lower(d.content), lower(regexp_extract(q, '[A-Za-z0-9]+', 0))) - 61, 0) ELSE 0 END AS s FROM answered a JOIN requests USING (request_id) LEFT JOIN docs d ON d.id = a.id) a
LEFT JOIN docs d ON d.id = a.id LEFT JOIN docs p ON p.id = d.parent_id LEFT JOIN docs g ON g.id = p.parent_id LEFT JOIN docs r ON r.id = g.parent_id""")
def _(v):
    tables, answers = answered(v)
    rows = requests.enriched(answers, tables["requests"].withColumn("include_params", F.lit(True)), tables["docs"])
    path = F.array_join(F.transform("ancestors", lambda a: a["doc_no"]), ">")
    return rows.select("request_id", "rank", "id", "doc_no", "title", "parent_id", F.md5("content").alias("content"), path.alias("ancestors"), F.length("snippet").cast("long").alias("snippet_chars"), F.size("params").cast("long").alias("n_params"))


VIEWS["parties"] = (("entities",), """SELECT id, slug, defining_doc_id, CASE entity_type WHEN 'region' THEN 'agent' WHEN 'nation' THEN 'composite_party'
WHEN 'customer' THEN CASE subtype WHEN 'BUILDING' THEN 'foundation' WHEN 'MACHINERY' THEN 'development_company' ELSE 'person' END WHEN 'supplier' THEN 'facilitator_org' ELSE entity_type END AS entity_type FROM entities """)
#: Nations comprise their region (two of three) and their customers.
VIEWS["comprised"] = ((), """SELECT concat('N', n_nationkey) AS from_id, concat('R', n_regionkey) AS to_id, 'entity' AS from_type, 'entity' AS to_type, 'comprises' AS edge_type FROM {nation} WHERE n_nationkey % 3 <> 0
UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey), 'entity', 'entity', 'comprises' FROM {customer}""")


@query("g14_links", "parties", sql="""SELECT p.id, CASE WHEN p.entity_type IN ('agent', 'facilitator_org') OR r.id IS NOT NULL THEN 'actor' ELSE 'doc' END AS kind,
CASE WHEN p.entity_type IN ('agent', 'facilitator_org') THEN p.slug ELSE coalesce(r.slug, p.defining_doc_id) END AS target,
CASE WHEN p.entity_type IN ('agent', 'facilitator_org') THEN 'own' WHEN r.id IS NULL THEN 'document' WHEN p.entity_type = 'composite_party' THEN 'agent' ELSE 'party' END AS resolved_by
FROM parties p LEFT JOIN customer ON p.id = concat('C', c_custkey) LEFT JOIN nation ON p.id = concat('N', n_nationkey) OR (n_nationkey = c_nationkey AND p.entity_type IN ('foundation', 'development_company'))
LEFT JOIN parties r ON r.id = concat('R', n_regionkey) AND n_nationkey % 3 <> 0 WHERE p.entity_type IN ('agent', 'facilitator_org') OR r.id IS NOT NULL OR p.defining_doc_id IS NOT NULL""")
def _(v):
    return graph.participant_links(v.parties, v.comprised)


#: Orders are instances of their priority (an urgent one an invocation) in their customer's segment and nation; two segments and one that nobody has are given.
VIEWS["instances"] = ((), """SELECT c_nationkey AS agent_id, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS category, o_orderpriority AS primitive, concat('Order ', o_orderkey) AS name,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'invocation' WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'P' THEN 'Suspended' WHEN o_orderkey % 50 = 1 THEN 'Lost' ELSE 'Completed' END AS status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""")


@query("a9_statistics", "instances", sql="""
, f AS (SELECT agent_id, coalesce(category, 'Unknown') AS category, primitive, status, name FROM instances WHERE status <> 'Lost' AND agent_id <> 3),
st AS (SELECT unnest(['Active', 'Suspended', 'Completed', 'invocation']) AS status), ag AS (SELECT n_nationkey AS agent_id FROM nation WHERE n_nationkey <> 3),
r AS (SELECT agent_id, category, primitive, status, 1 AS one FROM f UNION ALL SELECT agent_id, 'BUILDING', 'Seeded', status, 0 FROM ag, st UNION ALL SELECT agent_id, c, NULL, status, 0 FROM ag, st, (SELECT unnest(['BUILDING', 'MACHINERY', 'EMPTY']) AS c) x),
n AS (SELECT agent_id, category, primitive, status, list(name ORDER BY name)[1:3] AS names FROM f GROUP BY ALL),
g AS (SELECT agent_id, category, primitive, status, CAST(sum(one) AS BIGINT) AS n, CASE grouping(agent_id, category, primitive) WHEN 0 THEN 'primitive' WHEN 1 THEN 'category' WHEN 3 THEN 'agent' WHEN 5 THEN 'all categories' ELSE 'all' END AS level
  FROM r GROUP BY GROUPING SETS ((agent_id, category, primitive, status), (agent_id, category, status), (agent_id, status), (category, status), (status)))
SELECT g.*, CASE WHEN level = 'primitive' THEN coalesce(array_to_string(names, ','), '') ELSE '' END AS names FROM g LEFT JOIN n ON n.agent_id = g.agent_id AND n.category = g.category AND n.primitive = g.primitive AND n.status = g.status WHERE level <> 'primitive' OR g.primitive IS NOT NULL""")
def _(v):
    agents = v.nation.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("agent_id"))
    seeds = agents.select("agent_id", F.lit("BUILDING").alias("category"), F.lit("Seeded").alias("primitive"))
    rows = reports.status_statistics(agents, seeds, v.instances, ["BUILDING", "MACHINERY", "EMPTY"], most_names=3)
    return rows.withColumn("names", F.array_join("names", ","))


#: Searches with the beginning of every fiftieth document: by words, by its vector, by both; some quote a word, some ask for its language alone.
VIEWS["searches"] = ((), """SELECT doc_id AS request_id, concat(CASE WHEN doc_id % 100 = 0 THEN concat('"', regexp_extract(text, '[A-Za-z]+', 0), '" ') ELSE '' END, replace(substring(text, 1, 50), '"', '')) AS q,
CASE WHEN doc_id % 200 = 0 THEN lang END AS target_type, CASE doc_id % 150 WHEN 0 THEN 'lexical' WHEN 50 THEN 'semantic' END AS leg, 10 AS k FROM {documents} WHERE doc_id % 50 = 0 AND text IS NOT NULL""")
SEARCHED = ", " + PREFIX_INDEX.removeprefix(", ").replace(f"item_id AS query_id, unnest({terms_sql('text')}) AS term FROM benchmark", f"request_id AS query_id, unnest({terms_sql('q')}) AS term FROM searches WHERE leg IS NULL OR leg = 'lexical'") + """,
unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
near AS (SELECT request_id, 'D' || u.vec_id AS doc_id, round(list_sum(list_transform(range(1, len(u.e) + 1), lambda i: u.e[i] * w.e[i])) / sqrt(list_sum(list_transform(u.e, lambda x: x * x))) / sqrt(list_sum(list_transform(w.e, lambda x: x * x))), 9) AS score
  FROM searches JOIN unit w ON w.vec_id = request_id CROSS JOIN unit u WHERE leg IS NULL OR leg = 'semantic'),
near_best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) <= 200),
legs AS (SELECT query_id AS request_id, doc_id, 'lexical' AS source, round(score, 9) AS score FROM sc UNION ALL SELECT request_id, doc_id, 'semantic', score FROM near_best),
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY l.request_id, source ORDER BY l.score DESC, doc_id) AS n FROM legs l JOIN searches m ON m.request_id = l.request_id JOIN corpus d ON d.id = l.doc_id WHERE m.target_type IS NULL OR m.target_type = d.type),
fused AS (SELECT request_id, doc_id AS id, round(sum(1.0 / (60 + n)), 12) AS score FROM ranked WHERE n <= 40 GROUP BY ALL),
said AS (SELECT f.* FROM fused f JOIN searches m USING (request_id) JOIN corpus d USING (id) WHERE NOT starts_with(q, '"') OR regexp_matches(d.title || chr(10) || d.content, '(?i)(?:^|[^A-Za-z0-9_])' || regexp_extract(q, '"([^"]+)"', 1) || '(?:[^A-Za-z0-9_]|$)'))
"""


@query("r14_modes", "corpus", "searches", sql=SEARCHED + "SELECT request_id, id, round(score, 9) AS score, CAST(n - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS n FROM said) WHERE n <= 10")
def _(v):
    asked, docs = stored(v.searches, "searches"), stored(v.corpus, "corpus")
    q = v.embeddings.join(asked.where("leg IS NULL OR leg = 'semantic'"), F.col("vec_id") == F.col("request_id")).select(F.col("request_id").alias("query_id"), F.col("embedding").alias("q_vector"))
    near = search.semantic(v.vectors, q, 200).select(F.col("query_id").alias("request_id"), "doc_id", "score")
    hits = requests.searched(asked, docs, near).select(F.col("request_id").alias("query_id"), F.col("id").alias("doc_id"), "score")
    return search.top(hits, 10).select(F.col("query_id").alias("request_id"), F.col("doc_id").alias("id"), F.round("score", 9).alias("score"), "rank")
