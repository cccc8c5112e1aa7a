"""Queries over chains of responsibility, reports on them, and addresses of instances' parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as entity_rules
from ..operators import attribution, extraction, parameters, relations
from ..plans import chains
from ..session import stored
from . import query
from .relations import A, ADC, FAC, GOV, I, LABELLED, P, SUPPLY, X, all_entities, contract, slug_uid, uid

PARAM = "concat('A.6.1.1.', s_nationkey + 1, '.2.1.', s_suppkey % 2 + 1, '.', s_suppkey % 3 + 2, '.', s_suppkey + 1, '.1.1')"
#: Agents with the first of the sections that name their executor.
CHAINS = f"""c AS (SELECT n_nationkey, any_value(r_regionkey) AS r_regionkey, any_value(r_name) AS r_name, arg_min({PARAM}, (s_suppkey % 2, s_suppkey % 3, s_suppkey)) AS executor_source FROM {SUPPLY} GROUP BY n_nationkey)"""
EXECUTOR_NAME = "CASE WHEN r_regionkey = 4 THEN 'Core Council Executor Agent 5' ELSE r_name END"


def graph(v):
    """Entities and all edges among them and sections."""
    entities = all_entities(v)
    edges = stored(relations.entity_relations(v.sections, entities), "entity-edges")
    return entities, edges, stored(edges.unionByName(relations.responsible_parties(v.sections, entities, edges)), "all-edges")


@query("t1_chains", sql=f"""WITH {CHAINS} SELECT {uid(P.replace('n_nationkey', 'n.n_nationkey'))} AS agent_id, n_name AS agent, CASE WHEN c.r_regionkey IS NOT NULL THEN {uid(X)} END AS executor_id, {EXECUTOR_NAME.replace('ELSE r_name', 'ELSE r_name')} AS executor, executor_source,
CASE WHEN r_regionkey IS NOT NULL THEN {FAC} END AS facilitator_id, 'Fac ' || r_name AS facilitator, 'A.6.1.2.' || (r_regionkey + 1) || '.1' AS facilitator_source, CASE WHEN r_regionkey IS NOT NULL THEN {GOV} END AS govops_id, 'Gov ' || r_name AS govops, 'A.6.1.2.' || (r_regionkey + 1) || '.2' AS govops_source
FROM nation n LEFT JOIN c ON c.n_nationkey = n.n_nationkey""")
def _(v):
    entities, edges, _ = graph(v)
    return chains.responsibility_chains(entities, edges)


@query("t2_active_data_index", sql=f"""WITH {CHAINS} SELECT {uid("concat('D', s_suppkey)")} AS id, {ADC} || '.0.6.1' AS doc_no, 'Controller ' || s_suppkey AS controller, n_name AS agent,
CASE WHEN s_suppkey % 5 = 0 AND r.r_regionkey < 4 THEN 'Gov ' || r.r_name WHEN s_suppkey % 5 = 1 AND r.r_regionkey < 4 THEN 'Fac ' || r.r_name WHEN s_suppkey % 5 = 2 THEN 'Vendor ' || s_suppkey WHEN s_suppkey % 5 = 3 THEN 'Holder ' || o.r_name WHEN s_suppkey % 5 = 4 THEN 'Gov MIDDLE EAST' END AS party,
CASE s_suppkey % 5 WHEN 2 THEN 'direct' WHEN 3 THEN 'role' WHEN 4 THEN 'chain' ELSE CASE WHEN r.r_regionkey < 4 THEN 'chain' END END AS resolution, 'Fac ' || r.r_name AS facilitator,
concat_ws(' → ', {ADC}, CASE WHEN s_suppkey % 5 = 4 OR (s_suppkey % 5 < 2 AND r.r_regionkey < 4) THEN executor_source END,
  CASE WHEN s_suppkey % 5 = 1 AND r.r_regionkey < 4 THEN 'A.6.1.2.' || (r.r_regionkey + 1) || '.1' WHEN (s_suppkey % 5 = 0 AND r.r_regionkey < 4) OR (s_suppkey % 5 = 4 AND r.r_regionkey = 4) THEN 'A.6.1.2.' || (r.r_regionkey + 1) || '.2' END) AS evidence
FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN region o ON o.r_regionkey = s_suppkey % 4 JOIN c ON c.n_nationkey = n.n_nationkey
UNION ALL SELECT {uid("'E'")}, 'A.1.8.1.2.2.0.6.1', NULL, 'Governance', NULL, NULL, NULL, 'A.1.8.1.2.2' UNION ALL SELECT {uid("'O'")}, 'A.1.5.1.5.0.6.1', NULL, 'Governance', NULL, NULL, NULL, 'A.1.5.1.5'""")
def _(v):
    entities, edges, every = graph(v)
    return chains.active_data_index(v.sections, entities, every, stored(chains.responsibility_chains(entities, edges), "chains"))


@query("t10_advice", sql=f"""SELECT {uid(A)} AS id, 'no responsible party' AS advice FROM {SUPPLY} WHERE s_suppkey % 5 < 2 AND r_regionkey = 4 UNION ALL SELECT {uid(P)}, a FROM nation, (SELECT unnest(['no executor', 'no instance']) AS a) x WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT {slug_uid("x.slug")}, 'held by governance' FROM (SELECT unnest(['bo', 'cy', 'dee', 'eve-1', 'eve-2']) AS slug) x""")
def _(v):
    entities, _, every = graph(v)
    return chains.recommendations(v.sections, entities, every)


@query("t6_step_audit", "corpus", sql=r"""SELECT id, CASE WHEN h >= 1 THEN h WHEN n >= 2 THEN n WHEN p >= 2 THEN p WHEN b >= 3 THEN b END AS steps, CASE WHEN h >= 1 THEN 'step-headings' WHEN n >= 2 THEN 'numbered-list' WHEN p >= 2 THEN 'parenthesized' WHEN b >= 3 THEN 'bullets' ELSE 'none' END AS source FROM (
SELECT id, CAST(len(list_distinct(regexp_extract_all(content, '(?im)^#+[ \t]*(?:Step|Stage|Phase)[ \t]+([0-9]+)', 1))) AS BIGINT) AS h, CAST(len(regexp_extract_all(content, '(?m)^[0-9]+\.[ \t]')) AS BIGINT) AS n, CAST(len(regexp_extract_all(content, '(?m)^[-*][ \t]')) AS BIGINT) AS b,
CAST(coalesce(list_position(list_transform(m, lambda x, i: x = CAST(i AS VARCHAR)), false) - 1, len(m)) AS BIGINT) AS p FROM (SELECT id, coalesce(content, '') AS content, regexp_extract_all(coalesce(content, ''), '\(([0-9]+)\)', 1) AS m FROM corpus) y) z""")
def _(v):
    return chains.step_audit(v.corpus.select("id", "doc_no", "content", F.lit(None).cast("int").alias("override")), v.docs.where("false"))


@query("t6_step_children", "docs", sql=r"SELECT d.id, CAST(c.n AS BIGINT) AS steps, CASE WHEN c.n IS NULL THEN 'none' ELSE 'children' END AS source FROM docs d LEFT JOIN (SELECT regexp_replace(doc_no, '\.[^.]+$', '') AS up, count(*) AS n FROM docs WHERE contains(doc_no, '.') AND NOT regexp_matches(doc_no, '\.0\.[346]\.[0-9]+$') GROUP BY 1) c ON c.up = d.doc_no WHERE d.type = 'Nation' OR d.type = 'Region'")
def _(v):
    return chains.step_audit(v.docs.where("type IN ('Nation', 'Region')").select("id", "doc_no", "content", F.lit(None).cast("int").alias("override")), v.docs)


def instance_values(v):
    return stored(entity_rules.instance_params(v.sections, relations.instances(v.sections).select("id", "doc_no")), "params")


@query("n13_param_addresses", sql=f"SELECT {uid(I)} AS id, {contract(I)} AS address, 'token' AS role, 'base' AS chain, s_name AS label FROM supplier UNION ALL SELECT {uid(I)}, {contract(A)}, 'token', 'ethereum', s_name FROM supplier")
def _(v):
    names = relations.instances(v.sections).select("id", F.regexp_replace("title", " Instance Configuration Document$", "").alias("name"), F.lit(None).cast("string").alias("agent"))
    return parameters.param_addresses(instance_values(v), names).select("id", "address", "role", "chain", "label")


def mentions(v):
    found = extraction.addresses(v.sections).select(F.col("id").alias("doc_id"), "address", extraction.chain_of(F.col("before")).alias("chain"))
    return found.distinct()


REGISTRY = f"SELECT concat('NAME_', s_suppkey) AS name, {contract(I)} AS address FROM supplier WHERE s_suppkey % 3 = 0"


def registry(v):
    return v.spark.sql(REGISTRY.replace("FROM supplier", "FROM {s}"), s=v.supplier)


@query("a16_address_counts", sql="SELECT 'base' AS chain, CAST(count(*) AS BIGINT) AS addresses, CAST(count(*) FILTER (s_suppkey % 3 = 0) AS BIGINT) AS in_registry, CAST(count(*) FILTER (s_suppkey % 2 = 0) AS BIGINT) AS proxies, CAST(count(*) FILTER (s_suppkey % 4 <> 0) AS BIGINT) AS unlabelled FROM supplier")
def _(v):
    rows = v.known.withColumn("label", F.when(F.col("role") == "delegate", F.col("label")))
    return parameters.address_counts(rows, registry(v), v.contracts)


@query("r6_registry_lookup", sql=f"SELECT concat('name_', s_suppkey) AS query, {contract(I)} AS address, {uid(chr(99) + 'oncat(' + chr(39) + 'Q' + chr(39) + ', s_suppkey)')} AS doc_id, 2 AS score FROM supplier WHERE s_suppkey % 3 = 0")
def _(v):
    asked = v.supplier.select(F.concat(F.lit("name_"), F.col("s_suppkey").cast("string")).alias("query"))
    return parameters.registry_lookup(asked, registry(v), mentions(v))


@query("r19_address_lookup", sql=f"SELECT {contract(I)} AS address, 'base' AS chain, s_name AS label, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS entity, CAST(1 AS BIGINT) AS docs FROM supplier UNION ALL SELECT {contract(A)}, NULL, NULL, NULL, 0 FROM supplier")
def _(v):
    asked = v.known.select("address").unionByName(mentions(v).where("chain <> 'base'").select("address"))
    seen = mentions(v)
    return parameters.address_lookup(asked, v.known, all_entities(v), seen)


@query("x30_explorer_urls", sql=f"SELECT {contract(I)} AS address, concat('https://basescan.org/address/', {contract(I)}) AS url FROM supplier")
def _(v):
    return v.known.select("address", parameters.explorer_url(F.col("address"), F.col("chain")).alias("url"))


@query("f12_plausible_labels", sql="SELECT r_regionkey AS k, array_to_string(CASE WHEN r_regionkey % 2 = 0 THEN [r_name] ELSE ['contract', '12.5'] END, '|') AS labels FROM region")
def _(v):
    given = F.array(F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise("contract"), F.lit("12.5"))
    return v.region.select(F.col("r_regionkey").alias("k"), F.array_join(parameters.plausible_labels(given), "|").alias("labels"))


#: Regions are change sets: nations and customers changed, and nations are bullets, of which even ones name their section's number and odd ones their first customer; odd nations share a word with the first of them.
MATCHED = """m AS (SELECT n_regionkey AS set_id, concat('N', n_nationkey) AS id, n_nationkey AS bullet, 100 AS score, 'ref' AS via FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_regionkey, concat('C', min(c_custkey)), n_nationkey, 100, 'fuzzy' FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 1 GROUP BY n_regionkey, n_nationkey
UNION ALL SELECT n_regionkey, concat('N', n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey), 100, 'fuzzy' FROM nation WHERE n_nationkey % 2 = 1)"""


def change_sets(v):
    first = v.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min_by("c_name", "c_custkey").alias("first"))
    number = F.concat(F.lit("see A."), (F.col("n_regionkey") + 1).cast("string"), F.lit("."), (F.col("n_nationkey") + 1).cast("string"))
    said = v.nation.join(first, "n_nationkey", "left").withColumn("description", F.when(F.col("n_nationkey") % 2 == 0, number).otherwise(F.col("first")))
    bullets = said.select(F.col("n_regionkey").alias("set_id"), F.col("n_nationkey").alias("bullet"), F.concat(F.lit("About "), "n_name").alias("title"), "description")
    docs = v.docs.select("id", "doc_no", "title", "depth", "type")
    nodes = docs.where("depth = 2 OR (depth = 3 AND type <> 'Active Data')").select((F.element_at(F.split("doc_no", r"\."), 2).cast("int") - 1).alias("set_id"), "id", "doc_no", "title")
    return bullets, nodes, attribution.attributed(bullets, nodes, docs)


@query("h9_attribution", sql=f"WITH {MATCHED} SELECT * FROM m")
def _(v):
    return change_sets(v)[2]


@query("a11_match_rates", sql=f"WITH {MATCHED} SELECT r_regionkey AS set_id, CAST(n.k + coalesce(c.k, 0) AS BIGINT) AS changed, CAST(coalesce(h.k, 0) AS BIGINT) AS matched, coalesce(h.k, 0) / (n.k + coalesce(c.k, 0)) AS rate FROM region JOIN (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY 1) n ON n.n_regionkey = r_regionkey LEFT JOIN (SELECT n_regionkey, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) c ON c.n_regionkey = r_regionkey LEFT JOIN (SELECT set_id, count(*) AS k FROM m GROUP BY 1) h ON h.set_id = r_regionkey")
def _(v):
    _, nodes, matches = change_sets(v)
    return attribution.match_rates(nodes, matches)


@query("h3_relabelled", "history", sql="SELECT event_id, CASE WHEN commit_seq % 5 = 0 AND change_type = 'added' THEN 'moved' ELSE change_type END AS change_type FROM history")
def _(v):
    commits = v.history.select("commit_hash", F.when(F.col("commit_seq") % 5 == 0, "Migrate it to Markdown File").otherwise("Migrate").alias("message")).distinct()
    return attribution.relabelled(v.history, commits).select("event_id", "change_type")


@query("h12_summaries", sql=f"WITH {MATCHED} SELECT set_id, id, concat('About ', n_name) AS summary FROM m JOIN nation ON n_nationkey = bullet")
def _(v):
    bullets, nodes, matches = change_sets(v)
    sets = v.region.select(F.col("r_regionkey").alias("set_id"), F.col("r_name").alias("title"), F.lit("A body of some length").alias("body"))
    return attribution.summaries(nodes, matches, bullets, sets).where("summary IS NOT NULL").select("set_id", "id", "summary")
