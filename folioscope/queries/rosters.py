"""Queries over tables in texts: a section for each twenty customers, in turn of delegates, of derecognized ones and of members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rosters
from . import VIEWS, query
from .relations import slug_uid

ADDRESS, CONTRACT = "concat('0x', lpad(CAST(c_custkey AS STRING), 40, '0'))", "concat('0x', lpad(CAST(c_custkey + 1000000 AS STRING), 40, '0'))"
KIND = "CAST(floor(c_custkey / 20) AS BIGINT) % 3"
#: Entities that are there before: every fourth customer, with an address; and slugs of some rows to come.
VIEWS["actors"] = ((), f"""SELECT concat('X', c_custkey) AS id, concat('x-', c_custkey) AS slug, c_name AS name, CASE WHEN c_custkey % 8 = 0 THEN 'ecosystem_actor' ELSE 'agent' END AS entity_type FROM {{customer}} WHERE c_custkey % 4 = 0
UNION ALL SELECT concat('Y', c_custkey), concat(CASE {KIND} WHEN 0 THEN 'del-' WHEN 1 THEN 'gone-' ELSE 'mem-' END, c_custkey), c_name, 'agent' FROM {{customer}} WHERE c_custkey % 7 = 1 """)
VIEWS["owned"] = ((), f"""SELECT concat('X', c_custkey) AS entity_id, {ADDRESS} AS address, CAST(NULL AS STRING) AS role FROM {{customer}} WHERE c_custkey % 4 = 0
UNION ALL SELECT concat('X', c_custkey), {CONTRACT}, 'old' FROM {{customer}} WHERE c_custkey % 12 = 0""")


def table_texts(v):
    """One text for each twenty customers; a line for each, under a header that says what they are."""
    kind, k = F.expr(KIND), F.col("c_custkey").cast("string")
    ea = F.when(F.col("c_custkey") % 5 != 0, F.expr(ADDRESS)).otherwise("")
    line = F.when(kind == 0, F.concat(F.lit("| Del "), k, F.lit(" | "), ea, F.lit(" | "), F.expr(CONTRACT), F.lit(" | [post](https://forum.example/t/"), k, F.lit(") |")))
    line = line.when(kind == 1, F.concat(F.lit("| "), F.when(F.col("c_custkey") % 6 == 0, "-").otherwise(F.concat(F.lit("Gone "), k)), F.lit(" | 2024-01-01 | see https://forum.example/g/"), k, F.lit(" |")))
    line = line.otherwise(F.concat(F.lit("| Mem "), k, F.lit(" | law | 2023 | running | good | "), F.when(F.col("c_custkey") % 3 == 0, "N/A").otherwise(F.expr(ADDRESS)), F.lit(" |")))
    head = F.when(kind == 0, "| Delegate Name | EA Address | Delegation Contract | Forum Post |").when(kind == 1, "| Identity | Date | Reasoning Post |").otherwise("| Name or Alias | Domain Expertise | Start Date | Term Status | Standing | Verified Governance Address |")
    made = v.customer.groupBy(F.floor(F.col("c_custkey") / 20).alias("ord")).agg(F.min(head).alias("head"), F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
    return made.select(F.concat(F.lit("T"), F.col("ord").cast("string")).alias("id"), "ord", F.concat(F.lit("Below.\n"), "head", F.lit("\n|---|---|\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("content"))


def taken_in(v):
    entities = v.actors.select("*", F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("defining_doc_id"), F.lit(None).cast("map<string,string>").alias("meta"))
    return rosters.with_rosters(rosters.roster_rows(table_texts(v)), entities, v.owned)


def new_id(prefix: str) -> str:
    return slug_uid(f"concat('{prefix}', c_custkey)")


DOC = "concat('T', CAST(floor(c_custkey / 20) AS BIGINT))"
#: Texts of three table lines or more are tables; at least one row is left then.
R = f"""r AS (SELECT *, {KIND} AS kind, CASE {KIND} WHEN 0 THEN c_custkey % 5 <> 0 WHEN 1 THEN c_custkey % 6 <> 0 ELSE true END AS named,
 CASE {KIND} WHEN 0 THEN {new_id('del-')} WHEN 1 THEN {new_id('gone-')} ELSE {new_id('mem-')} END AS fresh_id FROM customer),
f AS (SELECT * FROM r WHERE named AND CASE kind WHEN 0 THEN c_custkey % 4 <> 0 ELSE c_custkey % 7 <> 1 END)"""


@query("e14_rosters", "actors", sql=f""", {R} SELECT a.id, a.slug, a.name, CASE WHEN c.c_custkey IS NOT NULL AND a.entity_type = 'ecosystem_actor' THEN 'delegate_org' ELSE a.entity_type END AS entity_type, true AS is_active, NULL AS defining_doc_id,
 CASE WHEN c.c_custkey IS NOT NULL THEN 'forum_url=https://forum.example/t/' || c.c_custkey ELSE '' END AS meta
FROM actors a LEFT JOIN (SELECT * FROM r WHERE kind = 0 AND named AND c_custkey % 4 = 0) c ON a.id = 'X' || c.c_custkey WHERE a.slug NOT IN (SELECT 'del-' || c_custkey FROM f WHERE kind = 0)
UNION ALL SELECT fresh_id, CASE kind WHEN 0 THEN 'del-' WHEN 1 THEN 'gone-' ELSE 'mem-' END || c_custkey, CASE kind WHEN 0 THEN 'Del ' WHEN 1 THEN 'Gone ' ELSE 'Mem ' END || c_custkey, CASE kind WHEN 2 THEN 'src_member' ELSE 'delegate_org' END, kind <> 1, {DOC},
 CASE kind WHEN 0 THEN 'forum_url=https://forum.example/t/' || c_custkey || ',source=active_data_table' WHEN 1 THEN 'derecognition_date=2024-01-01,forum_url=https://forum.example/g/' || c_custkey || ',source=active_data_table' ELSE 'domain_expertise=law,source=active_data_table,standing=good,start_date=2023,term_status=running' END FROM f""")
def _(v):
    pairs = F.array_sort(F.transform(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return taken_in(v)[0].withColumn("meta", F.array_join(pairs, ","))


@query("e14_addresses", "owned", sql=f""", {R}, k AS (SELECT * FROM r WHERE kind = 0 AND named AND c_custkey % 4 = 0)
SELECT entity_id, address, CASE WHEN k.c_custkey IS NOT NULL THEN CASE WHEN address = {ADDRESS.replace('c_custkey', 'k.c_custkey')} THEN 'ea_address' ELSE 'delegation_contract' END ELSE role END AS role FROM owned LEFT JOIN k ON entity_id = 'X' || k.c_custkey
UNION ALL SELECT fresh_id, {ADDRESS}, 'ea_address' FROM f WHERE kind = 0 UNION ALL SELECT fresh_id, {CONTRACT}, 'delegation_contract' FROM f WHERE kind = 0
UNION ALL SELECT fresh_id, {ADDRESS}, 'governance' FROM f WHERE kind = 2 AND c_custkey % 3 <> 0""")
def _(v):
    return taken_in(v)[1]


@query("e14_listings", sql=f"WITH {R} SELECT fresh_id AS entity_id, {DOC} AS doc_id FROM f UNION ALL SELECT 'X' || c_custkey, {DOC} FROM r WHERE kind = 0 AND named AND c_custkey % 4 = 0")
def _(v):
    return taken_in(v)[2]
