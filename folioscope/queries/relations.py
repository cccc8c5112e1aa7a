"""Queries over entities and typed relations of a corpus of numbered sections.

The corpus is plain SQL over the given tables: nations are agents with primitives, regions
executors with their offices, suppliers instances with parameters and controllers of
active data, customers recipients of grants.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import entities as entity_rules
from ..operators import extraction, relations
from ..session import stored
from . import VIEWS, query


def uid(key: str) -> str:
    """SQL for the id of a section or the slug's entity, in the shape of a UUID, from a key."""
    return "concat(" + ", '-', ".join(f"substring(md5({key}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def slug_uid(slug: str) -> str:
    """SQL for the id that a slug gives, where {sha} is the engine's SHA-256."""
    h = f"sha256({slug})"
    return f"concat(substring({h}, 1, 8), '-', substring({h}, 9, 4), '-4', substring({h}, 14, 3), '-', substring({h}, 17, 4), '-', substring({h}, 21, 12))"


def contract(key: str) -> str:
    return f"concat('0x', md5({key}), substring(md5(concat({key}, 'x')), 1, 8))"


AGENT, ROOT = "concat('A.6.1.1.', n_nationkey + 1)", "concat('A.6.1.1.', n_nationkey + 1, '.2.1.', j)"
P, X, R = "concat('P', n_nationkey)", "concat('X', r_regionkey)", "concat('R', n_nationkey, '-', j)"
I, A = "concat('I', s_suppkey)", "concat('A', s_suppkey)"
ICD = "concat('A.6.1.1.', s_nationkey + 1, '.2.1.', s_suppkey % 2 + 1, '.', s_suppkey % 3 + 2, '.', s_suppkey + 1)"
ADC = "concat('A.6.1.1.', s_nationkey + 1, '.3.', s_suppkey + 1)"
EXECUTOR = "CASE WHEN r_regionkey = 4 THEN concat('Core Council Executor Agent ', r_regionkey + 1) ELSE concat('Operational Executor Agent ', r_name) END"
TWO, THREE = "(SELECT 1 AS j UNION ALL SELECT 2) two", "(SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) three"
PARTY = """CASE s_suppkey % 5 WHEN 0 THEN 'The Responsible Party is Operational GovOps.' WHEN 1 THEN 'Responsible Party: Operational Facilitator' WHEN 2 THEN concat('The Responsible Party is the Vendor ', s_suppkey, '.')
WHEN 3 THEN concat('The Responsible Party is the Risk Advisor ', s_suppkey % 4 + 1, '.') ELSE 'Responsible Party: Core GovOps.' END"""
SUPPLIED = "{supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"

#: key, number, title, type, parent's key, content, order, rows
SECTIONS = (
    (P, AGENT, "n_name", "'Core'", "NULL", "''", "n_nationkey", "{nation}"),
    (X, "concat('A.6.1.2.', r_regionkey + 1)", EXECUTOR, "'Core'", "NULL", "''", "1000 + r_regionkey", "{region}"),
    ("concat('F', r_regionkey)", "concat('A.6.1.2.', r_regionkey + 1, '.1')", "CASE WHEN r_regionkey = 4 THEN 'Core Executor Facilitator' ELSE 'Facilitator' END", "'Core'", X, "concat('The Operational Facilitator for ', r_name, ' is the Fac ', r_name, '.')", "2000 + r_regionkey", "{region}"),
    ("concat('G', r_regionkey)", "concat('A.6.1.2.', r_regionkey + 1, '.2')", "CASE WHEN r_regionkey = 4 THEN 'Core GovOps' ELSE 'GovOps' END", "'Core'", X, "concat('Operational GovOps for ', r_name, ' is Gov ', r_name, '.')", "3000 + r_regionkey", "{region}"),
    ("concat('B', j)", "concat('A.2.2.', j)", "concat('Primitive ', j)", "'Core'", "NULL", "''", "4000 + j", TWO),
    (R, ROOT, "concat(CASE j WHEN 1 THEN 'Growth' ELSE 'Reward' END, ' Primitive')", "'Core'", P, f"concat('Read it. See [this](', {uid(chr(99) + 'oncat(' + chr(39) + 'B' + chr(39) + ', j)')}, ') and more.')", "5000 + n_nationkey * 10 + j", "{nation} CROSS JOIN " + TWO),
    ("concat('V', n_nationkey, '-', j)", f"concat({ROOT}, '.1.1')", "'Global Activation Status'", "'Core'", R, "concat('It is `', CASE (n_nationkey + j) % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'inactive' ELSE 'Completed' END, '`.')", "6000 + n_nationkey * 10 + j", "{nation} CROSS JOIN " + TWO),
    ("concat('T', n_nationkey, '-', j, '-', k)", f"concat({ROOT}, '.', k + 1)", "CASE k WHEN 1 THEN 'Active Instances Directory' WHEN 2 THEN 'In Progress Invocations' ELSE 'Completed Instances' END", "'Core'", R, "''", "7000 + n_nationkey * 100 + j * 10 + k", "{nation} CROSS JOIN " + TWO + " CROSS JOIN " + THREE),
    (I, ICD, "concat(s_name, ' Instance Configuration Document')", "'Core'", "concat('T', s_nationkey, '-', s_suppkey % 2 + 1, '-', s_suppkey % 3 + 1)", "''", "1000000000 + s_suppkey", "{supplier}"),
    ("concat('M', s_suppkey)", f"concat({ICD}, '.1')", "'Parameters'", "'Core'", I, "''", "2000000000 + s_suppkey", "{supplier}"),
    ("concat('N', s_suppkey)", f"concat({ICD}, '.1.1')", "CASE WHEN r_regionkey = 4 THEN 'Core Council Executor Agent' ELSE 'Operational Executor Agent' END", "'Core'", "concat('M', s_suppkey)", f"concat('It is [him](', {uid(X)}, ').')", "3000000000 + s_suppkey", SUPPLIED),
    ("concat('Q', s_suppkey)", f"concat({ICD}, '.1.2')", "'Token Address'", "'Core'", "concat('M', s_suppkey)", f"concat('The address of T on the Base blockchain is `', {contract(I)}, '`. The address of T on Ethereum is `', {contract(A)}, '`.')", "4000000000 + s_suppkey", "{supplier}"),
    ("concat('K', s_suppkey)", f"concat({ICD}, '.1.3')", "'Name'", "'Core'", "concat('M', s_suppkey)", "concat('The name of the instance is ', s_name, '.')", "5000000000 + s_suppkey", "{supplier}"),
    ("concat('L', s_suppkey)", f"concat({ICD}, '.1.4')", "'Inflow Rate Limits'", "'Core'", "concat('M', s_suppkey)", "concat('They are:', chr(10), '- `maxAmount`: ', s_suppkey, chr(10), '- `slope`: 7')", "6000000000 + s_suppkey", "{supplier}"),
    ("concat('Z', s_suppkey)", "concat('A.6.1.1.', s_nationkey + 1, '.4.', s_suppkey + 1)", "'Instance Configuration Document Location'", "'Core'", "concat('P', s_nationkey)", f"concat('[other](', {uid(chr(39) + 'B1' + chr(39))}, ') [here](', {uid(I)}, ')')", "7000000000 + s_suppkey", "{supplier}"),
    (A, ADC, "concat('Controller ', s_suppkey)", "'Active Data Controller'", "concat('P', s_nationkey)", PARTY, "8000000000 + s_suppkey", "{supplier}"),
    ("concat('D', s_suppkey)", f"concat({ADC}, '.0.6.1')", "concat('Data ', s_suppkey)", "'Active Data'", A, "''", "9000000000 + s_suppkey", "{supplier}"),
    ("concat('Y', r_regionkey)", "concat('A.1.7.1.', r_regionkey + 1)", "concat('Risk Advisor ', r_regionkey + 1)", "'Core'", "NULL", "''", "10000000000 + r_regionkey", "{region}"),
    ("concat('W', r_regionkey)", "concat('A.1.7.1.', r_regionkey + 1, '.2')", "concat('Designated Risk Advisor ', r_regionkey + 1)", "'Core'", "concat('Y', r_regionkey)", "concat('The role is held by Holder ', r_name, '.')", "11000000000 + r_regionkey", "{region}"),
    ("concat('U', n_nationkey)", "concat('A.2.8.2.', n_nationkey + 1)", "concat('Accord ', n_nationkey)", "'Core'", "NULL", "''", "12000000000 + n_nationkey", "{nation}"),
    ("concat('J', n_nationkey)", "concat('A.2.8.2.', n_nationkey + 1, '.1.1.1')", "'Party'", "'Core'", "concat('U', n_nationkey)", "concat('The party ''', n_name, ''' comprises the ', n_name, ' Prime Agent, ', n_name, ' Foundation, and Lab ', n_name, '.')", "13000000000 + n_nationkey", "{nation}"),
    ("concat('S', n_nationkey)", "concat('A.2.8.2.', n_nationkey + 1, '.1.1.2')", "'Party'", "'Core'", "concat('U', n_nationkey)", "'The party ''Sky'' comprises Sky Core.'", "14000000000 + n_nationkey", "{nation}"),
    ("'E'", "'A.1.8.1.2.2.0.6.1'", "'Members'", "'Active Data'", "NULL", "concat('- Lab ', n_name, chr(10), '- Ann')", "15000000000", "{nation} WHERE n_nationkey = 0"),
    ("'O'", "'A.1.5.1.5.0.6.1'", "'Delegates'", "'Active Data'", "NULL", "'The Aligned Delegates are Bo, Cy, and Dee.'", "16000000000", "{region} WHERE r_regionkey = 0"),
    ("concat('O', j)", "concat('A.1.5.4.1.', j, '.3.1')", "'Ranked'", "'Core'", "NULL", "concat('The Ranked Delegates are Bo and Eve ', j, '.')", "17000000000 + j", TWO),
    ("concat('H', c_custkey)", "concat('A.2.13.1.1.', c_custkey + 1)", "'Grant'", "'Core'", "NULL", "concat('x', chr(10), '* Recipient: ', c_name, CASE WHEN c_custkey % 2 = 0 THEN ' Foundation' ELSE '' END)", "20000000000 + c_custkey", "{customer}"),
)
VIEWS["sections"] = ((), "\nUNION ALL\n".join(
    f"SELECT {uid(key)} AS id, {number} AS doc_no, {title} AS title, {kind} AS type, CAST({'NULL' if parent == 'NULL' else uid(parent)} AS STRING) AS parent_id, {content} AS content, CAST({order} AS BIGINT) AS ord FROM {rows}"
    for key, number, title, kind, parent, content, order, rows in SECTIONS
))
#: Addresses that are known, and contracts: those of instances, each behind that of its controller.
KNOWN = f"SELECT {contract(I)} AS address, 'base' AS chain, s_name AS label, CASE WHEN s_suppkey % 4 = 0 THEN 'delegate' ELSE 'vault' END AS role FROM {{supplier}}"
VIEWS["known"] = ((), KNOWN)
VIEWS["contracts"] = ((), f"SELECT {contract(I)} AS address, 'base' AS chain, {contract(A)} AS implementation FROM {{supplier}} WHERE s_suppkey % 2 = 0")
NAMED = "concat(lower(replace(replace(n_name, '_', '-'), ' ', '-')))"
REGION_SLUG = "lower(replace(r_name, ' ', '-'))"
SUPPLY = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def labelled(v):
    return v.known.select("address", "chain", "label", F.array("role").alias("roles"))


def listed(v):
    """Rows of pipe tables, one for each region: a name and a section."""
    from ..sources import readers

    tables = v.region.select(F.col("r_regionkey").alias("id"), F.concat(F.lit("| Name | Kind |\n|---|---|\n| Shop "), "r_name", F.lit(" | agent |\n| Shop "), "r_name", F.lit(" | agent |")).alias("content"))
    rows = readers.pipe_table(tables)
    key = F.md5(F.concat(F.lit("Y"), F.col("id").cast("string")))
    part = lambda a, n: F.substring(key, a, n)
    doc = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    return rows.select(F.col("cells")["Name"].alias("name"), F.lit("ecosystem_actor").alias("entity_type"), doc.alias("doc_id"), F.lit(0).alias("ord")).distinct()


def all_entities(v):
    return stored(relations.all_entities(v.sections, labelled(v), listed(v)), "entities")


def entity_query(name: str, rule: str, sql: str):
    """Entities of a rule against SQL for slug, name, entity_type and defining_doc_id."""
    query(name, sql=f"SELECT slug, name, entity_type, CAST(doc AS VARCHAR) AS doc FROM ({sql}) x")(
        lambda v: all_entities(v).where(F.col("rule") == rule).select("slug", "name", "entity_type", F.col("defining_doc_id").alias("doc"))
    )


S = "SELECT DISTINCT {} AS slug, {} AS name, {} AS entity_type, {} AS doc FROM {}"
LABELLED = f"concat('supplier-', substring(s_name, 10))"
entity_query("e1_bootstrap", "E1", "SELECT unnest(['sky-core', 'sky-governance', 'support-facilitators']) AS slug, unnest(['Sky Core', 'Sky Governance', 'Support Facilitators']) AS name, unnest(['operational_party', 'governance_body', 'governance_body']) AS entity_type, NULL AS doc")
entity_query("e2_primes", "E2", S.format(NAMED, "n_name", "'agent'", uid(P), "nation"))
entity_query("e3_executors", "E3", S.format(f"CASE WHEN r_regionkey = 4 THEN 'core-council-executor-agent-5' ELSE {REGION_SLUG} END", "CASE WHEN r_regionkey = 4 THEN 'Core Council Executor Agent 5' ELSE r_name END", "'agent'", uid(X), "region"))
entity_query("e4_offices", "E4", S.format(f"concat('fac-', {REGION_SLUG})", "concat('Fac ', r_name)", "'facilitator_org'", uid("concat('F', r_regionkey)"), "region") + " UNION ALL " + S.format(f"concat('gov-', {REGION_SLUG})", "concat('Gov ', r_name)", "'govops_org'", uid("concat('G', r_regionkey)"), "region"))
entity_query("e5_parties", "E5", S.format("concat('vendor-', s_suppkey)", "concat('Vendor ', s_suppkey)", "'ecosystem_actor'", uid(A), "supplier WHERE s_suppkey % 5 = 2"))
entity_query("e6_members", "E6", f"SELECT 'ann' AS slug, 'Ann' AS name, 'ecosystem_actor' AS entity_type, {uid(chr(39) + 'E' + chr(39))} AS doc UNION ALL SELECT 'lab-nation-0', 'Lab NATION_0', 'development_company', {uid(chr(39) + 'E' + chr(39))}")
entity_query("e7_labelled", "E7", S.format(LABELLED, "s_name", "'delegate_org'", "NULL", "supplier WHERE s_suppkey % 4 = 0"))
entity_query("e8_delegates", "E8", f"SELECT unnest(['bo', 'cy', 'dee']) AS slug, unnest(['Bo', 'Cy', 'Dee']) AS name, 'delegate_org' AS entity_type, {uid(chr(39) + 'O' + chr(39))} AS doc UNION ALL SELECT concat('eve-', j), concat('Eve ', j), 'delegate_org', {uid('concat(' + chr(39) + 'O' + chr(39) + ', j)')} FROM {TWO}")
entity_query("e9_holders", "E9", S.format(f"concat('holder-', {REGION_SLUG})", "concat('Holder ', r_name)", "'ecosystem_actor'", uid("concat('W', r_regionkey)"), "region"))
entity_query("e10_recipients", "E10", S.format("concat('customer-', substring(c_name, 10), CASE WHEN c_custkey % 2 = 0 THEN '-foundation' ELSE '' END)", "concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN ' Foundation' ELSE '' END)", "CASE WHEN c_custkey % 2 = 0 THEN 'foundation' ELSE 'ecosystem_actor' END", uid("concat('H', c_custkey)"), "customer"))
entity_query("e11_accord_members", "E11", " UNION ALL ".join((
    S.format(f"concat({NAMED}, '-party')", "n_name", "'composite_party'", "NULL", "nation"), S.format(f"concat({NAMED}, '-foundation')", "concat(n_name, ' Foundation')", "'foundation'", "NULL", "nation"),
    S.format(f"concat('lab-', {NAMED})", "concat('Lab ', n_name)", "'development_company'", "NULL", "nation WHERE n_nationkey > 0"),
)))
entity_query("e12_instances", "E12", S.format(f"concat({NAMED}, CASE s_suppkey % 2 WHEN 0 THEN '-growth-' ELSE '-reward-' END, {LABELLED})", "s_name", "CASE s_suppkey % 3 WHEN 1 THEN 'invocation' ELSE 'instance' END", uid(I), "supplier JOIN nation ON s_nationkey = n_nationkey"))
entity_query("e13_primitives", "E13", S.format(f"concat({NAMED}, CASE j WHEN 1 THEN '-growth' ELSE '-reward' END)", "concat(CASE j WHEN 1 THEN 'Growth' ELSE 'Reward' END, ' Primitive')", "'primitive'", uid(R), f"nation CROSS JOIN {TWO}"))
entity_query("e14_listed", "E14", S.format(f"concat('shop-', {REGION_SLUG})", "concat('Shop ', r_name)", "'ecosystem_actor'", uid("concat('Y', r_regionkey)"), "region"))


@query("p1_instance_params", "sections", sql=f"""SELECT {uid(I)} AS id, k AS key, CASE k WHEN 'Name' THEN s_name WHEN 'Token Address (Base)' THEN {contract(I)} WHEN 'Token Address (Ethereum)' THEN {contract(A)} WHEN 'Inflow Rate Limits / maxAmount' THEN CAST(s_suppkey AS VARCHAR) WHEN 'Inflow Rate Limits / slope' THEN '7'
ELSE concat('It is [him](', {uid(X)}, ').') END AS value FROM {SUPPLY} CROSS JOIN (SELECT unnest(['Name', 'Token Address (Base)', 'Token Address (Ethereum)', 'Inflow Rate Limits / maxAmount', 'Inflow Rate Limits / slope', 'him']) AS k) ks
WHERE k <> 'him' UNION ALL SELECT {uid(I)}, CASE WHEN r_regionkey = 4 THEN 'Core Council Executor Agent' ELSE 'Operational Executor Agent' END, concat('It is [him](', {uid(X)}, ').') FROM {SUPPLY}""")
def _(v):
    found = relations.instances(v.sections).select("id", "doc_no")
    return entity_rules.instance_params(v.sections, found).select("id", "key", "value")


def typed(v, which: str):
    if which == "doc":
        return relations.doc_relations(v.sections)
    entities = all_entities(v)
    if which == "entity":
        return relations.entity_relations(v.sections, entities)
    if which == "address":
        params = entity_rules.instance_params(v.sections, relations.instances(v.sections).select("id", "doc_no"))
        return relations.address_relations(v.sections, entities, v.known, v.contracts, params)
    if which == "listed":
        return relations.listed_relations(listed(v), entities)
    return relations.responsible_parties(v.sections, entities, stored(relations.entity_relations(v.sections, entities), "entity-edges"))


def edge_query(name: str, which: str, kinds: tuple[str, ...], sql: str):
    """Edges of some types against SQL for from_id, to_id, edge_type and meta."""
    query(name, sql=f"SELECT from_id, to_id, edge_type, CAST(meta AS VARCHAR) AS meta FROM ({sql}) x")(
        lambda v: typed(v, which).where(F.col("edge_type").isin(*kinds)).select("from_id", "to_id", "edge_type", "meta")
    )


E = "SELECT DISTINCT {} AS from_id, {} AS to_id, {} AS edge_type, {} AS meta FROM {}"
STATUS = "CASE s_suppkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'InProgress' ELSE 'Completed' END"
FAC, GOV, HOLDER = (slug_uid(f"concat('{x}-', {REGION_SLUG})") for x in ("fac", "gov", "holder"))
IN_ROOT = "concat('R', s_nationkey, '-', s_suppkey % 2 + 1)"
edge_query("d5_implements", "doc", ("implements",), E.format(uid(R), uid("concat('B', j)"), "'implements'", "NULL", f"nation CROSS JOIN {TWO}"))
edge_query("d6_instance_of", "doc", ("instance_of",), E.format(uid(I), uid(IN_ROOT), "'instance_of'", STATUS, "supplier WHERE s_suppkey % 3 <> 1"))
edge_query("d7_invocation_of", "doc", ("invocation_of",), E.format(uid(I), uid(IN_ROOT), "'invocation_of'", STATUS, "supplier WHERE s_suppkey % 3 = 1"))
edge_query("d8_invoked_by", "entity", ("invoked_by",), E.format(uid(I), uid("concat('P', s_nationkey)"), "'invoked_by'", STATUS, "supplier"))
edge_query("d9_located_at", "doc", ("located_at",), E.format(uid("concat('Z', s_suppkey)"), uid(I), "'located_at'", "NULL", "supplier"))
edge_query("d10_has_status", "doc", ("has_status",), E.format(uid(R), uid("concat('V', n_nationkey, '-', j)"), "'has_status'", "NULL", f"nation CROSS JOIN {TWO}"))
edge_query("d11_prime_agents", "entity", ("prime_agent_for",), E.format(uid(P), slug_uid("'sky-core'"), "'prime_agent_for'", "NULL", "nation"))
edge_query("d12_executor_agents", "entity", ("operational_executor_agent_for", "core_executor_agent_for"), f"SELECT {uid(X)} AS from_id, {uid(P)} AS to_id, CASE WHEN r_regionkey = 4 THEN 'core_executor_agent_for' ELSE 'operational_executor_agent_for' END AS edge_type, NULL AS meta FROM {SUPPLY}")
edge_query("d13_facilitators", "entity", ("operational_facilitator_for", "core_facilitator_for"), E.format(FAC, uid(X), "CASE WHEN r_regionkey = 4 THEN 'core_facilitator_for' ELSE 'operational_facilitator_for' END", "NULL", "region"))
edge_query("d14_govops", "entity", ("operational_govops_for", "core_govops_for"), E.format(GOV, uid(X), "CASE WHEN r_regionkey = 4 THEN 'core_govops_for' ELSE 'operational_govops_for' END", "NULL", "region"))
edge_query("d15_aligned_delegates", "entity", ("aligned_delegate_for",), E.format(slug_uid("x.slug"), slug_uid("'sky-governance'"), "'aligned_delegate_for'", "NULL", "(SELECT unnest(['bo', 'cy', 'dee']) AS slug) x"))
edge_query("d16_ranked_delegates", "entity", ("ranked_delegate_for",), E.format(slug_uid("x.slug"), slug_uid("'sky-governance'"), "'ranked_delegate_for'", "level", "(SELECT unnest(['bo', 'eve-1', 'bo', 'eve-2']) AS slug, unnest([1, 1, 2, 2]) AS level) x"))
edge_query("d17_role_holders", "entity", ("holds_role_for",), E.format(HOLDER, uid("concat('W', r_regionkey)"), "'holds_role_for'", "concat('risk_advisor_', r_regionkey + 1)", "region"))
edge_query("d18_accords", "entity", ("ecosystem_accord",), E.format(uid("concat('U', n_nationkey)"), slug_uid(f"concat({NAMED}, '-party')"), "'ecosystem_accord'", "NULL", "nation") + " UNION ALL " + E.format(uid("concat('U', n_nationkey)"), slug_uid("'sky-core'"), "'ecosystem_accord'", "NULL", "nation"))
COMPOSITE = slug_uid(f"concat({NAMED}, '-party')")
edge_query("d19_comprises", "entity", ("comprises",), " UNION ALL ".join(E.format(COMPOSITE, to, "'comprises'", "NULL", "nation") for to in (uid(P), slug_uid(f"concat({NAMED}, '-foundation')"), slug_uid(f"concat('lab-', {NAMED})"))))
edge_query("d20_group_members", "entity", ("erg_member_for",), E.format(slug_uid("x.slug"), uid(chr(39) + "E" + chr(39)), "'erg_member_for'", "NULL", "(SELECT unnest(['ann', 'lab-nation-0']) AS slug) x"))
#: An agent's chain is that of the executor that its instances name last; agents of the region of the core executor have none.
edge_query("d21_responsible_parties", "party", ("responsible_party_for",), f"""SELECT CASE s_suppkey % 5 WHEN 0 THEN {GOV} WHEN 1 THEN {FAC} WHEN 2 THEN {slug_uid("concat('vendor-', s_suppkey)")} WHEN 3 THEN {slug_uid("concat('holder-', lower(replace(rr, ' ', '-')))")} ELSE {slug_uid("'gov-middle-east'")} END AS from_id,
{uid(A)} AS to_id, 'responsible_party_for' AS edge_type, CASE s_suppkey % 5 WHEN 2 THEN 'direct' WHEN 3 THEN 'role' ELSE 'chain' END AS meta FROM {SUPPLY} JOIN (SELECT r_regionkey AS rk, r_name AS rr FROM region) o ON rk = s_suppkey % 4 WHERE s_suppkey % 5 >= 2 OR r_regionkey < 4""")
edge_query("d22_defines_entity", "entity", ("defines_entity",), " UNION ALL ".join((
    *[E.format(uid(k), uid(k), "'defines_entity'", "NULL", t) for k, t in ((P, "nation"), (X, "region"), (I, "supplier"))],
    E.format(uid("concat('F', r_regionkey)"), FAC, "'defines_entity'", "NULL", "region"), E.format(uid("concat('G', r_regionkey)"), GOV, "'defines_entity'", "NULL", "region"),
    E.format(uid(A), slug_uid("concat('vendor-', s_suppkey)"), "'defines_entity'", "NULL", "supplier WHERE s_suppkey % 5 = 2"), E.format(uid("'E'"), slug_uid("x.slug"), "'defines_entity'", "NULL", "(SELECT unnest(['ann', 'lab-nation-0']) AS slug) x"),
    E.format(uid("'O'"), slug_uid("x.slug"), "'defines_entity'", "NULL", "(SELECT unnest(['bo', 'cy', 'dee']) AS slug) x"), E.format(uid("concat('O', j)"), slug_uid("concat('eve-', j)"), "'defines_entity'", "NULL", TWO),
    E.format(uid("concat('W', r_regionkey)"), HOLDER, "'defines_entity'", "NULL", "region"), E.format(uid("concat('Y', r_regionkey)"), slug_uid(f"concat('shop-', {REGION_SLUG})"), "'defines_entity'", "NULL", "region"),
    E.format(uid("concat('H', c_custkey)"), slug_uid("concat('customer-', substring(c_name, 10), CASE WHEN c_custkey % 2 = 0 THEN '-foundation' ELSE '' END)"), "'defines_entity'", "NULL", "customer"),
    E.format(uid(R), slug_uid(f"concat({NAMED}, CASE j WHEN 1 THEN '-growth' ELSE '-reward' END)"), "'defines_entity'", "NULL", f"nation CROSS JOIN {TWO}"),
)))
edge_query("d23_has_address", "address", ("has_address",), E.format(slug_uid(LABELLED), f"concat({contract(I)}, ':base')", "'has_address'", "NULL", "supplier WHERE s_suppkey % 4 = 0") + " UNION ALL " + E.format(uid(I), f"concat({contract(I)}, ':base')", "'has_address'", "NULL", "supplier") + " UNION ALL " + E.format(uid(I), f"concat({contract(A)}, ':ethereum')", "'has_address'", "NULL", "supplier"))
edge_query("d24_mentions", "address", ("mentions",), E.format(uid("concat('Q', s_suppkey)"), f"concat({contract(I)}, ':base')", "'mentions'", "NULL", "supplier") + " UNION ALL " + E.format(uid("concat('Q', s_suppkey)"), f"concat({contract(A)}, ':ethereum')", "'mentions'", "NULL", "supplier"))
edge_query("d25_proxies", "address", ("proxies_to",), E.format(f"concat({contract(I)}, ':base')", f"concat({contract(A)}, ':base')", "'proxies_to'", "NULL", "supplier WHERE s_suppkey % 2 = 0"))
edge_query("d26_listed", "listed", ("listed_in",), E.format(slug_uid(f"concat('shop-', {REGION_SLUG})"), uid("concat('Y', r_regionkey)"), "'listed_in'", "NULL", "region"))
edge_query("g5_instance_kinds", "doc", ("instance_of", "invocation_of"), E.format(uid(I), uid(IN_ROOT), "CASE s_suppkey % 3 WHEN 1 THEN 'invocation_of' ELSE 'instance_of' END", STATUS, "supplier"))


@query("d2_annotates", "sections", sql="SELECT id AS from_id, parent_id AS to_id FROM sections WHERE FALSE")
def _(v):
    return extraction.rule_edges(v.sections).where("edge_type = 'annotates'").select("from_id", "to_id")


@query("d4_cites", "sections", sql=f"""SELECT {uid(R)} AS from_id, {uid("concat('B', j)")} AS to_id FROM nation CROSS JOIN {TWO} UNION ALL SELECT {uid("concat('N', s_suppkey)")}, {uid(X)} FROM {SUPPLY} UNION ALL SELECT {uid("concat('Z', s_suppkey)")}, {uid("'B1'")} FROM supplier UNION ALL SELECT {uid("concat('Z', s_suppkey)")}, {uid(I)} FROM supplier""")
def _(v):
    return extraction.citations(v.sections).select("from_id", "to_id")


@query("x13_name_lists", sql=f"SELECT n_nationkey AS k, concat_ws('|', concat(n_name, ' Prime Agent'), concat(n_name, ' Foundation'), concat('Lab ', n_name)) AS names FROM nation")
def _(v):
    said = F.concat(F.lit("the "), "n_name", F.lit(" Prime Agent, "), "n_name", F.lit(" Foundation, and Lab "), "n_name")
    return v.nation.select(F.col("n_nationkey").alias("k"), F.array_join(text.name_list(said), "|").alias("names"))


@query("x16_declared_parties", "sections", sql=f"""SELECT {uid(A)} AS id, CASE s_suppkey % 5 WHEN 0 THEN 'operational_govops' WHEN 1 THEN 'operational_facilitator' WHEN 4 THEN 'core_govops' END AS role, CASE s_suppkey % 5 WHEN 2 THEN concat('Vendor ', s_suppkey) WHEN 3 THEN concat('Risk Advisor ', s_suppkey % 4 + 1) END AS name FROM supplier""")
def _(v):
    return relations.controllers(v.sections).select("id", "role", "name")
