"""Entities and typed relations of a corpus of numbered sections.

Entities come from rules that each say which sections they look at and how names are read
from them; of candidates with one slug the first by phase and order stays. Relations join
sections and entities by number, link, name or role. Every function takes and returns
DataFrames; sections have id, doc_no, title, type, parent_id, content and ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINK, assignment, bullet_items, declared_party, links, name_list, parent_key, party_role, slug_id, slugify
from .entities import ENTITY_RULES, entities_of, instance_params, primitive_status
from .extraction import addresses, first_entities

# fixed values: numbers under which sections of a kind stand, and entities that no section names
AGENTS, GLOBAL_PRIMITIVES, ROLE_HOME, ACCORDS = "A.6.1.1", "A.2.2", "A.1.7.1", "A.2.8.2"
MEMBERS_NO, DELEGATES_NO, RANKED_NO = "A.1.8.1.2.2.0.6.1", "A.1.5.1.5.0.6.1", r"^A\.1\.5\.4\.1\.([12])\.3\.1$"
BOOTSTRAP = (("sky-core", "Sky Core", "operational_party"), ("sky-governance", "Sky Governance", "governance_body"), ("support-facilitators", "Support Facilitators", "governance_body"))
# fixed values: titles of sections that hold instances, and what stands in them
TIERS = (("active instances", "instance", "Active"), ("completed instances", "instance", "Completed"), ("suspended instances", "instance", "Suspended"), ("in progress invocations", "invocation", "InProgress"))
EDGE = ("from_id", "from_type", "to_id", "to_type", "edge_type", "source", "meta")


def _parts(number: Column, first: int) -> Column:
    return F.array_join(F.slice(F.split(number, r"\."), 1, first), ".")


def _depth(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def by_number(docs: DataFrame, number: str = "number", *columns: str) -> DataFrame:
    """One row for each number, the last section that has it: number, its id as found_id, and columns as found_<column>."""
    last = F.max_by(F.struct("id", *columns), "ord").alias("last")
    return docs.groupBy(F.col("doc_no").alias(number)).agg(last).select(number, F.col("last.id").alias("found_id"), *[F.col(f"last.{c}").alias(f"found_{c}") for c in columns])


def edge(df: DataFrame, from_id: str, from_type: str, to_id: str, to_type: str, edge_type: Column | str, source: str | None = "doc_no", meta: Column | None = None) -> DataFrame:
    kind = F.lit(edge_type) if isinstance(edge_type, str) else edge_type
    return df.select(
        F.col(from_id).alias("from_id"), F.lit(from_type).alias("from_type"), F.col(to_id).alias("to_id"), F.lit(to_type).alias("to_type"), kind.alias("edge_type"),
        (F.col(source) if source else F.lit(None)).cast("string").alias("source"), (meta if meta is not None else F.lit(None)).cast("string").alias("meta"),
    )


# ---- what rules read from sections


def located(docs: DataFrame) -> Column:
    """Whether a section only says where an instance's configuration stands."""
    return F.lower("title").contains("instance configuration document location") | F.ltrim(F.lower(F.coalesce("content", F.lit("")))).rlike("^this instance['’]s associated instance configuration document is located at")


def instances(docs: DataFrame) -> DataFrame:
    """Configuration sections of agents' primitives: doc_no, id, title, root_id, root_no, root_title, root_content, agent_no, kind and status.

    The root is the section of the primitive, three numbers below the agent; kind and
    status come from the nearest section above with a known title, under the root.
    """
    number = F.col("doc_no")
    own = docs.where(F.lower("title").contains("instance configuration document") & ~located(docs) & number.rlike(r"^A\.6\.1\.1\.[0-9]+\.2\.[0-9]+\.[0-9]+(\.|$)"))
    own = own.select("id", "doc_no", "title", "ord", _parts(number, 8).alias("root_no"), _parts(number, 5).alias("agent_no"))
    roots = by_number(docs, "root_no", "title", "content").where(F.lower("found_title").endswith("primitive"))
    own = own.join(roots.select("root_no", F.col("found_id").alias("root_id"), F.col("found_title").alias("root_title"), F.col("found_content").alias("root_content")), "root_no")
    above = F.transform(F.sequence(F.lit(9), _depth(number)), lambda i: F.struct(_prefix(number, i).alias("number"), i.alias("depth")))
    tier = F.lit(None).cast("struct<kind: string, status: string>")
    for title, kind, status in reversed(TIERS):
        tier = F.when(F.lower("found_title").startswith(title), F.struct(F.lit(kind).alias("kind"), F.lit(status).alias("status"))).otherwise(tier)
    told = own.where(_depth(number) >= 9).select("id", F.explode(above).alias("a")).select("id", "a.number", "a.depth").join(by_number(docs, "number", "title"), "number").withColumn("tier", tier).where("tier IS NOT NULL")
    nearest = told.groupBy("id").agg(F.max_by("tier", "depth").alias("tier")).select("id", "tier.kind", "tier.status")
    return own.join(nearest, "id", "left")


def _prefix(number: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(number, r"\."), F.lit(1), n), ".")


def parties(docs: DataFrame) -> DataFrame:
    """Parties of accords: doc_no, ord, accord_no, party, members; a party that only is something has none."""
    said = r"(?i)the party ['‘]([^'’]+)['’]\s+(comprises|is)\b\s*([^.]*)"
    rows = docs.where(F.col("doc_no").rlike(r"^A\.2\.8\.2\.[0-9]+\.1\.1\.[0-9]+$"))
    party, verb = F.trim(F.regexp_extract("content", said, 1)), F.lower(F.regexp_extract("content", said, 2))
    members = F.when(verb == "comprises", name_list(F.regexp_extract("content", said, 3))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", "doc_no", "ord", _parts(F.col("doc_no"), 5).alias("accord_no"), party.alias("party"), members.alias("members")).where("party <> ''")


def member_slug(name: Column) -> Column:
    """The slug of an accord's member; agents are named without what they are."""
    return slugify(F.regexp_replace(name, r"(?i)\s+(?:Prime Agent|Executor Agent)$", ""))


def bindings(docs: DataFrame) -> DataFrame:
    """Holders of roles: id, doc_no, ord, title of the section that binds, role and holder; the role's section has the number before .2."""
    role = docs.where(F.col("doc_no").rlike(r"^A\.1\.7\.1\.[^.]+$")).select(F.concat("doc_no", F.lit(".2")).alias("number"), F.lower("title").alias("role"))
    bound = role.join(by_number(docs, "number", "title", "content", "ord"), "number")
    holder = F.trim(F.regexp_extract("found_content", r"(?i)role is held by\s+([^.]+)\.", 1))
    return bound.select(F.col("found_id").alias("id"), F.col("number").alias("doc_no"), F.col("found_ord").alias("ord"), F.col("found_title").alias("title"), F.regexp_replace("role", r"\s+", "_").alias("role"), holder.alias("holder")).where("holder <> ''")


def delegates(docs: DataFrame) -> DataFrame:
    """Delegates by list or sentence: doc_no, ord, id, level (null for aligned ones) and name."""
    said = lambda kind: name_list(F.regexp_extract("content", rf"(?i){kind} delegates?\s+(?:are|is)\s+([^.]+)\.", 1))
    items = bullet_items(F.col("content"))
    aligned = docs.where(F.col("doc_no") == DELEGATES_NO).select("id", "doc_no", "ord", F.lit(None).cast("int").alias("level"), F.explode(F.when(F.size(items) > 0, items).otherwise(said("aligned"))).alias("name"))
    ranked = docs.where(F.col("doc_no").rlike(RANKED_NO)).select("id", "doc_no", "ord", F.regexp_extract("doc_no", RANKED_NO, 1).cast("int").alias("level"), F.explode(said("ranked")).alias("name"))
    return aligned.unionByName(ranked)


def controllers(docs: DataFrame) -> DataFrame:
    """Controllers of active data with what they declare: id, doc_no, ord, declared, role and name (null where there is none)."""
    told = docs.where("type = 'Active Data Controller'").select("id", "doc_no", "ord", declared_party(F.col("content")).alias("declared")).where("declared IS NOT NULL")
    return told.withColumn("p", party_role(F.col("declared"))).select("id", "doc_no", "ord", "declared", "p.role", F.nullif("p.name", F.lit("")).alias("name"))


def role_titles(docs: DataFrame) -> DataFrame:
    """One row with the array of lower-case titles of the sections of roles."""
    return docs.where(F.col("doc_no").rlike(r"^A\.1\.7\.1\.[^.]+$")).agg(F.collect_set(F.lower("title")).alias("titles"))


# ---- entities


def all_entities(docs: DataFrame, labelled: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """slug, id, name, entity_type, subtype, defining_doc_id and rule of all entities.

    labelled: addresses with label and roles, of which delegates are entities; listed: rows
    of text tables (name, entity_type, doc_id, ord). Agents and instances have their
    section's id, others one that their slug gives. An actor that an accord lists as a
    member gets the type that the accord gives it.
    """
    spark = docs.sparkSession
    candidates = []

    def add(rule: str, phase: int, rows: DataFrame, name: Column, kind: Column | str, doc: Column | None = None, subtype: Column | None = None, own: bool = False, slug: Column | None = None, order: Column | None = None) -> None:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        candidates.append(rows.select(
            (slugify(name) if slug is None else slug).alias("slug"), name.alias("name"), kind.alias("entity_type"), (F.lit(None) if subtype is None else subtype).cast("string").alias("subtype"),
            (F.lit(None) if doc is None else doc).cast("string").alias("defining_doc_id"), F.lit(own).alias("own"), F.lit(rule).alias("rule"), F.lit(phase).alias("phase"),
            (F.col("ord") if order is None else order).cast("long").alias("ord"),
        ))

    known = spark.createDataFrame([(*b, k) for k, b in enumerate(BOOTSTRAP)], "slug string, name string, kind string, ord int")
    add("E1", 0, known, F.col("name"), F.col("kind"), slug=F.col("slug"))
    names = {1: "E2", 2: "E3", 3: "E4", 4: "E4"}
    for r in ENTITY_RULES[:4]:
        add(names[r.phase], r.phase, entities_of(docs, (r,)).withColumn("ord", F.lit(0)), F.col("name"), F.col("entity_type"), F.col("defining_doc_id"), F.col("subtype"), r.own_id)
    declared = controllers(docs).where("name IS NOT NULL").join(F.broadcast(role_titles(docs)))
    add("E5", 5, declared.where(~F.exists("titles", lambda t: F.contains(t, F.lower("name")))), F.col("name"), "ecosystem_actor", F.col("id"))
    members = docs.where(F.col("doc_no") == MEMBERS_NO).select("id", "ord", F.explode(bullet_items(F.col("content"))).alias("name"))
    add("E6", 6, members, F.col("name"), "ecosystem_actor", F.col("id"))
    if labelled is not None:
        add("E7", 7, labelled.where(F.array_contains("roles", "delegate") & F.col("label").isNotNull()), F.col("label"), "delegate_org", order=F.xxhash64("address"))
    add("E8", 8, delegates(docs), F.col("name"), "delegate_org", F.col("id"))
    add("E9", 9, bindings(docs), F.col("holder"), "ecosystem_actor", F.col("id"))
    grants = docs.where(F.col("doc_no").rlike(r"^A\.2\.13\.1\.[0-9]+\.[0-9]+$")).withColumn("name", F.trim(F.regexp_extract("content", r"(?i)\bRecipient:\s*([^\n]+)", 1))).where("name <> ''")
    add("E10", 10, grants, F.col("name"), F.when(F.lower("name").rlike(r"\bfoundation\b"), "foundation").otherwise("ecosystem_actor"), F.col("id"))
    accords = parties(docs)
    add("E11", 11, accords.where("lower(party) <> 'sky'"), F.col("party"), "composite_party", slug=F.concat(slugify(F.col("party")), F.lit("-party")))
    listed_members = accords.select("doc_no", "ord", F.explode("members").alias("name"))
    kind = F.when(F.lower("name").endswith("foundation"), "foundation").otherwise("development_company")
    add("E11", 12, listed_members, F.col("name"), kind, slug=F.when(F.lower("name").rlike("(?:prime|executor) agent$"), F.lit(None)).otherwise(slugify(F.col("name"))))
    found = instances(docs)
    agents = by_number(docs, "agent_no", "title").select("agent_no", F.col("found_title").alias("agent"), F.col("found_id").alias("agent_id"))
    primitive = slugify(F.regexp_replace("root_title", r"(?i)\s+Primitive$", ""))
    raw = F.trim(F.regexp_replace("title", r"(?i)\s+Instance Configuration Document\s*$", ""))
    single = F.regexp_replace(F.regexp_extract("root_content", r"(?i)for ([^.]+?)\.\s+See", 1), r"\binstances?\b", "Instance")
    named = found.join(agents, "agent_no", "left").withColumn("name", F.when((raw == "Single") & (single != ""), single).otherwise(raw))
    slug = F.concat_ws("-", F.coalesce(slugify(F.col("agent")), F.lit("unknown")), primitive, slugify(F.col("name")))
    add("E12", 13, named, F.col("name"), F.when(F.col("kind") == "invocation", "invocation").otherwise("instance"), F.col("id"), primitive, True, slug)
    roots = docs.where(F.col("doc_no").rlike(r"^A\.6\.1\.1\.[0-9]+\.2\.[0-9]+\.[0-9]+$") & F.lower("title").endswith("primitive")).withColumn("agent_no", _parts(F.col("doc_no"), 5)).join(agents, "agent_no")
    own_slug = slugify(F.regexp_replace("title", r"(?i)\s+Primitive$", ""))
    add("E13", 14, roots, F.col("title"), "primitive", F.col("id"), own_slug, slug=F.concat_ws("-", slugify(F.col("agent")), own_slug))
    if listed is not None:
        add("E14", 15, listed, F.col("name"), F.col("entity_type"), F.col("doc_id"))

    rows = candidates[0]
    for c in candidates[1:]:
        rows = rows.unionByName(c)
    first = first_entities(rows.where("slug IS NOT NULL AND slug <> ''"))
    given = listed_members.groupBy(slugify(F.col("name")).alias("slug")).agg(F.min(kind).alias("given"))
    typed = first.join(given, "slug", "left").withColumn("entity_type", F.when((F.col("entity_type") == "ecosystem_actor") & F.col("given").isNotNull(), F.col("given")).otherwise(F.col("entity_type")))
    return typed.select("slug", F.when(F.col("own"), F.col("defining_doc_id")).otherwise(slug_id(F.col("slug"))).alias("id"), "name", "entity_type", "subtype", "defining_doc_id", "rule")


# ---- relations


def doc_relations(docs: DataFrame) -> DataFrame:
    """implements, instance_of, invocation_of, located_at and has_status."""
    see = docs.where(F.col("doc_no").startswith(f"{AGENTS}.")).select("id", "doc_no", F.regexp_extract("content", rf"(?i)\bSee\s+{LINK}", 1).alias("to_id"))
    targets = docs.where(F.col("doc_no").startswith(f"{GLOBAL_PRIMITIVES}.")).select(F.col("id").alias("to_id"))
    out = edge(see.join(targets, "to_id", "left_semi"), "id", "doc", "to_id", "doc", "implements")
    kind = F.when(F.col("kind") == "invocation", "invocation_of").otherwise("instance_of")
    out = out.unionByName(edge(instances(docs), "id", "doc", "root_id", "doc", kind, meta=F.col("status")))
    homes = docs.where(F.lower("title").contains("instance configuration document") & ~located(docs)).select(F.col("id").alias("to_id"))
    linked = docs.where(located(docs)).select("id", "doc_no", F.posexplode(links(F.col("content"))).alias("n", "to_id")).join(homes, "to_id", "left_semi")
    out = out.unionByName(edge(linked.groupBy("id", "doc_no").agg(F.min_by("to_id", "n").alias("to_id")), "id", "doc", "to_id", "doc", "located_at"))
    told = docs.where(F.lower("title").contains("global activation status") & F.col("doc_no").startswith(f"{AGENTS}.")).select("id", parent_key(F.col("doc_no"), 2).alias("number"))
    return out.unionByName(edge(told.join(by_number(docs), "number"), "found_id", "doc", "id", "doc", "has_status", "number"))


def entity_relations(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of entities with each other and with sections, but for responsible parties."""
    ids = entities.select("slug", F.col("id").alias("entity_id"), "subtype")
    by_slug = lambda df, name: df.withColumn("slug", slugify(F.col(name))).join(ids.drop("subtype"), "slug")
    of_doc = entities.where("defining_doc_id IS NOT NULL").groupBy(F.col("defining_doc_id").alias("doc_id")).agg(F.max_by(F.struct("id", "subtype"), "slug").alias("e")).select("doc_id", F.col("e.id").alias("of_id"), F.col("e.subtype").alias("of_subtype"))
    constant = lambda df, slug: df.join(F.broadcast(entities.where(F.col("slug") == slug).select(F.col("id").alias("fixed_id"))))  # noqa: E731  (one row)

    out = edge(constant(docs.where(F.col("doc_no").rlike(r"^A\.6\.1\.1\.[0-9]+$")).join(of_doc, F.col("id") == F.col("doc_id")), "sky-core"), "of_id", "entity", "fixed_id", "entity", "prime_agent_for")
    by_no = by_number(docs)
    mine = instances(docs).select("id", "doc_no", "status", F.col("agent_no").alias("number")).join(by_no, "number").join(of_doc, F.col("found_id") == F.col("doc_id"))
    out = out.unionByName(edge(mine, "id", "entity", "of_id", "entity", "invoked_by", meta=F.col("status")))

    settings = docs.where(F.lower("title").rlike("^(?:operational|core)(?: council)? executor agent$") & F.col("doc_no").startswith(f"{AGENTS}."))
    settings = settings.select("id", "doc_no", _parts(F.col("doc_no"), 5).alias("number"), F.posexplode(links(F.col("content"))).alias("n", "link"))
    first = settings.join(docs.select(F.col("id").alias("link")), "link", "left_semi").groupBy("id", "doc_no", "number").agg(F.min_by("link", "n").alias("link"))
    executors = first.join(of_doc.select(F.col("doc_id").alias("link"), F.col("of_id").alias("executor_id"), "of_subtype"), "link").drop("id")
    primes = executors.join(by_no, "number").join(of_doc.drop("of_subtype"), F.col("found_id") == F.col("doc_id"))
    out = out.unionByName(edge(primes, "executor_id", "entity", "of_id", "entity", F.when(F.col("of_subtype") == "core_executor", "core_executor_agent_for").otherwise("operational_executor_agent_for")))

    for office, ending, core, subject in (
        ("facilitator", 1, "core executor facilitator", r"(?:The )?(?:(?:Operational|Core) (?:Executor )?)?Facilitator for [^.]+"), ("govops", 2, "core govops", r"(?:(?:Operational|Core) )?GovOps for [^.]+"),
    ):
        held = docs.where(F.col("doc_no").rlike(rf"^A\.6\.1\.2\.[0-9]+\.{ending}$")).withColumn("holder", assignment(F.col("content"), subject))
        held = by_slug(held, "holder").join(of_doc, F.col("parent_id") == F.col("doc_id"))
        out = out.unionByName(edge(held, "entity_id", "entity", "of_id", "entity", F.when(F.lower("title").contains(core), f"core_{office}_for").otherwise(f"operational_{office}_for")))

    voters = constant(by_slug(delegates(docs), "name"), "sky-governance")
    out = out.unionByName(edge(voters, "entity_id", "entity", "fixed_id", "entity", F.when(F.col("level").isNull(), "aligned_delegate_for").otherwise("ranked_delegate_for"), meta=F.col("level")))
    out = out.unionByName(edge(by_slug(bindings(docs), "holder"), "entity_id", "entity", "id", "doc", "holds_role_for", meta=F.col("role")))

    accords = parties(docs).withColumn("slug", F.when(F.lower("party") == "sky", F.lit("sky-core")).otherwise(F.concat(slugify(F.col("party")), F.lit("-party")))).join(ids.drop("subtype"), "slug")
    signed = accords.select("accord_no", F.col("entity_id").alias("party_id")).join(by_number(docs, "accord_no"), "accord_no")
    out = out.unionByName(edge(signed, "found_id", "doc", "party_id", "entity", "ecosystem_accord", "accord_no"))
    inside = accords.where("slug <> 'sky-core'").select("doc_no", F.col("entity_id").alias("party_id"), F.explode("members").alias("member")).withColumn("slug", member_slug(F.col("member"))).join(ids.drop("subtype"), "slug")
    inside = inside.where("party_id <> entity_id").groupBy("party_id", "entity_id").agg(F.min("doc_no").alias("doc_no"))
    out = out.unionByName(edge(inside, "party_id", "entity", "entity_id", "entity", "comprises"))

    group = docs.where(F.col("doc_no") == MEMBERS_NO).select("id", "doc_no", F.explode(bullet_items(F.col("content"))).alias("name"))
    out = out.unionByName(edge(by_slug(group, "name"), "entity_id", "entity", "id", "doc", "erg_member_for"))
    defined = entities.join(docs.select(F.col("id").alias("defining_doc_id")), "defining_doc_id", "left_semi")
    return out.unionByName(edge(defined, "defining_doc_id", "doc", "id", "entity", "defines_entity", None))


def responsible_parties(docs: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """responsible_party_for: who a controller's declaration means, with how it was resolved.

    First the holder of a role whose section's title has the name in it, then the entity
    of the name, then for a role alone the chain of prime agent, executor and office. Core
    offices and, outside of agents, an operational office that one entity alone has need
    no chain.
    """
    told = controllers(docs).withColumn("number", F.when(F.col("doc_no").startswith(f"{AGENTS}."), _parts(F.col("doc_no"), 5)))
    holders = edges.where("edge_type = 'holds_role_for'").select(F.col("to_id").alias("id"), F.col("from_id").alias("holder_id")).join(docs.select("id", F.lower("title").alias("title"), "ord"), "id")
    roles = holders.agg(F.sort_array(F.collect_list(F.struct("ord", "title", "holder_id"))).alias("roles"))  # one row: the roles that sections bind
    role_of = F.get(F.filter("roles", lambda r: F.contains(r["title"], F.lower("name"))), F.lit(0))["holder_id"]
    rows = told.join(F.broadcast(roles)).withColumn("by_role", F.when(F.col("name").isNotNull(), role_of)).drop("roles")
    rows = rows.withColumn("slug", slugify(F.col("name"))).join(entities.select("slug", F.col("id").alias("by_name")), "slug", "left")

    of = lambda kind, source, target: edges.where(F.col("edge_type") == kind).groupBy(F.col("to_id").alias(source)).agg(F.max(F.struct("source", "from_id"))["from_id"].alias(target))
    primes = by_number(docs).join(entities.select(F.col("defining_doc_id").alias("found_id"), F.col("id").alias("prime_id")), "found_id").select("number", "prime_id")
    chain = primes.join(of("operational_executor_agent_for", "prime_id", "executor_id"), "prime_id")
    for office in ("govops", "facilitator"):
        chain = chain.join(of(f"operational_{office}_for", "executor_id", f"operational_{office}"), "executor_id", "left")
    only = edges.agg(
        *[F.min(F.when(F.col("edge_type") == f"core_{o}_for", F.struct("source", "from_id")))["from_id"].alias(f"core_{o}") for o in ("govops", "facilitator")],
        F.when(F.count_distinct(F.when(F.col("edge_type") == "operational_govops_for", F.col("from_id"))) == 1, F.max(F.when(F.col("edge_type") == "operational_govops_for", F.col("from_id")))).alias("lone_govops"),
    )
    rows = rows.join(chain.select("number", "operational_govops", "operational_facilitator"), "number", "left").join(F.broadcast(only))
    support = entities.where("slug = 'support-facilitators'").agg(F.max("id").alias("support_id"))
    agent = F.col("number").isNotNull()
    by_chain = (
        F.when(F.col("role") == "core_facilitator", F.col("core_facilitator")).when(F.col("role") == "core_govops", F.col("core_govops"))
        .when(F.col("role") == "operational_govops", F.when(agent, F.col("operational_govops")).otherwise(F.col("lone_govops")))
        .when((F.col("role") == "operational_facilitator") & agent, F.col("operational_facilitator")).when((F.col("role") == "support_facilitators") & ~agent, F.col("support_id"))
    )
    rows = rows.join(F.broadcast(support)).withColumn("by_chain", by_chain).withColumn("party_id", F.coalesce("by_role", "by_name", "by_chain"))
    how = F.when(F.col("by_role").isNotNull(), "role").when(F.col("by_name").isNotNull(), "direct").otherwise("chain")
    return edge(rows.where("party_id IS NOT NULL"), "party_id", "entity", "id", "doc", "responsible_party_for", meta=how)


def address_relations(docs: DataFrame, entities: DataFrame, known: DataFrame, contracts: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """mentions, has_address and proxies_to; an address's node is its text and chain.

    known: address, chain, label; contracts: address, chain, implementation; params of
    instances: id, value, of which those that are addresses belong to their instance.
    """
    chains = known.groupBy("address").agg(F.min("chain").alias("chain"))
    node = F.concat_ws(":", "address", F.coalesce("chain", F.lit("ethereum")))
    named = addresses(docs).select("id", "address").distinct().join(chains, "address", "left").withColumn("node", node).join(docs.select("id", "doc_no"), "id")
    out = edge(named, "id", "doc", "node", "address", "mentions")
    owned = known.where("label IS NOT NULL").withColumn("slug", slugify(F.col("label"))).join(entities.select("slug", "id"), "slug").withColumn("node", node)
    pairs = owned.select("id", "node")
    if params is not None:
        values = params.where(F.col("value").rlike("^0x[0-9a-fA-F]{40}$")).select("id", F.lower("value").alias("address")).join(chains, "address", "left").withColumn("node", node)
        pairs = pairs.unionByName(values.select("id", "node"))
    out = out.unionByName(edge(pairs.distinct(), "id", "entity", "node", "address", "has_address", None))
    proxies = contracts.where("implementation IS NOT NULL").withColumn("node", F.concat_ws(":", F.lower("address"), "chain")).withColumn("behind", F.concat_ws(":", F.lower("implementation"), "chain"))
    return out.unionByName(edge(proxies, "node", "address", "behind", "address", "proxies_to", None))


def listed_relations(listed: DataFrame, entities: DataFrame) -> DataFrame:
    """listed_in: entities of rows of text tables (name, doc_id) with the sections that list them, each once."""
    rows = listed.withColumn("slug", slugify(F.col("name"))).join(entities.select("slug", "id"), "slug").select("id", "doc_id").distinct()
    return edge(rows, "id", "entity", "doc_id", "doc", "listed_in", None)


__all__ = ["all_entities", "address_relations", "bindings", "by_number", "controllers", "delegates", "doc_relations", "entity_relations", "instance_params", "instances", "listed_relations", "parties", "primitive_status", "responsible_parties"]
