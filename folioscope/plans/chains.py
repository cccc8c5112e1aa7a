"""Reports on who answers for what, along typed relations (see operators.relations), and on the steps of processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key, parent_key
from ..operators.relations import by_number

#: What a hop of a chain may be, its column, and the end that the hop starts from.
OFFICES = ("facilitator", "govops")


def _first(edges: DataFrame, office: str, at: str) -> DataFrame:
    """The first edge of an office by its source's number: at (the end it is for), <office>_id and <office>_source."""
    kinds = (f"operational_{office}_for", f"core_{office}_for")
    best = F.min_by(F.struct("from_id", "source"), F.struct(natural_key(F.col("source")), "from_id")).alias("e")
    return edges.where(F.col("edge_type").isin(*kinds)).groupBy(F.col("to_id").alias(at)).agg(best).select(at, F.col("e.from_id").alias(f"{office}_id"), F.col("e.source").alias(f"{office}_source"))


def responsibility_chains(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """agent_id and agent of each prime agent with its executor, and that one's facilitator and govops: id, name and source of each hop.

    Of several edges of a hop the first by its source's number counts; a hop that is
    missing leaves nulls from there on.
    """
    names = entities.select("id", "name")
    out = entities.where("entity_type = 'agent' AND subtype = 'prime'").select(F.col("id").alias("agent_id"), F.col("name").alias("agent"))
    out = out.join(_first(edges, "executor_agent", "agent_id").withColumnsRenamed({"executor_agent_id": "executor_id", "executor_agent_source": "executor_source"}), "agent_id", "left")
    for office in OFFICES:
        out = out.join(_first(edges, office, "executor_id"), "executor_id", "left")
    for hop in ("executor", *OFFICES):
        out = out.join(names.select(F.col("id").alias(f"{hop}_id"), F.col("name").alias(hop)), f"{hop}_id", "left")
    return out.select("agent_id", "agent", *[c for hop in ("executor", *OFFICES) for c in (f"{hop}_id", hop, f"{hop}_source")])


def active_data_index(docs: DataFrame, entities: DataFrame, edges: DataFrame, chains: DataFrame) -> DataFrame:
    """One row for each section of active data: its controller, agent, responsible party with how it was resolved, facilitator, and the evidence in order.

    The agent is that under whose number the controller stands, ``Governance`` without one.
    Evidence are the numbers of the controller and of the hops that led to the party.
    """
    data = docs.where(F.col("doc_no").rlike(r"\.0\.6\.[0-9]+$")).select("id", "doc_no", parent_key(F.col("doc_no"), 3).alias("number"))
    data = data.join(by_number(docs, "number", "title").withColumnsRenamed({"found_id": "controller_id", "found_title": "controller"}), "number", "left")
    agents = by_number(docs, "agent_no").join(chains, F.col("found_id") == F.col("agent_id")).drop("found_id")
    data = data.withColumn("agent_no", F.nullif(F.regexp_extract("number", r"^(A\.6\.1\.1\.[0-9]+)\.", 1), F.lit(""))).join(agents, "agent_no", "left")
    held = edges.where("edge_type = 'responsible_party_for'").groupBy(F.col("to_id").alias("controller_id")).agg(F.min(F.struct("from_id", "meta")).alias("p"))
    held = held.select("controller_id", F.col("p.from_id").alias("party_id"), F.col("p.meta").alias("resolution")).join(entities.select(F.col("id").alias("party_id"), F.col("name").alias("party")), "party_id", "left")
    hops = F.when(F.col("resolution") == "chain", F.array("executor_source", F.coalesce(F.when(F.col("party_id") == F.col("govops_id"), F.col("govops_source")), F.when(F.col("party_id") == F.col("facilitator_id"), F.col("facilitator_source")))))
    evidence = F.array_compact(F.concat(F.array("number"), F.coalesce(hops, F.array().cast("array<string>"))))
    rows = data.join(held, "controller_id", "left").withColumn("evidence", F.array_join(evidence, " → "))
    return rows.select("id", "doc_no", "controller", F.coalesce("agent", F.lit("Governance")).alias("agent"), "party", "resolution", "facilitator", "evidence")


def recommendations(docs: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """id and advice: controllers without a responsible party, agents without an executor, agents without a primitive, offices that only governance gives."""
    ids = lambda kind, end: edges.where(F.col("edge_type").isin(*kind)).select(F.col(end).alias("id")).distinct()
    controllers = docs.where("type = 'Active Data Controller'").select("id").join(ids(("responsible_party_for",), "to_id"), "id", "left_anti").select("id", F.lit("no responsible party").alias("advice"))
    primes = entities.where("entity_type = 'agent' AND subtype = 'prime'").select("id")
    alone = primes.join(ids(("operational_executor_agent_for", "core_executor_agent_for"), "to_id"), "id", "left_anti").select("id", F.lit("no executor").alias("advice"))
    idle = primes.join(ids(("invoked_by",), "to_id"), "id", "left_anti").select("id", F.lit("no instance").alias("advice"))
    ruled = ids(("aligned_delegate_for", "ranked_delegate_for"), "from_id").select("id", F.lit("held by governance").alias("advice"))
    return controllers.unionByName(alone).unionByName(idle).unionByName(ruled)


def _numbers(content: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(pattern), F.lit(1))


def step_audit(processes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, steps and source of each process (id, doc_no, content, override): what is known of its steps, by the first source that has any.

    An override counts first; then sections one number below that are no annotations or
    data, different numbers of headings like Step 2, at least two numbered lines, numbers
    in parentheses as far as they run from 1, and at least three bullets. Null for none.
    """
    below = docs.where(F.col("doc_no").rlike(r"\.[0-9]+$") & ~F.col("doc_no").rlike(r"\.0\.[346]\.[0-9]+$")).groupBy(parent_key(F.col("doc_no"), 1).alias("doc_no")).agg(F.count("*").alias("children"))
    content = F.col("content")
    headings = F.size(F.array_distinct(_numbers(content, r"(?im)^#+[ \t]*(?:Step|Stage|Phase)[ \t]+([0-9]+)")))
    lines, bullets = F.size(_numbers(content, r"(?m)^([0-9]+)\.[ \t]")), F.size(_numbers(content, r"(?m)^([-*])[ \t]"))
    marks = _numbers(content, r"\(([0-9]+)\)")
    running = F.transform(marks, lambda x, i: x == (i + 1).cast("string"))
    stop = F.array_position(running, F.lit(False))
    run = F.when(stop > 0, stop - 1).otherwise(F.size(marks))
    known = [("override", F.col("override"), 1), ("children", F.col("children"), 1), ("step-headings", headings, 1), ("numbered-list", lines, 2), ("parenthesized", run, 2), ("bullets", bullets, 3)]
    told = F.lit(None).cast("struct<steps: bigint, source: string>")
    for source, n, least in reversed(known):
        told = F.when(n >= least, F.struct(n.cast("long").alias("steps"), F.lit(source).alias("source"))).otherwise(told)
    rows = processes.join(below, "doc_no", "left").select("id", told.alias("t"))
    return rows.select("id", "t.steps", F.coalesce("t.source", F.lit("none")).alias("source"))
