"""Reports over sections, entities and edges, and the query that joins all conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bounded, natural_key
from ..operators import filters, graph

#: Words that make a sentence a duty.
MODAL = r"(?i)(?<![A-Za-z])(?:must|shall|should|will|may not|is responsible)(?![A-Za-z])"


def responsibility(edges: DataFrame, edge_type: str, holder: Column, member: Column) -> DataFrame:
    """member, place and party of members that edges of a type put in one place with holders, the first of whom is the party."""
    located = edges.where(F.col("edge_type") == edge_type)
    party = graph.picked(located.where(holder), "to_id", "from_id", F.col("from_id"), last=False)
    of = located.where(member).select(F.col("from_id").alias("member"), F.col("to_id").alias("place"))
    return of.join(party.select(F.col("to_id").alias("place"), F.col("from_id").alias("party")), "place").select("member", "place", "party")


def active_data(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """id, controller (its parent's title) and duties of each section of active data."""
    duties = edges.where("edge_type = 'responsible_party_for'").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("duties"))
    parents = docs.select(F.col("id").alias("parent_id"), F.col("title").alias("controller"))
    rows = docs.where("type = 'Active Data'").select("id", "parent_id").join(parents, "parent_id", "left").join(duties, "id", "left")
    return rows.select("id", "controller", F.coalesce("duties", F.lit(0)).alias("duties"))


def step_counts(processes: DataFrame, docs: DataFrame, numbered: str, least: int = 3) -> DataFrame:
    """id, steps and what they are counted by: children, else at least so many places of a pattern in the text."""
    kids = docs.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("kids"))
    rows = processes.withColumn("places", F.regexp_count("content", F.lit(numbered))).join(kids, "id", "left")
    by = F.when(F.col("kids").isNotNull(), "children").when(F.col("places") >= least, "numbers").otherwise("none")
    return rows.select("id", F.coalesce("kids", F.when(F.col("places") >= least, F.col("places")), F.lit(0)).cast("long").alias("steps"), by.alias("counted_by"))


def sidebar(entities: DataFrame, groups: list[str]) -> DataFrame:
    """Entities with the number of their type's group, in natural order."""
    grp = F.lit(len(groups))
    for k, name in reversed(list(enumerate(groups))):
        grp = F.when(F.col("entity_type") == name, k).otherwise(grp)
    return entities.withColumn("grp", grp)


def seeded_counts(agents: DataFrame, facts: DataFrame, kind: str) -> DataFrame:
    """agent, kind and n for every agent and every kind there is, zero where there is no fact."""
    kinds = facts.select(kind).distinct()
    counts = facts.groupBy("agent_id", kind).agg(F.count("*").alias("n"))
    # a row for each agent and kind is the report itself
    return agents.join(kinds).join(counts, ["agent_id", kind], "left").select("agent", kind, F.coalesce("n", F.lit(0)).alias("n"))


# fixed values: statuses of instances that are counted, and what invocations are counted as
STATUSES, INVOKED = ("Active", "Suspended", "Completed"), "invocation"


def status_statistics(agents: DataFrame, primitives: DataFrame, facts: DataFrame, categories: list[str], most_names: int = 100) -> DataFrame:
    """agent_id, category, primitive, status, n, names and level: counts at every level of a report, zeros included.

    facts: agent_id, category, primitive, status, name of instances (``STATUSES``) and
    invocations (status ``invocation``); others count nowhere, and facts of agents that are
    not among agents (agent_id) neither. Every agent has every category given, every one of its
    primitives (agent_id, category, primitive) and all statuses, with 0 where there is no
    fact; categories beyond those given come in with their facts. level is ``primitive``,
    ``category``, ``agent``, ``all categories`` (by category over all agents) or ``all``;
    what a level sums over is null. Null categories are Unknown. names are the first ``most_names``
    of a primitive's status in their order; the other levels have none.
    """
    states = F.explode(F.array(*[F.lit(s) for s in (*STATUSES, INVOKED)])).alias("status")
    category = F.coalesce("category", F.lit("Unknown")).alias("category")
    facts = facts.where(F.col("status").isin(*STATUSES, INVOKED) & F.col("primitive").isNotNull()).select("agent_id", category, "primitive", "status", "name").join(agents.select("agent_id").distinct(), "agent_id", "left_semi")
    # seeds are rows that count nothing, so that each level has its zeros
    seeds = primitives.join(agents.select("agent_id").distinct(), "agent_id", "left_semi").select("agent_id", category, "primitive", states)
    empty = agents.select("agent_id", F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"), F.lit(None).cast("string").alias("primitive")).select("*", states)
    rows = facts.select("agent_id", "category", "primitive", "status", F.lit(1).alias("one")).unionByName(seeds.unionByName(empty).withColumn("one", F.lit(0)))
    keys = [F.col(c) for c in ("agent_id", "category", "primitive", "status")]
    agent, kind, primitive, status = keys
    sums = rows.groupingSets([keys, [agent, kind, status], [agent, status], [kind, status], [status]], *keys).agg(F.sum("one").alias("n"), F.grouping_id().alias("gid"))
    # the bits of a grouping id are the columns summed over, agent first
    level = F.when(F.col("gid") == 0, "primitive").when(F.col("gid") == 2, "category").when(F.col("gid") == 6, "agent").when(F.col("gid") == 10, "all categories").otherwise("all")
    sums = sums.withColumn("level", level).where("level <> 'primitive' OR primitive IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("agent_id", "category", "primitive", "status").orderBy("name"))
    named = facts.where("name IS NOT NULL").withColumn("place", place).where(F.col("place") <= most_names)
    named = named.groupBy("agent_id", "category", "primitive", "status").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda p: p["name"]).alias("names")).withColumn("level", F.lit("primitive"))
    on = F.lit(True)
    for c in ("agent_id", "category", "primitive", "status", "level"):
        on &= F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
    both = sums.alias("s").join(named.alias("n"), on, "left")
    return both.select("s.agent_id", "s.category", "s.primitive", "s.status", F.col("s.n").alias("n"), F.coalesce("n.names", F.array().cast("array<string>")).alias("names"), "s.level")


def enriched(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """id, parent_title and the number of children of hits."""
    kids = docs.join(hits.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_params"))
    parents = docs.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    rows = hits.select("id", "parent_id").join(parents, "parent_id", "left").join(kids, "id", "left")
    return rows.select("id", "parent_title", F.coalesce("n_params", F.lit(0)).alias("n_params"))


def child_params(children: DataFrame) -> DataFrame:
    """id and params, a map of the titles of a section's children to their contents; of children with one title the last counts."""
    last = children.groupBy("parent_id", "title").agg(F.max_by("content", "ord").alias("content"))
    pairs = F.collect_list(F.struct("title", "content"))
    return last.groupBy(F.col("parent_id").alias("id")).agg(F.map_from_entries(pairs).alias("params"))


def ask(v, entity: str | None = None, edge_type: str | None = None, doc_type: str | None = None, under: str | None = None, since: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Sections that meet all conditions given, in order of their numbers; v has docs, edges and history.

    An entity gives its sections, by an edge type or all; without one all sections are
    looked at. A condition that is not given lets all pass.
    """
    docs = v.docs
    if entity is not None:
        mine = graph.entity_docs(v.edges, entity, edge_type).select(F.col("doc_id").alias("id"))
        docs = docs.join(mine, "id", "left_semi")
    if doc_type is not None:
        docs = docs.where(F.col("type") == doc_type)
    if under is not None:
        docs = docs.where(filters.in_scope(F.col("doc_no"), under))
    if status is not None:
        docs = docs.where(filters.phrase(F.col("title"), F.col("content"), status))
    if since is not None:
        docs = filters.constrained(docs, "id", filters.changed_ids(v.history, since=since))
    return docs.orderBy("doc_no", "id").limit(limit)


def rewards(instances: DataFrame, params: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Instances (id, agent, kind, status) with a column for each parameter key (params: id, key, value), null where it is not set."""
    columns = [F.max(F.when(F.col("key") == key, F.col("value"))).alias(name) for name, key in keys.items()]
    return instances.join(params.groupBy("id").agg(*columns), "id", "left")


def duties(docs: DataFrame, edges: DataFrame, subject: str) -> DataFrame:
    """id, route and snippet of what a facilitator is answerable for: sections it is responsible for, those that define it, and those whose text obliges it."""
    own = graph.entity_docs(edges, subject).select(F.col("doc_id").alias("id"), F.when(F.col("edge_type") == "responsible_party_for", "responsible").otherwise("linked").alias("route"))
    titled = docs.join(own, "id").select("id", "route", duty_snippet(F.col("content"), subject).alias("snippet"))
    told = docs.where(F.col("content").rlike(rf"(?i){bounded(subject)}") & F.col("content").rlike(MODAL)).select("id", F.lit("text").alias("route"), duty_snippet(F.col("content"), subject).alias("snippet"))
    return titled.unionByName(told)


def duty_snippet(content: Column, subject: str, width: int = 200) -> Column:
    """The first sentence with the subject and a word of duty, else the first with the subject, else the first, without links and marks."""
    plain = F.regexp_replace(F.regexp_replace(content, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`#]", "")
    sentences = F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    about = F.filter(sentences, lambda x: x.rlike(rf"(?i){bounded(subject)}"))
    bound = F.filter(about, lambda x: x.rlike(MODAL))
    best = F.coalesce(F.get(bound, F.lit(0)), F.get(about, F.lit(0)), F.get(sentences, F.lit(0)), F.lit(""))
    return F.when(F.length(best) > width, F.concat(F.substring(best, 1, width), F.lit("…"))).otherwise(best)


def decided(decisions: DataFrame, docs: DataFrame, curated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected decisions (id, action, category, reason): ids must be known, new and given once, with a category to add or a reason to ignore."""
    known = docs.select("id", F.lit(True).alias("known")).distinct()
    had = curated.select("id", F.lit(True).alias("had")).distinct()
    times = decisions.groupBy("id").agg(F.count("*").alias("times"))
    rows = decisions.join(known, "id", "left").join(had, "id", "left").join(times, "id", "left")
    fault = (
        F.when(F.col("known").isNull(), "unknown id").when(F.col("had"), "already there").when(F.col("times") > 1, "given twice")
        .when((F.col("action") == "add") & F.col("category").isNull(), "no category").when((F.col("action") == "ignore") & F.col("reason").isNull(), "no reason")
    )
    rows = rows.withColumn("fault", fault).drop("known", "had", "times")
    return rows.where("fault IS NULL").drop("fault"), rows.where("fault IS NOT NULL")


def in_order(docs: DataFrame) -> DataFrame:
    return docs.orderBy(natural_key(F.col("doc_no")), "id")
