"""Edges, paths and neighbourhoods of a graph of sections and entities.

A node is named by its type and id, as a section and the entity that it defines share an
id. Traversals are a fixed small number of joins, each followed by one aggregation that
keeps a node's least depth, so the frontier never repeats a node; each hop's frontier is
written to the shared folder, so that plans stay short and no hop is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

MOST_HOPS = 4


def labelled(edges: DataFrame, entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges with from_label and to_label: an entity's name, else a section's title, else the id."""
    names = entities.select(F.col("id").alias("n_id"), F.lit("entity").alias("n_type"), F.col("name").alias("label"))
    titles = docs.select(F.col("id").alias("n_id"), F.lit("doc").alias("n_type"), F.col("title").alias("label"))
    nodes = names.unionByName(titles)
    for end in ("from", "to"):
        side = nodes.select(F.col("n_id").alias(f"{end}_id"), F.col("n_type").alias(f"{end}_type"), F.col("label").alias(f"{end}_label"))
        edges = edges.join(side, [f"{end}_id", f"{end}_type"], "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", f"{end}_id"))
    return edges


def touching(edges: DataFrame, node_type: str, node_id: str) -> DataFrame:
    """Edges out of and into a node with their direction and the other end."""
    out = edges.where((F.col("from_type") == node_type) & (F.col("from_id") == node_id)).select("edge_type", F.lit("outbound").alias("direction"), F.col("to_type").alias("other_type"), F.col("to_id").alias("other_id"))
    into = edges.where((F.col("to_type") == node_type) & (F.col("to_id") == node_id)).select("edge_type", F.lit("inbound").alias("direction"), F.col("from_type").alias("other_type"), F.col("from_id").alias("other_id"))
    return out.unionByName(into)


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Pairs a_type, a_id, b_type, b_id that one hop leads from and to."""
    out = edges.select(F.col("from_type").alias("a_type"), F.col("from_id").alias("a_id"), F.col("to_type").alias("b_type"), F.col("to_id").alias("b_id"))
    into = edges.select(F.col("to_type").alias("a_type"), F.col("to_id").alias("a_id"), F.col("from_type").alias("b_type"), F.col("from_id").alias("b_id"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """node_type, node_id and depth (least number of hops, 0 for seeds) of what up to ``MOST_HOPS`` hops reach.

    seeds: node_type, node_id. Every node type is passed through.
    """
    if not 0 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be from 0 to {MOST_HOPS}")
    ends = edges.select("from_type", "from_id", "to_type", "to_id")
    found = seeds.select("node_type", "node_id", F.lit(0).alias("depth")).distinct()
    frontier = found
    for hop in range(1, hops + 1):
        legs = []
        for a, b, taken in (("from", "to", direction != "in"), ("to", "from", direction != "out")):
            if taken:  # edges at the frontier alone are kept before anything is made distinct
                at = frontier.select(F.col("node_type").alias(f"{a}_type"), F.col("node_id").alias(f"{a}_id"))
                legs.append(ends.join(at, [f"{a}_type", f"{a}_id"], "left_semi").select(F.col(f"{b}_type").alias("node_type"), F.col(f"{b}_id").alias("node_id")))
        there = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
        frontier = stored(there.distinct().join(found.select("node_type", "node_id"), ["node_type", "node_id"], "left_anti").withColumn("depth", F.lit(hop)), "frontier")
        found = found.unionByName(frontier)
    return found


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node_type, node_id)."""
    for end in ("from", "to"):
        edges = edges.join(nodes.select(F.col("node_type").alias(f"{end}_type"), F.col("node_id").alias(f"{end}_id")), [f"{end}_type", f"{end}_id"], "left_semi")
    return edges


def degrees(edges: DataFrame) -> DataFrame:
    """Edges of each node, both ends counted."""
    ends = F.explode(F.array(F.struct(F.col("from_type").alias("t"), F.col("from_id").alias("i")), F.struct(F.col("to_type").alias("t"), F.col("to_id").alias("i"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.t").alias("node_type"), F.col("e.i").alias("node_id")).agg(F.count("*").alias("degree"))


def entity_docs(edges: DataFrame, entity_id: str | None = None, edge_type: str | None = None) -> DataFrame:
    """entity_id, doc_id and edge_type of edges between an entity and a section, either way round."""
    if edge_type is not None:
        edges = edges.where(F.col("edge_type") == edge_type)
    out = edges.where("from_type = 'entity' AND to_type = 'doc'").select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("doc_id"), "edge_type")
    into = edges.where("from_type = 'doc' AND to_type = 'entity'").select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("doc_id"), "edge_type")
    both = out.unionByName(into)
    return both if entity_id is None else both.where(F.col("entity_id") == entity_id)


def two_hops(edges: DataFrame, entities: DataFrame, entity_id: str, through: str) -> DataFrame:
    """Sections of the entities of a type that an entity is linked with."""
    step = steps(edges.where("from_type = 'entity' AND to_type = 'entity'")).where(F.col("a_id") == entity_id)
    of_type = entities.where(F.col("entity_type") == through).select(F.col("id").alias("b_id"))
    middle = step.join(of_type, "b_id", "left_semi").select(F.col("b_id").alias("entity_id"))
    return entity_docs(edges).join(middle, "entity_id", "left_semi")


def picked(edges: DataFrame, key: str, value: str, order: Column, last: bool = True) -> DataFrame:
    """One value for each key: that of the last (or first) edge in an order."""
    pick = F.max_by(value, order) if last else F.min_by(value, order)
    return edges.groupBy(key).agg(pick.alias(value))


# fixed values: types of entities that have a page of their own, and those that share the page of the party that comprises them
OWN_PAGES, SHARING = ("agent", "facilitator_org", "govops_org"), ("composite_party", "foundation", "development_company")


def participant_links(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind (actor or doc), target and resolved_by of each entity (id, slug, entity_type, defining_doc_id) that can be linked to.

    First the edges ``comprises`` lead composite parties to the page of their agent, then they
    lead foundations and companies to the page that their party got in the first pass; an
    entity of a type with pages has its own, and what is left is linked to the section that
    defines it, if there is one. Of several agents or parties the one with the least slug counts. Repeated edges
    count once, edges with an end that is no entity here not at all.
    """
    ends = edges.where("edge_type = 'comprises' AND from_type = 'entity' AND to_type = 'entity'").select("from_id", "to_id").distinct()
    parties = entities.where("entity_type = 'composite_party'").select(F.col("id").alias("from_id"), F.col("slug").alias("party"))
    held = ends.join(parties, "from_id")
    agents = entities.where("entity_type = 'agent'").select(F.col("id").alias("to_id"), F.col("slug").alias("agent"))
    first = held.join(agents, "to_id").groupBy("from_id").agg(F.min("agent").alias("target"))
    sharing = entities.where(F.col("entity_type").isin(*SHARING)).select(F.col("id").alias("to_id"))
    second = held.join(first, "from_id").join(sharing, "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.min_by("target", F.struct("party", "target")).alias("by_party"))
    rows = entities.select("id", "slug", "entity_type", "defining_doc_id").join(first.select(F.col("from_id").alias("id"), F.col("target").alias("by_agent")), "id", "left").join(second, "id", "left")
    own = F.when(F.col("entity_type").isin(*OWN_PAGES), F.col("slug"))
    target = F.coalesce("by_party", "by_agent", own, "defining_doc_id")
    by = F.when(F.col("by_party").isNotNull(), "party").when(F.col("by_agent").isNotNull(), "agent").when(own.isNotNull(), "own").otherwise("document")
    return rows.select("id", F.when(by == "document", "doc").otherwise("actor").alias("kind"), target.alias("target"), by.alias("resolved_by")).where("target IS NOT NULL")
