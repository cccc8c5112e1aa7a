"""Sections as a tree, by their dotted numbers and by their parents.

Dotted numbers name all ancestors, so a chain is an explode and one equi join at any
depth. Parents are followed by jumps that double: chains of up to 2^k hops are joined to
those of the ancestors at 2^k hops, so a tree of any depth takes its logarithm of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import links
from ..session import stored

#: Rounds of doubled jumps; a chain beyond 2^24 hops is a cycle of parents.
MOST_ROUNDS = 24
#: Levels that are climbed one by one.
MOST_LEVELS = 1000


def number_ancestors(docs: DataFrame, shortest: int = 2) -> DataFrame:
    """id, ancestor_id and ancestor_no for each proper prefix of a number that is a section; notes (NR-) have none."""
    parts = F.split("doc_no", r"\.")
    prefix = F.transform(F.sequence(F.lit(shortest), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    own = docs.where(~F.col("doc_no").startswith("NR-") & (F.size(parts) > shortest)).select("id", F.explode(prefix).alias("ancestor_no"))
    # of sections with one number the last counts
    by_no = docs.groupBy(F.col("doc_no").alias("ancestor_no")).agg(F.max_by("id", "ord").alias("ancestor_id"))
    return own.join(by_no, "ancestor_no").select("id", "ancestor_id", "ancestor_no")


def parent_chain(docs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, hop (1 for the parent) and ancestor_id, by parents, up to the root at any depth; for some ids or all."""
    up = docs.where("parent_id IS NOT NULL").select("id", F.lit(1).cast("long").alias("hop"), F.col("parent_id").alias("ancestor_id"))
    chain = stored(up, "chain")
    for k in range(MOST_ROUNDS):
        far = chain.where(F.col("hop") == 1 << k)
        if far.isEmpty():
            break
        on = chain.select(F.col("id").alias("at"), F.col("hop").alias("more"), F.col("ancestor_id").alias("above"))
        further = far.join(on, F.col("ancestor_id") == F.col("at")).select("id", (F.col("hop") + F.col("more")).alias("hop"), F.col("above").alias("ancestor_id"))
        chain = stored(chain.unionByName(further), "chain")
    else:
        raise ValueError("parents form a cycle")
    chain = chain.withColumn("hop", F.col("hop").cast("int"))
    return chain if ids is None else chain.join(ids, "id", "left_semi")


def subtree(docs: DataFrame, root: str) -> DataFrame:
    """Ids of a section and all below it, by parents: each level joins the one above it, so nothing outside is touched."""
    kids = docs.where("parent_id IS NOT NULL").select("id", "parent_id")
    found = level = docs.where(F.col("id") == root).select("id").distinct()
    while True:
        # a section that is its own ancestor is met again at the root alone
        level = stored(kids.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").where(F.col("id") != root).select("id").distinct(), "level")
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def climb(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, hop (0 for itself) and ancestor_id of some ids alone, one join for each level above them."""
    up = docs.where("parent_id IS NOT NULL").select(F.col("id").alias("ancestor_id"), F.col("parent_id").alias("above"))
    found = level = stored(ids.select("id").distinct().withColumns({"hop": F.lit(0), "ancestor_id": F.col("id")}), "climbed")
    for _ in range(MOST_LEVELS):
        level = stored(level.join(up, "ancestor_id").where(F.col("above") != F.col("id")).select("id", (F.col("hop") + 1).alias("hop"), F.col("above").alias("ancestor_id")), "climbed")
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError("parents form a cycle")


def closest_flagged(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """id, hop and ancestor_id of the nearest ancestor among flagged (id).

    Each section knows how far it has looked and what it found; what is still open takes over
    what the section at the end of its reach knows, so the reach doubles and there is one row for each section.
    """
    flag = flagged.select(F.col("id").alias("parent_id"), F.lit(True).alias("is_flagged")).distinct()
    state = docs.where("parent_id IS NOT NULL").select("id", "parent_id").join(flag, "parent_id", "left")
    state = stored(state.select("id", F.lit(1).cast("long").alias("hop"), F.col("parent_id").alias("to"), F.coalesce("is_flagged", F.lit(False)).alias("found")), "reach")
    done = state.where("found")
    for _ in range(MOST_ROUNDS):
        further = state.select(F.col("id").alias("to"), F.col("hop").alias("more"), F.col("to").alias("next"), F.col("found").alias("there"))
        open_ = state.where("NOT found").join(further, "to").select("id", (F.col("hop") + F.col("more")).alias("hop"), F.col("next").alias("to"), F.col("there").alias("found"))
        state = stored(open_.unionByName(done), "reach")
        if state.where("NOT found").isEmpty():
            return state.select("id", F.col("hop").cast("int").alias("hop"), F.col("to").alias("ancestor_id"))
        done = state.where("found")
    raise ValueError("parents form a cycle")


def children(docs: DataFrame) -> DataFrame:
    """parent_id with the ids of its children in order."""
    kids = F.sort_array(F.collect_list(F.struct("ord", "id")))
    return docs.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.transform(kids, lambda k: k["id"]).alias("children"))


def around(docs: DataFrame, node: str, width: int) -> DataFrame:
    """relation and id of a section's parent, first 2 * width siblings and children."""
    me = docs.where(F.col("id") == node).select(F.col("parent_id").alias("p"))
    up = me.where("p IS NOT NULL").select(F.lit("parent").alias("relation"), F.col("p").alias("id"))
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("ord", "id"))
    siblings = docs.join(me, F.col("parent_id") == F.col("p"), "left_semi").where(F.col("id") != node)
    siblings = siblings.withColumn("n", rank).where(F.col("n") <= 2 * width).select(F.lit("sibling").alias("relation"), "id")
    below = docs.where(F.col("parent_id") == node).select(F.lit("child").alias("relation"), "id")
    return up.unionByName(siblings).unionByName(below)


def display_parent(docs: DataFrame) -> DataFrame:
    """id and display_parent_id: the section a supporting marker or variation belongs to, else that of the number without its last segment, else the parent."""
    no = F.col("doc_no")
    supported = F.regexp_extract(no, r"^(.*)\.0\.[346]\.[^.]+$", 1)
    varied = F.regexp_extract(no, r"^(.*)\.var[^.]*$", 1)
    shorter = F.regexp_extract(no, r"^(.*)\.[^.]+$", 1)
    key = F.when(supported != "", supported).when(varied != "", varied).when(shorter != "", shorter)
    by_no = docs.groupBy(F.col("doc_no").alias("key")).agg(F.max_by("id", "ord").alias("by_number"))
    return docs.withColumn("key", key).join(by_no, "key", "left").select("id", F.coalesce("by_number", "parent_id").alias("display_parent_id"))


def under_prefixes(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of docs with the columns of prefixes (prefix, ...) for each prefix that they are or stand under."""
    parts = F.split("doc_no", r"\.")
    every = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))
    return docs.withColumn("prefix", every).join(prefixes, "prefix")


def integrity(docs: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """problem and n: dangling ends by type, orphan parents and slugs given twice."""
    nodes = docs.select(F.lit("doc").alias("t"), F.col("id").alias("i")).unionByName(entities.select(F.lit("entity").alias("t"), F.col("id").alias("i"))).distinct()
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_type").alias("t"), F.col("from_id").alias("i")), F.struct(F.col("to_type").alias("t"), F.col("to_id").alias("i")))).alias("e")).select("e.*")
    dangling = ends.join(nodes, ["t", "i"], "left_anti").groupBy(F.concat(F.lit("dangling "), F.col("t")).alias("problem")).agg(F.count("*").alias("n"))
    orphans = docs.where("parent_id IS NOT NULL").join(docs.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan parent").alias("problem"), "n")
    twice = entities.groupBy("slug").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("slug given twice").alias("problem"), "n")
    return dangling.unionByName(orphans).unionByName(twice)


def unresolved(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """problem and n: links in texts to ids that no section has, edges whose evidence (source) is no section's number, and numbers given twice.

    A text counts once for each id it links to; edges without evidence are no fault. Targets
    are counted before they are joined, so that one that very many name is one row.
    """
    def lost(told: DataFrame, key: str, problem: str) -> DataFrame:
        known = docs.select(F.col(key).alias("k")).distinct()
        return told.groupBy("k").agg(F.count("*").alias("n")).join(known, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(problem).alias("problem"), "n")

    linked = lost(docs.select(F.explode(links(F.col("content"))).alias("k")), "id", "link to nothing")
    evidence = lost(edges.where("source IS NOT NULL").select(F.col("source").alias("k")), "doc_no", "evidence of nothing")
    twice = docs.where("doc_no IS NOT NULL").groupBy("doc_no").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("number given twice").alias("problem"), "n")
    return linked.unionByName(evidence).unionByName(twice)
