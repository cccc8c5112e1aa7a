"""Changed sections of change sets matched to the bullets that describe them.

Bullets and sections of one set meet on what they share: numbers and ids that a bullet
names, or words. Nothing is paired that shares nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import UUID, match_tokens, scrub

#: Numbers of sections in prose.
NUMBER = r"(?<![A-Za-z0-9.])A(?:\.[A-Za-z0-9]+)+"
# fixed values: the least score of a match by words, and the longest body that is a summary by itself
LEAST, SHORT = 0.35, 500


# fixed values: how many sections above lend their words to a section, by the segments of its number from one on; more segments, as the last
LENDING = (1, 1, 1, 2, 3, 3, 4, 5, 6)


def levels_above(depth: Column) -> Column:
    return F.get(F.array(*map(F.lit, LENDING)), F.least(depth, F.lit(len(LENDING))) - 1)


def _refs(text: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.regexp_extract_all(F.lower(text), F.lit(UUID), F.lit(0))))


def _prefixes(number: Column) -> Column:
    parts = F.split(number, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def scopes(bullets: DataFrame, agents: DataFrame) -> DataFrame:
    """set_id, bullet and prefix for agents (name, doc_no) that a bullet's title names; they meet on the words of the names."""
    words = lambda c: F.split(F.lower(c), "[^a-z0-9]+")
    first = agents.select("name", F.col("doc_no").alias("prefix"), F.get(F.filter(words(F.col("name")), lambda w: w != ""), F.lit(0)).alias("word"))
    met = bullets.select("set_id", "bullet", "title", F.explode(F.array_distinct(words(F.col("title")))).alias("word")).join(first, "word")
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))
    return met.where(F.contains(plain(F.col("title")), plain(F.col("name")))).select("set_id", "bullet", "prefix").distinct()


def attributed(bullets: DataFrame, nodes: DataFrame, docs: DataFrame, agents: DataFrame | None = None, harvested: DataFrame | None = None) -> DataFrame:
    """set_id, id, bullet, score (in percent) and via of changed sections (set_id, id, doc_no, title) that a bullet of their set describes.

    bullets: set_id, bullet (its place), title, description; docs: doc_no, title of all
    sections; agents: name, doc_no; harvested: set_id, ref, bullet for references outside
    of bullets. First come numbers and ids that a bullet names, then harvested ones, then
    words: hits of the section's own in title or description and of those above it in the
    title against its own, at least 0.35, where one own hit in a description or one from
    above does not count. A bullet with numbers, or with agents in its title, describes
    by words only sections under them. A set with one bullet gives it to all that are left.
    """
    told = bullets.withColumn("refs", _refs(F.concat_ws("\n", "title", "description")))
    named = told.select("set_id", "bullet", F.explode("refs").alias("ref"))
    keys = nodes.select("set_id", "id", F.explode(F.array_distinct(F.array("doc_no", "id"))).alias("ref"))
    by_ref = keys.join(named, ["set_id", "ref"]).groupBy("set_id", "id").agg(F.min("bullet").alias("bullet")).withColumns({"score": F.lit(100), "pass": F.lit(1), "via": F.lit("ref")})
    found = by_ref
    if harvested is not None:
        found = found.unionByName(keys.join(harvested, ["set_id", "ref"]).groupBy("set_id", "id").agg(F.min("bullet").alias("bullet")).withColumns({"score": F.lit(100), "pass": F.lit(2), "via": F.lit("ref")}))

    own = nodes.select("set_id", "id", "doc_no", F.explode(match_tokens(F.col("title"))).alias("token"), F.lit(True).alias("own"))
    depth = F.size(F.split("doc_no", r"\."))
    above = nodes.select("set_id", "id", "doc_no", F.explode(F.slice(_prefixes(F.col("doc_no")), F.greatest(F.lit(1), depth - levels_above(depth)), F.least(depth - 1, levels_above(depth)))).alias("up"))
    titles = docs.groupBy(F.col("doc_no").alias("up")).agg(F.max("title").alias("up_title"))
    lent = above.join(titles, "up").select("set_id", "id", "doc_no", F.explode(match_tokens(F.col("up_title"))).alias("token")).distinct().join(own.select("set_id", "id", "token"), ["set_id", "id", "token"], "left_anti").withColumn("own", F.lit(False))
    total = own.groupBy("set_id", "id").agg(F.count("*").alias("total"))
    said = told.select("set_id", "bullet", F.explode(match_tokens(F.col("title"))).alias("token"), F.lit(True).alias("in_title")).unionByName(told.select("set_id", "bullet", F.explode(match_tokens(F.col("description"))).alias("token"), F.lit(False).alias("in_title")))
    said = said.groupBy("set_id", "bullet", "token").agg(F.max("in_title").alias("in_title"))
    hits = own.unionByName(lent).join(said, ["set_id", "token"]).where("own OR in_title").groupBy("set_id", "id", "doc_no", "bullet").agg(F.count_if("own").alias("hits"), F.count_if(F.col("own") & F.col("in_title")).alias("title_hits"), F.count_if(~F.col("own")).alias("above"))
    scored = hits.where("title_hits > 0 OR hits >= 2 OR above >= 2").join(total, ["set_id", "id"]).withColumn("part", F.least(F.lit(1.0), (F.col("hits") + F.col("above")) / F.col("total"))).where(F.col("part") >= LEAST)

    limits = named.where(~F.col("ref").rlike(f"^{UUID}$")).select("set_id", "bullet", F.col("ref").alias("prefix"), F.lit("number").alias("kind"))
    if agents is not None:
        limits = limits.unionByName(scopes(bullets, agents).withColumn("kind", F.lit("agent")))
    inside = scored.select("set_id", "id", "bullet", F.explode(_prefixes(F.col("doc_no"))).alias("prefix")).join(limits, ["set_id", "bullet", "prefix"]).groupBy("set_id", "id", "bullet").agg(F.count_distinct("kind").alias("kept"))
    limited = limits.groupBy("set_id", "bullet").agg(F.count_distinct("kind").alias("kinds"))
    free = scored.join(limited, ["set_id", "bullet"], "left").join(inside, ["set_id", "id", "bullet"], "left").where("kinds IS NULL OR kinds = kept")
    best = free.groupBy("set_id", "id").agg(F.min(F.struct((-F.col("part")).alias("p"), "bullet")).alias("b"))
    found = found.unionByName(best.select("set_id", "id", F.col("b.bullet").alias("bullet"), F.round(-F.col("b.p") * 100).cast("int").alias("score"), F.lit(3).alias("pass"), F.lit("fuzzy").alias("via")))
    sole = bullets.groupBy("set_id").agg(F.count("*").alias("n"), F.min("bullet").alias("bullet")).where("n = 1").drop("n")
    found = found.unionByName(nodes.select("set_id", "id").join(sole, "set_id").select("set_id", "id", "bullet", F.lit(0).alias("score"), F.lit(4).alias("pass"), F.lit("sole-bullet").alias("via")))
    first = F.row_number().over(Window.partitionBy("set_id", "id").orderBy("pass"))
    return found.withColumn("n", first).where("n = 1").select("set_id", "id", "bullet", "score", "via")


def match_rates(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """set_id, changed, matched and rate of each change set."""
    both = nodes.select("set_id", "id").join(matches.select("set_id", "id", F.lit(True).alias("hit")), ["set_id", "id"], "left")
    return both.groupBy("set_id").agg(F.count("*").alias("changed"), F.count_if("hit").alias("matched")).withColumn("rate", F.col("matched") / F.col("changed"))


def summaries(nodes: DataFrame, matches: DataFrame, bullets: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id, id, summary and description of changed sections: their bullet's, else a set's own (set_id, title, body) if it has no bullets and a short body."""
    text = bullets.select("set_id", "bullet", F.col("title").alias("b_title"), F.col("description").alias("b_text"))
    own = sets.join(bullets.select("set_id").distinct(), "set_id", "left_anti").where((F.length("body") > 0) & (F.length("body") < SHORT))
    rows = nodes.select("set_id", "id").join(matches.select("set_id", "id", "bullet"), ["set_id", "id"], "left").join(text, ["set_id", "bullet"], "left").join(own, "set_id", "left")
    return rows.select("set_id", "id", F.coalesce("b_title", "title").alias("summary"), scrub(F.when(F.col("b_title").isNotNull(), F.col("b_text")).otherwise(F.col("body"))).alias("description"))


def relabelled(events: DataFrame, commits: DataFrame, phrase: str = "migrate to markdown") -> DataFrame:
    """Events (commit_hash, change_type, ...) with additions of commits (commit_hash, message) whose message has the phrase's words in order told as moves."""
    words = ".*".join(phrase.split())
    moved = commits.where(F.lower("message").rlike(f"(?s){words}")).select("commit_hash", F.lit(True).alias("_moved")).distinct()
    kind = F.when(F.col("_moved") & (F.col("change_type") == "added"), "moved").otherwise(F.col("change_type"))
    return events.join(moved, "commit_hash", "left").withColumn("change_type", kind).drop("_moved")

