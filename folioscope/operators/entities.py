"""Entities of sections by a table of rules, and parameters of configured instances.

A rule says which sections it looks at (by number or title), how names come out of a
section, what they are, and its phase. All rules run in one pass over the sections; of
names with one slug the earliest phase and order stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import assignment, bullet_items, slugify
from .extraction import first_entities
from .parameters import directory, expanded


def title_names(prefix: str = "") -> Callable[[], Column]:
    return lambda: F.array(F.trim(F.regexp_replace("title", f"(?i)^{prefix}", "")) if prefix else F.trim("title"))


def sentence_names(subject: str) -> Callable[[], Column]:
    return lambda: F.array(assignment(F.col("content"), subject))


def listed_names() -> Column:
    return bullet_items(F.col("content"))


def recipient_names() -> Column:
    return F.array(F.nullif(F.trim(F.regexp_extract("content", r"(?i)Recipient:\s*([^\n]+)", 1)), F.lit("")))


@dataclass(frozen=True)
class EntityRule:
    phase: int
    column: str
    pattern: str
    names: Callable[[], Column]
    entity_type: str
    subtype: str | None = None
    own_id: bool = False  # the entity has its section's id


# fixed values: which sections name which entities
ENTITY_RULES = (
    EntityRule(1, "doc_no", r"^A\.6\.1\.1\.[0-9]+$", title_names(), "agent", "prime", True),
    EntityRule(2, "doc_no", r"^A\.6\.1\.2\.[0-9]+$", title_names(r"Operational Executor Agent\s+"), "agent", "executor", True),
    EntityRule(3, "doc_no", r"^A\.6\.1\.2\.[0-9]+\.1$", sentence_names(r"(?:The )?(?:(?:Operational|Core) (?:Executor )?)?Facilitator for [^.]+"), "facilitator_org"),
    EntityRule(4, "doc_no", r"^A\.6\.1\.2\.[0-9]+\.2$", sentence_names(r"(?:(?:Operational|Core) )?GovOps for [^.]+"), "govops_org"),
    EntityRule(5, "doc_no", r"^A\.1\.8\.1\.2\.2\.0\.6\.1$", listed_names, "ecosystem_actor"),
    EntityRule(6, "doc_no", r"^A\.1\.5\.1\.5\.0\.6\.1$", listed_names, "delegate_org"),
    EntityRule(7, "doc_no", r"^A\.2\.13\.1\.[0-9]+\.[0-9]+$", recipient_names, "ecosystem_actor"),
)


def entities_of(docs: DataFrame, rules: tuple[EntityRule, ...] = ENTITY_RULES) -> DataFrame:
    """slug, name, entity_type, subtype, id (the section's, where the rule says so) and defining_doc_id."""
    found = F.flatten(F.array(*[
        F.when(F.col(r.column).rlike(r.pattern), _named(r)).otherwise(F.array().cast(_SHAPE)) for r in rules
    ]))
    rows = docs.select("id", "ord", F.explode(found).alias("e")).where("e.name IS NOT NULL AND e.name <> ''")
    core = F.col("e.name").rlike("(?i)^Core Council Executor Agent")
    subtype = F.when(F.col("e.subtype") == "executor", F.when(core, "core_executor").otherwise("operational_executor")).otherwise(F.col("e.subtype"))
    kind = F.when((F.col("e.entity_type") == "ecosystem_actor") & F.col("e.name").rlike(r"(?i)\bFoundation\b"), "foundation").otherwise(F.col("e.entity_type"))
    candidates = rows.select(
        slugify(F.col("e.name")).alias("slug"), F.col("e.name").alias("name"), kind.alias("entity_type"), subtype.alias("subtype"),
        F.when(F.col("e.own_id"), F.col("id")).alias("id"), F.col("id").alias("defining_doc_id"), F.col("e.phase").alias("phase"), "ord",
    )
    return first_entities(candidates).drop("phase", "ord")


_SHAPE = "array<struct<name: string, entity_type: string, subtype: string, own_id: boolean, phase: int>>"


def _named(rule: EntityRule) -> Column:
    shape = lambda n: F.struct(n.alias("name"), F.lit(rule.entity_type).alias("entity_type"), F.lit(rule.subtype).cast("string").alias("subtype"), F.lit(rule.own_id).alias("own_id"), F.lit(rule.phase).alias("phase"))
    return F.transform(rule.names(), shape)


def instance_params(docs: DataFrame, instances: DataFrame) -> DataFrame:
    """id, key, value and src_id of the leaves below an instance's section titled Parameters.

    instances: id, doc_no. Subtrees titled Custom Instance Parameters are left out, as are
    empty leaves and those that only point below. Values are formatted by title; a leaf of
    addresses by chain or of items '- `key`: value' gives one row for each; of rows with one
    key the later ones are named by their parent's title as well.
    """
    parts = F.split("doc_no", r"\.")
    homes = docs.where("title = 'Parameters'").select(F.regexp_replace("doc_no", r"\.[^.]*$", "").alias("doc_no"), F.col("doc_no").alias("home")).join(instances, "doc_no").select("id", "home")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    nodes = docs.select("doc_no", "title", "content", "ord", F.col("id").alias("src_id"), F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>")).alias("above"))
    custom = docs.where(F.col("title").rlike("(?i)^custom instance parameters$")).select(F.col("doc_no").alias("a"))
    under = nodes.withColumn("a", F.explode("above"))
    inner = under.select(F.regexp_replace("doc_no", r"\.[^.]*$", "").alias("doc_no")).distinct()
    leaves = under.join(homes, F.col("a") == F.col("home")).drop("a").join(inner, "doc_no", "left_anti")
    hidden = under.join(custom, "a", "left_semi").select("doc_no").distinct()
    leaves = leaves.join(hidden, "doc_no", "left_anti").where((F.trim(F.coalesce("content", F.lit(""))) != "") & ~directory(F.col("content")))
    keyed = expanded(F.col("title"), F.trim("content"))
    titles = docs.select(F.col("doc_no").alias("up"), F.col("title").alias("up_title"))
    rows = leaves.withColumn("up", F.element_at("above", -1)).join(titles, "up", "left").select("id", "src_id", "ord", "up_title", F.size("above").alias("depth"), F.posexplode(keyed).alias("n", "p")).select("*", "p.*")
    nth = F.row_number().over(Window.partitionBy("id", "key").orderBy("depth", "ord", "n"))
    return rows.withColumn("nth", nth).select("id", F.when(F.col("nth") > 1, F.concat_ws(" / ", "up_title", "key")).otherwise(F.col("key")).alias("key"), "value", "src_id")


def primitive_status(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """id and status of primitives (id, doc_no): the first of three words in the section .1.1 below."""
    told = docs.where(F.col("doc_no").endswith(".1.1"))
    status = told.select(F.regexp_replace("doc_no", r"\.1\.1$", "").alias("doc_no"), F.nullif(F.initcap(F.regexp_extract("content", "(?i)(Active|Inactive|Completed)", 1)), F.lit("")).alias("status"))
    return roots.join(status, "doc_no", "left").select("id", "status")
