"""Predicates over sections, entities, edges and change events, as columns or filtered tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded

# fixed values: section numbers and titles that say what a section is
STRUCTURE: dict[str, tuple[str, str]] = {
    "prime_agent": ("doc_no", r"^A\.6\.1\.1\.[0-9]+$"),
    "executor_agent": ("doc_no", r"^A\.6\.1\.2\.[0-9]+$"),
    "facilitator": ("doc_no", r"^A\.6\.1\.2\.[0-9]+\.1$"),
    "govops": ("doc_no", r"^A\.6\.1\.2\.[0-9]+\.2$"),
    "active_data": ("doc_no", r"\.0\.6\.[0-9]+$"),
    "annotation": ("doc_no", r"\.(0\.[34]|[0-9]+\.var[0-9]+)(\.[0-9]+)?$"),
    "accord": ("doc_no", r"^A\.2\.8\.2\.[0-9]+$"),
    "party_details": ("doc_no", r"^A\.2\.8\.2\.[0-9]+\.1\.1\.[0-9]+$"),
    "grant": ("doc_no", r"^A\.2\.13\.1\.[0-9]+\.[0-9]+$"),
    "instance_location": ("title", r"(?i)instance configuration document location"),
    "instance_config": ("title", r"(?i)instance configuration document(?! location)"),
    "activation_status": ("title", r"(?i)global activation status"),
}


def structure_flags(docs: DataFrame, rules: dict[str, tuple[str, str]] = STRUCTURE) -> DataFrame:
    """Adds a boolean column is_<name> for each rule."""
    return docs.withColumns({f"is_{name}": F.coalesce(F.col(column).rlike(pattern), F.lit(False)) for name, (column, pattern) in rules.items()})


def of_types(column: Column, types: list[str]) -> Column:
    """The type is one of those named, whatever their case; _ and - stand for a space."""
    return F.lower(column).isin(*[re.sub("[_-]", " ", t).lower() for t in types])


def in_scope(doc_no: Column, prefix: str) -> Column:
    """The section of a number or below it."""
    return (doc_no == prefix) | doc_no.startswith(f"{prefix}.")


def all_terms(field: Column, terms: list[str]) -> Column:
    """Every term stands in the field as a word, whatever its case."""
    out = F.lit(True)
    for t in terms:
        out &= field.rlike(f"(?i){bounded(t)}")
    return out


def phrase(title: Column, body: Column, text: str, case: bool = False) -> Column:
    """A phrase stands between word borders in the body or the title."""
    pattern = ("" if case else "(?i)") + bounded(text)
    return body.rlike(pattern) | title.rlike(pattern)


def without(title: Column, body: Column, words: list[str]) -> Column:
    """None of the words is a part of title and body."""
    both = F.lower(F.concat_ws(" ", title, body))
    out = F.lit(True)
    for w in words:
        out &= ~F.contains(both, F.lit(w.lower()))
    return out


def numbered(docs: DataFrame, like: str | None = None, shallowest: int | None = None, deepest: int | None = None, doc_type: str | None = None) -> DataFrame:
    """Sections by a LIKE pattern of numbers, a range of depths and a type; at least one is needed."""
    if like is None and shallowest is None and deepest is None and doc_type is None:
        raise ValueError("a filter needs a condition")
    for condition in (
        None if like is None else F.col("doc_no").like(like),
        None if shallowest is None else F.col("depth") >= shallowest,
        None if deepest is None else F.col("depth") <= deepest,
        None if doc_type is None else F.col("type") == doc_type,
    ):
        docs = docs if condition is None else docs.where(condition)
    return docs


def changed_ids(history: DataFrame, since: str | None = None, until: str | None = None, change_type: str | None = None, last_commits: int | None = None) -> DataFrame | None:
    """Distinct ids of sections with a change in a window; None without a condition, which lets all pass."""
    if since is None and until is None and change_type is None and last_commits is None:
        return None
    if since is not None:
        history = history.where(F.col("date") >= F.to_date(F.lit(since)))
    if until is not None:
        history = history.where(F.col("date") <= F.to_date(F.lit(until)))
    if change_type is not None:
        history = history.where(F.col("change_type") == change_type)
    if last_commits is not None:
        newest = history.agg(F.max("commit_seq").alias("newest"))
        history = history.crossJoin(newest).where(F.col("commit_seq") > F.col("newest") - last_commits)
    return history.select("doc_id").distinct()


def constrained(df: DataFrame, id_col: str, *sets: DataFrame | None) -> DataFrame:
    """Rows whose id is in every set; a set of None lets all pass, an empty one none."""
    for ids in sets:
        if ids is not None:
            df = df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")
    return df


def keyword_hits(title: Column, words: list[str], phrases: list[str]) -> Column:
    """The first single word that a title holds and all the phrases in it, sorted."""
    first = F.lower(F.regexp_extract(title, rf"(?i)(?:^|[^A-Za-z0-9_])({'|'.join(words)})(?![A-Za-z0-9_])", 1))
    several = [F.when(F.contains(F.lower(title), F.lit(p)), p) for p in phrases]
    return F.array_sort(F.filter(F.array(F.when(first != "", first), *several), lambda k: k.isNotNull()))


def name_score(name: Column, text: str) -> Column:
    """3 for the name itself, 2 for its beginning, 1 for a part, else 0."""
    low, t = F.lower(name), text.lower()
    return F.when(low == t, 3).when(low.startswith(t), 2).when(F.contains(low, F.lit(t)), 1).otherwise(0)


def visible_edges(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges neither of whose ends is hidden (hidden: id)."""
    for end in ("from_id", "to_id"):
        edges = edges.join(hidden.select(F.col("id").alias(end)), end, "left_anti")
    return edges
