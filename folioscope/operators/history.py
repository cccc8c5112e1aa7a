"""Versions of a corpus compared, changes classified and attributed, and feeds of changes."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType
from pyspark.sql.window import Window

from ..session import stored
from .tables import version_pairs
from .versioned import Versioned


def diff(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """id and change_type between two versions (id, title, content, path): added, removed, modified and moved, the last two both if both are so."""
    both = version_pairs(prev, curr)
    p, c = F.col("p"), F.col("c")
    there = p.isNotNull() & c.isNotNull()
    changed = there & ~(F.col("p.title").eqNullSafe(F.col("c.title")) & F.col("p.content").eqNullSafe(F.col("c.content")))
    events = F.array(F.when(p.isNull(), "added"), F.when(c.isNull(), "removed"), F.when(changed, "modified"), F.when(there & ~F.col("p.path").eqNullSafe(F.col("c.path")), "moved"))
    return both.select("id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("change_type"))


def all_versions(versions: DataFrame) -> DataFrame:
    """id, seq and change_type over many versions (seq, id, hash) in one pass; a gap is a removal and an addition.

    Versions without any row are not seen; the first version adds what it holds.
    """
    spans = versions.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    w = Window.partitionBy("id").orderBy("seq")
    rows = versions.crossJoin(F.broadcast(spans)).withColumns({"before": F.lag("seq").over(w), "after": F.lead("seq").over(w), "old_hash": F.lag("hash").over(w)})
    events = F.array(
        F.when(F.col("before").isNull() | (F.col("before") < F.col("seq") - 1), F.struct(F.col("seq").alias("seq"), F.lit("added").alias("change_type"))),
        F.when((F.col("before") == F.col("seq") - 1) & ~F.col("old_hash").eqNullSafe(F.col("hash")), F.struct(F.col("seq").alias("seq"), F.lit("modified").alias("change_type"))),
        F.when(F.coalesce(F.col("after"), F.col("last_seq") + 2) > F.col("seq") + 1, F.when(F.col("seq") < F.col("last_seq"), F.struct((F.col("seq") + 1).alias("seq"), F.lit("removed").alias("change_type")))),
    )
    return rows.select("id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("id", "e.seq", "e.change_type")


def line_changes(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """id, op and line for the lines that one version of a changed section has and the other lacks, repeats counted."""
    changed = prev.select("id", F.col("content").alias("a")).join(curr.select("id", F.col("content").alias("b")), "id").where("NOT a <=> b")

    def numbered(column: str, flag: str) -> DataFrame:
        lines = changed.select("id", F.posexplode(F.split(column, "\n")).alias("n", "line"))
        return lines.withColumn("copy", F.row_number().over(Window.partitionBy("id", "line").orderBy("n"))).select("id", "line", "copy", F.lit(True).alias(flag))

    both = numbered("a", "old").join(numbered("b", "new"), ["id", "line", "copy"], "full")
    return both.where("old IS NULL OR new IS NULL").select("id", F.when(F.col("old").isNull(), "+").otherwise("-").alias("op"), "line")


def change_size(changed_tokens: DataFrame) -> DataFrame:
    """id and size class of changed tokens (id, token): lint without letters or digits, typo up to four of them and runs of two, else semantic."""
    runs = F.filter(F.split("token", "[^a-zA-Z0-9]+"), lambda r: r != "")
    sums = changed_tokens.withColumn("runs", runs).groupBy("id").agg(
        F.sum(F.aggregate("runs", F.lit(0), lambda a, r: a + F.length(r))).alias("chars"),
        F.max(F.coalesce(F.array_max(F.transform("runs", lambda r: F.length(r))), F.lit(0))).alias("longest"),
        F.sum(F.length(F.regexp_replace("token", "[a-zA-Z0-9]+", ""))).alias("other"),
    )
    kind = F.when(F.col("chars") == 0, F.when(F.col("other") > 0, "lint")).when((F.col("chars") <= 4) & (F.col("longest") <= 2), "typo").otherwise("semantic")
    return sums.select("id", kind.alias("kind"))


def token_changes(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """id and token for each token that only one of two versions of a section has, repeats counted.

    Ids must be given once in each version; only changed texts are split, what is alike at
    their beginnings and ends cancels out in its row, and the rest of both versions stays
    where the join has put its id.
    """
    words = lambda c: F.coalesce(F.split(c, r"\s+"), F.array().cast("array<string>"))
    pairs = prev.select("id", F.col("content").alias("a")).join(curr.select("id", F.col("content").alias("b")), "id").where("NOT a <=> b")
    pairs = pairs.select("id", words("a").alias("a"), words("b").alias("b")).withColumn("head", _alike(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head"))
    pairs = pairs.select("id", rest("a").alias("a"), rest("b").alias("b")).withColumn("tail", _alike(F.col("a"), F.col("b"), backwards=True))
    told = lambda c, n: F.transform(F.slice(c, F.lit(1), F.size(c) - F.col("tail")), lambda t: F.struct(t.alias("token"), F.lit(n).alias("n")))
    each = pairs.select("id", F.explode(F.concat(told("a", -1), told("b", 1))).alias("t")).select("id", "t.*")
    sums = each.groupBy("id", "token").agg(F.abs(F.sum("n")).alias("n")).where("n > 0")
    return sums.select("id", "token", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("id", "token")


# fixed values: unchanged lines shown around a change, and the most lines of either side that are shown
CONTEXT, MOST_LINES = 2, 20


def _longest_rise(values: list[int]) -> list[bool]:
    """Which values belong to a longest rising run."""
    ends, at, before = [], [], []
    for n, v in enumerate(values):
        k = bisect_left(ends, v)
        before.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [v], [n]
    kept, n = [False] * len(values), at[-1] if at else -1
    while n >= 0:
        kept[n], n = True, before[n]
    return kept


@F.pandas_udf(ArrayType(BooleanType()))
def _rising(places: pd.Series) -> pd.Series:
    return places.map(lambda p: _longest_rise(list(p)))


def _alike(a: Column, b: Column, backwards: bool = False) -> Column:
    """How many elements two arrays have alike at their beginnings, or ends."""
    n = F.least(F.size(a), F.size(b))
    differs = lambda k: ~F.get(a, F.size(a) - k if backwards else k - 1).eqNullSafe(F.get(b, F.size(b) - k if backwards else k - 1))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(steps, differs), F.lit(0)) - 1, n)


def placed_hunks(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """id, hunk, old_at, new_at, before, removed, added and after: where and how texts of one id differ between two versions.

    Lines that both versions have exactly once, in the longest run in which both have them
    in one order, are held fast; between two of them, what is alike at the beginning and the
    end is left out, and the rest is a hunk: lines removed and added (all of them), the
    number of lines before it in either version, and up to two lines around it in the old
    one. A line that is moved past such lines is removed and added. Ids must be given once
    in each version; null texts are empty, and only changed texts are looked at.
    """
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    pairs = prev.select("id", lines(F.col("content")).alias("a")).join(curr.select("id", lines(F.col("content")).alias("b")), "id").where("a <> b")
    # both versions' lines come from one row, so they stay where the join has put their id
    tagged = lambda c: F.transform(c, lambda x, i: F.struct(F.lit(c).alias("side"), i.alias("at"), x.alias("line")))
    sides = pairs.select("id", F.explode(F.concat(tagged("a"), tagged("b"))).alias("l")).select("id", "l.*")
    where = lambda c: F.max(F.when(F.col("side") == c, F.col("at")))
    once = sides.groupBy("id", "line").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"), where("a").alias("i"), where("b").alias("j"))
    fast = once.where("na = 1 AND nb = 1").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("fast"))  # at most the lines of one text
    fast = fast.withColumn("rising", _rising(F.transform("fast", lambda f: f["j"]))).select("id", F.filter("fast", lambda f, k: F.get("rising", k)).alias("fast"))
    end = F.struct(F.size("a").alias("i"), F.size("b").alias("j"))
    start = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    rows = pairs.join(fast, "id", "left").withColumn("fast", F.concat(F.array(start), F.coalesce("fast", F.filter(F.array(end), lambda f: F.lit(False))), F.array(end)))

    def gap(k: Column) -> Column:
        one, other = F.get("fast", k), F.get("fast", k + 1)
        part = lambda side, x: F.slice(side, one[x] + 2, other[x] - one[x] - 1)
        around = lambda at, n: F.slice("a", at + 1, n)
        first = F.greatest(one["i"] + 1 - CONTEXT, F.lit(0))
        return F.struct((one["i"] + 1).alias("old_at"), (one["j"] + 1).alias("new_at"), part("a", "i").alias("a"), part("b", "j").alias("b"), around(first, one["i"] + 1 - first).alias("pre"), around(other["i"], F.lit(CONTEXT)).alias("post"))

    gaps = F.filter(F.transform(F.sequence(F.lit(0), F.size("fast") - 2), gap), lambda g: (F.size(g["a"]) > 0) | (F.size(g["b"]) > 0))
    rows = rows.select("id", F.explode(gaps).alias("g")).select("id", "g.*").withColumn("head", _alike(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head"))
    rows = rows.withColumns({"rest_a": rest("a"), "rest_b": rest("b")}).withColumn("tail", _alike(F.col("rest_a"), F.col("rest_b"), backwards=True))
    shown = F.concat("pre", F.slice("a", F.lit(1), F.col("head")))
    rows = rows.select(
        "id", (F.col("old_at") + F.col("head")).alias("old_at"), (F.col("new_at") + F.col("head")).alias("new_at"),
        F.slice(shown, F.greatest(F.size(shown) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT)).alias("before"),
        F.slice("rest_a", F.lit(1), F.size("rest_a") - F.col("tail")).alias("removed"), F.slice("rest_b", F.lit(1), F.size("rest_b") - F.col("tail")).alias("added"),
        F.slice(F.concat(F.slice("rest_a", F.size("rest_a") - F.col("tail") + 1, F.col("tail")), F.col("post")), F.lit(1), F.lit(CONTEXT)).alias("after"),
    ).where("size(removed) > 0 OR size(added) > 0")
    number = F.row_number().over(Window.partitionBy("id").orderBy("old_at", "new_at")) - 1
    return rows.withColumn("hunk", number).select("id", "hunk", "old_at", "new_at", "before", "removed", "added", "after")


def shown_hunks(hunks: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """Hunks with at most so many lines of each side, and how many more there are (more_removed, more_added)."""
    cut = {c: F.slice(c, 1, most) for c in ("removed", "added")}
    more = {f"more_{c}": F.greatest(F.size(c) - most, F.lit(0)) for c in ("removed", "added")}
    return hunks.withColumns(more).withColumns(cut)


def changed_pieces(hunks: DataFrame) -> DataFrame:
    """id and token, each piece of text that hunks take away or bring.

    Removed and added lines of a hunk are paired in order; of a pair only the words and gaps
    between the common beginning and end count. Lines without a partner count whole.
    """
    tokens = lambda line: F.split(line, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    pairs = hunks.select("id", F.explode(F.arrays_zip("removed", "added")).alias("p")).select("id", F.col("p.removed").alias("a"), F.col("p.added").alias("b"))
    alone = pairs.where("a IS NULL OR b IS NULL").select("id", F.coalesce("a", "b").alias("token"))
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("id", tokens(F.col("a")).alias("a"), tokens(F.col("b")).alias("b")).withColumn("head", _alike(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head"))
    both = both.withColumns({"a": rest("a"), "b": rest("b")}).withColumn("tail", _alike(F.col("a"), F.col("b"), backwards=True))
    middle = lambda c: F.slice(c, F.lit(1), F.size(c) - F.col("tail"))
    return alone.unionByName(both.select("id", F.explode(F.concat(middle("a"), middle("b"))).alias("token")))


def change_kinds(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """id and kind of all sections of which title or text differ: lint, typo or semantic by what their texts' hunks change, null for a changed title alone."""
    both = version_pairs(prev.select("id", "title", "content"), curr.select("id", "title", "content")).where("p IS NOT NULL AND c IS NOT NULL AND NOT p <=> c").select("id")
    return both.join(change_size(changed_pieces(placed_hunks(prev, curr))), "id", "left")


# fixed values: titles of change sets that touch no content, and of those that mend letters
LINT_TITLE = r"(?i)\b(?:whitespace|non[\s-]?breaking|formatt?ing|lint(?:er|ing)?|cleanup\s+formatting|remove\s+formatting)\b"
TYPO_TITLE = r"(?i)\b(?:fix(?:es|ed|ing)?\s+(?:a\s+)?(?:typos?|spelling)|(?:typos?|spelling)\s+fix(?:es)?|correct\s+(?:typos?|spelling))\b"


def title_kind(title: Column) -> Column:
    """lint or typo if a change set's title says so."""
    return F.when(title.rlike(LINT_TITLE), "lint").when(title.rlike(TYPO_TITLE), "typo")


def bullets(body: Column) -> Column:
    """(title, description) of list items of the form '- **Title** — description'."""
    item = r"(?m)^[ \t]*[-*][ \t]+\*\*([^*\n]+)\*\*[ \t]*(?:—|–|-|:)?[ \t]*([^\n]*)$"
    return F.arrays_zip(F.regexp_extract_all(body, F.lit(item), F.lit(1)).alias("title"), F.regexp_extract_all(body, F.lit(item), F.lit(2)).alias("description"))


def match_scores(bullet_tokens: DataFrame, own_tokens: DataFrame, least: float = 0.35) -> DataFrame:
    """node, bullet and score of the best bullet of each node, the earlier of two.

    bullet_tokens: bullet, token, in_title; own_tokens: node, token. A node's tokens found
    in a bullet's title or description count against all it has; a single one in a
    description does not count. Candidates meet on shared tokens.
    """
    total = own_tokens.groupBy("node").agg(F.countDistinct("token").alias("own"))
    hits = own_tokens.distinct().join(bullet_tokens.groupBy("bullet", "token").agg(F.max("in_title").alias("in_title")), "token")
    counts = hits.groupBy("node", "bullet").agg(F.count("*").alias("hits"), F.count_if("in_title").alias("title_hits"))
    scored = counts.where("title_hits > 0 OR hits >= 2").join(total, "node").withColumn("score", F.least(F.col("hits") / F.col("own"), F.lit(1.0))).where(F.col("score") >= least)
    best = Window.partitionBy("node").orderBy(F.desc("score"), "bullet")
    return scored.withColumn("n", F.row_number().over(best)).where("n = 1").select("node", "bullet", "score")


def patched_index(index: DataFrame, changed_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings without those of changed or removed sections (doc_id), with fresh ones."""
    return index.join(changed_ids, "doc_id", "left_anti").unionByName(fresh)


def feed(history: DataFrame, since: str | None = None, doc_ids: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Newest changes first."""
    if since is not None:
        history = history.where(F.col("date") >= F.to_date(F.lit(since)))
    if doc_ids is not None:
        history = history.join(doc_ids, "doc_id", "left_semi")
    return history.orderBy(F.desc("commit_seq"), F.desc("event_id")).limit(limit)


def between(history: DataFrame, one: int, other: int) -> DataFrame:
    """Changes by section between two commits, both included, in whichever order they are given."""
    rows = history.where(F.col("commit_seq").between(min(one, other), max(one, other)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("changes"), F.max("commit_seq").alias("last_seq"), F.array_join(F.array_sort(F.collect_set("change_type")), ",").alias("kinds"))


def resume(store: Versioned, events: DataFrame, source: str = "history") -> int:
    """Adds the events (doc_id, commit_hash, commit_seq, change_type, ...) of commits after the last one that a store has, and gives that commit's number.

    The store's table ``entries`` has each event once for its section, commit and type, and
    ``counts`` how many there are of each type (change_type, n), over all runs. Events,
    counts and the number of the last commit change together, so a run that is lost or comes
    again leaves nothing half done or counted twice. Events of commits up to the last one are passed over.
    """
    last = store.taken(source)
    fresh = events.where(F.col("commit_seq").isNotNull() if last is None else F.col("commit_seq") > last).dropDuplicates(["doc_id", "commit_hash", "change_type"])
    fresh = stored(fresh, "fresh-events")
    newest = fresh.agg(F.max("commit_seq")).first()[0]
    if newest is None:
        return -1 if last is None else last
    added = fresh.groupBy("change_type").agg(F.count("*").alias("n"))
    merged = store.read("counts", added.schema).unionByName(added).groupBy("change_type").agg(F.sum("n").alias("n"))
    store.replace({"counts": (merged, merged.select(F.col("change_type").alias("k0")), ["change_type"])}, source, newest, appended={"entries": fresh})
    return newest


def resolve_prefixes(asked: DataFrame, ids: DataFrame, length: int = 8) -> DataFrame:
    """prefix, matches and id (null unless there is one) for the first characters of ids."""
    short = ids.select(F.substring("id", 1, length).alias("prefix"), "id").groupBy("prefix").agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    found = asked.join(short, "prefix", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return found.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("id")).alias("id"))
