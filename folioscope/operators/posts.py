"""Posts that announce changes, parsed into bullets and references.

A post is read line by line into headings and what stands under them. One that has a
chapter named Summary among its chapters (##) speaks with that chapter; one with several
topics (###) has a bullet for each, and list items before the first topic stand in for
topics that are missing or empty. Everything is an expression over a post's lines, so a
post is never split over rows before its bullets are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import UUID

# fixed values: characters of a description, and the share of them within which it is cut at a space
LONGEST, LEAST_SHARE = 600, 0.6
#: Numbers of sections in prose, whatever their first letter.
NUMBER = r"(?<![A-Za-z0-9_])[A-Z](?:\.[A-Za-z0-9_]+)+"


def plain_text(md: Column) -> Column:
    """A text on one line without marks of lists, quotes, headings, bold type and links."""
    unmarked = F.regexp_replace(md, r"(?m)^[ \t]*(?:>[ \t]?|[-*][ \t]+|#{1,6}[ \t]+)+", "")
    unmarked = F.regexp_replace(F.regexp_replace(unmarked, r"\*\*([^*]+)\*\*", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(unmarked, r"\s+", " "))


def shortened(text: Column, longest: int = LONGEST) -> Column:
    """A text of at most so many characters, cut at its last space if that is near enough, with an ellipsis."""
    cut = F.substring(text, 1, longest)
    space = longest - F.locate(" ", F.reverse(cut))  # characters before the last space; all of them if there is none
    whole_words = F.when((space < longest) & (space > longest * LEAST_SHARE), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.trim(whole_words), F.lit("…")))


def heading_text(title: Column) -> Column:
    """A heading without marks around it and without code marks."""
    bare = F.regexp_replace(F.trim(title), r"^(\*\*|\*|_)(.+)\1$", "$2")
    return F.trim(F.regexp_replace(bare, "`([^`]+)`", "$1"))


def same_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")


def _level(line: Column) -> Column:
    return F.when(line.rlike(r"^###[ \t]+\S"), 3).when(line.rlike(r"^##[ \t]+[^#\s]"), 2).otherwise(0)


def _under(lines: Column, ends: Column, level: int) -> Column:
    """Headings of a level with the lines under each, up to the next heading of this level or above; ends are all such headings."""
    of_level = F.filter(F.transform(ends, lambda h, i: F.struct(h["level"].alias("level"), h["title"].alias("title"), h["at"].alias("at"), F.coalesce(F.get(ends, i + 1)["at"], F.size(lines)).alias("end"))), lambda h: h["level"] == level)
    return F.transform(of_level, lambda h: F.struct(h["title"].alias("title"), F.array_join(F.slice(lines, h["at"] + 2, h["end"] - h["at"] - 1), "\n").alias("body")))


def _bullet(title: Column, description: Column, origin: str, own: Column) -> Column:
    return F.struct(title.alias("title"), description.alias("description"), F.lit(origin).alias("origin"), own.alias("own"))


def parse_posts(posts: DataFrame) -> DataFrame:
    """post_id, mode and bullets (title, description, origin, own text) of posts (post_id, title, body), one row for each.

    mode is ``summary`` (a Summary among two or more chapters, with a text, in a post that has
    a title: its one bullet has the post's title), ``topics`` (two or more topics and at least
    one bullet) or ``none`` (no bullets). A topic without text gives no bullet; a list item
    ``- **Title** - description`` before the first topic gives one unless a topic's bullet has
    that title, letters and digits compared. Null bodies are empty. Posts may repeat.
    """
    rows = posts.select("post_id", F.coalesce("title", F.lit("")).alias("title"), F.split(F.coalesce("body", F.lit("")), r"\r?\n").alias("lines"))
    marked = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda h: F.startswith(h["line"], F.lit("##")))
    heads = F.filter(F.transform(marked, lambda h: F.struct(_level(h["line"]).alias("level"), F.trim(F.regexp_replace(h["line"], "^#+", "")).alias("title"), h["at"].alias("at"))), lambda h: h["level"] > 0)
    # what a function of elements or several columns use is a column of its own: an expression inside it would be worked out anew each time
    rows = rows.withColumn("heads", heads)
    rows = rows.withColumns({"chapters": F.filter("heads", lambda h: h["level"] == 2), "topics": F.filter("heads", lambda h: h["level"] == 3)})
    summary = F.get(F.filter(_under(F.col("lines"), F.col("chapters"), 2), lambda c: F.lower(c["title"]) == "summary"), 0)["body"]
    intro = F.array_join(F.slice("lines", F.lit(1), F.get("topics", F.lit(0))["at"]), "\n")
    item = r"(?m)^[-*][ \t]+\*\*([^*\n]+)\*\*[ \t]*[—–-][ \t]*(\S[^\n]*)$"
    rows = rows.withColumns({"summary": F.when(F.size("chapters") >= 2, F.trim(summary)), "n_topics": F.size("topics"), "blocks": _under(F.col("lines"), F.col("heads"), 3), "intro": F.when(F.size("topics") >= 2, intro)})
    rows = rows.withColumns({"items": F.arrays_zip(F.regexp_extract_all("intro", F.lit(item), F.lit(1)).alias("title"), F.regexp_extract_all("intro", F.lit(item), F.lit(2)).alias("description")), "plain": plain_text(F.col("summary"))})
    told = F.zip_with("blocks", F.transform("blocks", lambda b: plain_text(b["body"])), lambda b, plain: _bullet(heading_text(b["title"]), shortened(plain), "topic", F.concat_ws("\n", b["title"], b["body"])))
    rows = rows.withColumn("told", F.filter(told, lambda b: b["description"] != ""))
    said = F.transform("items", lambda t: _bullet(heading_text(t["title"]), F.trim(t["description"]), "item", F.concat_ws("\n", t["title"], t["description"])))
    rows = rows.withColumn("said", F.filter(said, lambda b: ~F.exists("told", lambda t: same_title(t["title"]) == same_title(b["title"]))))
    sums = F.array(_bullet(F.col("title"), shortened(F.col("plain")), "summary", F.concat_ws("\n", "title", "summary")))
    none = F.filter("told", lambda b: F.lit(False))
    bullets = F.when((F.col("summary") != "") & (F.col("title") != ""), sums).when(F.col("n_topics") >= 2, F.concat("told", "said")).otherwise(none)
    rows = rows.withColumn("bullets", bullets)
    mode = F.when(F.size("bullets") == 0, "none").when(F.get("bullets", F.lit(0))["origin"] == "summary", "summary").otherwise("topics")
    return rows.select("post_id", mode.alias("mode"), "bullets")


def post_bullets(parsed: DataFrame) -> DataFrame:
    """post_id, mode, bullet (its place from 0), title, description and origin; a post without bullets has one row with nulls."""
    rows = parsed.select("post_id", "mode", F.posexplode_outer("bullets").alias("bullet", "b"))
    return rows.select("post_id", "mode", "bullet", "b.title", "b.description", "b.origin")


def references(text: Column) -> Column:
    """Distinct numbers and ids of sections that a text names."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.regexp_extract_all(F.lower(text), F.lit(UUID), F.lit(0))))


def harvested(posts: DataFrame, parsed: DataFrame) -> DataFrame:
    """post_id, ref and bullet for every number and id in a whole post.

    A reference belongs to the first bullet whose whole text, also beyond the description's
    end, has it; one outside of all bullets to the post's first, and to none (null) in a post without bullets.
    """
    every = posts.select("post_id", F.explode(references(F.concat_ws("\n", "title", "body"))).alias("ref"), F.lit(None).cast("int").alias("bullet"), F.lit(True).alias("whole"))
    # posts without bullets and bullets without references stay, as no filter may be put below that would parse a post again
    rows = parsed.select("post_id", F.posexplode_outer("bullets").alias("bullet", "b")).select("post_id", "bullet", F.explode_outer(references(F.col("b.own"))).alias("ref"))
    rows = every.unionByName(rows.select("post_id", "ref", "bullet", F.lit(False).alias("whole"))).groupBy("post_id", "ref").agg(F.min("bullet").alias("inside"), F.max("whole").alias("whole"))
    found = rows.withColumn("first", F.min(F.when(F.col("inside").isNotNull(), 0)).over(Window.partitionBy("post_id"))).where("whole")
    return found.select("post_id", "ref", F.when(F.col("post_id").isNotNull(), F.coalesce("inside", "first")).alias("bullet"))
