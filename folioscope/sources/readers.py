"""Readers and writers of corpora: sections in text, folders of documents, JSON maps, pipe tables, state maps, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import UUID

#: depth marks, number, title, type and id of a section's heading line
HEADING = rf"^(#{{1,6}}) (\S+) - (.*?) \[([^\]]+)\]\s*<!-- UUID: ({UUID}) -->\s*$"


def sections(files: DataFrame) -> DataFrame:
    """Sections of texts (path, text): path, ord, depth, doc_no, title, type, id, content, content_hash, parent_id.

    A heading opens a section and what follows up to the next one is its body; lines
    before the first heading are left out. The parent is the last section one level up
    that no shallower section has closed.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("head", F.col("line").rlike(HEADING))
    upto = Window.partitionBy("path").orderBy("n")
    lines = lines.withColumn("ord", F.sum(F.col("head").cast("int")).over(upto)).where("ord > 0")
    bodies = lines.groupBy("path", "ord").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("heading"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("content"),
    )
    part = lambda k: F.regexp_extract("heading", HEADING, k)
    nodes = bodies.select("path", (F.col("ord") - 1).cast("int").alias("ord"), F.length(part(1)).alias("depth"), part(2).alias("doc_no"), part(3).alias("title"), part(4).alias("type"), part(5).alias("id"), "content", F.sha2("content", 256).alias("content_hash"))
    return with_parents(nodes, "path")


def with_parents(nodes: DataFrame, group: str) -> DataFrame:
    """Adds parent_id from depth and order: the last section less deep, if it is one level up."""
    earlier = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("string")
    for d in range(2, 7):
        last = F.last(F.when(F.col("depth") < d, F.struct("id", "depth")), ignorenulls=True).over(earlier)
        parent = F.when((F.col("depth") == d) & (last["depth"] == d - 1), last["id"]).otherwise(parent)
    return nodes.withColumn("parent_id", parent)


def unquoted(value: Column) -> Column:
    """A scalar without single quotes (doubled inside) or double quotes (with backslashes inside)."""
    single, double = F.regexp_extract(value, "^'(.*)'$", 1), F.regexp_extract(value, '^"(.*)"$', 1)
    return F.when(value.rlike("^'.*'$"), F.replace(single, F.lit("''"), F.lit("'"))).when(value.rlike('^".*"$'), F.regexp_replace(double, r"\\(.)", "$1")).otherwise(value)


def folder_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document.md under a folder that has an id: its front matter as columns, its body behind the heading, its path."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "document.md").text(path)
    return front_matter(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def front_matter(files: DataFrame) -> DataFrame:
    """path, id, doc_no, title, type and content of texts with a front matter between lines of three dashes."""
    head = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    key = lambda k: F.nullif(unquoted(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1))), F.lit(""))
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    content = F.regexp_replace(body, r"(?s)\A\s*#{1,6} [^\n]*\n*", "")
    rows = files.select("path", key("id").alias("id"), key("docNo").alias("doc_no"), key("name").alias("title"), key("type").alias("type"), content.alias("content"))
    return rows.where("id IS NOT NULL")


def snapshot(single: DataFrame | None, folders: DataFrame | None) -> DataFrame:
    """One shape of rows from either format of a version."""
    columns = ["path", "id", "doc_no", "title", "type", "content"]
    parts = [p.select(*columns) for p in (None if single is None else sections(single), folders) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def json_map(files: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON objects (text) keyed by id: id and the fields of the schema; texts that are no object give none."""
    return files.select(F.explode(F.from_json("text", f"MAP<STRING, STRUCT<{schema}>>")).alias("id", "v")).select("id", "v.*")


def json_arrays(files: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON arrays (path, text), one for each element with its document's id from the file name; names with a leading _ are passed over."""
    doc_id = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    rows = files.where(~F.substring(doc_id, 1, 1).eqNullSafe("_") & (doc_id != ""))
    return rows.select(doc_id.alias("doc_id"), F.explode(F.from_json("text", f"ARRAY<STRUCT<{schema}>>")).alias("e")).where("e IS NOT NULL").select("doc_id", "e.*")


def inverted_registry(registry: DataFrame) -> DataFrame:
    """address (lower case) and the last name given to it; only values that begin with 0x."""
    return registry.where(F.col("value").startswith("0x")).groupBy(F.lower("value").alias("address")).agg(F.max_by("name", "ord").alias("name"))


def contracts(rows: DataFrame) -> DataFrame:
    """Contract metadata in one shape: flags from 1, '1' or true, empty names and addresses as null."""
    flag = F.lower(F.col("proxy").cast("string")).isin("1", "true")
    empty = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return rows.select("chain_id", F.lower("address").alias("address"), empty("name").alias("name"), F.coalesce(flag, F.lit(False)).alias("is_proxy"), F.lower(empty("implementation")).alias("implementation"))


def state_values(files: DataFrame) -> DataFrame:
    """chain, block, address, function and value of state maps (text), by chain or flat; a null value stays a row."""
    values = "MAP<STRING, MAP<STRING, STRING>>"
    per_chain = files.select(F.explode(F.from_json("text", f"MAP<STRING, STRUCT<block: BIGINT, slot: BIGINT, values: {values}>>")).alias("chain", "s")).where("s.values IS NOT NULL")
    flat = files.select(F.from_json("text", f"STRUCT<block: BIGINT, slot: BIGINT, values: {values}>").alias("s")).where("s.values IS NOT NULL").select(F.lit("ethereum").alias("chain"), "s")
    both = per_chain.unionByName(flat).select("chain", F.coalesce("s.block", "s.slot").alias("block"), F.explode("s.values").alias("address", "m"))
    return both.select("chain", "block", "address", F.explode("m").alias("function", "value"))


def pipe_table(docs: DataFrame) -> DataFrame:
    """id, row and cells by header of the pipe table in a text of three table lines or more; short rows have empty cells."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = F.filter(F.split("content", "\n"), lambda x: F.ltrim(x).startswith("|"))
    rows = docs.select("id", lines.alias("all")).where(F.size("all") >= 3)
    rows = rows.select("id", F.filter("all", lambda x: ~F.trim(x).rlike(r"^\|[\s\-:|]+\|?$")).alias("lines")).where(F.size("lines") > 0)
    rows = rows.select("id", cells(F.get("lines", F.lit(0))).alias("header"), F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("row", "line")).withColumn("cells", cells(F.col("line")))
    filled = F.transform("header", lambda h, i: F.coalesce(F.get("cells", i), F.lit("")))
    return rows.select("id", "row", F.map_from_arrays("header", filled).alias("cells"))


def compact_export(entities: DataFrame, edges: DataFrame, drop_edge: str, drop_entity: str, pinning: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without a type of edges, without a type of entities unless an edge of the pinning types holds them, and without edges that lost an end."""
    pinned = edges.where(F.col("edge_type").isin(*pinning)).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    others = entities.where(F.col("entity_type") != drop_entity)
    kept = others.unionByName(entities.where(F.col("entity_type") == drop_entity).join(pinned, "id", "left_semi"))
    rest = edges.where(F.col("edge_type") != drop_edge)
    for end in ("from", "to"):
        known = kept.select(F.col("id").alias(f"{end}_id"))
        rest = rest.where(F.col(f"{end}_type") != "entity").unionByName(rest.where(F.col(f"{end}_type") == "entity").join(known, f"{end}_id", "left_semi").select(*rest.columns))
    return kept, rest.select(F.col("from_id").alias("f"), F.col("to_id").alias("t"), F.col("edge_type").alias("e"))


def write_report(df: DataFrame, path: str, evidence: str | None = None) -> None:
    """CSV with every cell in quotes; an array of evidence joined by arrows."""
    if evidence is not None:
        df = df.withColumn(evidence, F.array_join(evidence, " → "))
    df.write.option("header", True).option("quoteAll", True).mode("overwrite").csv(path)


def vector_lines(vectors: DataFrame, dim: int) -> DataFrame:
    """One JSON text for each vector, whose length is asserted."""
    checked = vectors.where(F.assert_true(F.size("embedding") == dim).isNull())
    return checked.select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("embedding").alias("values"), F.struct("label").alias("metadata"))).alias("line"))


def stamped(df: DataFrame, pins: dict[str, str]) -> DataFrame:
    """Adds the versions that an answer rests on."""
    return df.withColumns({f"pin_{k}": F.lit(v) for k, v in pins.items()})
