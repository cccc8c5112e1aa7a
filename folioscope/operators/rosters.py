"""Entities from tables in sections' texts: a table's header says what its rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_url, slug_id, slugify
from ..session import stored
from ..sources.readers import pipe_table
from .extraction import EVM

# fixed values: columns by which a table is known, columns of its rows' names, and what its other columns are called in an entity's meta
SHAPES: dict[str, tuple[str, dict[str, str]]] = {
    "delegate": ("Delegate Name", {}),
    "derecognized": ("Identity", {"Date": "derecognition_date"}),
    "member": ("Name or Alias", {"Domain Expertise": "domain_expertise", "Start Date": "start_date", "Term Status": "term_status", "Standing": "standing"}),
}
URLS = {"delegate": "Forum Post", "derecognized": "Reasoning Post"}
TYPES = {"delegate": "delegate_org", "derecognized": "delegate_org", "member": "src_member"}


def _cell(header: str) -> Column:
    return F.trim(F.coalesce(F.col("cells")[header], F.lit("")))


def _address(header: str) -> Column:
    found = F.regexp_extract(_cell(header), EVM, 0)
    return F.when(found != "", F.lower(found))


def roster_rows(docs: DataFrame) -> DataFrame:
    """doc_id, ord, row, shape, name, address, contract, governance and meta of rows of the three kinds of tables.

    docs: id, ord, content. A row without a name, or named -, is left out, as is a delegate
    without an address of its own. meta has the source, the link and the shape's own columns where they aren't empty.
    """
    rows = pipe_table(docs.select("id", "content")).join(docs.select("id", "ord"), "id")
    shape = F.lit(None).cast("string")
    for kind, (header, _) in reversed(SHAPES.items()):
        shape = F.when(F.map_contains_key("cells", F.lit(header)), kind).otherwise(shape)
    rows = rows.withColumn("shape", shape).where("shape IS NOT NULL")
    pick = lambda of: F.coalesce(*[F.when(F.col("shape") == kind, value) for kind, value in of.items()])
    pairs = [F.struct(F.lit("source").alias("k"), F.lit("active_data_table").alias("v")), F.struct(F.lit("forum_url").alias("k"), pick({k: first_url(_cell(h)) for k, h in URLS.items()}).alias("v"))]
    pairs += [F.struct(F.lit(name).alias("k"), F.when(F.col("shape") == kind, F.nullif(_cell(h), F.lit(""))).alias("v")) for kind, (_, own) in SHAPES.items() for h, name in own.items()]
    made = rows.select(
        F.col("id").alias("doc_id"), "ord", "row", "shape", pick({k: _cell(h) for k, (h, _) in SHAPES.items()}).alias("name"), _address("EA Address").alias("address"), _address("Delegation Contract").alias("contract"),
        F.when(F.col("shape") == "member", F.transform(F.regexp_extract_all(_cell("Verified Governance Address"), F.lit(EVM), F.lit(0)), F.lower)).alias("governance"),
        F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())).alias("meta"),
    )
    return made.where("name NOT IN ('', '-') AND (shape <> 'delegate' OR address IS NOT NULL)")


def with_rosters(rows: DataFrame, entities: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, their addresses and listings after the tables (``roster_rows``) are taken in.

    entities: id, slug, name, entity_type, is_active, defining_doc_id, meta (a map); owned:
    entity_id, address, role. A delegate whose address an entity has enriches it (a link; an
    ecosystem_actor becomes a delegate_org; the two addresses' roles), of several owners the
    one with the greatest id; any other delegate is a new entity, in the place of one with
    its slug, of several rows of a slug the last. Derecognized ones (inactive) and then members are new
    unless their slug is there. Listings (entity_id, doc_id) are of all that rows enriched or created.
    """
    rows = stored(rows.withColumns({"slug": slugify(F.col("name")), "at": F.struct("ord", "doc_id", "row")}), "roster")
    owners = owned.groupBy("address").agg(F.max("entity_id").alias("owner")).join(entities.select(F.col("id").alias("owner")), "owner", "left_semi")
    delegates = rows.where("shape = 'delegate'").join(owners, "address", "left")
    last = lambda df, key: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at")))).where("_n = 1").drop("_n")
    first = lambda df, key: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where("_n = 1").drop("_n")
    enriching = stored(delegates.where("owner IS NOT NULL"), "enriching")
    new_delegates = last(delegates.where("owner IS NULL"), "slug")
    had = entities.select("slug").unionByName(new_delegates.select("slug")).distinct()
    gone = first(rows.where("shape = 'derecognized'"), "slug").join(had, "slug", "left_anti")
    had = had.unionByName(gone.select("slug"))
    members = first(rows.where("shape = 'member'"), "slug").join(had, "slug", "left_anti")
    fresh = stored(new_delegates.drop("owner").unionByName(gone).unionByName(members), "roster-entities")

    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("shape")]
    created = fresh.select(slug_id(F.col("slug")).alias("id"), "slug", "name", kind.alias("entity_type"), (F.col("shape") != "derecognized").alias("is_active"), F.col("doc_id").alias("defining_doc_id"), "meta")
    links = last(enriching, "owner").select(F.col("owner").alias("id"), F.lit(True).alias("listed"))
    urls = last(enriching.where("meta['forum_url'] IS NOT NULL"), "owner").select(F.col("owner").alias("id"), F.col("meta")["forum_url"].alias("url"))
    kept = entities.join(fresh.where("shape = 'delegate'").select("slug"), "slug", "left_anti").join(links, "id", "left").join(urls, "id", "left")
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    with_url = F.when(F.col("url").isNull(), F.col("meta")).otherwise(F.map_concat(F.map_filter(meta, lambda k, v: k != "forum_url"), F.create_map(F.lit("forum_url"), F.col("url"))))
    kept = kept.withColumns({"entity_type": F.when(F.col("listed") & (F.col("entity_type") == "ecosystem_actor"), "delegate_org").otherwise(F.col("entity_type")), "meta": with_url})
    after = kept.select(created.columns).unionByName(created)

    told = lambda df, who: df.select(who.alias("entity_id"), "at", F.explode(F.array(F.struct(F.col("address"), F.lit("ea_address").alias("told")), F.struct(F.col("contract").alias("address"), F.lit("delegation_contract").alias("told")))).alias("a")).select("entity_id", "at", "a.*").where("address IS NOT NULL")
    roles = told(enriching, F.col("owner")).groupBy("entity_id", "address").agg(F.max_by("told", F.struct("at", F.col("told") == "ea_address")).alias("told"))
    addresses = owned.join(roles, ["entity_id", "address"], "left").select("entity_id", "address", F.coalesce("told", "role").alias("role"))
    brought = told(fresh.where("shape = 'delegate'"), slug_id(F.col("slug"))).select("entity_id", "address", F.col("told").alias("role"))
    verified = fresh.where("shape = 'member'").select(slug_id(F.col("slug")).alias("entity_id"), F.explode("governance").alias("address"), F.lit("governance").alias("role"))
    addresses = addresses.unionByName(brought).unionByName(verified).distinct()
    listings = enriching.select(F.col("owner").alias("entity_id"), "doc_id").unionByName(fresh.select(slug_id(F.col("slug")).alias("entity_id"), "doc_id")).distinct()
    return after, addresses, listings
