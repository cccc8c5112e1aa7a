"""Queries over column functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import filters
from . import query

TRIM = r"regexp_replace({c}, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g')"
TERMS = r"list_filter(string_split_regex(lower({c}), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: len(t) >= 2)"
TOKENS = "list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: len(t) > 2 AND t NOT IN ('the','a','an','and','or','for','in','on','to','at','by','with','from','of','is','as'))"


@query("x1_slugify", "entities", sql="SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS name_slug FROM entities")
def _(v):
    return v.entities.select("id", text.slugify(F.col("name")).alias("name_slug"))


@query("x2_slug_id", "entities", sql="""SELECT slug, concat(substr(h,1,8),'-',substr(h,9,4),'-4',substr(h,14,3),'-',substr(h,17,4),'-',substr(h,21,12)) AS uuid
FROM (SELECT slug, sha256(slug) AS h FROM entities)""")
def _(v):
    return v.entities.select("slug", text.slug_id(F.col("slug")).alias("uuid"))


@query("x3_content_hashes", "corpus", sql=f"SELECT id, sha256(content) AS body, md5({TRIM.format(c='content')}) AS trimmed, sha256(concat(title, chr(10), chr(10), content)) AS document FROM corpus")
def _(v):
    c, t = F.col("content"), F.col("title")
    return v.corpus.select("id", text.body_hash(c).alias("body"), text.trimmed_hash(c).alias("trimmed"), text.document_hash(t, c).alias("document"))


@query("x4_embed_text", "corpus", sql=f"SELECT id, md5(substr(concat(title, chr(10), chr(10), {TRIM.format(c='content')}), 1, 2048)) AS cut FROM corpus")
def _(v):
    return v.corpus.select("id", F.md5(text.embed_text(F.col("title"), F.col("content"))).alias("cut"))


@query("x6_index_terms", "corpus", sql=f"SELECT id, CAST(len(t) AS INT) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT id, {TERMS.format(c='content')} AS t FROM corpus)")
def _(v):
    return v.corpus.select("id", text.index_terms(F.col("content")).alias("t")).select("id", F.size("t").alias("n_terms"), F.array_join("t", " ").alias("terms"))


@query("x7_match_tokens", "corpus", sql=f"SELECT id, array_to_string(list_sort(list_distinct({TOKENS.format(c='content')})), ' ') AS tokens FROM corpus")
def _(v):
    return v.corpus.select("id", F.array_join(F.array_sort(text.match_tokens(F.col("content"))), " ").alias("tokens"))


@query("x8_parent_key", "docs", sql=r"SELECT id, CASE WHEN doc_no LIKE '%.%' THEN regexp_replace(doc_no, '\.[^.]*$', '') END AS parent_no, CASE WHEN doc_no LIKE '%.%.%' THEN regexp_replace(doc_no, '\.[^.]*\.[^.]*$', '') END AS grandparent_no FROM docs")
def _(v):
    return v.docs.select("id", text.parent_key(F.col("doc_no")).alias("parent_no"), text.parent_key(F.col("doc_no"), 2).alias("grandparent_no"))


@query("x9_true_depth", "docs", sql="SELECT id, CAST(CASE WHEN doc_no LIKE '%.0.6.%' THEN len(split_part(doc_no, '.0.6.', 1)) - len(replace(split_part(doc_no, '.0.6.', 1), '.', '')) + 1 ELSE len(doc_no) - len(replace(doc_no, '.', '')) END AS INT) AS true_depth FROM docs")
def _(v):
    return v.docs.select("id", text.true_depth(F.col("doc_no")).cast("int").alias("true_depth"))


@query("x10_natural_key", "docs", sql="SELECT id, array_to_string(list_transform(string_split(doc_no, '.'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 10, '0') ELSE x END), '.') AS sort_key FROM docs")
def _(v):
    return v.docs.select("id", text.natural_key(F.col("doc_no")).alias("sort_key"))


@query("x11_links", sql=r"""SELECT page_id, array_to_string(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)).list_sort(), ' ') AS targets FROM pages""")
def _(v):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return v.pages.select("page_id", F.array_join(F.array_sort(found), " ").alias("targets"))


@query("x12_first_url", sql=r"""SELECT page_id, nullif(regexp_extract(html, 'https?://[^\s)\]"''<>]+', 0), '') AS first_url FROM pages""")
def _(v):
    return v.pages.select("page_id", text.first_url(F.col("html")).alias("first_url"))


@query("x22_snippet", "corpus", sql="""SELECT id, concat(CASE WHEN s > 0 THEN '…' ELSE '' END, substr(content, s + 1, 160), CASE WHEN len(content) > s + 160 THEN '…' ELSE '' END) AS piece
FROM (SELECT *, CASE WHEN p > 0 THEN greatest(p - 61, 0) ELSE 0 END AS s FROM (SELECT *, instr(lower(content), 'licensed') AS p FROM corpus))""")
def _(v):
    return v.corpus.select("id", text.snippet(F.col("content"), "licensed").alias("piece"))


@query("x23_highlight", "corpus", sql="""SELECT id, md5(regexp_replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(licensed)', '<mark>\\1</mark>', 'gi')) AS marked FROM corpus""")
def _(v):
    return v.corpus.select("id", F.md5(text.highlight(F.col("content"), "licensed")).alias("marked"))


@query("x23_three_tiers", "corpus", sql=r"""SELECT id, md5(replace(regexp_replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
'(\bLicense\b)|((?i:\bLicense\b))|((?i:\bunder the\b)|(?i:licen)|(?i:permi))', '<mark>\1\3</mark>\2', 'g'), '<mark></mark>', '')) AS marked,
CAST(len(regexp_extract_all(content, '\bLicense\b|(?i:\bLicense\b)|(?i:\bunder the\b)|(?i:licen)|(?i:permi)')) AS BIGINT) AS found FROM corpus""")
def _(v):
    marked = text.highlight(F.col("content"), ["licen", "permi"], ["under the"], ["License"])
    found = F.regexp_count("content", F.lit(r"(?i)(?<![A-Za-z0-9_])(?:License|under the)(?![A-Za-z0-9_])|licen|permi"))
    return v.corpus.select("id", F.md5(marked).alias("marked"), found.cast("long").alias("found"))


@query("x25_scrub", "corpus", sql=r"""SELECT id, CASE WHEN regexp_matches(t, '^https?://\S+$') THEN NULL WHEN len(t) >= 10 THEN t END AS cleaned FROM (
SELECT id, trim(regexp_replace(regexp_replace(title, '[ \t\n\r\f\v]+', ' ', 'g'), '^[ —*•·:-]+|[ —*•·:-]+$', '', 'g')) AS t FROM corpus)""")
def _(v):
    return v.corpus.select("id", text.scrub(F.col("title")).alias("cleaned"))


@query("x26_since_date", "history", sql="SELECT event_id, CASE WHEN pr_number IS NULL THEN CAST('2024-01-31' AS DATE) ELSE CAST(CAST('2024-06-30' AS DATE) - pr_number AS DATE) END AS since FROM history")
def _(v):
    asked = F.when(F.col("pr_number").isNull(), "2024-01-31").otherwise(F.concat(F.col("pr_number").cast("string"), F.lit("d")))
    return v.history.select("event_id", text.since_date(asked, "2024-06-30").alias("since"))


@query("x27_safe_json", "history", sql="SELECT event_id, coalesce(json_keys(CASE WHEN json_valid(props) THEN props ELSE '{}' END)[1], '') AS first_key FROM history")
def _(v):
    return v.history.select("event_id", F.coalesce(F.get(F.json_object_keys("props"), F.lit(0)), F.lit("")).alias("first_key"))


@query("x28_unit_vector", "vectors", sql="""SELECT doc_id, round(list_sum(list_transform(h, lambda x: x * x)), 6) AS length2, round(h[1] / sqrt(list_sum(list_transform(h, lambda x: x * x))), 6) AS head
FROM (SELECT doc_id, CAST(embedding[1:16] AS DOUBLE[]) AS h FROM vectors)""")
def _(v):
    u = v.vectors.select("doc_id", F.slice("embedding", 1, 16).cast("array<double>").alias("h"), text.unit_vector(F.col("embedding"), 16).alias("u"))
    return u.select("doc_id", F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length2"), F.round(F.get("u", F.lit(0)), 6).alias("head"))


@query("x29_edge_label", "edges", sql="""SELECT edge_type, d.outbound, CASE edge_type WHEN 'parent_of' THEN CASE WHEN d.outbound THEN 'parent of' ELSE 'child of' END
 WHEN 'defines_entity' THEN CASE WHEN d.outbound THEN 'defines' ELSE 'defined by' END
 WHEN 'responsible_party_for' THEN CASE WHEN d.outbound THEN 'responsible party for' ELSE 'has responsible party' END ELSE edge_type END AS wording, CAST(count(*) AS BIGINT) AS n
FROM edges CROSS JOIN (SELECT true AS outbound UNION ALL SELECT false) d GROUP BY ALL""")
def _(v):
    both = v.edges.withColumn("outbound", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select("edge_type", "outbound", labels.edge_label(F.col("edge_type"), F.col("outbound")).alias("wording")).groupBy("edge_type", "outbound", "wording").agg(F.count("*").alias("n"))


@query("f1_types", "corpus", sql="SELECT id, type FROM corpus WHERE lower(type) IN ('en', 'fr')")
def _(v):
    return v.corpus.where(filters.of_types(F.col("type"), ["EN", "fr"])).select("id", "type")


@query("f2_scope", "docs", sql="SELECT id, doc_no FROM docs WHERE doc_no = 'A.2' OR starts_with(doc_no, 'A.2.')")
def _(v):
    return v.docs.where(filters.in_scope(F.col("doc_no"), "A.2")).select("id", "doc_no")


@query("f3_field_terms", "corpus", sql=r"SELECT id FROM corpus WHERE regexp_matches(content, '(?i)(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)') AND regexp_matches(content, '(?i)(?:^|[^A-Za-z0-9_])with(?:[^A-Za-z0-9_]|$)')")
def _(v):
    return v.corpus.where(filters.all_terms(F.col("content"), ["The", "with"])).select("id")


@query("f4_phrase", "corpus", sql=r"SELECT id FROM corpus WHERE regexp_matches(content, '(?i)(?:^|[^A-Za-z0-9_])licensed under the(?:[^A-Za-z0-9_]|$)') OR regexp_matches(title, '(?i)(?:^|[^A-Za-z0-9_])licensed under the(?:[^A-Za-z0-9_]|$)')")
def _(v):
    return v.corpus.where(filters.phrase(F.col("title"), F.col("content"), "licensed under the")).select("id")


@query("f5_exclusion", "corpus", sql="SELECT id FROM corpus WHERE NOT contains(lower(concat_ws(' ', title, content)), 'licensed') AND NOT contains(lower(concat_ws(' ', title, content)), 'token')")
def _(v):
    return v.corpus.where(filters.without(F.col("title"), F.col("content"), ["Licensed", "token"])).select("id")


@query("f6_numbered", "docs", sql="SELECT id, doc_no, depth FROM docs WHERE doc_no LIKE 'A.3.%' AND depth BETWEEN 2 AND 3")
def _(v):
    return filters.numbered(v.docs, like="A.3.%", shallowest=2, deepest=3).select("id", "doc_no", "depth")


@query("f7_status", "corpus", sql=r"SELECT id FROM corpus WHERE regexp_matches(content, '(?i)(?:^|[^A-Za-z0-9_])worthless(?:[^A-Za-z0-9_]|$)') OR regexp_matches(title, '(?i)(?:^|[^A-Za-z0-9_])worthless(?:[^A-Za-z0-9_]|$)')")
def _(v):
    return v.corpus.where(filters.phrase(F.col("title"), F.col("content"), "Worthless")).select("id")


@query("f8_history_window", "history", sql="SELECT DISTINCT doc_id FROM history WHERE change_type = 'moved' AND commit_seq > (SELECT max(commit_seq) FROM history WHERE change_type = 'moved') - 5")
def _(v):
    return filters.changed_ids(v.history, change_type="moved", last_commits=5)


@query("f9_structure", "docs", sql=r"""SELECT id, regexp_matches(doc_no, '\.0\.6\.[0-9]+$') AS is_active_data, regexp_matches(doc_no, '^A\.2\.8\.2\.[0-9]+$') AS is_accord,
regexp_matches(doc_no, '\.(0\.[34]|[0-9]+\.var[0-9]+)(\.[0-9]+)?$') AS is_annotation FROM docs""")
def _(v):
    return filters.structure_flags(v.docs).select("id", "is_active_data", "is_accord", "is_annotation")


@query("f10_keywords", "corpus", sql=r"""SELECT id, array_to_string(list_sort(list_filter([nullif(lower(regexp_extract(content, '(?i)(?:^|[^A-Za-z0-9_])(trash|idiot|license|token)(?:[^A-Za-z0-9_]|$)', 1)), ''),
 CASE WHEN contains(lower(content), 'apache license') THEN 'apache license' END], lambda k: k IS NOT NULL)), ',') AS keywords FROM corpus WHERE type <> 'es'""")
def _(v):
    hits = filters.keyword_hits(F.col("content"), ["trash", "idiot", "license", "token"], ["apache license"])
    return v.corpus.where("type <> 'es'").select("id", F.array_join(hits, ",").alias("keywords"))


@query("f13_name_score", "entities", sql="""SELECT id, name, CASE WHEN lower(name) = 'asia' THEN 3 WHEN starts_with(lower(name), 'asia') THEN 2 WHEN contains(lower(name), 'asia') THEN 1 END AS score
FROM entities WHERE contains(lower(name), 'asia')""")
def _(v):
    return v.entities.select("id", "name", filters.name_score(F.col("name"), "Asia").alias("score")).where("score > 0")


@query("f14_facets", "docs", "edges", sql="""SELECT d.id, d.type, e.from_id AS party FROM docs d LEFT JOIN edges e ON e.to_id = d.id AND e.edge_type = 'responsible_party_for'
WHERE d.depth = 4 AND d.type LIKE '1%' AND (e.from_id IS NULL OR e.from_id = 'S1')""")
def _(v):
    party = v.edges.where("edge_type = 'responsible_party_for'").select(F.col("to_id").alias("id"), F.col("from_id").alias("party"))
    rows = v.docs.where("depth = 4").join(party, "id", "left")
    return rows.where(F.col("type").startswith("1") & (F.col("party").isNull() | (F.col("party") == "S1"))).select("id", "type", "party")


@query("f15_visible_edges", "edges", "entities", sql="""SELECT edge_type, CAST(count(*) AS BIGINT) AS visible FROM edges
WHERE from_id NOT IN (SELECT id FROM entities WHERE entity_type = 'part') AND to_id NOT IN (SELECT id FROM entities WHERE entity_type = 'part') GROUP BY edge_type""")
def _(v):
    return filters.visible_edges(v.edges, v.entities.where("entity_type = 'part'")).groupBy("edge_type").agg(F.count("*").alias("visible"))
