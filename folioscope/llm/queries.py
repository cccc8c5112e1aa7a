"""The registered queries of this package, opN_<name>, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing, near_vectors, ngram_join, pii, prefix_trie, quality, sharding, substring, token_output, toxicity, whitening
from .common import table, word_count


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(docs, F.col("words"), lambda s: mixing.cyclic_weights(s, (5.0, 2.0, 1.0)), max_epochs=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM r),
v AS (SELECT arg_min(lev, (ratio, source)) AS lev FROM l WHERE lev * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN v.lev IS NULL THEN cap ELSE least(cap, v.lev * weight) END AS target FROM l LEFT JOIN v ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS gap,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN gap > 0 AND size > 0 AND prior + size / 2.0 <= gap THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p
"""


PLANTED = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    events = rows.unionByName(own).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"), "role", "text")
    read = chat.parse(chat.render(chat.fold(events)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, 10 + len(role) + len(text)
    + len(regexp_extract_all(concat(role, text), '<\\*(?:s>|r>|/s>|unk>)')) + len(regexp_extract_all(concat(role, text), '\[\\*(?:INST\]|/INST\])')) AS chars FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, threshold=0.7)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), n=3, a=90, b=100)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return token_output.token_digests(token_output.read_tokens(spark, path))


#: Key of the registered query; a real run takes its own from a secret store.
PII_KEY = "folioscope"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, PII_KEY).select("doc_id", "text", "n_entities", "kinds")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_groups(table(spark, sf_dir, "embeddings"), least_cosine=0.93)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - k + 2)), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM d, k),
si AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda j: array_to_string(w[j:j + least(len(w), 5) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, CAST(count(*) AS BIGINT) AS item_shingles FROM si GROUP BY item_id)
SELECT doc_id, item_id, any_value(item_shingles) AS item_shingles, CAST(count(*) AS BIGINT) AS found, count(*) / any_value(item_shingles) AS containment
FROM ds JOIN si USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 10 >= any_value(item_shingles) * 8
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=50, digest=True)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, threshold=0.7)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = prefix_trie.rebranched(prefix_trie.numbered(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, ids)


OP13_SQL = r"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS d, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT list(v ORDER BY i) AS f FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) g(i))),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, f.f[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM o), f),
r AS (
  SELECT h.c, o.d, o.role, o.text FROM h JOIN o ON o.c = h.c - h.c % 5 AND o.d <= h.h
  UNION ALL SELECT h.c, o.d, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.d > h.h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY d) AS d, md5(concat(len(role), ':', role, text)) AS m, strlen(text) AS b FROM r),
p AS (SELECT c, d, b, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS k, CASE WHEN d > 1 THEN string_agg(m, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE '' END AS q FROM t
  UNION ALL SELECT c, 0, 0, '', NULL FROM h),
n AS (SELECT k, any_value(q) AS q, any_value(d) AS depth, any_value(b) AS b, min(c) AS conv_id, count(*) AS n_convs FROM p GROUP BY k),
w AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.q = n.k) AS n_children, CASE WHEN n.q IS NOT NULL THEN (SELECT conv_id FROM n x WHERE x.k = n.q) END AS parent_conv_id FROM n),
s AS (SELECT p.k, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.b) AS saved_tokens FROM p JOIN w ON w.conv_id = p.c AND w.depth >= p.d GROUP BY p.k),
e AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM (SELECT c, arg_max(k, d) AS k FROM p GROUP BY c) GROUP BY k)
SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM w JOIN s ON s.k = w.k LEFT JOIN e ON e.k = w.k
"""


#: Components of links (a, b) among nodes (id) by closure.
CLOSURE = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, b AS other FROM both_ways UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
least AS (SELECT id, min(other) AS other FROM reach GROUP BY id)"""

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
@CLOSURE@
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, l.other) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id
""".replace("@CLOSURE@", CLOSURE)

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND norm > 0 AND isfinite(norm) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_sum(list_transform(range(1, len(x.e) + 1), lambda k: x.e[k] * y.e[k])) / (x.norm * y.norm) >= 0.93),
@CLOSURE@,
c AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(v.vec_id, l.other) AS component_id, v.vec_id = least(v.vec_id, l.other) AS kept
FROM v LEFT JOIN c ON c.id = v.vec_id LEFT JOIN least l ON l.id = v.vec_id
""".replace("@CLOSURE@", CLOSURE)

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - 48))) AS k, w FROM d),
g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
c AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT g.doc_id, unnest(range(g.k, g.k + 50)) AS i FROM g JOIN f ON f.h = g.h AND f.low < g.doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""

QUERIES = {"op1_mixing": op1_mixing, "op2_chat": op2_chat, "op3_toxicity": op3_toxicity, "op4_ngram_join": op4_ngram_join, "op5_token_output": op5_token_output, "op6_pii": op6_pii, "op7_near_vectors": op7_near_vectors, "op8_decontaminate": op8_decontaminate, "op9_sharding": op9_sharding, "op10_substring": op10_substring,
           "op11_quality": op11_quality, "op12_whitening": op12_whitening, "op13_prefix_trie": op13_prefix_trie}
ORACLE = {"op1_mixing": OP1_SQL, "op2_chat": OP2_SQL, "op4_ngram_join": OP4_SQL, "op7_near_vectors": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_substring": OP10_SQL, "op13_prefix_trie": OP13_SQL}
