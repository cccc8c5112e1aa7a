"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only.

An item with n shingles that a document holds to a share t or more has at most n - ceil(t n)
shingles that the document lacks. Items are partitioned by size, in powers of two. A
partition has its own length of signature: the most that its items may lack, and
``HITS`` more. An item's MinHash signature is so many of its least shingle hashes, and
its threshold is the number of them that a document must hold: all but those the item
may lack. The search looks up every shingle hash of a document in the signatures and
counts hits for each item; what reaches its threshold is a candidate. So a short item in
a document of any length is never missed, which a fixed signature of the document could
not promise, and a long item needs several hits to be looked at.

Candidates are then verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

#: Signature rows up to which they are broadcast (32 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes of items up to which they are broadcast to be verified; beyond, they are joined by shuffle, each in SALTS copies.
BROADCAST_BYTES, SALTS = 64 << 20, 16
#: Hits of its signature that an item needs, as far as it has shingles enough.
HITS = 3
#: What stands between words: anything but letters and digits.
BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _of(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _starts(words: Column, n: Column) -> Column:
    return F.when((F.size(words) >= n) & (n > 0), F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, n: int) -> Column:
    return _of(words, lambda w: F.transform(_starts(w, F.lit(n)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))


def shingles(words: Column, n: Column) -> Column:
    return _of(words, lambda w: F.array_distinct(F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))))


def item_shingles(items: DataFrame, n: int) -> DataFrame:
    """item_id, width (n, or the item's words if they are fewer) and wanted, its distinct runs of so many words."""
    items = items.withColumn("width", F.least(F.lit(n), F.size(words_of(F.col("text"))))).where("width > 0")
    return items.select("item_id", "width", shingles(words_of(F.col("text")), F.col("width")).alias("wanted"))


def signatures(items: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """hash, item_id, width, partition and threshold of the least hashes of each item, as many as its partition has."""
    a, b = share
    lacks = lambda size: size - F.ceil(size * a / b)
    hashed = item_shingles(items, n).withColumn("hashes", F.array_sort(F.transform("wanted", lambda s: F.xxhash64(F.split(s, " ")))))
    hashed = hashed.withColumn("hashes", F.array_distinct("hashes")).withColumn("partition", F.ceil(F.log2(F.size("hashes"))).cast("int"))
    length = (lacks(F.pow(F.lit(2), F.col("partition")).cast("long")) + HITS).cast("int")
    signed = hashed.withColumn("signature", F.slice("hashes", F.lit(1), length))
    threshold = F.size("signature") - lacks(F.size("hashes").cast("long"))
    return signed.select("item_id", "width", "partition", threshold.cast("int").alias("threshold"), F.explode("signature").alias("hash"))


def candidates(docs: DataFrame, items: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """doc_id and item_id where a document holds as many hashes of the item's signature as its threshold asks for."""
    signed = store(signatures(items, n, share).distinct(), "signatures")
    bound = signed.agg(F.count("*").alias("rows"), F.max("hash").alias("highest"), F.collect_set("width").alias("widths")).first()
    if bound["rows"] <= BROADCAST_ROWS:
        signed = F.broadcast(signed)
    widths = sorted(bound["widths"]) or [n]
    hashes = _of(words_of(F.col("text")), lambda w: F.concat(*[shingle_hashes(w, width) for width in widths]))
    probes = F.filter(hashes, lambda h: h <= F.lit(bound["highest"]).cast("long"))
    hits = docs.select("doc_id", F.explode(probes).alias("hash")).join(signed, "hash").select("doc_id", "item_id", "threshold", "hash").distinct()
    counted = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.min("threshold").alias("threshold"))
    return counted.where("hits >= threshold").select("doc_id", "item_id")


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, share: tuple[int, int] = (8, 10)) -> DataFrame:
    """doc_id, item_id, item_shingles, found and containment of all pairs with found / item_shingles >= share.

    Shingles are runs of n words, lower-cased, of letters and digits. An item of fewer
    words has its whole sequence as its one shingle, and is found where these words stand
    in a row. Texts that are null or have no words hold nothing and are found nowhere.
    Rows with a null doc_id or item_id are in no pair. Rows of one id count as one, with
    their best text. Other columns are ignored; no items or no documents give an empty table.
    """
    a, b = share
    docs, items = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), items.select("item_id", "text").where(F.col("item_id").isNotNull())
    found = store(candidates(docs, items, n, share), "candidates")
    wanted = store(item_shingles(items, n), "items")
    if (wanted.agg(F.sum(F.octet_length(F.array_join("wanted", " ")))).first()[0] or 0) <= BROADCAST_BYTES:
        paired = docs.join(found, "doc_id").join(F.broadcast(wanted), "item_id")
    else:  # an item that most documents hold is dealt over several tasks
        copies = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copies, ["item_id", "salt"]).drop("salt")
        paired = docs.join(asked, "doc_id")
    inside = F.size(F.array_intersect("wanted", shingles(words_of(F.col("text")), F.col("width")))).cast("long")
    held = paired.select("doc_id", "item_id", F.size("wanted").cast("long").alias("item_shingles"), inside.alias("found"))
    held = held.where(F.col("found") * b >= F.col("item_shingles") * a)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc(F.col("found") / F.col("item_shingles")), F.desc("item_shingles"))
    once = held.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
    return once.withColumn("containment", F.col("found") / F.col("item_shingles"))
