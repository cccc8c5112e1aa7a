"""Joins, aggregates, picks and set operations that reports and loads are built from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import digests


def version_pairs(prev: DataFrame, curr: DataFrame, key: str = "id") -> DataFrame:
    """Rows of two versions side by side as structs p and c, null where a version lacks the key."""
    p = prev.select(key, F.struct(*[c for c in prev.columns if c != key]).alias("p"))
    c = curr.select(key, F.struct(*[c for c in curr.columns if c != key]).alias("c"))
    return p.join(c, key, "full")


def reconcile(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with op: I for rows to insert, U to update, D to delete, = for those that stay; null keys compare as equal."""
    values = [c for c in source.columns if c not in keys]
    on = F.lit(True)
    t, s = target.alias("t"), source.alias("s")
    for k in keys:
        on &= F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    same = F.lit(True)
    for v in values:
        same &= F.col(f"t.{v}").eqNullSafe(F.col(f"s.{v}"))
    joined = t.withColumn("_t", F.lit(True)).alias("t").join(s.withColumn("_s", F.lit(True)).alias("s"), on, "full")
    op = F.when(F.col("t._t").isNull(), "I").when(F.col("s._s").isNull(), "D").when(same, "=").otherwise("U")
    return joined.select(*[F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in keys], op.alias("op"))


def ledger(ops: DataFrame) -> DataFrame:
    """One row with the numbers of inserted, updated, deleted and unchanged rows."""
    return ops.agg(*[F.count_if(F.col("op") == o).alias(n) for o, n in (("I", "inserted"), ("U", "updated"), ("D", "deleted"), ("=", "unchanged"))])


def new_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source, once for each key, whose key the target lacks."""
    return source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def longest_first(labels: Column) -> Column:
    """Distinct labels, longest first, ties by text."""
    order = lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(F.array_distinct(labels), order)), lambda s: s["x"])


def at_fractions(df: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """key with the values at floor(n * fraction) of its sorted values, the last at most; equal values are counted, not gathered."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(key).orderBy(value)
    counts = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(key))})
    at = lambda f: F.least(F.floor(F.col("_all") * F.lit(f)), F.col("_all") - 1)
    return counts.groupBy(key).agg(*[F.min(F.when(F.col("_upto") > at(f), F.col(value))).alias(name) for name, f in fractions.items()])


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """name, rows and an order-free checksum of a table."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(row).cast("string").alias("checksum"))


def glossary_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id and each term (term: lower-case words of a-z with one space between them) that a text (id, content) has as whole words, once, however the text parts them.

    A text is put into words once and each term is looked for in it; its runs of words are not made, as
    they are several times the text.
    """
    words = texts.select("id", F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("content"), "[^a-z]+", " ")), F.lit(" ")).alias("_words"))
    return words.join(F.broadcast(terms.select("term").distinct()), F.expr("contains(_words, concat(' ', term, ' '))")).select("id", "term")


#: Files of more bytes than that are hashed by blocks.
WHOLE = 128 << 20


def file_manifest(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """name, file, bytes and sha256 of every file of each folder or file (name -> path). Spark's reader passes over files without bytes.

    A file of up to ``WHOLE`` bytes is read by one task; a larger one by many, a block each (``digests.chained``), as this is called.
    Only files that Spark's reader of lines would unpack are read whole whatever their size, and all are where OpenSSL isn't found.
    """
    name_of = lambda path: F.element_at(F.split(path, "/"), -1)
    read = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    own = lambda name, files: files.select(F.lit(name).alias("name"), name_of("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    files = {name: read(path) for name, path in folders.items()}
    if digests.openssl() is None:
        return reduce(DataFrame.unionByName, [own(name, df) for name, df in files.items()])
    large = reduce(DataFrame.unionByName, [df.where(F.col("length") > WHOLE).select(F.lit(name).alias("name"), "path", "length") for name, df in files.items()]).collect()
    rows = [own(name, df.where(F.col("length") <= WHOLE)) for name, df in files.items()]
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    packed = {r["path"] for r in large if codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path(r["path"])) is not None}
    rows += [own(r["name"], read(digests.plain(r["path"]))) for r in large if r["path"] in packed]
    if lengths := {r["path"]: r["length"] for r in large if r["path"] not in packed}:
        hashes = digests.chained(spark, lengths)
        chained = spark.createDataFrame([(r["name"], r["path"], r["length"], hashes[r["path"]]) for r in large if r["path"] in hashes], "name string, path string, bytes long, sha256 string")
        rows.append(chained.select("name", name_of("path").alias("file"), "bytes", "sha256"))
    return reduce(DataFrame.unionByName, rows)


def merkle_roots(manifest: DataFrame) -> DataFrame:
    """name, files, bytes and root of a manifest: its files' hashes in the order of their names (then hashes), hashed two by two until one is left.

    A hash without a partner moves up as it is. Pairs of a level are hashed by many tasks;
    the number of rounds grows with the logarithm of the files.
    """
    place = F.row_number().over(Window.partitionBy("name").orderBy("file", "sha256")) - 1
    level = manifest.select("name", place.alias("at"), F.col("sha256").alias("hash"))
    most = manifest.groupBy("name").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        two = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda h: h["hash"])
        level = level.groupBy("name", F.floor(F.col("at") / 2).alias("at")).agg(two.alias("two"))
        level = level.select("name", "at", F.when(F.size("two") == 2, F.sha2(F.array_join("two", ""), 256)).otherwise(F.get("two", F.lit(0))).alias("hash"))
        most = -(-most // 2)
    sums = manifest.groupBy("name").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return sums.join(level.select("name", F.col("hash").alias("root")), "name")


def changed_files(manifest: DataFrame, pinned: DataFrame) -> DataFrame:
    """name, file and fault (missing, new, changed) of files that differ from a pinned manifest."""
    old = pinned.select("name", "file", F.struct("bytes", "sha256").alias("old"))
    both = manifest.select("name", "file", F.struct("bytes", "sha256").alias("now")).join(old, ["name", "file"], "full")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("now") != F.col("old"), "changed")
    return both.select("name", "file", fault.alias("fault")).where("fault IS NOT NULL")
