"""Tables in folders that change by whole versions: touched buckets are written anew, a list of folders is the switch.

A version is a small table that names, for each table and bucket of keys, the folder with
its rows, and for each source of batches the last one taken. It is written beside and
renamed into place, so readers see the old version or the new one, never a part; what a
lost writer leaves behind is named by no version. Folders of untouched buckets are named
again as they are. A change may also be laid beside what a bucket has: its rows, and the
keys whose older rows no longer count, so that little is written where little changes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored
from .tables import ledger

#: Layers of keys laid beside a bucket, beyond which it is written anew.
LAYERS = 4
VERSION = "kind string, name string, bucket int, place string, number long"


class Conflict(RuntimeError):
    """Another writer has committed the next version first."""


class Versioned:
    """Tables under one folder (a path that Spark's file systems know), which change together."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _listed(self, version: int | None) -> list:
        number = self.version() if version is None else version
        # a row for each bucket of each table, whatever the rows in them
        return self.spark.read.schema(VERSION).parquet(f"{self.root}/versions/{number:012d}").collect() if number else []

    def taken(self, source: str) -> int | None:
        """The last batch of a source that a version has."""
        return next((r["number"] for r in self._listed(None) if r["kind"] == "batch" and r["name"] == source), None)

    def read(self, name: str, schema: StructType, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table in the last version or an older one, of all buckets or some; none if the table isn't there."""
        own = [r for r in self._listed(version) if r["name"] == name and (r["kind"] == "key" or buckets is None or r["bucket"] in buckets)]
        places, gone = ([(r["number"] or 0, f"{self.root}/{r['place']}") for r in own if r["kind"] == kind] for kind in ("bucket", "gone"))
        rows = self.spark.read.schema(schema)
        if not places:
            return self.spark.createDataFrame([], schema)
        if not gone:
            return rows.parquet(*[p for _, p in places])
        keys = next(json.loads(r["place"]) for r in own if r["kind"] == "key")
        found = None
        for number in sorted({n for n, _ in places}):  # a few layers
            layer = rows.parquet(*[p for n, p in places if n == number])
            if after := [p for n, p in gone if n > number]:
                on = F.lit(True)
                for n, k in enumerate(keys):
                    on &= F.col(f"_k{n}").eqNullSafe(F.col(f"g.k{n}"))
                layer = layer.withColumns({f"_k{n}": F.expr(k) for n, k in enumerate(keys)}).join(self.spark.read.parquet(*after).alias("g"), on, "left_anti").drop(*[f"_k{n}" for n in range(len(keys))])
            found = layer if found is None else found.unionByName(layer)
        return found

    def bucket(self, keys: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def part(self, keys: list[Column], parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), *keys), F.lit(parts))

    def deal(self, rows: DataFrame, key: Column) -> DataFrame:
        """Rows with _bucket and _part, dealt by them, so that a task has whole keys of few buckets."""
        parts = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets))
        return rows.withColumns({"_bucket": self.bucket([key]), "_part": self.part([key], parts)}).repartition("_bucket", "_part")

    def replace(self, changes: dict[str, tuple[DataFrame, DataFrame, list[str]]], source: str | None = None, batch: int | None = None, appended: dict[str, DataFrame] | None = None, beside: bool = False, dealt: bool = False) -> int:
        """Commits a version in which rows of some keys are others, and gives its number.

        changes: name -> (rows, keys that lose all rows they had, SQL of the key); rows have
        the table's columns, keys the columns k0, k1, ..., and every row's key is among the
        keys. A key's rows are in one bucket; a bucket of none of the keys is not touched. Tables in
        ``appended`` get rows beside all they have; such a table is never one of changes too.
        A batch of a source that a version has already is passed over. The expressions of a
        table's key are the same in each call. With ``beside`` rows that stay are not written
        again: rows and keys of the change are laid beside them, up to ``LAYERS`` times. ``dealt``
        says that rows are in tasks of few buckets each already, as ``deal`` leaves them.
        """
        if source is not None and batch is not None and (last := self.taken(source)) is not None and last >= batch:
            return self.version()
        before = self.version()
        listed = [tuple(r) for r in self._listed(before)]  # kind, name, bucket, place, number
        for name, (rows, gone, keys) in changes.items():
            key = [F.expr(k).alias(f"k{n}") for n, k in enumerate(keys)]
            own = [F.col(f"k{n}") for n in range(len(keys))]
            gone = gone.select(*own).distinct().withColumn("_bucket", self.bucket(own))
            fresh = rows.withColumn("_bucket", self.bucket([F.expr(k) for k in keys]))
            touched = [r[0] for r in gone.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                continue
            folder = f"data/{name}/{uuid.uuid4().hex}"
            # a bucket is dealt over as many tasks as there would be without buckets, by its keys
            parts = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(touched)))
            there = {r[2] for r in listed if r[:2] == ("bucket", name)} & set(touched)
            deepest = max([sum(r[:3] == ("gone", name, b) for r in listed) for b in there], default=0)
            laid = beside and bool(there) and deepest < LAYERS
            rest = fresh.withColumn("_part", self.part(key, parts))
            whole = bool(there) and not laid
            if whole:
                kept = self.read(name, rows.schema, before, touched).withColumns({f"k{n}": k for n, k in enumerate(key)})
                on = F.lit(True)
                for n in range(len(keys)):
                    on &= F.col(f"o.k{n}").eqNullSafe(F.col(f"g.k{n}"))
                kept = kept.alias("o").join(gone.alias("g"), on, "left_anti").withColumn("_bucket", self.bucket([F.col(f"k{n}") for n in range(len(keys))])).drop(*[f"k{n}" for n in range(len(keys))])
                rest = kept.withColumn("_part", self.part(key, parts)).unionByName(rest)
            if whole or not dealt:
                rest = rest.repartition("_bucket", "_part")
            rest.drop("_part").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            if laid:
                gone.where(F.col("_bucket").isin(*there)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}-gone")
                listed = [r for r in listed if r[:2] != ("key", name)] + [("key", name, -1, json.dumps(keys), None)]
                listed += [("gone", name, b, f"{folder}-gone/_bucket={b}", before + 1) for b in touched if b in there]
            else:
                listed = [r for r in listed if r[0] not in ("bucket", "gone") or r[1] != name or r[2] not in touched]
            written = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.getPath().getName().startswith("_bucket=")}
            listed += [("bucket", name, b, f"{folder}/_bucket={b}", before + 1 if laid else None) for b in touched if b in written]
        for name, rows in (appended or {}).items():
            folder = f"data/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folder}")
            listed.append(("bucket", name, -before - 1, folder, None))
        if source is not None and batch is not None:
            listed = [r for r in listed if r[:2] != ("batch", source)] + [("batch", source, -1, None, batch)]
        self._publish(before + 1, listed)
        return before + 1

    def _publish(self, number: int, rows: list[tuple]) -> None:
        beside = f"{self.root}/pending/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(beside)
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        target = self._path(f"{self.root}/versions/{number:012d}")
        if self._fs.exists(target) or not self._fs.rename(self._path(beside), target):
            raise Conflict(f"version {number} is there already")

    def upsert(self, name: str, rows: DataFrame, keys: list[str], deleted: str | None = None, order: str | None = None, source: str | None = None, batch: int | None = None) -> DataFrame:
        """Inserts and updates rows by key, deletes those whose column ``deleted`` is true, and gives the numbers of a ledger.

        keys are SQL expressions, compared null-safe, so "coalesce(chain, '')" takes null for
        empty. Of several rows of a key the one with the greatest ``order`` counts, then the
        greatest by all columns. Rows equal to what is there change nothing: a bucket of
        nothing but such rows keeps its files, and an upsert of nothing else makes no version.
        """
        columns = [c for c in rows.columns if c != deleted and c != order]
        key = {f"k{n}": F.expr(k) for n, k in enumerate(keys)}
        whole = F.struct(*([F.col(order).alias("_o")] if order else []), *[F.col(c) for c in columns], *([F.col(deleted).alias("_d")] if deleted else [F.lit(False).alias("_d")]))
        newest = rows.withColumns(key).groupBy(*key).agg(F.max(whole).alias("s")).select(*key, F.struct(*[F.col("s")[c].alias(c) for c in columns]).alias("new"), F.coalesce(F.col("s._d"), F.lit(False)).alias("_d"))
        schema = rows.select(*columns).schema
        touched = [r[0] for r in newest.select(self.bucket([F.col(k) for k in key])).distinct().collect()]
        had = self.read(name, schema, buckets=touched).withColumns(key).select(*key, F.struct(*columns).alias("old"))
        on = F.lit(True)
        for k in key:
            on &= F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        both = newest.alias("n").join(had.alias("o"), on, "left").select(*[F.col(f"n.{k}").alias(k) for k in key], "new", "old", "_d")
        op = F.when(F.col("_d"), F.when(F.col("old").isNotNull(), "D").otherwise("=")).when(F.col("old").isNull(), "I").when(F.col("old").eqNullSafe(F.col("new")), "=").otherwise("U")
        both = both.withColumn("op", op)
        # what changes is written once; rows that stay leave their key's count alone
        both = stored(both.select(*key, F.when(F.col("op") != "=", F.col("new")).alias("new"), "op"), "upsert")
        counted = ledger(both)
        moved = both.where("op <> '='")
        numbers = counted.first()
        if any(numbers[c] for c in ("inserted", "updated", "deleted")):
            self.replace({name: (moved.where("op <> 'D'").select("new.*"), moved.select(*key), keys)}, source, batch)
        return self.spark.createDataFrame([tuple(numbers)], counted.schema)
