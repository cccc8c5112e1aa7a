"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

1. Equal vectors of one label are one class with a count. Classes are normalised, so that
   a cosine bound is a bound on distance.
2. In each of several tables a vector's bucket is the tuple of its quantised projections
   on normal directions. Only bucket keys and ids are dealt by bucket: a bucket's home is
   the least id in it, and buckets of one vector alone are left out.
3. A vector goes once to each distinct home of its buckets, however many tables lead there,
   with the list of its homes. Vectors of one home are compared exactly, and a pair is
   counted in the least home that both have, which their lists tell without listing pairs.
   A home of over ``BLOCK`` classes is dealt in cells of two blocks, so no task holds a
   whole home and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .components import connected_components
from .words import forest, mix, runs

#: Tables, projections in each, and the width of a quantum: at cosine 0.93 a pair shares
#: one of the tables with a probability over 0.998, and closer pairs more often; of vectors
#: that are not alike, one in 100,000 shares the bucket of a table.
TABLES, PROJECTIONS, WIDTH = 88, 16, 2.0
BLOCK = 1024
#: Shared buckets up to which their homes are broadcast (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def unit_rows(values: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    raw = np.array(values, np.float64).reshape(-1, dim)
    raw = raw / np.abs(raw).max(1, keepdims=True)  # no overflow of squares
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


class PStable:
    """Bucket keys of unit vectors of one dimension."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.direction = rng.standard_normal((dim, tables * projections))
        self.offset = rng.uniform(0, width, tables * projections)
        self.weight = rng.integers(0, 1 << 64, projections, dtype=np.uint64) | np.uint64(1)
        self.shape, self.width = (tables, projections), width

    def keys(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """A key for each vector and table, also by label."""
        quanta = np.floor((unit @ self.direction + self.offset) / self.width).astype(np.int64).view(np.uint64)
        tables = np.arange(self.shape[0], dtype=np.uint64)
        key = (quanta.reshape(-1, *self.shape) * self.weight).sum(2, dtype=np.uint64)
        return mix(mix(key + tables * np.uint64(0x9E3779B97F4A7C15)) ^ label.astype(np.int64).view(np.uint64)[:, None]).view(np.int64)


def _hash(batches: Iterator[pa.RecordBatch], tables: int, projections: int, width: float, seed: int) -> Iterator[pa.RecordBatch]:
    made: dict[int, PStable] = {}
    for batch in batches:
        sizes = np.diff(batch.column("vector").offsets.to_numpy())
        for dim in np.unique(sizes):
            dim = int(dim)
            pick = batch.filter(pa.array(sizes == dim))
            unit = unit_rows(pick.column("vector").flatten().to_numpy(), dim)
            family = made.setdefault(dim, PStable(dim, tables, projections, width, seed))
            label = pick.column("label").to_numpy()
            keys = family.keys(unit, label * 1_000_003 + dim)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pick.column("rep"), listed], names=["rep", "keys"])


def _lower_homes(home: int, at: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """A row for each list of sorted homes: its homes below this one as numbers, filled up with -1."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    below = homes < home
    count = np.bincount(row[below], minlength=len(at) - 1)
    out = np.full((len(at) - 1, int(count.max()) if len(count) else 0), -1, np.int64)
    if below.any():
        places = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[row[below], places] = np.unique(homes[below], return_inverse=True)[1]
    return out


def _counted_here(lower: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether no home below this one is in the lists of both vectors."""
    here = np.ones(len(i), bool)
    for k in range(lower.shape[1]):
        look = np.flatnonzero(here & (lower[i, k] >= 0))
        if len(look):
            here[look] = ~(lower[j[look]] == lower[i[look], k][:, None]).any(1)
    return here


def _compare(batches: Iterator[pa.RecordBatch], least_cosine: float) -> Iterator[pa.RecordBatch]:
    """rep with links to count and rep with a lower rep that it leads to; rows come sorted by cell."""
    for t in runs(batches, ["home", "cell_a", "cell_b"]):
        cells = np.stack([t.column(c).to_numpy() for c in ("home", "cell_a", "cell_b")])
        starts = np.flatnonzero(np.concatenate([[True], (cells[:, 1:] != cells[:, :-1]).any(0)]))
        rep, n, label, block = (t.column(c).to_numpy() for c in ("rep", "n", "label", "block"))
        lists, vectors = t.column("homes").combine_chunks(), t.column("vector").combine_chunks()
        list_at, vector_at = lists.offsets.to_numpy(), vectors.offsets.to_numpy()
        all_homes, all_values = lists.values.to_numpy(), vectors.values.to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(starts, [*starts[1:], len(rep)], strict=True):
            if e - s < 2 or len({*np.diff(vector_at[s : e + 1])}) > 1:
                continue
            unit = unit_rows(all_values[vector_at[s] : vector_at[e]], int(vector_at[s + 1] - vector_at[s]))
            lower = _lower_homes(int(cells[0, s]), list_at[s : e + 1] - list_at[s], all_homes[list_at[s] : list_at[e]])
            for at in range(s, e, 512):
                to = min(e, at + 512)
                i, j = np.nonzero(unit[at - s : to - s] @ unit.T >= least_cosine)
                i += at - s
                ok = (rep[s + i] < rep[s + j]) & (label[s + i] == label[s + j])
                if cells[1, s] != cells[2, s]:  # two blocks: pairs inside one are another cell's
                    ok &= block[s + i] != block[s + j]
                i, j = i[ok], j[ok]
                if len(i):
                    here = _counted_here(lower, i, j)
                    found.append((s + i[here], s + j[here]))
        if not found:
            continue
        i, j = (np.concatenate([f[k] for f in found]) for k in range(2))
        if not len(i):
            continue
        nodes, where = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
        links = np.bincount(where, np.concatenate([n[j], n[i]])).astype(np.int64)
        x, y = forest(rep[i], rep[j])
        least = nodes.copy()
        least[np.searchsorted(nodes, x)] = y
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(least)], names=["rep", "links", "least"])


def near_groups(vectors: DataFrame, least_cosine: float = 0.93, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two rows link if their labels are equal and not null, their vectors have equal
    lengths and their cosine in double precision is ``least_cosine`` or more. Vectors
    that are null, empty, zero or hold a null or a value that is not finite link with
    nothing, nor do rows with a null vec_id, whose component_id and kept are null.
    Repeated rows link with each other. Other columns are ignored. The hash finds a pair
    at the bound with a probability over 0.998.
    """
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # floats travel as they are
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    sound &= F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})  # a vector's name, of 128 bits
    name = ["label", "h1", "h2"]
    classes = store(rows.where(sound).groupBy(*name).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")), "vector-classes")
    keyed = classes.select("rep", "label", "vector").mapInArrow(lambda it: _hash(it, tables, projections, width, seed), "rep long, keys array<long>")
    keyed = store(keyed, "vector-keys").select("rep", F.explode("keys").alias("key"))

    homes = store(keyed.groupBy("key").agg(F.min("rep").alias("home"), F.max("rep").alias("last")).where("home < last").select("key", "home"), "homes")
    if homes.count() <= BROADCAST_ROWS:
        homes = F.broadcast(homes)
    listed = store(keyed.join(homes, "key").groupBy("rep").agg(F.array_sort(F.collect_set("home")).alias("homes")), "home-lists")
    sizes = listed.select(F.explode("homes").alias("home")).groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.select("rep", "n", "label", "vector").join(listed, "rep").withColumn("home", F.explode("homes")).join(sizes, "home")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("across", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"cell_a": F.least("block", "across"), "cell_b": F.greatest("block", "across")})
    order = ["home", "cell_a", "cell_b"]
    compared = dealt.select(*order, "rep", "n", "label", "block", "homes", "vector").repartition(*order).sortWithinPartitions(*order)
    links = store(compared.mapInArrow(lambda it: _compare(it, least_cosine), "rep long, links long, least long"), "vector-links")

    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(links, "rep", "least").withColumnRenamed("node", "rep")
    known = classes.select(*name, "rep", "n").join(counts, "rep", "left").join(groups, "rep", "left")
    known = known.select(*name, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where(sound).select("vec_id", *name).join(known, name).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
