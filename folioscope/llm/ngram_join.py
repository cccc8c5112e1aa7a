"""N-gram Jaccard join by prefix trees: groups of documents whose shingle sets are alike.

1. Each text becomes its set of n-word shingles in one global order: hashes by value,
   those that are frequent in some part of the corpus last. The order decides how much
   work there is, never the result.
2. Documents of equal sets are one class. Two classes can only be alike if they share a
   shingle of their prefixes (the first |x| - ceil(t |x|) + 1 in order), so prefixes are
   dealt by shingle. Bounds on length, position and a short parity bitmap of the whole set
   leave few postings; these are dealt again with a bitmap of a bit for each shingle of the
   set, whose differences bound the sets' difference so closely that hardly more than
   similar documents become candidates. These only say what has to be looked at together.
   A shingle that very many prefixes have is dealt in cells of two blocks of documents.
3. Each cluster of candidates has its whole sets stored in a trie in global order.
   Sets walk down the trie and share the overlap of common paths; a subtree is left when
   what remains of both sides cannot reach the overlap that its lengths need, or when all
   of it is already joined to the walker. Every link is decided on whole sets.
4. A cluster over ``BLOCK`` documents or ``BLOCK_SHINGLES`` shingles is dealt in blocks,
   each with the cluster's first document. What is joined to that document is done; what
   is not is then compared with every block of its cluster, so that no link between
   components is missed. As blocks are large, a text is sent to few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .components import connected_components
from .words import batches_of, mix, runs, shingle_sets, text_bytes

#: Documents, and shingles of documents, of a cluster that one task compares at once.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Documents with one prefix shingle that are looked at together.
RUN_BLOCK = 256
#: Documents whose links a task remembers, so as not to repeat them.
REMEMBERED = 1_000_000
#: Frequent shingles that the order puts last: the most frequent ones of those that a
#: batch of documents holds at least so often. The list is broadcast (8 bytes each).
FREQUENT, FREQUENT_IN_BATCH = 100_000, 4
#: Up to this size of a run of equal prefix shingles all pairs are looked at by offsets.
SMALL_RUN = 32

TOP = np.uint64(1 << 63)
FEATURES = "doc_id long, n_shingles int, s1 long, s2 long, b1 long, b2 long, bitmap binary, prefix array<long>"
POSTINGS = "token long, doc_id long, place long"
LINKS = "a long, b long"


def _lower(texts: pa.Array) -> list[bytes]:
    return [t.lower() for t in text_bytes(texts)]


def _count_frequent(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, "text"):
        sets = {s.tobytes(): s for s in shingle_sets(_lower(batch.column("text")), n)}
        found, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        often = times >= FREQUENT_IN_BATCH
        yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["shingle", "times"])


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of the most frequent shingles, at most ``FREQUENT``."""
    counted = docs.select("text").mapInArrow(lambda it: _count_frequent(it, n), "shingle long, times long")
    rows = counted.groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(FREQUENT).select("shingle")
    return np.sort(rows.toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles at each of as many places as the set has shingles, up to a power of two."""
    places = 1 << max(7, int(len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(x: tuple[int, int], y: tuple[int, int]) -> int:
    """Places at which two bitmaps (value, size in bits) differ, the larger folded to the size of the smaller."""
    (a, m), (b, k) = (x, y) if x[1] >= y[1] else (y, x)
    while m > k:
        m //= 2
        a = (a >> m) ^ (a & ((1 << m) - 1))
    return (a ^ b).bit_count()


class Order:
    """The global order: a shingle's hash, with the top bit set if it is frequent."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[frequent >> np.uint64(44)] = True

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = shingles >> np.uint64(1)
        if len(self.frequent):
            look = np.flatnonzero(self.maybe[shingles >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.frequent, shingles[look]), len(self.frequent) - 1)
            out[look[self.frequent[at] == shingles[look]]] |= TOP
        return np.sort(out)


def _features(batches: Iterator[pa.RecordBatch], n: int, a: int, b: int, frequent) -> Iterator[pa.RecordBatch]:
    order = Order(frequent.value)
    for batch in batches_of(batches, "text"):
        sets = [order(s) for s in shingle_sets(_lower(batch.column("text")), n)]
        size = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
        full = size > 0

        def total(op, values, full=full, at=at):
            out = np.zeros(len(full), np.uint64)
            if full.any():
                out[full] = op.reduceat(values[:-1], at[:-1][full])
            return pa.array(out.view(np.int64))

        # parity of the hash's low bits in two words of 64
        bit, half = np.uint64(1) << (flat & np.uint64(63)), (flat & np.uint64(64)) > 0
        prefix = np.where(full, size - -(-a * size // b) + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(prefix)])
        taken = np.concatenate([s[:p] for s, p in zip(sets, prefix, strict=True)]) if len(sets) else flat[:0]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(size.astype(np.int32)), total(np.add, flat), total(np.add, mix(flat)),
            total(np.bitwise_xor, np.where(half, bit, np.uint64(0))), total(np.bitwise_xor, np.where(half, np.uint64(0), bit)),
            pa.array([parity_bitmap(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(taken.view(np.int64))),
        ], names=["doc_id", "n_shingles", "s1", "s2", "b1", "b2", "bitmap", "prefix"])


class _Postings:
    """Bounds on pairs of postings: the overlap that is still possible against the one that is needed."""

    def __init__(self, t: pa.Table, a: int, b: int):
        self.a, self.b = a, b
        self.token, self.doc, self.place = (t.column(c).to_numpy() for c in ("token", "doc_id", "place"))
        self.n, self.pos = self.place >> 32, self.place & 0xFFFFFFFF
        edge = np.concatenate([[True], self.token[1:] != self.token[:-1]])
        self.block = t.column("block").to_numpy() if "block" in t.column_names else None
        if self.block is not None:
            cell = [t.column(c).to_numpy() for c in ("cell_a", "cell_b")]
            self.across = cell[0] != cell[1]
            for c in cell:
                edge[1:] |= c[1:] != c[:-1]
        self.starts = np.flatnonzero(edge)
        self.lengths = np.diff(np.concatenate([self.starts, [len(self.token)]]))
        self.end = np.repeat(self.starts + self.lengths, self.lengths)

    def need(self, i, j):
        return -(-self.a * (self.n[i] + self.n[j]) // (self.a + self.b))

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = self.n[i], self.n[j]
        left = np.minimum(x - self.pos[i], y - self.pos[j]) + np.minimum(self.pos[i], self.pos[j])
        ok = (self.b * np.minimum(x, y) >= self.a * np.maximum(x, y)) & (left >= self.need(i, j)) & (self.doc[i] != self.doc[j])
        if self.block is not None:  # of two blocks: pairs inside one are another cell's
            ok &= ~self.across[i] | (self.block[i] != self.block[j])
        return ok

    def short_runs(self):
        """Pairs of rows of runs of two to SMALL_RUN postings."""
        rows = np.flatnonzero(np.repeat((self.lengths > 1) & (self.lengths <= SMALL_RUN), self.lengths))
        for k in range(1, SMALL_RUN):
            rows = rows[rows + k < self.end[rows]]
            if not len(rows):
                break
            ok = rows[self.possible(rows, rows + k)]
            yield ok, ok + k

    def long_runs(self):
        long = self.lengths > SMALL_RUN
        yield from zip(self.starts[long].tolist(), self.lengths[long].tolist(), strict=True)


def _bounded_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted postings in tables that cut no run of up to SMALL_RUN; what is longer comes in pieces, marked as such."""
    held: pa.Table | None = None
    passing = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if passing is not None:
            token = t.column("token").to_numpy()
            own = len(token) if (token == passing).all() else int(np.argmax(token != passing))
            if own:
                yield t.slice(0, own), True
            t = t.slice(own)
            passing = passing if not t.num_rows else None
        if held is not None:
            t, held = pa.concat_tables([held, t]).combine_chunks(), None
        if not t.num_rows:
            continue
        token = t.column("token").to_numpy()
        last = int(np.flatnonzero(token != token[-1])[-1]) + 1 if (token != token[-1]).any() else 0
        if last:
            yield t.slice(0, last).combine_chunks(), False
        t = t.slice(last)
        if t.num_rows > SMALL_RUN:
            passing = token[-1]
            yield t, True
        else:
            held = t
    if held is not None:
        yield held.combine_chunks(), False


def _shared(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Postings that may have a partner; rows come sorted by shingle."""
    for t, long in _bounded_runs(batches):
        p = _Postings(t, a, b)
        keep = np.full(len(p.token), long)
        if not long:
            b1, b2 = (t.column(c).to_numpy().view(np.uint64) for c in ("b1", "b2"))
            for i, j in p.short_runs():
                apart = np.bitwise_count(b1[i] ^ b1[j]).astype(np.int64) + np.bitwise_count(b2[i] ^ b2[j])
                ok = apart <= p.n[i] + p.n[j] - 2 * p.need(i, j)
                keep[i[ok]] = keep[j[ok]] = True
            for s, length in p.long_runs():
                keep[s : s + length] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (p.token, p.doc, p.place)], names=["token", "doc_id", "place"])


def _candidates(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Links that join all documents that share a prefix shingle and may be alike; rows come sorted by shingle and cell."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for t in runs(batches, ["token", "cell_a", "cell_b"]):
        p = _Postings(t, a, b)
        if len(parent) > REMEMBERED:  # some links may come again
            parent.clear()
        maps: dict[int, tuple[int, int]] = {}
        for doc, raw in zip(p.doc.tolist(), t.column("bitmap").to_pylist(), strict=True):
            if doc not in maps:
                maps[doc] = (int.from_bytes(raw, "little"), 8 * len(raw))
        new: list[tuple[int, int]] = []

        def look(i: np.ndarray, j: np.ndarray, p=p, new=new, maps=maps) -> None:
            most = p.n[i] + p.n[j] - 2 * p.need(i, j)
            for x, y, m in zip(p.doc[i].tolist(), p.doc[j].tolist(), most.tolist(), strict=True):
                u, w = find(x), find(y)
                if u != w and _apart(maps[x], maps[y]) <= m:
                    parent[max(u, w)] = min(u, w)
                    new.append((max(u, w), min(u, w)))

        for i, j in p.short_runs():
            look(i, j)
        for s, length in p.long_runs():
            docs = p.doc[s : s + length].tolist()
            for i in range(length - 1):
                roots = [find(d) for d in docs]
                rest = np.array([k for k in range(i + 1, length) if roots[k] != roots[i]], np.int64)
                if not len(rest):
                    if len(set(roots)) == 1:
                        break
                    continue
                rest = rest[p.possible(np.full(len(rest), s + i), s + rest)]
                look(np.full(len(rest), s + i), s + rest)
        if new:
            x = np.array(new, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


class Trie:
    """Sets in one order as a prefix tree with runs of single children in one node."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.rank = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.rank]
        self.sizes = np.array([len(s) for s in self.sets])
        self.root = self._node(0, len(sets), 0)

    @staticmethod
    def _common(x: np.ndarray, y: np.ndarray, start: int) -> int:
        k = min(len(x), len(y))
        differ = x[start:k] != y[start:k]
        at = int(differ.argmax()) if k > start else 0
        return start + at if k > start and differ[at] else k

    def _node(self, lo: int, hi: int, depth: int):
        """(leaves lo to hi, depths from and to, shortest and longest set, children)

        Children are built when a walker first comes by.
        """
        to = self._common(self.sets[lo], self.sets[hi - 1], depth)
        sizes = self.sizes[lo:hi]
        return [lo, hi, depth, to, int(sizes.min()), int(sizes.max()), None]

    def _children(self, node) -> list:
        lo, hi, _, to, _, _, children = node
        if children is None:
            children, at = [], lo
            while at < hi and len(self.sets[at]) == to:  # sets that end here
                children.append([at, at + 1, to, to, to, to, []])
                at += 1
            while at < hi:
                head, a, b = self.sets[at][to], at + 1, hi
                while a < b:  # first set with another shingle here
                    mid = (a + b) // 2
                    a, b = (mid + 1, b) if self.sets[mid][to] == head else (a, mid)
                children.append(self._node(at, a, to))
                at = a
            node[6] = children
        return children

    def links(self, a: int, b: int, label: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of sets with b * overlap >= a * union that join different labels; label is by set and changes."""
        mine = label[self.rank]
        found = []
        for i, x in enumerate(self.sets):
            if not len(x) or (mine == mine[i]).all():
                continue
            nx, stack = len(x), [(self.root, 0)]
            while stack:
                node, overlap = stack.pop()
                lo, hi, start, to, short, long, _ = node
                if hi <= i + 1 or (mine[max(lo, i + 1) : hi] == mine[i]).all():
                    continue
                seen = 0
                if to > start:
                    part = self.sets[lo][start:to]
                    at = np.searchsorted(x, part)
                    overlap += int((x[np.minimum(at, nx - 1)] == part).sum())
                if to:
                    seen = int(np.searchsorted(x, self.sets[lo][to - 1], "right"))
                need = -(-a * (nx + max(short, -(-a * nx // b))) // (a + b))
                if overlap + min(nx - seen, long - to) < need:
                    continue
                if hi - lo == 1 and to == len(self.sets[lo]):
                    if b * overlap >= a * (nx + to - overlap):
                        found.append((self.rank[i], self.rank[lo]))
                        mine[mine == mine[lo]] = mine[i]
                else:
                    stack += [(child, overlap) for child in reversed(self._children(node))]
        label[self.rank] = mine
        return found


def _verify(batches: Iterator[pa.RecordBatch], n: int, a: int, b: int, frequent) -> Iterator[pa.RecordBatch]:
    """Links of the blocks of clusters, decided on whole sets; rows come sorted by block."""
    order = Order(frequent.value)
    for t in runs(batches, ["cluster", "block", "other"]):
        keys = np.stack([t.column(k).to_numpy() for k in ("cluster", "block", "other")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        docs, comps, found = t.column("doc_id").to_numpy(), t.column("component").to_numpy(), []
        for s, e in zip(starts, [*starts[1:], len(docs)], strict=True):
            ids, first = np.unique(docs[s:e], return_index=True)
            if len(ids) < 2:
                continue
            texts = _lower(t.column("text").slice(s, e - s).take(pa.array(first)).combine_chunks())
            sets = [order(x) for x in shingle_sets(texts, n)]
            label = np.unique(comps[s:e][first], return_inverse=True)[1]
            found += [(ids[i], ids[j]) for i, j in Trie(sets).links(a, b, label)]
        if found:
            x = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _in_blocks(rows: DataFrame, n: int, a: int, b: int, frequent) -> DataFrame:
    keys = ["cluster", "block", "other"]
    dealt = rows.select(*keys, "doc_id", "component", "text").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda it: _verify(it, n, a, b, frequent), LINKS)


def jaccard_groups(docs: DataFrame, n: int = 3, a: int = 90, b: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, for sets of n-word shingles alike by a / b or more.

    component_id is the least doc_id that links lead to, the document's own included.
    Texts are lower-cased in A-Z; with fewer than n words the whole sequence is the one
    shingle. Texts that are null or without words have no shingles and link with nothing.
    Rows with a null doc_id link with nothing and have a null component_id. Repeated rows
    come back as often as they are there. Other columns are ignored.
    """
    spark = docs.sparkSession
    sc: SparkContext = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = sc.broadcast(frequent_shingles(docs, n))
    features = store(docs.mapInArrow(lambda it: _features(it, n, a, b, frequent), FEATURES), "features")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = features.where(usable).groupBy("s1", "s2").agg(F.min("doc_id").alias("first_id"))

    firsts = classes.select(F.col("first_id").alias("doc_id"))
    postings = (
        features.where(usable).join(firsts, "doc_id", "left_semi")
        .select("doc_id", "n_shingles", "b1", "b2", F.posexplode("prefix").alias("pos", "token"))
        .select("token", "doc_id", (F.shiftleft(F.col("n_shingles").cast("long"), 32) + F.col("pos")).alias("place"), "b1", "b2")
    )
    shared = store(postings.repartition("token").sortWithinPartitions("token").mapInArrow(lambda it: _shared(it, a, b), POSTINGS), "shared-postings")
    hot = shared.groupBy("token").agg(F.ceil(F.count("*") / RUN_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = shared.join(store(hot, "hot-shingles"), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("across", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "across").alias("cell_a"), F.greatest("block", "across").alias("cell_b"), "block", "doc_id", "place")
    sized = features.where(usable).groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap"))
    keys = ["token", "cell_a", "cell_b"]
    mapped = dealt.join(sized.select("doc_id", "bitmap"), "doc_id").repartition(*keys).sortWithinPartitions(*keys)
    pairs = mapped.mapInArrow(lambda it: _candidates(it, a, b), LINKS)
    clusters = store(connected_components(pairs).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")

    counted = clusters.join(sized.select("doc_id", "n_shingles"), "doc_id")
    many = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = counted.groupBy("cluster").agg(many.alias("blocks"))
    placed = counted.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    texts = store(docs.join(placed, "doc_id").withColumn("head", F.col("doc_id") == F.col("cluster")), "cluster-texts")
    everywhere = F.when(F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first_pass = texts.withColumn("block", F.explode(everywhere)).withColumns({"other": F.lit(-1), "component": F.col("doc_id")})
    links = store(_in_blocks(first_pass, n, a, b, frequent), "links")
    groups = store(connected_components(links), "groups")

    large = texts.where(F.col("blocks") > 1).join(groups, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")
    away = large.where(F.col("component") != F.col("cluster"))
    if not away.isEmpty():
        tally = away.groupBy("cluster").agg(many.alias("others"))
        numbered = large.join(tally, "cluster")
        visitors = numbered.where(F.col("component") != F.col("cluster")).withColumn("other", F.pmod(F.xxhash64("doc_id"), F.col("others")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        hosts = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        cells = visitors.unionByName(hosts)
        groups = connected_components(store(links.unionByName(_in_blocks(cells, n, a, b, frequent)), "all-links"))

    classes = classes.join(groups.withColumnRenamed("component", "least_id"), F.col("first_id") == F.col("node"), "left")
    named = classes.select("s1", "s2", F.coalesce("least_id", "first_id").alias("least_id"))
    shingled = features.where(usable).join(named, ["s1", "s2"]).select("doc_id", "n_shingles", F.col("least_id").alias("component_id"))
    rest = features.where(~usable | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return shingled.unionByName(rest).withColumn("n_shingles", F.col("n_shingles").cast("long"))
