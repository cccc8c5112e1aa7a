"""The trie of all beginnings of conversations, by digests of fixed-length blocks of turns.

A turn is known by two 64-bit hashes of role and text. A node, the sequence of the first d
turns, is known by d and by the exclusive or of its turns' hashes, each hashed together with
its place; so a block's key follows from its parent's and its own digest, in any order.

1. Turns are gathered in blocks of ``BLOCK``, and conversations are grouped by key and digest
   of each block. Copies are one row from here on.
2. Where a node at a block's start goes on in one block alone, all its turns have that
   block's members. Only where blocks differ are their turns looked at one by one.
3. The least member of a node owns it. The nodes of one owner are a path down to the end of
   its conversation, so a subtree's sums are those of the rest of the owner's path and the
   totals of all other owners that come through, which are summed by block first as well.

Nothing goes level by level: the number of shuffles is the same at any depth. A conversation
or path of many turns is dealt in stretches, whose sums are carried over in a small table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

#: Turns of a block, turns of a stretch, ids that are joined to one string at most.
BLOCK, STRETCH, IDS_AT_ONCE = 8, 4096, 4096
NODE = ["depth", "x1", "x2"]


def running(rows: DataFrame, key: str, stretch: str, order: Column, values: dict[str, Column], exclusive_or: bool = False) -> DataFrame:
    """Running sums of values over the rows of a key, own row included; stretches are in the order of rows.

    Each stretch is summed by itself, and a table of a row for each stretch carries what comes before it.
    """
    total = F.bit_xor if exclusive_or else F.sum
    both = (lambda a, b: a.bitwiseXOR(b)) if exclusive_or else (lambda a, b: a + b)
    so_far = Window.partitionBy(key, stretch).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, stretch).agg(*[total(v).alias(f"_{n}") for n, v in values.items()])
    before = sums.select(key, stretch, *[total(f"_{n}").over(earlier).alias(f"_{n}") for n in values], F.row_number().over(Window.partitionBy(key).orderBy(stretch)).alias("_at")).where("_at > 1").drop("_at")
    own = rows.withColumns({n: total(v).over(so_far) for n, v in values.items()})
    return own.join(before, [key, stretch], "left").withColumns({n: both(F.col(n), F.coalesce(f"_{n}", F.lit(0))) for n in values}).drop(*[f"_{n}" for n in values])


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), h1, h2 and bytes of every turn, from conv_id, turn, role and text.

    Turns of a conversation are in the order of ``turn``, null first; equal ones in that of
    their hashes, so repeated rows are turns of their own. Null roles and texts are empty.
    Rows without a conv_id belong to no conversation and are left out. Other columns are
    ignored; no rows give none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(7), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    turns = store(turns.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))), "turns")
    order = F.struct(F.col("turn").isNotNull(), "turn", "h1", "h2")
    return running(turns, "conv_id", "stretch", order, {"depth": F.lit(1)}).select("conv_id", "depth", "h1", "h2", "bytes")


def lent_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from another: crc32 of its decimal id modulo 9."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebranched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations whose first h turns are those of conversation c - c % 5, and all ids, also of those without turns.

    Takes and gives the columns of ``numbered``. h is ``lent_turns``; a conversation gives its
    first 8 turns at most, to at most 8 others and itself, and keeps its own after its first h.
    """
    ids = turns.where("depth = 1").select("conv_id")
    own = turns.where(F.col("depth") > lent_turns(F.col("conv_id")))
    lent = turns.where((F.col("depth") <= 8) & (F.col("conv_id") % 5 == 0)).withColumn("to", F.explode(F.array(*[F.try_add("conv_id", F.lit(k)) for k in range(-4, 5)])))
    lent = lent.where(F.col("to").isNotNull() & (F.col("to") - F.col("to") % 5 == F.col("conv_id")) & (F.col("depth") <= lent_turns(F.col("to"))))
    lent = lent.select(F.col("to").alias("conv_id"), "depth", "h1", "h2", "bytes").join(ids, "conv_id", "left_semi")
    turns = own.unionByName(lent)
    # where the lender has fewer turns than h, own turns follow at once
    return turns, ids


def _fold(turns: Column, upto: Column, lane: str, start: Column) -> Column:
    """Key of the first turns of a block, in one of the two lanes."""
    return F.aggregate(F.slice(turns, 1, upto), start, lambda a, t: a.bitwiseXOR(t[lane]))


def _each_turn(blocks: DataFrame, *keep: str) -> DataFrame:
    """A row for each turn of blocks (k, p1, p2, turns): its node, its parent's key, its bytes, and columns to keep."""
    rows = blocks.withColumn("t", F.explode(F.sequence(F.lit(1), F.size("turns"))))
    for lane in "12":
        rows = rows.withColumn(f"q{lane}", _fold(F.col("turns"), F.col("t") - 1, f"g{lane}", F.col(f"p{lane}")))
    turn = F.get("turns", F.col("t") - 1)
    return rows.select((F.col("k") * BLOCK + F.col("t")).alias("depth"), *[F.col(f"q{x}").bitwiseXOR(turn[f"g{x}"]).alias(f"x{x}") for x in "12"], "q1", "q2", turn["bytes"].alias("bytes"), *keep)


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id: strings of some ids of one node."""
    node, first, ids, out = None, 0, [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*NODE, "conv_id")]
        for *own, c in zip(*columns, strict=True):
            if own != node or len(ids) >= IDS_AT_ONCE:
                if ids:
                    out.append((*node, first, ",".join(ids)))
                node, first, ids = own, c, []
            ids.append(str(c))
        if len(out) >= 256:
            yield _as_batch(out, [*NODE, "first", "ids"])
            out = []
    if ids:
        out.append((*node, first, ",".join(ids)))
    if out:
        yield _as_batch(out, [*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by node and first id: SHA-256 of all strings of a node, which are never put together."""
    node, state, out = None, None, []
    for batch in batches:
        for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
            if own != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) >= 1000:
            yield _as_batch(out, [*NODE, "ends_sha256"])
            out = []
    if node is not None:
        out.append((*node, state.hexdigest()))
    if out:
        yield _as_batch(out, [*NODE, "ends_sha256"])


def _as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, x1, x2 and ends_sha256 (of all ids, ascending, with commas) of nodes at which conversations end.

    Ids are dealt by node and id, so those of one node are made into strings by many tasks;
    one task then reads a node's strings, each of up to 4,096 ids, one after another.
    """
    node = "depth long, x1 long, x2 long"
    strings = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_id_runs, f"{node}, first long, ids string")
    return strings.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, f"{node}, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each distinct sequence of first turns, from turns as ``numbered`` gives them; ``ids`` names conversations that may have no turns.

    Columns, all long but the last: conv_id (the node's least member), depth, parent_conv_id
    (the parent's; null for the root), n_convs (members), n_children, n_leaves (nodes without
    children in its subtree, itself included), saved_tokens (bytes of the last text of each
    node of its subtree for every member but one), ends_sha256 (SHA-256 of the decimal ids,
    ascending, with commas, of members that end there).

    The root has no text and all conversations; no conversations give no root. Depths of a
    conversation must run from 1 without gaps; gaps are closed, equal depths are ordered by hash.
    """
    step = F.struct("depth", "h1", "h2")
    turns = store(turns.withColumn("stretch", F.floor(F.col("depth") / STRETCH)), "trie-turns")
    ids = (turns.select("conv_id").distinct() if ids is None else ids.select("conv_id").unionByName(turns.select("conv_id")).distinct())
    closed = running(turns, "conv_id", "stretch", step, {"d": F.lit(1)}).withColumn("k", F.floor((F.col("d") - 1) / BLOCK))
    turn = F.struct("d", F.xxhash64("d", "h1").alias("g1"), F.xxhash64("h2", "d").alias("g2"), "bytes")
    blocks = closed.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    for lane in "12":
        blocks = blocks.withColumn(f"b{lane}", _fold(F.col("turns"), F.size("turns"), f"g{lane}", F.lit(0).cast("long")))
    blocks = store(blocks.withColumn("stretch", F.floor(F.col("k") / (STRETCH // BLOCK))), "trie-blocks")
    blocks = running(blocks, "conv_id", "stretch", F.col("k"), {"e1": F.col("b1"), "e2": F.col("b2")}, exclusive_or=True)
    blocks = store(blocks.select("conv_id", "k", F.transform("turns", lambda t: t.dropFields("d")).alias("turns"), "b1", "b2", "e1", "e2", *[F.col(f"e{x}").bitwiseXOR(F.col(f"b{x}")).alias(f"p{x}") for x in "12"]), "trie-keyed-blocks")

    # blocks of all conversations, each distinct one once
    grouped = store(blocks.groupBy("k", "p1", "p2", "b1", "b2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.any_value("turns").alias("turns")), "trie-groups")
    start = ["k", "p1", "p2"]
    split = grouped.where("k > 0").groupBy(*start).agg(F.count("*").alias("ways")).where("ways > 1").select(*start, F.lit(True).alias("split"))
    marked = store(grouped.join(split, start, "left").withColumn("split", F.coalesce("split", F.col("k") == 0)), "trie-split")
    one_way = _each_turn(marked.where("not split"), "n_convs", "conv_id")
    parted = _each_turn(marked.where("split"), "n_convs", "conv_id").groupBy(*NODE).agg(
        F.any_value("q1").alias("q1"), F.any_value("q2").alias("q2"), F.any_value("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = store(one_way.unionByName(parted.select(*one_way.columns)), "trie-nodes")

    below = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("x1"), F.col("q2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("bytes"), "stretch": -F.floor(F.col("depth") / STRETCH)})
    nodes = store(nodes, "trie-children")
    paths = store(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "trie-paths")

    # what an owner adds to the nodes above its own path, by block and then by turn
    shared = blocks.select("conv_id", "k", "p1", "p2", "turns").join(paths, "conv_id").where(F.col("top") > F.col("k") * BLOCK + 1)
    shared = shared.withColumn("turns", F.slice("turns", 1, F.least(F.col("top") - 1 - F.col("k") * BLOCK, F.size("turns").cast("long")).cast("int")))
    for lane in "12":
        shared = shared.withColumn(f"c{lane}", _fold(F.col("turns"), F.size("turns"), f"g{lane}", F.lit(0).cast("long")))
    shared = shared.groupBy(*start, "c1", "c2").agg(F.any_value("turns").alias("turns"), F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    more = _each_turn(shared, "more_saved", "more_leaves").groupBy(*NODE).agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))

    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct((F.col("k") * BLOCK + F.size("turns")).alias("depth"), F.col("e1").alias("x1"), F.col("e2").alias("x2")), "k").alias("at")).select("conv_id", "at.*")
    zero = F.lit(0).cast("long")
    ends = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in NODE])
    digests = store(end_digests(ends), "trie-ends")

    all_ids = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    sums = paths.agg(F.coalesce(F.sum("saved"), zero).alias("saved_tokens"), F.coalesce(F.sum("leaf"), zero).alias("leaves"))
    first = nodes.where("depth = 1").agg(F.count("*").alias("n_children"))
    # three tables of one row each
    root = all_ids.crossJoin(sums).crossJoin(first).select(
        *[zero.alias(c) for c in NODE], "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")

    rest = running(nodes, "conv_id", "stretch", -F.col("depth"), {"own_saved": F.col("saved")}).join(paths.select("conv_id", "leaf"), "conv_id").join(more, NODE, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("q1"), F.col("x2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    rest = rest.select(*NODE, "q1", "q2", "conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("own_saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"))
    deep = rest.where("depth > 1").join(parents, ["depth", "q1", "q2"])
    # all nodes of depth 1 have the root as parent
    high = rest.where("depth = 1").crossJoin(F.broadcast(all_ids.select(F.col("conv_id").alias("parent_conv_id"))))
    whole = deep.select(root.columns).unionByName(high.select(root.columns)).unionByName(root)
    empty = hashlib.sha256().hexdigest()
    return whole.join(digests, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
