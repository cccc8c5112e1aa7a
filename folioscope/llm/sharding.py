"""Sharding by a hierarchical weighted hash tree: region, rack and shard.

At each level every child of the node draws -ln(u) / weight, with u from a hash of the
key and the child's path and the weight of all that is below it; the least draw wins and
the key goes down into that child alone, so a row makes as many draws as the nodes on its
way have children. A draw depends on nothing but the key, the path and the weight below,
so a change of weights moves keys only into, out of or inside subtrees whose weights
change.

Shards that are added one by one fill places that the tree has from the beginning. A
region that has all its shards draws once, for all of them. In the one that is being
filled, a node's draw is told apart into its children's: the winner below it has the
node's own draw, and any other child that draw plus what its own draw at that level is
behind the winner's. The least of draws has no memory, so these are what all places would
draw on their own, and full nodes, racks and shards of that region compete by them with
the other regions. No draw changes when a shard is added: it only takes keys into itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: regions -> racks -> weights of shards
Topology = list[list[list[float]]]

#: Parts that a shard's rows are numbered in.
SLOT_PARTS = 256
#: Rows of the table of part offsets up to which it is broadcast (24 bytes a row).
OFFSETS_BROADCAST = 200_000


def topology(shards: int, racks: int = 2, per_rack: int = 5) -> Topology:
    """A tree with places for a number of shards: regions of ``racks`` racks of ``per_rack`` places of weight 1, the last one whole too."""
    regions = -(-shards // (racks * per_rack))
    return [[[1.0] * per_rack for _ in range(racks)] for _ in range(regions)]


def _mean(weight: float) -> float:
    return 1.0 / weight if weight > 0 else float("inf")


def _draws(key: Column, path: list[Column], means: list[Column], seed: int) -> Column:
    """The draws of a node's children, by the reciprocals of their weights; a child of weight 0 never wins."""
    def draw(n: int, mean: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), *path, F.lit(n)), 11)
        return -F.ln((bits.cast("double") + 0.5) * F.lit(2.0**-53)) * mean

    return F.array(*[draw(n, m) for n, m in enumerate(means)])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that stands once in the expression, however often it is used, so that filters pushed through it stay small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _winner(draws: Column) -> Column:
    """The number of the least draw, the first of equal ones."""
    return F.array_min(F.transform(draws, lambda d, n: F.struct(d.alias("d"), n.alias("n"))))["n"]


def _told_apart(node: Column, draws: Column) -> Column:
    """Draws of a node's children on the scale of all nodes: the least is the node's own, the others are as far behind as they were."""
    return _bound(draws, lambda ds: F.transform(ds, lambda d: node + (d - F.array_min(ds))))


def place(df: DataFrame, key: Column, tree: Topology, out: str = "shard", seed: int = 7, built: int | None = None) -> DataFrame:
    """Adds the number of the shard, counted through the tree, that the key descends to.

    With ``built`` only the first so many places of the tree hold shards; a place that is
    built later takes keys into itself and moves no others. Null keys all descend the same
    way. A column of df that has the name of the result is replaced. The tree is part of
    the plan; nothing is shuffled. Raises if no place that is built has a weight.
    """
    places = [(r, k, s) for r, racks in enumerate(tree) for k, rack in enumerate(racks) for s in range(len(rack))]
    number = {p: n for n, p in enumerate(places)}
    here = places[:built]
    if not any(tree[r][k][s] > 0 for r, k, s in here):
        raise ValueError("no shard that is built has a weight")
    total = lambda *node: sum(tree[r][k][s] for r, k, s in places if (r, k, s)[: len(node)] == node)
    is_whole = lambda *node: all(number[p] < len(here) for p in places if p[: len(node)] == node)
    begun = lambda *node: total(*node) > 0 and any(p[: len(node)] == node for p in here)

    def inside(node: tuple[int, ...], children: int) -> Callable[[Column], Column]:
        return lambda draws: rivals(node, draws, children)

    def rivals(node: tuple[int, ...], draws: Column, children: int) -> Column:
        """The least of a node's children by draw, with the way to it; one that is being filled stands for its own children."""
        out = []
        for n in range(children):
            child = (*node, n)
            if not begun(*child):
                continue
            draw = F.get(draws, F.lit(n))
            if is_whole(*child):
                region, rack, shard = (*child, None, None)[:3]
                out.append(F.struct(draw.alias("draw"), F.lit(region).alias("region"), F.lit(rack).cast("int").alias("rack"), F.lit(shard).cast("int").alias("place")))
            else:
                below = tree[child[0]] if len(child) == 1 else tree[child[0]][child[1]]
                means = [F.lit(_mean(total(*child, m))) for m in range(len(below))]
                inner = _told_apart(draw, _draws(key, [*map(F.lit, child)], means, seed))
                out.append(_bound(inner, inside(child, len(below))))
        return F.array_min(F.array(*out))

    # below the winner: weights and first numbers of its children are looked up by the way that was taken
    racks, shards = max(map(len, tree)), max(len(rack) for region in tree for rack in region)
    rack_means = F.lit([[_mean(total(r, k)) for k in range(racks)] for r in range(len(tree))])
    shard_means = F.lit([[[_mean(total(r, k, s)) for s in range(shards)] for k in range(racks)] for r in range(len(tree))])
    first = F.lit([[number.get((r, k, 0), -1) for k in range(racks)] for r in range(len(tree))])
    of = lambda values, *index: reduce(F.get, index, values)
    regions = _draws(key, [], [F.lit(_mean(total(r))) for r in range(len(tree))], seed)

    def down(won: Column) -> Column:
        region = won["region"]
        rack = F.coalesce(won["rack"], _winner(_draws(key, [region], [of(rack_means, region, F.lit(k)) for k in range(racks)], seed)))
        return _bound(rack, lambda k: of(first, region, k) + F.coalesce(won["place"], _winner(_draws(key, [region, k], [of(shard_means, region, k, F.lit(s)) for s in range(shards)], seed))))

    won = _bound(regions, lambda ds: rivals((), ds, len(tree)))
    return df.withColumn(out, F.coalesce(_bound(won, down), F.lit(-1)))


def slots(df: DataFrame, key: str, order: list[str], shard: str = "shard", shards: int = 40) -> DataFrame:
    """Adds slot: a gapless number from 0 within each shard.

    A shard's rows are numbered in parts by a hash of the key, each from the count of all
    parts before it, so that no task has to order a whole shard.
    """
    part = F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(SLOT_PARTS)).cast("int")
    rows = df.withColumn("_part", part)
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(F.col(shard).alias("_s"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    if shards * SLOT_PARTS <= OFFSETS_BROADCAST:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = rows.withColumn("_row", F.row_number().over(within) - 1)
    joined = numbered.join(offsets, (F.col(shard) == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("slot", (F.col("_offset") + F.col("_row")).cast("long")).drop("_part", "_row", "_s", "_p", "_offset")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is ``key``: the id and the number of shards decide, and grown_shard is the
    place with one more shard, for any number of shards. Null texts have size 16 and the
    checksum of an empty text; null ids share one shard; repeated rows share a shard and
    have slots of their own. Texts do not decide: equal texts have equal text_crc32, and
    stand in one shard only if their ids do. Other columns of the input are ignored; an
    empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = place(rows, F.col("doc_id"), topology(shards), "shard", built=shards)
    rows = place(rows, F.col("doc_id"), topology(shards + 1), "grown_shard", built=shards + 1)
    out = slots(rows, "doc_id", ["doc_id", "size", "text_crc32"], shards=shards)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
