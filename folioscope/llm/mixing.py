"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Each source gets a share of the budget by its weight, but no more than ``max_epochs``
times its own size; what clamped sources cannot take is shared among the others by
weight until none is above its cap. The level of the water has a closed form: with
sources in order of cap / weight the clamped ones come first, so one pass over the
source table (one row for each source) finds it.

Documents are then taken floor(target / size) times, and once more in a seeded order
until the rest of the target is filled. The order is cut into slices by the hash of the
document, so that a source with most of the rows is still dealt over many tasks: slice
totals give each slice its starting point, and rows are only ordered within a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of a document's hash that name its slice of the seeded order.
SLICE_DIGITS = 3

#: Columns that ``mix`` adds.
RESULTS = ("size", "source_size", "weight", "target", "copies", "taken")
WORK = ("_mix_source", "_mix_size", "_mix_draw", "_mix_slice", "_mix_before", "_mix_prior", "_mix_whole", "_mix_gap")


def water_level(sources: DataFrame, max_epochs: float = 3.0, budget: Column | None = None) -> DataFrame:
    """Targets of sources: columns source, source_size, weight in; target and the given out.

    ``budget`` is an aggregate of the table, the sum of all sizes by default. Weights of
    zero, below zero or null get a target of 0; if the caps together are below the
    budget, every source stands at its cap. An empty table gives an empty one.
    """
    budget = F.sum("source_size") if budget is None else budget
    everything = Window.partitionBy()
    by_ratio = Window.partitionBy().orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0)
    cap = F.col("source_size").cast("double") * F.lit(float(max_epochs))
    filled = (
        sources.withColumn("_w", weight)
        .withColumn("_cap", F.when(F.col("_w") > 0, cap).otherwise(0.0))
        .withColumn("ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")))
        .withColumn("_budget", budget.over(everything).cast("double"))
        .withColumn("_clamped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.when(F.col("_open") > 0, (F.col("_budget") - F.col("_clamped")) / F.col("_open")))
        .withColumn("_holds", F.when((F.col("_w") > 0) & (F.col("_level") * F.col("_w") <= F.col("_cap")), F.col("_level")))
        .withColumn("_level", F.first("_holds", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return filled.withColumn("target", target).drop("_w", "_cap", "ratio", "_budget", "_clamped", "_open", "_level", "_holds")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds weight: the given ones in turn over sources by code point, null last."""
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))


def mix(docs: DataFrame, size: Column, weigh, id_col: str = "doc_id", source_col: str = "source", max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """Every row of docs with size, source_size, target (of its source), copies and taken.

    ``weigh`` turns a table (source, source_size) into one with weight besides. Null
    sources form a source of their own, null sizes count 0, null ids draw as an empty
    id. Rows that are repeated are drawn as rows of their own. Sources of size 0 and
    documents of size 0 have taken = 0. Columns of docs that have the names of results
    are replaced; all others are kept. The last document of a source's extra round goes
    in if more than half of it fits, so a source misses its target by half a document at
    most. The same rows and seed give the same result in any order and partitioning.
    """
    clash = [c for c in RESULTS if c in docs.columns]
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.withColumns({"_mix_source": F.col(source_col), "_mix_size": F.coalesce(size.cast("long"), F.lit(0)), "_mix_draw": draw}).drop(*clash)
    rows = rows.withColumn("_mix_slice", F.substring("_mix_draw", 1, SLICE_DIGITS))
    slices = rows.groupBy(F.col("_mix_source").alias("source"), F.col("_mix_slice").alias("slice")).agg(F.sum("_mix_size").alias("slice_size")).checkpoint()
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = water_level(weigh(sources), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        slices.withColumn("_mix_before", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)))
        .withColumnRenamed("source", "_s")
        .join(targets.withColumn("_mix_whole", epochs), F.col("_s").eqNullSafe(F.col("source")))
        .withColumn("_mix_gap", F.col("target") - F.col("_mix_whole") * F.col("source_size"))
        .select("source", "slice", "source_size", "weight", "target", "_mix_whole", "_mix_gap", "_mix_before")
    )
    tie = [F.col("_mix_draw"), F.col("_mix_size"), F.hash(*[c for c, kind in rows.dtypes if "map" not in kind])]
    within = Window.partitionBy("_mix_source", "_mix_slice").orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_mix_prior", F.coalesce(F.sum("_mix_size").over(within), F.lit(0)))
    joined = placed.join(
        plan.withColumnRenamed("source", "_mix_key").withColumnRenamed("slice", "_mix_part"),
        F.col("_mix_source").eqNullSafe(F.col("_mix_key")) & (F.col("_mix_slice") == F.col("_mix_part")),
    ).drop("_mix_key", "_mix_part")
    extra = (F.col("_mix_gap") > 0) & (F.col("_mix_before") + F.col("_mix_prior") + F.col("_mix_size") / 2 <= F.col("_mix_gap")) & (F.col("_mix_size") > 0)
    copies = (F.col("_mix_whole") + extra.cast("int")).cast("int")
    return joined.withColumns({"size": F.col("_mix_size"), "copies": copies, "taken": (copies * F.col("_mix_size")).cast("long")}).drop(*WORK)


def repeat(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as ``copies`` says (null or 0: not at all), without the mixture's columns; an empty table gives an empty one."""
    often = mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return often.drop("_copy", *RESULTS)
