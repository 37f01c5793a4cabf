"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / weight, with u drawn from a
hash of its id; within a source the documents are taken in key order until the
source's token budget is filled. Budgets above one epoch take all documents
once (complete epochs) before the rest is selected by key (the fraction).

No source is ever sorted as a whole. Keys are mapped to [0, 1) and summed by
histogram bins, three levels of 1024 bins each; only the documents of the one
bin in which the budget runs out are sorted. A source's result is one cut
(key, id): a document is in the fraction if its pair is at or before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import column, pack, unpack, word_count
from .store import materialize, scratch

#: Weights given in turn to the sources in code-point order.
CYCLE = (5, 2, 1)
BINS = 1024
#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>"


def uniform(key: Column, seed: int) -> Column:
    """52 bits of md5(key:seed) as a number inside (0, 1)."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def quality_weight(text: Column) -> Column:
    """Share of characters that are no symbols, in steps of 1/100, at least 0.05; 1 for empty or null text."""
    clean = F.length(F.translate(text, SYMBOLS, "")).cast("double")
    share = F.floor(F.try_divide(clean * 100, F.length(text).cast("double"))) / F.lit(100.0)
    return F.coalesce(F.greatest(share, F.lit(0.05)), F.lit(1.0))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Token budgets of sources: (source, source_size) -> source, source_size, target.

    The total, ``share`` times all sizes, is dealt by weight; a source stops at
    ``cap`` times its size and its excess goes to the others by weight, until
    none is above. That fixed point is min(cap * size, level * weight): with
    sources sorted by cap / weight, the level is the first for which the next
    source is not yet full. One row for each source, so plain windows do.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    ranked = sizes.withColumn("w", weights).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("full") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("used", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    level = (F.col("total") - F.col("used")) / F.col("left_w")
    fits = F.when(level * F.col("w") <= F.col("full"), level)
    ranked = ranked.withColumn("level", F.max(fits).over(everything))
    return ranked.select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least("full", F.col("level") * F.col("w"))).alias("target")
    )


def _cuts(keyed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(of, edge_key, inner): ``inner`` is the last pair (key, tie) that source ``of`` takes in its edge bin, which begins at edge_key.

    The document in which the budget runs out is taken if that brings the sum
    nearer to the budget. ``b1 b2 b3`` are the histogram bins of the key.
    """
    left, edge = budgets.where("rest > 0").select(F.col("source").alias("of"), F.col("rest").alias("left")), keyed
    for bin_ in ("b1", "b2", "b3"):
        inside = edge.join(left, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
        sums = inside.groupBy("source", bin_).agg(F.sum("size").alias("s"), F.max("left").alias("left"))
        running = Window.partitionBy("source").orderBy(bin_)
        sums = sums.withColumn("to", F.sum("s").over(running))
        full = Window.partitionBy("source")
        # The first bin that reaches the rest; the last one where none does.
        sums = sums.withColumn("hit", F.coalesce(F.min(F.when(F.col("to") >= F.col("left"), F.col(bin_))).over(full), F.max(bin_).over(full)))
        hit = sums.where(F.col(bin_) == F.col("hit")).select(F.col("source").alias("of"), "hit", (F.col("left") - (F.col("to") - F.col("s"))).alias("left"))
        hit = materialize(hit, "mix-bin")
        edge = edge.join(hit.drop("left"), F.col("source").eqNullSafe(F.col("of")) & (F.col(bin_) == F.col("hit")), "left_semi")
        left = hit.drop("hit")
    inside = edge.join(left, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
    run = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = inside.groupBy("source", "key", "tie").agg(F.sum("size").alias("size"), F.max("left").alias("left"))
    summed = one.withColumn("to", F.sum("size").over(run))
    taken = F.abs(F.col("to") - F.col("left")) <= F.abs(F.col("to") - F.col("size") - F.col("left"))
    inner_cut = summed.where(taken).groupBy(F.col("source").alias("of")).agg(F.max(F.struct("key", "tie")).alias("inner"))
    # Where the edge bin gives nothing, everything before it is still taken.
    edge_bins = inside.groupBy("source").agg(F.min("key").alias("edge_key"))
    return edge_bins.join(inner_cut, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "edge_key", "inner")


def mix_plan(skinny: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Per source: source_size, target, epochs, cut. ``skinny`` has source, size, key, tie and is read several times."""
    sizes = skinny.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = materialize(
        targets(sizes, share, cap, cycle)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "mix-budgets",
    )
    cuts = _cuts(skinny.where("size > 0"), budgets)
    return materialize(budgets.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-plan", keep=True)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    share: float = 1.5,
    cap: float = 2.0,
    cycle: tuple[int, ...] = CYCLE,
    seed: int = 20,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (of its columns those in ``carry``, if given) with size, source_size, target and taken (words the mix takes of the document).

    ``weight`` is a column of ``docs``, by default :func:`quality_weight` of the
    text. With ``carry``, texts are read once: size and key are written beside
    the carried columns. Without, they are read twice and never written.

    Null text has size 0 and is taken 0 times; a null source is a source of its
    own, sorted last; weights that are null or not above 0 count as 0.05. Rows
    that agree in id and text tie and are taken alike; an empty table gives an
    empty result. Input columns of the result's names are replaced. Sources are
    a dimension: the plan has one row for each, and Spark broadcasts it only
    below its own size threshold, as the written table's size is known.
    """
    columns = docs.columns if carry is None else list(carry)
    packed = docs.select(F.struct(*map(column, columns)).alias("row"), column(text_col).alias("text"), column(id_col).alias("id"), column(source_col).alias("source"), (quality_weight(column(text_col)) if weight is None else weight).alias("w"))
    text, id_, w = F.col("text"), F.col("id"), F.when(F.col("w") > 0, F.col("w")).otherwise(0.05)
    tie = F.concat_ws(":", id_.cast("string"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))
    rows = packed.select("row", "source", word_count(text).alias("size"), (-F.log(uniform(id_, seed)) / w).alias("key"), tie.alias("tie"))
    at = F.col("key") / (1 + F.col("key")) * BINS
    b1 = F.floor(at)
    b2 = F.floor((at - b1) * BINS)
    b3 = F.floor(((at - b1) * BINS - b2) * BINS)
    rows = rows.withColumns({"b1": b1, "b2": b2, "b3": b3})
    with scratch(docs.sparkSession):
        if carry is None:
            skinny = materialize(rows.drop("row"), "mix-keys")
        else:
            rows = materialize(rows, "mix-keys", keep=True)
            skinny = rows.drop("row")
        plan = mix_plan(skinny, share, cap, cycle)
    joined = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    in_part = F.coalesce((F.col("key") < F.col("edge_key")) | (F.struct("key", "tie") <= F.col("inner")), F.lit(False))
    taken = F.col("size") * (F.col("epochs") + F.when(in_part, 1).otherwise(0))
    return unpack(joined, columns, {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("long")})


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it; documents without words are not in it. All columns stay, whatever their names."""
    own = (options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source"))
    taken = mix_sources(pack(docs).select("row", *[F.col("row")[c].alias(c) for c in own]), **options)
    copies = taken.where("taken > 0").select("row", F.explode(F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int"))))
    return unpack(copies, docs.columns, {})
