"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Each source has a weight and a size (its words). A budget is shared by weight; a source is clamped at max_epochs times
its size, and what it can't take is shared again by weight among the others, until no source is above its clamp. A
source then is repeated whole as often as its target allows, and a seeded selection of its documents once more, so
that the words taken equal the target: documents are drawn in the order of a seeded hash until it is full, and the
one that crosses the line gives only its leading words.

The order is cut at one point per source, found from sums over slices of the order. So a document's fate follows from its own hash and its source's cut,
and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.llm.common import WORD, checkpointed, word_count

#: Slices of a source by hash; running sums go over slices first, so that no source is sorted in one task.
SLICES = 2048
#: Sources up to which their table of cuts is sent to the tasks; more are joined by a shuffle.
SENT_SOURCES = 100_000


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with the sums over the rows before each in this order, 0 for the first; no step sorts all in one task."""
    held = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    starts = starts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    found = held.join(F.broadcast(starts), "_part").withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()})
    return found.select(*rows.columns, *sums)


def code_point_rank(names: DataFrame, name: str) -> DataFrame:
    """names with its 0-based rank by code point, null last; names are distinct."""
    return running(names, [F.col(name).asc_nulls_last()], rank=F.lit(1))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources (with size and weight) with target: clamp, share the excess by weight, until none is above its clamp.

    Sources are clamped in the order of clamp by weight. The level is that of the first source which the budget, less the clamps of those before it, leaves at or under its
    own clamp. If all sources are clamped, the budget is more than the mix can take, and targets are the clamps.
    """
    cap, weight = F.col("size") * F.lit(float(max_epochs)), F.col("weight").cast("double")
    ratio = cap / F.when(weight > 0, weight)
    total = sources.agg(F.coalesce(F.sum(F.when(weight > 0, weight)), F.lit(0.0))).first()[0]
    order = [ratio.asc_nulls_last(), F.col("_source")]
    sums = running(sources.where(weight > 0), order, _caps=cap, _weights=weight)
    level = (F.lit(float(budget)) - F.col("_caps")) / (F.lit(total) - F.col("_weights"))
    found = sums.where(F.lit(total) > F.col("_weights")).where(ratio >= level).agg(F.min_by(level, F.struct(ratio, "_caps", "_weights"))).first()[0]
    target = cap if found is None else F.least(weight * F.lit(max(found, 0.0)), cap)
    return sources.withColumn("target", F.when(weight > 0, target).otherwise(0.0).cast("double"))


def _order(text: str, doc_id: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))


def _slice(order: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(order, 20), F.lit(SLICES))


def _cuts(sized: DataFrame, weights: tuple[float, ...] | DataFrame, share: float, max_epochs: float) -> DataFrame:
    """(_source, source_size, target, _whole, _cut_slice, _cut, _left): how often each source is taken whole, and where the order of its documents is cut.

    Those before the cut are taken once more; those at it share the _left words. Without a cut, _cut_slice is -1. sized: (_id, _key, size, _order, _slice).
    """
    slices = checkpointed(sized.groupBy(F.col("_key").alias("_source"), "_slice").agg(F.sum("size").alias("_size")))
    sources = slices.groupBy("_source").agg(F.sum("_size").alias("size"))
    if isinstance(weights, DataFrame):
        named = weights.select(F.col("source").alias("_of"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(named, F.col("_source").eqNullSafe(F.col("_of")), "left").select("_source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        sources = code_point_rank(sources, "_source").select("_source", "size", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight"))
    sources = checkpointed(sources)
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    times = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    filled = water_fill(sources, share * total, max_epochs).withColumn("_whole", times).withColumn("_rest", F.round(F.col("target") - F.col("_whole") * F.col("size")).cast("long"))
    filled = checkpointed(filled)

    run = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.withColumn("_before", F.coalesce(F.sum("_size").over(run), F.lit(0)))
    crossed = before.join(filled.select(F.col("_source").alias("_of"), "_rest"), F.col("_source").eqNullSafe(F.col("_of")))
    crossed = crossed.where((F.col("_rest") > F.col("_before")) & (F.col("_rest") <= F.col("_before") + F.col("_size")))
    crossed = checkpointed(crossed.select(F.col("_source").alias("_of"), F.col("_slice").alias("_cut_slice"), (F.col("_rest") - F.col("_before")).alias("_need")))
    # Of one slice per source, the sums along the order.
    inside = sized.join(crossed, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_cut_slice")))
    inside = inside.groupBy("_of", "_cut_slice", "_need", "_order").agg(F.sum("size").alias("_size"))
    along = Window.partitionBy("_of").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_left", F.col("_need") - F.coalesce(F.sum("_size").over(along), F.lit(0)))
    cuts = inside.where((F.col("_left") > 0) & (F.col("_left") <= F.col("_size"))).select("_of", "_cut_slice", F.col("_order").alias("_cut"), "_left")
    found = filled.join(cuts, F.col("_source").eqNullSafe(F.col("_of")), "left")
    return checkpointed(found.select("_source", F.col("size").cast("long").alias("source_size"), "target", "_whole", F.coalesce("_cut_slice", F.lit(-1).cast("long")).alias("_cut_slice"), F.coalesce("_cut", F.lit(0).cast("long")).alias("_cut"), F.coalesce("_left", F.lit(0).cast("long")).alias("_left")))


def _sized(docs: DataFrame, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    order = _order(text, doc_id, seed)
    return checkpointed(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_key"), word_count(F.col(text)).alias("size"), order.alias("_order"), _slice(order).cast("long").alias("_slice")))


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (_key, _order, _slice, ...) with their source's cut and _place: -1 before it, 0 at it, 1 after it."""
    same = F.col("_key").eqNullSafe(F.col("_source"))
    found = rows.join(F.broadcast(cuts) if cuts.count() <= SENT_SOURCES else cuts, same).drop("_source")
    here, there = F.struct("_slice", "_order"), F.struct(F.col("_cut_slice").alias("_slice"), F.col("_cut").alias("_order"))
    return found.withColumn("_place", F.when(here < there, -1).when(here == there, 0).otherwise(1))


def _shared(at_cut: DataFrame) -> DataFrame:
    """Rows at the cut, in most sources one, with the words _extra that each of them gives."""
    within = Window.partitionBy("_key").orderBy("_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return at_cut.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.coalesce(F.sum("size").over(within), F.lit(0)))).cast("long"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] | DataFrame = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row of docs with its size, source_size, target (both of its source), taken, whole (how often it is taken whole)
    and part (words of one more, partial repetition).

    weights: a cycle dealt to the sources by code point, null last, or a table (source, weight). share: words of the mix as a part of all words.
    Null texts and texts without words have size 0 and are taken 0 words, 0 times. A null source is a source of its own. Repeated rows and equal or null
    ids are documents of their own. A source of size 0 has target 0. Of docs' columns, the id and the source stay.
    """
    sized = _sized(docs, text, doc_id, source, seed)
    placed = _with_cuts(sized, _cuts(sized, weights, share, max_epochs))
    plain = placed.where("_place <> 0").withColumn("_extra", F.when(F.col("_place") < 0, F.col("size")).otherwise(0).cast("long"))
    done = plain.unionByName(_shared(placed.where("_place = 0")))
    full = (F.col("_extra") == F.col("size")) & (F.col("size") > 0)
    whole = (F.col("_whole") + full.cast("int")).cast("int")
    done = done.withColumns({"taken": (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long"), "whole": F.when(F.col("size") > 0, whole).otherwise(0), "part": F.when(full, 0).otherwise(F.col("_extra"))})
    return done.select(F.col("_id").alias("doc_id"), F.col("_key").alias("source"), "size", "source_size", "target", "taken", "whole", "part")


def mixed(docs: DataFrame, weights: tuple[float, ...] | DataFrame = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix: the rows of docs, each as often as it is taken, with the columns of docs. Texts are whole: the one document of a source that the plan takes in part is
    taken once more or not, whichever is nearer to the target. Texts without words are not taken.
    """
    cuts = _cuts(_sized(docs, text, doc_id, source, seed), weights, share, max_epochs)
    order = _order(text, doc_id, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = _with_cuts(docs.where(F.col(text).rlike(WORD)).select(row, F.col(source).alias("_key"), order.alias("_order"), _slice(order).cast("long").alias("_slice")), cuts)
    plain = rows.where("_place <> 0").select("_row", (F.col("_whole") + (F.col("_place") < 0).cast("int")).alias("_times"))
    cut = _shared(rows.where("_place = 0").withColumns({"size": word_count(F.col(f"_row.`{text}`")), "_id": F.col(f"_row.`{doc_id}`")}))
    taken = plain.unionByName(cut.select("_row", (F.col("_whole") + (2 * F.col("_extra") >= F.col("size")).cast("int")).alias("_times")))
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
