"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_of, save, text_of

#: Bits of the hash that one histogram resolves, and how many histograms there are at most.
BITS, LEVELS = 12, 5
#: Up to so many sources (rows of under 200 bytes each) are broadcast; beyond, a shuffled join takes over.
MAX_BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0) -> DataFrame:
    """(source, source_size) to target: shares of the total by weight, none above ``ceiling`` times its source.

    Sources by code point, null last, take the weights in turn. What a ceiling
    leaves over goes to the others by weight until none is above: with sources
    sorted by ceiling over weight, the first ones stop at their ceiling and the
    rest share what is left; window sums over the sorted sources find where.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(ceiling) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    ranked = ranked.withColumn("_place", F.row_number().over(by_ratio)).withColumn("_level", level).withColumn("_capped", F.col("_level") > F.col("_ratio"))
    # the level of the first source under its ceiling holds for it and all behind it
    free = F.min(F.when(~F.col("_capped"), F.struct("_place", "_level"))).over(every)["_level"]
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), free * F.col("_w")))
    return ranked.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, seed: int = 23, weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many times the mix takes each row.

    Every row is taken ``floor(target / source_size)`` times; for the rest of
    the target, the rows whose seeded hash lies below their source's threshold
    are taken once more. The thresholds come from histograms of words by source
    and leading hash bits; each next histogram splits only the bucket that the
    budget ends in, until it holds one hash. A larger budget takes a superset.
    No row is sorted or moved by source; only histograms are.

    Returns id, source, size, source_size, target, copies int and _row_hash,
    one row for each input row. Null texts have no words and null sources are a
    source. Equal rows share a hash and are taken alike. If there are no words,
    targets are 0 and nothing is taken. Other columns are not read.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), row_hash(seed, id_col, text_col).alias("_hash"))
    rows, _ = save(rows, "mix-rows")
    goal, few = thresholds(rows, weights, ceiling)
    return _taken(rows, goal, few).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", F.col("_hash").alias("_row_hash"))


def apply(docs: DataFrame, seed: int = 23, weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row as often as it is taken, with the input's columns.

    The thresholds decide from a row's source and hash alone, so the texts are
    filtered where they lie and are neither sorted nor shuffled.
    """
    slim = docs.select(F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"), row_hash(seed, id_col, text_col).alias("_hash"))
    slim, _ = save(slim, "mix-rows")
    goal, few = thresholds(slim, weights, ceiling)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).cast("string").alias("source"), row_hash(seed, id_col, text_col).alias("_hash"))
    return _taken(packed, goal, few).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def row_hash(seed: int, id_col: str, text_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_of(id_col), text_of(text_col)), 64 - BITS * LEVELS)


def _join(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    right = right.withColumnRenamed("source", "_s")
    return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")


def _taken(rows: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    return _join(rows, goal, few).withColumn("copies", F.col("_base") + (F.col("_hash") < F.col("_below")).cast("int"))


def thresholds(rows: DataFrame, weights: tuple[int, ...], ceiling: float) -> tuple[DataFrame, bool]:
    """(source, source_size, target, _base, _below) from (source, size, _hash), and whether it is small enough to broadcast."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal, _ = save(targets(sizes, weights, ceiling).withColumn("_base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")), "mix-targets")
    few = goal.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES

    # _below: all hashes under it are taken; the next histogram is of the _width hashes from it on
    edge = goal.select("source", (F.col("target") - F.col("_base") * F.col("source_size")).alias("_left"), F.lit(0).cast("long").alias("_below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        within = _join(rows, edge, few).where(F.shiftright(F.col("_hash") - F.col("_below"), shift + BITS) == 0).where(F.col("_hash") >= F.col("_below"))
        histogram = within.groupBy("source", F.shiftright(F.col("_hash") - F.col("_below"), shift).alias("_bucket")).agg(
            F.sum("size").alias("_words"), F.min("_left").alias("_left"), F.min("_below").alias("_below"))
        upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        histogram = histogram.withColumn("_sum", F.sum("_words").over(upto))
        # the first bucket that the budget doesn't cover is the boundary; behind the last one, all are taken
        cut = histogram.where(F.col("_sum") > F.col("_left")).groupBy("source").agg(F.min(F.struct("_bucket", "_sum", "_words", "_left", "_below")).alias("_c"))
        # the last bucket is one hash: it is taken if that comes nearer to the target
        nearer = (F.col("_c._words") <= 2 * (F.col("_c._left") - (F.col("_c._sum") - F.col("_c._words")))).cast("int")
        found = cut.select(
            F.col("source").alias("_cs"),
            (F.col("_c._below") + F.shiftleft(F.col("_c._bucket"), shift) + (nearer if shift == 0 else F.lit(0))).alias("_nb"),
            (F.col("_c._left") - (F.col("_c._sum") - F.col("_c._words"))).alias("_nl"),
        )
        edge, _ = save(
            edge.join(found, F.col("source").eqNullSafe(F.col("_cs")), "left").select(
                "source", F.coalesce("_nl", "_left").alias("_left"),
                F.coalesce("_nb", F.col("_below") if level else F.lit(1 << (BITS * LEVELS))).alias("_below")),
            "mix-edge")
    return goal.join(edge.select(F.col("source").alias("_s"), "_below"), F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s"), few
