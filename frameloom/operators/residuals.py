"""Prediction by painting, and searches for what it misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .keys import frame


#: Side of the tiles by which pixels meet the boxes that may cover them.
TILE = 16


def _tiled(pixel: DataFrame) -> DataFrame:
    return pixel.withColumn("_tx", F.expr(f"int(x div {TILE})")).withColumn("_ty", F.expr(f"int(y div {TILE})"))


def _on_tiles(boxes: DataFrame, l: str = "l", t: str = "t", r: str = "r", b: str = "b") -> DataFrame:
    """Boxes once for each tile that they touch; empty ones touch none."""
    some = boxes.where(f"{r} > {l} AND {b} > {t}")
    across = some.withColumn("_tx", F.expr(f"explode(sequence(int({l} div {TILE}), int(({r} - 1) div {TILE})))"))
    return across.withColumn("_ty", F.expr(f"explode(sequence(int({t} div {TILE}), int(({b} - 1) div {TILE})))"))


def paint(pixel: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each pixel's colour under boxes (f, z, l, t, r, b, fill struct) painted in order of z, over black.

    A range join by tiles of the frame, so a pixel meets the boxes near it
    alone; the last one that covers it wins.
    """
    by = frame(pixel)
    slots = _tiled(pixel.select(*by, "k", "x", "y"))
    covers = (F.col("x") >= F.col("l")) & (F.col("x") < F.col("r")) & (F.col("y") >= F.col("t")) & (F.col("y") < F.col("b"))
    hit = slots.join(_on_tiles(boxes), [*by, "_tx", "_ty"]).where(covers).groupBy(*by, "k").agg(F.max_by("fill", "z").alias("fill"))
    return pixel.select(*by, "k").join(hit, [*by, "k"], "left").select(*by, "k", *[F.coalesce(F.col(f"fill.{c}"), F.lit(0)).alias(f"p{c}") for c in "bgr"])


def error_bins(pixel: DataFrame, predicted: DataFrame, threshold: int, bits: int, least: int, k: int) -> DataFrame:
    """The largest colour bins among pixels in error, per frame: (f, bin, n, b, g, r, rank).

    A pixel is in error if a channel is off by the threshold or all by twice it.
    """
    by = frame(pixel)
    d = [F.abs(F.col(c) - F.col(f"p{c}")) for c in "bgr"]
    wrong = pixel.join(predicted, [*by, "k"]).where((F.greatest(*d) >= threshold) | (d[0] + d[1] + d[2] >= 2 * threshold))
    bins = wrong.groupBy(*by, X.color_bin(bits).alias("bin")).agg(F.count("*").alias("n"), *[F.expr(f"int(bround(sum({c}) / count(*), 0))").alias(c) for c in "bgr"]).where(F.col("n") >= least)
    return bins.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "bin"))).where(F.col("rank") <= k)


def detail_bins(pixel: DataFrame, regions: DataFrame, threshold: float, focus: float, foreground: DataFrame, k: int, owner: float | None = None) -> DataFrame:
    """Per region, the colour bins (4 bits a channel) of the largest weighted error: (f, z, bin, n, error, rank).

    With ``owner``, ``pixel`` has the predicted colour as pb, pg, pr, and a
    pixel counts only where that is within ``owner`` of the region's own.
    """
    by = frame(pixel)
    boxes = _on_tiles(regions.select(*by, "z", "l", "t", F.col("r").alias("r_"), F.col("b").alias("b_"), "mean_b", "mean_g", "mean_r"), r="r_", b="b_")
    covers = (F.col("x") >= F.col("l")) & (F.col("x") < F.col("r_")) & (F.col("y") >= F.col("t")) & (F.col("y") < F.col("b_"))
    seen = _tiled(pixel.join(foreground.select(*by, "k", "moved"), [*by, "k"], "left")).join(boxes, [*by, "_tx", "_ty"]).where(covers)
    if owner is not None:
        seen = seen.where(X.belongs(["pb", "pg", "pr"], ["mean_b", "mean_g", "mean_r"], owner))
    fg = F.coalesce(F.col("moved") != 0, F.lit(False))
    error = X.distance(["b", "g", "r"], ["mean_b", "mean_g", "mean_r"] if owner is None else ["pb", "pg", "pr"])
    hit = seen.withColumn("e", error).where(F.col("e") >= X.effective_threshold(threshold, fg, focus))
    # whole numbers add up alike in any order
    weight = F.round(X.weighted_error(F.col("e"), fg, focus) * 1000).cast("long")
    bins = hit.groupBy(*by, "z", X.color_bin(4).alias("bin")).agg(F.count("*").alias("n"), F.sum(weight).alias("error"))
    return bins.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "z").orderBy(F.desc("error"), "bin"))).where(F.col("rank") <= k)


def mask_coverage(regions: DataFrame, mask: DataFrame, focus: float) -> DataFrame:
    """Regions by area times how much of a grid of samples in them moves: (f, z, coverage, score)."""
    by = frame(mask)
    boxes = regions.select(*by, "z", "area", "l", "t", F.col("r").alias("r_"), F.col("b").alias("b_"), F.expr("greatest(4, least(r - l, b - t) div 12)").alias("step"))
    on = (F.col("x") >= F.col("l")) & (F.col("x") < F.col("r_")) & (F.col("y") >= F.col("t")) & (F.col("y") < F.col("b_"))
    hit = _tiled(mask).join(_on_tiles(boxes, r="r_", b="b_"), [*by, "_tx", "_ty"]).where(on & ((F.col("x") - F.col("l")) % F.col("step") == 0) & ((F.col("y") - F.col("t")) % F.col("step") == 0))
    share = F.avg((F.col("moved") != 0).cast("int"))
    return hit.groupBy(*by, "z", "area").agg(share.alias("coverage")).select(*by, "z", "coverage", (F.col("area") * (1 + F.col("coverage") * focus / 18)).alias("score"))
