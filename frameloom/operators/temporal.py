"""Scores between neighbouring frames, top-k by frame, and the point budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .keys import frame, video


def match_scores(regions: DataFrame, diagonal: float, most: float | None = None) -> DataFrame:
    """Regions of a frame against those of the one before, by score: (video, f, z, pz, score).

    Regions of a frame are bounded by its pixels and the join is on the frame.
    With ``most``, pairs above it are dropped as early as the terms of place
    and size alone exceed it; no match is lost, as no term is negative.
    """
    by = frame(regions)
    cols = ["z", "area", "cx", "cy", "l", "t", "r", "b", "mean_b", "mean_g", "mean_r"]
    before = regions.select(*video(regions), (F.col("f") + 1).alias("f"), *[F.col(c).alias(f"p_{c}") for c in cols])
    center = F.sqrt((F.col("cx") - F.col("p_cx")) ** 2 + (F.col("cy") - F.col("p_cy")) ** 2)
    color = X.distance(["mean_b", "mean_g", "mean_r"], ["p_mean_b", "p_mean_g", "p_mean_r"])
    iou = X.intersection_over_union(["l", "t", "r", "b"], ["p_l", "p_t", "p_r", "p_b"])
    both = regions.join(before, by)
    if most is not None:
        both = both.where(X.region_match_score(center, diagonal, F.lit(0.0), "area", "p_area", F.lit(1.0)) <= most)
    scored = both.select(*by, "z", F.col("p_z").alias("pz"), X.region_match_score(center, diagonal, color, "area", "p_area", iou).alias("score"))
    return scored if most is None else scored.where(F.col("score") <= most)


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def point_budget(strokes: DataFrame, cap: int, budget: int) -> DataFrame:
    """How many points each stroke gets, in order of priority: at most ``cap``, its own number and what is left; under 2 it is left out."""
    by = frame(strokes)
    order = Window.partitionBy(*by).orderBy(F.desc("priority"), "z").rowsBetween(Window.unboundedPreceding, -1)
    want = F.least(F.lit(cap), F.col("n"))
    spent = strokes.withColumn("want", want).withColumn("left", F.lit(budget) - F.coalesce(F.sum("want").over(order), F.lit(0)))
    return spent.withColumn("points", F.least("want", "left")).where("points >= 2").select(*by, "z", F.col("points").cast("int").alias("points"))


def resample(strokes: DataFrame, n: int) -> DataFrame:
    """At most n points of each path, at half-even rounded places from first to last, without repeats in a row."""
    picked = F.expr(f"CASE WHEN size(points) <= {n} THEN points ELSE transform(sequence(0, {n} - 1), i -> points[int(bround(double(i) * (size(points) - 1) / ({n} - 1), 0))]) END")
    return strokes.withColumn("points", picked).withColumn("points", F.expr("filter(points, (p, i) -> i = 0 OR p <> points[i - 1])"))
