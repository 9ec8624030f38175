"""Whole-file summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import frame


def regions(df: DataFrame) -> DataFrame:
    """Frames, regions, corrections (id 0), points and distinct positive ids of (f, id, points)."""
    return df.agg(
        F.countDistinct("f").alias("frames"), F.count("*").alias("regions"), F.count(F.when(F.col("id") == 0, 1)).alias("corrections"),
        F.sum(F.size("points")).cast("long").alias("points"), F.countDistinct(F.when(F.col("id") > 0, F.col("id"))).alias("tracks"))


def of_frames(df: DataFrame) -> DataFrame:
    """The same of frames with their regions in an array, so that frames without regions count."""
    told = df.agg(
        F.count("*").alias("frames"), F.sum(F.size("regions")).cast("long").alias("regions"), F.sum(F.size(F.filter("regions", lambda r: r["id"] == 0))).cast("long").alias("corrections"),
        F.sum(F.aggregate("regions", F.lit(0), lambda a, r: a + F.size(r["points"]))).cast("long").alias("points"))
    # two tables of one row
    return told.join(tracks(df, "regions"))


def tracks(df: DataFrame, items: str) -> DataFrame:
    """How many distinct ids above 0 the items of frames have."""
    return df.select(F.explode(F.transform(items, lambda s: s["id"])).alias("id")).where("id > 0").agg(F.countDistinct("id").alias("tracks"))


def strokes(frames: DataFrame, strokes_: DataFrame, residuals: DataFrame, cells_per_frame: int) -> DataFrame:
    """Frames, key frames, cells of the dense surface, strokes and their points, distinct ids (that of hatches, 0, counts) and residual patches."""
    told = frames.agg(F.count("*").alias("frames"), F.sum(F.col("key").cast("int")).cast("long").alias("keyframes"), (F.count("*") * cells_per_frame).alias("cells"))
    drawn = strokes_.agg(F.count("*").alias("strokes"), F.countDistinct("id").alias("tracks"), F.coalesce(F.sum(F.size("points")), F.lit(0)).cast("long").alias("points"))
    # three tables of one row
    return told.join(drawn).join(residuals.agg(F.count("*").alias("residuals")))


def per_frame(df: DataFrame) -> DataFrame:
    return df.groupBy(*frame(df)).agg(F.count("*").alias("regions"), F.count(F.when(F.col("id") == 0, 1)).alias("corrections"), F.sum(F.size("points")).cast("long").alias("points"))
