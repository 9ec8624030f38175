"""Pixel sources: the synthetic test frame, rasters of events, and raw BGR frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the frames that events fill, 500 events each.
WIDTH, HEIGHT = 25, 20


def synthetic(spark: SparkSession, width: int, height: int, shift: int) -> DataFrame:
    """The gradient, rectangle and diagonal test frame, later layers on top."""
    # The colours and places of the layers.
    box = (F.col("y") >= 14) & (F.col("y") < 46) & (F.col("x") >= 24 + shift) & (F.col("x") < min(width, 68 + shift))
    line = (F.col("y") < 64) & (F.col("x") == F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("y") + shift)))
    pixel = spark.range(width * height).select(F.lit(shift).alias("f"), F.col("id").cast("int").alias("k"), F.expr(f"int(id % {width})").alias("x"), F.expr(f"int(id div {width})").alias("y"))
    value = lambda base, boxed: F.when(line, 235).when(box, boxed).otherwise(F.expr(base)).cast("int")
    return pixel.select("*", value(f"32 + x * 40 div {width}", 50).alias("b"), value(f"38 + y * 35 div {height}", 86).alias("g"), value("48", 190).alias("r"))


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 25 x 20 pixels from runs of 500 events: (f, k, x, y, b, g, r)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    place = e.selectExpr("int(event_id div 500) f", "int(event_id % 500) k", "user_id", "event_type", "bigint(floor(abs(value))) v")
    at = place.selectExpr("*", f"k % {WIDTH} x", f"k div {WIDTH} y")
    return at.selectExpr(
        "f", "k", "int(x) x", "int(y) y", "int((x * 6 + user_id % 32 + f) % 256) b", "int((y * 9 + v % 24) % 256) g",
        "int((IF(x >= 6 + f % 4 AND x < 15 + f % 4 AND y BETWEEN 5 AND 13, 170, 40) + length(event_type) * 3) % 256) r")


RASTER_SQL = f"""pixel AS (
  SELECT f, k, x, y, CAST((x * 6 + user_id % 32 + f) % 256 AS BIGINT) AS b, CAST((y * 9 + v % 24) % 256 AS BIGINT) AS g,
         CAST((CASE WHEN x >= 6 + f % 4 AND x < 15 + f % 4 AND y BETWEEN 5 AND 13 THEN 170 ELSE 40 END + length(event_type) * 3) % 256 AS BIGINT) AS r
  FROM (SELECT event_id // 500 AS f, event_id % 500 AS k, (event_id % 500) % {WIDTH} AS x, (event_id % 500) // {WIDTH} AS y,
               user_id, event_type, CAST(floor(abs(value)) AS BIGINT) AS v FROM events))"""


def raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(path, f, bgr) of files of raw interleaved BGR frames; a file that ends within a frame is an error."""
    size = width * height * 3
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    whole = F.when(F.length("content") % size == 0, F.col("content")).otherwise(F.raise_error(F.lit("file ends within a frame")).cast("binary"))
    cut = files.select("path", whole.alias("content")).where(F.length("content") > 0)
    return cut.select("path", F.posexplode(F.expr(f"transform(sequence(0, length(content) div {size} - 1), i -> substring(content, i * {size} + 1, {size}))")).alias("f", "bgr"))


def explode_frames(frames: DataFrame, width: int) -> DataFrame:
    """Raw frames to pixels."""
    byte = lambda i: f"int(conv(hex(substring(bgr, 3 * k + {i + 1}, 1)), 16, 10))"
    k = frames.withColumn("k", F.expr("explode(sequence(0, length(bgr) div 3 - 1))"))
    return k.selectExpr("path", "f", "k", f"k % {width} x", f"int(k div {width}) y", f"{byte(0)} b", f"{byte(1)} g", f"{byte(2)} r")
