"""Whole jobs: frames to region, edge and stroke files, and what files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import exprs as X
from ..operators import encode as E
from ..operators import frames as FR
from ..operators import stencils as ST
from ..operators import strokes as SK
from ..operators import summary as SU
from ..operators import surface as S
from ..sources import binary_format as B
from ..sources import raster
from ..sources import text_format as TF


def first_frames(frames: DataFrame, most: int) -> DataFrame:
    """The first ``most`` frames of each video, all if it is 0."""
    return frames.where(F.col("f") < most) if most > 0 else frames


def stroke_strokes(pixel: DataFrame, width: int, height: int, knobs: dict) -> DataFrame:
    """Tracked strokes of pixels (video, f, k, x, y, b, g, r), ghosts among them: rows of strokes.STROKE_SCHEMA.

    One window by frame serves all stencils; the strokes' own kernel takes the
    frame as it lies, and only strokes are folded by video.
    """
    seen = ST.blur(pixel.withColumn("l0", X.luma()), "l0", width, height, "l")
    nms = ST.suppress(ST.gradient(seen, "l", width, height), width, height)
    edges = FR.hysteresis(nms, "nms", ST.high_threshold(nms, "nms", knobs["quality"], knobs["density"]), width, height)
    bridged = ST.bridge(edges, "edge", width, height, "e").select("video", "f", "k", F.col("e").alias("edge"))
    whole = nms.select("video", "f", "k", "b", "g", "r", "mag").join(bridged, ["video", "f", "k"])
    return SK.tracked(SK.build(whole, width, height, knobs), width, height, knobs["density"])


def stroke_frames(pixel: DataFrame, width: int, height: int, knobs: dict | None = None) -> DataFrame:
    """(video, f, key, changes, strokes, residuals) of pixels: a row a frame, as the stroke container holds it."""
    knobs = P.DEFAULTS | (knobs or {})
    cell = P.surface_cell(knobs["quality"], knobs["detail"], width, height)
    cells = S.grid_means(pixel, cell, width)
    sent = S.changes(cells, P.surface_delta(knobs["quality"], knobs["detail"]), knobs["keyframe"])
    tracked = stroke_strokes(pixel, width, height, knobs)
    hatched = SK.as_rows(S.hatches(cells, cell, width, height, knobs)).withColumn("z", F.col("z") + 1_000_000)
    patches = S.residual_tiles(pixel, cells, cell, width, height, knobs)

    def listed(df: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))  # a frame's size bounds it
        return df.groupBy("video", "f").agg(held.alias(name)).select("video", "f", F.transform(name, lambda s: F.struct(*[s[c].alias(c) for c in fields])).alias(name))

    changes = listed(sent, ["cell"], ["cell", "r", "g", "b"], "changes")
    strokes = listed(tracked.unionByName(hatched), ["z"], ["id", "r", "g", "b", "intensity", "width", "glow", "opacity", "points", "length", "z"], "strokes")
    residuals = listed(patches, ["y", "x"], ["x", "y", "w", "h", "r", "g", "b", "opacity"], "residuals")
    every = pixel.select("video", "f").distinct().withColumn("key", F.col("f") % knobs["keyframe"] == 0)
    out = every.join(changes, ["video", "f"], "left").join(strokes, ["video", "f"], "left").join(residuals, ["video", "f"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("video", "f", "key", empty("changes"), empty("strokes"), empty("residuals"))


def stroke_header(width: int, height: int, knobs: dict) -> dict:
    cell = P.surface_cell(knobs["quality"], knobs["detail"], width, height)
    return {k: knobs[k] for k in B.STROKE_FIELDS if k in knobs} | {"cell": cell, "cols": -(-width // cell), "rows": -(-height // cell), "width": width, "height": height}


def convert_strokes(pixel: DataFrame, path: str, width: int, height: int, fps: float = 30.0, knobs: dict | None = None, max_frames: int = 0) -> None:
    """Writes a stroke container for each video to a mounted folder."""
    knobs = P.DEFAULTS | (knobs or {})
    pixel.sparkSession.dataSource.register(B.StrokeContainer)
    frames = stroke_frames(first_frames(pixel, max_frames), width, height, knobs)
    writer = frames.repartition("video").sortWithinPartitions("video", "f").write.format("stroke_container").mode("append").option("path", path).option("fps", fps)
    for k, v in stroke_header(width, height, knobs).items():
        writer = writer.option(k, v)
    writer.save()


def convert_regions(frames: DataFrame, path: str, width: int, height: int, fps: float = 30.0, knobs: dict | None = None, binary: bool = True) -> None:
    """Traces frames (video, f, bgr), names regions and writes a file for each video: a container, or text."""
    knobs = E.KNOBS | (knobs or {})
    named = E.with_ids(E.regions(frames, width, height, knobs), width, height)
    if not binary:
        TF.write_text(TF.region_text(named, width, height, fps, knobs["quality"], knobs["palette"]), path)
        return
    frames.sparkSession.dataSource.register(B.RegionContainer)
    writer = named.repartition("video").sortWithinPartitions("video", "f").write.format("region_container").mode("append").option("path", path).option("fps", fps)
    writer.option("width", width).option("height", height).option("quality", knobs["quality"]).option("palette", knobs["palette"]).save()


def convert_edges(frames: DataFrame, path: str, width: int, height: int, fps: float = 30.0, sensitivity: float = 60.0, lightness: bool = True, tolerance: float = 0.0) -> None:
    """Writes an edge text file for each video."""
    TF.write_text(TF.edge_text(E.edges(frames, width, height, sensitivity, lightness, tolerance), width, height, fps), path)


def info(spark: SparkSession, path: str) -> DataFrame:
    """What the files of a path hold, told by the path's extension: one row of counts, with the format's name for text files."""
    kind = spark.range(1).select(X.is_stroke_path(F.lit(path)).alias("s"), X.is_binary_path(F.lit(path)).alias("b")).first()
    if kind["s"]:
        frames = B.read_stroke_frames(spark, path)
        each = frames.select((F.octet_length("surface") / 3).cast("long").alias("cells"), "key", "strokes", "residuals")
        told = each.agg(
            F.count("*").alias("frames"), F.sum(F.col("key").cast("long")).alias("keyframes"), F.sum("cells").alias("cells"), F.sum(F.size("strokes")).cast("long").alias("strokes"),
            F.sum(F.aggregate("strokes", F.lit(0), lambda a, s: a + F.size(s["points"]))).cast("long").alias("points"), F.sum(F.size("residuals")).cast("long").alias("residuals"))
        ids = frames.select(F.explode("strokes.id").alias("id")).agg(F.countDistinct("id").alias("tracks"))  # hatches' 0 is one of them
        return told.join(ids)
    if kind["b"]:
        return SU.of_frames(B.read_region_frames(spark, path)).withColumn("paths", F.lit(0).cast("long"))
    lines = TF.read_lines(spark, path)
    name = TF.headers(lines).agg(F.min("format").alias("format")).first()["format"]
    if name == TF.REGION_FORMAT:
        regions = TF.parse_regions(lines).groupBy("path", "f").agg(F.collect_list(F.struct("id", "points")).alias("regions"))
        whole = TF.parse_frames(lines).select("path", "f").join(regions, ["path", "f"], "left").withColumn("regions", F.coalesce("regions", F.array().cast("array<struct<id:int,points:array<struct<x:int,y:int>>>>")))
        told = SU.of_frames(whole).withColumn("paths", F.lit(0).cast("long"))
    else:
        paths = TF.parse_paths(lines) if name == TF.EDGE_FORMAT else TF.parse_legacy(lines).where(F.size("points") > 0)
        frames = (TF.framed(lines, ("PATH",), 3) if name == TF.EDGE_FORMAT else TF.parse_legacy(lines)).select("path", "f").distinct().agg(F.count("*").alias("frames"))
        zero = F.lit(0).cast("long")
        told = frames.join(paths.agg(F.count("*").alias("paths"), F.coalesce(F.sum(F.size("points")), F.lit(0)).cast("long").alias("points"))).select("frames", zero.alias("regions"), zero.alias("corrections"), "points", zero.alias("tracks"), "paths")
    return told.withColumn("format", F.lit(name))


def synthetic_pixels(spark: SparkSession, width: int = 96, height: int = 64, shifts: tuple[int, ...] = (0, 4), video: str = "test") -> DataFrame:
    """The two synthetic test frames as pixels of one video, numbered in order."""
    out = None
    for f, shift in enumerate(shifts):
        one = raster.synthetic(spark, width, height, shift).withColumn("f", F.lit(f)).withColumn("video", F.lit(video))
        out = one if out is None else out.unionByName(one)
    return out


def packed(pixel: DataFrame) -> DataFrame:
    """Frames (video, f, bgr) of whole frames of pixels; a frame's pixels bound the list."""
    digits = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "bgr"])
    return pixel.groupBy("video", "f").agg(F.array_sort(F.collect_list(F.struct("k", digits.alias("h")))).alias("p")).select("video", "f", F.unhex(F.array_join(F.transform("p", lambda s: s["h"]), "")).alias("bgr"))
