"""Triangles for display: fans of polygons, cells, strokes and residual patches in clip space.

Vertices are rows (keys, vertex, x, y, red, green, blue, alpha): x and y in clip
space, colours and alpha from 0 to 1. Six vertices are a quad, two triangles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import surface as S
from .keys import frame

#: Corners of a quad, clockwise from its first, as its two triangles take them.
QUAD = (0, 1, 2, 0, 2, 3)


def clip_x(x: Column, width: int) -> Column:
    return x / max(1, width) * 2 - 1


def clip_y(y: Column, height: int) -> Column:
    return 1 - y / max(1, height) * 2


def fan(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Triangles of each polygon from its first vertex: (f, z, tri, corner, cx, cy)."""
    by = frame(regions)
    tri = "transform(sequence(2, size(points) - 1), i -> array(points[0], points[i - 1], points[i]))"
    t = regions.where(F.size("points") >= 3).select(*by, "z", F.posexplode(F.expr(tri)).alias("tri", "v"))
    return t.select(*by, "z", "tri", F.posexplode("v").alias("corner", "p")).select(
        *by, "z", "tri", "corner", clip_x(F.col("p.x"), width).alias("cx"), clip_y(F.col("p.y"), height).alias("cy"))


def corner(x, y, alpha) -> Column:
    return F.struct(*[F.expr(v).cast("double").alias(n) if isinstance(v, str) else v.cast("double").alias(n) for n, v in (("x", x), ("y", y), ("alpha", alpha))])


def quads(df: DataFrame, keys: list[str], four: list[list[Column]], width: int, height: int) -> DataFrame:
    """Vertices of quads, given by their corners' (x, y, alpha), in the row's colour b, g, r.

    ``four`` is one list of four corners for each quad of a row.
    """
    v = F.array(*[q[i] for q in four for i in QUAD])
    out = df.select(*keys, "b", "g", "r", F.posexplode(v).alias("vertex", "p"))
    color = [(F.col(c) / 255).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))]
    return out.select(*keys, "vertex", clip_x(F.col("p.x"), width).alias("x"), clip_y(F.col("p.y"), height).alias("y"), *color, X.clamp(F.col("p.alpha"), 0.0, 1.0).alias("alpha"))


def box(x0, y0, x1, y1, alpha) -> list[Column]:
    return [corner(x0, y0, alpha), corner(x1, y0, alpha), corner(x1, y1, alpha), corner(x0, y1, alpha)]


def subdivisions(span: Column) -> Column:
    """How finely a surface cell of a span is drawn."""
    return F.when(span >= 36, 4).when(span >= 24, 3).when(span >= 14, 2).otherwise(1)


def backdrop(cells: DataFrame, cols: int, rows: int, width: int, height: int) -> DataFrame:
    """Vertices of a backdrop's grid of colours (f, cx, cy, b, g, r)."""
    keys = [*frame(cells), "cx", "cy"]
    return quads(cells, keys, [box(f"cx * {width} / {cols}D", f"cy * {height} / {rows}D", f"(cx + 1) * {width} / {cols}D", f"(cy + 1) * {height} / {rows}D", F.lit(1.0))], width, height)


def surface_vertices(cells: DataFrame, cell: int, width: int, height: int, opacity: int) -> DataFrame:
    """Vertices of surface cells, large ones cut finer, each piece in the shown colour of its middle; none if the surface is clear."""
    by = frame(cells)
    wide = S.with_corners(cells, S.corners(cells)).where(F.lit(opacity > 0))
    wide = wide.selectExpr("*", f"cx * {cell} x0", f"cy * {cell} y0", f"least({width}, cx * {cell} + {cell}) - cx * {cell} w", f"least({height}, cy * {cell} + {cell}) - cy * {cell} h")
    cut = wide.withColumn("nx", subdivisions(F.col("w"))).withColumn("ny", subdivisions(F.col("h")))
    cut = cut.selectExpr("*", "explode(sequence(0, ny - 1)) sy").selectExpr("*", "explode(sequence(0, nx - 1)) sx").withColumn("piece", F.expr("sy * nx + sx"))
    tx, ty = F.expr("(sx + 0.5D) / nx"), F.expr("(sy + 0.5D) / ny")
    colored = cut.select(*by, "cell", "piece", *[f"{c}" for c in ("x0", "y0", "w", "h", "nx", "ny", "sx", "sy")], *[S.shown(c, tx, ty).alias(c) for c in "bgr"])
    return quads(colored, [*by, "cell", "piece"], [box("x0 + w * sx / double(nx)", "y0 + h * sy / double(ny)", "x0 + w * (sx + 1) / double(nx)", "y0 + h * (sy + 1) / double(ny)", F.lit(opacity / 100))], width, height)


def residual_vertices(patches: DataFrame, width: int, height: int) -> DataFrame:
    """Vertices of residual patches (f, x, y, w, h, b, g, r, opacity): a core and four sides that fade outwards; small ones are one fainter box."""
    by = frame(patches)
    inside = patches.selectExpr(*by, *[f"{k} AS {n}" for k, n in (("x", "px"), ("y", "py"))], "b", "g", "r", "opacity / 255D AS a", f"double(greatest(0, least({width}, x))) x0", f"double(greatest(0, least({height}, y))) y0",
                                f"double(greatest(0, least({width}, x + w))) x1", f"double(greatest(0, least({height}, y + h))) y1").where("x1 > x0 AND y1 > y0")
    inside = inside.withColumn("m", F.expr("greatest(2D, least(7D, 0.33D * least(x1 - x0, y1 - y0)))"))
    inside = inside.selectExpr("*", "x0 + m AS u0", "y0 + m AS v0", "x1 - m AS u1", "y1 - m AS v1")
    keys = [*by, "px", "py"]
    large = (F.col("u1") > F.col("u0")) & (F.col("v1") > F.col("v0"))
    sides = [
        box("u0", "v0", "u1", "v1", "a"),
        [corner("x0", "y0", "0D"), corner("x1", "y0", "0D"), corner("u1", "v0", "a"), corner("u0", "v0", "a")], [corner("u0", "v1", "a"), corner("u1", "v1", "a"), corner("x1", "y1", "0D"), corner("x0", "y1", "0D")],
        [corner("x0", "y0", "0D"), corner("u0", "v0", "a"), corner("u0", "v1", "a"), corner("x0", "y1", "0D")], [corner("u1", "v0", "a"), corner("x1", "y0", "0D"), corner("x1", "y1", "0D"), corner("u1", "v1", "a")]]
    return quads(inside.where(large), keys, sides, width, height).unionByName(quads(inside.where(~large), keys, [box("x0", "y0", "x1", "y1", "0.55D * a")], width, height))


def stroke_vertices(strokes: DataFrame, width: int, height: int, glow: bool) -> DataFrame:
    """Vertices of strokes (f, z, points, b, g, r, intensity, width, glow, opacity): each segment a quad along its normal.

    The glow pass draws wider, brighter and fainter; segments under .001 are skipped.
    """
    by = frame(strokes)
    core = F.greatest(F.lit(1.0), F.col("width") / 4)
    half = (core + F.col("glow") if glow else core) / 2
    alpha = F.col("opacity") / 255 * (X.clamp(F.col("glow") / 28, 0.08, 0.32) if glow else F.lit(1.0))
    color = [(X.glow_boost(c, "intensity") if glow else F.col(c)).alias(c) for c in "bgr"]
    s = F.expr("transform(sequence(1, size(points) - 1), i -> struct(points[i - 1] AS a, points[i] AS b))")
    t = strokes.where(F.size("points") >= 2).select(*by, "z", *color, half.alias("hw"), alpha.alias("a"), F.posexplode(s).alias("seg", "s"))
    t = t.selectExpr(*by, "z", "seg", "b", "g", "r", "hw", "a", "double(s.a.x) ax", "double(s.a.y) ay", "double(s.b.x) bx", "double(s.b.y) by").withColumn("len", F.expr("sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))")).where("len >= 0.001")
    t = t.withColumn("nx", F.expr("-(by - ay) / len * hw")).withColumn("ny", F.expr("(bx - ax) / len * hw"))
    return quads(t, [*by, "z", "seg"], [[corner("ax + nx", "ay + ny", "a"), corner("bx + nx", "by + ny", "a"), corner("bx - nx", "by - ny", "a"), corner("ax - nx", "ay - ny", "a")]], width, height)


def stroke_frame(cells: DataFrame, strokes: DataFrame, patches: DataFrame, cell: int, width: int, height: int, opacity: int) -> DataFrame:
    """All vertices of a frame in the order of drawing: surface, residual patches, glow, strokes. (f, layer, item, part, vertex, ...)."""
    by = frame(cells)
    layer = lambda df, n, item, part: df.select(*by, F.lit(n).alias("layer"), F.expr(item).cast("long").alias("item"), F.expr(part).cast("long").alias("part"), "vertex", "x", "y", "red", "green", "blue", "alpha")
    return (
        layer(surface_vertices(cells, cell, width, height, opacity), 0, "cell", "piece").unionByName(layer(residual_vertices(patches, width, height), 1, "py", "px"))
        .unionByName(layer(stroke_vertices(strokes, width, height, True), 2, "z", "seg")).unionByName(layer(stroke_vertices(strokes, width, height, False), 3, "z", "seg")))


def region_frame(regions: DataFrame, backdrops: DataFrame | None, cols: int, rows: int, width: int, height: int) -> DataFrame:
    """All triangles of a frame in the order of drawing: the backdrop if there is one, then polygons by z: (f, layer, item, part, corner, x, y, red, green, blue)."""
    by = frame(regions)
    colors = regions.select(*by, "z", *[(F.col(c) / 255).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])
    drawn = fan(regions, width, height).join(colors, [*by, "z"]).select(*by, F.lit(1).alias("layer"), F.col("z").cast("long").alias("item"), F.col("tri").cast("long").alias("part"), F.col("corner").cast("int").alias("corner"), F.col("cx").alias("x"), F.col("cy").alias("y"), "red", "green", "blue")
    if backdrops is None:
        return drawn
    behind = backdrop(backdrops, cols, rows, width, height)
    return behind.select(*by, F.lit(0).alias("layer"), F.expr(f"bigint(cy * {cols} + cx)").alias("item"), F.expr("bigint(vertex div 3)").alias("part"), F.expr("int(vertex % 3)").alias("corner"), "x", "y", "red", "green", "blue").unionByName(drawn)
