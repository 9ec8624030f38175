"""Surface cells: grid means, changes, reconstruction, corners, hatches, residual tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import exprs as X
from .keys import frame, video

CHANNELS = ("b", "g", "r")


def grid_means(pixel: DataFrame, cell: int, width: int) -> DataFrame:
    """Truncating mean colour of each cell of a grid: (f, cell, cx, cy, b, g, r)."""
    cols = -(-width // cell)
    by = frame(pixel)
    at = pixel.selectExpr(*by, f"int(x div {cell}) cx", f"int(y div {cell}) cy", *CHANNELS)
    return at.groupBy(*by, "cx", "cy").agg(*[F.expr(f"int(sum({c}) div count(*))").alias(c) for c in CHANNELS]).selectExpr(*by, f"cy * {cols} + cx cell", "cx", "cy", *CHANNELS)


def changes(cells: DataFrame, threshold: int, keyframe: int) -> DataFrame:
    """Cells to send: all on a key frame, else those that moved from the frame before by the threshold or more.

    A cell is compared with the frame before, not with what was sent last, so a
    slow drift is sent with the next key frame only.
    """
    before = Window.partitionBy(*video(cells), "cell").orderBy("f")
    last = [F.lag(c).over(before).alias(f"p{c}") for c in CHANNELS]
    seen = cells.select("*", F.lag("f").over(before).alias("pf"), *last)
    moved = X.distance_squared(list(CHANNELS), [f"p{c}" for c in CHANNELS]) >= threshold * threshold
    return seen.where((F.col("f") % keyframe == 0) | F.col("pf").isNull() | moved).select(*frame(cells), "cell", *CHANNELS)


def reconstruct(sent: DataFrame, slots: DataFrame) -> DataFrame:
    """The dense surface: at each (f, cell) of ``slots`` the colour sent last at or before that frame."""
    by = frame(slots)
    known = slots.select(*by, "cell").join(sent, [*by, "cell"], "left")
    upto = Window.partitionBy(*video(slots), "cell").orderBy("f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.select(*by, "cell", *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in CHANNELS])


def corners(cells: DataFrame) -> DataFrame:
    """Truncating mean of the up to four cells that meet at each grid corner: (f, vx, vy, b, g, r)."""
    by = frame(cells)
    spread = cells.select(*by, *CHANNELS, F.explode(F.expr("array(struct(cx AS vx, cy AS vy), struct(cx + 1 AS vx, cy AS vy), struct(cx AS vx, cy + 1 AS vy), struct(cx + 1 AS vx, cy + 1 AS vy))")).alias("v"))
    return spread.groupBy(*by, "v.vx", "v.vy").agg(*[F.expr(f"int(sum({c}) div count(*))").alias(c) for c in CHANNELS])


def with_corners(cells: DataFrame, meet: DataFrame) -> DataFrame:
    """Cells with the colours of their four corners in a row: c00_b to c11_r beside own_b to own_r."""
    spots = F.explode(F.expr("array(struct('c00' AS n, cx AS vx, cy AS vy), struct('c10' AS n, cx + 1 AS vx, cy AS vy), struct('c01' AS n, cx AS vx, cy + 1 AS vy), struct('c11' AS n, cx + 1 AS vx, cy + 1 AS vy))"))
    by = frame(cells)
    asked = cells.select(*by, "cell", "cx", "cy", *CHANNELS, spots.alias("s")).select(*by, "cell", "cx", "cy", *[F.col(c).alias(f"own_{c}") for c in CHANNELS], "s.*")
    met = asked.join(meet, [*by, "vx", "vy"])
    picks = [F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{n}_{c}") for n in ("c00", "c10", "c01", "c11") for c in CHANNELS]
    return met.groupBy(*by, "cell", "cx", "cy", *[f"own_{c}" for c in CHANNELS]).agg(*picks)


def shown(c: str, tx, ty) -> Column:
    """A channel of a cell's shown colour at a place in it: 0.88 of its own and 0.12 of its corners' bilinear blend."""
    return X.blend_byte(f"own_{c}", X.bilinear(f"c00_{c}", f"c10_{c}", f"c01_{c}", f"c11_{c}", tx, ty), 0.12)


def display(cells: DataFrame, meet: DataFrame, tx: float, ty: float) -> DataFrame:
    return with_corners(cells, meet).select(*frame(cells), "cell", *[shown(c, tx, ty).cast("int").alias(c) for c in CHANNELS])


def display_at(places: DataFrame, cells: DataFrame, cell: int, width: int, height: int) -> DataFrame:
    """``places`` (f, x, y and more) with the surface's shown colour at each pixel as pb, pg, pr."""
    cols, rows = -(-width // cell), -(-height // cell)
    at = places.withColumn("cx", F.least(F.lit(cols - 1), F.expr(f"int(x div {cell})"))).withColumn("cy", F.least(F.lit(rows - 1), F.expr(f"int(y div {cell})")))
    met = at.join(with_corners(cells, corners(cells)).drop("cell"), [*frame(cells), "cx", "cy"])
    part = lambda v, i, most: f"({v} - {i} * {cell}) / double(greatest(1, least({most}, {i} * {cell} + {cell}) - {i} * {cell}))"
    tx, ty = F.expr(part("x", "cx", width)), F.expr(part("y", "cy", height))
    return met.select(*places.columns, *[shown(c, tx, ty).cast("int").alias(f"p{c}") for c in CHANNELS])


def hatches(cells: DataFrame, cell: int, width: int, height: int, knobs: dict) -> DataFrame:
    """Short strokes over every so many cells of a frame, up to the number that its size allows, in order of cells.

    A slash or backslash by the parity of its place, lighter than the cell and
    the more opaque the darker that is; bright cells get one on every fifth
    diagonal alone. ``knobs`` are those of ``params.DEFAULTS``.
    """
    cols, rows = -(-width // cell), -(-height // cell)
    limit = P.max_hatches(knobs["detail"], width, height)
    stride = max(1, -(-(cols * rows) // max(1, limit)))
    inset = max(1, cell // 5)
    seen = cells.withColumn("luma", X.luminance()).where(F.col("cell") % stride == 0).where((F.col("luma") <= 238) | ((F.col("cx") + F.col("cy")) % 5 == 0))
    seen = seen.selectExpr("*", f"cx * {cell} x0", f"cy * {cell} y0", f"least({width - 1}, cx * {cell} + {cell - 1}) x1", f"least({height - 1}, cy * {cell} + {cell - 1}) y1").where("x1 > x0 AND y1 > y0")
    placed = seen.withColumn("z", F.row_number().over(Window.partitionBy(*frame(cells)).orderBy("cell"))).where(F.col("z") <= (limit if knobs["detail"] > 0 else 0))
    slash = F.expr(f"(cx div {stride} + cy) % 2 = 0")
    dark = F.floor(X.clamp(255 - F.col("luma"), 0.0, 255.0))
    lighter = X.clamp((255 - F.col("luma")) / 510.0, 0.08, 0.28)
    whole = lambda v, lo, hi: F.floor(X.clamp(v, float(lo), float(hi))).cast("int")
    return placed.select(
        *frame(cells), "z", "cell", (F.col("x0") + inset).cast("int").alias("x0"), F.when(slash, F.col("y1") - inset).otherwise(F.col("y0") + inset).cast("int").alias("y0"),
        (F.col("x1") - inset).cast("int").alias("x1"), F.when(slash, F.col("y0") + inset).otherwise(F.col("y1") - inset).cast("int").alias("y1"),
        *[X.blend_byte(c, 255, lighter).cast("int").alias(c) for c in CHANNELS],
        whole(80 + dark * 0.45, 80, 210).alias("intensity"), F.lit(P.clamp(3 + knobs["quality"] // 60, 3, 5)).alias("width"), F.lit(P.clamp(knobs["glow"] // 18, 0, 5)).alias("glow"),
        whole(28 + dark * 0.35 + knobs["detail"] * 0.25, 34, 148).alias("opacity"))


def residual_tiles(pixel: DataFrame, cells: DataFrame, cell: int, width: int, height: int, knobs: dict) -> DataFrame:
    """Tiles whose pixels differ from the surface's colour in the tile's middle: (f, x, y, w, h, error, colour, opacity).

    Of the tiles whose mean error reaches the threshold, the worst by error, as
    many as the frame's size allows, equal ones in order of place.
    """
    tile, threshold = P.residual_tile(cell), P.residual_threshold(knobs["quality"], knobs["residual"])
    limit = P.max_residuals(knobs["residual"], width, height)
    box = [f"tx * {tile} x0", f"ty * {tile} y0", f"least({width}, tx * {tile} + {tile}) x1", f"least({height}, ty * {tile} + {tile}) y1"]
    by = frame(pixel)
    middles = pixel.select(*by).distinct().selectExpr(*by, f"explode(sequence(0, {-(-width // tile) - 1})) tx").selectExpr(*by, "tx", f"explode(sequence(0, {-(-height // tile) - 1})) ty")
    middles = middles.selectExpr(*by, "tx", "ty", *box).selectExpr("*", "int((x0 + x1) div 2) x", "int((y0 + y1) div 2) y")
    predicted = display_at(middles, cells, cell, width, height).drop("x", "y")
    told = pixel.selectExpr(*by, f"int(x div {tile}) tx", f"int(y div {tile}) ty", *CHANNELS).join(predicted, [*by, "tx", "ty"])
    seen = told.selectExpr(*by, "tx", "ty", "x0", "y0", "x1", "y1", *CHANNELS, "(abs(b - pb) + abs(g - pg) + abs(r - pr)) div 3 AS e")
    tiles = seen.groupBy(*by, "tx", "ty", "x0", "y0", "x1", "y1").agg(F.expr("sum(e) / double(count(*))").alias("error"), *[F.expr(f"int(sum({c}) div count(*))").alias(c) for c in CHANNELS]).where(F.col("error") >= threshold)
    worst = Window.partitionBy(*by).orderBy(F.desc("error"), "ty", "tx")
    opacity = F.floor(X.clamp(36 + F.col("error") * 3.2, 54.0, 190.0)).cast("int").alias("opacity")
    return tiles.withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= limit).select(
        *by, F.col("x0").alias("x"), F.col("y0").alias("y"), F.expr("x1 - x0").alias("w"), F.expr("y1 - y0").alias("h"), "error", *CHANNELS, opacity)


def proportional_grid(pixel: DataFrame, cols: int, rows: int, width: int, height: int) -> DataFrame:
    """Half-even means over bins proportional to the frame: a backdrop of cols x rows colours."""
    by = frame(pixel)
    at = pixel.selectExpr(*by, f"int(x * {cols} div {width}) cx", f"int(y * {rows} div {height}) cy", *CHANNELS)
    return at.groupBy(*by, "cx", "cy").agg(*[F.expr(f"int(bround(sum({c}) / count(*), 0))").alias(c) for c in CHANNELS])
