"""Stencils over dense frames: blur, gradient, suppression, thresholds, bridging, morphology.

Rows are dense and numbered row by row, so a pixel's eight neighbours are at
fixed offsets of k. One window by frame serves them all: the frame is shuffled
and sorted once, however many stencils follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from .keys import frame, video


def at(df: DataFrame, c: str, dx: int, dy: int, width: int) -> Column:
    """A neighbour's value; at the border it may be another row's, so callers mask it."""
    return F.lag(c, -(dy * width + dx)).over(Window.partitionBy(*frame(df)).orderBy("k"))


def interior(width: int, height: int) -> Column:
    return (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < width - 1) & (F.col("y") < height - 1)


def blur(df: DataFrame, c: str, width: int, height: int, out: str) -> DataFrame:
    """3 x 3 binomial blur (1 2 1), rounded by adding 8; border pixels stay."""
    total = sum((at(df, c, dx, dy, width) * ((2 - abs(dx)) * (2 - abs(dy))) for dx in (-1, 0, 1) for dy in (-1, 0, 1)), F.lit(0))
    return df.withColumn(out, F.when(interior(width, height), F.shiftright((total + 8).cast("int"), 4)).otherwise(F.col(c)).cast("int"))


def gradient(df: DataFrame, c: str, width: int, height: int) -> DataFrame:
    """Sobel gx, gy and mag = min(255, (|gx| + |gy|) >> 2); 0 at the border."""
    a = lambda dx, dy: at(df, c, dx, dy, width)
    gx = a(1, -1) + 2 * a(1, 0) + a(1, 1) - a(-1, -1) - 2 * a(-1, 0) - a(-1, 1)
    gy = a(-1, 1) + 2 * a(0, 1) + a(1, 1) - a(-1, -1) - 2 * a(0, -1) - a(1, -1)
    inside = interior(width, height)
    out = df.withColumn("gx", F.when(inside, gx).otherwise(0).cast("int")).withColumn("gy", F.when(inside, gy).otherwise(0).cast("int"))
    return out.withColumn("mag", F.least(F.lit(255), F.shiftright(F.abs("gx") + F.abs("gy"), 2)))


def suppress(df: DataFrame, width: int, height: int) -> DataFrame:
    """Keeps a magnitude that is no less than both neighbours along its gradient (four directions)."""
    m = lambda dx, dy: at(df, "mag", dx, dy, width)
    ax, ay = F.abs("gx"), F.abs("gy")
    same = F.col("gx").bitwiseXOR(F.col("gy")) >= 0
    one = F.when(ax > 2 * ay, m(-1, 0)).when(ay > 2 * ax, m(0, -1)).when(same, m(-1, -1)).otherwise(m(1, -1))
    two = F.when(ax > 2 * ay, m(1, 0)).when(ay > 2 * ax, m(0, 1)).when(same, m(1, 1)).otherwise(m(-1, 1))
    kept = interior(width, height) & (F.col("mag") >= one) & (F.col("mag") >= two)
    return df.withColumn("nms", F.when(kept, F.col("mag")).otherwise(0))


def high_threshold(df: DataFrame, c: str, quality: int, density: int) -> DataFrame:
    """Per frame the largest value that as many non-zero pixels reach as are kept (``params.keep_count``), from 18 to 210; 255 if there are none."""
    by = frame(df)
    counts = df.where(F.col(c) > 0).groupBy(*by, F.col(c).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    upto = w.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = counts.withColumn("cum", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(w)).where(F.col("cum") >= P.keep_count(F.col("all"), quality, density))
    found = cut.groupBy(*by).agg(F.max("v").alias("v"))
    return df.select(*by).distinct().join(found, by, "left").select(*by, F.when(F.col("v").isNull(), 255).otherwise(F.least(F.lit(210), F.greatest(F.lit(18), F.col("v")))).cast("int").alias("high"))


def bridge(df: DataFrame, c: str, width: int, height: int, out: str) -> DataFrame:
    """Sets an inner pixel whose opposite neighbours on one of the four axes are set in the old mask."""
    m = lambda dx, dy: F.coalesce(at(df, c, dx, dy, width), F.lit(0))
    pairs = [(m(dx, dy) > 0) & (m(-dx, -dy) > 0) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))]
    joined = pairs[0] | pairs[1] | pairs[2] | pairs[3]
    return df.withColumn(out, F.when(F.col(c) > 0, 1).when(interior(width, height) & joined, 1).otherwise(0))


def _around(df: DataFrame, c: str, width: int, height: int, pick, out: str) -> DataFrame:
    """pick (least or greatest) of the pixel and its neighbours within the frame."""
    near = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            ok = (F.col("x") + dx >= 0) & (F.col("x") + dx < width) & (F.col("y") + dy >= 0) & (F.col("y") + dy < height)
            near.append(F.when(ok, at(df, c, dx, dy, width)))
    return df.withColumn(out, pick(*near))


def erode(df, c, width, height, out):
    return _around(df, c, width, height, F.least, out)


def dilate(df, c, width, height, out):
    return _around(df, c, width, height, F.greatest, out)


def open_close_open(df: DataFrame, c: str, width: int, height: int, out: str) -> DataFrame:
    """Opening, closing and opening by a 3 x 3 square; beyond the border there is nothing."""
    now = c
    for i, step in enumerate((erode, dilate, dilate, erode, erode, dilate)):
        df = step(df, now, width, height, f"_m{i}")
        now = f"_m{i}"
    return df.withColumn(out, F.col(now)).drop(*[f"_m{i}" for i in range(6)])


def motion(pixel: DataFrame, threshold: int, least: float = 0.0015, most: float = 0.7) -> DataFrame:
    """Pixels that moved since the frame before; a frame whose share of them is out of range has no mask."""
    by = frame(pixel)
    before = Window.partitionBy(*video(pixel), "k").orderBy("f")
    d = [F.abs(F.col(c) - F.lag(c).over(before)) for c in ("b", "g", "r")]
    seen = pixel.select(*by, "k", "x", "y", F.lag("f").over(before).alias("pf"), F.greatest(*d).alias("most"), (d[0] + d[1] + d[2]).alias("total"))
    marked = seen.where("pf IS NOT NULL").withColumn("moved", ((F.col("most") >= threshold) & (F.col("total") >= 2 * threshold)).cast("int"))
    share = F.avg("moved").over(Window.partitionBy(*by))
    return marked.withColumn("share", share).where((F.col("share") >= least) & (F.col("share") <= most)).select(*by, "k", "x", "y", "moved")


def boundary_edges(labelled: DataFrame, width: int, height: int, c: str = "idx") -> DataFrame:
    """Directed unit edges around each set of equal ``c``, clockwise: (f, idx, component, k, side, x0, y0, x1, y1).

    ``c`` may be the label or the component; sides are numbered from the top, clockwise.
    """
    other = lambda dx, dy, ok: (~ok) | (at(labelled, c, dx, dy, width) != F.col(c))
    component = F.col("component") if "component" in labelled.columns else F.col(c)
    by = frame(labelled)
    sides = labelled.select(
        *by, "idx", component.alias("component"), "k", "x", "y", other(0, -1, F.col("y") > 0).alias("top"), other(1, 0, F.col("x") < width - 1).alias("right"),
        other(0, 1, F.col("y") < height - 1).alias("low"), other(-1, 0, F.col("x") > 0).alias("left"))
    edge = lambda n, side, a, b, c, d: f"IF({side}, struct({n} AS side, {a} AS x0, {b} AS y0, {c} AS x1, {d} AS y1), NULL)"
    four = ", ".join((edge(0, "top", "x", "y", "x + 1", "y"), edge(1, "right", "x + 1", "y", "x + 1", "y + 1"), edge(2, "low", "x + 1", "y + 1", "x", "y + 1"), edge(3, "left", "x", "y + 1", "x", "y")))
    return sides.select(*by, "idx", "component", "k", F.explode(F.expr(f"filter(array({four}), e -> e IS NOT NULL)")).alias("e")).select(*by, "idx", "component", "k", "e.*")
