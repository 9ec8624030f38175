"""Palettes: sampling, k-means, nearest-colour assignment, label statistics, background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import frame

CHANNELS = ("b", "g", "r")


def grid_sample(pixel: DataFrame, stride: int) -> DataFrame:
    return pixel.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))


def initial(sample: DataFrame, size: int) -> DataFrame:
    """Centres at evenly spaced places of each frame's samples, in pixel order: (f, idx, b, g, r)."""
    by = frame(sample)
    w = Window.partitionBy(*by)
    placed = sample.withColumn("i", F.row_number().over(w.orderBy("k")) - 1).withColumn("n", F.count("*").over(w))
    idx = F.expr(f"explode(filter(sequence(0, int(least({size}, n)) - 1), j -> int(rint(j * (n - 1) / greatest(1D, least({size}, n) - 1D))) = i))")
    return placed.select(*by, idx.alias("idx"), *[F.col(c).cast("double").alias(c) for c in CHANNELS])


def packed(palette: DataFrame) -> DataFrame:
    """One row a frame with its centres in order; a palette has at most some dozens."""
    return palette.groupBy(*frame(palette)).agg(F.array_sort(F.collect_list(F.struct("idx", *CHANNELS))).alias("centres"))


def nearest(centres: str = "centres", of: tuple[str, ...] = CHANNELS) -> Column:
    """The centre of the least squared distance; the first of equals."""
    d = " + ".join(f"(c.{v} - {v}) * (c.{v} - {v})" for v in of)
    return F.expr(f"array_min(transform({centres}, c -> struct({d} AS d, c.idx AS idx))).idx")


def assign(pixel: DataFrame, palette: DataFrame) -> DataFrame:
    """Adds ``idx``: each pixel's nearest centre of its frame's palette."""
    return pixel.join(packed(palette), frame(palette)).withColumn("idx", nearest()).drop("centres")


def nearest_rows(x, centres):
    """The nearest centre of each row; the first of equals."""
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def _lloyd(x, weight, centres, steps: int):
    """Lloyd's steps; the first of equally near centres takes a row, a centre without rows stays."""
    import numpy as np

    for _ in range(steps):
        near = nearest_rows(x, centres)
        w = np.bincount(near, weight, len(centres))
        sums = np.stack([np.bincount(near, weight * x[:, c], len(centres)) for c in range(3)], axis=1)
        centres = np.where(w[:, None] > 0, sums / np.maximum(w, 1e-300)[:, None], centres)
    return centres


def spread(n: int, size: int) -> list[int]:
    """Places of ``size`` starts among n samples, the first and the last among them."""
    size = min(size, n)
    return [round(j * (n - 1) / max(1.0, size - 1.0)) for j in range(size)]


def frame_palette(x, size: int, seed=None):
    """A frame's palette from its samples (an array of b, g, r): eight steps, or three from the palette of the frame before."""
    if seed is not None and len(seed) == min(size, len(x)):
        return _lloyd(x, _ones(x), seed, 3)
    return _lloyd(x, _ones(x), x[spread(len(x), size)], 8)


def mean_palette(means, counts, size: int):
    """A palette over mean colours (an array of b, g, r) with weight sqrt(count) from 1 to 96, started evenly in order of luminance."""
    import numpy as np

    order = np.argsort(0.2126 * means[:, 2] + 0.7152 * means[:, 1] + 0.0722 * means[:, 0], kind="stable")
    x, w = means[order], np.clip(np.sqrt(counts[order].astype(float)), 1, 96)
    return _lloyd(x, w, x[spread(len(x), size)], 6)


def _ones(x):
    import numpy as np

    return np.ones(len(x))


def _by_frame(df: DataFrame, order: list[str], size: int, steps: int, weight: str | None) -> DataFrame:
    """k-means of each frame in one task, as a frame's samples are bounded by their stride: one shuffle for all steps."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(order)
        x = pdf[list(CHANNELS)].to_numpy(float)
        w = pdf[weight].to_numpy(float) if weight else np.ones(len(x))
        start = spread(len(x), size)
        out = pd.DataFrame(_lloyd(x, w, x[start], steps), columns=list(CHANNELS))
        return out.assign(**{c: pdf[c].iloc[0] for c in by}, idx=range(len(start)))[[*by, "idx", *CHANNELS]]

    by = frame(df)
    return df.groupBy(*by).applyInPandas(run, f"{'video string, ' * (len(by) - 1)}f int, idx int, b double, g double, r double")


def kmeans(sample: DataFrame, size: int, steps: int = 8) -> DataFrame:
    """A palette for each frame: centres started at evenly spaced samples in pixel order."""
    return _by_frame(sample.select(*frame(sample), "k", *CHANNELS), ["k"], size, steps, None)


def weighted_kmeans(means: DataFrame, size: int, steps: int = 6) -> DataFrame:
    """Over mean colours (f, id, n, b, g, r) with weight sqrt(n) from 1 to 96, started evenly in order of luminance."""
    weighed = means.withColumn("w", F.greatest(F.lit(1.0), F.least(F.lit(96.0), F.sqrt(F.col("n").cast("double"))))).withColumn("l", 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b"))
    return _by_frame(weighed.select(*frame(means), "id", "w", "l", *CHANNELS), ["l", "id"], size, steps, "w")


def label_stats(labelled: DataFrame) -> DataFrame:
    """(f, idx, n, b, g, r): counts and half-even mean colours."""
    return labelled.groupBy(*frame(labelled), "idx").agg(F.count("*").alias("n"), *[F.expr(f"int(bround(sum({c}) / count(*), 0))").alias(c) for c in CHANNELS])


def background(stats: DataFrame) -> DataFrame:
    """Each frame's largest label, or its largest label that isn't dark if those are 18% of the pixels and it has 3%."""
    seen = stats.withColumn("l", 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b"))
    pick = F.struct("n", (-F.col("idx")).alias("i"), *CHANNELS)
    light = F.col("l") >= 34
    found = seen.groupBy(*frame(stats)).agg(F.sum("n").alias("all"), F.max(pick).alias("top"), F.sum(F.when(light, F.col("n")).otherwise(0)).alias("lit"), F.max(F.when(light, pick)).alias("best"))
    use = (F.col("lit") >= 0.18 * F.col("all")) & (F.col("best.n") >= 0.03 * F.col("all"))
    chosen = F.when(use, F.col("best")).otherwise(F.col("top"))
    return found.select(*frame(stats), (-chosen["i"]).alias("idx"), chosen["n"].alias("n"), *[chosen[c].alias(c) for c in CHANNELS])


def region_fits(means: DataFrame, palette: DataFrame) -> DataFrame:
    """Nearest centre of each mean's rounded colour, and the squared distance of the mean as it is."""
    by = frame(means)
    rounded = means.select(*by, "id", *[F.col(c).alias(f"u{c}") for c in CHANNELS], *[F.bround(c, 0).alias(c) for c in CHANNELS])
    found = rounded.join(packed(palette), by).withColumn("idx", nearest())
    at = F.element_at("centres", F.expr("int(array_position(transform(centres, c -> c.idx), idx))"))
    d = sum(((F.col(f"u{c}") - at[c]) * (F.col(f"u{c}") - at[c]) for c in CHANNELS), F.lit(0.0))
    return found.select(*by, "id", "idx", d.alias("distance"))
