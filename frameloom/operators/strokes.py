"""Strokes of a frame and their ids from frame to frame.

The pixel steps before them (luminance, blur, gradient, thinning, threshold,
bridging) are DataFrame stencils; what depends on an order within a frame or
from frame to frame runs here, a frame or a video to a group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from . import kernels as K

POINTS = "array<struct<x:int,y:int>>"
FIELDS = f"points {POINTS}, b int, g int, r int, intensity int, width int, glow int, opacity int, length double, cx double, cy double, l int, t int, right int, bottom int, misses int"
STROKE_SCHEMA = f"video string, f int, z int, id int, {FIELDS}"


def path_length(points) -> float:
    return sum(math.dist(a, b) for a, b in zip(points, points[1:]))


def geometry(points) -> dict:
    """What follows from a stroke's points: length, middle and half-open box."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return {"length": path_length(points), "center": (sum(xs) / len(xs), sum(ys) / len(ys)), "box": (min(xs), min(ys), max(xs) + 1, max(ys) + 1)}


def attributes(points, bgr, magnitude, knobs: dict) -> dict:
    """Colour, intensity, width, glow and opacity from up to about 96 samples along the points."""
    taken = points[:: max(1, len(points) // 96)]
    color = tuple(sum(int(bgr[y, x, c]) for x, y in taken) // len(taken) for c in range(3))
    mean = sum(int(magnitude[y, x]) for x, y in taken) / len(taken)
    intensity = P.clamp(round(1.2 * mean + 0.35 * knobs["quality"]), 32, 255)
    return {
        "color": color, "intensity": intensity, "width": P.clamp(round(4 * (1.05 + 0.012 * knobs["quality"] + 0.004 * knobs["density"])), 4, 18),
        "glow": P.clamp(round(1 + 0.16 * knobs["glow"] + 0.025 * intensity), 0, 32), "opacity": P.clamp(120 + intensity // 2 + knobs["glow"] // 3, 120, 255)}


def priority(s: dict) -> float:
    return s["length"] * (0.6 + s["intensity"] / 255) * (s["opacity"] / 255)


def resampled(points, n: int):
    """At most n points at even places from the first to the last, without repeats in a row."""
    if n >= len(points):
        return list(points)
    picked = [points[round(i * (len(points) - 1) / (n - 1))] for i in range(n)] if n > 2 else []
    out = [p for i, p in enumerate(picked) if i in (0, n - 1) or p != picked[i - 1]]
    return [*out[:-1], points[-1]] if len(out) >= 2 else [points[0], points[-1]]


def within_budget(strokes: list[dict], most: int, cap: int) -> list[dict]:
    """Strokes in order with their points cut to ``cap`` each and to what is left of ``most``; under two left, the rest is left out."""
    kept, used = [], 0
    for s in strokes:
        if most - used < 2:
            break
        target = min(cap, len(s["points"]), most - used)
        if len(s["points"]) > target:
            points = resampled(s["points"], target)
            s = s | {"points": points} | geometry(points)
        used += len(s["points"])
        kept.append(s)
    return kept


def frame_strokes(edge, magnitude, bgr, knobs: dict) -> list[dict]:
    """A frame's strokes from its edge mask: walks through 8-connected components, simplified, the best by priority, in order of place."""
    import numpy as np

    height, width = edge.shape
    label = K.components((edge > 0).astype(int).ravel(), width, height, K.NEAR8, blank=0)
    least = P.stroke_min_pixels(knobs["quality"], knobs["density"], width, height)
    shortest, tolerance = max(4, least // 2), P.stroke_simplify(knobs["quality"], knobs["density"])
    least_length = P.stroke_min_length(knobs["quality"], knobs["density"], width, height)
    found = []
    for start in np.unique(label[label >= 0]).tolist():
        pixels = K.visiting_order(label, start, width, height)
        if len(pixels) < least:
            continue
        for walk in K.chains(pixels, width, shortest):
            if len(walk) < shortest:
                continue
            points = K.simplify([(k % width, k // width) for k in walk], tolerance)
            if path_length(points) >= least_length:
                found.append({"id": 0, "points": points, "misses": 0} | attributes(points, bgr, magnitude, knobs) | geometry(points))
    best = sorted(found, key=lambda s: -priority(s))[: P.max_strokes(knobs["density"], width, height)]
    kept = within_budget(best, P.max_stroke_points(knobs["density"], width, height), P.points_per_stroke(knobs["quality"], knobs["density"]))
    return sorted(kept, key=lambda s: (s["box"][1], s["box"][0]))


def match_score(a: dict, b: dict, diagonal: float) -> float:
    """Middle, ends, colour, overlap and length of two strokes, weighed; 0 for equal ones."""
    p, q = a["points"], b["points"]
    ends = min(math.dist(p[0], q[0]) + math.dist(p[-1], q[-1]), math.dist(p[0], q[-1]) + math.dist(p[-1], q[0])) / 2
    size = P.clamp(abs(math.log((a["length"] + 1) / (b["length"] + 1))) / 2.2, 0.0, 1.0)
    return 0.30 * math.dist(a["center"], b["center"]) / diagonal + 0.25 * ends / diagonal + 0.20 * math.dist(a["color"], b["color"]) / 441.67295593 + 0.15 * (1 - K.iou(a["box"], b["box"])) + 0.10 * size


def blend(old, new, weight: float) -> int:
    return P.clamp(round(old * (1.0 - weight) + new * weight), 0, 255)


def smoothed(now: dict, before: dict) -> dict:
    """A matched stroke drawn towards the one before; points only if they are as many."""
    out = now | {"color": tuple(blend(a, b, 0.70) for a, b in zip(before["color"], now["color"]))}
    out |= {k: blend(before[k], now[k], w) for k, w in (("intensity", 0.70), ("width", 0.72), ("glow", 0.70), ("opacity", 0.78))}
    if len(now["points"]) == len(before["points"]):
        points = [(round(0.28 * a[0] + 0.72 * b[0]), round(0.28 * a[1] + 0.72 * b[1])) for a, b in zip(before["points"], now["points"])]
        out |= {"points": points} | geometry(points)
    return out


def track(strokes: list[dict], previous: list[dict], next_id: int, width: int, height: int, density: int) -> tuple[list[dict], int]:
    """Ids for a frame's strokes, and ghosts of those of the frame before that are gone.

    By priority, a stroke takes the best unused one before (score up to 0.22)
    and is smoothed towards it, else a new id. Unmatched ones that were missed
    at most once stay as ghosts, the longest first and fainter each time.
    """
    diagonal, used, named = max(1.0, math.hypot(width, height)), set(), list(strokes)
    for i in sorted(range(len(strokes)), key=lambda i: -priority(strokes[i])):
        scored = [(match_score(strokes[i], p, diagonal), n) for n, p in enumerate(previous) if p["id"] not in used]
        best = min(scored, default=(1.0, -1))
        if best[0] <= 0.22:
            before = previous[best[1]]
            named[i] = smoothed(strokes[i], before) | {"id": before["id"]}
            used.add(before["id"])
        else:
            named[i], next_id = strokes[i] | {"id": next_id}, next_id + 1
    gone = sorted((p for p in previous if p["id"] not in used and p["misses"] < 2), key=lambda p: -p["length"])[: P.clamp(density, 12, 80)]
    ghosts = [p | {"opacity": max(24, p["opacity"] * (55 if p["misses"] == 0 else 35) // 100), "misses": p["misses"] + 1} for p in gone]
    return named + ghosts, next_id


def row(s: dict) -> tuple:
    return ([{"x": x, "y": y} for x, y in s["points"]], *s["color"], s["intensity"], s["width"], s["glow"], s["opacity"], s["length"], *s["center"], *s["box"], s["misses"])


def unrow(r) -> dict:
    """The stroke of a row of STROKE_SCHEMA's fields."""
    points = [(p["x"], p["y"]) for p in r["points"]]
    return {"points": points, "color": (r["b"], r["g"], r["r"]), "intensity": r["intensity"], "width": r["width"], "glow": r["glow"], "opacity": r["opacity"], "length": r["length"],
            "center": (r["cx"], r["cy"]), "box": (r["l"], r["t"], r["right"], r["bottom"]), "misses": r["misses"]}


def build(pixels: DataFrame, width: int, height: int, knobs: dict) -> DataFrame:
    """Strokes of each frame, without ids: ``pixels`` is (video, f, k, b, g, r, mag, edge), each frame whole; a frame is a group."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        shape = (height, width)
        found = frame_strokes(pdf["edge"].to_numpy().reshape(shape), pdf["mag"].to_numpy().reshape(shape), pdf[["b", "g", "r"]].to_numpy().reshape(*shape, 3), knobs)
        rows = [(pdf["video"].iloc[0], int(pdf["f"].iloc[0]), z, 0, *row(s)) for z, s in enumerate(found)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STROKE_SCHEMA.replace(POINTS, "p").split(", ")])

    return pixels.select("video", "f", "k", "b", "g", "r", "mag", "edge").groupBy("video", "f").applyInPandas(run, STROKE_SCHEMA)


def tracked(strokes: DataFrame, width: int, height: int, density: int) -> DataFrame:
    """Ids, smoothing and ghosts: a video is folded in order of its frames, of which one is held at a time beside its strokes' rows.

    ``strokes`` is STROKE_SCHEMA as ``build`` returns it. Frames without strokes have no row, yet age the ghosts.
    """

    def run(pdf):
        import pandas as pd

        out, previous, next_id = [], [], 1
        by_frame = dict(list(pdf.sort_values(["f", "z"]).groupby("f", sort=True)))
        for f in range(int(pdf["f"].min()), int(pdf["f"].max()) + 1):
            now = [unrow(r) for r in by_frame[f].to_dict("records")] if f in by_frame else []
            previous, next_id = track(now, previous, next_id, width, height, density)
            out += [(pdf["video"].iloc[0], f, z, s["id"], *row(s)) for z, s in enumerate(previous)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in STROKE_SCHEMA.replace(POINTS, "p").split(", ")])

    return strokes.groupBy("video").applyInPandas(run, STROKE_SCHEMA)


def as_rows(hatches: DataFrame, video: str = "video") -> DataFrame:
    """Hatches of ``surface.hatches`` with their video as rows of STROKE_SCHEMA, id 0."""
    points = F.expr("array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y1 AS y))")
    return hatches.select(
        video, "f", F.col("z").cast("int").alias("z"), F.lit(0).alias("id"), points.alias("points"), "b", "g", "r", "intensity", "width", "glow", "opacity",
        F.expr("sqrt(double((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))").alias("length"), F.expr("(x0 + x1) / 2D").alias("cx"), F.expr("(y0 + y1) / 2D").alias("cy"),
        F.expr("least(x0, x1)").alias("l"), F.expr("least(y0, y1)").alias("t"), F.expr("greatest(x0, x1) + 1").alias("right"), F.expr("greatest(y0, y1) + 1").alias("bottom"), F.lit(0).alias("misses"))
