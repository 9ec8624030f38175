"""From frames to regions: the tracers of one frame, and the job over videos.

Frames are independent but for the one before, which tells motion, so they are
traced in parallel; only the regions' ids are folded in order of frames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from . import images as I
from . import kernels as K
from .palette import frame_palette, nearest_rows

TRACERS = ("custom", "contours", "fast", "merged")
#: Knobs of the region encoder, as in ``params.DEFAULTS``, and the palette's size.
KNOBS = {k: P.DEFAULTS[k] for k in ("quality", "dark", "patch", "focus", "corrections")} | {"palette": 36, "tracer": "custom"}

REGION = "struct<id:int,b:int,g:int,r:int,points:array<struct<x:int,y:int>>,area:double,cx:double,cy:double,l:int,t:int,right:int,bottom:int,is_correction:boolean>"
FRAME_SCHEMA = f"video string, f int, back_b int, back_g int, back_r int, regions array<{REGION}>"


def luminance(color) -> float:
    b, g, r = color
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def mean_of(points) -> tuple[float, float]:
    return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)


def box_of(points) -> tuple[int, int, int, int]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs) + 1, max(ys) + 1


def region(color, points, area, center, box, correction=False) -> dict:
    return {"id": 0, "color": tuple(int(c) for c in color), "points": [(int(x), int(y)) for x, y in points], "area": float(area), "center": center, "box": tuple(int(v) for v in box), "correction": correction}


def speckle(r: dict, min_area: float, pixels: int, dark: int) -> bool:
    """Dark regions that are small and thin, long or ragged."""
    l, t, right, bottom = r["box"]
    w, h = right - l, bottom - t
    limit = min_area * P.dark_base_factor(dark)
    if luminance(r["color"]) >= P.dark_luminance(dark) or r["area"] >= max(limit, 0.004 * pixels):
        return False
    compact = r["area"] / max(1, w * h)
    small = r["area"] < limit and (min(w, h) <= 3 or max(w, h) / max(1, min(w, h)) >= 8 or compact < 0.18)
    return small or (compact < 0.1 and r["area"] < 1.7 * limit)


def noise(color, area: float, box, min_area: float, dark: int) -> bool:
    """Corrections that are thin, ragged, or small and dark."""
    w, h = box[2] - box[0], box[3] - box[1]
    return w <= 2 or h <= 2 or area / max(1, w * h) < 0.08 or (luminance(color) < P.dark_luminance(dark) and area < min_area * P.dark_residual_factor(dark))


def outlines(component, width: int, height: int, tolerance: float) -> dict[int, list]:
    """Each component's largest loop of pixel edges, without collinear vertices and simplified; those of under three vertices are left out."""
    k = np.arange(width * height)
    x, y = k % width, k // width
    grid = component.reshape(height, width)
    pad = np.pad(grid, 1, constant_values=-2)
    sides = [(pad[:-2, 1:-1], 0, 0, 1, 0), (pad[1:-1, 2:], 1, 0, 1, 1), (pad[2:, 1:-1], 1, 1, 0, 1), (pad[1:-1, :-2], 0, 1, 0, 0)]
    found = [np.stack([component[at], at, np.full(len(at), n), x[at] + a, y[at] + b, x[at] + c, y[at] + d], axis=1)
             for n, (other, a, b, c, d) in enumerate(sides) for at in [np.flatnonzero((other != grid).ravel() & (component >= 0))]]
    edges = np.concatenate(found)
    edges = edges[np.lexsort((edges[:, 2], edges[:, 1], edges[:, 0]))]
    out = {}
    for part in np.split(edges, np.flatnonzero(np.diff(edges[:, 0])) + 1):
        if len(part):
            ring = K.simplify_ring(K.without_collinear(K.largest_loop([tuple(e) for e in part[:, 3:].tolist()])), tolerance)
            if len(ring) >= 3:
                out[int(part[0, 0])] = ring
    return out


def by_components(component, colors, width: int, height: int, min_area: float, tolerance: float, middle: bool = False) -> list[dict]:
    """Regions of at least ``min_area`` pixels, in order of their first pixels; ``colors`` has a colour for each component."""
    known, at, counts = np.unique(component, return_inverse=True, return_counts=True)
    keep = np.where(counts[at] >= min_area, component, -1)
    x, y = np.arange(len(component)) % width, np.arange(len(component)) // width
    out = []
    for c, ring in outlines(keep, width, height, tolerance).items():
        mine = keep == c
        box = (x[mine].min(), y[mine].min(), x[mine].max() + 1, y[mine].max() + 1)
        center = ((box[0] + box[2] - 1) / 2, (box[1] + box[3] - 1) / 2) if middle else (float(x[mine].mean()), float(y[mine].mean()))
        out.append(region(colors(c, mine), ring, mine.sum(), center, box))
    return out


def by_contours(labels, colors, width: int, height: int, min_area: float, tolerance: float) -> list[dict]:
    """Regions of the outer contours of each label's mask."""
    out = []
    for label in np.unique(labels).tolist():
        for ring, area in I.contours((labels == label).reshape(height, width)):
            points = K.simplify_ring(ring, tolerance) if len(ring) > 3 else ring
            if area >= min_area and len(points) >= 3:
                out.append(region(colors[label], points, area, mean_of(points), box_of(points)))
    return out


def render(regions: list[dict], back, width: int, height: int) -> np.ndarray:
    """The regions' polygons painted in order over the background."""
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = back
    for r in regions:
        if len(r["points"]) >= 3:
            I.fill_polygon(canvas, r["points"], r["color"])
    return canvas


def patches(mask, color, min_area: float, tolerance: float, left: int = 0, top: int = 0) -> list[dict]:
    """Corrections of a mask's outer contours after opening, closing and opening."""
    out = []
    for ring, area in I.contours(I.open_close_open(mask.astype(np.uint8) * 255)):
        points = [(x + left, y + top) for x, y in (K.simplify_ring(ring, tolerance) if len(ring) > 3 else ring)]
        if area >= min_area and len(points) >= 3:
            out.append(region(color, points, area, mean_of(points), box_of(points), True))
    return out


def bin_colors(bins, bgr, count: int):
    n = np.bincount(bins, minlength=count)
    return n, np.rint(np.stack([np.bincount(bins, bgr[:, c], count) for c in range(3)], axis=1) / np.maximum(n, 1)[:, None]).astype(int)


def details(bgr, mask, back, base: list[dict], knobs: dict) -> list[dict]:
    """Small regions that the large ones miss: in each, the colour bins of the largest weighed error, traced."""
    height, width = bgr.shape[:2]
    q, d, focus = knobs["quality"], knobs["patch"], knobs["focus"]
    if d <= 0 or not base:
        return []
    min_area, bound = P.min_region_area(q, width, height), P.detail_min_bounds(q, d)
    fits = lambda r: not r["correction"] and len(r["points"]) >= 3 and r["area"] >= P.detail_source_area(min_area, width, height, d) and r["box"][2] - r["box"][0] >= bound and r["box"][3] - r["box"][1] >= bound
    sources = sorted(filter(fits, base), key=lambda r: -source_score(r, mask, focus))[: P.max_detail_sources(d)]
    if not sources:
        return []
    predicted, found = render(base, back, width, height), []
    limit = P.detail_threshold(q, d)
    for r in sources:
        l, t, right, bottom = max(0, r["box"][0]), max(0, r["box"][1]), min(width, r["box"][2]), min(height, r["box"][3])
        if right - l <= 2 or bottom - t <= 2:
            continue
        inside = np.zeros((bottom - t, right - l), np.uint8)
        I.fill_polygon(inside, [(x - l, y - t) for x, y in r["points"]], 1)
        own, guess = bgr[t:bottom, l:right].astype(float), predicted[t:bottom, l:right].astype(float)
        error = np.sqrt(((own - guess) ** 2).sum(axis=2))
        mine = (inside > 0) & (np.sqrt(((guess - np.array(r["color"], float)) ** 2).sum(axis=2)) <= P.detail_owner(q, d))
        weighed = error
        if mask is not None and focus > 0:
            moved = mask[t:bottom, l:right] > 0
            mine &= error >= limit * np.where(moved, P.clamp(1 - 0.0045 * focus, 0.55, 1.0), P.clamp(1 + 0.009 * focus, 1.0, 1.9))
            weighed = error * np.where(moved, 1 + focus / 32, P.clamp(1 - focus / 150, 0.35, 1.0))
        else:
            mine &= error >= limit
        if not mine.any():
            continue
        pixels = own[mine].astype(int)
        bins = (pixels[:, 2] >> 4) * 256 + (pixels[:, 1] >> 4) * 16 + (pixels[:, 0] >> 4)
        n, colors = bin_colors(bins, pixels, 4096)
        score = np.bincount(bins, weighed[mine], 4096)
        chosen = [b for b in np.argsort(-score, kind="stable").tolist() if n[b] >= P.detail_bin_pixels(P.detail_area(min_area, d), d) and n[b]][: P.max_detail_bins(d)]
        place = np.full(mine.shape, -1)
        place[mine] = bins
        for b in chosen:
            for p in patches(place == b, colors[b], P.detail_area(min_area, d), P.detail_simplify(P.simplify_tolerance(q), d), l, t):
                if p["box"][2] - p["box"][0] > 2 and p["box"][3] - p["box"][1] > 2:
                    found.append((p["area"] * score[b] / n[b], p))
    return [p for _, p in sorted(found, key=lambda x: -x[0])[: P.max_detail_regions(q, d)]]


def source_score(r: dict, mask, focus: int) -> float:
    """A region's area, the more of it moves the larger."""
    if mask is None or focus <= 0:
        return r["area"]
    l, t, right, bottom = r["box"]
    step = max(4, min(right - l, bottom - t) // 12)
    return r["area"] * (1 + (mask[t:bottom:step, l:right:step] > 0).mean() * focus / 18)


def corrections(bgr, back, base: list[dict], knobs: dict) -> list[dict]:
    """Regions over what the others paint wrongly: the most frequent colour bins of the pixels in error, traced."""
    height, width = bgr.shape[:2]
    q, c = knobs["quality"], knobs["corrections"]
    d = np.abs(bgr.astype(int) - render(base, back, width, height))
    t = P.error_threshold(q, c)
    wrong = (d.max(axis=2) >= t) | (d.sum(axis=2) >= 2 * t)
    pixels = bgr[wrong].astype(int)
    bins = (pixels[:, 2] >> 5) * 64 + (pixels[:, 1] >> 5) * 8 + (pixels[:, 0] >> 5)
    n, colors = bin_colors(bins, pixels, 512)
    min_area = P.error_area(P.min_region_area(q, width, height), c)
    chosen = [b for b in np.argsort(-n, kind="stable").tolist() if n[b] >= P.error_bin_pixels(min_area)][: P.max_error_bins(q, c)]
    place = np.full(wrong.shape, -1)
    place[wrong] = bins
    found = [p for b in chosen for p in patches(place == b, colors[b], min_area, P.error_simplify(P.simplify_tolerance(q))) if not noise(p["color"], p["area"], p["box"], min_area, knobs["dark"])]
    return sorted(found, key=lambda p: -p["area"])[: P.max_error_regions(q, c)]


def background(colors, counts):
    """The largest label's colour, or the largest light one's if light ones have 18% of the pixels and it 3%."""
    light = np.array([luminance(c) >= 34 for c in colors])
    best = int(np.argmax(counts))
    lit = np.where(light, counts, 0)
    if lit.sum() >= 0.18 * counts.sum() and lit.max() >= 0.03 * counts.sum():
        best = int(np.argmax(lit))
    return tuple(int(v) for v in colors[best])


def trace(bgr: np.ndarray, before: np.ndarray | None, knobs: dict, seed=None) -> tuple[tuple, list[dict], np.ndarray]:
    """A frame's background, its regions with details and corrections, and its palette, which may seed the next frame's."""
    height, width = bgr.shape[:2]
    q = knobs["quality"]
    soft = I.bilateral(bgr, q)
    if knobs["tracer"] == "fast":
        step = P.color_step(q)
        soft = np.minimum(255, (I.gaussian3(soft).astype(int) + step // 2) // step * step).astype(np.uint8)
    stride = P.sample_stride(width, height)
    palette = frame_palette(soft[::stride, ::stride].reshape(-1, 3).astype(float), knobs["palette"], seed)
    flat = soft.reshape(-1, 3).astype(int)
    labels = np.concatenate([nearest_rows(flat[i : i + 65536].astype(float), palette) for i in range(0, len(flat), 65536)])
    counts, colors = bin_colors(labels, flat, len(palette))
    back = background(colors, counts)
    min_area, tolerance = P.min_region_area(q, width, height), P.simplify_tolerance(q)
    if knobs["tracer"] in ("contours", "fast"):
        found = by_contours(labels, colors, width, height, min_area, tolerance)
    elif knobs["tracer"] == "merged":
        component = K.merged_regions(bgr.reshape(-1, 3), I.gaussian3(bgr).reshape(-1, 3), width, height, q, knobs["palette"], min_area)
        own = bgr.reshape(-1, 3)
        found = by_components(component, lambda c, mine: np.rint(own[mine].mean(axis=0)), width, height, P.merged_region_area(min_area), tolerance, middle=True)
    else:
        found = by_components(K.components(labels, width, height), lambda c, mine: colors[labels[c]], width, height, min_area, tolerance)
    if knobs["dark"] > 0:
        found = [r for r in found if not speckle(r, min_area, width * height, knobs["dark"])]
    found = sorted(found, key=lambda r: -r["area"])
    found += details(bgr, I.foreground(bgr, before, knobs["focus"]), back, found, knobs)
    if knobs["corrections"] > 0:
        found += corrections(bgr, back, found, knobs)
    return back, found, palette


def as_tuple(r: dict) -> tuple:
    return (r["id"], *r["color"], [{"x": x, "y": y} for x, y in r["points"]], r["area"], *map(float, r["center"]), *r["box"], r["correction"])


def regions(frames: DataFrame, width: int, height: int, knobs: dict | None = None) -> DataFrame:
    """FRAME_SCHEMA of frames (video, f, bgr): a row a frame, its regions in order of painting, ids 0.

    Frames are told apart by (video, f); each is joined to the one before. A
    frame without regions keeps its row.
    """
    knobs = KNOBS | (knobs or {})
    before = frames.select("video", (F.col("f") + 1).alias("f"), F.col("bgr").alias("before"))
    names = REGION.removeprefix("struct<").split(",")
    keys = [n.split(":")[0] for n in names if ":" in n and not n.startswith(("points", "y:"))]
    keys.insert(4, "points")

    def run(batches):
        import pandas as pd

        image = lambda data: np.frombuffer(data, np.uint8).reshape(height, width, 3)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                back, found, _ = trace(image(r.bgr), None if r.before is None else image(r.before), knobs)
                out.append((r.video, r.f, *back, [dict(zip(keys, as_tuple(x))) for x in found]))
            yield pd.DataFrame(out, columns=["video", "f", "back_b", "back_g", "back_r", "regions"])

    both = frames.select("video", "f", "bgr").join(before, ["video", "f"], "left").select("video", F.col("f").cast("int").alias("f"), "bgr", "before")
    return both.mapInPandas(run, FRAME_SCHEMA)


def with_ids(traced: DataFrame, width: int, height: int) -> DataFrame:
    """FRAME_SCHEMA with the regions' ids; corrections keep 0. Regions without their points are folded, in order of frames, a video to a group."""
    from .frames import track_regions

    each = traced.select("video", "f", F.posexplode("regions").alias("z", "s")).where("NOT s.is_correction")
    slim = each.select("video", "f", "z", "s.area", "s.cx", "s.cy", "s.l", "s.t", F.col("s.right").alias("r"), F.col("s.bottom").alias("b"), F.col("s.b").alias("mean_b"), F.col("s.g").alias("mean_g"), F.col("s.r").alias("mean_r"))
    ids = track_regions(slim, width, height).groupBy("video", "f").agg(F.map_from_entries(F.collect_list(F.struct("z", "id"))).alias("_ids"))  # a frame's regions bound the map
    named = F.transform("regions", lambda s, i: s.withField("id", F.coalesce(F.try_element_at(F.col("_ids"), i), F.lit(0))))
    return traced.join(ids, ["video", "f"], "left").withColumn("regions", named).select(*traced.columns)


def edges(frames: DataFrame, width: int, height: int, sensitivity: float = 60.0, lightness: bool = True, tolerance: float = 0.0) -> DataFrame:
    """(video, f, paths) of frames (video, f, bgr): the contours of each frame's Canny edges, as open polylines."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                mask = I.canny(np.frombuffer(r.bgr, np.uint8).reshape(height, width, 3), sensitivity, lightness)
                paths = [K.simplify(ring, tolerance) if tolerance > 0 and len(ring) > 2 else ring for ring, _ in I.contours(mask)]
                out.append((r.video, r.f, [[{"x": int(x), "y": int(y)} for x, y in p] for p in paths if p]))
            yield pd.DataFrame(out, columns=["video", "f", "paths"])

    return frames.select("video", F.col("f").cast("int").alias("f"), "bgr").mapInPandas(run, "video string, f int, paths array<array<struct<x:int,y:int>>>")
