"""Image steps on one frame, as NumPy arrays: filters, morphology, edges, contours, polygons.

What the engine is measured against leaves these to an image library; here they
are written from their published definitions. Filters may differ from that
library in the last bit of a rounding, contours and fills along a border.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K


def _shifted(a: np.ndarray, dx: int, dy: int, mode: str, fill: int = 0) -> np.ndarray:
    """``a`` (height x width and maybe channels) seen from dx, dy further on; beyond the border it is mirrored or ``fill``."""
    h, w = a.shape[:2]
    if mode == "mirror":
        ys, xs = np.abs(np.arange(h) + dy), np.abs(np.arange(w) + dx)
        ys, xs = np.where(ys >= h, np.maximum(2 * (h - 1) - ys, 0), ys), np.where(xs >= w, np.maximum(2 * (w - 1) - xs, 0), xs)
        return a[ys][:, xs]
    out = np.full_like(a, fill)
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if y1 > y0 and x1 > x0:
        out[y0:y1, x0:x1] = a[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return out


def gaussian3(a: np.ndarray, sigma: float = 0.65) -> np.ndarray:
    """3 x 3 Gaussian blur of bytes, mirrored at the border."""
    side = np.exp(-1 / (2 * sigma * sigma))
    weight = {0: 1 / (1 + 2 * side), 1: side / (1 + 2 * side), -1: side / (1 + 2 * side)}
    x = a.astype(float)
    rows = sum(weight[d] * _shifted(x, d, 0, "mirror") for d in (-1, 0, 1))
    return np.clip(np.rint(sum(weight[d] * _shifted(rows, 0, d, "mirror") for d in (-1, 0, 1))), 0, 255).astype(np.uint8)


def bilateral(bgr: np.ndarray, quality: int) -> np.ndarray:
    """The smoothing before regions are sought: nearby pixels weigh by their distance in place and colour.

    The diameter and the spread follow the quality (fixed values).
    """
    size = 5 if quality >= 80 else 7 if quality >= 60 else 9
    sigma = 22.0 if quality >= 90 else 30.0 if quality >= 80 else 40.0 if quality >= 65 else 56.0
    x, r = bgr.astype(float), size // 2
    total, weight = np.zeros_like(x), np.zeros(x.shape[:2])
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dx * dx + dy * dy > r * r:
                continue
            other = _shifted(x, dx, dy, "mirror")
            far = np.abs(other - x).sum(axis=2)
            w = np.exp(-(far * far + dx * dx + dy * dy) / (2 * sigma * sigma))
            total += w[..., None] * other
            weight += w
    return np.clip(np.rint(total / weight[..., None]), 0, 255).astype(np.uint8)


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element."""
    r, out = size // 2, []
    for dy in range(-r, r + 1):
        half = round(r * np.sqrt((r * r - dy * dy) / (r * r))) if r else 0
        out += [(dx, dy) for dx in range(-int(half), int(half) + 1)]
    return out


SQUARE = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def erode(mask: np.ndarray, offsets) -> np.ndarray:
    return np.minimum.reduce([_shifted(mask, dx, dy, "fill", 255) for dx, dy in offsets])


def dilate(mask: np.ndarray, offsets) -> np.ndarray:
    return np.maximum.reduce([_shifted(mask, dx, dy, "fill", 0) for dx, dy in offsets])


def open_close_open(mask: np.ndarray) -> np.ndarray:
    for step in (erode, dilate, dilate, erode, erode, dilate):
        mask = step(mask, SQUARE)
    return mask


def clean_foreground(mask: np.ndarray, focus: int) -> np.ndarray:
    """Closing and dilation of a mask of motion by an ellipse that follows the focus (fixed values)."""
    kernel = ellipse(11 if focus >= 70 else 7 if focus >= 40 else 5)
    mask = erode(dilate(mask, kernel), kernel)
    for _ in range(2 if focus >= 70 else 1):
        mask = dilate(mask, kernel)
    return mask


def foreground(bgr: np.ndarray, before: np.ndarray | None, focus: int) -> np.ndarray | None:
    """Which pixels moved since the frame before, cleaned; None without focus or if too few or too many moved."""
    from .. import params as P

    if focus <= 0 or before is None or before.shape != bgr.shape:
        return None
    d = np.abs(bgr.astype(int) - before)
    t = P.motion_threshold(focus)
    mask = (d.max(axis=2) >= t) & (d.sum(axis=2) >= 2 * t)
    if not 0.0015 <= mask.mean() <= 0.7:
        return None
    return clean_foreground(mask.astype(np.uint8) * 255, focus)


def canny(bgr: np.ndarray, sensitivity: float, lightness: bool) -> np.ndarray:
    """Canny's edges of the grey values, or of the CIE lightness: Sobel, suppression along four directions, two thresholds."""
    low = max(1.0, sensitivity)
    high = max(low + 1, 2 * sensitivity)
    b, g, r = (bgr[..., c].astype(float) for c in range(3))
    if lightness:
        linear = lambda v: np.where(v / 255 > 0.04045, ((v / 255 + 0.055) / 1.055) ** 2.4, v / 255 / 12.92)
        y = 0.212671 * linear(r) + 0.715160 * linear(g) + 0.072169 * linear(b)
        gray = np.rint(np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y) * 255 / 100)
    else:
        gray = np.rint(0.114 * b + 0.587 * g + 0.299 * r)
    at = lambda dx, dy: _shifted(gray, dx, dy, "mirror")
    gx = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    gy = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    mag = np.abs(gx) + np.abs(gy)
    m = lambda dx, dy: _shifted(mag, dx, dy, "fill", 0)
    slope = np.abs(gy) / np.maximum(np.abs(gx), 1e-9)
    flat, steep = slope < np.tan(np.pi / 8), slope > np.tan(3 * np.pi / 8)
    rising = gx * gy < 0
    one = np.where(flat, m(-1, 0), np.where(steep, m(0, -1), np.where(rising, m(1, -1), m(-1, -1))))
    two = np.where(flat, m(1, 0), np.where(steep, m(0, 1), np.where(rising, m(-1, 1), m(1, 1))))
    kept = np.where((mag > one) & (mag >= two), mag, 0)
    h, w = kept.shape
    found = K.components((kept > low).astype(int).ravel(), w, h, K.NEAR8, blank=0)
    strong = np.zeros(h * w + 1, bool)
    strong[found[(kept > high).ravel()]] = True
    strong[-1] = False
    return (strong[found] & (found >= 0)).reshape(h, w).astype(np.uint8) * 255


#: Clockwise ways around a pixel, from the right (y runs down).
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def outer_contour(inside: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    """The border of the component whose first pixel in scan order is x, y: its border pixels in order, by Moore's tracing."""
    h, w = inside.shape
    is_in = lambda px, py: 0 <= px < w and 0 <= py < h and inside[py, px]
    ring, at, way, first = [(x, y)], (x, y), 0, None
    while True:
        for turn in range(8):
            d = (way + 6 + turn) % 8  # the ways are tried from the one that was left behind
            step = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if is_in(*step):
                break
        else:
            return ring
        if (at, step) == first:
            return ring[:-1] if len(ring) > 1 and ring[-1] == ring[0] else ring
        first = first or (at, step)
        at, way = step, d
        ring.append(at)


def straight(ring: list[tuple[int, int]], closed: bool = True) -> list[tuple[int, int]]:
    """A chain of pixels without those where its way doesn't turn."""
    n = len(ring)
    if n < 3:
        return list(ring)
    way = lambda a, b: (b[0] - a[0], b[1] - a[1])
    return [p for i, p in enumerate(ring) if (not closed and i in (0, n - 1)) or way(ring[i - 1], p) != way(p, ring[(i + 1) % n])]


def contours(mask: np.ndarray) -> list[tuple[list[tuple[int, int]], float]]:
    """The outer contour of each 8-connected component of a mask, in scan order, with the area that it encloses."""
    h, w = mask.shape
    label = K.components((mask > 0).astype(int).ravel(), w, h, K.NEAR8, blank=0).reshape(h, w)
    out = []
    for start in np.unique(label[label >= 0]).tolist():
        ring = straight(outer_contour(label == start, start % w, start // w))
        out.append((ring, abs(K.shoelace(ring))))
    return out


def fill_polygon(canvas: np.ndarray, points: list[tuple[int, int]], value) -> None:
    """Paints what lies within a polygon, or on its border, by even and odd crossings of each row."""
    h, w = canvas.shape[:2]
    pts = np.asarray(points, float)
    nxt = np.roll(pts, -1, axis=0)
    for y in range(max(0, int(pts[:, 1].min())), min(h - 1, int(pts[:, 1].max())) + 1):
        a, b = pts[:, 1], nxt[:, 1]
        hit = (np.minimum(a, b) <= y) & (y < np.maximum(a, b))
        xs = np.sort(pts[hit, 0] + (y - a[hit]) / (b[hit] - a[hit]) * (nxt[hit, 0] - pts[hit, 0]))
        for l, r in zip(xs[::2], xs[1::2]):
            canvas[y, max(0, int(np.ceil(l - 1e-9))) : min(w, int(np.floor(r + 1e-9)) + 1)] = value
    steps = np.maximum(np.abs(nxt - pts).max(axis=1), 1).astype(int)
    for p, q, n in zip(pts, nxt, steps):
        line = np.rint(p + (q - p) * np.linspace(0, 1, n + 1)[:, None]).astype(int)
        line = line[(line[:, 0] >= 0) & (line[:, 0] < w) & (line[:, 1] >= 0) & (line[:, 1] < h)]
        canvas[line[:, 1], line[:, 0]] = value
