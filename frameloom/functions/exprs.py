"""Scalar operators over colours, boxes, points and primitives, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def half_even(v: Column) -> Column:
    return F.bround(v, 0)


def clamp(v: Column, lo, hi) -> Column:
    return F.least(_c(hi), F.greatest(_c(lo), _c(v)))


def clamp_byte(v: Column) -> Column:
    return clamp(v, 0, 255)


def luminance(r="r", g="g", b="b") -> Column:
    return 0.2126 * _c(r) + 0.7152 * _c(g) + 0.0722 * _c(b)


def luma(r="r", g="g", b="b") -> Column:
    """Fixed-point luminance; its weights differ from those of :func:`luminance`."""
    return F.shiftright(54 * _c(r) + 183 * _c(g) + 19 * _c(b), 8)


def color_bin(bits: int, r="r", g="g", b="b") -> Column:
    """The leading bits of each channel as one number, red first."""
    top = [F.shiftright(_c(v), 8 - bits) for v in (r, g, b)]
    return F.shiftleft(top[0], 2 * bits) + F.shiftleft(top[1], bits) + top[2]


def snap(v, step: int) -> Column:
    """The nearest multiple of step, at most 255."""
    return _c(v) if step <= 1 else F.least(F.lit(255), F.expr(f"(({v} + {step // 2}) div {step}) * {step}"))


def distance_squared(a: list, b: list) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b):
        total = total + (_c(x) - _c(y)) * (_c(x) - _c(y))
    return total


def distance(a: list, b: list) -> Column:
    return F.sqrt(distance_squared(a, b).cast("double"))


def effective_threshold(t, foreground: Column, focus: float, has_mask: bool = True) -> Column:
    """A detail threshold lowered in the foreground and raised behind it."""
    if not has_mask or focus <= 0:
        return _c(t)
    return _c(t) * F.when(foreground, max(0.55, min(1.0, 1 - 0.0045 * focus))).otherwise(max(1.0, min(1.9, 1 + 0.009 * focus)))


def weighted_error(e, foreground: Column, focus: float, has_mask: bool = True) -> Column:
    if not has_mask or focus <= 0:
        return _c(e)
    return _c(e) * F.when(foreground, 1 + focus / 32).otherwise(max(0.35, min(1.0, 1 - focus / 150)))


def dark_speckle(luma_: Column, area: Column, w: Column, h: Column, dark: float, limit: float, frame_pixels: int) -> Column:
    """Dark regions that are small and thin, long or ragged."""
    thin, long_ = F.least(w, h), F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h))
    compact = area / F.greatest(F.lit(1), w * h)
    small = (area < limit) & ((thin <= 3) | (long_ >= 8) | (compact < 0.18))
    ragged = (compact < 0.1) & (area < 1.7 * limit)
    return (luma_ < 12 + 0.45 * dark) & ~(area >= F.greatest(F.lit(float(limit)), F.lit(0.004 * frame_pixels))) & (small | ragged)


def residual_noise(luma_: Column, area: Column, w: Column, h: Column, dark: float, min_area: float) -> Column:
    compact = area / F.greatest(F.lit(1), w * h)
    return (w <= 2) | (h <= 2) | (compact < 0.08) | ((luma_ < 12 + 0.45 * dark) & (area < min_area * (1.8 + 0.08 * dark)))


def intersection_over_union(a: list, b: list) -> Column:
    """Of two half-open boxes (l, t, r, b); 0 if either is empty or they don't meet."""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when((w * h > 0) & (union > 0), w * h / union).otherwise(F.lit(0.0))


def vertex_mean(points="points") -> Column:
    n = F.size(points)
    s = lambda k: F.aggregate(F.transform(points, lambda p: p[k].cast("double")), F.lit(0.0), lambda a, v: a + v)
    return F.struct((s("x") / n).alias("x"), (s("y") / n).alias("y"))


def bounds(points="points") -> Column:
    """The half-open bounding box of integer points."""
    at = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.struct(at(F.array_min, "x").alias("l"), at(F.array_min, "y").alias("t"), (at(F.array_max, "x") + 1).alias("r"), (at(F.array_max, "y") + 1).alias("b"))


def ring_area(points: str = "points") -> Column:
    """Signed shoelace area; 0 for fewer than three points."""
    return F.expr(
        f"CASE WHEN size({points}) < 3 THEN 0D ELSE aggregate(transform({points}, (p, i) -> "
        f"bigint(p.x) * {points}[(i + 1) % size({points})].y - bigint({points}[(i + 1) % size({points})].x) * p.y), 0L, (a, v) -> a + v) / 2D END")


def path_length(points: str = "points") -> Column:
    return F.expr(
        f"aggregate(transform(slice({points}, 2, size({points})), (p, i) -> sqrt(double((p.x - {points}[i].x) * (p.x - {points}[i].x) + (p.y - {points}[i].y) * (p.y - {points}[i].y)))), 0D, (a, v) -> a + v)")


def endpoint_distance(a: str, b: str) -> Column:
    """Mean distance of two paths' ends, in the better direction."""
    d = lambda p, q: f"sqrt(pow({p}.x - {q}.x, 2) + pow({p}.y - {q}.y, 2))"
    a0, a1, b0, b1 = f"element_at({a}, 1)", f"element_at({a}, -1)", f"element_at({b}, 1)", f"element_at({b}, -1)"
    return F.expr(f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN double('Infinity') ELSE least({d(a0, b0)} + {d(a1, b1)}, {d(a0, b1)} + {d(a1, b0)}) / 2 END")


def segment_distance_squared(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = (_c(v).cast("double") for v in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, clamp(((px - ax) * dx + (py - ay) * dy) / n, 0.0, 1.0)).otherwise(F.lit(0.0))
    return (px - ax - t * dx) * (px - ax - t * dx) + (py - ay - t * dy) * (py - ay - t * dy)


def blend_byte(old, new, weight) -> Column:
    """``weight`` of the new value and the rest of the old one."""
    return clamp_byte(half_even(_c(old) * (1.0 - _c(weight)) + _c(new) * _c(weight)))


def bilinear(c00, c10, c01, c11, tx, ty) -> Column:
    top = _c(c00) + (_c(c10) - _c(c00)) * _c(tx)
    low = _c(c01) + (_c(c11) - _c(c01)) * _c(tx)
    return clamp_byte(half_even(top + (low - top) * _c(ty)))


def glow_boost(v, intensity) -> Column:
    return clamp_byte(half_even(_c(v) * (1.08 + 0.28 * _c(intensity) / 255)))


def stroke_priority(length, intensity, opacity) -> Column:
    return _c(length) * (0.6 + _c(intensity) / 255) * (_c(opacity) / 255)


def region_match_score(center_distance, diagonal, color_distance, area, other_area, iou) -> Column:
    size = clamp(F.abs(F.log((_c(area) + 1) / (_c(other_area) + 1))) / 2, 0.0, 1.0)
    return 0.35 * _c(center_distance) / diagonal + 0.35 * _c(color_distance) / 441.67295593 + 0.15 * size + 0.15 * (1 - _c(iou))


def stroke_match_score(center_distance, ends, diagonal, color_distance, iou, length, other_length) -> Column:
    size = clamp(F.abs(F.log((_c(length) + 1) / (_c(other_length) + 1))) / 2.2, 0.0, 1.0)
    return 0.30 * _c(center_distance) / diagonal + 0.25 * _c(ends) / diagonal + 0.20 * _c(color_distance) / 441.67295593 + 0.15 * (1 - _c(iou)) + 0.10 * size


def belongs(predicted: list, fill: list, threshold) -> Column:
    """Whether a predicted colour is a region's own."""
    return distance(predicted, fill) <= _c(threshold)


def hex_color(r="r", g="g", b="b") -> Column:
    return F.format_string("%02X%02X%02X", _c(r).cast("int"), _c(g).cast("int"), _c(b).cast("int"))


def number_text(v) -> Column:
    """At most three decimals, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.3f", F.round(_c(v), 3)), r"\.?0+$", "")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./\\]+)$", 1))


# The extensions of the formats.
def is_packed_path(path) -> Column:
    return extension(path).isin("lvfz", "lvfb", "lvfbz")


def is_binary_path(path) -> Column:
    return extension(path).isin("lvfb", "lvfbz")


def is_stroke_path(path) -> Column:
    return extension(path).isin("lvfs", "lvfsz")


def varint_hex(v: str) -> Column:
    """Unsigned LEB128 of a number below 2^63, as hexadecimal digits; null of null."""
    n = f"bigint({v})"
    groups = f"CASE {' '.join(f'WHEN {n} < {1 << 7 * g}L THEN {g}' for g in range(1, 9))} ELSE 9 END"
    return F.expr(f"IF({n} IS NULL, NULL, lower(array_join(transform(sequence(0, {groups} - 1), i -> lpad(hex((shiftright({n}, 7 * i) & 127) + IF(i + 1 < {groups}, 128, 0)), 2, '0')), '')))")


def varint_value(h: str) -> Column:
    return F.expr(f"aggregate(sequence(0, length({h}) div 2 - 1), 0L, (a, i) -> a + shiftleft(bigint(conv(substring({h}, 2 * i + 1, 2), 16, 10)) & 127, 7 * i))")
