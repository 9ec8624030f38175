"""Semantic constants as functions of the quality knobs: of numbers, or of columns where a table holds the knobs.

q quality, c corrections, p palette, d patch detail, o object focus, s surface
detail, n stroke density, r residual, all 0 to 100; w and h in pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(*v) -> bool:
    return any(isinstance(x, Column) for x in v)


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def low(*v):
    """The least of numbers, or of columns among them."""
    return F.least(*map(_lit, v)) if _any(*v) else min(v)


def high(*v):
    return F.greatest(*map(_lit, v)) if _any(*v) else max(v)


def clamp(v, lo, hi):
    return low(hi, high(lo, v))


def half_even(v):
    return F.rint(v) if _any(v) else round(v)


def div(a, b):
    """Division of whole numbers towards zero."""
    if _any(a, b):
        return F.floor(F.abs(_lit(a)) / _lit(b)) * F.signum(_lit(a).cast("double"))
    return int(a / b)


def root(v):
    return F.sqrt(_lit(v)) if _any(v) else math.sqrt(v)


def pick(test, yes, no):
    return F.when(test, _lit(yes)).otherwise(_lit(no)) if _any(test) else (yes if test else no)


def _rounded(base, slope, lo, hi):
    return lambda q: clamp(half_even(base + slope * (100 - q)), lo, hi)


# The coefficients and bounds below.
palette_size = lambda q: clamp(half_even(8 + 0.34 * q), 8, 48)
min_region_area = lambda q, w, h: high(4.0, w * h * (0.00005 + (100 - q) * 0.000035))
merged_region_area = lambda min_area: high(36.0, 0.08 * min_area)
simplify_tolerance = lambda q: high(0.65, (101 - q) / 15)
neighbor_merge = _rounded(4, 0.08, 4, 9)
blurred_boundary = _rounded(13, 0.14, 12, 22)
blurred_region = _rounded(8, 0.1, 8, 16)
color_step = _rounded(6, 0.08, 6, 12)
palette_fit = lambda q, p: clamp(half_even(20 + 0.18 * (100 - q) + 0.04 * high(0, p - 36)), 20, 34)
guided_region = lambda q, p: clamp(half_even(15 + 0.16 * (100 - q) + 0.035 * high(0, p - 36)), 15, 26)
guided_large_region = _rounded(7, 0.08, 7, 12)
guided_boundary = lambda q, p: clamp(half_even(14 + 0.13 * (100 - q) + 0.03 * high(0, p - 36)), 14, 24)
absorb_limit = lambda min_area: clamp(half_even(0.55 * min_area), 128, 1200)


def error_threshold(q, c=100):
    base = clamp(half_even(72 - 0.42 * q), 24, 58)
    return clamp(base + half_even(0.28 * (100 - c)), base, 76)


error_area = lambda min_area, c=100: high(3.0, 0.45 * min_area * clamp(1 + 0.025 * (100 - c), 1.0, 3.5))
error_simplify = lambda simplify: high(0.45, 0.75 * simplify)
max_error_regions = lambda q, c=100: high(0, half_even(clamp(3 * q - 150, 36, 180) * c / 100))
max_error_bins = lambda q, c=100: high(1, half_even(clamp(div(q - 34, 4), 6, 18) * clamp(c / 100, 0.15, 1.0)))
error_bin_pixels = lambda area: high(8, half_even(0.7 * area))
detail_min_bounds = lambda q, d: clamp(half_even(48 - 0.18 * q - 0.15 * d), 16, 42)
detail_threshold = lambda q, d: clamp(42 - 0.16 * q - 0.18 * d, 12.0, 34.0)
detail_owner = lambda q, d: clamp(8 + 0.04 * (100 - q) + 0.03 * d, 8.0, 14.0)
detail_source_area = lambda min_area, w, h, d: high(min_area * clamp(12 - 0.06 * d, 5.0, 12.0), w * h * clamp(0.003 - 0.000015 * d, 0.0012, 0.003))
detail_bin_pixels = lambda area, d: high(14, half_even(area * clamp(0.12 - 0.0007 * d, 0.045, 0.12)))
detail_area = lambda area, d: high(18.0, area * clamp(0.16 - 0.0008 * d, 0.06, 0.16))
detail_simplify = lambda simplify, d: clamp(0.6 * simplify - 0.003 * d, 0.35, 1.1)
max_detail_sources = lambda d: clamp(8 + div(d, 3), 8, 36)
max_detail_bins = lambda d: clamp(2 + div(d, 12), 3, 10)
max_detail_regions = lambda q, d: pick(d <= 0, 0, clamp(24 + div(q, 2) + d, 48, 220))
motion_threshold = lambda o: clamp(half_even(44 - 0.22 * o), 18, 44)
dark_luminance = lambda k: 12 + 0.45 * k
dark_base_factor = lambda k: 1.5 + 0.095 * k
dark_residual_factor = lambda k: 1.8 + 0.08 * k
backdrop_columns = lambda q, w: clamp(pick(q >= 92, 64, pick(q >= 70, 48, 32)), 1, high(1, w))


def _scale(w, h, hi: float):
    return clamp(root(w * h / (1920 * 1080)), 0.75, hi)


surface_cell = lambda q, s, w, h: clamp(half_even((25 - 0.15 * s - 0.055 * q) * _scale(w, h, 1.35)), 7, 32)
surface_delta = lambda q, s: clamp(20 - div(q, 9) - div(s, 12), 5, 18)
stroke_min_pixels = lambda q, n, w, h: clamp(half_even((12 - 0.045 * q - 0.035 * n) * _scale(w, h, 1.4)), 3, 14)
stroke_min_length = lambda q, n, w, h: clamp(root(w * w + h * h) * (0.006 - 0.000018 * q - 0.000014 * n), 4.0, 20.0)
stroke_simplify = lambda q, n: clamp(2.7 - 0.012 * q - 0.004 * n, 0.7, 2.8)
max_strokes = lambda n, w, h: clamp(half_even(150 + 9 * n + 110 * w * h / 1e6), 120, 1500)
max_stroke_points = lambda n, w, h: clamp(half_even(5200 + 105 * n + 1450 * w * h / 1e6), 5000, 26000)
points_per_stroke = lambda q, n: clamp(70 + q + div(n, 2), 90, 230)
max_hatches = lambda s, w, h: clamp(half_even(220 + 12 * s + 260 * w * h / 1e6), 220, 1800)
residual_threshold = lambda q, r: clamp(46 - div(q, 5) - div(r, 3), 12, 42)
max_residuals = lambda r, w, h: clamp(half_even(r * (2.8 + w * h / 1e6)), 0, 900)
keep_share = lambda q, n: 0.012 + 0.00075 * n + 0.00022 * q
residual_tile = lambda cell: clamp(div(cell, 3), 6, 18)


def keep_count(nonzero, q, n):
    """How many edge pixels stay: the share of the non-zero ones, between a 300th (or 80, if a sixth is more) and a sixth of them."""
    most = high(div(nonzero, 300), 1, div(nonzero, 6))
    least = high(1, div(nonzero, 300), low(80, most))
    return clamp(half_even(nonzero * keep_share(q, n)), least, most)


sample_stride = lambda w, h, target=14000: max(1, math.isqrt(w * h // target))

#: Defaults of the knobs.
DEFAULTS = {"quality": 82, "dark": 65, "patch": 35, "focus": 45, "corrections": 100, "density": 78, "detail": 65, "residual": 6, "glow": 38, "opacity": 10, "keyframe": 30}
