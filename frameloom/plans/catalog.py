"""The queries over driver tables, each with the SQL that gives the same rows.

Frames are the event raster of :mod:`frameloom.sources.raster` unless a name
says otherwise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import exprs as X
from ..operators import encode as E
from ..operators import frames as FR
from ..operators import palette as PA
from ..operators import render as R
from ..operators import residuals as RE
from ..operators import stencils as ST
from ..operators import strokes as SK
from ..operators import summary as SU
from ..operators import surface as S
from ..operators import temporal as T
from ..sources import text_format as TF
from ..sources.raster import HEIGHT, RASTER_SQL, WIDTH, event_raster
from . import jobs

W, H, CELL, COLS = WIDTH, HEIGHT, 5, 5
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, raster: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {RASTER_SQL} {', ' + sql[4:].strip() if sql.strip().startswith('AND ') else sql}" if raster else sql
        return f

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


LUM = "0.2126 * r + 0.7152 * g + 0.0722 * b"
LUMA = "((54 * r + 183 * g + 19 * b) >> 8)"


@query(f"SELECT f, k, round({LUM}, 6) AS luma FROM pixel")
def luma_float(spark, d):
    return event_raster(spark, d).select("f", "k", r6(X.luminance(), "luma"))


@query(f"SELECT f, k, {LUMA} AS luma FROM pixel")
def luma_fixed(spark, d):
    return event_raster(spark, d).select("f", "k", X.luma().alias("luma"))


@query("SELECT f, k, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS detail_bin, (r >> 5) * 64 + (g >> 5) * 8 + (b >> 5) AS residual_bin FROM pixel")
def quantize_bins(spark, d):
    return event_raster(spark, d).select("f", "k", X.color_bin(4).alias("detail_bin"), X.color_bin(3).alias("residual_bin"))


STEP = P.color_step(82)


@query("SELECT f, k, " + ", ".join(f"least(255, (({c} + {STEP // 2}) // {STEP}) * {STEP}) AS {c}" for c in "bgr") + " FROM pixel")
def band_snap(spark, d):
    return event_raster(spark, d).select("f", "k", *[X.snap(c, STEP).cast("int").alias(c) for c in "bgr"])


BOX = "CAST(p_size AS BIGINT) AS w, p_partkey % 37 + 1 AS h, p_size * (p_partkey % 37 + 1) * (p_partkey % 10 + 1) / 10.0 AS area, p_retailprice * 100 % 97 AS luma"


def _boxes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    return p.selectExpr("p_partkey", "bigint(p_size) w", "p_partkey % 37 + 1 h", "p_size * (p_partkey % 37 + 1) * (p_partkey % 10 + 1) / 10D area", "p_retailprice * 100 % 97 luma")


@query(f"""SELECT p_partkey FROM (SELECT p_partkey, {BOX} FROM part) WHERE NOT (luma < 12 + 0.45 * 65 AND area < greatest(120.0, 0.004 * 50000)
  AND ((area < 120 AND (least(w, h) <= 3 OR greatest(w, h) / CAST(greatest(1, least(w, h)) AS DOUBLE) >= 8 OR area / CAST(w * h AS DOUBLE) < 0.18)) OR (area / CAST(w * h AS DOUBLE) < 0.1 AND area < 1.7 * 120)))""", raster=False)
def speckle_filter(spark, d):
    c = F.col
    return _boxes(spark, d).where(~X.dark_speckle(c("luma"), c("area"), c("w"), c("h"), 65, 120, 50000)).select("p_partkey")


@query(f"""SELECT p_partkey FROM (SELECT p_partkey, {BOX} FROM part) WHERE NOT (w <= 2 OR h <= 2 OR area / CAST(w * h AS DOUBLE) < 0.08 OR (luma < 12 + 0.45 * 65 AND area < 30 * (1.8 + 0.08 * 65)))""", raster=False)
def residual_noise_filter(spark, d):
    c = F.col
    return _boxes(spark, d).where(~X.residual_noise(c("luma"), c("area"), c("w"), c("h"), 65, 30)).select("p_partkey")


@query("""SELECT a.p_partkey, round(CASE WHEN iw * ih > 0 THEN iw * ih / (a.w * a.h + b.w * b.h - iw * ih) ELSE 0 END, 6) AS iou FROM
  (SELECT a.p_partkey, a.w, a.h, a.l, a.t, greatest(0, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l)) AS iw, greatest(0, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t)) AS ih FROM
    (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, p_partkey % 37 + 1 AS h, p_partkey % 20 AS l, p_partkey % 11 AS t FROM part) a JOIN
    (SELECT p_partkey - 1 AS p_partkey, CAST(p_size AS DOUBLE) AS w, p_partkey % 37 + 1 AS h, p_partkey % 20 AS l, p_partkey % 11 AS t FROM part) b USING (p_partkey)) a
  JOIN (SELECT p_partkey - 1 AS p_partkey, CAST(p_size AS DOUBLE) AS w, p_partkey % 37 + 1 AS h FROM part) b USING (p_partkey)""", raster=False)
def iou_pairs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "p_partkey % 20 l", "p_partkey % 11 t", "p_partkey % 20 + p_size r", "p_partkey % 11 + p_partkey % 37 + 1 b")
    n = p.selectExpr("p_partkey - 1 p_partkey", "l l2", "t t2", "r r2", "b b2")
    return p.join(n, "p_partkey").select("p_partkey", r6(X.intersection_over_union(["l", "t", "r", "b"], ["l2", "t2", "r2", "b2"]), "iou"))


def _paths(spark, d):
    """One path a row of pixels: its blue profile."""
    return event_raster(spark, d).groupBy("f", F.col("y").alias("z")).agg(F.array_sort(F.collect_list(F.struct("x", F.col("b").alias("y")))).alias("points"))


@query("""SELECT f, z, round(sum(sqrt(CAST((x - px) * (x - px) + (b - pb) * (b - pb) AS DOUBLE))), 6) AS length FROM
  (SELECT f, y AS z, x, b, lag(x) OVER w AS px, lag(b) OVER w AS pb FROM pixel WINDOW w AS (PARTITION BY f, y ORDER BY x)) GROUP BY f, z""")
def polyline_length(spark, d):
    return _paths(spark, d).select("f", "z", r6(X.path_length(), "length"))


@query("""SELECT f, z, round(abs(sum(x * nb - nx * b)) / 2.0, 6) AS area, min(x) AS l, min(b) AS t, max(x) + 1 AS r, max(b) + 1 AS low, round(avg(x), 6) AS cx, round(avg(b), 6) AS cy FROM
  (SELECT f, y AS z, x, b, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(b) OVER w, first_value(b) OVER w) AS nb FROM pixel WINDOW w AS (PARTITION BY f, y ORDER BY x)) GROUP BY f, z""")
def ring_area_bounds(spark, d):
    p = _paths(spark, d).withColumn("q", X.bounds()).withColumn("m", X.vertex_mean())
    return p.select("f", "z", r6(F.abs(X.ring_area()), "area"), "q.l", "q.t", "q.r", F.col("q.b").alias("low"), r6(F.col("m.x"), "cx"), r6(F.col("m.y"), "cy"))


@query("""SELECT f, z, round(greatest(0, d), 6) AS d FROM (SELECT f, y AS z, max(CASE WHEN x = 12 THEN b END) AS b, max(CASE WHEN x = 0 THEN b END) AS b0, max(CASE WHEN x = 24 THEN b END) AS b1 FROM pixel GROUP BY f, y) q,
  LATERAL (SELECT greatest(0, least(1, (12.0 * 24 + (b - b0) * (b1 - b0)) / (576.0 + (b1 - b0) * (b1 - b0)))) AS t), LATERAL (SELECT (12 - t * 24) * (12 - t * 24) + (b - b0 - t * (b1 - b0)) * (b - b0 - t * (b1 - b0)) AS d)""")
def segment_distance(spark, d):
    p = event_raster(spark, d).groupBy("f", F.col("y").alias("z")).agg(*[F.max(F.when(F.col("x") == x, F.col("b"))).alias(n) for x, n in ((12, "b"), (0, "b0"), (24, "b1"))])
    return p.select("f", "z", r6(X.segment_distance_squared(F.lit(12), "b", F.lit(0), "b0", F.lit(24), "b1"), "d"))


@query("""SELECT f, z, round(least(sqrt(CAST(0 + (b0 - c0) * (b0 - c0) AS DOUBLE)) + sqrt(CAST((b1 - c1) * (b1 - c1) AS DOUBLE)), sqrt(576.0 + (b0 - c1) * (b0 - c1)) + sqrt(576.0 + (b1 - c0) * (b1 - c0))) / 2, 6) AS ends FROM
  (SELECT f, y AS z, max(CASE WHEN x = 0 THEN b END) AS b0, max(CASE WHEN x = 24 THEN b END) AS b1 FROM pixel GROUP BY f, y) a JOIN
  (SELECT f + 1 AS f, y AS z, max(CASE WHEN x = 0 THEN b END) AS c0, max(CASE WHEN x = 24 THEN b END) AS c1 FROM pixel GROUP BY f, y) b USING (f, z)""")
def stroke_ends(spark, d):
    p = _paths(spark, d)
    return p.join(p.select((F.col("f") + 1).alias("f"), "z", F.col("points").alias("before")), ["f", "z"]).select("f", "z", r6(X.endpoint_distance("points", "before"), "ends"))


@query("SELECT f, k, b, g, r FROM pixel WHERE x % 3 = 0 AND y % 3 = 0")
def grid_sample(spark, d):
    return PA.grid_sample(event_raster(spark, d), 3).select("f", "k", "b", "g", "r")


SIZE = 6
SAMPLE = "s AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM pixel WHERE x % 2 = 0 AND y % 2 = 0)"
START = f"c0 AS (SELECT f, j AS idx, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g, CAST(r AS DOUBLE) AS r FROM s, range(0, {SIZE}) t(j) WHERE CAST(round_even(j * (n - 1) / {SIZE - 1}.0::DOUBLE, 0) AS BIGINT) = i)"


def _nearest_sql(pixels, centres, extra=""):
    return f"(SELECT p.f, p.k, min(struct_pack(d := (c.b - p.b) * (c.b - p.b) + (c.g - p.g) * (c.g - p.g) + (c.r - p.r) * (c.r - p.r), idx := c.idx)).idx AS idx, any_value(p.b) AS b, any_value(p.g) AS g, any_value(p.r) AS r{extra} FROM {pixels} p JOIN {centres} c ON p.f = c.f GROUP BY p.f, p.k)"


def _kmeans_sql(steps, out):
    parts = [SAMPLE, START]
    for i in range(steps):
        parts.append(f"c{i + 1} AS (SELECT c.f, c.idx, " + ", ".join(f"coalesce(CAST(s{c} AS DOUBLE) / n, c.{c}) AS {c}" for c in "bgr") + f" FROM c{i} c LEFT JOIN (SELECT f, idx, count(*) AS n, sum(b) AS sb, sum(g) AS sg, sum(r) AS sr FROM {_nearest_sql('s', f'c{i}')} GROUP BY f, idx) q ON c.f = q.f AND c.idx = q.idx)")
    return "AND " + ", ".join(parts) + " " + out.format(n=f"c{steps}")


def _sample(spark, d):
    return PA.grid_sample(event_raster(spark, d), 2)


@query(f"AND {SAMPLE}, {START} SELECT f, idx, b, g, r FROM c0")
def palette_init(spark, d):
    return PA.initial(_sample(spark, d), SIZE)


def _palette(spark, d, steps=8):
    return PA.kmeans(_sample(spark, d), SIZE, steps)


@query(_kmeans_sql(8, "SELECT f, idx, round(b, 6) AS b, round(g, 6) AS g, round(r, 6) AS r FROM {n}"))
def palette_kmeans(spark, d):
    return _palette(spark, d).select("f", "idx", *[r6(F.col(c), c) for c in "bgr"])


def _labels(spark, d):
    return PA.assign(event_raster(spark, d), _palette(spark, d, 2))


LABELLED = _kmeans_sql(2, "")[:-1] + f", lab AS {_nearest_sql('pixel', 'c2')}, st AS (SELECT f, idx, count(*) AS n, " + ", ".join(f"CAST(round_even(sum({c}) / CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS {c}" for c in "bgr") + " FROM lab GROUP BY f, idx)"


@query(LABELLED + " SELECT f, k, idx FROM lab")
def palette_assign(spark, d):
    return _labels(spark, d).select("f", "k", "idx")


@query(LABELLED + " SELECT f, idx, n, b, g, r FROM st")
def label_stats(spark, d):
    return PA.label_stats(_labels(spark, d))


@query(LABELLED + f""", m AS (SELECT *, {LUM} AS l FROM st), q AS (SELECT f, sum(n) AS al, max(struct_pack(n := n, i := -idx, b := b, g := g, r := r)) AS top,
  sum(CASE WHEN l >= 34 THEN n ELSE 0 END) AS lit, max(CASE WHEN l >= 34 THEN struct_pack(n := n, i := -idx, b := b, g := g, r := r) END) AS best FROM m GROUP BY f),
  u AS (SELECT f, CASE WHEN lit >= 0.18 * al AND best.n >= 0.03 * al THEN best ELSE top END AS c FROM q) SELECT f, -c.i AS idx, c.n AS n, c.b AS b, c.g AS g, c.r AS r FROM u""")
def background_pick(spark, d):
    return PA.background(PA.label_stats(_labels(spark, d)))


CELLS = f"cells AS (SELECT f, (y // {CELL}) * {COLS} + x // {CELL} AS cell, x // {CELL} AS cx, y // {CELL} AS cy, " + ", ".join(f"sum({c}) // count(*) AS {c}" for c in "bgr") + " FROM pixel GROUP BY 1, 2, 3, 4)"
SENT = f"""{CELLS}, sent AS (SELECT f, cell, b, g, r FROM (SELECT *, lag(f) OVER w AS pf, lag(b) OVER w AS pb, lag(g) OVER w AS pg, lag(r) OVER w AS pr FROM cells WINDOW w AS (PARTITION BY cell ORDER BY f))
  WHERE f % 30 = 0 OR pf IS NULL OR (b - pb) * (b - pb) + (g - pg) * (g - pg) + (r - pr) * (r - pr) >= 81)"""


def _cells(spark, d):
    return S.grid_means(event_raster(spark, d), CELL, W)


@query(f"AND {CELLS} SELECT f, cell, cx, cy, b, g, r FROM cells")
def surface_cells(spark, d):
    return _cells(spark, d)


@query(f"AND {SENT} SELECT * FROM sent")
def surface_delta(spark, d):
    return S.changes(_cells(spark, d), 9, 30)


@query(f"AND {SENT} SELECT c.f, c.cell, " + ", ".join(f"last_value(s.{c} IGNORE NULLS) OVER (PARTITION BY c.cell ORDER BY c.f ROWS UNBOUNDED PRECEDING) AS {c}" for c in "bgr") + " FROM cells c LEFT JOIN sent s USING (f, cell)")
def surface_reconstruct(spark, d):
    cells = _cells(spark, d)
    return S.reconstruct(S.changes(cells, 9, 30), cells)


CORNERS = f"{CELLS}, corner AS (SELECT f, cx + dx AS vx, cy + dy AS vy, " + ", ".join(f"sum({c}) // count(*) AS {c}" for c in "bgr") + " FROM cells, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy) GROUP BY 1, 2, 3)"


@query(f"AND {CORNERS} SELECT * FROM corner")
def surface_corners(spark, d):
    return S.corners(_cells(spark, d))


WIDE = f"{CORNERS}, wide AS (SELECT a.f, a.cell, a.cx, a.cy, a.b, a.g, a.r, " + ", ".join(f"c{i}{j}.{c} AS c{i}{j}_{c}" for i in (0, 1) for j in (0, 1) for c in "bgr") + " FROM cells a " + " ".join(
    f"JOIN corner c{i}{j} ON c{i}{j}.f = a.f AND c{i}{j}.vx = a.cx + {i} AND c{i}{j}.vy = a.cy + {j}" for i in (0, 1) for j in (0, 1)) + ")"


def _blend(old, new, weight):
    return f"CAST(least(255, greatest(0, round_even(({old}) * (1.0::DOUBLE - {weight}) + ({new}) * {weight}, 0))) AS BIGINT)"


def _shown(c, tx, ty):
    top, low = f"(c00_{c} + (c10_{c} - c00_{c}) * {tx})", f"(c01_{c} + (c11_{c} - c01_{c}) * {tx})"
    return _blend(c, f"least(255, greatest(0, round_even({top} + ({low} - {top}) * {ty}, 0)))", "0.12::DOUBLE")


def _display_sql():
    return f"AND {WIDE} SELECT f, cell, " + ", ".join(f"{_shown(c, '0.25::DOUBLE', '0.75::DOUBLE')} AS {c}" for c in "bgr") + " FROM wide"


@query(_display_sql())
def surface_bilinear(spark, d):
    cells = _cells(spark, d)
    return S.display(cells, S.corners(cells), 0.25, 0.75)


#: The encoder's knobs for these small frames: more residual patches than by default.
KNOBS = P.DEFAULTS | {"residual": 35}


def _at_sql(places):
    """Places (f, x, y and more) with the shown colour of the surface there."""
    tx, ty = "((q.x - w.cx * 5) / CAST(least(25, w.cx * 5 + 5) - w.cx * 5 AS DOUBLE))", "((q.y - w.cy * 5) / CAST(least(20, w.cy * 5 + 5) - w.cy * 5 AS DOUBLE))"
    return "(SELECT q.*, " + ", ".join(f"{_shown(c, tx, ty).replace('(' + c + ') *', '(w.' + c + ') *')} AS p{c}" for c in "bgr") + f" FROM {places} q JOIN wide w ON w.f = q.f AND w.cx = least(4, q.x // 5) AND w.cy = least(3, q.y // 5))"


@query(f"AND {WIDE} SELECT f, k, pb, pg, pr FROM {_at_sql('(SELECT f, k, x, y FROM pixel)')}")
def surface_at_pixels(spark, d):
    pixel = event_raster(spark, d)
    return S.display_at(pixel.select("f", "k", "x", "y"), S.grid_means(pixel, CELL, W), CELL, W, H).select("f", "k", "pb", "pg", "pr")


@query(f"""AND {CELLS}, h AS (SELECT f, cell, cx, cy, b, g, r, {LUM} AS l, cx * 5 AS x0, cy * 5 AS y0, least(24, cx * 5 + 4) AS x1, least(19, cy * 5 + 4) AS y1 FROM cells), dk AS (SELECT *, CAST(floor(least(255, greatest(0, 255 - l))) AS BIGINT) AS dark, least(0.28::DOUBLE, greatest(0.08::DOUBLE, (255 - l) / 510.0)) AS wt FROM h WHERE l <= 238 OR (cx + cy) % 5 = 0)
  SELECT f, row_number() OVER (PARTITION BY f ORDER BY cell) AS z, cell, x0 + 1 AS x0, CASE WHEN (cx + cy) % 2 = 0 THEN y1 - 1 ELSE y0 + 1 END AS y0, x1 - 1 AS x1, CASE WHEN (cx + cy) % 2 = 0 THEN y0 + 1 ELSE y1 - 1 END AS y1, """
       + ", ".join(f"{_blend(c, 255, 'wt')} AS {c}" for c in "bgr")
       + """, CAST(floor(least(210, greatest(80, 80 + dark * 0.45::DOUBLE))) AS BIGINT) AS intensity, 4 AS width, 2 AS glow, CAST(floor(least(148, greatest(34, 28 + dark * 0.35::DOUBLE + 16.25))) AS BIGINT) AS opacity FROM dk""")
def hatch_strokes(spark, d):
    return S.hatches(_cells(spark, d), CELL, W, H, KNOBS)


TILES = f"""{WIDE}, tl AS (SELECT f, tx, ty, tx * 6 AS x0, ty * 6 AS y0, least(25, tx * 6 + 6) AS x1, least(20, ty * 6 + 6) AS y1 FROM (SELECT DISTINCT f FROM pixel), range(0, 5) a(tx), range(0, 4) b(ty)),
  pd AS {_at_sql('(SELECT *, (x0 + x1) // 2 AS x, (y0 + y1) // 2 AS y FROM tl)')}, te AS (SELECT p.f, d.x0, d.y0, d.x1, d.y1, sum((abs(p.b - d.pb) + abs(p.g - d.pg) + abs(p.r - d.pr)) // 3) / CAST(count(*) AS DOUBLE) AS error, sum(p.b) // count(*) AS b, sum(p.g) // count(*) AS g, sum(p.r) // count(*) AS r
    FROM pixel p JOIN pd d ON d.f = p.f AND d.tx = p.x // 6 AND d.ty = p.y // 6 GROUP BY ALL),
  ti AS (SELECT f, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, error, b, g, r, CAST(floor(least(190, greatest(54, 36 + error * 3.2::DOUBLE))) AS BIGINT) AS opacity FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY error DESC, y0, x0) AS rank FROM te WHERE error >= 19) WHERE rank <= 98)"""


@query(f"AND {TILES} SELECT f, x, y, w, h, round(error, 6) AS error, b, g, r, opacity FROM ti")
def residual_tiles(spark, d):
    return _patches(spark, d).withColumn("error", F.round("error", 6))


def _patches(spark, d):
    pixel = event_raster(spark, d)
    return S.residual_tiles(pixel, S.grid_means(pixel, CELL, W), CELL, W, H, KNOBS)


@query("SELECT f, x * 6 // 25 AS cx, y * 4 // 20 AS cy, " + ", ".join(f"CAST(round_even(sum({c}) / CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS {c}" for c in "bgr") + " FROM pixel GROUP BY 1, 2, 3")
def backdrop_grid(spark, d):
    return S.proportional_grid(event_raster(spark, d), 6, 4, W, H)


MOTION = """mo AS (SELECT f, k, x, y, CAST(mx >= 12 AND tot >= 24 AS BIGINT) AS moved FROM (SELECT f, k, x, y, pf, greatest(db, dg, dr) AS mx, db + dg + dr AS tot FROM
  (SELECT f, k, x, y, lag(f) OVER w AS pf, abs(b - lag(b) OVER w) AS db, abs(g - lag(g) OVER w) AS dg, abs(r - lag(r) OVER w) AS dr FROM pixel WINDOW w AS (PARTITION BY k ORDER BY f))) WHERE pf IS NOT NULL),
  mask AS (SELECT f, k, x, y, moved FROM (SELECT *, avg(moved) OVER (PARTITION BY f) AS share FROM mo) WHERE share BETWEEN 0.0015 AND 0.7)"""


@query(f"AND {MOTION} SELECT * FROM mask")
def motion_mask(spark, d):
    return ST.motion(event_raster(spark, d), 12)


IN = f"x > 0 AND y > 0 AND x < {W - 1} AND y < {H - 1}"


def _sum_sql(table, c, weights):
    terms = " + ".join(f"{w} * lag({c}, {-(dy * W + dx)}) OVER w" if dy * W + dx < 0 else f"{w} * lead({c}, {dy * W + dx}) OVER w" for (dx, dy), w in weights.items() if w)
    return terms


BLUR_W = {(dx, dy): (2 - abs(dx)) * (2 - abs(dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
GX = {(1, -1): 1, (1, 0): 2, (1, 1): 1, (-1, -1): -1, (-1, 0): -2, (-1, 1): -1}
GY = {(-1, 1): 1, (0, 1): 2, (1, 1): 1, (-1, -1): -1, (0, -1): -2, (1, -1): -1}
WIN = "WINDOW w AS (PARTITION BY f ORDER BY k)"
BLURRED = f"lu AS (SELECT f, k, x, y, {LUMA} AS l FROM pixel), bl AS (SELECT f, k, x, y, CASE WHEN {IN} THEN ({_sum_sql('lu', 'l', BLUR_W)} + 8) >> 4 ELSE l END AS l FROM lu {WIN})"
FIELD = f"{BLURRED}, gr AS (SELECT f, k, x, y, CASE WHEN {IN} THEN {_sum_sql('bl', 'l', GX)} ELSE 0 END AS gx, CASE WHEN {IN} THEN {_sum_sql('bl', 'l', GY)} ELSE 0 END AS gy FROM bl {WIN}), fi AS (SELECT *, least(255, (abs(gx) + abs(gy)) >> 2) AS mag FROM gr)"


def _n(c, dx, dy):
    off = dy * W + dx
    return f"lag({c}, {-off}) OVER w" if off < 0 else f"lead({c}, {off}) OVER w"


NMS = f"""{FIELD}, nm AS (SELECT f, k, x, y, CASE WHEN {IN} AND mag >= CASE WHEN abs(gx) > 2 * abs(gy) THEN {_n('mag', -1, 0)} WHEN abs(gy) > 2 * abs(gx) THEN {_n('mag', 0, -1)} WHEN xor(gx, gy) >= 0 THEN {_n('mag', -1, -1)} ELSE {_n('mag', 1, -1)} END
  AND mag >= CASE WHEN abs(gx) > 2 * abs(gy) THEN {_n('mag', 1, 0)} WHEN abs(gy) > 2 * abs(gx) THEN {_n('mag', 0, 1)} WHEN xor(gx, gy) >= 0 THEN {_n('mag', 1, 1)} ELSE {_n('mag', -1, 1)} END THEN mag ELSE 0 END AS nms FROM fi {WIN})"""
QUALITY, DENSITY = KNOBS["quality"], KNOBS["density"]
KEPT = "least(mo, greatest(le, CAST(round_even(al * (0.012::DOUBLE + 0.00075::DOUBLE * 78 + 0.00022::DOUBLE * 82), 0) AS BIGINT)))"
HIGH = f"""{NMS}, hg AS (SELECT f, v, sum(n) OVER (PARTITION BY f ORDER BY v DESC) AS cum, sum(n) OVER (PARTITION BY f) AS al FROM (SELECT f, nms AS v, count(*) AS n FROM nm WHERE nms > 0 GROUP BY 1, 2)),
  hb AS (SELECT f, v, cum, al, greatest(al // 300, 1, al // 6) AS mo, greatest(1, al // 300, least(80, greatest(al // 300, 1, al // 6))) AS le FROM hg),
  hi AS (SELECT f, coalesce(least(210, greatest(18, v)), 255) AS high FROM (SELECT DISTINCT f FROM pixel) LEFT JOIN (SELECT f, max(v) AS v FROM hb WHERE cum >= {KEPT} GROUP BY f) USING (f))"""


def _blurred(spark, d):
    return ST.blur(event_raster(spark, d).select("f", "k", "x", "y", X.luma().alias("l0")), "l0", W, H, "l")


def _nms(spark, d):
    return ST.suppress(ST.gradient(_blurred(spark, d), "l", W, H), W, H)


def _edges(spark, d):
    nms = _nms(spark, d)
    return FR.hysteresis(nms, "nms", ST.high_threshold(nms, "nms", QUALITY, DENSITY), W, H)


@query(f"AND {BLURRED} SELECT f, k, l FROM bl")
def blur3x3(spark, d):
    return _blurred(spark, d).select("f", "k", "l")


@query(f"AND {FIELD} SELECT f, k, gx, gy, mag FROM fi")
def sobel(spark, d):
    return ST.gradient(_blurred(spark, d), "l", W, H).select("f", "k", "gx", "gy", "mag")


@query(f"AND {NMS} SELECT f, k, nms FROM nm")
def nms(spark, d):
    return _nms(spark, d).select("f", "k", "nms")


@query(f"AND {HIGH} SELECT f, high FROM hi")
def adaptive_threshold(spark, d):
    return ST.high_threshold(_nms(spark, d), "nms", QUALITY, DENSITY)


HYST = f"""{HIGH}, cand AS (SELECT f, k, x, y, nms >= high AS seed, ({IN}) AND nms >= greatest(8, round_even(0.42::DOUBLE * high, 0)) AS grow FROM nm JOIN hi USING (f)),
  ed(f, x, y) AS (SELECT f, x, y FROM cand WHERE seed UNION SELECT c.f, c.x, c.y FROM ed e JOIN cand c ON c.f = e.f AND c.grow AND abs(c.x - e.x) <= 1 AND abs(c.y - e.y) <= 1),
  em AS (SELECT p.f, p.k, p.x, p.y, CAST(e.f IS NOT NULL AS BIGINT) AS edge FROM pixel p LEFT JOIN ed e ON e.f = p.f AND e.x = p.x AND e.y = p.y)"""


@query(f"AND {HYST} SELECT f, k, edge FROM em")
def hysteresis(spark, d):
    return _edges(spark, d).select("f", "k", "edge")


PAIRS = " OR ".join(f"({_n('edge', dx, dy)} > 0 AND {_n('edge', -dx, -dy)} > 0)" for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)))


@query(f"AND {HYST} SELECT f, k, CASE WHEN edge > 0 THEN 1 WHEN {IN} AND ({PAIRS}) THEN 1 ELSE 0 END AS bridged FROM em {WIN}")
def gap_bridge(spark, d):
    return ST.bridge(_edges(spark, d), "edge", W, H, "bridged").select("f", "k", "bridged")


def _morph_sql():
    parts, now = [f"m0 AS (SELECT f, k, x, y, CAST(r > 100 AS BIGINT) AS v FROM pixel)"], "m0"
    for i, f in enumerate(("min", "max", "max", "min", "min", "max")):
        parts.append(f"m{i + 1} AS (SELECT a.f, a.k, a.x, a.y, {f}(b.v) AS v FROM {now} a JOIN {now} b ON a.f = b.f AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3, 4)")
        now = f"m{i + 1}"
    return "AND " + ", ".join(parts) + " SELECT f, k, v AS mask FROM m6"


@query(_morph_sql())
def morph_open_close(spark, d):
    mask = event_raster(spark, d).select("f", "k", "x", "y", (F.col("r") > 100).cast("int").alias("v"))
    return ST.open_close_open(mask, "v", W, H, "mask").select("f", "k", "mask")


BANDS = "bands AS (SELECT f, k, x, y, b, g, r, (r // 64) * 16 + (g // 64) * 4 + b // 64 AS v FROM pixel)"
COMP = f"""{BANDS}, ne AS (SELECT a.f, a.k AS a, b.k AS b FROM bands a JOIN bands b ON a.f = b.f AND a.v = b.v AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
  reach(f, k, c) AS (SELECT f, k, k FROM bands UNION SELECT n.f, n.b, q.c FROM reach q JOIN ne n ON n.f = q.f AND n.a = q.k WHERE n.b > q.c),
  comp AS (SELECT f, k, min(c) AS component FROM reach GROUP BY 1, 2)"""


def _bands(spark, d):
    return event_raster(spark, d).withColumn("v", F.expr("(r div 64) * 16 + (g div 64) * 4 + b div 64").cast("int"))


def _regions(spark, d, least=3):
    pixel = _bands(spark, d)
    return FR.region_table(FR.connected(pixel, "v", W, H), pixel, least)


@query(f"AND {COMP} SELECT f, k, component FROM comp")
def connected_regions(spark, d):
    return FR.connected(_bands(spark, d), "v", W, H)


REGIONS = f"""{COMP}, reg AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY area DESC, component) - 1 AS z FROM (SELECT c.f, c.component, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b,
  CAST(round_even(avg(p.b), 0) AS BIGINT) AS mean_b, CAST(round_even(avg(p.g), 0) AS BIGINT) AS mean_g, CAST(round_even(avg(p.r), 0) AS BIGINT) AS mean_r FROM comp c JOIN pixel p USING (f, k) GROUP BY 1, 2) WHERE area >= 3)"""


@query(f"AND {REGIONS} SELECT f, z, component, area, round(cx, 6) AS cx, round(cy, 6) AS cy, l, t, r, b, mean_b, mean_g, mean_r FROM reg")
def region_table(spark, d):
    return _regions(spark, d).withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query(f"""AND {BANDS} SELECT f, v AS idx, x + a AS x0, y + b_ AS y0, x + c AS x1, y + d_ AS y1 FROM (SELECT *, y > 0 AND {_n('v', 0, -1)} = v AS st, x < {W - 1} AND {_n('v', 1, 0)} = v AS sr, y < {H - 1} AND {_n('v', 0, 1)} = v AS sl, x > 0 AND {_n('v', -1, 0)} = v AS sf FROM bands {WIN}) q,
  (VALUES ('t', 0, 0, 1, 0), ('r', 1, 0, 1, 1), ('l', 1, 1, 0, 1), ('f', 0, 1, 0, 0)) o(side, a, b_, c, d_) WHERE NOT coalesce(CASE side WHEN 't' THEN st WHEN 'r' THEN sr WHEN 'l' THEN sl ELSE sf END, false)""")
def boundary_edges(spark, d):
    return ST.boundary_edges(_bands(spark, d).withColumn("idx", F.col("v")), W, H).select("f", "idx", "x0", "y0", "x1", "y1")


def _rings(spark, d, tolerance):
    pixel = _bands(spark, d).withColumn("idx", F.col("v"))
    labelled = pixel.join(FR.connected(pixel, "v", W, H), ["f", "k"])
    return FR.rings(ST.boundary_edges(labelled, W, H, "component"), tolerance)


@query(f"""AND {COMP}, cp AS (SELECT c.f, c.k, c.component, b.x, b.y, b.v FROM comp c JOIN bands b USING (f, k)), sd AS (SELECT a.f, a.component, any_value(a.v) AS idx, count(*) AS area FROM cp a GROUP BY 1, 2)
  SELECT f, idx, component, area FROM sd""")
def ring_components(spark, d):
    """Each component has one ring, which with its holes encloses the component's pixels."""
    return _rings(spark, d, 1.0).where("area > 0").select("f", "idx", "component", F.col("pixels").alias("area"))


@query()
def boundary_rings(spark, d):
    return _rings(spark, d, 1.0).drop("pixels", "points")


@query()
def rdp_simplify(spark, d):
    return _rings(spark, d, 1.75).select("f", "idx", "component", "n_simple", "points")


@query()
def merged_regions(spark, d):
    return FR.merged(event_raster(spark, d), W, H, QUALITY, P.palette_size(QUALITY))


def _video(df):
    return df.withColumn("video", F.lit("events"))


def _strokes(spark, d):
    bridged = ST.bridge(_edges(spark, d), "edge", W, H, "e2").select("f", "k", F.col("e2").alias("edge"))
    mag = ST.gradient(_blurred(spark, d), "l", W, H).select("f", "k", "mag")
    return SK.build(_video(event_raster(spark, d).join(mag, ["f", "k"]).join(bridged, ["f", "k"])), W, H, KNOBS)


@query()
def stroke_chains(spark, d):
    return _strokes(spark, d)


@query()
def stroke_tracks(spark, d):
    return SK.tracked(_strokes(spark, d), W, H, DENSITY)


@query()
def stroke_encode(spark, d):
    """The stroke encoder over the event frames: a row a frame."""
    frames = jobs.stroke_frames(_video(event_raster(spark, d)), W, H, KNOBS)
    return frames.select("video", "f", "key", F.size("changes").alias("changes"), F.size("strokes").alias("strokes"), F.size("residuals").alias("residuals"), F.expr("aggregate(strokes, 0, (a, s) -> a + size(s.points))").alias("points"))


def _frames(spark, d):
    return jobs.packed(_video(event_raster(spark, d)))


@query()
def region_encode(spark, d):
    """The region encoder over the event frames, ids and all: a row a region."""
    traced = E.with_ids(E.regions(_frames(spark, d), W, H, {"palette": 8}), W, H)
    return traced.select("video", "f", "back_r", "back_g", "back_b", F.posexplode("regions").alias("z", "s")).select("video", "f", "back_r", "back_g", "back_b", "z", "s.id", "s.r", "s.g", "s.b", "s.points", "s.is_correction")


@query()
def region_encode_merged(spark, d):
    return E.regions(_frames(spark, d), W, H, {"palette": 8, "tracer": "merged"}).select("video", "f", F.size("regions").alias("regions"))


@query()
def region_encode_fast(spark, d):
    return E.regions(_frames(spark, d), W, H, {"palette": 8, "tracer": "fast"}).select("video", "f", F.size("regions").alias("regions"))


@query()
def edge_encode(spark, d):
    return E.edges(_frames(spark, d), W, H, 60.0, True, 0.5).select("video", "f", F.posexplode("paths").alias("z", "points"))


@query(f"""AND {REGIONS} SELECT f, z, pz, round(0.35 * sqrt((cx - pcx) * (cx - pcx) + (cy - pcy) * (cy - pcy)) / sqrt({W * W + H * H}.0) + 0.35 * sqrt(CAST((mean_b - pb) * (mean_b - pb) + (mean_g - pg) * (mean_g - pg) + (mean_r - pr) * (mean_r - pr) AS DOUBLE)) / 441.67295593
  + 0.15 * least(1, greatest(0, abs(ln((area + 1.0::DOUBLE) / (parea + 1))) / 2)) + 0.15 * (1 - CASE WHEN iw * ih > 0 THEN iw * ih / CAST((r - l) * (b - t) + (p_r - p_l) * (p_b - p_t) - iw * ih AS DOUBLE) ELSE 0 END), 6) AS score FROM
  (SELECT a.*, p.z AS pz, p.cx AS pcx, p.cy AS pcy, p.area AS parea, p.mean_b AS pb, p.mean_g AS pg, p.mean_r AS pr, p.l AS p_l, p.t AS p_t, p.r AS p_r, p.b AS p_b,
    greatest(0, least(a.r, p.r) - greatest(a.l, p.l)) AS iw, greatest(0, least(a.b, p.b) - greatest(a.t, p.t)) AS ih FROM reg a JOIN reg p ON a.f = p.f + 1)""")
def region_match_scores(spark, d):
    return T.match_scores(_regions(spark, d), (W * W + H * H) ** 0.5).withColumn("score", F.round("score", 6))


@query()
def region_ids(spark, d):
    return FR.track_regions(_regions(spark, d).withColumn("video", F.lit("events")), W, H)


@query("""SELECT f, z, CAST(points AS BIGINT) AS points FROM (SELECT f, z, least(want, 60 - coalesce(sum(want) OVER (PARTITION BY f ORDER BY priority DESC, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS points FROM
  (SELECT f, y AS z, sum(b) AS priority, least(8, max(g) % 12) AS want FROM pixel GROUP BY 1, 2)) WHERE points >= 2""")
def point_budget(spark, d):
    s = event_raster(spark, d).groupBy("f", F.col("y").alias("z")).agg(F.sum("b").alias("priority"), (F.max("g") % 12).alias("n"))
    return T.point_budget(s, 8, 60)


@query("""AND q AS (SELECT f, y AS z, i, max(CASE WHEN x = CAST(round_even(i * 24 / 8.0::DOUBLE, 0) AS BIGINT) THEN b END) AS b, CAST(round_even(i * 24 / 8.0::DOUBLE, 0) AS BIGINT) AS x FROM pixel, range(0, 9) t(i) GROUP BY f, y, i)
  SELECT f, z, count(*) AS n, string_agg(x || ',' || b, ' ' ORDER BY i) AS path FROM q GROUP BY f, z""")
def stroke_resample(spark, d):
    return T.resample(_paths(spark, d), 9).select("f", "z", F.size("points").cast("long").alias("n"), F.expr(TF.points_text("points")).alias("path"))


ERRORS = f"""{CELLS}, er AS (SELECT p.f, (p.r >> 5) * 64 + (p.g >> 5) * 8 + (p.b >> 5) AS bin, p.b, p.g, p.r FROM pixel p JOIN cells c ON p.f = c.f AND p.x // 5 = c.cx AND p.y // 5 = c.cy
  WHERE greatest(abs(p.b - c.b), abs(p.g - c.g), abs(p.r - c.r)) >= 10 OR abs(p.b - c.b) + abs(p.g - c.g) + abs(p.r - c.r) >= 20)"""


@query(f"AND {ERRORS} SELECT f, bin, n, b, g, r, rank FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, bin) AS rank FROM (SELECT f, bin, count(*) AS n, " + ", ".join(f"CAST(round_even(sum({c}) / CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS {c}" for c in "bgr") + " FROM er GROUP BY 1, 2) WHERE n >= 4) WHERE rank <= 5")
def residual_bins_topk(spark, d):
    pixel = event_raster(spark, d)
    cells = S.grid_means(pixel, CELL, W).withColumn("z", F.col("cell")).selectExpr("f", "z", "cx * 5 l", "cy * 5 t", "cx * 5 + 5 r", "cy * 5 + 5 b", "struct(b, g, r) fill")
    return RE.error_bins(pixel, RE.paint(pixel, cells), 10, 3, 4, 5)


@query(f"""AND {REGIONS}, {MOTION}, hit AS (SELECT p.f, q.z, (p.r >> 4) * 256 + (p.g >> 4) * 16 + (p.b >> 4) AS bin, coalesce(m.moved <> 0, false) AS fg,
    sqrt(CAST((p.b - q.mean_b) * (p.b - q.mean_b) + (p.g - q.mean_g) * (p.g - q.mean_g) + (p.r - q.mean_r) * (p.r - q.mean_r) AS DOUBLE)) AS e
    FROM pixel p JOIN reg q ON p.f = q.f AND p.x >= q.l AND p.x < q.r AND p.y >= q.t AND p.y < q.b LEFT JOIN mask m ON m.f = p.f AND m.k = p.k)
  SELECT f, z, bin, n, error, rank FROM (SELECT *, row_number() OVER (PARTITION BY f, z ORDER BY error DESC, bin) AS rank FROM (SELECT f, z, bin, count(*) AS n, CAST(sum(CAST(round(e * CASE WHEN fg THEN 1 + 45 / 32.0::DOUBLE ELSE 1 - 45 / 150.0::DOUBLE END * 1000) AS BIGINT)) AS BIGINT) AS error
    FROM hit WHERE e >= 20 * CASE WHEN fg THEN 1 - 0.0045::DOUBLE * 45 ELSE 1 + 0.009::DOUBLE * 45 END GROUP BY 1, 2, 3)) WHERE rank <= 4""")
def detail_bins_topk(spark, d):
    pixel = event_raster(spark, d)
    return RE.detail_bins(pixel, _regions(spark, d), 20.0, 45, ST.motion(pixel, 12), 4)


@query(f"""AND {REGIONS}, {MOTION} SELECT f, z, round(cov, 6) AS coverage, round(area * (1 + cov * 45 / 18), 6) AS score FROM (SELECT q.f, q.z, q.area, avg(CAST(m.moved <> 0 AS BIGINT)) AS cov FROM mask m JOIN reg q ON m.f = q.f AND m.x >= q.l AND m.x < q.r AND m.y >= q.t AND m.y < q.b
  AND (m.x - q.l) % greatest(4, least(q.r - q.l, q.b - q.t) // 12) = 0 AND (m.y - q.t) % greatest(4, least(q.r - q.l, q.b - q.t) // 12) = 0 GROUP BY 1, 2, 3)""")
def region_mask_scores(spark, d):
    return RE.mask_coverage(_regions(spark, d), ST.motion(event_raster(spark, d), 12), 45).select("f", "z", r6(F.col("coverage"), "coverage"), r6(F.col("score"), "score"))


@query(f"""AND {REGIONS}, top AS (SELECT p.f, p.k, max(struct_pack(z := q.z, b := q.mean_b, g := q.mean_g, r := q.mean_r)) AS s FROM pixel p JOIN reg q ON p.f = q.f AND p.x >= q.l AND p.x < q.r AND p.y >= q.t AND p.y < q.b GROUP BY 1, 2)
  SELECT p.f, p.k, coalesce(s.b, 0) AS pb, coalesce(s.g, 0) AS pg, coalesce(s.r, 0) AS pr FROM pixel p LEFT JOIN top USING (f, k)""")
def painted_boxes(spark, d):
    boxes = _regions(spark, d).selectExpr("f", "z", "l", "t", "r", "b", "struct(mean_b b, mean_g g, mean_r r) fill")
    return RE.paint(event_raster(spark, d), boxes)


@query(f"""AND {COMP}, mean AS (SELECT c.f, c.component AS id, count(*) AS n, avg(p.b) AS b, avg(p.g) AS g, avg(p.r) AS r FROM comp c JOIN pixel p USING (f, k) GROUP BY 1, 2), c0 AS (SELECT f, cell AS idx, b, g, r FROM (SELECT f, (y // 5) * 5 + x // 5 AS cell, sum(b) // count(*) AS b, sum(g) // count(*) AS g, sum(r) // count(*) AS r FROM pixel GROUP BY 1, 2) WHERE cell % 4 = 0),
  w AS (SELECT m.f, m.id, any_value(m.b) AS b, any_value(m.g) AS g, any_value(m.r) AS r, min(struct_pack(d := (c.b - round_even(m.b, 0)) * (c.b - round_even(m.b, 0)) + (c.g - round_even(m.g, 0)) * (c.g - round_even(m.g, 0)) + (c.r - round_even(m.r, 0)) * (c.r - round_even(m.r, 0)), idx := c.idx)).idx AS idx FROM mean m JOIN c0 c ON m.f = c.f GROUP BY 1, 2)
  SELECT w.f, w.id, w.idx, round((w.b - c.b) * (w.b - c.b) + (w.g - c.g) * (w.g - c.g) + (w.r - c.r) * (w.r - c.r), 6) AS distance FROM w JOIN c0 c ON w.f = c.f AND w.idx = c.idx""")
def region_palette_fit(spark, d):
    pixel = _bands(spark, d)
    palette = S.grid_means(pixel, CELL, W).where("cell % 4 = 0").select("f", F.col("cell").alias("idx"), "b", "g", "r")
    return PA.region_fits(_means(spark, d), palette).withColumn("distance", F.round("distance", 6))


def _means(spark, d):
    pixel = _bands(spark, d)
    return FR.connected(pixel, "v", W, H).join(pixel, ["f", "k"]).groupBy("f", F.col("component").alias("id")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "bgr"])


def _weighted_sql(size, steps):
    parts = [f"""{COMP}, mean AS (SELECT c.f, c.component AS id, count(*) AS n, avg(p.b) AS b, avg(p.g) AS g, avg(p.r) AS r FROM comp c JOIN pixel p USING (f, k) GROUP BY 1, 2),
      s0 AS (SELECT f, id AS k, b, g, r, least(96, greatest(1, sqrt(n))) AS w, row_number() OVER (PARTITION BY f ORDER BY {LUM}, id) - 1 AS i, count(*) OVER (PARTITION BY f) AS nn FROM mean)""",
             f"c0 AS (SELECT f, j AS idx, b, g, r FROM s0, range(0, {size}) t(j) WHERE j < nn AND CAST(round_even(j * (nn - 1) / greatest(1.0::DOUBLE, least({size}, nn) - 1.0::DOUBLE), 0) AS BIGINT) = i)"]
    for i in range(steps):
        near = _nearest_sql("s0", f"c{i}", ", any_value(p.w) AS w")
        parts.append(f"c{i + 1} AS (SELECT c.f, c.idx, " + ", ".join(f"coalesce(s{c}, c.{c}) AS {c}" for c in "bgr") + f" FROM c{i} c LEFT JOIN (SELECT f, idx, " + ", ".join(f"sum(w * {c}) / sum(w) AS s{c}" for c in "bgr") + f" FROM {near} GROUP BY f, idx) q ON c.f = q.f AND c.idx = q.idx)")
    return "AND " + ", ".join(parts) + f" SELECT f, idx, round(b, 6) AS b, round(g, 6) AS g, round(r, 6) AS r FROM c{steps}"


@query(_weighted_sql(4, 6))
def weighted_palette(spark, d):
    return PA.weighted_kmeans(_means(spark, d), 4).select("f", "idx", *[r6(F.col(c), c) for c in "bgr"])


@query("""AND v AS (SELECT f, k, (f * 500 + k) * 2731 AS n FROM pixel) SELECT f, k, n AS value, lower(printf('%02x', (n & 127) + CASE WHEN n >= 128 THEN 128 ELSE 0 END) || CASE WHEN n >= 128 THEN printf('%02x', ((n >> 7) & 127) + CASE WHEN n >= 16384 THEN 128 ELSE 0 END) ELSE '' END
  || CASE WHEN n >= 16384 THEN printf('%02x', ((n >> 14) & 127) + CASE WHEN n >= 2097152 THEN 128 ELSE 0 END) ELSE '' END || CASE WHEN n >= 2097152 THEN printf('%02x', ((n >> 21) & 127) + CASE WHEN n >= 268435456 THEN 128 ELSE 0 END) ELSE '' END || CASE WHEN n >= 268435456 THEN printf('%02x', n >> 28) ELSE '' END) AS hex, n AS back FROM v""")
def varint_roundtrip(spark, d):
    v = event_raster(spark, d).selectExpr("f", "k", "(bigint(f) * 500 + k) * 2731 AS value").withColumn("hex", X.varint_hex("value"))
    return v.select("f", "k", "value", "hex", X.varint_value("hex").alias("back"))


def _texted(spark, d):
    """Regions as polygons: their boxes' corners."""
    reg = _regions(spark, d)
    return reg.withColumn("id", F.when(F.col("z") % 5 == 0, 0).otherwise(F.col("component") + 1)).withColumn("points", F.expr("array(struct(int(l) AS x, int(t) AS y), struct(int(r) AS x, int(t) AS y), struct(int(r) AS x, int(b) AS y), struct(int(l) AS x, int(b) AS y))"))


LINE = "'REGION ' || CASE WHEN z % 5 = 0 THEN 0 ELSE component + 1 END || ' ' || mean_r || ' ' || mean_g || ' ' || mean_b || ' 4 ' || l || ',' || t || ' ' || r || ',' || t || ' ' || r || ',' || b || ' ' || l || ',' || b"


@query(f"AND {REGIONS} SELECT f, z, {LINE} AS line, CASE WHEN z % 5 = 0 THEN 0 ELSE component + 1 END AS id, mean_r AS r, mean_g AS g, mean_b AS b, 4 AS n, z % 5 = 0 AS is_correction FROM reg")
def region_text_roundtrip(spark, d):
    lines = _texted(spark, d).withColumn("line", F.expr(TF.region_line("id", ("mean_r", "mean_g", "mean_b"), "points")))
    body = lines.select(F.lit("one").alias("path"), F.col("f").alias("frame"), F.expr("f * 100000 + 2 + z").cast("long").alias("n"), "line")
    ends = body.select("path", "frame").distinct().select("path", "frame", F.explode(F.expr("array(struct(bigint(frame * 100000) AS n, concat('FRAME ', frame) AS line), struct(bigint(frame * 100000 + 99999) AS n, 'END' AS line))")).alias("e"))
    back = TF.parse_regions(body.select("path", "n", "line").unionByName(ends.select("path", "e.n", "e.line")), header=0)
    known = lines.select("f", "z", "line")
    return back.join(known, ["f", "z"]).select("f", "z", "line", "id", "r", "g", "b", F.size("points").alias("n"), "is_correction")


@query(f"AND {CELLS}, h AS (SELECT f, cell, printf('%02X%02X%02X', (r // 32) * 32, (g // 64) * 64, (b // 64) * 64) AS hex FROM cells) SELECT f, run, any_value(hex) || '*' || count(*) AS token FROM (SELECT *, sum(nw) OVER (PARTITION BY f ORDER BY cell) AS run FROM (SELECT *, CASE WHEN lag(hex) OVER (PARTITION BY f ORDER BY cell) = hex THEN 0 ELSE 1 END AS nw FROM h)) GROUP BY f, run")
def backdrop_rle(spark, d):
    return TF.backdrop_runs(_cells(spark, d).selectExpr("f", "cell", "int((r div 32) * 32) r", "int((g div 64) * 64) g", "int((b div 64) * 64) b"))


@query(f"AND {CELLS} SELECT f, cell, CAST((r // 32) * 32 AS BIGINT) AS r, CAST((g // 64) * 64 AS BIGINT) AS g, CAST((b // 64) * 64 AS BIGINT) AS b FROM cells")
def backdrop_expand(spark, d):
    return TF.expand_runs(backdrop_rle(spark, d))


@query(f"""AND {REGIONS} SELECT f, z, tri, corner, round(px / 25.0 * 2 - 1, 6) AS cx, round(1 - py / 20.0 * 2, 6) AS cy FROM (SELECT f, z, tri, corner, CASE WHEN corner = 0 THEN l WHEN (tri, corner) = (0, 1) THEN r WHEN (tri, corner) = (1, 2) THEN l ELSE r END AS px,
  CASE WHEN corner = 0 THEN t WHEN (tri, corner) = (0, 1) THEN t WHEN (tri, corner) = (1, 2) THEN b ELSE b END AS py FROM reg, range(0, 2) a(tri), range(0, 3) c(corner))""")
def fan_triangles(spark, d):
    return R.fan(_texted(spark, d), W, H).withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


def _clip(v, keys):
    """Vertices with six decimals."""
    return v.select(*keys, "vertex", *[r6(F.col(c), c) for c in ("x", "y", "red", "green", "blue", "alpha")])


def _quad_sql(corners, source, keys, colors=("r", "g", "b")):
    """SQL: vertices of quads; corners are four (x, y, alpha) over a row of ``source``."""
    pick = lambda i: "CASE vertex " + " ".join(f"WHEN {v} THEN {corners[c][i]}" for v, c in enumerate(R.QUAD)) + " END"
    return (f"SELECT {keys}, vertex, round(({pick(0)}) / 25.0::DOUBLE * 2 - 1, 6) AS x, round(1 - ({pick(1)}) / 20.0::DOUBLE * 2, 6) AS y, "
            + ", ".join(f"round({c} / 255.0::DOUBLE, 6) AS {n}" for c, n in zip(colors, ("red", "green", "blue"))) + f", round(least(1, greatest(0, CAST(({pick(2)}) AS DOUBLE))), 6) AS alpha FROM {source} q, range(0, 6) vv(vertex)")


def _box_sql(x0, y0, x1, y1, alpha):
    return [(x0, y0, alpha), (x1, y0, alpha), (x1, y1, alpha), (x0, y1, alpha)]


def _surface_sql():
    """Cells of 15 pixels: 15 wide ones are cut in two, the last ones of 10 or 5 not."""
    cells15 = "cells AS (SELECT f, (y // 15) * 2 + x // 15 AS cell, x // 15 AS cx, y // 15 AS cy, " + ", ".join(f"sum({c}) // count(*) AS {c}" for c in "bgr") + " FROM pixel GROUP BY 1, 2, 3, 4)"
    wide = WIDE.replace(CELLS, cells15)
    cut = f"""{wide}, cu AS (SELECT *, (cx * 15 + 0.0) AS x0, (cy * 15 + 0.0) AS y0, least(25, cx * 15 + 15) - cx * 15 AS w, least(20, cy * 15 + 15) - cy * 15 AS h FROM wide), cv AS (SELECT *, CASE WHEN w >= 14 THEN 2 ELSE 1 END AS nx, CASE WHEN h >= 14 THEN 2 ELSE 1 END AS ny FROM cu),
      ce AS (SELECT * FROM cv, range(0, 2) a(sx), range(0, 2) b(sy) WHERE sx < nx AND sy < ny), cs AS (SELECT f, cell, sy * nx + sx AS piece, x0, y0, w, h, nx, ny, sx, sy, {", ".join(f"{_shown(c, '((sx + 0.5::DOUBLE) / nx)', '((sy + 0.5::DOUBLE) / ny)')} AS {c}" for c in "bgr")} FROM ce)"""
    at = lambda v, n, s: f"({v} + {'w' if n == 'nx' else 'h'} * {s} / CAST({n} AS DOUBLE))"
    return f"AND {cut} " + _quad_sql(_box_sql(at("x0", "nx", "sx"), at("y0", "ny", "sy"), at("x0", "nx", "(sx + 1)"), at("y0", "ny", "(sy + 1)"), "0.32::DOUBLE"), "cs", "f, cell, piece")


@query(_surface_sql())
def surface_vertices(spark, d):
    return _clip(R.surface_vertices(S.grid_means(event_raster(spark, d), 15, W), 15, W, H, 32), ["f", "cell", "piece"])


def _residual_sql(keys="f, x AS px, y AS py"):
    base = f"""{TILES}, rv AS (SELECT f, x AS px, y AS py, b, g, r, opacity / 255.0::DOUBLE AS a, x + 0.0::DOUBLE AS x0, y + 0.0::DOUBLE AS y0, x + w + 0.0::DOUBLE AS x1, y + h + 0.0::DOUBLE AS y1, greatest(2, least(7, 0.33::DOUBLE * least(w, h))) AS m FROM ti)"""
    u0, v0, u1, v1 = "(x0 + m)", "(y0 + m)", "(x1 - m)", "(y1 - m)"
    sides = [
        _box_sql(u0, v0, u1, v1, "a"), [("x0", "y0", "0"), ("x1", "y0", "0"), (u1, v0, "a"), (u0, v0, "a")], [(u0, v1, "a"), (u1, v1, "a"), ("x1", "y1", "0"), ("x0", "y1", "0")],
        [("x0", "y0", "0"), (u0, v0, "a"), (u0, v1, "a"), ("x0", "y1", "0")], [(u1, v0, "a"), ("x1", "y0", "0"), ("x1", "y1", "0"), (u1, v1, "a")]]
    large = f"(SELECT * FROM rv WHERE {u1} > {u0} AND {v1} > {v0})"
    parts = [f"SELECT f, px, py, vertex + {6 * n} AS vertex, x, y, red, green, blue, alpha FROM ({_quad_sql(side, large, 'f, px, py')})" for n, side in enumerate(sides)]
    small = _quad_sql(_box_sql("x0", "y0", "x1", "y1", "0.55::DOUBLE * a"), f"(SELECT * FROM rv WHERE NOT ({u1} > {u0} AND {v1} > {v0}))", "f, px, py")
    return base, " UNION ALL ".join([*parts, f"SELECT * FROM ({small})"])


@query("AND " + " ".join(_residual_sql()))
def residual_vertices(spark, d):
    return _clip(R.residual_vertices(_patches(spark, d), W, H), ["f", "px", "py"])


ATTRIBUTES = {"b": "z * 11", "g": "z * 5", "r": "255 - z * 10", "intensity": "40 + z * 9", "width": "4 + z % 14", "glow": "z * 3 % 32", "opacity": "120 + z * 5"}


def _drawn(spark, d):
    return T.resample(_paths(spark, d), 9).selectExpr("f", "z", "points", *[f"{v} AS {k}" for k, v in ATTRIBUTES.items()])


def _stroke_sql(glow):
    pts = "qs AS (SELECT f, y AS z, i, max(CASE WHEN x = CAST(round_even(i * 24 / 8.0::DOUBLE, 0) AS BIGINT) THEN b END) AS py, CAST(round_even(i * 24 / 8.0::DOUBLE, 0) AS BIGINT) AS px FROM pixel, range(0, 9) t(i) GROUP BY f, y, i)"
    color = lambda c: f"CAST(least(255, greatest(0, round_even(({ATTRIBUTES[c]}) * (1.08::DOUBLE + 0.28::DOUBLE * ({ATTRIBUTES['intensity']}) / 255), 0))) AS BIGINT)" if glow else f"({ATTRIBUTES[c]})"
    core = f"greatest(1.0::DOUBLE, ({ATTRIBUTES['width']}) / 4.0::DOUBLE)"
    half = f"({core} + ({ATTRIBUTES['glow']})) / 2" if glow else f"{core} / 2"
    alpha = f"({ATTRIBUTES['opacity']}) / 255.0::DOUBLE" + (f" * least(0.32::DOUBLE, greatest(0.08::DOUBLE, ({ATTRIBUTES['glow']}) / 28.0::DOUBLE))" if glow else "")
    seg = f"""{pts}, sg AS (SELECT *, sqrt(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE)) AS len FROM (SELECT f, z, i AS seg, px AS ax, py AS ay, lead(px) OVER w AS bx, lead(py) OVER w AS by_, {", ".join(f"{color(c)} AS {c}" for c in "bgr")}, {half} AS hw, {alpha} AS a FROM qs WINDOW w AS (PARTITION BY f, z ORDER BY i)) WHERE bx IS NOT NULL),
      sn AS (SELECT *, -(by_ - ay) / len * hw AS nx, (bx - ax) / len * hw AS ny FROM sg WHERE len >= 0.001)"""
    return f"AND {seg} " + _quad_sql([("ax + nx", "ay + ny", "a"), ("bx + nx", "by_ + ny", "a"), ("bx - nx", "by_ - ny", "a"), ("ax - nx", "ay - ny", "a")], "sn", "f, z, seg")


@query(_stroke_sql(False))
def stroke_vertices(spark, d):
    return _clip(R.stroke_vertices(_drawn(spark, d), W, H, False), ["f", "z", "seg"])


@query(_stroke_sql(True))
def stroke_glow_vertices(spark, d):
    return _clip(R.stroke_vertices(_drawn(spark, d), W, H, True), ["f", "z", "seg"])


def _stroke_frame_sql():
    core, glow = (_stroke_sql(g)[4:] for g in (False, True))
    cut = core.index(" SELECT f, z, seg")
    surface = _surface_sql()[4:].replace("cells AS", "cells15 AS").replace(" FROM cells,", " FROM cells15,").replace(" FROM cells a ", " FROM cells15 a ").replace("corner AS", "corner15 AS").replace("JOIN corner ", "JOIN corner15 ").replace("wide AS", "wide15 AS").replace("FROM wide)", "FROM wide15)")
    s_cut = surface.index(" SELECT f, cell, piece")
    base, patches = _residual_sql()
    rename = lambda q: q.replace("qs AS", "qs2 AS").replace("FROM qs ", "FROM qs2 ").replace("sg AS", "sg2 AS").replace("FROM sg ", "FROM sg2 ").replace("sn AS", "sn2 AS").replace("FROM sn ", "FROM sn2 ")
    g_cut = rename(glow).index(" SELECT f, z, seg")
    body = [f"SELECT f, 0 AS layer, cell AS item, piece AS part, vertex, x, y, red, green, blue, alpha FROM ({surface[s_cut:]})", f"SELECT f, 1, py, px, vertex, x, y, red, green, blue, alpha FROM ({patches})",
            f"SELECT f, 2, z, seg, vertex, x, y, red, green, blue, alpha FROM ({rename(glow)[g_cut:]})", f"SELECT f, 3, z, seg, vertex, x, y, red, green, blue, alpha FROM ({core[cut:]})"]
    return f"AND {surface[:s_cut]}, {base}, {core[:cut]}, {rename(glow)[:g_cut]} " + " UNION ALL ".join(body)


@query(_stroke_frame_sql())
def stroke_gpu_frame(spark, d):
    cells = S.grid_means(event_raster(spark, d), 15, W)
    return _clip(R.stroke_frame(cells, _drawn(spark, d), _patches(spark, d), 15, W, H, 32), ["f", "layer", "item", "part"])


GRID = "gd AS (SELECT f, x * 6 // 25 AS cx, y * 4 // 20 AS cy, " + ", ".join(f"CAST(round_even(sum({c}) / CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS {c}" for c in "bgr") + " FROM pixel GROUP BY 1, 2, 3)"


@query(f"AND {GRID} " + _quad_sql(_box_sql("cx * 25 / 6.0::DOUBLE", "cy * 20 / 4.0::DOUBLE", "(cx + 1) * 25 / 6.0::DOUBLE", "(cy + 1) * 20 / 4.0::DOUBLE", "1"), "gd", "f, cx, cy"))
def backdrop_triangles(spark, d):
    return _clip(R.backdrop(backdrop_grid(spark, d), 6, 4, W, H), ["f", "cx", "cy"])


@query(f"""AND {REGIONS}, {GRID} SELECT f, 0 AS layer, cy * 6 + cx AS item, vertex // 3 AS part, vertex % 3 AS corner, x, y, red, green, blue FROM ({_quad_sql(_box_sql("cx * 25 / 6.0::DOUBLE", "cy * 20 / 4.0::DOUBLE", "(cx + 1) * 25 / 6.0::DOUBLE", "(cy + 1) * 20 / 4.0::DOUBLE", "1"), "gd", "f, cx, cy")})
  UNION ALL SELECT f, 1, z, tri, corner, round(px / 25.0::DOUBLE * 2 - 1, 6), round(1 - py / 20.0::DOUBLE * 2, 6), round(mean_r / 255.0::DOUBLE, 6), round(mean_g / 255.0::DOUBLE, 6), round(mean_b / 255.0::DOUBLE, 6) FROM (SELECT f, z, tri, corner, mean_r, mean_g, mean_b, CASE WHEN corner = 0 THEN l WHEN (tri, corner) = (0, 1) THEN r WHEN (tri, corner) = (1, 2) THEN l ELSE r END AS px,
  CASE WHEN corner = 0 THEN t WHEN (tri, corner) = (0, 1) THEN t WHEN (tri, corner) = (1, 2) THEN b ELSE b END AS py FROM reg, range(0, 2) a(tri), range(0, 3) c(corner))""")
def region_gpu_frame(spark, d):
    regions = _texted(spark, d).select("f", "z", "points", F.col("mean_b").alias("b"), F.col("mean_g").alias("g"), F.col("mean_r").alias("r"))
    v = R.region_frame(regions, backdrop_grid(spark, d), 6, 4, W, H)
    return v.select("f", "layer", "item", "part", "corner", *[r6(F.col(c), c) for c in ("x", "y", "red", "green", "blue")])


@query(f"AND {REGIONS} SELECT count(DISTINCT f) AS frames, count(*) AS regions, count(*) FILTER (WHERE z % 5 = 0) AS corrections, CAST(4 * count(*) AS BIGINT) AS points, count(DISTINCT CASE WHEN z % 5 <> 0 THEN component + 1 END) AS tracks FROM reg")
def info_summary(spark, d):
    return SU.regions(_texted(spark, d))


@query(f"AND {REGIONS} SELECT f, count(*) AS regions, count(*) FILTER (WHERE z % 5 = 0) AS corrections, CAST(4 * count(*) AS BIGINT) AS points FROM reg GROUP BY f")
def frame_stats(spark, d):
    return SU.per_frame(_texted(spark, d))


@query("""SELECT vec_id, label FROM (SELECT e.vec_id, c.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 9), c.label) AS rn FROM embeddings e,
  (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) WHERE i = 1) c) WHERE rn = 1""", raster=False)
def embedding_nearest_center(spark, d):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label")
    # one centre a label, of which there are ten
    c = e.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("i = 1").agg(F.collect_list(F.struct("label", "embedding")).alias("c"))
    dist = "round(aggregate(zip_with(embedding, x.embedding, (a, b) -> (double(a) - double(b)) * (double(a) - double(b))), 0D, (s, v) -> s + v), 9)"
    return e.drop("label").crossJoin(F.broadcast(c)).select("vec_id", F.expr(f"array_min(transform(c, x -> struct({dist} AS d, x.label AS label))).label").alias("label"))


@query("""SELECT c_mktsegment, o_orderkey, o_totalprice, rank FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3""", raster=False)
def orders_topk_per_segment(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    return T.top_k(o.join(c, o.o_custkey == c.c_custkey), ["c_mktsegment"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("c_mktsegment", "o_orderkey", "o_totalprice", "rank")


@query("SELECT f, k, printf('%02X%02X%02X', r, g, b) AS hex FROM pixel")
def hex_colors(spark, d):
    return event_raster(spark, d).select("f", "k", X.hex_color().alias("hex"))


@query("SELECT f, k, " + ", ".join(f"CAST(least(255, greatest(0, round_even({c} * (1.08::DOUBLE + 0.28::DOUBLE * g / 255), 0))) AS BIGINT) AS {c}" for c in "br") + " FROM pixel")
def glow_boost(spark, d):
    return event_raster(spark, d).select("f", "k", *[X.glow_boost(c, "g").cast("int").alias(c) for c in "br"])


@query("""AND s AS (SELECT f, y AS z, max(b) AS l, max(g) AS i, max(r) AS o FROM pixel GROUP BY 1, 2) SELECT f, z, round(l * (0.6::DOUBLE + i / 255.0::DOUBLE) * (o / 255.0::DOUBLE), 6) AS priority FROM s""")
def stroke_priorities(spark, d):
    s = event_raster(spark, d).groupBy("f", F.col("y").alias("z")).agg(F.max("b").alias("l"), F.max("g").alias("i"), F.max("r").alias("o"))
    return s.select("f", "z", r6(X.stroke_priority("l", "i", "o"), "priority"))


def _match_sql():
    one = """(SELECT f{shift} AS f, y AS z, max(CASE WHEN x = 0 THEN b END) AS b0, max(CASE WHEN x = 24 THEN b END) AS b1, avg(b) AS cy, min(b) AS t, max(b) + 1 AS lo, CAST(round_even(avg(b), 0) AS BIGINT) AS mb, CAST(round_even(avg(g), 0) AS BIGINT) AS mg, CAST(round_even(avg(r), 0) AS BIGINT) AS mr,
      sum(len) AS len FROM (SELECT *, sqrt(CAST(1 + (b - lag(b) OVER (PARTITION BY f, y ORDER BY x)) * (b - lag(b) OVER (PARTITION BY f, y ORDER BY x)) AS DOUBLE)) AS len FROM pixel) GROUP BY f, y)"""
    diagonal = f"sqrt({W * W + H * H}.0::DOUBLE)"
    ends = "least(abs(a.b0 - p.b0) + abs(a.b1 - p.b1), sqrt(576.0::DOUBLE + (a.b0 - p.b1) * (a.b0 - p.b1)) + sqrt(576.0::DOUBLE + (a.b1 - p.b0) * (a.b1 - p.b0))) / 2"
    ih = "greatest(0, least(a.lo, p.lo) - greatest(a.t, p.t))"
    iou = f"CASE WHEN {ih} > 0 THEN 25 * {ih} / CAST(25 * (a.lo - a.t) + 25 * (p.lo - p.t) - 25 * {ih} AS DOUBLE) ELSE 0 END"
    return f"""SELECT a.f, a.z, round(0.30::DOUBLE * abs(a.cy - p.cy) / {diagonal} + 0.25::DOUBLE * ({ends}) / {diagonal} + 0.20::DOUBLE * sqrt(CAST((a.mb - p.mb) * (a.mb - p.mb) + (a.mg - p.mg) * (a.mg - p.mg) + (a.mr - p.mr) * (a.mr - p.mr) AS DOUBLE)) / 441.67295593::DOUBLE
      + 0.15::DOUBLE * (1 - {iou}) + 0.10::DOUBLE * least(1, greatest(0, abs(ln((a.len + 1) / (p.len + 1))) / 2.2::DOUBLE)), 6) AS score FROM {one.format(shift="")} a JOIN {one.format(shift=" + 1")} p ON a.f = p.f AND a.z = p.z"""


@query(_match_sql())
def stroke_match_scores(spark, d):
    colors = event_raster(spark, d).groupBy("f", F.col("y").alias("z")).agg(*[F.expr(f"int(bround(avg({c}), 0))").alias(f"m{c}") for c in "bgr"])
    now = _paths(spark, d).join(colors, ["f", "z"]).select("*", X.bounds().alias("q"), X.vertex_mean().alias("m"), X.path_length().alias("len"))
    before = now.select((F.col("f") + 1).alias("f"), "z", *[F.col(c).alias(f"p_{c}") for c in ("points", "mb", "mg", "mr", "q", "m", "len")])
    both = now.join(before, ["f", "z"])
    center = F.sqrt((F.col("m.x") - F.col("p_m.x")) ** 2 + (F.col("m.y") - F.col("p_m.y")) ** 2)
    iou = X.intersection_over_union([F.col(f"q.{k}") for k in "ltrb"], [F.col(f"p_q.{k}") for k in "ltrb"])
    color = X.distance(["mb", "mg", "mr"], ["p_mb", "p_mg", "p_mr"])
    score = X.stroke_match_score(center, X.endpoint_distance("points", "p_points"), (W * W + H * H) ** 0.5, color, iou, "len", "p_len")
    return both.select("f", "z", r6(score, "score"))


@query("SELECT p_partkey, regexp_replace(printf('%.3f', round(p_retailprice / 7, 3)), '\\.?0+$', '') AS text FROM part", raster=False)
def number_texts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.number_text(F.col("p_retailprice") / 7).alias("text"))


ENDINGS = ("lvf", "LVFZ", "lvfb", "LvfBz", "lvfs", "lvfsz", "mp4", "lvfx")


@query("SELECT p_partkey, path, lower(split_part(path, '.', 2)) IN ('lvfz', 'lvfb', 'lvfbz') AS packed, lower(split_part(path, '.', 2)) IN ('lvfb', 'lvfbz') AS is_binary, lower(split_part(path, '.', 2)) IN ('lvfs', 'lvfsz') AS stroke FROM (SELECT p_partkey, '/a/b' || p_partkey || '.' || list_extract(["
       + ", ".join(f"'{e}'" for e in ENDINGS) + "], CAST(p_partkey % 8 AS INTEGER) + 1) AS path FROM part)", raster=False)
def path_kinds(spark, d):
    ends = F.array(*[F.lit(e) for e in ENDINGS])
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("/a/b"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(ends, (F.col("p_partkey") % 8).cast("int") + 1)).alias("path"))
    return p.select("p_partkey", "path", X.is_packed_path("path").alias("packed"), X.is_binary_path("path").alias("is_binary"), X.is_stroke_path("path").alias("stroke"))


@query(f"AND {REGIONS}, {WIDE}, own AS (SELECT q.f, q.z, p.k FROM {_at_sql('(SELECT f, k, x, y FROM pixel)')} p JOIN reg q ON p.f = q.f AND p.x >= q.l AND p.x < q.r AND p.y >= q.t AND p.y < q.b WHERE sqrt(CAST((p.pb - q.mean_b) * (p.pb - q.mean_b) + (p.pg - q.mean_g) * (p.pg - q.mean_g) + (p.pr - q.mean_r) * (p.pr - q.mean_r) AS DOUBLE)) <= 40) SELECT f, z, count(*) AS pixels FROM own GROUP BY 1, 2")
def owned_pixels(spark, d):
    """How many pixels of a region's box the surface shows in about the region's colour."""
    pixel = event_raster(spark, d)
    shown = S.display_at(pixel.select("f", "k", "x", "y"), S.grid_means(pixel, CELL, W), CELL, W, H)
    boxes = RE._on_tiles(_regions(spark, d))
    covers = "x >= l AND x < r AND y >= t AND y < b"
    hit = RE._tiled(shown).join(boxes, ["f", "_tx", "_ty"]).where(covers).where(X.belongs(["pb", "pg", "pr"], ["mean_b", "mean_g", "mean_r"], 40.0))
    return hit.groupBy("f", "z").agg(F.count("*").alias("pixels"))


def _knobs(p):
    """Knobs over their whole ranges, from the part numbers."""
    k = {"q": "p_partkey % 100 + 1", "c": "p_partkey * 7 % 101", "p": "p_partkey % 128 + 1", "d": "p_partkey * 3 % 101", "o": "p_partkey * 11 % 101", "k": "p_partkey * 13 % 101", "s": "p_partkey * 17 % 101", "n": "p_partkey * 19 % 101",
         "r": "p_partkey * 23 % 101", "w": "160 + p_partkey % 1800", "h": "120 + p_partkey * 5 % 1000", "e": "p_partkey * 13 % 5000 + 1"}
    return ", ".join(f"{v} AS {n}" for n, v in k.items()) if p is None else p.selectExpr("p_partkey", *[f"{v} AS {n}" for n, v in k.items()])


def _formulas(knobs):
    """(name, the engine's formula over the knobs, numbers or columns, and the same in SQL)."""
    q, c, p, d, o, k, s, n, r, w, h, e = knobs
    area, cl = "greatest(4.0, w * h * (0.00005 + (100 - q) * 0.000035))", lambda v, a, b: f"least({b}, greatest({a}, {v}))"
    even, cut = lambda v: f"round_even({v}, 0)", lambda a, b: f"trunc(({a}) / {b}.0)"
    rounded = lambda base, slope, a, b: cl(even(f"{base} + {slope} * (100 - q)"), a, b)
    soft, base = "greatest(0.65, (101 - q) / 15.0)", cl(even("72 - 0.42 * q"), 24, 58)
    error = f"greatest(3.0, 0.45 * {area} * {cl('1 + 0.025 * (100 - c)', '1.0', '3.5')})"
    plain = f"greatest(3.0, 0.45 * {area} * {cl('1 + 0.025 * (100 - 100)', '1.0', '3.5')})"
    scale = lambda hi: cl("sqrt(w * h / 2073600.0)", "0.75", hi)
    A = P.min_region_area(q, w, h)
    B = P.error_area(A)
    return [
        ("palette_size", P.palette_size(q), cl(even("8 + 0.34 * q"), 8, 48)), ("min_region_area", A, area), ("merged_region_area", P.merged_region_area(A), f"greatest(36.0, 0.08 * {area})"),
        ("simplify_tolerance", P.simplify_tolerance(q), soft), ("neighbor_merge", P.neighbor_merge(q), rounded(4, 0.08, 4, 9)), ("blurred_boundary", P.blurred_boundary(q), rounded(13, 0.14, 12, 22)),
        ("blurred_region", P.blurred_region(q), rounded(8, "0.1", 8, 16)), ("color_step", P.color_step(q), rounded(6, 0.08, 6, 12)),
        ("palette_fit", P.palette_fit(q, p), cl(even("20 + 0.18 * (100 - q) + 0.04 * greatest(0, p - 36)"), 20, 34)), ("guided_region", P.guided_region(q, p), cl(even("15 + 0.16 * (100 - q) + 0.035 * greatest(0, p - 36)"), 15, 26)),
        ("guided_large_region", P.guided_large_region(q), rounded(7, 0.08, 7, 12)), ("guided_boundary", P.guided_boundary(q, p), cl(even("14 + 0.13 * (100 - q) + 0.03 * greatest(0, p - 36)"), 14, 24)),
        ("absorb_limit", P.absorb_limit(A), cl(even(f"0.55 * {area}"), 128, 1200)), ("error_threshold", P.error_threshold(q, c), cl(f"{base} + {even('0.28 * (100 - c)')}", base, 76)),
        ("error_area", P.error_area(A, c), error), ("error_simplify", P.error_simplify(P.simplify_tolerance(q)), f"greatest(0.45, 0.75 * {soft})"),
        ("max_error_regions", P.max_error_regions(q, c), f"greatest(0, {even(cl('3 * q - 150', 36, 180) + ' * c / 100.0')})"), ("max_error_bins", P.max_error_bins(q, c), f"greatest(1, {even(cl(cut('q - 34', 4), 6, 18) + ' * ' + cl('c / 100.0', '0.15', '1.0'))})"),
        ("detail_min_bounds", P.detail_min_bounds(q, d), cl(even("48 - 0.18 * q - 0.15 * d"), 16, 42)), ("detail_threshold", P.detail_threshold(q, d), cl("42 - 0.16 * q - 0.18 * d", "12.0", "34.0")),
        ("detail_owner", P.detail_owner(q, d), cl("8 + 0.04 * (100 - q) + 0.03 * d", "8.0", "14.0")),
        ("detail_source_area", P.detail_source_area(A, w, h, d), f"greatest({area} * {cl('12 - 0.06 * d', '5.0', '12.0')}, w * h * {cl('0.003 - 0.000015 * d', '0.0012', '0.003')})"),
        ("detail_bin_pixels", P.detail_bin_pixels(B, d), f"greatest(14, {even(plain + ' * ' + cl('0.12 - 0.0007 * d', '0.045', '0.12'))})"), ("detail_area", P.detail_area(B, d), f"greatest(18.0, {plain} * {cl('0.16 - 0.0008 * d', '0.06', '0.16')})"),
        ("detail_simplify", P.detail_simplify(P.simplify_tolerance(q), d), cl(f"0.6 * {soft} - 0.003 * d", "0.35", "1.1")), ("max_detail_sources", P.max_detail_sources(d), cl(f"8 + {cut('d', 3)}", 8, 36)),
        ("max_detail_bins", P.max_detail_bins(d), cl(f"2 + {cut('d', 12)}", 3, 10)), ("max_detail_regions", P.max_detail_regions(q, d), f"CASE WHEN d <= 0 THEN 0 ELSE {cl('24 + ' + cut('q', 2) + ' + d', 48, 220)} END"),
        ("motion_threshold", P.motion_threshold(o), cl(even("44 - 0.22 * o"), 18, 44)), ("dark_luminance", P.dark_luminance(k), "12 + 0.45 * k"), ("dark_base_factor", P.dark_base_factor(k), "1.5 + 0.095 * k"),
        ("dark_residual_factor", P.dark_residual_factor(k), "1.8 + 0.08 * k"), ("backdrop_columns", P.backdrop_columns(q, w), cl("CASE WHEN q >= 92 THEN 64 WHEN q >= 70 THEN 48 ELSE 32 END", 1, "greatest(1, w)")),
        ("surface_cell", P.surface_cell(q, s, w, h), cl(even(f"(25 - 0.15 * s - 0.055 * q) * {scale('1.35')}"), 7, 32)), ("surface_delta", P.surface_delta(q, s), cl(f"20 - {cut('q', 9)} - {cut('s', 12)}", 5, 18)),
        ("stroke_min_pixels", P.stroke_min_pixels(q, n, w, h), cl(even(f"(12 - 0.045 * q - 0.035 * n) * {scale('1.4')}"), 3, 14)), ("stroke_min_length", P.stroke_min_length(q, n, w, h), cl("sqrt(CAST(w * w + h * h AS DOUBLE)) * (0.006 - 0.000018 * q - 0.000014 * n)", "4.0", "20.0")),
        ("stroke_simplify", P.stroke_simplify(q, n), cl("2.7 - 0.012 * q - 0.004 * n", "0.7", "2.8")), ("max_strokes", P.max_strokes(n, w, h), cl(even("150 + 9 * n + 110 * w * h / 1000000.0"), 120, 1500)),
        ("max_stroke_points", P.max_stroke_points(n, w, h), cl(even("5200 + 105 * n + 1450 * w * h / 1000000.0"), 5000, 26000)), ("points_per_stroke", P.points_per_stroke(q, n), cl(f"70 + q + {cut('n', 2)}", 90, 230)),
        ("max_hatches", P.max_hatches(s, w, h), cl(even("220 + 12 * s + 260 * w * h / 1000000.0"), 220, 1800)), ("residual_threshold", P.residual_threshold(q, r), cl(f"46 - {cut('q', 5)} - {cut('r', 3)}", 12, 42)),
        ("max_residuals", P.max_residuals(r, w, h), cl(even("r * (2.8 + w * h / 1000000.0)"), 0, 900)),
        ("keep_count", P.keep_count(e, q, n), cl(even("e * (0.012 + 0.00075 * n + 0.00022 * q)"), f"greatest(1, {cut('e', 300)}, least(80, greatest(1, {cut('e', 300)}, {cut('e', 6)})))", f"greatest(1, {cut('e', 300)}, {cut('e', 6)})")),
    ]


#: Added before rounding, so that no formula's value lies halfway between two decimals.
NUDGE = 3.33333e-08


def quality_params(spark, d):
    """All formulas of the quality knobs, over knobs of many values."""
    return _knobs(spark.read.parquet(f"{d}/part.parquet").select("p_partkey")).select("p_partkey", *[F.round(v.cast("double") + NUDGE, 6).alias(name) for name, v, _ in _formulas([F.col(x) for x in "qcpdoksnrwhe"])])


def _params_sql():
    import re

    parts = ", ".join(f"round(CAST({re.sub(r'(?<![0-9.])[0-9]+[.][0-9]+', lambda m: m[0] + '::DOUBLE', sql)} AS DOUBLE) + {NUDGE!r}::DOUBLE, 6) AS {name}" for name, _, sql in _formulas([50] * 12))
    return f"SELECT p_partkey, {parts} FROM (SELECT p_partkey, {_knobs(None)} FROM part)"


QUERIES["quality_params"], ORACLES["quality_params"] = quality_params, _params_sql()
