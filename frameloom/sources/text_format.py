"""Region and edge text: lines to rows and back, with DataFrame expressions.

A file's lines carry their ordinal; frames are islands between FRAME and END.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

# The first lines that tell the text formats, and what they are called.
REGION_SIGNATURE, EDGE_SIGNATURE = "LVFVF2", "LVFVF1"
REGION_FORMAT, EDGE_FORMAT, LEGACY_FORMAT = "LVFVF2 traced regions", "LVFVF1 edge paths", "legacy point stream"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of text files, in order; blank lines and those that start with # are skipped."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return lines.select("path", "n", F.trim("line").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))


def fail(test: Column, message, value: Column) -> Column:
    """``value``, or an error where ``test`` holds."""
    return F.when(test, F.raise_error(F.lit(message) if isinstance(message, str) else message).cast("string")).otherwise(value)


def whole(c: Column) -> Column:
    """A whole number, or an error."""
    return F.coalesce(c.try_cast("int"), F.raise_error(F.concat(F.lit("not a whole number: "), F.coalesce(c, F.lit("nothing")))).cast("int"))


def headers(lines: DataFrame) -> DataFrame:
    """(path, format, fps, width, height, quality, palette) of text files, by their first lines; an unknown or broken header is an error.

    Region files have FPS, SIZE, QUALITY and PALETTE lines, edge files the first
    two; a legacy file's only header line is ``fps,width,height``. Names are
    read in capitals or not. Quality and palette are 0 where a format has none.
    """
    first = lines.withColumn("_i", F.row_number().over(Window.partitionBy("path").orderBy("n"))).where("_i <= 5")
    head = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_i", "line"))).alias("h")).select("path", F.transform("h", lambda x: x["line"]).alias("h"))
    kind = F.upper(F.col("h")[0])
    old = F.filter(F.transform(F.split(F.col("h")[0], ","), lambda v: F.trim(v)), lambda v: v != "")
    kind = F.when(kind == REGION_SIGNATURE, REGION_FORMAT).when(kind == EDGE_SIGNATURE, EDGE_FORMAT).when(F.size(old) == 3, LEGACY_FORMAT)
    told = head.select("path", fail(kind.isNull(), "unknown format", kind).alias("format"), "h", old.alias("old"))

    def named(i: int, name: str, values: int) -> Column:
        parts = F.split(F.try_element_at("h", F.lit(i + 1)), " +")
        good = (F.size(parts) == values + 1) & (F.upper(parts[0]) == name)
        return F.when(F.coalesce(good, F.lit(False)), parts).otherwise(F.raise_error(F.lit(f"invalid {name} line")).cast("array<string>"))

    is_old, is_region = F.col("format") == LEGACY_FORMAT, F.col("format") == REGION_FORMAT
    fps = F.when(is_old, F.col("old")[0]).otherwise(named(1, "FPS", 1)[1])
    size = lambda i: whole(F.when(is_old, F.col("old")[i]).otherwise(named(2, "SIZE", 2)[i]))
    number = lambda i, name: F.when(is_region, whole(named(i, name, 1)[1])).otherwise(0)
    fps = F.coalesce(fps.try_cast("double"), F.raise_error(F.lit("invalid FPS line")).cast("double"))
    return told.select("path", "format", fps.alias("fps"), size(1).alias("width"), size(2).alias("height"), number(3, "QUALITY").alias("quality"), number(4, "PALETTE").alias("palette"))


def points(c: str) -> str:
    """SQL: space-separated ``x,y`` tokens to points."""
    return f"transform(filter(split({c}, ' +'), t -> t <> ''), t -> struct(int(split(t, ',')[0]) AS x, int(split(t, ',')[1]) AS y))"


def points_text(c: str) -> str:
    return f"array_join(transform({c}, p -> concat(p.x, ',', p.y)), ' ')"


def region_line(id_: str, rgb: tuple[str, str, str], pts: str) -> str:
    """SQL: a REGION line."""
    return f"concat_ws(' ', 'REGION', {id_}, {', '.join(rgb)}, size({pts}), {points_text(pts)})"


def path_line(pts: str) -> str:
    """SQL: a PATH line."""
    return f"concat_ws(' ', 'PATH', size({pts}), {points_text(pts)})"


def background_line(rgb: tuple[str, str, str]) -> str:
    """SQL: a BACKGROUND line."""
    return f"concat_ws(' ', 'BACKGROUND', {', '.join(rgb)})"


def framed(lines: DataFrame, known: tuple[str, ...], header: int) -> DataFrame:
    """(path, f, n, word, line) of the lines in frames, FRAME lines too, numbered by position; ``header`` lines before them are left out.

    A line that is none of ``known``, one outside a frame, a frame within a
    frame and a frame without END are errors.
    """
    at = Window.partitionBy("path").orderBy("n")
    word = F.upper(F.split("line", " ")[0])
    body = lines.withColumn("_i", F.row_number().over(at)).where(F.col("_i") > header).withColumn("word", word)
    opened = F.sum((F.col("word") == "FRAME").cast("int")).over(at)
    closed = F.coalesce(F.sum((F.col("word") == "END").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = body.withColumn("f", (opened - 1).cast("int")).withColumn("_open", opened - closed).withColumn("_last", F.last("word").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    fault = (
        F.when(~F.col("word").isin("FRAME", "END", *known), F.concat(F.lit("unexpected line: "), "line"))
        .when(F.col("_open") != 1, F.concat(F.lit("line outside a frame, or END is missing before: "), "line")).when(F.col("_last") != "END", F.lit("a frame ended before END")))
    return body.select("path", "f", "n", fail(fault.isNotNull(), fault, F.col("word")).alias("word"), "line")


def numbered(c: str, skip: int) -> Column:
    """The points of an array of tokens from its place ``skip`` on; a token that isn't ``x,y`` is an error."""
    pair = F.transform(F.slice(c, skip + 1, F.greatest(F.size(c) - skip, F.lit(0))), lambda t: F.split(t, ","))
    checked = F.transform(pair, lambda t: F.struct(*[whole(F.trim(fail(F.size(t) != 2, "invalid point", t[i]))).alias(n) for i, n in ((0, "x"), (1, "y"))]))
    return checked


def counted(points_: Column, declared: Column) -> Column:
    return F.when(F.size(points_) == declared, points_).otherwise(F.raise_error(F.lit("points don't match their count")).cast("array<struct<x:int,y:int>>"))


def byte(c: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), whole(c)))


def parse_regions(lines: DataFrame, header: int = 5) -> DataFrame:
    """(path, f, z, id, r, g, b, points, area, is_correction) of region lines with frames numbered by position.

    A line that is none of the format's, a frame without END, and a count that
    differs from the points are errors. Colours are clamped to 0..255.
    """
    body = framed(lines, ("BACKGROUND", "BACKDROP", "REGION"), header)
    parts = body.where(F.col("word") == "REGION").withColumn("p", F.split("line", " +"))
    parts = parts.withColumn("p", F.when(F.size("p") >= 6, F.col("p")).otherwise(F.raise_error(F.lit("invalid REGION line")).cast("array<string>")))
    rows = parts.select(
        "path", "f", "n", whole(F.col("p")[1]).alias("id"), *[byte(F.col("p")[i]).alias(c) for i, c in ((2, "r"), (3, "g"), (4, "b"))], counted(numbered("p", 6), whole(F.col("p")[5])).alias("points"))
    z = (F.row_number().over(Window.partitionBy("path", "f").orderBy("n")) - 1).alias("z")
    return rows.select("path", "f", z, "id", "r", "g", "b", "points", F.abs(X.ring_area()).alias("area"), (F.col("id") == 0).alias("is_correction"))


def parse_frames(lines: DataFrame, header: int = 5) -> DataFrame:
    """(path, f, back_r, back_g, back_b, cols, rows, backdrop) of a region file's frames, those without regions too.

    The background is black and the backdrop null where a frame has none; the
    last of several holds. ``backdrop`` has cols x rows hexadecimal colours.
    """
    body = framed(lines, ("BACKGROUND", "BACKDROP", "REGION"), header)
    last = lambda word: F.max_by("line", F.when(F.col("word") == word, F.col("n")))
    frames = body.groupBy("path", "f").agg(last("BACKGROUND").alias("back"), last("BACKDROP").alias("drop"))
    frames = frames.select("path", "f", F.split("back", " +").alias("back"), F.split("drop", " +").alias("drop"))
    back = F.when(F.size("back") == 4, F.col("back")).otherwise(F.raise_error(F.lit("invalid BACKGROUND line")).cast("array<string>"))
    color = lambda i: F.when(F.col("back").isNull(), 0).otherwise(byte(back[i]))
    side = lambda i: F.when(F.col("drop").isNotNull(), whole(F.try_element_at("drop", F.lit(i + 1))))
    told = frames.select("path", "f", color(1).alias("back_r"), color(2).alias("back_g"), color(3).alias("back_b"), side(1).alias("cols"), side(2).alias("rows"), "drop")
    run = lambda t: F.when(F.instr(t, "*") > 0, whole(F.substring_index(t, "*", -1))).otherwise(1)
    good = lambda t: F.when(~F.substring_index(t, "*", 1).rlike("^[0-9A-Fa-f]{6}$"), F.raise_error(F.concat(F.lit("invalid colour: "), t)).cast("string")).when(run(t) <= 0, F.raise_error(F.lit("a run must be positive")).cast("string")).otherwise(F.upper(F.substring_index(t, "*", 1)))
    cells = F.flatten(F.transform(F.slice("drop", 4, F.greatest(F.size("drop") - 3, F.lit(0))), lambda t: F.array_repeat(good(t), run(t))))
    fits = (F.col("cols") > 0) & (F.col("rows") > 0) & (F.size(cells) == F.col("cols") * F.col("rows"))
    drop = F.when(F.col("drop").isNotNull(), F.when(fits, cells).otherwise(F.raise_error(F.lit("a backdrop's colours don't match its size")).cast("array<string>")))
    return told.select("path", "f", "back_r", "back_g", "back_b", "cols", "rows", drop.alias("backdrop"))


def parse_paths(lines: DataFrame, header: int = 3) -> DataFrame:
    """(path, f, z, points) of an edge file's PATH lines, under the same checks."""
    parts = framed(lines, ("PATH",), header).where(F.col("word") == "PATH").withColumn("p", F.split("line", " +"))
    rows = parts.select("path", "f", "n", counted(numbered("p", 2), whole(F.try_element_at("p", F.lit(2)))).alias("points"))
    return rows.select("path", "f", (F.row_number().over(Window.partitionBy("path", "f").orderBy("n")) - 1).alias("z"), "points")


def parse_legacy(lines: DataFrame) -> DataFrame:
    """(path, f, z, points) of a legacy file: each line behind the first is a frame of one path, numbers apart by blanks, X and Y; an odd one is left out."""
    at = Window.partitionBy("path").orderBy("n")
    body = lines.withColumn("f", F.row_number().over(at) - 2).where("f >= 0")
    v = F.filter(F.split("line", "[ \\tXY]+"), lambda t: t != "")
    pts = F.transform(F.sequence(F.lit(0), F.expr("size(v) div 2 - 1")), lambda i: F.struct(whole(F.get("v", 2 * i)).alias("x"), whole(F.get("v", 2 * i + 1)).alias("y")))
    return body.withColumn("v", v).select("path", "f", F.lit(0).alias("z"), F.when(F.size("v") >= 2, pts).otherwise(F.array().cast("array<struct<x:int,y:int>>")).alias("points"))


def header_lines(kind: str, fps: str, width: str, height: str, quality: str = "0", palette: str = "0") -> str:
    """SQL: the array of a file's header lines."""
    number = f"regexp_replace(format_string('%.3f', round({fps}, 3)), '\\\\.?0+$', '')"
    more = f", concat('QUALITY ', {quality}), concat('PALETTE ', {palette})" if kind == REGION_SIGNATURE else ""
    return f"array('{kind}', concat('FPS ', {number}), concat('SIZE ', {width}, ' ', {height}){more})"


def region_text(frames: DataFrame, width: int, height: int, fps: float, quality: int, palette: int) -> DataFrame:
    """(video, n, line): a region file for each video, of frames as ``encode.regions`` gives them, in order."""
    line = region_line("s.id", ("s.r", "s.g", "s.b"), "s.points")
    body = F.expr(f"concat(array(concat('FRAME ', f), {background_line(('back_r', 'back_g', 'back_b'))}), transform(regions, s -> {line}), array('END'))")
    lines = frames.select("video", (F.col("f").cast("long") + 1).alias("_f"), F.posexplode(body).alias("_i", "line"))
    head = frames.select("video").distinct().select("video", F.lit(0).cast("long").alias("_f"), F.posexplode(F.expr(header_lines(REGION_SIGNATURE, f"{float(fps)}D", str(width), str(height), str(quality), str(palette)))).alias("_i", "line"))
    return head.unionByName(lines).select("video", (F.col("_f") * (1 << 31) + F.col("_i")).alias("n"), "line")


def edge_text(frames: DataFrame, width: int, height: int, fps: float) -> DataFrame:
    """(video, n, line): an edge file for each video, of frames as ``encode.edges`` gives them."""
    body = F.expr(f"concat(array(concat('FRAME ', f)), transform(paths, p -> {path_line('p')}), array('END'))")
    lines = frames.select("video", (F.col("f").cast("long") + 1).alias("_f"), F.posexplode(body).alias("_i", "line"))
    head = frames.select("video").distinct().select("video", F.lit(0).cast("long").alias("_f"), F.posexplode(F.expr(header_lines(EDGE_SIGNATURE, f"{float(fps)}D", str(width), str(height)))).alias("_i", "line"))
    return head.unionByName(lines).select("video", (F.col("_f") * (1 << 31) + F.col("_i")).alias("n"), "line")


def write_text(lines: DataFrame, path: str) -> None:
    """One folder a video, ``video=v``, with its file; a video's lines are written in order by one task, as a file is sequential."""
    lines.repartition("video").sortWithinPartitions("video", "n").select("line", "video").write.partitionBy("video").text(path)


def backdrop_runs(cells: DataFrame) -> DataFrame:
    """Run-length tokens of a grid's colours in cell order: (f, run, token)."""
    w = Window.partitionBy("f").orderBy("cell")
    hexed = cells.withColumn("hex", F.format_string("%02X%02X%02X", "r", "g", "b"))
    starts = hexed.withColumn("new", F.when(F.lag("hex").over(w) == F.col("hex"), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(w)).groupBy("f", "run").agg(F.first("hex").alias("hex"), F.count("*").alias("n"))
    return runs.select("f", "run", F.concat_ws("*", "hex", F.col("n").cast("string")).alias("token"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """Tokens back to (f, cell, r, g, b); a run below one is an error."""
    parts = runs.select("f", "run", F.split("token", r"\*")[0].alias("hex"), F.split("token", r"\*")[1].cast("int").alias("n"))
    ok = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("a run must be positive")).cast("int"))
    tokens = parts.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("run", "hex", ok.alias("n")))).alias("t"))
    cells = tokens.select("f", F.posexplode(F.expr("flatten(transform(t, x -> array_repeat(x.hex, x.n)))")).alias("cell", "hex"))
    return cells.select("f", "cell", *[F.conv(F.substring("hex", i, 2), 16, 10).cast("int").alias(c) for i, c in ((1, "r"), (3, "g"), (5, "b"))])


def parse_fps(c: str):
    """``a/b`` with b other than 0, or a number, else 0."""
    a, b = F.split(c, "/")[0], F.try_element_at(F.split(c, "/"), F.lit(2))
    whole = F.expr(f"try_cast({c} AS double)")
    return F.coalesce(F.when(b.isNotNull(), F.try_divide(a.try_cast("double"), b.try_cast("double"))).otherwise(whole), F.lit(0.0))


def probe(output: str) -> tuple[int, int, float] | None:
    """Width, height and frames a second from ``name=value`` lines of a probe; the first rate above 0 counts; None if one is missing."""
    found = {"width": 0, "height": 0, "fps": 0.0}
    for line in output.splitlines():
        name, _, value = (part.strip() for part in line.partition("="))
        if name in ("width", "height"):
            found[name] = int(value)
        elif name in ("avg_frame_rate", "r_frame_rate") and found["fps"] <= 0:
            a, _, b = value.partition("/")
            try:
                found["fps"] = float(a) / float(b or 1)
            except (ValueError, ZeroDivisionError):
                pass
    return (found["width"], found["height"], found["fps"]) if all(v > 0 for v in found.values()) else None
