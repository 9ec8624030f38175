"""Region and stroke containers: codecs, and Spark data sources that read and write them."""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Signatures, versions and frame markers of the containers.
REGION_MAGIC, STROKE_MAGIC = b"LVFB2", b"LVFS1"
VERSIONS, REGION_FRAME, STROKE_FRAME = (1, 2), 0xF2, 0xF5

REGION_SCHEMA = "path string, f int, declared_f int, z int, id int, r int, g int, b int, points array<struct<x:int,y:int>>, area double, cx double, cy double, is_correction boolean"


def put_varint(out: io.BytesIO, v: int) -> None:
    if v < 0:
        raise ValueError("a varint isn't negative")
    while v > 127:
        out.write(bytes([v & 127 | 128]))
        v >>= 7
    out.write(bytes([v]))


def take(src: io.BytesIO, n: int) -> bytes:
    data = src.read(n)
    if len(data) < n:
        raise EOFError("the file ends within a frame")
    return data


def get_varint(src: io.BytesIO) -> int:
    total = 0
    for i in range(5):
        byte = take(src, 1)[0]
        total |= (byte & 127) << 7 * i
        if byte < 128:
            return total
    raise ValueError("a varint has at most five bytes")


def opened(data: bytes) -> io.BytesIO:
    """Bytes as they are, or unpacked: by Brotli where that library is there, or by zlib (our own variant)."""
    if data[:5] in (REGION_MAGIC, STROKE_MAGIC):
        return io.BytesIO(data)
    if data[:1] == b"\x78":
        return io.BytesIO(zlib.decompress(data))
    try:
        import brotli
    except ImportError:
        raise ValueError("neither a container nor zlib, and no Brotli library is installed") from None
    return io.BytesIO(brotli.decompress(data))


def write_regions(header: dict, frames: list[dict]) -> bytes:
    out = io.BytesIO()
    out.write(REGION_MAGIC + bytes([2]))
    put_varint(out, header["width"])
    put_varint(out, header["height"])
    out.write(struct.pack("<d", header["fps"]))
    put_varint(out, header["quality"])
    put_varint(out, header["palette"])
    for frame in frames:
        out.write(region_frame(frame))
    return out.getvalue()


def region_frame(frame: dict) -> bytes:
    """One frame's bytes: frames follow each other behind the header."""
    out = io.BytesIO()
    out.write(bytes([REGION_FRAME]))
    put_varint(out, frame["f"])
    out.write(bytes(frame["background"]))
    put_varint(out, len(frame["regions"]))
    for region in frame["regions"]:
        put_varint(out, region["id"])
        out.write(bytes(region["color"]))
        put_varint(out, len(region["points"]))
        for x, y in region["points"]:
            put_varint(out, x)
            put_varint(out, y)
    return out.getvalue()


def read_regions(data: bytes) -> tuple[dict, Iterator[dict]]:
    src = opened(data)
    if src.read(5) != REGION_MAGIC:
        raise ValueError("not a region container")
    version = take(src, 1)[0]
    if version not in VERSIONS:
        raise ValueError(f"version {version}")
    header = {"version": version, "width": get_varint(src), "height": get_varint(src), "fps": struct.unpack("<d", take(src, 8))[0]}
    header |= {"quality": get_varint(src), "palette": get_varint(src)}

    def frames():
        while marker := src.read(1):
            if marker[0] != REGION_FRAME:
                raise ValueError("bad frame marker")
            frame = {"f": get_varint(src), "background": tuple(take(src, 3)), "regions": []}
            if version == 1:
                cols, rows = get_varint(src), get_varint(src)
                frame["backdrop"] = (cols, rows, take(src, 3 * cols * rows))
            for _ in range(get_varint(src)):
                region = {"id": get_varint(src), "color": tuple(take(src, 3))}
                region["points"] = [(get_varint(src), get_varint(src)) for _ in range(get_varint(src))]
                frame["regions"].append(region)
            yield frame

    return header, frames()


def geometry(points: list[tuple[int, int]]) -> tuple[float, float, float]:
    """Area and centre as readers work them out from the points."""
    if not points:
        return 0.0, 0.0, 0.0
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2 if len(points) > 2 else 0.0
    return area, sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)


STROKE_FIELDS = ("quality", "density", "detail", "residual", "glow", "opacity", "keyframe", "cell", "cols", "rows")


def write_strokes(header: dict, frames: list[dict]) -> bytes:
    out = io.BytesIO()
    out.write(STROKE_MAGIC + bytes([2]))
    put_varint(out, header["width"])
    put_varint(out, header["height"])
    out.write(struct.pack("<d", header["fps"]))
    for name in STROKE_FIELDS:
        put_varint(out, header[name])
    for frame in frames:
        out.write(bytes([STROKE_FRAME]))
        put_varint(out, frame["f"])
        out.write(bytes([frame["key"]]))
        put_varint(out, len(frame["changes"]))
        for cell, color in frame["changes"]:
            put_varint(out, cell)
            out.write(bytes(color))
        put_varint(out, len(frame["strokes"]))
        for s in frame["strokes"]:
            put_varint(out, s["id"])
            out.write(bytes(s["color"]) + bytes([s["intensity"], s["width"], s["glow"], s["opacity"]]))
            put_varint(out, len(s["points"]))
            for x, y in s["points"]:
                put_varint(out, x)
                put_varint(out, y)
        put_varint(out, len(frame["residuals"]))
        for p in frame["residuals"]:
            for name in ("x", "y", "w", "h"):
                put_varint(out, p[name])
            out.write(bytes(p["color"]) + bytes([p["opacity"]]))
    return out.getvalue()


def read_strokes(data: bytes) -> tuple[dict, Iterator[dict]]:
    """Frames carry the dense surface, rebuilt from the changes."""
    src = opened(data)
    if src.read(5) != STROKE_MAGIC:
        raise ValueError("not a stroke container")
    version = take(src, 1)[0]
    if version not in VERSIONS:
        raise ValueError(f"version {version}")
    header = {"version": version, "width": get_varint(src), "height": get_varint(src), "fps": struct.unpack("<d", take(src, 8))[0]}
    for name in STROKE_FIELDS:
        header[name] = 100 if name == "opacity" and version == 1 else get_varint(src)

    def frames():
        surface = [(0, 0, 0)] * (header["cols"] * header["rows"])
        while marker := src.read(1):
            if marker[0] != STROKE_FRAME:
                raise ValueError("bad frame marker")
            frame = {"f": get_varint(src), "key": bool(take(src, 1)[0]), "changes": [], "strokes": [], "residuals": []}
            for _ in range(get_varint(src)):
                cell, color = get_varint(src), tuple(take(src, 3))
                if cell >= len(surface):
                    raise ValueError("cell out of range")
                surface[cell] = color
                frame["changes"].append((cell, color))
            frame["surface"] = list(surface)
            for _ in range(get_varint(src)):
                s = {"id": get_varint(src), "color": tuple(take(src, 3))}
                s |= dict(zip(("intensity", "width", "glow", "opacity"), take(src, 4)))
                s["points"] = [(get_varint(src), get_varint(src)) for _ in range(get_varint(src))]
                s["length"] = sum(math.dist(a, b) for a, b in zip(s["points"], s["points"][1:]))
                frame["strokes"].append(s)
            for _ in range(get_varint(src)):
                p = {name: get_varint(src) for name in ("x", "y", "w", "h")}
                p |= {"color": tuple(take(src, 3)), "opacity": take(src, 1)[0]}
                frame["residuals"].append(p)
            yield frame

    return header, frames()


def region_rows(path: str, data: bytes) -> Iterator[tuple]:
    """A container's regions as rows of REGION_SCHEMA; frames are numbered by position."""
    _, frames = read_regions(data)
    for f, frame in enumerate(frames):
        for z, region in enumerate(frame["regions"]):
            yield (path, f, frame["f"], z, region["id"], *region["color"], [{"x": x, "y": y} for x, y in region["points"]], *geometry(region["points"]), region["id"] == 0)


def read_region_files(spark, path: str):
    """Region containers in any file system that Spark reads, a file a row of work."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for at, data in zip(pdf["path"], pdf["content"]) for r in region_rows(at, bytes(data))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REGION_SCHEMA.replace("struct<x:int,y:int>", "p").split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, REGION_SCHEMA)


REGION_FRAMES = "path string, f int, declared_f int, back_r int, back_g int, back_b int, cols int, rows int, backdrop binary, regions array<struct<id:int,r:int,g:int,b:int,points:array<struct<x:int,y:int>>,is_correction:boolean>>"
STROKE_FRAMES = (
    "path string, f int, declared_f int, key boolean, changes array<struct<cell:int,r:int,g:int,b:int>>, surface binary, "
    "strokes array<struct<id:int,r:int,g:int,b:int,intensity:int,width:int,glow:int,opacity:int,points:array<struct<x:int,y:int>>,length:double>>, "
    "residuals array<struct<x:int,y:int,w:int,h:int,r:int,g:int,b:int,opacity:int>>")


def names(schema: str) -> list[str]:
    """The top columns of a schema's text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return [c.split()[0] for c in out]


def _points(points) -> list[dict]:
    return [{"x": x, "y": y} for x, y in points]


def _color(rgb) -> dict:
    return dict(zip("rgb", map(int, rgb)))


def region_frame_rows(path: str, data: bytes) -> Iterator[tuple]:
    """A container's frames as rows of REGION_FRAMES: those without regions too, with backgrounds and, in version 1, backdrops."""
    _, frames = read_regions(data)
    for f, frame in enumerate(frames):
        cols, rows, drop = frame.get("backdrop", (None, None, None))
        regions = [{"id": r["id"], **_color(r["color"]), "points": _points(r["points"]), "is_correction": r["id"] == 0} for r in frame["regions"]]
        yield (path, f, frame["f"], *frame["background"], cols, rows, drop, regions)


def stroke_frame_rows(path: str, data: bytes) -> Iterator[tuple]:
    """A stroke container's frames as rows of STROKE_FRAMES; the surface is dense, three bytes a cell."""
    _, frames = read_strokes(data)
    for f, frame in enumerate(frames):
        strokes = [{"id": s["id"], **_color(s["color"]), **{k: s[k] for k in ("intensity", "width", "glow", "opacity")}, "points": _points(s["points"]), "length": s["length"]} for s in frame["strokes"]]
        patches = [{**{k: p[k] for k in "xywh"}, **_color(p["color"]), "opacity": p["opacity"]} for p in frame["residuals"]]
        yield (path, f, frame["f"], frame["key"], [{"cell": c, **_color(v)} for c, v in frame["changes"]], b"".join(map(bytes, frame["surface"])), strokes, patches)


def _read_files(spark, path: str, rows_of, schema: str):
    """Containers in any file system that Spark reads, a file a row of work, a frame a row of the result."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at, data in zip(pdf["path"], pdf["content"]):
                rows = list(rows_of(at, bytes(data)))
                for k in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[k : k + 64], columns=names(schema))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_region_frames(spark, path: str):
    return _read_files(spark, path, region_frame_rows, REGION_FRAMES)


def read_stroke_frames(spark, path: str):
    return _read_files(spark, path, stroke_frame_rows, STROKE_FRAMES)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, rows_of):
        self.path, self.rows_of = path, rows_of

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [FilePartition(p) for p in found if not os.path.basename(p).startswith("_")]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from self.rows_of(partition.path, f.read())


class Written(WriterCommitMessage):
    def __init__(self, staged: str | None, path: str):
        self.staged, self.path = staged, path


def _points_of(points) -> list[tuple[int, int]]:
    return [(p["x"], p["y"]) for p in points]


def _rgb(v) -> tuple[int, int, int]:
    return v["r"], v["g"], v["b"]


class ContainerWriter(DataSourceWriter):
    """One container a partition, its frames in order.

    A task writes to a name of its own under ``_staging``; only what the driver
    commits is moved into place, so files of retried, speculative or failed
    tasks are never seen. The folder is one that driver and executors mount.
    """

    def __init__(self, options: dict, suffix: str):
        self.options, self.suffix = dict(options), suffix

    def content(self, rows) -> bytes | None:
        raise NotImplementedError

    def write(self, rows):
        import os
        import uuid

        data, name = self.content(rows), f"part-{uuid.uuid4().hex}{self.suffix}"
        if data is None:
            return Written(None, "")
        if self.options.get("compression") == "zlib":
            data = zlib.compress(data)
        staging = os.path.join(self.options["path"], "_staging")
        os.makedirs(staging, exist_ok=True)
        staged = os.path.join(staging, name)
        with open(staged, "wb") as f:
            f.write(data)
        return Written(staged, os.path.join(self.options["path"], name))

    def commit(self, messages):
        import os
        import shutil

        for m in messages:
            if m and m.staged:
                os.replace(m.staged, m.path)
        shutil.rmtree(os.path.join(self.options["path"], "_staging"), ignore_errors=True)

    def abort(self, messages):
        import os
        import shutil

        shutil.rmtree(os.path.join(self.options["path"], "_staging"), ignore_errors=True)


class RegionWriter(ContainerWriter):
    """Of rows of regions (f, z, id, r, g, b, points), over black, or of whole frames (f, back_r, back_g, back_b, regions)."""

    def content(self, rows):
        frames: dict[int, dict] = {}
        for r in rows:
            if "regions" in r:
                held = [(z, {"id": s["id"], "color": _rgb(s), "points": _points_of(s["points"])}) for z, s in enumerate(r["regions"])]
                frames[r["f"]] = {"f": r["f"], "background": (r["back_r"], r["back_g"], r["back_b"]), "regions": held}
            else:
                frame = frames.setdefault(r["f"], {"f": r["f"], "background": (0, 0, 0), "regions": []})
                frame["regions"].append((r["z"], {"id": r["id"], "color": _rgb(r), "points": _points_of(r["points"])}))
        if not frames:
            return None
        for frame in frames.values():
            frame["regions"] = [region for _, region in sorted(frame["regions"], key=lambda x: x[0])]
        o = self.options
        header = {"width": int(o["width"]), "height": int(o["height"]), "fps": float(o.get("fps", 30)), "quality": int(o.get("quality", 82)), "palette": int(o.get("palette", 36))}
        return write_regions(header, [frames[f] for f in sorted(frames)])


class StrokeWriter(ContainerWriter):
    """Of whole frames (f, key, changes, strokes, residuals) as ``plans.jobs.stroke_frames`` gives them."""

    def content(self, rows):
        frames = []
        for r in sorted(rows, key=lambda r: r["f"]):
            strokes = [{k: s[k] for k in ("id", "intensity", "width", "glow", "opacity")} | {"color": _rgb(s), "points": _points_of(s["points"])} for s in r["strokes"]]
            patches = [{k: p[k] for k in ("x", "y", "w", "h", "opacity")} | {"color": _rgb(p)} for p in r["residuals"]]
            frames.append({"f": r["f"], "key": int(r["key"]), "changes": [(c["cell"], _rgb(c)) for c in r["changes"]], "strokes": strokes, "residuals": patches})
        o = self.options
        return write_strokes({"width": int(o["width"]), "height": int(o["height"]), "fps": float(o.get("fps", 30))} | {k: int(o[k]) for k in STROKE_FIELDS}, frames) if frames else None


class RegionContainer(DataSource):
    """``spark.read.format("region_container").load(path)`` and ``df.write.format("region_container")`` for mounted paths."""

    @classmethod
    def name(cls):
        return "region_container"

    def schema(self):
        return REGION_SCHEMA

    def reader(self, schema):
        return ContainerReader(self.options["path"], region_rows)

    def writer(self, schema, overwrite):
        return RegionWriter(self.options, ".lvfb")


class StrokeContainer(DataSource):
    """The same of stroke containers, a frame a row; the header's fields are options of the writer."""

    @classmethod
    def name(cls):
        return "stroke_container"

    def schema(self):
        return STROKE_FRAMES

    def reader(self, schema):
        return ContainerReader(self.options["path"], stroke_frame_rows)

    def writer(self, schema, overwrite):
        return StrokeWriter(self.options, ".lvfs")
