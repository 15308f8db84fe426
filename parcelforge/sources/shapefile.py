"""Zipped shapefiles: geometry and attributes of every record, parsed where Spark reads the file.

Each archive is one task's work; a folder of archives spreads over tasks. Where a layer's .prj
names a plane grid, its points become degrees; a grid that isn't known is an error.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from parcelforge.functions import projection

SCHEMA = "file string, layer string, ordinal long, geometry_type string, points array<struct<lat:double,lon:double>>, properties map<string,string>"
#: Shape types of the format, without their Z and M variants (10 and 20 more).
KINDS = {0: None, 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def shapes(data: bytes) -> Iterator[tuple[str | None, list[tuple[float, float]]]]:
    """(type, [(x, y)]) of each record; the parts of a record follow each other."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        kind = KINDS.get(struct.unpack("<i", body[:4])[0] % 10)
        if kind == "Point":
            yield kind, [struct.unpack("<2d", body[4:20])]
        elif kind in ("LineString", "Polygon"):
            parts, count = struct.unpack("<2i", body[36:44])
            flat = struct.unpack(f"<{2 * count}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * count])
            yield kind, list(zip(flat[::2], flat[1::2], strict=True))
        elif kind == "MultiPoint":
            count = struct.unpack("<i", body[36:40])[0]
            flat = struct.unpack(f"<{2 * count}d", body[40 : 40 + 16 * count])
            yield kind, list(zip(flat[::2], flat[1::2], strict=True))
        else:
            yield None, []


def attributes(data: bytes) -> Iterator[dict[str, str]]:
    """Fields of each record of a DBF table, as text in UTF-8 or else Latin-1; deleted records are given too, to keep step with the shapes."""
    count, head, width = struct.unpack("<iHH", data[4:12])
    fields, at = [], 32
    while data[at : at + 1] != b"\r":
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for n in range(count):
        at, row = head + n * width + 1, {}
        for name, size in fields:
            raw = data[at : at + size]
            at += size
            try:
                row[name] = raw.decode("utf-8").strip()
            except UnicodeDecodeError:
                row[name] = raw.decode("latin-1").strip()
        yield row


def in_view(kind: str | None, points: list[tuple[float, float]], box: tuple[float, float, float, float] | None) -> bool:
    """Whether a shape's own box meets ``box`` (west, south, east, north); points and empty records have none and stay."""
    if box is None or kind in (None, "Point") or not points:
        return True
    xy = np.array(points)
    (west, south), (east, north) = xy.min(axis=0), xy.max(axis=0)
    return not (east < box[0] or west > box[2] or north < box[1] or south > box[3])


def read_shapefiles(spark: SparkSession, path: str, layer: str | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows of SCHEMA of all layers, or of one, in the zip archives at ``path``.

    ``bbox`` is in the units of the file, as the boxes inside it are, and is held against them
    before anything is projected.
    """

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inside = {n.lower(): n for n in z.namelist()}
                    for low in sorted(n for n in inside if n.endswith(".shp")):
                        stem = low.rsplit("/", 1)[-1][:-4]
                        if layer and stem != layer.lower():
                            continue
                        table, prj = inside.get(low[:-4] + ".dbf"), inside.get(low[:-4] + ".prj")
                        grid = projection.from_prj(z.read(prj).decode("utf-8", "ignore")) if prj else None
                        rows = attributes(z.read(table)) if table else iter(())
                        out = []
                        for i, (kind, points) in enumerate(shapes(z.read(inside[low]))):
                            values = next(rows, {})
                            if not in_view(kind, points, bbox):
                                continue
                            if grid and points:
                                lat, lon = grid.inverse(*np.array(points).T, np)
                                points = list(zip(lon.tolist(), lat.tolist(), strict=True))
                            out.append((name, stem, i, kind, [{"lat": y, "lon": x} for x, y in points], values))
                        yield pd.DataFrame(out, columns=["file", "layer", "ordinal", "geometry_type", "points", "properties"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(parse, SCHEMA)
