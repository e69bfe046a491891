"""Chunked images as Spark data sources: OME-Zarr and tiled TIFF, read by chunks, and pyramids of tiled TIFF, written.

`read_zarr` and `read_tiff` give a row a pixel and channel: slide_id, level, channel, row, col, value. A partition is a
run of chunks; filters on slide_id, level, row and col, and the same as options, choose chunks before any is read.
Files are read by ranges, those elsewhere than in local or mounted folders through pyarrow.fs (s3://, hdfs:// and others).

`write_pyramids` writes one BigTIFF a slide. Tiles of each level come from those of the level above in Spark; the place
of each tile in its file is the sum of what lies before it, so every task writes its own bytes into the same file, at
their place, and again with the same result where a task is lost. Files get their names when all tasks have ended.
Several tasks write into one file, so the target must be a folder of a POSIX file system that all executors share.

Supported: bytes without compression, deflate/zlib/gzip and zstandard; TIFF and BigTIFF of both byte orders with strips
left aside, predictor 2; Zarr of versions 2 and 3 in C order. Blosc, JPEG and LZW chunks are an error that names them.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.window import Window

from .work import deleted, written

PIXELS = "slide_id string, level int, channel int, row int, col int, value double"
#: Chunks of a partition.
CHUNKS = 16
# fixed values: tags, types and codes of the TIFF 6.0 and BigTIFF formats
TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u4,u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 10: "i4,i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, MAKE, SAMPLES = 256, 257, 258, 259, 262, 270, 271, 277
X_RESOLUTION, Y_RESOLUTION, PLANAR, UNIT, SOFTWARE, PREDICTOR = 282, 283, 284, 296, 305, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SUB_IFDS, SAMPLE_FORMAT = 322, 323, 324, 325, 330, 339
CODECS = {1: "none", 5: "LZW", 7: "JPEG", 8: "deflate", 32946: "deflate", 33003: "JPEG 2000", 33005: "JPEG 2000", 50000: "zstd"}


def local(path: str) -> str | None:
    """The path in the local file system; None in others."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else os.path.abspath(path)


class Source:
    """Ranged reads of a file. Local ones go without pyarrow, whose threads do not outlive the forks of Python workers."""

    def __init__(self, path: str):
        self.path = local(path)
        if self.path is None:
            fs, inner = pafs.FileSystem.from_uri(path)
            self.file = fs.open_input_file(inner)
        else:
            self.file = open(self.path, "rb")

    def read_at(self, n: int, at: int) -> bytes:
        if self.path is None:
            return self.file.read_at(n, at)
        return os.pread(self.file.fileno(), n, at)

    def close(self) -> None:
        self.file.close()


def whole(path: str) -> bytes | None:
    """The bytes of a file; None where there is none."""
    try:
        at = local(path)
        if at is None:
            fs, inner = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(inner) as f:
                return f.read()
        with open(at, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return None


def expanded(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "deflate":
        return zlib.decompress(data, 47)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"chunks in {codec} cannot be read")


@dataclass
class Level:
    """One level of an image: its size in pixels, that of a chunk, and what its reader needs besides."""

    number: int
    width: int
    height: int
    chunk_width: int
    chunk_height: int
    channels: int
    dtype: str
    more: dict = field(default_factory=dict)

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.chunk_height)


# TIFF


@dataclass
class Page:
    tags: dict[int, np.ndarray]
    order: str

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if v is None or not len(v) else v[0].item() if hasattr(v[0], "item") else v[0]

    def text(self, tag: int) -> str:
        v = self.tags.get(tag)
        return "" if v is None else v.tobytes().split(b"\0")[0].decode("utf-8", "replace")


def tiff_pages(source, skip: tuple[int, ...] = ()) -> list[Page]:
    """The pages of a TIFF, and after each those of its SubIFDs, by ranged reads; values of the tags in skip are left out."""
    head = source.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    size = struct.calcsize(word)
    at = struct.unpack(order + word, head[8:16] if big else head[4:8])[0]
    pages: list[Page] = []

    def page(at: int) -> tuple[Page, int]:
        n = struct.unpack(order + count, source.read_at(struct.calcsize(count), at))[0]
        start = at + struct.calcsize(count)
        body = source.read_at(n * entry + size, start)
        tags = {}
        for k in range(n):
            tag, kind, m = struct.unpack(order + "HH" + word, body[k * entry : k * entry + 4 + size])
            if kind not in TYPES or tag in skip:
                continue
            dtype = np.dtype([(f"f{i}", order + t) for i, t in enumerate(TYPES[kind].split(","))]) if "," in TYPES[kind] else np.dtype(TYPES[kind] if kind == 2 else order + TYPES[kind])
            raw = body[k * entry + 4 + size : (k + 1) * entry]
            data = raw[: m * dtype.itemsize] if m * dtype.itemsize <= size else source.read_at(m * dtype.itemsize, struct.unpack(order + word, raw)[0])
            tags[tag] = np.frombuffer(data, dtype=dtype)
        return Page(tags, order), struct.unpack(order + word, body[n * entry :])[0]

    seen = set()
    while at and at not in seen:
        seen.add(at)
        found, at = page(at)
        pages.append(found)
        for sub in found.tags.get(SUB_IFDS, ()):
            pages.append(page(int(sub))[0])
    return pages


def tiff_levels(pages: list[Page]) -> list[Level]:
    """Tiled pages that are smaller versions of the first tiled one."""
    out: list[Level] = []
    for k, p in enumerate(pages):
        if TILE_WIDTH not in p.tags:
            continue
        bits, form = int(p.one(BITS, 8)), int(p.one(SAMPLE_FORMAT, 1))
        level = Level(len(out), int(p.one(WIDTH)), int(p.one(HEIGHT)), int(p.one(TILE_WIDTH)), int(p.one(TILE_HEIGHT)), int(p.one(SAMPLES, 1)), f"{p.order}{'uif'[form - 1]}{bits // 8}")
        level.more = {"page": k, "codec": CODECS.get(int(p.one(COMPRESSION, 1)), f"code {p.one(COMPRESSION)}"), "predictor": int(p.one(PREDICTOR, 1)), "planar": int(p.one(PLANAR, 1))}
        if out and (level.width > out[-1].width or abs(level.width / level.height - out[0].width / out[0].height) > 0.1 * level.width / level.height):
            continue
        out.append(level)
    return out


def tiff_properties(pages: list[Page]) -> dict[str, str]:
    """Properties of the first page: TIFF fields, and the `key = value` parts of an Aperio description."""
    first, out = pages[0], {}
    for tag, name in ((DESCRIPTION, "tiff.ImageDescription"), (MAKE, "tiff.Make"), (SOFTWARE, "tiff.Software")):
        if first.text(tag):
            out[name] = first.text(tag)
    for tag, name in ((X_RESOLUTION, "tiff.XResolution"), (Y_RESOLUTION, "tiff.YResolution")):
        v = first.tags.get(tag)
        if v is not None and v[0][1]:
            out[name] = repr(float(v[0][0]) / float(v[0][1]))
    out["tiff.ResolutionUnit"] = {1: "none", 2: "inch", 3: "centimeter"}.get(first.one(UNIT, 2), "none")
    description = first.text(DESCRIPTION)
    if description.startswith("Aperio"):
        for part in description.split("|")[1:]:
            key, cut, value = part.partition("=")
            if cut:
                out[f"aperio.{key.strip()}"] = value.strip()
    return out


class TiffImage:
    def __init__(self, path: str):
        self.source = Source(path)
        self.pages: list[Page] | None = None

    def levels(self) -> list[Level]:
        # where tiles lie is read by the tasks that read them
        return tiff_levels(tiff_pages(self.source, (TILE_OFFSETS, TILE_BYTES)))

    def chunk(self, level: Level, ty: int, tx: int) -> Iterator[tuple[int, np.ndarray]]:
        if self.pages is None:
            self.pages = tiff_pages(self.source)
        page = self.pages[level.more["page"]]
        planes = level.channels if level.more["planar"] == 2 else 1
        for plane in range(planes):
            k = plane * level.across * level.down + ty * level.across + tx
            n = int(page.tags[TILE_BYTES][k])
            shape = (level.chunk_height, level.chunk_width, level.channels // planes)
            if n == 0:
                data = np.zeros(shape, dtype=level.dtype)
            else:
                data = np.frombuffer(expanded(self.source.read_at(n, int(page.tags[TILE_OFFSETS][k])), level.more["codec"]), dtype=level.dtype).reshape(shape)
            if level.more["predictor"] == 2:
                data = np.cumsum(data, axis=1, dtype=data.dtype)
            for c in range(shape[2]):
                yield plane + c, data[:, :, c]


# OME-Zarr


class ZarrImage:
    def __init__(self, path: str):
        self.root = path.rstrip("/")

    def read(self, name: str) -> bytes | None:
        return whole(f"{self.root}/{name}")

    def levels(self) -> list[Level]:
        v2, v3 = self.read(".zattrs"), self.read("zarr.json")
        attributes = json.loads(v2) if v2 else json.loads(v3 or b"{}").get("attributes", {}).get("ome", {})
        scales = attributes.get("multiscales")
        if not scales:
            raise ValueError(f"no multiscales at {self.root}")
        axes = [a["name"] if isinstance(a, dict) else a for a in scales[0].get("axes", "tczyx")]
        out = []
        for number, d in enumerate(scales[0]["datasets"]):
            out.append(self.level(number, d["path"], axes))
        return out

    def level(self, number: int, name: str, axes: list[str]) -> Level:
        meta = self.read(f"{name}/.zarray")
        if meta:
            m = json.loads(meta)
            if m.get("order", "C") != "C" or m.get("filters"):
                raise ValueError("arrays in Fortran order or with filters cannot be read")
            codec = (m.get("compressor") or {"id": "none"})["id"]
            chunks, dtype, fill = m["chunks"], m["dtype"], m.get("fill_value") or 0
            key = {"separator": m.get("dimension_separator", "."), "prefix": ""}
        else:
            m = json.loads(self.read(f"{name}/zarr.json") or b"{}")
            if not m:
                raise ValueError(f"no array at {self.root}/{name}")
            codecs = [c["name"] for c in m.get("codecs", [])]
            little = all(c.get("configuration", {}).get("endian", "little") == "little" for c in m.get("codecs", []) if c["name"] == "bytes")
            rest = [c for c in codecs if c not in ("bytes", "crc32c")]
            codec = rest[0] if rest else "none"
            if len(rest) > 1 or "crc32c" in codecs:
                codec = "+".join(codecs)
            kind = np.dtype(m["data_type"])
            dtype, fill = kind.newbyteorder("<" if little else ">").str, m.get("fill_value") or 0
            chunks = m["chunk_grid"]["configuration"]["chunk_shape"]
            encoding = m.get("chunk_key_encoding", {"name": "default"})
            default = encoding["name"] == "default"
            key = {"separator": encoding.get("configuration", {}).get("separator", "/" if default else "."), "prefix": "c" if default else ""}
        shape = m["shape"]
        size, chunk = dict(zip(axes, shape, strict=True)), dict(zip(axes, chunks, strict=True))
        codec = {"zlib": "deflate", "gzip": "deflate"}.get(codec, codec)
        return Level(number, size["x"], size["y"], chunk["x"], chunk["y"], size.get("c", 1), dtype, {"name": name, "axes": axes, "chunks": chunks, "codec": codec, "fill": fill, **key})

    def chunk(self, level: Level, ty: int, tx: int) -> Iterator[tuple[int, np.ndarray]]:
        """Channels of the first z and t."""
        m = level.more
        axes, chunks = m["axes"], m["chunks"]
        per = chunks[axes.index("c")] if "c" in axes else 1
        for lot in range(-(-level.channels // per)):
            at = [{"y": ty, "x": tx, "c": lot}.get(a, 0) for a in axes]
            data = self.read("/".join([m["name"], m["separator"].join([*([m["prefix"]] if m["prefix"] else []), *map(str, at)])]))
            if data is None:
                grid = np.full(chunks, m["fill"], dtype=level.dtype)
            else:
                grid = np.frombuffer(expanded(data, m["codec"]), dtype=level.dtype).reshape(chunks)
            grid = grid[tuple(slice(None) if a in "cyx" else 0 for a in axes)]
            left = [a for a in axes if a in "cyx"]
            grid = np.transpose(grid, [left.index(a) for a in ("c", "y", "x") if a in left])
            grid = grid if "c" in left else grid[None]
            for c in range(min(per, level.channels - lot * per)):
                yield lot * per + c, grid[c]


IMAGES = {"tiff": TiffImage, "zarr": ZarrImage}


def image_paths(path: str, kind: str) -> list[str]:
    """The images at a path: itself, or those in the folder."""
    ends, at = ((".tif", ".tiff", ".svs") if kind == "tiff" else (".zarr",)), local(path)
    if path.rstrip("/").endswith(ends):
        return [path]
    if at is not None:
        if os.path.isfile(at):
            return [path]
        return sorted(f"{at}/{f}" for f in os.listdir(at) if f.endswith(ends))
    fs, inner = pafs.FileSystem.from_uri(path)
    found = fs.get_file_info(pafs.FileSelector(inner))
    return sorted(path.rstrip("/") + "/" + f.base_name for f in found if f.base_name.endswith(ends)) or [path]


def slide_name(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    for end in (".ome.zarr", ".zarr", ".ome.tiff", ".ome.tif", ".tiff", ".tif", ".svs"):
        if name.endswith(end):
            return name.removesuffix(end)
    return name


@dataclass
class Chunks(InputPartition):
    path: str
    level: Level
    places: list[tuple[int, int]]


class ChunkReader(DataSourceReader):
    """Bounds on rows, columns and levels choose the chunks; what is within a chunk is cut too."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.per = int(options.get("chunks", CHUNKS))
        self.low = {c: int(options[f"{c}_from"]) for c in ("level", "row", "col") if f"{c}_from" in options}
        self.high = {c: int(options[f"{c}_to"]) for c in ("level", "row", "col") if f"{c}_to" in options}
        self.slides: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds are kept; Spark applies all filters again."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if name == "slide_id" and isinstance(f, (EqualTo, In)):
                self.slides = set(values) if self.slides is None else self.slides & set(values)
            elif name in ("level", "row", "col") and values and all(isinstance(v, int) for v in values):
                if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low.get(name, 0), min(values) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high.get(name, 1 << 31), max(values) + (not isinstance(f, LessThan)))
            yield f

    def bounds(self, name: str, size: int) -> tuple[int, int]:
        return max(0, self.low.get(name, 0)), min(size, self.high.get(name, size))

    def partitions(self) -> list[Chunks]:
        out = []
        for path in image_paths(self.path, self.kind):
            if self.slides is not None and slide_name(path) not in self.slides:
                continue
            levels = IMAGES[self.kind](path).levels()
            first, end = self.bounds("level", len(levels))
            for level in levels[first:end]:
                (r0, r1), (c0, c1) = self.bounds("row", level.height), self.bounds("col", level.width)
                if r0 >= r1 or c0 >= c1:
                    continue
                rows = range(r0 // level.chunk_height, (r1 - 1) // level.chunk_height + 1)
                cols = range(c0 // level.chunk_width, (c1 - 1) // level.chunk_width + 1)
                places = [(ty, tx) for ty in rows for tx in cols]
                out += [Chunks(path, level, places[k : k + self.per]) for k in range(0, len(places), self.per)]
        return out

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are none
            return
        image, level, name = IMAGES[self.kind](partition.path), partition.level, slide_name(partition.path)
        (r0, r1), (c0, c1) = self.bounds("row", level.height), self.bounds("col", level.width)
        for ty, tx in partition.places:
            top, left = ty * level.chunk_height, tx * level.chunk_width
            rows, cols = np.arange(max(r0, top), min(r1, top + level.chunk_height)), np.arange(max(c0, left), min(c1, left + level.chunk_width))
            for channel, grid in image.chunk(level, ty, tx):
                values = grid[rows[0] - top : rows[-1] + 1 - top, cols[0] - left : cols[-1] + 1 - left].astype(np.float64).ravel()
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(name, n), pa.repeat(pa.scalar(level.number, pa.int32()), n), pa.repeat(pa.scalar(channel, pa.int32()), n),
                        pa.array(np.repeat(rows, len(cols)).astype(np.int32)), pa.array(np.tile(cols, len(rows)).astype(np.int32)), pa.array(values),
                    ],
                    names=["slide_id", "level", "channel", "row", "col", "value"],
                )


class ZarrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slidelake_zarr"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader("zarr", self.options)


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slidelake_tiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader("tiff", self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PlacedWriter(self.options["path"], schema.fieldNames())


def _read(spark: SparkSession, source: type[DataSource], path: str, options: dict) -> DataFrame:
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(source.name()).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def read_zarr(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pixels of the OME-Zarr images at path (one, or a folder of them). Options: level_from, level_to, row_from, ... (ends are not included), chunks (of a partition)."""
    return _read(spark, ZarrSource, path, options)


def read_tiff(spark: SparkSession, path: str, **options) -> DataFrame:
    """A1: pixels of the tiled TIFF files at path. Options as for read_zarr."""
    return _read(spark, TiffSource, path, options)


def as_rgb(pixels: DataFrame, top: float = 255.0) -> DataFrame:
    """slide_id, level, row, col, r, g, b from 0 to 1: the first three channels side by side."""
    pick = [(F.max(F.when(F.col("channel") == k, F.col("value"))) / top).alias(c) for k, c in enumerate("rgb")]
    return pixels.groupBy("slide_id", "level", "row", "col").agg(*pick)


SLIDE = "slide_id string, path string, width double, height double, levels array<struct<level:int,width:bigint,height:bigint,downsample:double>>, properties map<string,string>, associated int"


def open_slides(spark: SparkSession, path: str, glob: str = "*.{tif,tiff,svs}") -> DataFrame:
    """A1, A3-A5: a row a TIFF file: size, levels, properties and the number of pages that are no level. Directories alone are read, by ranges, each file in a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                source = Source(name)
                pages = tiff_pages(source, (TILE_OFFSETS, TILE_BYTES))
                source.close()
                levels = tiff_levels(pages)
                if not levels:
                    continue
                w = levels[0].width
                yield pd.DataFrame(
                    {
                        "slide_id": [slide_name(name)], "path": [name], "width": [float(w)], "height": [float(levels[0].height)],
                        "levels": [[{"level": x.number, "width": x.width, "height": x.height, "downsample": w / x.width} for x in levels]],
                        "properties": [tiff_properties(pages)], "associated": [len(pages) - len(levels)],
                    }
                )

    return files.mapInPandas(run, SLIDE)


# pyramids


def tiles_of(pixels: DataFrame, bands: list[str], tile: int) -> DataFrame:
    """slide_id, level, ty, tx, data: pixels(slide_id, row, col, bands) as tiles of doubles, places without a pixel as NaN."""
    at = pixels.select("slide_id", F.floor(F.col("row") / tile).cast("int").alias("ty"), F.floor(F.col("col") / tile).cast("int").alias("tx"), (F.col("row") % tile).alias("__r"), (F.col("col") % tile).alias("__c"), *[F.col(b).cast("double").alias(b) for b in bands])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((tile, tile, len(bands)), np.nan)
        grid[pdf["__r"], pdf["__c"]] = pdf[bands]
        return pd.DataFrame({"slide_id": pdf["slide_id"].iloc[:1], "level": 0, "ty": pdf["ty"].iloc[0], "tx": pdf["tx"].iloc[0], "data": [grid.tobytes()]})

    return at.groupBy("slide_id", "ty", "tx").applyInPandas(run, "slide_id string, level int, ty int, tx int, data binary")


def halved(blocks: np.ndarray, how: str) -> np.ndarray:
    """Blocks (height, width, 4, bands) to one value each; NaN is no pixel."""
    none = np.isnan(blocks).all(axis=2)
    held = np.where(none[:, :, None, :], 0.0, blocks)
    if how == "nearest":
        first = np.argmax(~np.isnan(held), axis=2)
        out = np.take_along_axis(held, first[:, :, None, :], axis=2)[:, :, 0]
    elif how == "mode":
        n = np.nansum(held[:, :, :, None, :] == held[:, :, None, :, :], axis=3) * ~np.isnan(held)
        out = np.nanmin(np.where(n == n.max(axis=2, keepdims=True), held, np.nan), axis=2)
    else:
        out = {"mean": np.nanmean, "median": np.nanmedian, "max": np.nanmax, "min": np.nanmin}[how](held, axis=2)
    return np.where(none, np.nan, out)


def next_level(tiles: DataFrame, bands: int, tile: int, how: str) -> DataFrame:
    """Tiles of half the size: up to four tiles become one."""
    above = tiles.select("slide_id", (F.col("level") + 1).alias("level"), F.shiftright("ty", 1).alias("py"), F.shiftright("tx", 1).alias("px"), F.col("ty").bitwiseAND(1).alias("qy"), F.col("tx").bitwiseAND(1).alias("qx"), "data")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((2 * tile, 2 * tile, bands), np.nan)
        for qy, qx, data in zip(pdf["qy"], pdf["qx"], pdf["data"], strict=True):
            grid[qy * tile : (qy + 1) * tile, qx * tile : (qx + 1) * tile] = np.frombuffer(data).reshape(tile, tile, bands)
        blocks = grid.reshape(tile, 2, tile, 2, bands).transpose(0, 2, 1, 3, 4).reshape(tile, tile, 4, bands)
        return pd.DataFrame({"slide_id": pdf["slide_id"].iloc[:1], "level": pdf["level"].iloc[0], "ty": pdf["py"].iloc[0], "tx": pdf["px"].iloc[0], "data": [halved(blocks, how).tobytes()]})

    return above.groupBy("slide_id", "level", "py", "px").applyInPandas(run, "slide_id string, level int, ty int, tx int, data binary")


def as_kind(v: np.ndarray, kind: str) -> np.ndarray:
    if np.dtype(kind).kind == "f":
        return v.astype(kind)
    return np.clip(np.rint(v), np.iinfo(kind).min, np.iinfo(kind).max).astype(kind)


def header(sizes: list[tuple[int, int]], tile: int, bands: int, kind: str, places: list[tuple[np.ndarray, np.ndarray]] | None, counts: list[int], description: str, per_cm: float | None) -> bytes:
    """A BigTIFF's directories, one a level, which take the same bytes whatever the places (offsets and sizes of tiles) are."""
    code = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    out, at = [struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)], 16
    for k, (w, h) in enumerate(sizes):
        offsets, lengths = places[k] if places else (np.zeros(counts[k]), np.zeros(counts[k]))
        entries: list[tuple[int, int, int, bytes]] = [
            (254, 4, 1, struct.pack("<I", int(k > 0))), (WIDTH, 4, 1, struct.pack("<I", w)), (HEIGHT, 4, 1, struct.pack("<I", h)),
            (BITS, 3, bands, np.full(bands, np.dtype(kind).itemsize * 8, "<u2").tobytes()), (COMPRESSION, 3, 1, struct.pack("<H", 8)),
            (PHOTOMETRIC, 3, 1, struct.pack("<H", 2 if bands == 3 else 1)), (SAMPLES, 3, 1, struct.pack("<H", bands)), (PLANAR, 3, 1, struct.pack("<H", 1)),
            (TILE_WIDTH, 4, 1, struct.pack("<I", tile)), (TILE_HEIGHT, 4, 1, struct.pack("<I", tile)),
            (TILE_OFFSETS, 16, counts[k], offsets.astype("<u8").tobytes()), (TILE_BYTES, 16, counts[k], lengths.astype("<u8").tobytes()),
            (SAMPLE_FORMAT, 3, bands, np.full(bands, code, "<u2").tobytes()),
        ]
        if description and k == 0:
            text = description.encode() + b"\0"
            entries.append((DESCRIPTION, 2, len(text), text))
        if per_cm:
            for tag in (X_RESOLUTION, Y_RESOLUTION):
                entries.append((tag, 5, 1, struct.pack("<II", round(per_cm * 100 / 2**k), 100)))
            entries.append((UNIT, 3, 1, struct.pack("<H", 3)))
        entries.sort()
        body, extra = [struct.pack("<Q", len(entries))], []
        free = at + 8 + 20 * len(entries) + 8
        for tag, type_, n, data in entries:
            if len(data) <= 8:
                body.append(struct.pack("<HHQ", tag, type_, n) + data.ljust(8, b"\0"))
            else:
                data += b"\0" * (-len(data) % 8)
                body.append(struct.pack("<HHQQ", tag, type_, n, free))
                extra.append(data)
                free += len(data)
        body.append(struct.pack("<Q", free if k + 1 < len(sizes) else 0))
        out += [*body, *extra]
        at = free
    return b"".join(out)


@dataclass
class Placed(WriterCommitMessage):
    files: list[str]


class PlacedWriter(DataSourceWriter):
    """Rows (file, place, data): bytes that go to a place of a file. All go to files of another name first, which commit renames."""

    def __init__(self, path: str, names: list[str]):
        self.path = local(path)
        if self.path is None:
            raise ValueError("several tasks write into one file: the target must be a folder of a shared POSIX file system")
        self.at = [names.index(n) for n in ("file", "place", "data")]
        self.mark = f".{uuid.uuid4().hex}.part"

    def write(self, iterator) -> Placed:
        os.makedirs(self.path, exist_ok=True)
        files, handle, current = set(), None, None
        try:
            for row in iterator:
                name, place, data = (row[k] for k in self.at)
                if name != current:
                    if handle is not None:
                        os.fsync(handle)
                        os.close(handle)
                    handle, current = os.open(f"{self.path}/{name}{self.mark}", os.O_CREAT | os.O_WRONLY), name
                    files.add(name)
                while data:
                    n = os.pwrite(handle, data, place)
                    data, place = data[n:], place + n
        finally:
            if handle is not None:
                os.fsync(handle)
                os.close(handle)
        return Placed(sorted(files))

    def commit(self, messages: list[Placed | None]) -> None:
        for name in sorted({f for m in messages if m for f in m.files}):
            os.replace(f"{self.path}/{name}{self.mark}", f"{self.path}/{name}")

    def abort(self, messages: list[Placed | None]) -> None:
        for f in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if f.endswith(self.mark):
                os.unlink(f"{self.path}/{f}")


def pyramid_tiles(pixels: DataFrame, bands: list[str], tile: int = 256, how: str = "mean") -> tuple[DataFrame, list[DataFrame]]:
    """Tiles of all levels, each made of the one before until a slide has one tile, and the tables to remove afterwards."""
    level = written(tiles_of(pixels, bands, tile), "tiles")
    held = [level]
    while True:
        # slides that still have more than one tile go on
        wide = level.groupBy("slide_id").agg(F.max(F.greatest("ty", "tx")).alias("last")).filter("last > 0").select("slide_id")
        level = written(next_level(level.join(wide, "slide_id", "left_semi"), len(bands), tile, how), "tiles")
        held.append(level)
        if level.isEmpty():
            break
    out = held[0]
    for more in held[1:]:
        out = out.unionByName(more)
    return out, held


def write_pyramids(pixels: DataFrame, path: str, bands: tuple[str, ...] = ("r", "g", "b"), tile: int = 256, how: str = "mean", kind: str = "<u1", top: float = 255.0, empty: float | None = None, description: str = "", pixel_size: float | None = None) -> None:
    """A tiled BigTIFF with all levels for each slide of pixels(slide_id, row, col, bands), as <slide_id>.tif under path.

    Values times `top` are rounded half to even (not those of float kinds); places without a pixel get `empty` (white, or
    0 with one band), tiles without any have no bytes and read as 0. Levels
    are made of unrounded values by mean, median, max, min, mode (the smallest) or nearest (the first of a block).
    """
    if tile % 16:
        raise ValueError("a tile's side must be a multiple of 16")
    names, fill = list(bands), empty if empty is not None else top if len(bands) > 1 else 0.0
    spark, n = pixels.sparkSession, len(bands)
    spark.dataSource.register(TiffSource)
    sizes = pixels.groupBy("slide_id").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))
    tiles, held = pyramid_tiles(pixels, names, tile, how)

    @F.pandas_udf("binary")
    def pressed(data: pd.Series) -> pd.Series:
        out = []
        for d in data:
            v = np.frombuffer(d) * top
            out.append(zlib.compress(as_kind(np.where(np.isnan(v), fill, v), kind).tobytes(), 6))
        return pd.Series(out, dtype=object)

    made = written(tiles.select("slide_id", "level", "ty", "tx", pressed("data").alias("data")).withColumn("n", F.octet_length("data").cast("long")), "pressed")
    deleted(*held)
    before = F.sum("n").over(Window.partitionBy("slide_id").orderBy("level", "ty", "tx")) - F.col("n")
    placed = made.withColumn("before", before)

    def heads(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        levels, counts, grids = [], [], []
        for k in range(int(pdf["level"].max()) + 1):
            levels.append((max(1, math.ceil(w / 2**k)), max(1, math.ceil(h / 2**k))))
            grids.append((math.ceil(levels[k][0] / tile), math.ceil(levels[k][1] / tile)))
            counts.append(grids[k][0] * grids[k][1])
        start = len(header(levels, tile, n, kind, None, counts, description, 1e4 / pixel_size if pixel_size else None))
        places = []
        for k in range(len(levels)):
            own = pdf[pdf["level"] == k]
            offsets, lengths = np.zeros(counts[k], dtype=np.int64), np.zeros(counts[k], dtype=np.int64)
            at = (own["ty"] * grids[k][0] + own["tx"]).to_numpy()
            offsets[at], lengths[at] = own["before"] + start, own["n"]
            places.append((offsets, lengths))
        data = header(levels, tile, n, kind, places, counts, description, 1e4 / pixel_size if pixel_size else None)
        return pd.DataFrame({"slide_id": [key[0]], "data": [data]})

    # a row a tile of the slide, without its bytes
    index = placed.drop("data").join(sizes, "slide_id").groupBy("slide_id").applyInPandas(heads, "slide_id string, data binary")
    index = written(index, "heads")
    file = F.concat("slide_id", F.lit(".tif")).alias("file")
    body = placed.join(index.select("slide_id", F.octet_length("data").cast("long").alias("start")), "slide_id").select(file, (F.col("start") + F.col("before")).alias("place"), "data")
    index.select(file, F.lit(0).cast("long").alias("place"), "data").unionByName(body).write.format(TiffSource.name()).option("path", path).mode("append").save()
    deleted(made, index)


def put(path: str, data: bytes) -> None:
    """A whole file; on local file systems it appears at once."""
    at = local(path)
    if at is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        part = f"{at}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, at)
    else:
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_output_stream(inner) as f:
            f.write(data)


def write_zarr(pixels: DataFrame, path: str, bands: tuple[str, ...] = ("r", "g", "b"), tile: int = 256, how: str = "mean", kind: str = "<u1", top: float = 255.0, empty: float = 0.0, pixel_size: float = 1.0) -> None:
    """An OME-Zarr (version 0.4) with all levels for each slide of pixels, as <slide_id>.zarr under path: a chunk of all bands a file.

    A lost task writes its chunks again, with the same bytes; metadata come last, so an image is whole where it has them.
    """
    n = len(bands)
    sizes = {r["slide_id"]: (r["h"], r["w"]) for r in pixels.groupBy("slide_id").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h")).collect()}
    tiles, held = pyramid_tiles(pixels, list(bands), tile, how)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for slide, level, ty, tx, data in pdf.itertuples(index=False):
                v = (np.frombuffer(data) * top).reshape(tile, tile, n).transpose(2, 0, 1)
                put(f"{path}/{slide}.zarr/{level}/0/{ty}/{tx}", zlib.compress(as_kind(np.where(np.isnan(v), empty, v), kind).tobytes(), 6))
            yield pdf[["slide_id", "level"]]

    made = tiles.select("slide_id", "level", "ty", "tx", "data").mapInPandas(run, "slide_id string, level int")
    depths = made.groupBy("slide_id").agg(F.max("level").alias("last")).collect()
    axes = [{"name": "c", "type": "channel"}, {"name": "y", "type": "space", "unit": "micrometer"}, {"name": "x", "type": "space", "unit": "micrometer"}]
    for r in depths:
        h, w = sizes[r["slide_id"]]
        for k in range(r["last"] + 1):
            shape = [n, max(1, math.ceil(h / 2**k)), max(1, math.ceil(w / 2**k))]
            array = {"zarr_format": 2, "shape": shape, "chunks": [n, tile, tile], "dtype": np.dtype(kind).str, "compressor": {"id": "zlib", "level": 6}, "fill_value": empty, "order": "C", "filters": None, "dimension_separator": "/"}
            put(f"{path}/{r['slide_id']}.zarr/{k}/.zarray", json.dumps(array).encode())
        datasets = [{"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [1.0, pixel_size * 2**k, pixel_size * 2**k]}]} for k in range(r["last"] + 1)]
        put(f"{path}/{r['slide_id']}.zarr/.zgroup", b'{"zarr_format": 2}')
        put(f"{path}/{r['slide_id']}.zarr/.zattrs", json.dumps({"multiscales": [{"version": "0.4", "name": str(r["slide_id"]), "axes": axes, "datasets": datasets}]}).encode())
    deleted(*held)


def write_masks(mask: DataFrame, path: str, legend: dict[int, str] | None = None, tile: int = 256, kind: str = "<u2") -> None:
    """masks(mask_id, row, col, label) as tiled TIFF of one band with smaller levels (the nearest label), and the legend as JSON in the description."""
    text = json.dumps({"legend": {str(k): v for k, v in sorted((legend or {}).items())}})
    write_pyramids(mask.withColumnRenamed("mask_id", "slide_id"), path, ("label",), tile, "nearest", kind, 1.0, 0.0, text)


def read_mask_files(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """mask(mask_id, row, col, label) of tiled TIFF masks, pixels of 0 left out."""
    found = read_tiff(spark, path, level_from=level, level_to=level + 1)
    return found.filter("channel = 0 AND value <> 0").select(F.col("slide_id").alias("mask_id"), "row", "col", F.col("value").cast("int").alias("label"))
