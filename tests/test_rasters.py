"""Zarr and TIFF: files that the tests write byte by byte, round trips, and reads that touch the wanted chunks alone."""

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from slidelake.operators import pixels as P
from slidelake.sources import rasters as R


def tiff(path, pages, order="<", big=False, codec=8, predictor=1, planar=1, extra=()):
    """A file of tiled pages (arrays of rows, columns, bands) with tiles of 16 x 16, directories last."""
    word, count = ("Q", "Q") if big else ("I", "H")
    press = {1: bytes, 8: zlib.compress}[codec]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HHHQ" if big else order + "HI", *((43, 8, 0, 0) if big else (42, 0))))
    link = len(out) - struct.calcsize(word)
    for number, a in enumerate(pages):
        h, w, n = a.shape
        padded = np.zeros((-(-h // 16) * 16, -(-w // 16) * 16, n), a.dtype)
        padded[:h, :w] = a
        places = []
        for c in range(n) if planar == 2 else [slice(None)]:
            for y in range(0, padded.shape[0], 16):
                for x in range(0, padded.shape[1], 16):
                    t = padded[y : y + 16, x : x + 16, c]
                    if predictor == 2:
                        t = np.diff(t, axis=1, prepend=np.zeros_like(t[:, :1]))
                    data = press(t.astype(a.dtype.newbyteorder(order)).tobytes())
                    places.append((len(out), len(data)))
                    out += data
        entries = {256: (4, [w]), 257: (4, [h]), 258: (3, [a.dtype.itemsize * 8] * n), 259: (3, [codec]), 277: (3, [n]), 284: (3, [planar]), 317: (3, [predictor]), 322: (4, [16]), 323: (4, [16]), 324: (4, [p for p, _ in places]), 325: (4, [n for _, n in places])}
        if number == 0:
            entries |= dict(extra)
        body = struct.pack(order + count, len(entries))
        size = struct.calcsize(word)
        at = len(out)
        free = at + len(body) + len(entries) * (4 + 2 * size) + size
        tail = b""
        for tag, (kind, values) in sorted(entries.items()):
            data = values if isinstance(values, bytes) else b"".join(struct.pack(order + {3: "H", 4: "I", 5: "II"}[kind], *(v if isinstance(v, tuple) else (v,))) for v in values)
            body += struct.pack(order + "HH" + word, tag, kind, len(values))
            if len(data) > size:
                body += struct.pack(order + word, free + len(tail))
                tail += data
            else:
                body += data.ljust(size, b"\0")
        out[link : link + size] = struct.pack(order + word, at)
        link = at + len(body)
        out += body + b"\0" * size + tail
    Path(path).write_bytes(bytes(out))


def zarr(path, levels, chunk=(3, 16, 16), version=2, codec="zlib", separator="/"):
    """Arrays of bands, rows, columns."""
    for k, a in enumerate(levels):
        root = Path(path) / str(k)
        root.mkdir(parents=True)
        if version == 2:
            meta = {"zarr_format": 2, "shape": a.shape, "chunks": chunk, "dtype": a.dtype.str, "compressor": None if codec is None else {"id": codec}, "fill_value": 7, "order": "C", "filters": None, "dimension_separator": separator}
            (root / ".zarray").write_text(json.dumps(meta))
        else:
            meta = {"zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": a.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default"}, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}], "fill_value": 7}
            (root / "zarr.json").write_text(json.dumps(meta))
        for i in range(-(-a.shape[0] // chunk[0])):
            for y in range(-(-a.shape[1] // chunk[1])):
                for x in range(-(-a.shape[2] // chunk[2])):
                    t = np.zeros(chunk, a.dtype)
                    part = a[i * chunk[0] : (i + 1) * chunk[0], y * chunk[1] : (y + 1) * chunk[1], x * chunk[2] : (x + 1) * chunk[2]]
                    t[: part.shape[0], : part.shape[1], : part.shape[2]] = part
                    press = zlib.compressobj(6, zlib.DEFLATED, 31) if version == 3 else None
                    data = t.tobytes() if codec is None else press.compress(t.tobytes()) + press.flush() if press else zlib.compress(t.tobytes())
                    name = separator.join(map(str, (i, y, x))) if version == 2 else f"c/{i}/{y}/{x}"
                    (root / name).parent.mkdir(parents=True, exist_ok=True)
                    (root / name).write_bytes(data)
    scales = {"multiscales": [{"axes": [{"name": n} for n in "cyx"], "datasets": [{"path": str(k)} for k in range(len(levels))]}]}
    if version == 2:
        (Path(path) / ".zattrs").write_text(json.dumps(scales))
    else:
        (Path(path) / "zarr.json").write_text(json.dumps({"attributes": {"ome": scales}}))


def image(seed, h, w, bands=3, kind="u1"):
    return np.random.default_rng(seed).integers(0, 200, (h, w, bands)).astype(kind)


def cells(df):
    return {(r.slide_id, r.level, r.channel, r.row, r.col): r.value for r in df.collect()}


def wanted(name, levels, rows=slice(None), cols=slice(None)):
    out = {}
    for k, a in enumerate(levels):
        for (r, c, b), v in np.ndenumerate(a):
            if r in range(*rows.indices(a.shape[0])) and c in range(*cols.indices(a.shape[1])):
                out[name, k, b, r, c] = float(v)
    return out


@pytest.mark.parametrize(("order", "big", "codec", "predictor", "planar", "kind"), [("<", False, 1, 1, 1, "u1"), (">", False, 8, 2, 1, "u2"), ("<", True, 8, 1, 2, "u1"), (">", True, 1, 1, 1, "u2")])
def test_tiff_files(spark, tmp_path, order, big, codec, predictor, planar, kind):
    levels = [image(1, 40, 50, 3, kind), image(2, 20, 25, 3, kind)]
    tiff(tmp_path / "a.tif", levels, order, big, codec, predictor, planar)
    assert cells(R.read_tiff(spark, str(tmp_path / "a.tif"))) == wanted("a", levels)


@pytest.mark.parametrize(("version", "codec", "separator", "chunk"), [(2, "zlib", "/", (3, 16, 16)), (2, None, ".", (1, 16, 20)), (3, "gzip", "/", (2, 16, 16))])
def test_zarr_files(spark, tmp_path, version, codec, separator, chunk):
    levels = [image(3, 40, 50), image(4, 20, 25)]
    zarr(tmp_path / "z.ome.zarr", [a.transpose(2, 0, 1) for a in levels], chunk, version, codec, separator)
    assert cells(R.read_zarr(spark, str(tmp_path / "z.ome.zarr"))) == wanted("z", levels)


def test_missing_chunks_are_filled_and_codecs_named(spark, tmp_path):
    a = image(3, 20, 20)
    zarr(tmp_path / "z.zarr", [a.transpose(2, 0, 1)])
    (tmp_path / "z.zarr/0/0/1/1").unlink()
    want = a.copy()
    want[16:, 16:] = 7
    assert cells(R.read_zarr(spark, str(tmp_path / "z.zarr"))) == wanted("z", [want])
    zarr(tmp_path / "b.zarr", [a.transpose(2, 0, 1)], codec="blosc")
    with pytest.raises(Exception, match="blosc"):
        R.read_zarr(spark, str(tmp_path / "b.zarr")).collect()
    with pytest.raises(Exception, match="no_such|cannot be found|FileNotFound"):
        R.read_zarr(spark, str(tmp_path / "no_such.zarr")).collect()


@pytest.mark.parametrize("kind", ["tiff", "zarr"])
def test_a_box_reads_its_chunks_alone(spark, tmp_path, kind):
    levels = [image(5, 100, 120), image(6, 50, 60)]
    if kind == "tiff":
        path = tmp_path / "a.tif"
        tiff(path, levels, codec=1)
        data = bytearray(path.read_bytes())
        page = R.tiff_pages(R.TiffImage(str(path)).source)[0]
    else:
        path = tmp_path / "a.zarr"
        zarr(path, [a.transpose(2, 0, 1) for a in levels])
    reader = R.ChunkReader(kind, {"path": str(path), "chunks": "2"})
    kept = list(reader.pushFilters([R.EqualTo(("level",), 0), R.GreaterThanOrEqual(("row",), 20), R.LessThan(("row",), 40), R.GreaterThan(("col",), 31), R.LessThanOrEqual(("col",), 63), R.EqualTo(("value",), 3.0)]))
    assert len(kept) == 6
    parts = reader.partitions()
    touched = {p for part in parts for p in part.places}
    assert touched == {(y, x) for y in (1, 2) for x in (2, 3)} and len(parts) == 2 and {p.level.number for p in parts} == {0}
    # what is not wanted is spoilt
    across = R.IMAGES[kind](str(path)).levels()[0].across
    for k in range(across * 7):
        if divmod(k, across) not in touched:
            if kind == "tiff":
                data[int(page.tags[R.TILE_OFFSETS][k])] ^= 255
            else:
                (path / "0/0" / str(k // across) / str(k % across)).write_bytes(b"spoilt")
    if kind == "tiff":
        path.write_bytes(bytes(data))
    read = R.read_tiff if kind == "tiff" else R.read_zarr
    box = wanted("a", levels[:1], slice(20, 40), slice(32, 64))
    assert cells(read(spark, str(path)).filter("level = 0 AND row >= 20 AND row < 40 AND col >= 32 AND col < 64")) == box
    assert cells(read(spark, str(path), level_to=1, row_from=20, row_to=40, col_from=32, col_to=64)) == box
    assert read(spark, str(path)).filter("slide_id = 'other'").count() == 0


def test_open_slides(spark, tmp_path):
    levels = [image(1, 40, 60), image(2, 20, 30), image(3, 10, 15)]
    text = b"Aperio Image\r\n40x60|AppMag = 20|MPP = 0.5\0"
    tiff(tmp_path / "a.svs", levels, extra=[(270, (2, text)), (282, (5, [(20000, 1)])), (283, (5, [(20000, 1)])), (296, (3, [3]))])
    tiff(tmp_path / "b.tif", levels[:1])
    found = {r.slide_id: r for r in R.open_slides(spark, str(tmp_path)).collect()}
    a = found["a"]
    assert (a.width, a.height, a.associated) == (60, 40, 0) and [(x.width, x.height, x.downsample) for x in a.levels] == [(60, 40, 1.0), (30, 20, 2.0), (15, 10, 4.0)]
    assert a.properties["aperio.AppMag"] == "20" and a.properties["tiff.XResolution"] == "20000.0" and a.properties["tiff.ResolutionUnit"] == "centimeter"
    assert len(found["b"].levels) == 1


@pytest.fixture(scope="module")
def pixels(spark):
    r = np.random.default_rng(8)
    rows = [(s, y, x, *map(float, r.uniform(0, 1, 3))) for s, h, w in (("a", 70, 100), ("b", 5, 9)) for y in range(h) for x in range(w) if (x + y) % 13]
    return spark.createDataFrame([*rows, ("a", 69, 99, 0.1, 0.2, 0.3), ("b", 4, 8, 0.4, 0.5, 0.6)], "slide_id string, row int, col int, r double, g double, b double").dropDuplicates(["slide_id", "row", "col"])


def stepped(pixels, k, how):
    df = pixels.withColumnRenamed("slide_id", "tile_id")
    for _ in range(k):
        df = P.pyramid_step(df, how)
    return {(r.tile_id, r.row, r.col): (r.r, r.g, r.b) for r in df.collect()}


@pytest.mark.parametrize("how", ["mean", "median", "max", "mode", "nearest"])
def test_pyramids_are_repeated_steps(spark, tmp_path, pixels, how):
    R.write_pyramids(pixels, str(tmp_path), tile=32, how=how, kind="<f8", top=1.0, empty=-1.0)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.tif", "b.tif"]
    back = R.as_rgb(R.read_tiff(spark, str(tmp_path)), 1.0).filter("r >= 0").collect()
    assert {(r.slide_id, r.level) for r in back} == {("a", 0), ("a", 1), ("a", 2), ("b", 0)}
    for k in range(3):
        want = {key: v for key, v in stepped(pixels, k, how).items() if key[0] == "a" or k == 0}
        got = {(r.slide_id, r.row, r.col): (r.r, r.g, r.b) for r in back if r.level == k}
        assert got.keys() == want.keys()
        assert all(got[key] == pytest.approx(want[key], abs=1e-12) for key in want)


def test_bytes_are_rounded_and_directories_hold(spark, tmp_path, pixels):
    R.write_pyramids(pixels, str(tmp_path), tile=32, description="made here", pixel_size=0.5)
    a = {r.slide_id: r for r in R.open_slides(spark, str(tmp_path)).collect()}["a"]
    assert [(x.width, x.height) for x in a.levels] == [(100, 70), (50, 35), (25, 18)]
    assert a.properties["tiff.ImageDescription"] == "made here" and float(a.properties["tiff.XResolution"]) == 20000
    got = {(r.slide_id, r.row, r.col): r for r in R.as_rgb(R.read_tiff(spark, str(tmp_path), level_to=1), 1.0).collect()}
    for r in pixels.collect():
        assert tuple(got[r.slide_id, r.row, r.col][c] for c in "rgb") == tuple(np.rint(np.array([r.r, r.g, r.b]) * 255))
    assert got["a", 0, 0]["r"] == 255  # no pixel


def test_zarr_round_trip(spark, tmp_path, pixels):
    R.write_zarr(pixels, str(tmp_path), tile=32, kind="<f8", top=1.0, empty=-1.0, pixel_size=0.5)
    back = R.as_rgb(R.read_zarr(spark, str(tmp_path)), 1.0).filter("r >= 0").collect()
    for k in range(3):
        want = {key: v for key, v in stepped(pixels, k, "mean").items() if key[0] == "a" or k == 0}
        got = {(r.slide_id, r.row, r.col): (r.r, r.g, r.b) for r in back if r.level == k}
        assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], abs=1e-12) for key in want)


def test_masks_with_a_legend(spark, tmp_path):
    rows = [("m", r, c, 1 + (r * c) % 300) for r in range(40) for c in range(70) if (r + c) % 3]
    mask = spark.createDataFrame(rows, "mask_id string, row int, col int, label int")
    R.write_masks(mask, str(tmp_path), {1: "tumour", 2: "stroma"}, tile=32)
    assert {(r.mask_id, r.row, r.col, r.label) for r in R.read_mask_files(spark, str(tmp_path)).collect()} == set(rows)
    held = R.open_slides(spark, str(tmp_path)).first()
    assert json.loads(held.properties["tiff.ImageDescription"])["legend"] == {"1": "tumour", "2": "stroma"}


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    writer = R.PlacedWriter(str(tmp_path), ["file", "place", "data"])
    done = writer.write(iter([("x.tif", 4, b"efgh"), ("x.tif", 0, b"abcd"), ("y.tif", 0, b"z")]))
    again = writer.write(iter([("x.tif", 4, b"efgh")]))
    assert not (tmp_path / "x.tif").exists()
    writer.commit([done, again, None])
    assert (tmp_path / "x.tif").read_bytes() == b"abcdefgh" and len(list(tmp_path.iterdir())) == 2
    other = R.PlacedWriter(str(tmp_path), ["file", "place", "data"])
    other.write(iter([("x.tif", 0, b"zzzz")]))
    other.abort([])
    assert (tmp_path / "x.tif").read_bytes() == b"abcdefgh" and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(ValueError):
        R.write_pyramids(spark.createDataFrame([], "slide_id string, row int, col int, r double, g double, b double"), str(tmp_path), tile=20)
