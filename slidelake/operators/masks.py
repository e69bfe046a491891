"""Label masks: rasterising regions, connected components, contours (H1, H31, H32, N45-N49). mask(mask_id, row, col, label), rows and columns from 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..sources.work import written
from .links import smallest_members
from .regions import areal

#: The side of the blocks in which a mask is labelled.
BLOCK = 256


def runs(rois: DataFrame, width: int, height: int, scale: float = 1.0) -> DataFrame:
    """roi_index, shape, part, hole, row, first, end: the stretches of pixels whose centres a ring holds, by scan line.

    Each side of a ring meets the lines between its ends, a row a line; the crossings of a ring with a line, in order,
    are the ends of stretches. Nothing here has a row a pixel. `shape` tells rows of one index apart, by their geometry.
    """
    own = ["roi_index", "shape", "part"]
    sides = areal(rois).select("roi_index", F.xxhash64("geometry").alias("shape"), F.posexplode("geometry").alias("part", "polygon")).select(*own, F.posexplode("polygon").alias("ring", "r"))
    sides = sides.filter(F.size("r") > 1).select(*own, "ring", "r", F.explode(F.sequence(F.lit(1), F.size("r") - 1)).alias("k"))
    a, b = F.get("r", F.col("k") - 1), F.get("r", F.col("k"))
    sides = sides.select(*own, "ring", a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")).filter("ay <> by")
    # a line more at both ends, then the exact rule
    low, high = (f(F.col("ay"), F.col("by")) / scale for f in (F.least, F.greatest))
    top, foot = F.greatest(F.lit(0), F.floor(low - 1.5)), F.least(F.lit(height - 1), F.ceil(high + 0.5))
    lines = sides.filter(top <= foot).withColumn("row", F.explode(F.sequence(top.cast("int"), foot.cast("int")))).withColumn("y", (F.col("row") + 0.5) * scale)
    lines = lines.filter((F.col("by") > F.col("y")) != (F.col("ay") > F.col("y")))
    at = (F.col("ax") - F.col("bx")) * (F.col("y") - F.col("by")) / (F.col("ay") - F.col("by")) + F.col("bx")
    crossed = lines.groupBy(*own, "ring", "row").agg(F.sort_array(F.collect_list(at)).alias("at"))
    # a ring that is not closed may be crossed an odd number of times: it holds what lies to the left
    crossed = crossed.withColumn("at", F.when(F.size("at") % 2 == 1, F.concat(F.array(F.lit(float("-inf"))), "at")).otherwise(F.col("at")))
    pair = crossed.select(*own, (F.col("ring") > 0).alias("hole"), "row", "at", F.explode(F.sequence(F.lit(0), (F.size("at") / 2 - 1).cast("int"))).alias("k"))

    def column(x: Column) -> Column:
        """The first pixel whose centre is not left of x."""
        c = F.greatest(F.lit(-1.0), F.least(F.lit(float(width + 1)), F.ceil(x / scale - 0.5).cast("double")))
        c = F.when((c - 0.5) * scale >= x, c - 1).when((c + 0.5) * scale < x, c + 1).otherwise(c)
        return F.greatest(F.lit(0.0), F.least(F.lit(float(width)), c)).cast("int")

    ends = [column(F.get("at", 2 * F.col("k") + i)) for i in (0, 1)]
    return pair.select(*own, "hole", "row", ends[0].alias("first"), ends[1].alias("end")).filter("first < end")


def rois_to_mask(rois: DataFrame, width: int, height: int, scale: float = 1.0, overlap: str = "last") -> DataFrame:
    """Row, col, label (roi_index + 1) of pixels whose centre lies in a region; where regions overlap the last or the first wins."""
    cells = runs(rois, width, height, scale).select("roi_index", "shape", "part", "hole", "row", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("col"))
    hit = cells.groupBy("row", "col", "roi_index", "shape", "part").agg(F.bool_or("hole").alias("hole")).filter("NOT hole")
    pick = F.max if overlap == "last" else F.min
    out = hit.groupBy("row", "col").agg(pick("roi_index").alias("roi_index"), F.min("roi_index").alias("low"), F.max("roi_index").alias("high"))
    if overlap == "error":
        out = out.filter(F.when(F.col("low") < F.col("high"), F.raise_error(F.lit("regions overlap")).cast("boolean")).otherwise(F.lit(True)))
    return out.select("row", "col", (F.col("roi_index") + 1).alias("label"))


def codebook(rois: DataFrame, label_by: str = "index", values: dict[str, int] | None = None) -> DataFrame:
    """roi_index, value, key: what stands for each region in a mask, by class, id, name, index or constant.

    Values of classes, ids and names count from 1 in the order in which they first come, empty ones as `unlabelled`;
    with `values` they are those, and a key without one is an error.
    """
    if label_by == "constant":
        return rois.select("roi_index", F.lit(1).alias("value"), F.lit("foreground").alias("key"))
    columns = {"class": "class", "id": "roi_id", "name": "name", "index": "roi_id"}
    if label_by not in columns:
        raise ValueError(f"label_by must be one of constant, {', '.join(columns)}")
    blank = F.nullif(F.trim(F.col(columns[label_by]).cast("string")), F.lit(""))
    keys = rois.select("roi_index", F.coalesce(blank, F.lit("unlabelled")).alias("key"))
    if values is not None:
        of = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(int(v)))]) if values else F.lit(None).cast("map<string,int>")
        known = F.element_at(of, F.col("key"))
        return keys.select("roi_index", F.when(known.isNull(), F.raise_error(F.concat(F.lit("no value for "), "key")).cast("int")).otherwise(known).alias("value"), "key")
    if label_by == "index":
        return keys.select("roi_index", (F.col("roi_index") + 1).alias("value"), "key")
    # a row a key
    named = keys.groupBy("key").agg(F.min("roi_index").alias("first"))
    named = named.select("key", F.row_number().over(Window.orderBy("first")).alias("value"))
    return keys.join(named, "key").select("roi_index", "value", "key")


def coded_mask(rois: DataFrame, book: DataFrame, width: int, height: int, scale: float = 1.0, overlap: str = "last") -> DataFrame:
    """Row, col, label of rois_to_mask with the values of a codebook."""
    mask = rois_to_mask(rois, width, height, scale, overlap)
    return mask.join(book.select((F.col("roi_index") + 1).alias("label"), "value"), "label").select("row", "col", F.col("value").alias("label"))


def components(grid: np.ndarray, eight: bool = True) -> np.ndarray:
    """Component numbers from 1 of the true cells, in column-major order of their first cell; 0 elsewhere.

    By runs: stretches of true cells within a column. Runs of neighbouring columns that touch are found by two searches
    in their sorted ends; each pair hangs the larger label under the smaller one, and labels are followed to their roots,
    in rounds until all pairs agree. No step goes cell by cell.
    """
    out = np.zeros(grid.shape, dtype=np.int32)
    turned = np.ascontiguousarray(grid.T, dtype=bool)
    step = np.diff(np.pad(turned, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    col, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    if not len(col):
        return out
    # places along all columns, with room between them
    wide, reach = grid.shape[0] + 4, int(eight)
    first, last = col * wide + start + 1, col * wide + end + 1
    low = np.searchsorted(last, first + wide - reach, side="right")
    high = np.searchsorted(first, last + wide + reach, side="left")
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(col)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(col))
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]) is not None and (up != label).any():
            label = up
    # a root is the first run of its component
    number = np.cumsum(label == np.arange(len(col)))[label]
    out.T[turned] = np.repeat(number, end - start)
    return out


def rings(edges: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed rings from directed cell sides (x0, y0, x1, y1), with the cells on the right; corners only. Where four sides meet, the ring turns so that cells that touch by a corner stay together."""
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in edges.tolist():
        nxt.setdefault((x0, y0), []).append((x1, y1))
    out = []
    for start in sorted(nxt):
        while start in nxt:
            ring, at, way = [start], start, None
            while True:
                ways = nxt[at]
                turn = lambda b: 0 if way is None else -(way[0] * (b[1] - at[1]) - way[1] * (b[0] - at[0]))  # noqa: B023, E731
                b = min(ways, key=turn)
                ways.remove(b)
                if not ways:
                    del nxt[at]
                way, at = (b[0] - at[0], b[1] - at[1]), b
                ring.append(at)
                if at == start:
                    break
            kept = [p for k, p in enumerate(ring[:-1]) if (ring[k - 1 if k else -2][0] - p[0]) * (ring[k + 1][1] - p[1]) != (ring[k - 1 if k else -2][1] - p[1]) * (ring[k + 1][0] - p[0])]
            out.append([(float(x), float(y)) for x, y in [*kept, kept[0]]])
    return out


def ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    """Even-odd crossings of a ring of axis-parallel sides."""
    return sum((a[1] > y) != (b[1] > y) and x < a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1


def polygons(edges: np.ndarray) -> list[list[list[tuple[float, float]]]]:
    """Shells with their holes. A hole belongs to the smallest shell that holds the cell on the right of its first side."""
    found = rings(edges)
    shells, holes = [[r] for r in found if ring_area(r) > 0], [r for r in found if ring_area(r) < 0]
    for h in holes:
        (x0, y0), (x1, y1) = h[:2]
        dx, dy = np.sign(x1 - x0), np.sign(y1 - y0)
        x, y = x0 + dx / 2 - dy / 2, y0 + dy / 2 + dx / 2
        own = [s for s in shells if holds(s[0], x, y)]
        min(own, key=lambda s: ring_area(s[0])).append(h)
    return shells


def blocks_labelled(mask: DataFrame, eight: bool) -> DataFrame:
    """mask with `node`, which names the component of its pixel within a block of BLOCK x BLOCK: its first pixel in column-major order, as column * 2^32 + row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        pdf["node"] = np.int64(0)
        for _, own in pdf.groupby("label"):
            grid = np.zeros((int(own["row"].max()) - r0 + 1, int(own["col"].max()) - c0 + 1), dtype=bool)
            r, c = own["row"].to_numpy() - r0, own["col"].to_numpy() - c0
            grid[r, c] = True
            numbers = components(grid, eight)[r, c]
            place = (own["col"].to_numpy().astype(np.int64) << 32) + own["row"].to_numpy()
            first = np.full(numbers.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, numbers, place)
            pdf.loc[own.index, "node"] = first[numbers]
        return pdf[["mask_id", "label", "row", "col", "node"]]

    rows = mask.select(F.col("mask_id").cast("string").alias("mask_id"), F.col("label").cast("int").alias("label"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    at = [F.floor(F.col(c) / BLOCK).alias(f"b{c}") for c in ("row", "col")]
    return rows.groupBy("mask_id", *at).applyInPandas(lambda pdf: run(pdf.reset_index(drop=True)), "mask_id string, label int, row int, col int, node long")


def labelled(mask: DataFrame, eight: bool = True) -> DataFrame:
    """mask(mask_id, label, row, col) with `root`, the component of its pixel: the first of its pixels in column-major order.

    Blocks are labelled each in a task; a pixel at a block's low edge meets its neighbours in other blocks by an
    equality join, and the links between blocks become components by rounds of joins. No task holds a mask.
    """
    held = written(blocks_labelled(mask, eight), "blocks")
    steps = [(-1, 0), (0, -1)] + ([(-1, -1), (-1, 1)] if eight else [])
    edge = "row % {0} = 0 OR col % {0} = 0 OR col % {0} = {1}".format(BLOCK, BLOCK - 1)
    sent = held.filter(edge).withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    sent = sent.select("mask_id", "label", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), F.col("node").alias("a"))
    met = sent.join(held.withColumnRenamed("node", "b"), ["mask_id", "label", "row", "col"]).filter("a <> b").select("mask_id", "label", "a", "b").distinct()
    key = lambda c: F.struct("mask_id", "label", F.col(c).alias("node"))
    links = written(met.select(key("a").alias("a"), key("b").alias("b")), "links")
    if links.isEmpty():
        return held.withColumnRenamed("node", "root")
    roots = smallest_members(links).select("node.*", F.col("label").alias("to")).select("mask_id", "label", "node", F.col("to.node").alias("root"))
    return held.join(roots, ["mask_id", "label", "node"], "left").select("mask_id", "label", "row", "col", F.coalesce("root", "node").alias("root"))


def _numbered(pixels: DataFrame, least_area: int) -> DataFrame:
    """mask_id, label, root, component, area and box of the components that are large enough, numbered from 1 in the order of their first pixels."""
    area = pixels.groupBy("mask_id", "label", "root").agg(F.count("*").alias("area"), F.min("col").alias("xmin"), F.min("row").alias("ymin"), (F.max("col") + 1).alias("xmax"), (F.max("row") + 1).alias("ymax"))
    place = F.row_number().over(Window.partitionBy("mask_id", "label").orderBy("root"))
    return area.filter(F.col("area") >= least_area).withColumn("component", place)


def mask_components(mask: DataFrame, least_area: int = 1, eight: bool = True) -> DataFrame:
    """The connected components of each label of each mask: area and box in pixels."""
    return _numbered(labelled(mask, eight), least_area).select("mask_id", "label", "component", "area", "xmin", "ymin", "xmax", "ymax")


def mask_to_rois(mask: DataFrame, scale: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), least_area: int = 1, eight: bool = True) -> DataFrame:
    """Each component as a region: its outer ring and holes, scaled and shifted. With diagonal neighbours a component may have several shells.

    A pixel's sides that no pixel of the component shares are what reaches the task that follows them into rings: a
    component's outline, not its area.
    """
    pixels = written(labelled(mask, eight), "labelled")
    table = _numbered(pixels, least_area)
    # a side, as (x, y, vertical), with the way that has the pixel on its right
    side = lambda x, y, vertical, way: F.struct(x.alias("x"), y.alias("y"), F.lit(vertical).alias("vertical"), F.lit(way).alias("way"))
    r, c = F.col("row"), F.col("col")
    sides = pixels.select("mask_id", "label", "root", F.explode(F.array(side(c, r, False, 1), side(c + 1, r, True, 1), side(c, r + 1, False, -1), side(c, r, True, -1))).alias("s"))
    outline = sides.groupBy("mask_id", "label", "root", "s.x", "s.y", "s.vertical").agg(F.sum("s.way").alias("way")).filter("way <> 0")
    long = outline.select("mask_id", "label", "root", "way", "x", "y", (F.col("x") + (~F.col("vertical")).cast("int")).alias("u"), (F.col("y") + F.col("vertical").cast("int")).alias("v"))
    ahead = F.col("way") == 1
    ways = long.select("mask_id", "label", "root", *[F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("x0", "x", "u"), ("y0", "y", "v"), ("x1", "u", "x"), ("y1", "v", "y"))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = polygons(pdf[["x0", "y0", "x1", "y1"]].to_numpy())
        shape = [[[[x * scale + origin[0], y * scale + origin[1]] for x, y in ring] for ring in polygon] for polygon in found]
        return pd.DataFrame({"mask_id": [pdf["mask_id"].iloc[0]], "label": [pdf["label"].iloc[0]], "component": [pdf["component"].iloc[0]], "area": [pdf["area"].iloc[0]], "geometry": [shape]})

    met = ways.join(table.select("mask_id", "label", "root", "component", "area"), ["mask_id", "label", "root"])
    return met.groupBy("mask_id", "label", "component").applyInPandas(run, f"mask_id string, label int, component int, area long, geometry {G.GEOMETRY}")


def tissue_mask(pixels: DataFrame, saturation: float = 0.05, brightness: float = 0.8) -> DataFrame:
    """H1 (simple): tissue pixels as a mask: saturated, or not bright."""
    from . import pixels as P

    return pixels.filter((P.saturation() >= saturation) | (P.brightness() <= brightness)).select(F.col("tile_id").cast("string").alias("mask_id"), "row", "col", F.lit(1).alias("label"))


def dilated(mask: DataFrame, radius: int = 1) -> DataFrame:
    """The mask grown by a disk."""
    disk = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disk])
    sent = mask.select("mask_id", "label", "row", "col", F.explode(spots).alias("s"))
    return sent.select("mask_id", "label", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col")).distinct()
