"""Artefact candidates of tiles: pen marks, folds, bubbles, dust, stain faults.

Every tile is one group: its pixels become small arrays, connected components are described by shape, edges and the
ring about them, and those that pass the limits count. Pixels that a tile lacks are black.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .masks import components

EPSILON = 1 / 255
#: Limits by kind; they may be overridden by name.
LIMITS = {
    "fold": {"high_od": 1.2, "saturation": 0.25, "brightness": 0.45, "edge": 0.05, "min_edge": 0.03, "min_area": 20, "min_aspect": 1.0, "fraction": 0.01},
    "bubble": {"brightness": 0.85, "saturation": 0.18, "edge": 0.05, "min_edge": 0.03, "min_contrast": 0.05, "min_roundness": 0.55, "min_circularity": 0.25, "min_fill": 0.35, "max_fill": 0.98, "min_area": 20, "ring": 2, "fraction": 0.01},
    "dust": {"brightness": 0.30, "edge": 0.05, "min_edge": 0.10, "min_contrast": 0.08, "min_area": 2, "max_area": 200, "max_diameter": 40, "ring": 2, "fraction": 0.001},
    "pen": {"channel": 120 / 255, "blue": (1.4, 1.2), "green": (1.3, 1.3), "red": (1.3, 1.3), "black": 45 / 255, "black_edge": 35 / 255, "black_edge_fraction": 0.05, "min_area": 5, "fraction": 0.0},
    "low_stain": {"saturation": 0.08, "brightness": 0.88, "low_od": 0.15, "high_od": 2.2, "dark": 0.18, "min_area": 5, "fraction": 0.20},
    "over_stain": {"high_od": 2.2, "dark": 0.18, "min_area": 5, "fraction": 0.20},
}


class Tile:
    """A tile's channels and what follows from them."""

    def __init__(self, pdf: pd.DataFrame):
        row, col = pdf["row"].to_numpy() - int(pdf["row"].min()), pdf["col"].to_numpy() - int(pdf["col"].min())
        rgb = np.zeros((3, row.max() + 1, col.max() + 1))
        for k, c in enumerate("rgb"):
            rgb[k, row, col] = np.nan_to_num(pdf[c].to_numpy(dtype=float))
        self.r, self.g, self.b = rgb
        self.top = rgb.max(axis=0)
        self.saturation = np.divide(self.top - rgb.min(axis=0), self.top, out=np.zeros_like(self.top), where=self.top > 0)
        self.grey = 0.299 * self.r + 0.587 * self.g + 0.114 * self.b
        self.od = -np.log(np.maximum(rgb, EPSILON)).sum(axis=0)

    @property
    def edge(self) -> np.ndarray:
        """The greatest difference to one of the four neighbours."""
        out = np.zeros_like(self.grey)
        dx, dy = np.abs(np.diff(self.grey, axis=1)), np.abs(np.diff(self.grey, axis=0))
        for part, d in ((np.s_[:, 1:], dx), (np.s_[:, :-1], dx), (np.s_[1:, :], dy), (np.s_[:-1, :], dy)):
            out[part] = np.maximum(out[part], d)
        return out


def disk(cells: np.ndarray, radius: int) -> np.ndarray:
    """The cells grown by a disk; the array grows with them."""
    out = np.zeros((cells.shape[0] + 2 * radius, cells.shape[1] + 2 * radius), dtype=bool)
    for i in range(-radius, radius + 1):
        for j in range(-radius, radius + 1):
            if i * i + j * j <= radius * radius:
                out[radius + i : radius + i + cells.shape[0], radius + j : radius + j + cells.shape[1]] |= cells
    return out


def perimeter(cells: np.ndarray) -> int:
    """Sides of cells that face no other cell."""
    grid = np.pad(cells, 1).astype(np.int8)
    return int(np.abs(np.diff(grid, axis=0)).sum() + np.abs(np.diff(grid, axis=1)).sum())


def boundary(cells: np.ndarray) -> np.ndarray:
    """Cells with a neighbour (of four) outside."""
    grid = np.pad(cells, 1)
    return cells & ~(grid[:-2, 1:-1] & grid[2:, 1:-1] & grid[1:-1, :-2] & grid[1:-1, 2:])


def described(mask: np.ndarray, tile: Tile, least: int, ring: int, edge_at: float):
    """(the window of the tile, the cells in it, measures) of each component of at least `least` cells. Work is within the component's own box, with room for the ring."""
    numbers = components(mask)
    rows, cols = np.nonzero(numbers)
    own = numbers[rows, cols]
    n = int(own.max(initial=0)) + 1
    areas = np.bincount(own, minlength=n)
    box = [np.full(n, 1 << 30), np.full(n, -1), np.full(n, 1 << 30), np.full(n, -1)]
    for at, v, pick in ((0, rows, np.minimum), (1, rows, np.maximum), (2, cols, np.minimum), (3, cols, np.maximum)):
        pick.at(box[at], own, v)
    for k in np.flatnonzero(areas >= max(1, least)):
        if not k:
            continue
        r0, r1, c0, c1 = (int(b[k]) for b in box)
        area, h, w = int(areas[k]), r1 - r0 + 1, c1 - c0 + 1
        window = np.s_[max(0, r0 - ring) : r1 + 1 + ring, max(0, c0 - ring) : c1 + 1 + ring]
        cells, edge, top = numbers[window] == k, tile.edge[window], tile.top[window]
        m = {"area": area, "long": max(w, h), "aspect": max(w, h) / max(1, min(w, h)), "roundness": min(w, h) / max(w, h), "fill": area / (w * h), "inner_edge": float((edge[cells] >= edge_at).mean()), "level": float(top[cells].mean())}
        m["circularity"] = min(1.0, 4 * np.pi * area / max(perimeter(cells) ** 2, 1))
        if ring:
            around = disk(cells, ring)[ring:-ring, ring:-ring] & ~cells
            zone = boundary(cells) | around
            m["zone_edge"] = float((edge[zone] >= edge_at).mean()) if zone.any() else np.nan
            m["ring_level"] = float(top[around].mean()) if around.any() else np.nan
        yield window, cells, m


def found(tile: Tile, kind: str, limits: dict) -> tuple[np.ndarray, list[dict]]:
    """The pixels of the candidates and the measures of each."""
    p = LIMITS[kind] | limits
    ring, edge_at, fits = 0, p.get("edge", 0.0), lambda m: True
    if kind == "fold":
        raw = (tile.od >= p["high_od"]) & (tile.saturation >= p["saturation"]) & (tile.top <= p["brightness"])
        fits = lambda m: m["inner_edge"] >= p["min_edge"] and m["aspect"] >= p["min_aspect"]
    elif kind == "bubble":
        raw, ring = (tile.top >= p["brightness"]) & (tile.saturation <= p["saturation"]), p["ring"]
        fits = lambda m: m["zone_edge"] >= p["min_edge"] and m["level"] - m["ring_level"] >= p["min_contrast"] and m["roundness"] >= p["min_roundness"] and m["circularity"] >= p["min_circularity"] and p["min_fill"] <= m["fill"] <= p["max_fill"]
    elif kind == "dust":
        raw, ring = tile.top <= p["brightness"], p["ring"]
        fits = lambda m: m["area"] <= p["max_area"] and m["long"] <= p["max_diameter"] and m["zone_edge"] >= p["min_edge"] and m["ring_level"] - m["level"] >= p["min_contrast"]
    elif kind == "pen":
        colours = {"blue": (tile.b, tile.r, tile.g), "green": (tile.g, tile.r, tile.b), "red": (tile.r, tile.g, tile.b)}
        raw = np.zeros_like(tile.r, dtype=bool)
        for name, (own, one, two) in colours.items():
            raw |= (own >= p["channel"]) & (own >= p[name][0] * one) & (own >= p[name][1] * two)
        for window, cells, m in described(tile.grey <= p["black"], tile, p["min_area"], 0, p["black_edge"]):
            if m["inner_edge"] >= p["black_edge_fraction"]:
                raw[window] |= cells
    else:
        over = (tile.od > p["high_od"]) | (tile.top < p["dark"])
        raw = over if kind == "over_stain" else ~over & ((tile.saturation < p["saturation"]) | (tile.top > p["brightness"]) | (tile.od < p["low_od"]))
    kept = np.zeros_like(raw)
    rows = []
    for window, cells, m in described(raw, tile, max(1, p["min_area"]), ring, edge_at):
        if fits(m):
            kept[window] |= cells
            rows.append(m)
    return kept, rows


def detect(pixels: DataFrame, kind: str, **limits) -> DataFrame:
    """By tile the candidates' number, pixels and share, and whether the share reaches the kind's limit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, rows = found(Tile(pdf), kind, limits)
        share = float(mask.mean())
        return pd.DataFrame({"tile_id": [str(pdf["tile_id"].iloc[0])], "objects": [len(rows)], "n": [int(mask.sum())], "fraction": [share], "candidate": [share > 0 and share >= (LIMITS[kind] | limits)["fraction"]]})

    return pixels.groupBy("tile_id").applyInPandas(run, "tile_id string, objects long, n long, fraction double, candidate boolean")
