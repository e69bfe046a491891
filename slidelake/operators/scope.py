"""Which regions, points and cells an analysis is about: selectors, project scopes, training footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import label_or
from . import regions

# fixed values: names that select nothing by themselves, and the columns of points that hold a scope's fields
RESERVED = ("__all__", "__all_unlabelled__", "__all_non_training__")
FIELDS = {
    "project_key": ("project_key", "wsi_project_key"),
    "project_image": ("project_image", "image", "image_id", "sample_id", "sample", "slide_id", "tissue"),
    "project_section": ("project_section", "section", "section_id", "scene", "sample_id", "sample"),
    "image_id": ("image_id", "sample_id", "sample", "slide_id", "project_image"),
    "section_id": ("section_id", "section", "scene", "project_section"),
    "sample_id": ("sample_id", "sample", "slide_id"),
}


def selected(rois: DataFrame, ids: list[str], include_all: bool = False) -> DataFrame:
    """Regions named by `roi:<id or name>`, `roi_index:<number from 0>`, `class:<class, any case>` or a bare id, name or class."""
    if include_all:
        return rois
    wanted = [i for i in ids if i and i not in RESERVED]
    tail = lambda p: [i.removeprefix(p) for i in wanted if i.startswith(p)]
    bare = [i for i in wanted if not i.startswith(("roi:", "roi_index:", "class:"))]
    numbers = [int(i) for i in tail("roi_index:") if i.isdecimal()]
    classes = [(c.strip() or "unclassified").lower() for c in tail("class:")]
    hit = F.col("roi_index").isin(numbers) | F.col("roi_id").isin(tail("roi:") + bare) | F.col("name").isin(tail("roi:") + bare) | F.col("class").isin(bare) | F.lower(label_or(F.col("class"), "unclassified")).isin(classes)
    return rois.filter(F.coalesce(hit, F.lit(False)))


def scope_keep(scope: Column, columns: list[str]) -> Column:
    """Whether a point with these columns is in a region's scope (a map by field): each field that has a value and a column must agree with one of its columns, in any case; none keeps all."""
    out = F.lit(True)
    for field, names in FIELDS.items():
        own = [F.coalesce(F.lower(F.col(c).cast("string")) == F.lower(scope[field]), F.lit(False)) for c in names if c in columns]
        if own:
            met = own[0]
            for o in own[1:]:
                met = met | o
            out = out & (F.coalesce(scope[field], F.lit("")).isin("") | met)
    return out


def assign_points(points: DataFrame, rois: DataFrame, ids: list[str], include_all: bool = False) -> DataFrame:
    """Points with label, roi_id, roi_index of the first selected region that holds them within its scope (rois.scope, a map by field, may be null)."""
    # as entries, since maps have no order and the lists of regions are sorted
    entries = F.coalesce(F.map_entries("scope"), F.array().cast("array<struct<key:string,value:string>>"))
    held = selected(rois, ids, include_all).withColumn("scope", entries)
    x, y = F.col("x"), F.col("y")
    hits = F.filter("near", lambda r: G.contains(r["geometry"], x, y) & scope_keep(F.map_from_entries(r["scope"]), points.columns))
    met = regions.candidates(points, held).withColumn("hit", F.get(hits, 0))
    return met.select(*points.columns, F.when(F.col("hit").isNotNull(), label_or(F.col("hit.class"), "unclassified")).alias("label"), F.col("hit.roi_id").alias("roi_id"), F.col("hit.roi_index").alias("roi_index"))


def in_project(points: DataFrame, scope: dict) -> DataFrame:
    """Points of a project's image (by key, else image index, else image) and section (by index from 0, else name); what is not given or has no column is not asked."""

    def first(*options: tuple[str, str]) -> Column | None:
        for field, kind in options:
            v = scope.get(field)
            if field in points.columns and v is not None and str(v) != "" and not (kind == "int" and int(v) < 0):
                return F.col(field).try_cast("int") == int(v) if kind == "int" else F.col(field).cast("string") == str(v)
        return None

    wants = [first(("project_key", "text"), ("project_image_index", "int"), ("project_image", "text")), first(("project_section_index", "int"), ("project_section", "text"))]
    out = points
    for w in wants:
        out = out if w is None else out.filter(w)
    return out


def roi_training(footprints: DataFrame, rois: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """Of footprints(id, x, y, width, height; x and y the centre) each that a selected region's label meets: label, accepted (the whole footprint lies in one region). Centres under two labels are an error."""
    held = selected(rois, ids).withColumn("label", label_or(F.col("class"), "unclassified"))
    x, y = F.col("x"), F.col("y")
    near = regions.candidates(footprints, held).withColumn("r", F.explode(F.filter("near", lambda r: G.contains(r["geometry"], x, y))))
    corner = near.withColumn("cx", x).withColumn("cy", y).withColumn("x", x - F.col("width") / 2).withColumn("y", y - F.col("height") / 2)
    whole = regions.footprints_in_roi(corner, F.col("r.geometry"))
    by = whole.groupBy(key).agg(F.min("r.label").alias("label"), F.max("r.label").alias("other"), F.max(F.col("inside").cast("int")).alias("inside"))
    clash = F.raise_error(F.lit("training regions of two labels overlap")).cast("boolean")
    return by.filter(F.when(F.col("label") != F.col("other"), clash).otherwise(F.lit(True))).select(key, "label", (F.col("inside") == 1).alias("accepted"))


def segmentation_review(cells: DataFrame, review: DataFrame) -> DataFrame:
    """cells(cell_id, source_id) with their review rows(cell_id, status, disagreement, action, iou, coverage), which name a cell by either id.

    Statuses are available or unavailable; cells without a row are unavailable. Shares beyond 0 to 1, an unknown
    status or action, and two rows of one cell are errors.
    """
    check = lambda ok, what: F.when(F.coalesce(ok, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean"))
    held = review.withColumn("status", F.coalesce("status", F.lit("available")))
    held = held.filter(check(F.col("status").isin("available", "unavailable"), "unknown review status") & check(F.col("action").isin("retain_original", "adjust_boundary"), "unknown review action"))
    held = held.filter(check(F.col("iou").between(0, 1) & F.col("coverage").between(0, 1), "a share of a review lies beyond 0 to 1"))
    names = cells.select(F.col("cell_id").alias("to"), F.explode(F.array_distinct(F.array("cell_id", "source_id"))).alias("named"))
    met = held.join(names, held["cell_id"] == names["named"]).drop("named", "cell_id")
    one = met.groupBy("to").agg(F.count("*").alias("n"), F.first(F.struct("status", "disagreement", "action", "iou", "coverage")).alias("r"))
    one = one.filter(check(F.col("n") == 1, "two review rows of one cell"))
    required = F.col("r.disagreement") | (F.col("r.action") == "adjust_boundary")
    out = cells.join(one, cells["cell_id"] == one["to"], "left")
    return out.select(*cells.columns, F.coalesce("r.status", F.lit("unavailable")).alias("status"), F.col("r.disagreement").alias("disagreement"), required.alias("review_required"), F.col("r.iou").alias("iou"), F.col("r.coverage").alias("coverage"))


def checked_registration(pairs: DataFrame) -> DataFrame:
    """pairs(source, target, registration) of image identities: equal frames without a registration, or an exact identity affine between equal images, pass; others are an error."""
    same = F.lit(True)
    for c in ("sha256", "width", "height", "mpp_x", "mpp_y", "coordinate_convention"):
        same = same & (F.col(f"source.{c}") == F.col(f"target.{c}"))
    unit = F.lit([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])
    named = (F.col("registration.source_frame_id") == F.col("source.frame_id")) & (F.col("registration.target_frame_id") == F.col("target.frame_id"))
    fine = same & F.when(F.col("registration").isNull(), F.col("source.frame_id") == F.col("target.frame_id")).otherwise(named & (F.col("registration.affine") == unit))
    bad = F.raise_error(F.lit("cells and image need one frame or a verified identity registration")).cast("boolean")
    return pairs.filter(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(bad))
