"""Readers and writers: regions as GeoJSON, point tables with alias resolution, tissue positions, image metadata, projects (A, B)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import GEOMETRY
from ..functions.scalars import colour, first_number, label_or

# fixed values: names under which tables hold ids and coordinates
ALIASES = {
    "id": ("id", "cell_id", "spot_id", "barcode", "label", "name"),
    "x": ("x", "centroid_x", "spot_x", "image_x", "pxl_col_in_fullres", "x_centroid"),
    "y": ("y", "centroid_y", "spot_y", "image_y", "pxl_row_in_fullres", "y_centroid"),
}
#: tissue positions without a header, in this order
POSITIONS = "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double"
# fixed values: properties that hold microns per pixel and the objective power, by priority
MPP_X = ["openslide.mpp-x", "mpp-x", "ome.physical-size-x", "PhysicalSizeX", "physical-size-x", "microns-per-pixel-x"]
MPP_Y = ["openslide.mpp-y", "mpp-y", "ome.physical-size-y", "PhysicalSizeY", "physical-size-y", "microns-per-pixel-y"]
POWER = ["openslide.objective-power", "aperio.AppMag", "objective-power"]
# fixed values: the frame of a feature collection
OPENING, CLOSING = '{"type":"FeatureCollection","features":[', "]}"
FEATURE = "array<struct<type:string,id:string,properties:string,geometry:string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Regions of feature collections, features or bare geometries, one document a file. Points and lines have an empty geometry.

    Every document is parsed where it lies; features of one document become rows at once.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.input_file_name().alias("file"))
    kind = F.get_json_object("doc", "$.type")
    one = F.struct(F.lit("Feature").alias("type"), F.get_json_object("doc", "$.id").alias("id"), F.get_json_object("doc", "$.properties").alias("properties"), F.when(kind == "Feature", F.get_json_object("doc", "$.geometry")).otherwise(F.col("doc")).alias("geometry"))
    features = F.when(kind == "FeatureCollection", F.from_json(F.get_json_object("doc", "$.features"), FEATURE)).otherwise(F.array(one))
    return parsed_features(docs.select("file", F.posexplode(features).alias("roi_index", "f")))


def parsed_features(rows: DataFrame) -> DataFrame:
    """roi_index, roi_id, name, class, object_type, is_locked, color, geometry_type, geometry, properties from features `f`."""
    p = lambda path: F.get_json_object("f.properties", path)
    kind = F.get_json_object("f.geometry", "$.type")
    inner = F.get_json_object("f.geometry", "$.coordinates")
    geometry = F.when(kind == "Polygon", F.array(F.from_json(inner, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(inner, GEOMETRY)).otherwise(F.array().cast(GEOMETRY))
    raw = p("$.classification.color")
    packed = F.when(raw.startswith("["), F.concat(F.lit("#"), F.concat_ws("", F.transform(F.from_json(raw, "array<int>"), lambda v: F.lpad(F.hex(v), 2, "0"))))).otherwise(colour(F.coalesce(raw, p("$.classification.colorRGB"))))
    return rows.select(
        "file", F.col("roi_index"), F.coalesce("f.id", F.concat(F.lit("roi_"), F.col("roi_index") + 1)).alias("roi_id"), F.coalesce(p("$.name"), p("$.label")).alias("name"), F.coalesce(p("$.classification.name"), p("$.class")).alias("class"),
        p("$.objectType").alias("object_type"), F.coalesce(p("$.isLocked").try_cast("boolean"), F.lit(False)).alias("is_locked"), packed.alias("color"), kind.alias("geometry_type"), geometry.alias("geometry"), F.col("f.properties").alias("properties"),
    )


def geometry_json() -> Column:
    """The geometry of a region as GeoJSON text: one polygon or several; points and lines that lost theirs have none."""
    one = F.size("geometry") == 1
    shape = F.concat(F.lit('{"type":"'), F.when(one, F.lit("Polygon")).otherwise(F.lit("MultiPolygon")), F.lit('","coordinates":'), F.when(one, F.to_json(F.get("geometry", F.lit(0)))).otherwise(F.to_json("geometry")), F.lit("}"))
    return F.when(F.size("geometry") > 0, shape).otherwise(F.lit("null"))


def _feature(roi_id, properties, name, kind, color, locked, object_type, geometry) -> str:
    """One feature: the properties that were read, with what the columns say now."""
    held = json.loads(properties) if properties else None
    held = held if isinstance(held, dict) else {}
    classification = held["classification"] if isinstance(held.get("classification"), dict) else {}
    now = {"name": kind, "color": [int(color[i : i + 2], 16) for i in (1, 3, 5)] if color else None}
    for key in ("colorRGB", "color") if color else ():
        classification.pop(key, None)
    classification.update({k: v for k, v in now.items() if v is not None})
    if kind is not None and "class" in held:
        held["class"] = kind
    given = {"name": name, "objectType": object_type, "isLocked": True if locked else held.get("isLocked"), "classification": classification or None}
    held.update({k: v for k, v in given.items() if v is not None})
    return f'{{"type":"Feature","id":{json.dumps(roi_id)},"properties":{json.dumps(held)},"geometry":{geometry}}}'


def write_geojson(rois: DataFrame, path: str, mode: str = "error") -> None:
    """B1: feature collections under path, one for each partition of the regions, each a whole document with a feature a line, by roi_index.

    Members of the column properties (JSON text, as read_geojson gives it) are kept; name, class, color (#RRGGBB),
    object_type and is_locked, where such columns are there and not null, are written over them. A feature is a row from
    first to last, so that no document is held whole. Presets and export rules come before: review.apply_presets and
    review.exported.
    """
    given = lambda c, kind="string": F.col(c).cast(kind).alias(c) if c in rois.columns else F.lit(None).cast(kind).alias(c)
    columns = [given(c) for c in ("roi_id", "properties", "name", "class", "color")] + [given("is_locked", "boolean"), given("object_type")]
    rows = rois.sortWithinPartitions("roi_index").select(*columns, geometry_json().alias("geometry"))

    def lines(batches):
        import pandas as pd

        begun = False
        for pdf in batches:
            if len(pdf):
                made = [_feature(*r) for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)]
                yield pd.DataFrame({"value": [("," if begun or k else OPENING) + f for k, f in enumerate(made)]})
                begun = True
        if begun:
            yield pd.DataFrame({"value": [CLOSING]})

    rows.mapInPandas(lines, "value string").write.mode(mode).text(path)


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Regions of files with a feature a line, as write_geojson makes them or as text sequences (RS before a feature or not).

    Files of any size are split among tasks. Lines that are neither features nor the frame of a collection are an error;
    blank ones are not. roi_index tells regions apart and rises within a file, with gaps.
    """
    frame = F.lit(OPENING)
    text = F.regexp_replace(F.replace(F.trim("value"), frame, F.lit("")), r"^[\x1e,\s]+|,\s*$", "")
    rows = spark.read.text(path).select(text.alias("line"), F.input_file_name().alias("file")).filter(~F.col("line").isin("", CLOSING))
    feature = F.from_json("line", "struct<type:string,id:string,properties:string,geometry:string>")
    bad = F.raise_error(F.concat(F.lit("not a feature: "), F.substring("line", 1, 80))).cast("boolean")
    held = rows.select("file", "line", feature.alias("f")).filter(F.when(F.col("f.type") == "Feature", F.lit(True)).otherwise(bad))
    return parsed_features(held.select("file", F.monotonically_increasing_id().alias("roi_index"), "f"))


def resolved(df: DataFrame, **names: str) -> DataFrame:
    """Id, x, y by their aliases without regard to case, and the other columns; rows without finite coordinates go."""
    lower = {c.lower(): c for c in df.columns}
    found = {}
    for want, options in ALIASES.items():
        hit = names.get(want) or next((lower[o] for o in options if o in lower), None)
        if hit is None and want != "id":
            raise ValueError(f"no column for {want} among {df.columns}")
        found[want] = hit
    x, y = (F.col(found[c]).try_cast("double") for c in ("x", "y"))
    id_ = F.col(found["id"]).cast("string") if found["id"] else F.concat(F.lit("point_"), F.monotonically_increasing_id())
    rest = [c for c in df.columns if c not in found.values() and c.lower() not in ("id", "x", "y")]
    out = df.select(id_.alias("id"), x.alias("x"), y.alias("y"), *rest)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out.filter(finite("x") & finite("y"))


def read_points(spark: SparkSession, path: str, sep: str = ",", **names: str) -> DataFrame:
    return resolved(spark.read.csv(path, header=True, sep=sep), **names)


def read_tissue_positions(spark: SparkSession, path: str) -> DataFrame:
    """Barcode, in_tissue, grid place and full-resolution pixels, from files with or without a header."""
    rows = spark.read.schema(POSITIONS).csv(path).filter(F.col("pxl_row_in_fullres").isNotNull() & F.col("pxl_col_in_fullres").isNotNull())
    return rows.withColumn("id", F.col("barcode")).withColumn("x", F.col("pxl_col_in_fullres")).withColumn("y", F.col("pxl_row_in_fullres"))


def pixel_size(slides: DataFrame) -> DataFrame:
    """Microns per pixel by priority of properties, else by the TIFF resolution (up to 50 µm), each axis standing in for the other; and the objective power."""
    unit = F.lower(F.element_at("properties", "tiff.ResolutionUnit"))
    per = F.when(unit.isin("centimeter", "cm", "3"), 10_000.0).when(unit.isin("inch", "2"), 25_400.0)
    tiff = lambda k: (lambda v: F.when(v <= 50, v))(F.try_divide(per, first_number(F.col("properties"), [k])))
    x = F.coalesce(first_number(F.col("properties"), MPP_X), tiff("tiff.XResolution"))
    y = F.coalesce(first_number(F.col("properties"), MPP_Y), tiff("tiff.YResolution"))
    return slides.select("slide_id", F.coalesce(x, y).alias("mpp_x"), F.coalesce(y, x).alias("mpp_y"), first_number(F.col("properties"), POWER).alias("objective_power"))


def omezarr_levels(text: DataFrame) -> DataFrame:
    """Path, level, dataset and scales from the metadata documents (`path`, `value`) of multiscale images; the downsample is that of x against the first level."""
    kind = "array<struct<axes:array<struct<name:string,type:string>>,datasets:array<struct<path:string,coordinateTransformations:array<struct<type:string,scale:array<double>>>>>>>"
    v2, v3 = F.get_json_object("value", "$.multiscales"), F.get_json_object("value", "$.attributes.ome.multiscales")
    images = text.select("path", F.get(F.from_json(F.coalesce(v3, v2), kind), 0).alias("m"))
    rows = images.select("path", "m.axes", F.posexplode("m.datasets").alias("level", "d"))
    scale = F.get(F.filter("d.coordinateTransformations", lambda t: t["type"] == "scale"), 0)["scale"]
    rows = rows.withColumn("scale", scale).withColumn("axes", F.transform("axes", lambda a: a["name"]))
    sx = F.element_at("scale", F.array_position("axes", F.lit("x")).cast("int"))
    first = F.first("sx").over(Window.partitionBy("path").orderBy("level"))
    return rows.withColumn("sx", sx).withColumn("downsample", F.col("sx") / first).select("path", "level", F.col("d.path").alias("dataset"), "axes", "scale", "downsample")


def read_pixels(spark: SparkSession, path: str, glob: str = "*.ppm") -> DataFrame:
    """pixels(tile_id, row, col, r, g, b) of binary PPM images, values from 0 to 1. One image is one task's work at a time."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                parts = data.split(None, 4)
                w, h, top = int(parts[1]), int(parts[2]), int(parts[3])
                v = np.frombuffer(data, dtype=np.uint8, count=3 * w * h, offset=len(data) - 3 * w * h).reshape(h * w, 3) / top
                yield pd.DataFrame({"tile_id": name.rpartition("/")[2].rpartition(".")[0], "row": np.repeat(np.arange(h), w), "col": np.tile(np.arange(w), h), "r": v[:, 0], "g": v[:, 1], "b": v[:, 2]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, "tile_id string, row int, col int, r double, g double, b double")


def save_project(tables: dict[str, DataFrame], path: str, metadata: dict | None = None) -> None:
    """Each table as Parquet, the manifest last."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = json.dumps({"version": 1, "tables": sorted(tables), "metadata": metadata or {}})
    spark.range(1).select(F.lit(manifest).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def experiment_project(experiment: DataFrame, path: str) -> None:
    """A project out of an experiment (experiment.read_experiment): its images and feature sets as tables, its id as metadata."""
    images = experiment.select("tissue_id", "sha256", "width", "height", "mpp_x", "mpp_y", "frame_id", "coordinate_convention").distinct()
    sets = experiment.select("tissue_id", "feature_set_id", "feature_path", "feature_sha256", "unit").distinct()
    ids = [r[0] for r in experiment.select("experiment_id").distinct().limit(2).collect()]
    if len(ids) != 1:
        raise ValueError("one experiment makes a project")
    save_project({"images": images, "feature_sets": sets}, path, {"experiment_id": ids[0]})


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A27."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def registered_viewport(points: DataFrame, box: tuple[float, float, float, float], limit: int) -> tuple[DataFrame, int]:
    """The points of a half-open window, at most `limit` by row, and how many there are."""
    x0, y0, x1, y1 = box
    inside = points.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return inside.orderBy("row").limit(limit), inside.count()


def with_class(rois: DataFrame, other: str = "unclassified") -> DataFrame:
    return rois.withColumn("class", label_or(F.col("class"), other))


def read_masks(spark: SparkSession, path: str, glob: str = "*.pgm") -> DataFrame:
    """mask(mask_id, row, col, label) of binary PGM images, pixels of 0 left out; masks.mask_to_rois makes regions of them. One image is one task's work at a time."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                parts = data.split(None, 4)
                w, h, top = int(parts[1]), int(parts[2]), int(parts[3])
                kind = ">u2" if top > 255 else np.uint8
                v = np.frombuffer(data[len(data) - w * h * np.dtype(kind).itemsize :], dtype=kind).reshape(h, w)
                r, c = np.nonzero(v)
                yield pd.DataFrame({"mask_id": name.rpartition("/")[2].rpartition(".")[0], "row": r, "col": c, "label": v[r, c].astype(int)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, "mask_id string, row int, col int, label int")


def read_phenotype_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """`outputs` (name, path) of a project's 00_execution/project_outputs.tsv, and `cells` of its cell tables, where local coordinates are shifted: x is x_orig, else x + dx."""
    outputs = spark.read.csv(f"{path}/00_execution/project_outputs.tsv", header=True, sep="\t")
    lower = {c.lower(): c for c in outputs.columns}
    name = next(lower[c] for c in ("name", "output", "type", "key") if c in lower)
    held = outputs.select(F.col(name).alias("name"), F.col(lower["path"]).alias("path"))
    files = [r["path"] for r in held.filter(F.lower("name").isin("cells", "cell_table")).collect()]
    out = {"outputs": held}
    if files:
        rows = spark.read.csv([f if "/" in f[:1] or "://" in f else f"{path}/{f}" for f in files], header=True)
        number = lambda c: F.col(c).try_cast("double") if c in rows.columns else F.lit(None).cast("double")
        moved = {v: F.coalesce(number(f"{v}_orig"), number(v) + F.coalesce(number(f"d{v}"), F.lit(0.0))) for v in "xy"}
        out["cells"] = rows.withColumns(moved)
    return out


def write_associations(associated: DataFrame, path: str, mode: str = "error") -> None:
    """B2: points with their regions as CSV."""
    associated.write.mode(mode).csv(path, header=True)
