"""Presets, review contexts, checkpoints, ledgers and matching by id (A26-A28, C1-C9, C16, E2, J, N35-N37, N78, N82-N84)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import label_or
from . import ranges

# fixed values: the preset classes, their colours and whether they are exported
PRESETS = (
    ("tumour", "#D73027", True), ("stroma", "#4575B4", True), ("necrosis", "#7F7F7F", True), ("normal", "#1A9850", True),
    ("artefact", "#984EA3", False), ("exclusion", "#000000", False), ("invasive front", "#F46D43", True),
)


def default_presets(spark: SparkSession) -> DataFrame:
    """C3."""
    rows = ", ".join(f"('{c}', '{c}', '{colour}', {str(e).lower()})" for c, colour, e in PRESETS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(class, label, color, export)")


def _key(c: str = "class") -> Column:
    return F.lower(F.trim(F.col(c)))


def presets(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """Own presets laid over the defaults value by value, class names without regard to case. A label defaults to the class, export to true."""
    a = defaults.select(_key().alias("k"), *[F.col(c).alias(f"d_{c}") for c in ("class", "label", "color", "export")])
    b = own.select(_key().alias("k"), *[F.col(c).alias(f"o_{c}") for c in ("class", "label", "color", "export")])
    met = a.join(b, "k", "full_outer")
    name = F.coalesce(F.trim("o_class"), "d_class")
    return met.select(name.alias("class"), F.coalesce("o_label", "d_label", name).alias("label"), F.coalesce("o_color", "d_color", F.lit("#00BFC4")).alias("color"), F.coalesce("o_export", "d_export", F.lit(True)).alias("export"))


def set_class(rois: DataFrame, label: str, ids: list[str] | None = None) -> DataFrame:
    """The class of all or of the named regions; a name without a region is an error."""
    if ids is None:
        return rois.withColumn("class", F.lit(label))
    missing = set(ids) - {r[0] for r in rois.filter(F.col("roi_id").isin(ids)).select("roi_id").distinct().collect()}
    if missing:
        raise ValueError(f"no region {sorted(missing)[0]}")
    return rois.withColumn("class", F.when(F.col("roi_id").isin(ids), F.lit(label)).otherwise(F.col("class")))


def apply_presets(rois: DataFrame, table: DataFrame, update: bool = True) -> DataFrame:
    """Each region's colour from its class's preset; without `update` only where it has none."""
    held = table.select(_key().alias("__k"), F.col("color").alias("__color"))
    met = rois.withColumn("__k", _key()).join(F.broadcast(held) if held.limit(10_001).count() <= 10_000 else held, "__k", "left")
    colour = F.coalesce("__color", "color") if update else F.coalesce("color", "__color")
    return met.withColumn("color", colour).drop("__k", "__color")


def exported(rois: DataFrame, table: DataFrame) -> DataFrame:
    """Regions whose class is exported; classes without a preset are."""
    held = table.filter(~F.col("export")).select(_key().alias("__k")).distinct()
    return rois.withColumn("__k", _key()).join(held, "__k", "left_anti").drop("__k")


def select(observations: DataFrame, ids: DataFrame | None = None, cluster_field: str | None = None, cluster_values: list[str] | None = None, tissue_ids: list[str] | None = None, unit: str | None = None) -> DataFrame:
    """Observations by explicit ids or by cluster values (not both), and by tissue and unit. Neither selects none."""
    if ids is not None and cluster_field is not None:
        raise ValueError("either ids or a cluster field")
    if ids is not None:
        out = observations.join(ids.select("id").distinct(), "id", "left_semi")
    elif cluster_field is not None:
        out = observations.filter(F.element_at("cluster_values", cluster_field).isin(cluster_values or []))
    else:
        out = observations.filter(F.lit(False))
    out = out.filter(F.col("tissue_id").isin(tissue_ids)) if tissue_ids is not None else out
    return out.filter(F.col("observation_unit") == unit) if unit is not None else out


def row_signature(df: DataFrame) -> Column:
    """The hash of a row's columns in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def signature(df: DataFrame, parts: int = 256) -> DataFrame:
    """One hash of all rows, the same for any order; row hashes meet in parts by their first byte, and parts in one hash."""
    rows = df.select(row_signature(df).alias("h"))
    n = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(parts))
    word = lambda k: F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    each = rows.groupBy(n.alias("part")).agg(F.count("*").alias("n"), *[word(k).alias(f"w{k}") for k in range(5)])
    line = F.concat_ws(":", *[F.col(c).cast("string") for c in ("part", "n", "w0", "w1", "w2", "w3", "w4")])
    return each.agg(F.sum("n").alias("rows"), F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(line))), 256).alias("signature"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join by a key that must be unique on both sides."""
    for side, df in (("left", left), ("right", right)):
        if not duplicates(df, key).isEmpty():
            raise ValueError(f"repeated {key} on the {side}")
    return left.join(right, key)


def commit_checkpoints(ledger: DataFrame) -> DataFrame:
    """Of checkpoints(context_id, revision, digest, state) the state in force: the highest revision. Equal revisions with different digests are an error."""
    by = ledger.groupBy("context_id").agg(F.max(F.struct("revision", "digest", "state")).alias("top"), F.max("revision").alias("m"))
    at = ledger.groupBy("context_id", "revision").agg(F.count_distinct("digest").alias("kinds"))
    met = by.join(at, (by["context_id"] == at["context_id"]) & (by["m"] == at["revision"])).select(by["context_id"], "top", "kinds")
    clash = F.raise_error(F.lit("one revision with two states")).cast("boolean")
    return met.filter(F.when(F.col("kinds") > 1, clash).otherwise(F.lit(True))).select("context_id", F.col("top.revision").alias("revision"), F.col("top.digest").alias("digest"), F.col("top.state").alias("state"))


def confirmed(ledger: DataFrame) -> DataFrame:
    """Ids that a person labelled, with the latest label. Of entries of one time the greatest status, then label, counts; null is the least."""
    latest = ledger.groupBy("id").agg(F.max(F.struct("updated_at", "status", "label")).alias("last"))
    return latest.filter("last.status = 'confirmed'").select("id", F.col("last.label").alias("label"))


def tissue_context(cells: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Each cell's region of greatest overlap (the first region id on ties); fractions beyond 0 to 1 are an error."""
    bad = F.raise_error(F.lit("an overlap is no fraction")).cast("boolean")
    fine = overlaps.filter(F.when((F.col("fraction") < 0) | (F.col("fraction") > 1), bad).otherwise(F.lit(True)))
    best = fine.groupBy("cell_id").agg(F.min(F.struct((-F.col("fraction")).alias("f"), F.col("region_id").alias("region_id"))).alias("best"), F.count("*").alias("n_regions"))
    return cells.join(best, "cell_id", "left").withColumn("region_id", F.col("best.region_id")).withColumn("fraction", -F.col("best.f")).drop("best")


def tile_report(tiles: DataFrame, variables: list[str]) -> DataFrame:
    """Tiles by value of each variable, null as NA."""
    long = tiles.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.coalesce(F.col(v).cast("string"), F.lit("NA")).alias("value")) for v in variables])).alias("r"))
    return long.groupBy("r.variable", "r.value").agg(F.count("*").alias("n"))


def cluster_fields(df: DataFrame, key: str) -> DataFrame:
    """Columns that look like categories: text or whole numbers with 2 to max(50, min(200, n / 2)) different values, one a name without regard to case."""
    names = [f.name for f in df.schema if f.name != key and f.dataType.simpleString() in ("string", "int", "bigint", "boolean")]
    if not names:
        return df.sparkSession.sql("SELECT '' AS field, 0L AS kinds WHERE false")
    counts = df.agg(F.count("*").alias("__n"), *[F.count_distinct(c).alias(c) for c in names])
    long = counts.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("kinds")) for c in names])).alias("r")).select("__n", "r.*")
    fine = long.filter((F.col("kinds") >= 2) & (F.col("kinds") <= F.greatest(F.lit(50), F.least(F.lit(200), F.floor(F.col("__n") / 2)))))
    return fine.withColumn("rn", F.row_number().over(Window.partitionBy(F.lower("field")).orderBy("field"))).filter("rn = 1").select("field", "kinds")


def gene_match(asked: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each asked name's feature: as it is, then without regard to case, then with _ - . alike, then by alias."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[_.-]", "")
    forms = known.select("feature", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("feature").alias("form")), F.struct(F.lit(1).alias("rank"), F.lower("feature").alias("form")), F.struct(F.lit(2).alias("rank"), plain(F.col("feature")).alias("form")))).alias("f"))
    named = aliases.select("feature", F.struct(F.lit(3).alias("rank"), F.lower("alias").alias("form")).alias("f")).join(known.select("feature"), "feature", "left_semi")
    forms = forms.unionByName(named).select("feature", "f.*")
    wants = asked.select("name", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("name").alias("form")), F.struct(F.lit(1).alias("rank"), F.lower("name").alias("form")), F.struct(F.lit(2).alias("rank"), plain(F.col("name")).alias("form")), F.struct(F.lit(3).alias("rank"), F.lower("name").alias("form")))).alias("w")).select("name", "w.*")
    best = wants.join(forms, ["rank", "form"]).groupBy("name").agg(F.min(F.struct("rank", "feature")).alias("best"))
    return asked.select("name").distinct().join(best, "name", "left").select("name", F.col("best.feature").alias("feature"), F.col("best.rank").alias("rank"))


def cache_prune(files: DataFrame, max_bytes: int, max_age_days: float, now: float) -> DataFrame:
    """files(path, bytes, mtime) that a cache drops: those too old, then the least recent until 90 % of the cap is left, if the cap is passed."""
    old = (F.lit(now) - F.col("mtime")) > max_age_days * 86400
    young = files.filter(~old)
    summed = ranges.running(young, [F.col("mtime").desc(), F.col("path")], F.col("bytes"))
    full = summed.filter((F.col("total") > max_bytes) & (F.col("upto") > 0.9 * max_bytes)).select("path", F.lit("size").alias("reason"))
    return files.filter(old).select("path", F.lit("age").alias("reason")).unionByName(full)


def thinned(df: DataFrame, order: str, most: int) -> DataFrame:
    """At most `most` rows at even steps of the order, for display."""
    n = df.count()
    if n <= most:
        return df
    step = -(-n // most)
    placed = ranges.running(df, [F.col(order)], F.lit(1))
    return placed.filter((F.col("upto") - 1) % step == 0).select(*df.columns)


def class_summary(rois: DataFrame) -> DataFrame:
    return rois.groupBy(label_or(F.col("class"), "unclassified").alias("class")).agg(F.count("*").alias("n"))


CHECKPOINT = "context_id string, source_signature string, revision long, selected_ids array<string>, records array<struct<id:string,status:string,label:string,reviewer:string,updated_at:string,action:string>>"


def checkpoint(context_id: str, context_signature: DataFrame, selected: DataFrame, records: DataFrame, revision: int = 0) -> DataFrame:
    """One row: a context's id and signature, the selected ids and a person's records. The selection is what a person picks, bounded by hand."""
    ids = selected.select("id").distinct().agg(F.sort_array(F.collect_list("id")).alias("selected_ids"))
    held = records.agg(F.sort_array(F.collect_list(F.struct("id", "status", "label", "reviewer", "updated_at", "action"))).alias("records"))
    sig = context_signature.select(F.col("signature").alias("source_signature"))
    if revision < 0:
        raise ValueError("a revision is 0 or more")
    return sig.crossJoin(ids).crossJoin(held).select(F.lit(context_id).alias("context_id"), "source_signature", F.lit(revision).cast("long").alias("revision"), "selected_ids", "records")  # one row each


def validated_checkpoint(point: DataFrame, context_id: str, context_signature: DataFrame, observations: DataFrame) -> DataFrame:
    """The checkpoint, if it belongs to the context as it is now and names none but its observations; else an error."""
    sig = context_signature.select(F.col("signature").alias("now"))
    named = point.select(F.explode(F.concat("selected_ids", F.transform("records", lambda r: r["id"]))).alias("id")).distinct().join(observations.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("strange"))
    bad = lambda what: F.raise_error(F.lit(what)).cast("boolean")
    met = point.crossJoin(sig).crossJoin(named)  # one row each
    ok = F.when((F.col("context_id") != context_id) | (F.col("source_signature") != F.col("now")), bad("the checkpoint belongs to another or a changed context")).when(F.col("strange") > 0, bad("the checkpoint names what is no observation")).otherwise(F.lit(True))
    return met.filter(ok).select(*point.columns)


def write_checkpoint(point: DataFrame, path: str, mode: str = "error") -> None:
    """As JSON; Spark's commit makes the file appear whole or not at all."""
    point.coalesce(1).write.mode(mode).json(path)


def read_checkpoint(spark: SparkSession, path: str, context_id: str, context_signature: DataFrame, observations: DataFrame) -> DataFrame:
    """A checkpoint that was written, validated against its context."""
    return validated_checkpoint(spark.read.schema(CHECKPOINT).json(path), context_id, context_signature, observations)


def attach_spatial(observations: DataFrame, coordinates: DataFrame, metadata: DataFrame | None, matrix: list[list[float]], tissue_id: str, dataset_id: str = "spatial", confirmed: bool = False) -> DataFrame:
    """The observations with those of coordinates(id, x, y) added, moved into the image by a confirmed affine; metadata(id, ...) becomes cluster_values by unique id."""
    if not confirmed:
        raise ValueError("a coordinate mapping must be confirmed")
    x = F.col("x") * matrix[0][0] + F.col("y") * matrix[0][1] + matrix[0][2]
    y = F.col("x") * matrix[1][0] + F.col("y") * matrix[1][1] + matrix[1][2]
    new = coordinates.select("id", x.alias("x"), y.alias("y"))
    values = F.create_map().cast("map<string,string>")
    if metadata is not None:
        fields = [c for c in metadata.columns if c != "id"]
        new = matched(new, metadata, "id")
        values = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in fields]))
    elif not duplicates(new, "id").isEmpty():
        raise ValueError("repeated id")
    made = new.select(F.concat_ws("::", F.lit(tissue_id), F.lit(dataset_id), "id").alias("id"), F.col("id").cast("string").alias("original_id"), F.lit(dataset_id).alias("dataset_id"), F.lit(tissue_id).alias("tissue_id"), F.lit("spot").alias("observation_unit"), "x", "y", values.alias("cluster_values"))
    return observations.unionByName(made, allowMissingColumns=True)


def inventory(df: DataFrame) -> DataFrame:
    """Field, type of the columns of a spatial table."""
    rows = ", ".join(f"('{f.name}', '{f.dataType.simpleString()}')" for f in df.schema)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(field, type)")


def spatial_clusters(spots: DataFrame, table: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """C17: the spots' ids with the cluster fields of a table by id; spots that it lacks have nulls, fields that it lacks are an error."""
    fields = fields or [c for c in table.columns if c != "id"]
    if missing := [f for f in fields if f not in table.columns]:
        raise ValueError(f"no field {missing[0]}")
    first = table.dropDuplicates(["id"]).select("id", *fields)
    return spots.select("id").join(first, "id", "left")


def tile_review(tiles: DataFrame, review: DataFrame, signature_now: str, tolerance: float = 0.51) -> DataFrame:
    """Review rows(plan_id, signature, cx, cy, decision) that hold for the tiles of a plan: of its present signature, one a tile, with centres within half a pixel; others are an error."""
    bad = lambda what: F.raise_error(F.lit(what)).cast("boolean")
    met = review.join(tiles.select("plan_id", (F.col("x") + F.col("width") / 2).alias("tx"), (F.col("y") + F.col("height") / 2).alias("ty")), "plan_id", "left")
    met = met.withColumn("n", F.count("*").over(Window.partitionBy("plan_id")))
    far = (F.abs(F.col("cx") - F.col("tx")) > tolerance) | (F.abs(F.col("cy") - F.col("ty")) > tolerance)
    ok = F.when(F.col("signature") != signature_now, bad("the review is of another plan")).when(F.col("tx").isNull(), bad("no such tile")).when(F.col("n") > 1, bad("a tile is reviewed twice")).when(far, bad("a centre lies elsewhere")).otherwise(F.lit(True))
    return met.filter(ok).select("plan_id", "decision")


def case_report(tables: dict[str, DataFrame], tile_variables: list[str]) -> dict[str, DataFrame]:
    """The tables of a case report, for sources.tables.write_report: rows by table, regions by class, tiles by variable."""
    counts = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = one if counts is None else counts.unionByName(one)
    out = {} if counts is None else {"summary": counts}
    if "rois" in tables:
        out["classes"] = class_summary(tables["rois"])
    if "tiles" in tables:
        out["tiles"] = tile_report(tables["tiles"], tile_variables)
    return out
