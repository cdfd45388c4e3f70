"""Results as CSV, GeoJSON features and training manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import split_of, spreadsheet_text

C = F.col


def csv_safe(rows: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Text cells a spreadsheet will not run; numbers with a fixed count of decimals."""
    digits = digits or {}
    cells = []
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cells.append(spreadsheet_text(C(f.name)).alias(f.name))
        elif f.name in digits:
            cells.append(F.format_string(f"%.{digits[f.name]}f", C(f.name)).alias(f.name))
        else:
            cells.append(C(f.name))
    return rows.select(*cells)


def write_csv(rows: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    csv_safe(rows, digits).write.mode("overwrite").option("header", "true").csv(path)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 8), F.round(lat, 8)).alias("coordinates"))


def line_string(points: Column) -> Column:
    """`points`: an array of structs with lon and lat, in order."""
    return F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(F.round(p["lon"], 8), F.round(p["lat"], 8))).alias("coordinates"))


def features(rows: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row; unknown properties are written as null, not left out."""
    body = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def all_features(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def track_lines(points: DataFrame) -> DataFrame:
    """A line's track as one ordered array; a track holds a point a metre, as its maker spaced them."""
    return points.groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chainage_m", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def training_manifest(tiles: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """One row per tile with its labels and split; whole jobs stay on one side of the split."""
    listed = labels.groupBy(*keys, "tile_id").agg(F.array_sort(F.collect_list(F.struct("x", "y", "w", "h"))).alias("labels"))
    j = tiles.join(listed, [*keys, "tile_id"], "left")
    empty = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    return j.withColumn("labels", F.coalesce("labels", empty)).withColumn("split", split_of(C("job")))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").partitionBy("split").json(path)


# Columns of the named exports in their order, with the number of decimals of numbers.
PICKS = {"id": None, "channel": None, "trace": 2, "sample": 2, "time_ns": 3, "depth_m": 3, "velocity_m_per_ns": 5, "velocity_source": None, "dielectric": 2, "fit_r2": 3, "label": None, "note": None, "created_at": None}
REVIEWS = {"review": None, "channel": None, "target": None, "identity": None, "material": None, "confidence": None, "status": None, "reviewer": None, "decided_at": None, "note": None, "said_by": None, "why": None}
DIG_ITEMS = {
    "id": None, "status": None, "line": None, "chainage_m": 2, "lat": 8, "lon": 8, "horizontal_error_m": 2, "depth_m": 2, "depth_min_m": 2, "depth_max_m": 2, "identity": None, "material": None, "decided_by": None,
    "decided_at": None, "depth_basis": None, "note": None, "line_start_lat": 8, "line_start_lon": 8, "field_outcome": None, "field_report": None, "attention_reason": None}
TARGETS = {
    "id": None, "status": None, "line": None, "chainage_m": 3, "depth_m": 2, "depth_error_m": 2, "horizontal_error_m": 2, "depth_basis": None, "channels": None, "corroboration": 0, "contrast": None, "reading": None,
    "near_surface": None}


def table_export(rows: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """The columns of a named export as text: numbers with their decimals, nothing for null, no cell that a spreadsheet runs."""
    def cell(name: str, digits: int | None) -> Column:
        text = spreadsheet_text(C(name).cast("string")) if digits is None else F.format_string(f"%.{digits}f", C(name).cast("double"))
        return F.when(C(name).isNull(), "").otherwise(text).alias(name)

    return rows.select(*[cell(n, d) for n, d in columns.items()])


def pick_export(picks: DataFrame) -> DataFrame:
    """Picks with the source of their velocity beside it; fit_r2 is empty unless it was fitted."""
    return table_export(picks, PICKS)


def review_export(reviews: DataFrame) -> DataFrame:
    """Reviews of a record store (id, target_id, layer, model, ...), with who said what."""
    said = F.concat("layer", F.lit(" ("), "model", F.lit(")"))
    return table_export(reviews.withColumn("review", C("id")).withColumn("target", C("target_id")).withColumn("said_by", said), REVIEWS)


def _depth_range(rows: DataFrame) -> DataFrame:
    return rows.withColumn("depth_min_m", F.greatest(C("depth_m") - C("depth_error_m"), F.lit(0.0))).withColumn("depth_max_m", C("depth_m") + C("depth_error_m"))


def dig_export(items: DataFrame, attention: DataFrame) -> DataFrame:
    """Dig items, and below them what needs attention (line, ref, reason): lines and references without a place."""
    whole = table_export(_depth_range(items).withColumn("attention_reason", F.lit(None).cast("string")), DIG_ITEMS)
    ref = F.when(F.coalesce("ref", F.lit("")) != "", F.concat("line", F.lit("#"), "ref")).otherwise(C("line"))
    told = {"id": spreadsheet_text(ref), "status": F.lit("needs_attention"), "line": spreadsheet_text(C("line")), "attention_reason": spreadsheet_text(C("reason"))}
    return whole.unionByName(attention.select(*[told.get(n, F.lit("")).alias(n) for n in DIG_ITEMS]))


def target_export(targets: DataFrame) -> DataFrame:
    """The target list of a site; channels is an array of their names."""
    return table_export(targets.withColumn("corroboration", F.size("channels")).withColumn("channels", F.array_join("channels", " ")), TARGETS)


def callout_export(callouts: DataFrame) -> DataFrame:
    """Call-outs in the long table that drawings are exchanged in."""
    return table_export(callouts, {"drawing": None, "sheet": 0, "utility": None, "depth_m": 2, "chainage_m": 1, "chainage_source": None, "status": None, "read_by": None})


def point_export(points: DataFrame) -> DataFrame:
    return table_export(points, {"drawing": None, "sheet": 0, "chainage_m": 1, "lat": 7, "lon": 7})


def track_features(points: DataFrame) -> DataFrame:
    """One line feature for each line's track (line_id, chainage_m, lat, lon), with its length and start."""
    ends = points.groupBy("line_id").agg((F.max("chainage_m") - F.min("chainage_m")).alias("length"))
    t = track_lines(points).join(ends, "line_id").select(
        F.lit("survey_line").alias("kind"), C("line_id").alias("job"), F.round("length", 2).alias("length_m"),
        F.transform(F.slice("points", 1, 1), lambda p: F.array(F.round(p["lon"], 8), F.round(p["lat"], 8)))[0].alias("start"), "points")
    return features(t, line_string(C("points")), ["kind", "job", "length_m", "start"])


def run_features(members: DataFrame, site: str = "site") -> DataFrame:
    """One line feature for each utility run (site, run_id, line_rank, target_id, lat, lon, depth_m), its targets in the order of the lines."""
    member = F.struct("line_rank", "target_id", "lat", "lon")
    r = members.groupBy(site, "run_id").agg(
        F.array_sort(F.collect_list(member)).alias("points"), F.countDistinct("line_rank").alias("lines"), F.percentile("depth_m", F.lit(0.5)).alias("middle"), F.min("depth_m").alias("d0"), F.max("depth_m").alias("d1"))
    r = r.select(
        F.lit("utility_run").alias("kind"), F.concat(C(site).cast("string"), F.lit("#R"), C("run_id").cast("string")).alias("id"), "lines", F.round("middle", 2).alias("depth_m"),
        F.array(F.round("d0", 2), F.round("d1", 2)).alias("depth_range_m"), F.transform("points", lambda p: p["target_id"]).alias("targets"), F.lit("suggested").alias("status"), "points")
    return features(r, line_string(C("points")), ["kind", "id", "lines", "depth_m", "depth_range_m", "targets", "status"])


def dig_features(items: DataFrame) -> DataFrame:
    """One point feature for each dig item, with its depth range and the start of its line."""
    near = F.round
    f = _depth_range(items).select(
        F.lit("dig_item").alias("kind"), "id", "status", "line", near("chainage_m", 2).alias("chainage_m"), F.array(near("line_start_lon", 8), near("line_start_lat", 8)).alias("line_start"),
        near("horizontal_error_m", 2).alias("horizontal_error_m"), near("depth_m", 2).alias("depth_m"), F.array(near("depth_min_m", 2), near("depth_max_m", 2)).alias("depth_range_m"), "depth_basis", "identity",
        "material", "decided_by", "decided_at", "note", "field_outcome", "field_report", "lat", "lon")
    return features(f, point(C("lon"), C("lat")), [c for c in f.columns if c not in ("lat", "lon")])


def collection_metadata(site: str, items: DataFrame, attention: DataFrame) -> DataFrame:
    """The one row beside the features: how many items there are and are confirmed, and how many places need attention, by reason."""
    n = items.agg(F.count("*").alias("items"), F.count_if(C("status") == "confirmed").alias("confirmed"))
    by = attention.groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("needs_attention"))
    return n.withColumn("k", F.lit(1)).join(by.withColumn("k", F.lit(1)), "k").select(F.lit(site).alias("site"), "items", "confirmed", "needs_attention")
