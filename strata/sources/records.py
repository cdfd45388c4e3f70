"""Human records from JSON files, one file for each job and kind: typed rows of good files, and a reason for every other file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

#: Each kind's file name, the key its list stands under, and its fields; those after the bar may be absent.
STORES = {
    "boxes": ("boxes.json", "boxes", "id string, channel string, x double, y double, w double, h double",
              "note string, detector string, detector_version string, run_id string, corroboration int"),
    "picks": ("picks.json", "picks", "id string, channel string, trace double, sample double, time_ns double, depth_m double, velocity_m_per_ns double, velocity_source string, "
              "dielectric double, label string, note string, fit_r2 double, created_at string", "post_processed boolean"),
    "reviews": ("reviews.json", "reviews", "id string, channel string, target_id string, target_kind string, x double, y double, w double, h double, identity string, material string, "
                "confidence string, why string, layer string, model string, created_at string", "status string, reviewer string, note string, decided_at string"),
    "field_reports": ("field_reports.json", "reports", "id string, item_id string, outcome string, reporter string, note string, reported_at string, lat double, lon double, accuracy_m double",
                      "depth_found_m double"),
    "anchors": ("georef.json", "reference_points", "chainage_m double, lat double, lon double, accuracy_m double, source string", ""),
}
#: What an absent field stands for, where that is not null.
DEFAULTS = {"boxes": {"note": ""}, "reviews": {"status": "proposed", "reviewer": "", "note": "", "decided_at": ""}}
JOB = r"([^/]+)/[^/]+$"  # the folder that a file lies in


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ") if f]


def record_texts(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """path, text of every file of a kind below a folder. Spark does not list files of no bytes; those need a listing of one's own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", STORES[kind][0]).load(root)
    return files.select("path", C("content").cast("string").alias("text"))


def parse_records(files: DataFrame, kind: str, defaults: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, refused) of files (path, text).

    records: job, no, version, and the kind's fields. refused: path, reason: a file that is no JSON, that has no list under
    its key, or one of whose records lacks a field, has one that the kind does not know, or a value of another type. A
    refused file gives no records, so that nothing is taken for empty that is only broken; other files are not touched.
    """
    _, key, required, optional = STORES[kind]
    must, may = _names(required), _names(optional)
    typed = ", ".join(x for x in (required, optional) if x)
    whole = F.from_json("text", f"version int, {key} array<string>, bad string", {"columnNameOfCorruptRecord": "bad"})
    f = files.select("path", "text", whole.alias("f"), F.try_parse_json("text").isNotNull().alias("json"))
    listed = C("f").getField(key)
    lists = f.select("path", F.when(~F.coalesce("json", F.lit(False)) | C("text").isNull(), "not JSON").when(listed.isNull() | C("f.bad").isNotNull(), f'no list of "{key}"').alias("reason"), C("f.version").alias("version"), listed.alias("records"))
    one = lists.filter(C("reason").isNull()).select("path", "version", F.posexplode("records").alias("no", "record"))
    r = F.from_json("record", f"{typed}, bad string", {"columnNameOfCorruptRecord": "bad"})
    given = F.coalesce(F.json_object_keys("record"), F.array().cast("array<string>"))
    lacking, unknown = F.array_except(F.array(*map(F.lit, must)), given), F.array_except(given, F.array(*map(F.lit, [*must, *may])))
    said = F.when(F.json_object_keys("record").isNull(), "is no object").when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(F.array_sort(lacking), ", ")))
    said = said.when(F.size(unknown) > 0, F.concat(F.lit("has unknown "), F.array_join(F.array_sort(unknown), ", "))).when(C("r.bad").isNotNull(), "has a value of another type")
    each = one.withColumn("r", r).select("path", "version", "no", "r", said.alias("said"))
    broken = each.filter(C("said").isNotNull()).groupBy("path").agg(F.min(F.struct("no", "said")).alias("m"))
    broken = broken.select("path", F.concat(F.lit("record "), C("m.no").cast("string"), F.lit(" "), C("m.said")).alias("reason"))
    absent = DEFAULTS.get(kind, {}) if defaults is None else defaults
    value = lambda n: (F.coalesce(C("r")[n], F.lit(absent[n])) if n in absent else C("r")[n]).alias(n)
    good = each.join(broken, "path", "left_anti").select(F.regexp_extract("path", JOB, 1).alias("job"), "no", "version", *[value(n) for n in (*must, *may)])
    return good, lists.filter(C("reason").isNotNull()).select("path", "reason").unionByName(broken)


def read_record_store(spark: SparkSession, kind: str, root: str) -> tuple[DataFrame, DataFrame]:
    """`parse_records` of all files of a kind below a folder, one task for many files."""
    return parse_records(record_texts(spark, kind, root), kind)


def parse_metadata(files: DataFrame, key: str = "LocationID") -> DataFrame:
    """path, location_id, fields of semicolon-separated tables (path, text): fields maps column names to values; a byte-order mark is dropped and of rows with one key the last counts."""
    lines = F.filter(F.split(F.regexp_replace("text", "^﻿", ""), r"\r?\n"), lambda x: F.trim(x) != "")
    names = F.transform(F.split(F.element_at("lines", 1), ";"), lambda x: F.trim(x))
    rows = files.withColumn("lines", lines).filter(F.size("lines") > 1).select("path", names.alias("names"), F.posexplode(F.slice("lines", 2, F.size("lines") - 1)).alias("no", "line"))
    cells = F.transform("names", lambda n, i: F.struct(n.alias("key"), F.try_element_at(F.split("line", ";"), i + 1).alias("value")))
    r = rows.select("path", "no", F.map_from_entries(cells).alias("fields")).withColumn("location_id", F.try_element_at("fields", F.lit(key)))
    last = r.groupBy("path", "location_id").agg(F.max_by("fields", "no").alias("fields"))
    return last.filter(C("location_id").isNotNull())


#: Columns of the two tables that drawings are exchanged in.
CALLOUT_TABLE = "drawing string, sheet int, utility string, depth_m double, chainage_m double, chainage_source string, status string, read_by string"
POINT_TABLE = "drawing string, sheet int, chainage_m double, lat double, lon double"


def parse_table(texts: DataFrame, fields: str) -> DataFrame:
    """Rows of comma-separated lines (value) under their names: quoted cells are opened, what is no number of its column's kind is null."""
    raw = F.from_csv("value", F.lit(", ".join(f"{n} string" for n in _names(fields))), {"mode": "PERMISSIVE"})
    kinds = [f.split() for f in fields.split(", ")]
    return texts.select(raw.alias("r")).select(*[(C(f"r.{n}") if k == "string" else F.trim(C(f"r.{n}")).try_cast(k)).alias(n) for n, k in kinds])


def read_table(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A call-out or geo-point table from disk, by its header's names."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*[(C(n) if k == "string" else F.trim(C(n)).try_cast(k)).alias(n) for n, k in (f.split() for f in fields.split(", "))])
