"""File formats: the trace view written as recordings by Spark and read back, and exports."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strata.operators.lines import LINE
from strata.plans import views as V
from strata.plans.registry import query
from strata.plans.survey import _TILES, tiles
from strata.session import shared_folder
from strata.sources import export, ingest, radar, records

C = F.col


def segy_bytes(block: np.ndarray) -> bytes:
    n, samples = block.shape
    head = bytearray(3600)
    for at, value in ((16, 200), (20, samples), (24, 5)):
        struct.pack_into("<h", head, 3200 + at, value)
    out = bytes(head)
    for i in range(n):
        h = bytearray(240)
        struct.pack_into("<h", h, 70, -1000)
        struct.pack_into("<iii", h, 72, 10_000 + 20 * i, 50_000 + 5 * i, 25 * i)
        out += bytes(h) + block[i].astype("<f4").tobytes()
    return out


def dzt_bytes(block: np.ndarray) -> bytes:
    samples = block.shape[1]
    head = bytearray(1024)
    struct.pack_into("<HHHHh", head, 0, 255, 1, samples, 32, 0)
    struct.pack_into("<5f", head, 10, 0.0, 40.0, 0.0, 0.0, 0.2 * samples)
    struct.pack_into("<Hf", head, 52, 1, 9.0)
    return bytes(head) + np.rint(block * 1e6).astype("<i4").tobytes()


def mala_bytes(block: np.ndarray) -> bytes:
    return np.rint(block * 1e4).astype("<i2").tobytes()


def spr_bytes(block: np.ndarray) -> bytes:
    samples = block.shape[1]
    fields = {"ACQUISITION_DATE": "2024", "SPR_FILE_VERSION": "7", "SPR_SAMPLES_PER_SCAN": str(samples), "SPR_SAMPLING_INTERVAL": "200", "SPR_SHAFT_INTERVAL": "0.025", "SPR_MEDIUM_DIELECTRIC": "9.0", "NOTE": ""}
    out = b"\x01" * 100
    for key, value in fields.items():
        text = f"{key} {value}".encode()
        out += struct.pack("<H", len(text) + 3) + text + b"\x00"
    for row in np.rint(block * 1e4).astype("<i2"):
        head = bytearray(64)
        struct.pack_into("<HH", head, 0, 1, 64)
        head[32:41] = b"\x0d\x00LINE_ID"
        out += bytes(head) + row.tobytes()
    return out


def recordings(spark, sf, encode):
    """Every line and channel of the trace view as the bytes of one file."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trace")
        block = np.stack(pdf["samples"].to_numpy()).astype(float)
        return pd.DataFrame({"path": [f"{pdf['line_id'].iloc[0]}/{pdf['channel'].iloc[0]}"], "content": [encode(block)]})

    return V.traces(spark, sf).groupBy(*LINE).applyInPandas(run, "path string, content binary")


def decoded(files, reader, digits=6):
    t = ingest.decode(files, reader).filter(C("error").isNull())
    key = F.split("path", "/")
    return t.select(key[0].cast("long").alias("line_id"), key[1].alias("channel"), "trace", F.round("distance_m", 4).alias("distance_m"), F.round("dt", 6).alias("dt"),
                    F.posexplode("samples").alias("sample", "v")).select("line_id", "channel", "trace", "distance_m", "dt", "sample", F.round("v", digits).alias("amp"))


@query("C03_segy_ingest", """
  SELECT s.line_id, s.channel, s.trace, CASE WHEN n.n > 1 THEN round(s.trace * 0.025, 4) END AS distance_m, 0.2 AS dt, s.sample, round(s.amp, 6) + 0.0 AS amp FROM samples s JOIN (SELECT line_id, channel, max(trace) + 1 AS n FROM samples GROUP BY ALL) n USING (line_id, channel)""")
def _(spark, sf):
    return decoded(recordings(spark, sf, segy_bytes), "segy")


@query("C04_dzt_ingest", """
  SELECT line_id, channel, trace, round(trace * 0.025, 4) AS distance_m, 0.2 AS dt, CAST(s AS INTEGER) AS sample, round_even(samples[greatest(s, 2) + 1] * 1e6, 0) + 0.0 AS amp FROM traces, range(64) AS r(s)""")
def _(spark, sf):
    return decoded(recordings(spark, sf, dzt_bytes), "dzt")


@query("C05_mala_ingest", "SELECT line_id, channel, trace, round(trace * 0.025, 4) AS distance_m, 0.2 AS dt, sample, round_even(amp * 1e4, 0) + 0.0 AS amp FROM samples")
def _(spark, sf):
    data = recordings(spark, sf, mala_bytes)
    named = data.withColumn("path", F.concat("path", F.lit(".rd3")))
    head = F.lit("SAMPLES:64\nFREQUENCY:5000\nDISTANCE INTERVAL:0.025").cast("binary")
    both = named.unionByName(data.select(F.concat("path", F.lit(".rad")).alias("path"), head.alias("content")))
    return decoded(ingest.with_mala_headers(both).withColumn("path", F.regexp_replace("path", r"\.rd3$", "")), "mala")


@query("C06_spr_ingest", "SELECT line_id, channel, trace, round(trace * 0.025, 4) AS distance_m, 0.2 AS dt, sample, round_even(amp * 1e4, 0) + 0.0 AS amp FROM samples")
def _(spark, sf):
    return decoded(recordings(spark, sf, spr_bytes), "spr")


@query("C07_xta_ingest", "SELECT line_id, trace, sample, amp FROM (SELECT line_id, trace, sample, round(amp, 6) + 0.0 AS amp FROM samples WHERE channel = 'RAD') WHERE line_id IN (SELECT line_id FROM samples WHERE channel = 'RAD' GROUP BY line_id)")
def _(spark, sf):
    s = V.traces(spark, sf).filter(C("channel") == "RAD")
    row = lambda x, i: F.concat_ws(" ", F.format_string("%.3f", C("trace") * 0.025), F.format_string("%.1f", i * 0.2), x.cast("decimal(38,18)").cast("string"))
    one = s.select("line_id", "trace", F.concat_ws("\n", F.transform("samples", row)).alias("text"))
    f = one.groupBy("line_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("trace", "text"))), lambda t: t["text"])).cast("binary").alias("content"))
    traces, _refused = ingest.read_xta(f.select(C("line_id").cast("string").alias("path"), "content"))
    return traces.select(C("path").cast("long").alias("line_id"), "trace", F.posexplode("samples").alias("sample", "v")).select("line_id", "trace", "sample", F.round("v", 6).alias("amp"))


@query("C08_gps_log_ingest", """
  SELECT o_custkey AS line_id, CAST(o_orderkey % 400 AS INTEGER) AS trace, CAST((o_orderkey % 190) - 95 AS DOUBLE) AS lat, CAST((o_orderkey % 370) - 185 AS DOUBLE) AS lon FROM orders
  WHERE o_orderkey % 13 <> 0 AND (o_orderkey % 190) - 95 BETWEEN -90 AND 90 AND (o_orderkey % 370) - 185 BETWEEN -180 AND 180 AND NOT ((o_orderkey % 190) = 95 AND (o_orderkey % 370) = 185)""")
def _(spark, sf):
    o = C("o_orderkey")
    raw = V.table(spark, sf, "orders").select(C("o_custkey").alias("line_id"), F.when(o % 13 == 0, "n/a").otherwise((o % 400).cast("string")).alias("trace"),
                                              (o % 190 - 95).cast("string").alias("lat"), (o % 370 - 185).cast("string").alias("lon"))
    return ingest.gps_fixes(raw)


@query("C01_path_intake", """
  SELECT e AS extension, CASE WHEN r THEN 'file' ELSE 'skipped' END AS outcome, count(*) AS n FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'sgy' WHEN 1 THEN 'RD3' WHEN 2 THEN 'pdf' ELSE 'ra2' END AS e, page_id % 4 <> 2 AS r FROM pages WHERE page_id % 10 <> 9)
  GROUP BY ALL""")
def _(spark, sf):
    i = C("page_id")
    e = F.when(i % 4 == 0, "sgy").when(i % 4 == 1, "RD3").when(i % 4 == 2, "pdf").otherwise("ra2")
    name = F.concat(F.lit("survey/"), F.when(i % 10 == 9, "._").otherwise("line"), i.cast("string"), F.lit("."), e)
    good, bad = ingest.intake(V.table(spark, sf, "pages").select(name.alias("path")))
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension")
    both = good.select(ext, F.lit("file").alias("outcome")).unionByName(bad.select(ext, F.lit("skipped").alias("outcome")))
    return both.groupBy("extension", "outcome").agg(F.count("*").alias("n"))


@query("C16_csv_rows", """
  SELECT finding_id, CASE WHEN finding_id % 3 = 0 THEN '''=' || class_name WHEN finding_id % 3 = 1 THEN '''@' || class_name ELSE class_name END AS label, printf('%.3f', x1) AS x1 FROM findings""")
def _(spark, sf):
    i = C("finding_id")
    f = V.findings(spark, sf).select(i, F.concat(F.when(i % 3 == 0, "=").when(i % 3 == 1, "@").otherwise(""), C("class_name")).alias("label"), "x1")
    return export.csv_safe(f, {"x1": 3})


@query("C17_U02_geojson_features", """
  SELECT 'anchor' AS kind, anchor_id AS id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM anchors UNION ALL SELECT 'fix', fix_id, round(lon, 8), round(lat, 8) FROM gps_fixes""")
def _(spark, sf):
    a = V.anchors(spark, sf).select(F.lit("anchor").alias("kind"), C("anchor_id").alias("id"), "lat", "lon", F.lit(None).cast("string").alias("note"))
    g = V.gps_fixes(spark, sf).select(F.lit("fix").alias("kind"), C("fix_id").alias("id"), "lat", "lon", F.lit(None).cast("string").alias("note"))
    f = export.all_features(*[export.features(x, export.point(C("lon"), C("lat")), ["kind", "id", "note"]) for x in (a, g)])
    j = F.from_json("feature", "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<kind:string,id:long,note:string>")
    return f.select(j.alias("j")).select(C("j.properties.kind").alias("kind"), C("j.properties.id").alias("id"), C("j.geometry.coordinates")[0].alias("lon"), C("j.geometry.coordinates")[1].alias("lat"))


@query("C19_training_manifest", None)
def _(spark, sf):
    from strata.operators.decisions import tile_labels

    decided, clean = tiles(spark, sf)
    m = export.training_manifest(clean.withColumn("job", C("line_id").cast("string")), tile_labels(clean, decided, ["line_id"]), ["line_id"])
    return m.select("line_id", "tile_id", "t0", "s0", "t1", "s1", "split", F.size("labels").alias("n_labels"))


@query("C20_long_callout_table", "SELECT drawing, sheet, utility, coalesce(printf('%.2f', depth_m), '') AS depth_m, read_by FROM (SELECT drawing, sheet, utility, read_by, round(depth_m * 25, 0) AS depth_m FROM callouts)")
def _(spark, sf):
    c = V.callouts(spark, sf).select("drawing", "sheet", "utility", F.round(C("depth_m") * 25, 0).alias("d"), "read_by")
    c = c.withColumn("depth_m", F.when(C("d").isNull(), "").otherwise(F.format_string("%.2f", C("d")))).drop("d")
    return export.csv_safe(c)


def written(files, folder: str):
    """Write files (name, content) below a folder that all executors reach; returns how many."""
    def run(batches):
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        store.create_dir(inside, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with store.open_output_stream(f"{inside}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.mapInPandas(run, "n long").agg(F.sum("n")).first()[0]


@query("C03_Z03_split_segy", """
  SELECT line_id, channel, CAST(trace AS BIGINT) AS trace, round(10 + 0.02 * trace, 6) AS x, round(50 + 0.005 * trace, 6) AS y, round(CASE WHEN n > 1 THEN 0.025 END, 6) AS spacing, 0.2 AS dt, sample, round(amp, 6) + 0.0 AS amp
  FROM samples JOIN (SELECT line_id, channel, max(trace) + 1 AS n FROM traces GROUP BY ALL) USING (line_id, channel)""")
def _(spark, sf):
    folder = shared_folder(spark, "recordings")
    name = F.concat(F.replace("path", F.lit("/"), F.lit("_")), F.lit(".sgy"))
    written(recordings(spark, sf, segy_bytes).select(name.alias("name"), "content"), folder)
    radar.register(spark)
    t = spark.read.format("radar").option("splitBytes", 4096).load(folder).filter("error IS NULL")
    key = F.split(F.regexp_extract("path", r"([^/]+)\.sgy$", 1), "_")
    at = lambda c: F.round(c, 6).alias(c)
    return t.select(key[0].cast("long").alias("line_id"), key[1].alias("channel"), "trace", at("x"), at("y"), at("spacing"), at("dt"), F.posexplode("samples").alias("sample", "v")).select(
        "line_id", "channel", "trace", "x", "y", "spacing", "dt", "sample", F.round(C("v").cast("double"), 6).alias("amp"))


@query("C10_record_stores", """
  SELECT CAST(line_id AS VARCHAR) AS job, CASE WHEN line_id % 11 > 3 THEN count(*) ELSE 0 END AS n_records, CAST(CASE WHEN line_id % 11 > 3 THEN sum(CAST(round(chainage_m * 10) AS BIGINT)) ELSE 0 END AS BIGINT) AS chainage_dm,
    CASE line_id % 11 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no list of "reference_points"' WHEN 2 THEN 'record 0 has a value of another type' WHEN 3 THEN 'record 0 lacks source' END AS reason FROM anchors GROUP BY line_id""")
def _(spark, sf):
    fields = F.struct("anchor_id", F.struct("chainage_m", "lat", "lon", "accuracy_m", "source").alias("r"))
    jobs = V.anchors(spark, sf).groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["r"]).alias("reference_points"))
    text, k = F.to_json(F.struct(F.lit(1).alias("version"), "reference_points")), C("line_id") % 11
    text = F.when(k == 0, F.substring(text, F.lit(1), F.length(text) - 3)).when(k == 1, F.replace(text, F.lit('"reference_points"'), F.lit('"points"'))).when(
        k == 2, F.regexp_replace(text, r'"chainage_m":[0-9.E-]+', '"chainage_m":"x"')).when(k == 3, F.replace(text, F.lit('"source"'), F.lit('"origin"'))).otherwise(text)
    files = jobs.select(F.concat(F.lit("annotations/"), C("line_id").cast("string"), F.lit("/georef.json")).alias("path"), text.alias("text"))
    good, refused = records.parse_records(files, "anchors")
    whole = good.groupBy("job").agg(F.count("*").alias("n_records"), F.sum(F.round(C("chainage_m") * 10).cast("long")).alias("chainage_dm")).withColumn("reason", F.lit(None).cast("string"))
    none = F.lit(0).cast("long")
    return whole.unionByName(refused.select(F.regexp_extract("path", records.JOB, 1).alias("job"), none.alias("n_records"), none.alias("chainage_dm"), "reason"))


@query("C09_survey_metadata", """
  SELECT 'nation' || s_nationkey AS survey, CAST(s_suppkey AS VARCHAR) AS location_id, CAST(s_suppkey % 30 AS VARCHAR) AS eps, CASE WHEN s_suppkey % 4 <> 0 THEN 'soil' || s_suppkey % 3 END AS soil FROM supplier""")
def _(spark, sf):
    i = C("s_suppkey")
    cells = F.concat_ws(";", i.cast("string"), (i % 30).cast("string"), F.when(i % 4 != 0, F.concat(F.lit("soil"), (i % 3).cast("string"))))
    lines = V.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.concat_ws("\r\n", F.sort_array(F.collect_list(cells))).alias("rows"))
    text = F.concat(F.lit("\ufeffLocationID; eps;soil\r\n"), "rows", F.lit("\r\n"))
    m = records.parse_metadata(lines.select(F.concat(F.lit("nation"), C("s_nationkey").cast("string")).alias("path"), text.alias("text")))
    return m.select(C("path").alias("survey"), "location_id", C("fields")["eps"].alias("eps"), C("fields")["soil"].alias("soil"))


@query("C11_exchange_tables", """
  SELECT 'point' AS kind, 'road "' || line_id || '", Rhs' AS drawing, CAST(anchor_id % 9 AS INTEGER) AS sheet, CASE WHEN anchor_id % 7 <> 0 THEN chainage_m END AS chainage_m, round(lat, 6) AS lat FROM anchors
  UNION ALL SELECT 'call-out', drawing, sheet, round(depth_m * 10, 3), NULL FROM callouts""")
def _(spark, sf):
    i = C("anchor_id")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    road = F.concat(F.lit('road "'), C("line_id").cast("string"), F.lit('", Rhs'))
    number = lambda c: c.cast("double").cast("string")
    points = V.anchors(spark, sf).select(F.concat_ws(",", quoted(road), (i % 9).cast("string"), F.when(i % 7 == 0, "n/a").otherwise(number(C("chainage_m"))), number(C("lat")), number(C("lon"))).alias("value"))
    calls = V.callouts(spark, sf).select(F.concat_ws(",", quoted(C("drawing")), C("sheet").cast("string"), C("utility"), F.coalesce(number(C("depth_m")), F.lit("")), F.lit(""), F.lit(""), F.lit("read"), F.lit("text")).alias("value"))
    p = records.parse_table(points, records.POINT_TABLE).select(F.lit("point").alias("kind"), "drawing", "sheet", "chainage_m", F.round("lat", 6).alias("lat"))
    c = records.parse_table(calls, records.CALLOUT_TABLE).select(F.lit("call-out").alias("kind"), "drawing", "sheet", F.round(C("depth_m") * 10, 3).alias("chainage_m"), F.lit(None).cast("double").alias("lat"))
    return p.unionByName(c)


_DIG = """SELECT CASE WHEN pick_id % 9 = 0 THEN '=' ELSE '' END || line_id || '#' || pick_id AS id, CASE WHEN strength > 50 THEN 'confirmed' ELSE 'proposed' END AS status, line_id AS line, trace * 0.025 AS chainage_m, 12.9 + trace * 0.000001 AS lat,
    77.5 + sample * 0.000001 AS lon, sample * 0.01 AS depth_m, 0.11 AS depth_error_m, CASE WHEN pick_id % 4 = 0 THEN 'pipe' ELSE '' END AS identity, CASE WHEN pick_id % 5 = 0 THEN '-x' END AS note FROM channel_picks"""


def dig_rows(spark, sf):
    i = C("pick_id")
    text = lambda v, n: F.lit(v).alias(n)
    return V.channel_picks(spark, sf).select(
        F.concat(F.when(i % 9 == 0, "=").otherwise(""), C("line_id").cast("string"), F.lit("#"), i.cast("string")).alias("id"), F.when(C("strength") > 50, "confirmed").otherwise("proposed").alias("status"),
        C("line_id").cast("string").alias("line"), (C("trace") * 0.025).alias("chainage_m"), (12.9 + C("trace") * 0.000001).alias("lat"), (77.5 + C("sample") * 0.000001).alias("lon"), F.lit(0.25).alias("horizontal_error_m"),
        (C("sample") * 0.01).alias("depth_m"), F.lit(0.11).alias("depth_error_m"), F.when(i % 4 == 0, "pipe").otherwise("").alias("identity"), text("", "material"), text("ann", "decided_by"), text("2024", "decided_at"),
        text("assumed", "depth_basis"), F.when(i % 5 == 0, "-x").alias("note"), F.lit(12.9).alias("line_start_lat"), F.lit(77.5).alias("line_start_lon"), text("", "field_outcome"), text("", "field_report"))


@query("C16_dig_item_export", f"""
  WITH d AS ({_DIG}) SELECT CASE WHEN id LIKE '=%' THEN '''' || id ELSE id END AS id, status, CAST(line AS VARCHAR) AS line, printf('%.2f', depth_m) AS depth_m, printf('%.2f', greatest(depth_m - depth_error_m, 0)) AS depth_min_m, printf('%.2f', depth_m + depth_error_m) AS depth_max_m,
    printf('%.8f', lat) AS lat, printf('%.8f', lon) AS lon, identity, coalesce('''' || note, '') AS note, '' AS attention_reason FROM d
  UNION ALL SELECT CASE WHEN line_id % 2 = 0 THEN line_id || '#r' ELSE CAST(line_id AS VARCHAR) END, 'needs_attention', CAST(line_id AS VARCHAR), '', '', '', '', '', '', '', 'no track' FROM line_table WHERE channel = 'RAD'""")
def _(spark, sf):
    lines = V.line_table(spark, sf).filter(C("channel") == "RAD")
    attention = lines.select(C("line_id").cast("string").alias("line"), F.when(C("line_id") % 2 == 0, "r").alias("ref"), F.lit("no track").alias("reason"))
    return export.dig_export(dig_rows(spark, sf), attention).select("id", "status", "line", "depth_m", "depth_min_m", "depth_max_m", "lat", "lon", "identity", "note", "attention_reason")


@query("C16_pick_export", """
  SELECT CAST(pick_id AS VARCHAR) AS id, channel, printf('%.2f', trace + 0.0) AS trace, printf('%.2f', sample + 0.0) AS sample, printf('%.3f', sample * 0.2) AS time_ns, printf('%.3f', sample * 0.01) AS depth_m, '0.09990' AS velocity_m_per_ns,
    CASE WHEN pick_id % 3 = 0 THEN 'fitted' ELSE 'assumed' END AS velocity_source, '9.00' AS dielectric, CASE WHEN pick_id % 3 = 0 THEN '0.900' ELSE '' END AS fit_r2, CASE WHEN pick_id % 7 = 0 THEN '''+pipe' ELSE 'pipe' END AS label, '' AS note, '2024' AS created_at FROM channel_picks""")
def _(spark, sf):
    i = C("pick_id")
    fitted = i % 3 == 0
    p = V.channel_picks(spark, sf).select(
        i.alias("id"), "channel", "trace", "sample", (C("sample") * 0.2).alias("time_ns"), (C("sample") * 0.01).alias("depth_m"), F.lit(0.0999).alias("velocity_m_per_ns"), F.when(fitted, "fitted").otherwise("assumed").alias("velocity_source"),
        F.lit(9.0).alias("dielectric"), F.when(fitted, 0.9).alias("fit_r2"), F.when(i % 7 == 0, "+pipe").otherwise("pipe").alias("label"), F.lit("").alias("note"), F.lit("2024").alias("created_at"))
    return export.pick_export(p)


@query("C16_review_export", """
  SELECT CAST(label_id AS VARCHAR) AS review, CAST(trace AS VARCHAR) AS target, decision AS status, CASE WHEN label_id % 5 = 0 THEN '''@ann' ELSE 'ann' END AS reviewer, 'shape (m' || label_id % 3 || ')' AS said_by, CASE WHEN label_id % 4 = 0 THEN '' ELSE 'seen' END AS why FROM label_events""")
def _(spark, sf):
    i = C("label_id")
    none = lambda n: F.lit("").alias(n)
    e = V.label_events(spark, sf).select(
        i.alias("id"), none("channel"), C("trace").alias("target_id"), none("identity"), none("material"), none("confidence"), C("decision").alias("status"), F.when(i % 5 == 0, "@ann").otherwise("ann").alias("reviewer"), none("decided_at"),
        none("note"), F.lit("shape").alias("layer"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"), F.when(i % 4 != 0, "seen").alias("why"))
    return export.review_export(e).select("review", "target", "status", "reviewer", "said_by", "why")


@query("C17_dig_features", f"""
  WITH d AS ({_DIG}) SELECT id, status, round(lon, 8) AS lon, round(lat, 8) AS lat, round(greatest(depth_m - 0.11, 0), 2) AS depth_from, round(depth_m + 0.11, 2) AS depth_to, note FROM d""")
def _(spark, sf):
    j = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<id:string,status:string,depth_range_m:array<double>,note:string>")
    p = export.dig_features(dig_rows(spark, sf)).select(j.alias("j"))
    return p.select("j.properties.id", "j.properties.status", C("j.geometry.coordinates")[0].alias("lon"), C("j.geometry.coordinates")[1].alias("lat"), C("j.properties.depth_range_m")[0].alias("depth_from"), C("j.properties.depth_range_m")[1].alias("depth_to"), "j.properties.note")


@query("C17_track_features", """
  SELECT line_id AS job, round(max(chainage_m) - min(chainage_m), 2) AS length_m, count(*) AS points, round(arg_min(lon, (chainage_m, lon, lat)), 8) AS start_lon FROM anchors GROUP BY line_id""")
def _(spark, sf):
    j = F.from_json("feature", "geometry struct<type:string,coordinates:array<array<double>>>, properties struct<job:long,length_m:double,start:array<double>>")
    p = export.track_features(V.anchors(spark, sf)).select(j.alias("j"))
    return p.select("j.properties.job", "j.properties.length_m", F.size("j.geometry.coordinates").cast("long").alias("points"), C("j.properties.start")[0].alias("start_lon"))


@query("C17_run_features", """
  SELECT site || '#R' || line_rank AS id, count(*) AS targets, round(min(depth_m), 2) AS shallow, round(max(depth_m), 2) AS deep FROM run_targets GROUP BY site, line_rank""")
def _(spark, sf):
    # Targets of one line stand in for the members of a run: what is checked here is the feature.
    m = V.run_targets(spark, sf).select("site", C("line_rank").alias("run_id"), "line_rank", "target_id", C("north").alias("lat"), C("east").alias("lon"), "depth_m")
    j = F.from_json("feature", "geometry struct<coordinates:array<array<double>>>, properties struct<id:string,depth_range_m:array<double>,targets:array<long>>")
    p = export.run_features(m).select(j.alias("j"))
    return p.select("j.properties.id", F.size("j.geometry.coordinates").cast("long").alias("targets"), C("j.properties.depth_range_m")[0].alias("shallow"), C("j.properties.depth_range_m")[1].alias("deep"))


@query("C16_target_export", """
  SELECT CAST(pick_id AS VARCHAR) AS id, CAST(line_id AS VARCHAR) AS line, printf('%.3f', trace * 0.025) AS chainage_m, printf('%.2f', sample * 0.01) AS depth_m, CASE WHEN pick_id % 2 = 0 THEN 'RAD RA1' ELSE 'RAD' END AS channels,
    CASE WHEN pick_id % 2 = 0 THEN '2' ELSE '1' END AS corroboration, CASE WHEN pick_id % 3 = 0 THEN 'lighter' ELSE '' END AS contrast, CASE WHEN sample * 0.2 < 1.5 THEN 'true' ELSE 'false' END AS near_surface FROM channel_picks""")
def _(spark, sf):
    i = C("pick_id")
    t = V.channel_picks(spark, sf).select(
        i.cast("string").alias("id"), F.lit("detected").alias("status"), C("line_id").cast("string").alias("line"), (C("trace") * 0.025).alias("chainage_m"), (C("sample") * 0.01).alias("depth_m"), F.lit(0.1).alias("depth_error_m"),
        F.lit(0.2).alias("horizontal_error_m"), F.lit("assumed").alias("depth_basis"), F.when(i % 2 == 0, F.array(F.lit("RAD"), F.lit("RA1"))).otherwise(F.array(F.lit("RAD"))).alias("channels"),
        F.when(i % 3 == 0, "lighter").alias("contrast"), F.lit(None).cast("string").alias("reading"), (C("sample") * 0.2 < 1.5).alias("near_surface"))
    return export.target_export(t).select("id", "line", "chainage_m", "depth_m", "channels", "corroboration", "contrast", "near_surface")
