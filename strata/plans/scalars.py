"""Column-expression queries: physics, geometry, grading, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata import params as P
from strata.functions import geo, grading, physics, text
from strata.plans import views as V
from strata.plans.registry import query

C = F.col


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("X01_velocity_permittivity_depth", """
  SELECT line_id, fit_id, round(pow(0.2998 / velocity, 2), 6) AS dielectric,
         round(0.2998 / sqrt(pow(0.2998 / velocity, 2)), 6) AS velocity_back,
         round(velocity * apex_time_ns / 2, 6) AS depth_m
  FROM fits""")
def _(spark, sf):
    f = V.fits(spark, sf)
    eps = physics.dielectric_from_velocity(C("velocity"))
    return f.select(
        "line_id", "fit_id", r6(eps, "dielectric"), r6(physics.velocity_from_dielectric(eps), "velocity_back"),
        r6(physics.depth_from_time(C("apex_time_ns"), C("velocity")), "depth_m"))


@query("X02_velocity_from_limb_point", """
  SELECT line_id, pick_id, CASE WHEN sample * 0.4 > 4.0 AND abs(trace - 20) > 0
         THEN round(2 * abs((trace - 20) * 0.025) / sqrt((sample * 0.4) * (sample * 0.4) - 4.0 * 4.0), 6) END AS velocity
  FROM channel_picks""")
def _(spark, sf):
    return V.channel_picks(spark, sf).select(
        "line_id", "pick_id",
        r6(physics.velocity_from_limb_point((C("trace") - 20) * 0.025, C("sample") * 0.4, F.lit(4.0)), "velocity"))


@query("X03_velocity_from_curvature", """
  SELECT line_id, fit_id, round(2 * n_inliers * 0.025 / 0.2, 6) AS velocity FROM fits""")
def _(spark, sf):
    return V.fits(spark, sf).select("line_id", "fit_id", r6(physics.velocity_from_curvature(C("n_inliers"), F.lit(0.025), F.lit(0.2)), "velocity"))


@query("X04_hyperbola_curve_points", """
  SELECT line_id, fit_id, CAST(k AS INTEGER) AS offset_traces,
         round(sqrt(apex_time_ns * apex_time_ns + (2 * k * 0.025 / velocity) * (2 * k * 0.025 / velocity)) / 0.2, 6) AS sample
  FROM fits, range(-3, 4) AS r(k)""")
def _(spark, sf):
    f = V.fits(spark, sf).withColumn("offset_traces", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    return f.select("line_id", "fit_id", "offset_traces",
                    r6(physics.hyperbola_sample(C("offset_traces"), C("apex_time_ns"), C("velocity"), F.lit(0.025), F.lit(0.2)), "sample"))


@query("X05_half_widths", """
  SELECT line_id, fit_id,
    round(least(greatest(0.5 * velocity * sqrt((apex_time_ns + 3.0) * (apex_time_ns + 3.0) - apex_time_ns * apex_time_ns), 0.2), 1.5), 6) AS half_width_m,
    round(greatest(velocity * apex_time_ns / 2, 0.15), 6) AS half_aperture_m
  FROM fits""")
def _(spark, sf):
    return V.fits(spark, sf).select(
        "line_id", "fit_id", r6(physics.half_width_m(C("apex_time_ns"), C("velocity")), "half_width_m"),
        r6(physics.half_aperture_m(C("velocity") * C("apex_time_ns") / 2), "half_aperture_m"))


@query("X06_geodesic_distance", None)
def _(spark, sf):
    a = V.anchors(spark, sf)
    return a.select("line_id", "anchor_id", F.round(geo.geodesic_m(C("lat"), C("lon"), F.lit(12.9), F.lit(77.5)), 3).alias("metres"))


_W = "(1 - 0.00669437999014 * pow(sin(radians(12.9)), 2))"
_M = f"(6378137.0 * (1 - 0.00669437999014) / pow({_W}, 1.5))"
_N = f"(6378137.0 / sqrt({_W}))"


@query("X07_local_frame", f"""
  WITH e AS (SELECT line_id, anchor_id, radians(lon - 77.5) * {_N} * cos(radians(12.9)) AS east, radians(lat - 12.9) * {_M} AS north FROM anchors)
  SELECT line_id, anchor_id, round(east, 5) AS east, round(north, 5) AS north,
         round(12.9 + degrees(north / {_M}), 9) AS lat_back, round(77.5 + degrees(east / ({_N} * cos(radians(12.9)))), 9) AS lon_back
  FROM e""")
def _(spark, sf):
    a = V.anchors(spark, sf)
    east, north = geo.to_local(C("lat"), C("lon"), F.lit(12.9), F.lit(77.5))
    a = a.select("line_id", "anchor_id", east.alias("e"), north.alias("n"))
    lat, lon = geo.from_local(C("e"), C("n"), F.lit(12.9), F.lit(77.5))
    return a.select("line_id", "anchor_id", F.round("e", 5).alias("east"), F.round("n", 5).alias("north"),
                    F.round(lat, 9).alias("lat_back"), F.round(lon, 9).alias("lon_back"))


@query("X08_utm_zone_per_site", """
  SELECT line_id, min(zone) AS epsg, count(DISTINCT zone) = 1 AS single_zone FROM (
    SELECT line_id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone FROM anchors)
  GROUP BY line_id""")
def _(spark, sf):
    z = V.anchors(spark, sf).select("line_id", geo.utm_epsg(C("lon"), C("lat")).alias("zone"))
    return z.groupBy("line_id").agg(F.min("zone").alias("epsg"), (F.min("zone") == F.max("zone")).alias("single_zone"))


@query("X09_box_to_traces", """
  WITH b AS (SELECT finding_id, x1, x2, y1, y2, CAST(greatest(0, floor(x1 / 640.0 * 383)) AS INTEGER) AS t0,
         CAST(greatest(0, floor(y1 / 640.0 * 256)) AS INTEGER) AS s0 FROM findings)
  SELECT finding_id, t0 AS trace_start, CAST(least(383, greatest(t0 + 1, ceil(x2 / 640.0 * 383))) AS INTEGER) AS trace_end,
         s0 AS sample_start, CAST(least(256, greatest(s0 + 1, ceil(y2 / 640.0 * 256))) AS INTEGER) AS sample_end FROM b""")
def _(spark, sf):
    box = physics.box_in_traces(C("x1"), C("y1"), C("x2"), C("y2"), 640.0, 640.0, F.lit(383), F.lit(256))
    return V.findings(spark, sf).select("finding_id", box.alias("b")).select("finding_id", "b.*")


@query("X10_direct_wave_skip", """
  SELECT line_id, channel, CAST(least(n_samples, rint) AS INTEGER) AS skip_samples FROM
    (SELECT line_id, channel, n_samples, round_even(3.07 / d, 0) AS rint FROM
      (SELECT *, CASE channel WHEN 'RAD' THEN 0.1 WHEN 'RA1' THEN 0.2 ELSE 0.4 END AS d FROM line_table))""")
def _(spark, sf):
    d = F.when(C("channel") == "RAD", 0.1).when(C("channel") == "RA1", 0.2).otherwise(0.4)
    return V.line_table(spark, sf).select("line_id", "channel", physics.direct_wave_skip(C("n_samples"), d).alias("skip_samples"))


@query("X11_permittivity_signal", """
  SELECT line_id, apex_id, CASE WHEN e >= 90 THEN 'implausible' WHEN e <= 2.5 THEN 'air_like' WHEN site IS NULL THEN 'soil_like'
      WHEN e < site / 2 THEN 'fast' WHEN e > site * 2 THEN 'wet' ELSE 'soil_like' END AS signal
  FROM (SELECT line_id, apex_id, depth_m * 50 AS e, dielectric AS site FROM apexes)""")
def _(spark, sf):
    return V.apexes(spark, sf).select("line_id", "apex_id", physics.permittivity_signal(C("depth_m") * 50, C("dielectric")).alias("signal"))


@query("X12_callout_status", """
  SELECT drawing, sheet, part, supp, CASE WHEN depth_m IS NULL THEN 'depth_unread' WHEN safe_path_m IS NULL THEN 'no_safe_path'
      WHEN depth_m * 1.3 >= safe_path_m THEN 'reaches_safe_path' ELSE 'clear' END AS status FROM callouts""")
def _(spark, sf):
    return V.callouts(spark, sf).select("drawing", "sheet", "part", "supp", grading.callout_status(C("depth_m"), C("safe_path_m")).alias("status"))


@query("X13_depth_position_evidence", """
  SELECT finding_id,
    CASE WHEN line_id % 7 = 0 THEN round(least(greatest(y / 256.0, 0.0), 1.0) * 2.0, 6) ELSE round(y * 0.1 * (0.2998 / sqrt(9.0)) / 2, 6) END AS depth_m,
    CASE WHEN line_id % 7 <> 0 AND line_id % 3 = 0 THEN 'calibrated' ELSE 'estimated' END AS depth_label,
    CASE WHEN position_m IS NOT NULL AND line_id % 5 <> 0 THEN round(position_m + x * 0.025, 6) END AS pos_m,
    CASE WHEN position_m IS NULL OR line_id % 5 = 0 THEN 'unavailable' WHEN line_id % 2 = 0 THEN 'calibrated' ELSE 'estimated' END AS pos_label
  FROM (SELECT *, (y1 + y2) / 2 * 0.4 AS y, (x1 + x2) / 2 * 0.6 AS x FROM findings)""")
def _(spark, sf):
    f = V.findings(spark, sf).withColumn("y", (C("y1") + C("y2")) / 2 * 0.4).withColumn("x", (C("x1") + C("x2")) / 2 * 0.6)
    line = C("line_id")
    depth = grading.depth_evidence(C("y"), F.lit(256.0), F.when(line % 7 != 0, 0.1), F.lit(9.0), line % 3 == 0)
    position = grading.position_evidence(C("position_m"), F.when(line % 5 == 0, "synthetic").otherwise("wheel_encoder"), C("x"), F.lit(0.025), line % 2 == 0)
    return f.select("finding_id", depth.alias("d"), position.alias("p")).select(
        "finding_id", r6(C("d.value"), "depth_m"), C("d.label").alias("depth_label"),
        r6(C("p.value"), "pos_m"), C("p.label").alias("pos_label"))


@query("X14_quality_grade", """
  SELECT finding_id, CASE WHEN pp AND level LIKE 'QL-B%' THEN level || 'P' ELSE level END AS label, summary FROM (
    SELECT finding_id, CASE finding_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS pp,
      CASE WHEN finding_id % 11 = 0 THEN 'QL-A' WHEN finding_id % 4 = 1 THEN 'QL-B2' WHEN finding_id % 13 = 0 THEN 'QL-D' ELSE 'ungraded' END AS level,
      CASE WHEN position_confidence = 'unavailable' THEN 'no along-line position could be derived, so this cannot be placed even on its own line'
        ELSE CASE depth_confidence WHEN 'calibrated' THEN 'depth measured from this target''s own hyperbola'
          WHEN 'estimated' THEN 'depth derived from an assumed velocity, not a measured one' ELSE 'no depth could be derived' END
          || CASE WHEN 1 + finding_id % 3 >= 2 THEN ', consistent across ' || CAST(1 + finding_id % 3 AS VARCHAR) || ' frequency channels'
             ELSE ', seen on a single frequency channel' END END AS summary
    FROM findings)""")
def _(spark, sf):
    i = C("finding_id")
    pp = F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    level = grading.quality_level(i % 11 == 0, F.when(i % 2 == 1, F.when(i % 4 == 1, "QL-B2").otherwise("QL-Z")),
                                  F.when(i % 4 == 1, "second technique").otherwise(" "), i % 13 == 0)
    return V.findings(spark, sf).select(
        i, grading.quality_label(level, pp).alias("label"),
        grading.evidence_summary(C("position_confidence"), C("depth_confidence"), 1 + i % 3).alias("summary"))


@query("X15_post_processed_flag", """
  SELECT finding_id, finding_id % 4 <> 0 OR finding_id % 3 = 0 OR finding_id % 5 = 0 AS post_processed FROM findings""")
def _(spark, sf):
    i = C("finding_id")
    chain = {"time_zero_sample": i % 4, "dewow": i % 3 == 0, "background_removal": F.when(i % 5 == 0, "mean").otherwise("none"),
             "bandpass": F.lit(False), "gain": F.lit("none"), "stack_traces": F.lit(1), "migrate": F.lit(False)}
    return V.findings(spark, sf).select(i, grading.post_processed(chain).alias("post_processed"))


@query("X16_reading_text", """
  SELECT finding_id, CASE
    WHEN c = 'lighter' AND run THEN 'lighter than the soil and on a run across lines: an air-filled pipe or duct' || note
    WHEN c = 'lighter' THEN 'lighter than the soil and isolated: a possible void (check records before calling it one)'
    WHEN c = 'denser' AND run THEN 'denser than the soil and on a run across lines: a metal or water-filled pipe' || note
    WHEN c = 'denser' THEN 'denser than the soil and isolated: a stone, fitting or short object' END AS reading
  FROM (SELECT finding_id, CASE finding_id % 3 WHEN 0 THEN 'lighter' WHEN 1 THEN 'denser' ELSE 'unreadable' END AS c, finding_id % 2 = 0 AS run,
    CASE WHEN finding_id % 5 = 0 THEN '' ELSE ' (the runs on this site are not above chance)' END AS note FROM findings)""")
def _(spark, sf):
    i = C("finding_id")
    contrast = F.when(i % 3 == 0, "lighter").when(i % 3 == 1, "denser").otherwise("unreadable")
    return V.findings(spark, sf).select(i, grading.reading(contrast, i % 2 == 0, i % 5 == 0).alias("reading"))


@query("X17_error_budget", """
  SELECT fit_id, line_id, round(sqrt(j * j + 0.0025 + 0.15 * 0.15), 6) AS horizontal_error_m,
         round((CASE WHEN n_inliers > 9 THEN 0.05 ELSE 0.15 END) * d + 0.04, 6) AS depth_error_m
  FROM (SELECT *, velocity / 3 AS j, velocity * apex_time_ns / 2 AS d FROM fits)""")
def _(spark, sf):
    return V.fits(spark, sf).select(
        "fit_id", "line_id", r6(physics.horizontal_error_m(C("velocity") / 3, F.lit(0.15)), "horizontal_error_m"),
        r6(physics.depth_error_m(C("velocity") * C("apex_time_ns") / 2, C("n_inliers") > 9), "depth_error_m"))


@query("X18_gain_curves", """
  SELECT line_id, channel, trace, sample, round(amp * (1.0 + sample / 63 * 2.0), 6) + 0.0 AS linear_amp,
         round(amp * exp(sample / 63 * 2.0), 6) + 0.0 AS exponential_amp FROM samples""")
def _(spark, sf):
    return V.samples(spark, sf).select(
        "line_id", "channel", "trace", "sample",
        r6(C("amp") * physics.gain_curve(C("sample"), F.lit(64), "linear", 2.0), "linear_amp"),
        r6(C("amp") * physics.gain_curve(C("sample"), F.lit(64), "exponential", 2.0), "exponential_amp"))


_TICKS = r"'^CH-(\d{2,4})$'"


@query("X21_drawing_label_patterns", rf"""
  SELECT drawing, word_id, TRY_CAST(coalesce(nullif(regexp_extract(t, {_TICKS}, 1), ''), nullif(regexp_extract(reverse(t), {_TICKS}, 1), '')) AS INTEGER) AS tick,
         regexp_matches(t, '^CH-\d{{2,4}}$') OR regexp_matches(t, '^CH-\d+/\d+$') OR regexp_matches(reverse(t), '^CH-\d{{2,4}}$') OR regexp_matches(reverse(t), '^CH-\d+/\d+$') AS is_tick,
         CAST(nullif(regexp_extract(d, '^(\d+(?:\.\d+)?)m?(?:[A-Za-z]+)?$', 1), '') AS DOUBLE) AS number,
         CAST(nullif(regexp_extract(dw, '(?i)(?:^|[\dm])Depth=?(\d+(?:\.\d+)?)?m?$', 1), '') AS DOUBLE) AS depth,
         regexp_matches(dw, '(?i)(?:^|[\dm])Depth=?(\d+(?:\.\d+)?)?m?$') AS depth_word
  FROM (SELECT drawing, word_id, CASE WHEN word_id % 5 = 0 THEN 'CH-' || CAST(word_id % 200 AS VARCHAR) WHEN word_id % 5 = 1 THEN reverse('CH-' || CAST(word_id % 900 AS VARCHAR)) ELSE text END AS t,
          CASE WHEN word_id % 4 = 0 THEN '0.' || CAST(word_id % 90 AS VARCHAR) || 'mSTORM' ELSE text END AS d,
          CASE WHEN word_id % 4 = 1 THEN '0.36mDepth=1.' || CAST(word_id % 90 AS VARCHAR) || 'm' ELSE text END AS dw FROM words)""")
def _(spark, sf):
    i, w = C("word_id"), C("text")
    t = F.when(i % 5 == 0, F.concat(F.lit("CH-"), (i % 200).cast("string"))).when(i % 5 == 1, F.reverse(F.concat(F.lit("CH-"), (i % 900).cast("string")))).otherwise(w)
    d = F.when(i % 4 == 0, F.concat(F.lit("0."), (i % 90).cast("string"), F.lit("mSTORM"))).otherwise(w)
    dw = F.when(i % 4 == 1, F.concat(F.lit("0.36mDepth=1."), (i % 90).cast("string"), F.lit("m"))).otherwise(w)
    return V.words(spark, sf).select(
        "drawing", "word_id", text.tick_value(t).alias("tick"), text.is_tick_label(t).alias("is_tick"),
        text.number_value(d).alias("number"), text.depth_value(dw).alias("depth"), text.is_depth_word(dw).alias("depth_word"))


@query("X22_names_and_escapes", r"""
  SELECT page_id, string_split('Set' || CAST(page_id % 9 AS VARCHAR) || '_' || url, '_')[1] AS site,
    CASE WHEN page_id % 3 = 0 THEN replace('Road Rhs ' || url, 'Rhs', 'Lhs') WHEN page_id % 3 = 1 THEN replace('Road Lhs ' || url, 'Lhs', 'Rhs') END AS twin,
    replace(replace(replace(html, '&', '&amp;'), '>', '&gt;'), '<', '&lt;') AS xml,
    CASE WHEN page_id % 2 = 0 THEN '''=' || url ELSE url END AS cell,
    CASE page_id % 4 WHEN 0 THEN 'VENDOR_OFC_DUCT' WHEN 1 THEN 'CLAIM_CONFIRMED' WHEN 2 THEN 'TARGET_PICK' ELSE 'RADAR_LINE' END AS layer,
    CASE page_id % 4 WHEN 0 THEN 'OFC DUCT 1.50 m' WHEN 1 THEN 'pipe — confirmed' WHEN 2 THEN 'interpreter pick 7.5 m' ELSE url END AS name,
    'url: ' || url || chr(10) || 'depth: 1.5' AS description
  FROM pages""")
def _(spark, sf):
    i, url = C("page_id"), C("url")
    drawing = F.concat(F.when(i % 3 == 0, "Road Rhs ").when(i % 3 == 1, "Road Lhs ").otherwise("Road "), url)
    kind = F.when(i % 4 == 0, "vendor_callout").when(i % 4 == 1, "claim").when(i % 4 == 2, "target").otherwise("radar_line")
    origin, status = F.lit("interpreter pick"), F.lit("confirmed")
    return V.table(spark, sf, "pages").select(
        i, text.site_of(F.concat(F.lit("Set"), (i % 9).cast("string"), F.lit("_"), url)).alias("site"),
        text.opposite_side(drawing).alias("twin"), text.xml_text(C("html")).alias("xml"),
        text.spreadsheet_text(F.when(i % 2 == 0, F.concat(F.lit("="), url)).otherwise(url)).alias("cell"),
        text.layer_name(kind, F.lit("OFC DUCT"), status, origin).alias("layer"),
        text.display_name(kind, F.lit("OFC DUCT"), F.lit(1.5), F.lit("pipe"), status, url, origin, F.lit(7.5)).alias("name"),
        text.described({"url": url, "empty": F.lit(""), "depth": F.lit("1.5")}).alias("description"))


@query("X23_evidence_text", """
  SELECT finding_id, 'class: ' || class_name || chr(10) ||
    CASE WHEN depth_confidence = 'unavailable' THEN 'depth: unavailable' ELSE 'depth: ' || printf('%.2f', depth_m) || ' m (' || depth_confidence || ')' END || chr(10) ||
    CASE WHEN position_confidence = 'unavailable' THEN 'position: unavailable' ELSE 'position: ' || printf('%.2f', position_m) || ' m (' || position_confidence || ')' END AS block
  FROM (SELECT finding_id, class_name, depth_confidence, position_confidence, floor(depth_m + 0.5) AS depth_m, floor(position_m + 0.5) AS position_m FROM findings)""")
def _(spark, sf):
    f = V.findings(spark, sf).select("finding_id", "class_name", "depth_confidence", "position_confidence",
                                     F.floor(C("depth_m") + 0.5).cast("double").alias("depth_m"), F.floor(C("position_m") + 0.5).cast("double").alias("position_m"))
    return f.select("finding_id", F.concat_ws("\n", F.concat(F.lit("class: "), C("class_name")),
                    text.evidence_line("depth", C("depth_m"), "m", C("depth_confidence")),
                    text.evidence_line("position", C("position_m"), "m", C("position_confidence"))).alias("block"))


@query("X24_strict_response_parse", """
  SELECT finding_id, CASE finding_id % 4 WHEN 0 THEN 'pipe' WHEN 1 THEN '  ' WHEN 2 THEN 'pipe' END AS what,
    CASE finding_id % 4 WHEN 1 THEN 'missing or blank: what' WHEN 2 THEN 'missing or blank: how' WHEN 3 THEN 'not a JSON object' END AS error
  FROM findings""")
def _(spark, sf):
    i = C("finding_id")
    raw = F.when(i % 4 == 0, '{"what":"pipe","where":"line","why":"arch","how":"fit","recommended_action":"dig"}').when(
        i % 4 == 1, '{"what":"  ","where":"line","why":"arch","how":"fit","recommended_action":"dig"}').when(
        i % 4 == 2, '{"what":"pipe","where":"line","why":"arch","recommended_action":"dig"}').otherwise("not json")
    return V.findings(spark, sf).select(i, text.parse_response(raw).alias("r")).select("finding_id", C("r.parsed.what").alias("what"), C("r.error").alias("error"))


@query("X25_header_lookup", """
  SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 3 AS flagged,
         json_extract_string(props, '$.missing') AS missing FROM events""")
def _(spark, sf):
    header = F.from_json("props", "map<string,string>")
    return V.table(spark, sf, "events").select(
        "event_id", F.try_element_at(header, F.lit("k")).alias("k"),
        (F.get_json_object("props", "$.k").cast("int") % 10 == 3).alias("flagged"),
        F.try_element_at(header, F.lit("missing")).alias("missing"))


@query("X26_stable_split", """
  WITH h AS (SELECT o_orderkey, sha256('job' || CAST(o_orderkey AS VARCHAR)) AS d FROM orders),
  f AS (SELECT o_orderkey, list_reduce(list_transform(string_split(d, ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS INTEGER)),
          lambda a, b: (a * 16 + b) % 100) AS pct, d FROM h)
  SELECT o_orderkey, CAST(pct AS INTEGER) AS pct, CASE WHEN pct < 20 THEN 'val' ELSE 'train' END AS split,
         CAST('0x' || d[1:8] AS BIGINT) AS scene_rank FROM f""")
def _(spark, sf):
    job = F.concat(F.lit("job"), C("o_orderkey").cast("string"))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", text.hash_percent(job).alias("pct"), text.split_of(job).alias("split"),
        F.conv(F.substring(F.sha2(job, 256), 1, 8), 16, 10).cast("long").alias("scene_rank"))


@query("X27_request_fingerprint", """
  SELECT min(finding_id) AS first_finding, count(*) AS requests,
         sha256('{"class":"' || class_name || '","line":' || CAST(line_id AS VARCHAR) || '}') AS fingerprint
  FROM findings GROUP BY class_name, line_id""")
def _(spark, sf):
    f = V.findings(spark, sf).groupBy("class_name", "line_id").agg(F.min("finding_id").alias("first_finding"), F.count("*").alias("requests"))
    return f.select("first_finding", "requests", text.fingerprint({"class": C("class_name"), "line": C("line_id")}).alias("fingerprint"))


@query("X28_channel_and_member_arrays", """
  SELECT line_id, list_filter(['RAD', 'RA1', 'RA2'], lambda c: list_contains(cs, c)) AS channels, n_members,
         list_filter(rules, lambda r: r IS NOT NULL) AS rules FROM (
    SELECT line_id, list(DISTINCT channel) AS cs, count(*) AS n_members,
           [CASE WHEN max(strength) > 60 THEN 'strong' END, CASE WHEN count(DISTINCT channel) > 2 THEN 'all_channels' END] AS rules
    FROM channel_picks GROUP BY line_id)""")
def _(spark, sf):
    g = V.channel_picks(spark, sf).groupBy("line_id").agg(
        F.collect_set("channel").alias("cs"), F.count("*").alias("n_members"), F.max("strength").alias("s"))
    rules = F.array(F.when(C("s") > 60, "strong"), F.when(F.size("cs") > 2, "all_channels"))
    order = F.array(*[F.lit(c) for c in V.CHANNELS])  # shallow to deep
    return g.select("line_id", F.filter(order, lambda c: F.array_contains("cs", c)).alias("channels"), "n_members", F.array_compact(rules).alias("rules"))


@query("X29_age_windows", """
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 15 MINUTE AS recent,
         CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS INTEGER) AS age_days FROM events""")
def _(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        (C("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp") - F.expr("INTERVAL 15 MINUTES")).alias("recent"),
        F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("age_days"))


@query("X30_uncertainty_ring", """
  SELECT anchor_id, CAST(i AS INTEGER) AS step, round(lon + accuracy_m / (111320.0 * cos(radians(lat))) * cos(i * (2 * pi() / 48)), 9) AS lon,
         round(lat + accuracy_m / 111320.0 * sin(i * (2 * pi() / 48)), 9) AS lat FROM anchors, range(49) AS r(i)""")
def _(spark, sf):
    ring = V.anchors(spark, sf).select("anchor_id", F.posexplode(geo.circle_ring(C("lon"), C("lat"), C("accuracy_m"))).alias("step", "p"))
    return ring.select("anchor_id", "step", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query("X31_axis_calibration", """
  SELECT finding_id, round(0.5 + (x1 - 40.0) * (9.5 - 0.5) / (600.0 - 40.0), 6) + 0.0 AS along_m,
         round(0.0 + (y1 - 20.0) * (3.0 - 0.0) / (620.0 - 20.0), 6) + 0.0 AS depth_m FROM findings""")
def _(spark, sf):
    px = lambda c, *ticks: physics.axis_to_metres(C(c), *[F.lit(t) for t in ticks])
    return V.findings(spark, sf).select("finding_id", r6(px("x1", 40.0, 0.5, 600.0, 9.5), "along_m"), r6(px("y1", 20.0, 0.0, 620.0, 3.0), "depth_m"))


@query("X32_placed_positions", """
  SELECT apex_id, line_id, round(10.0 + position_m * 0.6, 6) AS east, round(20.0 + position_m * 0.8, 6) AS north,
         round((10.0 + position_m * 0.6) * 0.8 + (20.0 + position_m * 0.8) * 0.6, 6) AS along FROM apexes""")
def _(spark, sf):
    east = physics.placed_at(F.lit(10.0), C("position_m"), F.lit(0.6))
    north = physics.placed_at(F.lit(20.0), C("position_m"), F.lit(0.8))
    return V.apexes(spark, sf).select("apex_id", "line_id", r6(east, "east"), r6(north, "north"),
                                      r6(physics.along_axis(east, north, F.lit(0.8), F.lit(0.6)), "along"))


@query("X33_channel_description", """
  SELECT line_id, channel, n_traces, round((n_traces - 1) * spacing, 6) AS length_m, round(n_samples * dt, 6) AS window_ns,
         CASE WHEN header_dielectric >= 2.0 THEN round(0.2998 / sqrt(header_dielectric) * (n_samples * dt) / 2, 6) END AS max_depth_m FROM line_table""")
def _(spark, sf):
    return V.line_table(spark, sf).select(
        "line_id", "channel", "n_traces", r6(physics.line_length_m(C("n_traces"), C("spacing")), "length_m"),
        r6(C("n_samples") * C("dt"), "window_ns"),
        r6(physics.max_depth_m(C("n_samples"), C("dt"), physics.usable_dielectric(C("header_dielectric"))), "max_depth_m"))


@query("A29_sign_test", """
  WITH RECURSIVE c AS (SELECT line_id, CAST(count(*) FILTER (WHERE n_inliers > 12) AS INTEGER) AS better, CAST(count(*) FILTER (WHERE n_inliers <= 12) AS INTEGER) AS worse FROM fits GROUP BY line_id),
  t AS (SELECT line_id, better, worse, 0 AS i, pow(2.0, -(better + worse)) AS term, pow(2.0, -(better + worse)) AS total FROM c
        UNION ALL SELECT line_id, better, worse, i + 1, term * (better + worse - i) / (i + 1), total + term * (better + worse - i) / (i + 1) FROM t WHERE i < least(better, worse))
  SELECT line_id, CAST(better AS BIGINT) AS better, CAST(worse AS BIGINT) AS worse, round(least(1.0, 2 * total), 6) AS p FROM t WHERE i = least(better, worse)""")
def _(spark, sf):
    c = V.fits(spark, sf).groupBy("line_id").agg(F.count_if(C("n_inliers") > 12).alias("better"), F.count_if(C("n_inliers") <= 12).alias("worse"))
    return c.select("line_id", "better", "worse", r6(grading.sign_test_p(C("better"), C("worse")), "p"))


@query("F03_detection_sanitising", """
  SELECT finding_id FROM findings WHERE isfinite(x1) AND isfinite(y1) AND isfinite(x2) AND isfinite(y2)
    AND class_name IN ('cavities', 'clear_point_reflector', 'elongated_linear_target') AND x2 > x1 + 20 AND y2 > y1""")
def _(spark, sf):
    from strata.operators.quality import sane_detections

    f = V.findings(spark, sf).withColumn("x2", C("x2") - 20)
    return sane_detections(f, ("cavities", "clear_point_reflector", "elongated_linear_target")).select("finding_id")


@query("F04_fit_credibility", """
  SELECT fit_id, line_id, CASE WHEN velocity <= 0 OR velocity > 0.2998 THEN 'faster_than_light' WHEN apex_time_ns < 3.07 THEN 'direct_wave'
    WHEN apex_sample > 0.9 * n_samples THEN 'record_end' WHEN n_inliers < 8 THEN 'few_inliers' WHEN pow(0.2998 / velocity, 2) >= 90 THEN 'implausible_permittivity' END AS reason FROM fits""")
def _(spark, sf):
    eps = physics.dielectric_from_velocity(C("velocity"))
    return V.fits(spark, sf).select("fit_id", "line_id", physics.fit_rejection(
        C("velocity"), C("apex_time_ns"), C("apex_sample"), C("n_inliers"), eps, C("n_samples")).alias("reason"))


@query("F09_line_dielectric", """
  SELECT line_id, CASE WHEN count(u) = count(*) AND min(u) = max(u) THEN min(u) END AS dielectric
  FROM (SELECT line_id, CASE WHEN header_dielectric >= 2.0 THEN header_dielectric END AS u FROM line_table) GROUP BY line_id""")
def _(spark, sf):
    from strata.operators.quality import line_dielectric

    return line_dielectric(V.line_table(spark, sf), "header_dielectric")


@query("F10_line_end_filter", """
  SELECT pick_id, line_id FROM channel_picks WHERE sample * 0.2 - 1.6 > 0 AND trace >= 0.3 / 0.025 AND trace <= 40 - 1 - 0.3 / 0.025""")
def _(spark, sf):
    return V.channel_picks(spark, sf).filter(
        physics.away_from_ends(C("sample") * 0.2 - 1.6, C("trace"), F.lit(40), F.lit(0.025))).select("pick_id", "line_id")


@query("F11_near_surface_flag", "SELECT pick_id, line_id, sample * 0.2 - 1.6 < 1.5 AS near_surface FROM channel_picks")
def _(spark, sf):
    return V.channel_picks(spark, sf).select("pick_id", "line_id", physics.near_surface(C("sample") * 0.2 - 1.6).alias("near_surface"))


@query("F13_numeric_cell", r"""
  SELECT drawing, word_id, TRY_CAST(t AS DOUBLE) AS value FROM
    (SELECT drawing, word_id, CASE WHEN word_id % 3 = 0 THEN CAST(word_id % 70 AS VARCHAR) || '.5' ELSE text END AS t FROM words)
  WHERE regexp_matches(t, '^[0-9]+([.][0-9]+)?$') AND TRY_CAST(t AS DOUBLE) > 0 AND TRY_CAST(t AS DOUBLE) < 5""")
def _(spark, sf):
    from strata.operators.quality import numeric_cells

    t = F.when(C("word_id") % 3 == 0, F.concat((C("word_id") % 70).cast("string"), F.lit(".5"))).otherwise(C("text"))
    return numeric_cells(V.words(spark, sf).select("drawing", "word_id", t.alias("text")))
