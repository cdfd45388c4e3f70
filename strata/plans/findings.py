"""Queries over findings, labels, picks and sign-in events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata import params as P
from strata.operators import findings as O
from strata.operators import quality as Q
from strata.operators import signin
from strata.operators.bands import band_join
from strata.operators.quantiles import group_quantiles
from strata.plans import views as V
from strata.plans.registry import query

C = F.col
_WEIGHTS = "CASE class_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.RISK_WEIGHTS.items()) + " ELSE 0.2 END"
_RISK = f"""risk AS (SELECT *, CASE WHEN len(rules) > 0 THEN 'HIGH' WHEN score < 0.35 THEN 'LOW' WHEN score < 0.65 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (
  SELECT frame_id, avg({_WEIGHTS} * confidence) AS score,
    list_filter([CASE WHEN bool_or(class_name = 'cavities') AND bool_or(class_name IN ('elongated_linear_target', 'intersecting_linear_and_point_reflector')) THEN 'cavities_with_utility' END,
      CASE WHEN count(*) FILTER (WHERE class_name = 'elongated_linear_target' AND confidence > 0.8) >= 2 THEN 'multiple_high_confidence_elongated' END], lambda r: r IS NOT NULL) AS rules
  FROM findings GROUP BY frame_id))"""
_WITH_LEVEL = f"WITH {_RISK}, fl AS (SELECT f.*, r.level AS risk_level FROM findings f JOIN risk r USING (frame_id))"


def with_level(spark, sf):
    f = V.findings(spark, sf)
    risk = O.risk_by_frame(f).select("frame_id", C("level").alias("risk_level"))
    return f.join(risk, "frame_id")


@query("A01_A02_risk_by_frame", f"WITH {_RISK} SELECT frame_id, round(score, 10) AS score, level, rules FROM risk")
def _(spark, sf):
    return O.risk_by_frame(V.findings(spark, sf)).withColumn("score", F.round("score", 10))


@query("A03_survey_summary", _WITH_LEVEL + """
  SELECT survey_id, 'total' AS kind, 'all' AS value, count(*) AS n FROM fl GROUP BY survey_id
  UNION ALL SELECT survey_id, 'risk', risk_level, count(*) FROM fl GROUP BY ALL
  UNION ALL SELECT survey_id, 'class', class_name, count(*) FROM fl GROUP BY ALL""")
def _(spark, sf):
    return O.survey_summary(with_level(spark, sf))


@query("A04_confidence_breakdown", """
  SELECT survey_id, field, count(*) FILTER (WHERE label = 'calibrated') AS calibrated, count(*) FILTER (WHERE label = 'estimated') AS estimated,
    count(*) FILTER (WHERE label = 'unavailable') AS unavailable FROM (
    SELECT survey_id, 'depth' AS field, depth_confidence AS label FROM findings UNION ALL SELECT survey_id, 'position', position_confidence FROM findings)
  GROUP BY survey_id, field""")
def _(spark, sf):
    return O.confidence_breakdown(V.findings(spark, sf))


@query("A05_line_history_by_risk", _WITH_LEVEL + """
  SELECT line_id, count(*) FILTER (WHERE risk_level = 'HIGH') AS high, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium,
    count(*) FILTER (WHERE risk_level = 'LOW') AS low FROM fl GROUP BY line_id""")
def _(spark, sf):
    return O.history_by_risk(with_level(spark, sf))


@query("A06_vendor_depth_priors", """
  SELECT utility, count(*) AS n, round(quantile_cont(depth_m, 0.5), 6) AS median_m, round(quantile_cont(depth_m, 0.1), 6) AS p10_m,
    round(quantile_cont(depth_m, 0.9), 6) AS p90_m FROM callouts WHERE read_by = 'text' AND depth_m IS NOT NULL GROUP BY utility""")
def _(spark, sf):
    c = V.callouts(spark, sf).filter((C("read_by") == "text") & C("depth_m").isNotNull())
    q = group_quantiles(c, ["utility"], "depth_m", {"median_m": 0.5, "p10_m": 0.1, "p90_m": 0.9})
    n = c.groupBy("utility").agg(F.count("*").alias("n"))
    return n.join(q, "utility").select("utility", "n", *[F.round(c_, 6).alias(c_) for c_ in ("median_m", "p10_m", "p90_m")])


@query("A07_drawing_counters", """
  WITH s AS (SELECT *, CASE WHEN depth_m IS NULL THEN 'depth_unread' WHEN depth_m * 1.3 >= safe_path_m THEN 'reaches_safe_path' ELSE 'clear' END AS status FROM callouts)
  SELECT 'read_by' AS counter, read_by AS value, count(*) AS n FROM s GROUP BY read_by UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY status
  UNION ALL SELECT 'utility', utility, count(*) FROM s GROUP BY utility""")
def _(spark, sf):
    from strata.operators.drawings import drawing_counters

    return drawing_counters(V.callouts(spark, sf))


@query("A08_failures_in_window", """
  SELECT username, ip, count(*) AS pair_failures, max(by_name) AS name_failures FROM (
    SELECT lower(username) AS username, ip, count(*) OVER (PARTITION BY lower(username)) AS by_name FROM login_events
    WHERE event = 'login_failed' AND signed_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAY AND signed_at <= TIMESTAMP '2024-01-20 00:00:00')
  GROUP BY username, ip""")
def _(spark, sf):
    until = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return signin.failures_since(V.login_events(spark, sf), until - F.expr("INTERVAL 3 DAYS"), until)


@query("A09_last_login", """
  SELECT lower(username) AS username, max(signed_at) FILTER (WHERE event = 'login') AS last_login, count(*) AS events FROM login_events GROUP BY lower(username)""")
def _(spark, sf):
    return signin.accounts(V.login_events(spark, sf))


@query("A10_label_progress", """
  SELECT decision, count(*) AS n FROM (SELECT arg_max(decision, (decided_at, label_id)) AS decision FROM label_events GROUP BY job, trace, round(time_ns, 3)) GROUP BY decision""")
def _(spark, sf):
    e = V.label_events(spark, sf).withColumn("time_key", F.round("time_ns", 3))
    return O.latest_per_key(e, ["job", "trace", "time_key"], ["decided_at", "label_id"]).groupBy("decision").agg(F.count("*").alias("n"))


@query("W05_latest_label", """
  SELECT job, trace, arg_max(decision, (decided_at, label_id)) AS decision, arg_max(user_id, (decided_at, label_id)) AS user_id, max((decided_at, label_id)).label_id AS label_id
  FROM (SELECT job, trace, decision, user_id, decided_at, label_id FROM label_events) GROUP BY job, trace""".replace("max((decided_at, label_id)).label_id", "arg_max(label_id, (decided_at, label_id))"))
def _(spark, sf):
    return O.latest_per_key(V.label_events(spark, sf), ["job", "trace"], ["decided_at", "label_id"]).select("job", "trace", "decision", "user_id", "label_id")


@query("F01_findings_of_a_line", """
  SELECT finding_id, survey_id, line_id, class_name, round(confidence, 6) AS confidence FROM findings WHERE line_id = 7 ORDER BY finding_id""")
def _(spark, sf):
    return V.findings(spark, sf).filter(C("line_id") == 7).orderBy("finding_id").select(
        "finding_id", "survey_id", "line_id", "class_name", F.round("confidence", 6).alias("confidence"))


@query("F02_survey_exists", """
  SELECT survey_id, survey_id IN (SELECT survey_id FROM findings) AS present FROM
    (SELECT DISTINCT strftime(o_orderdate + INTERVAL 9000 DAY, '%Y-%m-%d') AS survey_id FROM orders UNION SELECT DISTINCT survey_id FROM findings)""".replace("9000", "9300"))
def _(spark, sf):
    frames = V.findings(spark, sf).select("survey_id").distinct()
    asked = V.table(spark, sf, "orders").select(F.date_format(C("o_orderdate") + F.expr("INTERVAL 9300 DAYS"), "yyyy-MM-dd").alias("survey_id"))
    asked = asked.union(frames).distinct()
    return asked.join(frames.withColumn("here", F.lit(True)), "survey_id", "left").select("survey_id", F.coalesce("here", F.lit(False)).alias("present"))


@query("F05_quarantine_findings", """
  SELECT finding_id, CASE WHEN (depth_m IS NULL) <> (depth_confidence = 'unavailable') THEN 'depth value and label disagree'
    WHEN confidence < 0 OR confidence > 1 THEN 'confidence outside 0..1' WHEN finding_id % 19 < 1 THEN 'no corroborating channel' END AS reason
  FROM (SELECT finding_id, confidence, depth_confidence, CASE WHEN finding_id % 17 = 0 THEN NULL ELSE depth_m END AS depth_m FROM findings)
  WHERE reason IS NOT NULL""")
def _(spark, sf):
    f = V.findings(spark, sf).withColumn("depth_m", F.when(C("finding_id") % 17 != 0, C("depth_m"))).withColumn("corroborating_channels", C("finding_id") % 19)
    return Q.split_valid(f, Q.finding_rules())[1].select("finding_id", "reason")


@query("F06_anchor_checks", """
  SELECT line_id, count(*) AS n_points, CASE WHEN count(*) < 2 THEN 'fewer than two reference points' WHEN min(r) IS NOT NULL THEN min(r)
    WHEN count(DISTINCT chainage_m) < count(*) THEN 'two reference points share a chainage' END AS reason FROM (
    SELECT *, CASE WHEN lat < -90 OR lat > 90 THEN 'latitude or longitude out of range' WHEN chainage_m < -1 OR chainage_m > 2401 THEN 'chainage off the line'
      WHEN accuracy_m <= 0 OR accuracy_m > 100 THEN 'accuracy out of range' WHEN length(trim(source)) NOT BETWEEN 1 AND 200 THEN 'source missing or too long' END AS r FROM anchors)
  GROUP BY line_id""")
def _(spark, sf):
    return Q.check_anchor_sets(V.anchors(spark, sf), F.lit(2400.0))


@query("F07_pick_rules", """
  SELECT fit_id, line_id, CASE WHEN n_inliers % 4 = 0 THEN 'unknown velocity source' WHEN velocity - 0.1 <= 0 THEN 'velocity not positive'
    WHEN (n_inliers % 5 = 0) <> (n_inliers % 2 = 0) THEN 'fit quality only with a fit' END AS reason FROM fits""")
def _(spark, sf):
    i = C("n_inliers")
    f = V.fits(spark, sf).select("fit_id", "line_id", F.when(i % 4 == 0, "guess").when(i % 2 == 0, "fitted").otherwise("manual").alias("velocity_source"),
                                 (C("velocity") - 0.1).alias("velocity_m_per_ns"), F.when(i % 5 == 0, 0.9).alias("fit_r2"))
    return f.select("fit_id", "line_id", Q.first_reason(Q.pick_rules()).alias("reason"))


@query("F08_field_report_rules", """
  SELECT review_id, CASE WHEN status = 'proposed' THEN 'unknown outcome' WHEN target_id % 3 = 2 THEN 'item of another job' WHEN reviewer = 'system' THEN 'no reporter'
    WHEN decided_at > 9 THEN 'depth out of range' END AS reason FROM reviews""")
def _(spark, sf):
    r = V.reviews(spark, sf)
    job = F.when(C("target_id") % 3 == 2, C("job") + 1).otherwise(C("job"))
    r = r.select(
        "review_id", "job", F.when(C("status") == "proposed", "maybe").otherwise("found").alias("outcome"),
        F.concat(job.cast("string"), F.lit("#"), C("target_id").cast("string")).alias("item_id"),
        F.when(C("reviewer") == "system", " ").otherwise(C("reviewer")).alias("reporter"), F.lit("ok").alias("note"),
        F.lit(12.9).alias("lat"), F.lit(77.5).alias("lon"), F.lit(0.5).alias("accuracy_m"),
        F.when(C("decided_at") > 9, 99.0).otherwise(1.0).alias("depth_found_m"))
    return r.select("review_id", Q.first_reason(Q.field_report_rules()).alias("reason"))


@query("F12_held_out_sites", """
  SELECT o_orderkey FROM orders WHERE 'Set' || CAST(o_custkey % 9 AS VARCHAR) NOT IN ('Set3', 'Set4', 'Set5')""")
def _(spark, sf):
    site = F.concat(F.lit("Set"), (C("o_custkey") % 9).cast("string"))
    return Q.held_out(V.table(spark, sf, "orders"), site).select("o_orderkey")


@query("F15_whole_line_check", """
  WITH bad AS (SELECT line_id, channel FROM samples GROUP BY line_id, channel
    HAVING count(*) FILTER (WHERE line_id % 3 = 1 AND trace = 5 AND sample = 7) > 0)
  SELECT line_id, channel, count(*) AS n FROM samples s WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.line_id = s.line_id AND b.channel = s.channel) GROUP BY line_id, channel""")
def _(spark, sf):
    dropout = (C("line_id") % 3 == 1) & (C("trace") == 5) & (C("sample") == 7)
    s = V.samples(spark, sf).withColumn("amp", F.when(dropout, float("nan")).otherwise(C("amp")))
    return Q.refuse_broken_lines(s).groupBy("line_id", "channel").agg(F.count("*").alias("n"))


@query("F16_line_stretch", """
  SELECT line_id, channel, trace, sample, amp FROM samples WHERE trace * 0.025 >= 0.25 AND trace * 0.025 < 0.5""")
def _(spark, sf):
    # The stretch is a filter on the trace column, applied before the samples are unpacked.
    t = V.traces(spark, sf).filter((C("trace") * 0.025 >= 0.25) & (C("trace") * 0.025 < 0.5))
    return t.select("line_id", "channel", "trace", F.posexplode("samples").alias("sample", "amp"))


@query("F17_lines_of_a_site", "SELECT drawing, count(*) AS n FROM callouts WHERE CAST(drawing % 50 AS VARCHAR) = '7' GROUP BY drawing")
def _(spark, sf):
    from strata.functions.text import site_of

    c = V.callouts(spark, sf).withColumn("job_name", F.concat((C("drawing") % 50).cast("string"), F.lit("_"), C("drawing").cast("string")))
    return c.filter(site_of(C("job_name")) == "7").groupBy("drawing").agg(F.count("*").alias("n"))


@query("A32_sites_list", """
  SELECT o_custkey % 50 AS site, count(DISTINCT o_custkey) AS lines, count(DISTINCT o_custkey) >= 2 AS mappable FROM orders GROUP BY o_custkey % 50""")
def _(spark, sf):
    from strata.functions.text import site_of

    o = V.table(spark, sf, "orders").select(F.concat((C("o_custkey") % 50).cast("string"), F.lit("_"), C("o_custkey").cast("string")).alias("job")).distinct()
    g = o.groupBy(site_of(C("job")).cast("long").alias("site")).agg(F.count("*").alias("lines"))
    return g.withColumn("mappable", C("lines") >= 2)


@query("J01_prior_pass_counts", """
  WITH f AS (SELECT line_id, position_m, confidence FROM findings WHERE position_m IS NOT NULL), p AS (SELECT DISTINCT line_id, position_m FROM f)
  SELECT p.line_id, p.position_m, count(*) AS n_passes, round(max(confidence), 6) AS best_confidence FROM p JOIN f ON p.line_id = f.line_id AND abs(f.position_m - p.position_m) <= 0.51
  GROUP BY p.line_id, p.position_m""")
def _(spark, sf):
    return O.prior_pass_counts(V.findings(spark, sf), 0.51).withColumn("best_confidence", F.round("best_confidence", 6))


@query("J01_prior_passes_of_a_frame", """
  SELECT p.line_id, p.finding_id AS probe_id, f.finding_id, f.class_name FROM (SELECT line_id, finding_id, position_m FROM findings WHERE class_name = 'cavities' AND confidence > 0.9) p
  JOIN findings f ON f.line_id = p.line_id AND abs(f.position_m - p.position_m) <= 0.51""")
def _(spark, sf):
    f = V.findings(spark, sf)
    probes = f.filter((C("class_name") == "cavities") & (C("confidence") > 0.9)).select("line_id", C("finding_id").alias("probe_id"), C("position_m").alias("probe_position_m"))
    return O.prior_passes(f, probes, 0.51).select("line_id", "probe_id", "finding_id", "class_name")


@query("J02_candidates_with_diagnosis", """
  SELECT p.pick_id, p.line_id, p.strength, f.n_inliers FROM channel_picks p LEFT JOIN (SELECT fit_id, line_id, max(n_inliers) AS n_inliers FROM fits WHERE n_inliers > 6 GROUP BY ALL) f ON f.fit_id = p.pick_id AND f.line_id = p.line_id""")
def _(spark, sf):
    fits = V.fits(spark, sf).filter(C("n_inliers") > 6).groupBy("fit_id", "line_id").agg(F.max("n_inliers").alias("n_inliers"))
    p = V.channel_picks(spark, sf)
    return p.join(fits.withColumnRenamed("fit_id", "pick_id"), ["pick_id", "line_id"], "left").select("pick_id", "line_id", "strength", "n_inliers")


@query("J03_label_user_names", """
  SELECT job, trace, label_id, s_name AS username FROM label_events JOIN supplier ON user_id = s_suppkey""")
def _(spark, sf):
    s = V.table(spark, sf, "supplier").select(C("s_suppkey").alias("user_id"), C("s_name").alias("username"))
    return V.label_events(spark, sf).join(s, "user_id").select("job", "trace", "label_id", "username")


@query("J04_queue_with_decisions", """
  WITH l AS (SELECT job, trace, round(time_ns, 3) AS k, arg_max(decision, (decided_at, label_id)) AS decision FROM label_events GROUP BY job, trace, round(time_ns, 3))
  SELECT q.line_id, q.trace, q.n_picks, l.decision FROM (SELECT line_id, trace % 8 AS trace, count(*) AS n_picks FROM channel_picks GROUP BY ALL) q
  LEFT JOIN l ON l.job = q.line_id AND l.trace = q.trace AND l.k = round(q.trace * 0.4, 3)""")
def _(spark, sf):
    e = V.label_events(spark, sf).withColumn("k", F.round("time_ns", 3))
    latest = O.latest_per_key(e, ["job", "trace", "k"], ["decided_at", "label_id"]).select(C("job").alias("line_id"), "trace", "k", "decision")
    q = V.channel_picks(spark, sf).groupBy("line_id", (C("trace") % 8).alias("trace")).agg(F.count("*").alias("n_picks"))
    return q.withColumn("k", F.round(C("trace") * 0.4, 3)).join(latest, ["line_id", "trace", "k"], "left").select("line_id", "trace", "n_picks", "decision")


_LIVE = """live AS (SELECT line_id, apex_id AS id, CAST(floor(position_m / 0.025) AS INTEGER) AS trace_start, CAST(floor(position_m / 0.025) AS INTEGER) + 5 + n_inliers % 9 AS trace_end,
    CAST(floor(depth_m * 50) AS INTEGER) AS sample_start, CAST(floor(depth_m * 50) AS INTEGER) + 12 AS sample_end FROM apexes WHERE channel <> 'RA2'),
  batch AS (SELECT line_id, apex_id AS id, CAST(floor(position_m / 0.025) AS INTEGER) + 1 AS trace_start, CAST(floor(position_m / 0.025) AS INTEGER) + 9 AS trace_end,
    CAST(floor(depth_m * 50) AS INTEGER) + 3 AS sample_start, CAST(floor(depth_m * 50) AS INTEGER) + 20 AS sample_end FROM apexes WHERE channel <> 'RAD')"""
_SAME = """b.line_id = a.line_id AND least(a.sample_end, b.sample_end) - greatest(a.sample_start, b.sample_start) > 0
    AND least(a.trace_end, b.trace_end) - greatest(a.trace_start, b.trace_start) >= 0.5 * least(a.trace_end - a.trace_start, b.trace_end - b.trace_start)"""


def _live_batch(spark, sf):
    a = V.apexes(spark, sf)
    t, s = F.floor(C("position_m") / 0.025).cast("int"), F.floor(C("depth_m") * 50).cast("int")
    live = a.filter(C("channel") != "RA2").select("line_id", C("apex_id").alias("id"), t.alias("trace_start"), (t + 5 + C("n_inliers") % 9).alias("trace_end"), s.alias("sample_start"), (s + 12).alias("sample_end"))
    batch = a.filter(C("channel") != "RAD").select("line_id", C("apex_id").alias("id"), (t + 1).alias("trace_start"), (t + 9).alias("trace_end"), (s + 3).alias("sample_start"), (s + 20).alias("sample_end"))
    return live, batch


@query("J05_same_target_pairs", f"WITH {_LIVE} SELECT a.line_id, a.id, b.id AS r_id, a.trace_start, b.trace_start AS r_trace_start FROM live a JOIN batch b ON {_SAME}")
def _(spark, sf):
    live, batch = _live_batch(spark, sf)
    return O.match_boxes(live, batch, "inner").select("line_id", "id", "r_id", "trace_start", "r_trace_start")


@query("J06_live_vs_batch", f"""WITH {_LIVE} SELECT 'matched' AS outcome, count(*) AS n FROM batch a WHERE EXISTS (SELECT 1 FROM live b WHERE {_SAME})
  UNION ALL SELECT 'missed', count(*) FROM batch a WHERE NOT EXISTS (SELECT 1 FROM live b WHERE {_SAME})
  UNION ALL SELECT 'extra', count(*) FROM live a WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE {_SAME})""".replace("FROM batch a", "FROM (SELECT DISTINCT * FROM batch) a").replace("FROM live a", "FROM (SELECT DISTINCT * FROM live) a"))
def _(spark, sf):
    live, batch = _live_batch(spark, sf)
    count = lambda name, df: df.agg(F.lit(name).alias("outcome"), F.count("*").alias("n"))
    return count("matched", O.match_boxes(batch, live, "left_semi")).unionByName(
        count("missed", O.match_boxes(batch, live, "left_anti"))).unionByName(count("extra", O.match_boxes(live, batch, "left_anti")))


@query("J07_point_on_linear", """
  SELECT detection_id, frame_id FROM shape_detections p WHERE shape = 'point_reflector' AND EXISTS (SELECT 1 FROM shape_detections l WHERE l.frame_id = p.frame_id
    AND l.shape = 'linear_reflector' AND p.x1 < l.x2 AND l.x1 < p.x2 AND p.y1 < l.y2 AND l.y1 < p.y2)""")
def _(spark, sf):
    d = V.shape_detections(spark, sf)
    return O.box_overlap_flags(d.filter(C("shape") == "point_reflector"), d.filter(C("shape") == "linear_reflector")).select("detection_id", "frame_id")


@query("J08_neighbour_classes", """
  SELECT a.finding_id, CAST(count(b.finding_id) AS BIGINT) AS n_neighbours, count(*) FILTER (WHERE b.class_name = 'cavities') AS n_cavities
  FROM findings a LEFT JOIN findings b ON a.frame_id = b.frame_id AND a.finding_id <> b.finding_id GROUP BY a.finding_id""")
def _(spark, sf):
    f = O.with_neighbour_classes(V.findings(spark, sf))
    total = F.aggregate(F.map_values("neighbours"), F.lit(0).cast("long"), lambda a, b: a + b)
    return f.select("finding_id", total.alias("n_neighbours"), F.coalesce(F.try_element_at("neighbours", F.lit("cavities")), F.lit(0)).cast("long").alias("n_cavities"))


@query("J09_chebyshev_neighbours", """
  SELECT a.line_id, a.apex_id, count(*) AS n FROM apexes a JOIN apexes b ON a.line_id = b.line_id AND abs(a.position_m - b.position_m) <= 0.3 AND abs(a.depth_m - b.depth_m) <= 0.35 GROUP BY a.line_id, a.apex_id""")
def _(spark, sf):
    from strata.operators.corroborate import neighbour_counts

    return neighbour_counts(V.apexes(spark, sf)).groupBy("line_id", "apex_id").agg(F.sum(C("n")).alias("n"))


@query("J18_tag_hits", """
  SELECT DISTINCT t.line_id, t.apex_id FROM apexes t WHERE channel = 'RAD' AND EXISTS (SELECT 1 FROM channel_picks p WHERE p.line_id = t.line_id AND abs(p.trace * 0.025 - t.position_m) <= 0.3 AND abs(p.sample * 0.2 - t.depth_m * 3) <= 1.5)""")
def _(spark, sf):
    tags = V.apexes(spark, sf).filter(C("channel") == "RAD").select("line_id", "apex_id", "position_m", (C("depth_m") * 3).alias("time_ns"))
    picks = V.channel_picks(spark, sf).select("line_id", (C("trace") * 0.025).alias("p_position"), (C("sample") * 0.2).alias("p_time"))
    return band_join(tags, picks, ["line_id"], [("position_m", "p_position", 0.3), ("time_ns", "p_time", 1.5)], "left_semi").select("line_id", "apex_id").distinct()


@query("W04_adjacent_differences", """
  SELECT line_id, channel, trace, sample, round(amp - lag(amp) OVER (PARTITION BY line_id, channel, sample ORDER BY trace), 6) + 0.0 AS step FROM samples""")
def _(spark, sf):
    from strata.operators.lines import trace_differences

    d = trace_differences(V.traces(spark, sf))
    return d.select("line_id", "channel", "trace", F.posexplode("samples").alias("sample", "v")).select("line_id", "channel", "trace", "sample", F.round("v", 6).alias("step"))


@query("W07_W08_regular_rows_and_crowds", """
  WITH p AS (SELECT detection_id, frame_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM shape_detections WHERE shape = 'point_reflector'),
  g AS (SELECT *, x - lag(x) OVER (PARTITION BY frame_id ORDER BY x, detection_id) AS gap FROM p),
  r AS (SELECT frame_id, count(*) >= 3 AND coalesce(avg(gap) > 0 AND stddev_pop(gap) / avg(gap) < 0.25 AND (max(y) - min(y)) / 640 < 0.1, false) AS regular FROM g GROUP BY frame_id)
  SELECT detection_id, regular, (SELECT count(*) - 1 FROM p q WHERE q.frame_id = p.frame_id AND abs(q.x - p.x) <= 96.0) >= 2 AS crowded FROM p JOIN r USING (frame_id)""")
def _(spark, sf):
    from strata.operators.refine import crowded_points, regular_rows

    p = V.shape_detections(spark, sf).filter(C("shape") == "point_reflector")
    return crowded_points(p, 640.0).join(regular_rows(p, 640.0), "frame_id").select("detection_id", "regular", "crowded")


@query("W09_line_labels", """
  SELECT pick_id, line_id, trace, strength, CASE channel WHEN 'RAD' THEN 'P' ELSE 'C' END || CAST(row_number() OVER (PARTITION BY line_id, channel = 'RAD' ORDER BY trace, pick_id, strength) AS VARCHAR) AS label FROM channel_picks""")
def _(spark, sf):
    p = V.channel_picks(spark, sf).withColumn("kind", F.when(C("channel") == "RAD", "P").otherwise("C"))
    from strata.operators.bands import ordinal

    r = ordinal(p, ["line_id", "kind"], ["trace", "pick_id", "strength"], 1024.0)
    return r.select("pick_id", "line_id", "trace", "strength", F.concat("kind", C("rank").cast("string")).alias("label"))


@query("K01_top_picks", """
  SELECT line_id, pick_id, strength, rank FROM (SELECT line_id, pick_id, strength, CAST(row_number() OVER (PARTITION BY line_id ORDER BY strength DESC, pick_id) AS INTEGER) AS rank FROM channel_picks) WHERE rank <= 5""")
def _(spark, sf):
    return O.top_k(V.channel_picks(spark, sf), ["line_id"], [F.desc("strength"), F.asc("pick_id")], 5).select("line_id", "pick_id", "strength", "rank")


@query("K05_findings_by_risk", _WITH_LEVEL + """
  SELECT finding_id, risk_level, CASE risk_level WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS priority FROM fl ORDER BY priority, finding_id""")
def _(spark, sf):
    p = F.when(C("risk_level") == "HIGH", 0).when(C("risk_level") == "MEDIUM", 1).otherwise(2)
    return with_level(spark, sf).select("finding_id", "risk_level", p.alias("priority")).orderBy("priority", "finding_id")


@query("K08_signin_history", "SELECT event_id, signed_at, username, event FROM login_events ORDER BY signed_at DESC, event_id DESC LIMIT 200")
def _(spark, sf):
    return signin.history(V.login_events(spark, sf), 200).select("event_id", "signed_at", "username", "event")


@query("U01_targets_of_a_line", """
  SELECT line_id, pick_id AS target_id, 'candidate' AS origin, strength, CAST(NULL AS VARCHAR) AS identity FROM channel_picks
  UNION ALL SELECT line_id, fit_id, 'pick', CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM fits WHERE n_inliers > 15
  UNION ALL SELECT job, review_id, 'claim', CAST(NULL AS DOUBLE), trim(identity) FROM reviews WHERE status <> 'rejected'""")
def _(spark, sf):
    c = V.channel_picks(spark, sf).select("line_id", C("pick_id").alias("target_id"), F.lit("candidate").alias("origin"), "strength")
    p = V.fits(spark, sf).filter(C("n_inliers") > 15).select("line_id", C("fit_id").alias("target_id"), F.lit("pick").alias("origin"))
    r = V.reviews(spark, sf).filter(C("status") != "rejected").select(C("job").alias("line_id"), C("review_id").alias("target_id"), F.lit("claim").alias("origin"), F.trim("identity").alias("identity"))
    return c.unionByName(p, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)


@query("U05_class_intersection", """
  SELECT frame_id, list_has_any(list(DISTINCT class_name), ['elongated_linear_target', 'intersecting_linear_and_point_reflector']) AS touches FROM findings GROUP BY frame_id""")
def _(spark, sf):
    g = V.findings(spark, sf).groupBy("frame_id").agg(F.collect_set("class_name").alias("classes"))
    return g.select("frame_id", F.arrays_overlap("classes", F.array(*[F.lit(c) for c in P.UTILITY_CLASSES])).alias("touches"))


@query("C15_replace_detector_rows", """
  SELECT job, id, detector, note FROM (SELECT line_id AS job, pick_id AS id, CASE pick_id % 3 WHEN 0 THEN 'energy' WHEN 1 THEN 'migration' END AS detector,
      CASE WHEN pick_id % 2 = 0 THEN 'auto: seen' ELSE 'by hand' END AS note FROM channel_picks)
    WHERE NOT (job % 2 = 0 AND (coalesce(detector = 'migration', false) OR (detector IS NULL AND note LIKE 'auto:%')))
  UNION ALL SELECT line_id, fit_id, 'migration', 'auto: new' FROM fits WHERE line_id % 4 = 0""")
def _(spark, sf):
    i = C("pick_id")
    p = V.channel_picks(spark, sf)
    stored = p.select(C("line_id").alias("job"), i.alias("id"), F.when(i % 3 == 0, "energy").when(i % 3 == 1, "migration").alias("detector"),
                      F.when(i % 2 == 0, "auto: seen").otherwise("by hand").alias("note"))
    runs = p.filter(C("line_id") % 2 == 0).select(C("line_id").alias("job"))
    fresh = V.fits(spark, sf).filter(C("line_id") % 4 == 0).select(C("line_id").alias("job"), C("fit_id").alias("id"), F.lit("auto: new").alias("note"))
    return O.replace_detector_rows(stored, fresh, runs, "migration", "v1").select("job", "id", "detector", "note")


@query("C21_human_record_events", """
  SELECT job, trace, decision FROM (SELECT job, trace, arg_max(action, (seq)) AS action, arg_max(decision, (seq)) AS decision FROM (
    SELECT job, trace, decision, label_id AS seq, CASE WHEN label_id % 3 = 0 THEN 'delete' ELSE 'add' END AS action FROM label_events) GROUP BY job, trace) WHERE action = 'add'""")
def _(spark, sf):
    e = V.label_events(spark, sf).select(F.concat_ws("#", "job", "trace").alias("key"), "job", "trace", "decision", C("label_id").alias("seq"),
                                         F.when(C("label_id") % 3 == 0, "delete").otherwise("add").alias("action"))
    empty = e.filter(F.lit(False)).drop("seq", "action")
    return O.apply_events(empty, e, "key", ["seq"]).select("job", "trace", "decision")


@query("C22_run_once_guard", """
  SELECT line_id, channel, n_traces FROM line_table l WHERE NOT EXISTS (SELECT 1 FROM channel_picks p WHERE p.line_id % 7 = l.line_id AND p.channel = l.channel AND p.sample > 29 AND p.trace > 38 AND p.strength > 95)""")
def _(spark, sf):
    runs = V.channel_picks(spark, sf).filter((C("sample") > 29) & (C("trace") > 38) & (C("strength") > 95)).select((C("line_id") % 7).alias("line_id"), "channel").distinct()
    runs = runs.withColumn("detector", F.lit("migration")).withColumn("detector_version", F.lit("v1"))
    return O.not_yet_run(V.line_table(spark, sf), runs, "migration", "v1").select("line_id", "channel", "n_traces")


@query("C13_C14_versioned_findings", """
  SELECT finding_id, CASE WHEN finding_id % 5 = 0 THEN 'explained ' || class_name ELSE NULL END AS what, CASE WHEN finding_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM findings""")
def _(spark, sf):
    f = V.findings(spark, sf).select("finding_id", "class_name", F.lit(None).cast("string").alias("what"), F.lit(1).alias("version"))
    reasoning = f.filter(C("finding_id") % 5 == 0).select("finding_id", F.concat(F.lit("explained "), "class_name").alias("what"))
    return O.latest_per_key(O.append_reasoning(f, reasoning), ["finding_id"], ["version"]).select("finding_id", "what", "version")
