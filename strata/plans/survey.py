"""Queries on placement, site maps, decisions and dig items."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata import params as P
from strata.operators import decisions as D
from strata.operators import placement as L
from strata.operators import site as S
from strata.operators import sitemap as T
from strata.operators.findings import latest_per_key
from strata.plans import views as V
from strata.plans.registry import query

C = F.col


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


_TRACK = """tf AS (SELECT line_id, survey_id, count(*) AS n, regr_slope(east, distance_m) AS se, regr_intercept(east, distance_m) AS ie, regr_slope(north, distance_m) AS sn, regr_intercept(north, distance_m) AS i_n
    FROM track_points GROUP BY ALL HAVING regr_sxx(east, distance_m) > 0),
  tr AS (SELECT p.line_id, sqrt(avg(pow(p.east - (ie + se * distance_m), 2) + pow(p.north - (i_n + sn * distance_m), 2))) AS rms FROM track_points p JOIN tf USING (line_id) GROUP BY p.line_id),
  good AS (SELECT tf.*, rms, sqrt(se * se + sn * sn) AS sc FROM tf JOIN tr USING (line_id) WHERE n >= 3 AND sqrt(se * se + sn * sn) > 0.6 AND sqrt(se * se + sn * sn) < 1.4 AND rms < 0.3)"""


def placed(spark, sf):
    return L.straight_lines(L.fit_tracks(V.track_points(spark, sf), ["line_id", "survey_id"], "distance_m", "east", "north"))


@query("A13_line_placement", f"WITH {_TRACK} SELECT line_id, round(ie, 6) AS start_east, round(i_n, 6) AS start_north, round(se / sc, 6) AS dir_east, round(sn / sc, 6) AS dir_north, round(rms, 6) AS rms_m FROM good")
def _(spark, sf):
    return placed(spark, sf).select("line_id", r("start_east", "start_east"), r("start_north", "start_north"), r("dir_east", "dir_east"), r("dir_north", "dir_north"), r("rms_m", "rms_m"))


@query("A15_survey_axis", f"""WITH {_TRACK}, d AS (SELECT survey_id, line_id, se / sc AS de, sn / sc AS dn FROM good), f AS (SELECT survey_id, arg_min(de, line_id) AS fe, arg_min(dn, line_id) AS fn FROM d GROUP BY survey_id),
  m AS (SELECT survey_id, avg(CASE WHEN de * fe + dn * fn >= 0 THEN de ELSE -de END) AS e, avg(CASE WHEN de * fe + dn * fn >= 0 THEN dn ELSE -dn END) AS n FROM d JOIN f USING (survey_id) GROUP BY survey_id)
  SELECT survey_id, round(e / sqrt(e * e + n * n), 6) AS axis_east, round(n / sqrt(e * e + n * n), 6) AS axis_north FROM m""")
def _(spark, sf):
    a = L.survey_axis(placed(spark, sf), "survey_id", "line_id")
    return a.select("survey_id", r("axis_east", "axis_east"), r("axis_north", "axis_north"))


_GPS = """gc AS (SELECT line_id, avg(lat) AS lat0, avg(lon) AS lon0 FROM gps_fixes GROUP BY line_id HAVING count(DISTINCT (lat, lon)) >= 5),
  gx AS (SELECT line_id, trace * 0.025 AS x, (lon - lon0) * 111320.0 * cos(radians(lat0)) AS e, (lat - lat0) * 110574.0 AS n FROM gps_fixes JOIN gc USING (line_id)),
  gf AS (SELECT line_id, regr_slope(e, x) AS se, regr_intercept(e, x) AS ie, regr_slope(n, x) AS sn, regr_intercept(n, x) AS i_n FROM gx GROUP BY line_id HAVING regr_sxx(e, x) > 0),
  gj AS (SELECT line_id, sqrt(avg(pow(e - (ie + se * x), 2) + pow(n - (i_n + sn * x), 2))) AS jitter FROM gx JOIN gf USING (line_id) GROUP BY line_id),
  gl AS (SELECT line_id, lat0, lon0, jitter, se / greatest(sqrt(se * se + sn * sn), 1e-9) AS de, sn / greatest(sqrt(se * se + sn * sn), 1e-9) AS dn FROM gf JOIN gj USING (line_id) JOIN gc USING (line_id))"""


@query("A14_gps_track_quality", f"WITH {_GPS} SELECT line_id, round(jitter, 5) AS jitter_m, round(de, 5) + 0.0 AS dir_east, round(dn, 5) + 0.0 AS dir_north FROM gl")
def _(spark, sf):
    return L.gps_tracks(V.gps_fixes(spark, sf), 0.025).select("line_id", r("jitter_m", "jitter_m", 5), r("dir_east", "dir_east", 5), r("dir_north", "dir_north", 5))


_HEAD = f"""{_GPS}, hd AS (SELECT line_id, line_id % 40 AS site, CASE WHEN h < 0 THEN h + 180 WHEN h >= 180 THEN h - 180 ELSE h END AS heading FROM (SELECT line_id, degrees(atan2(dn, de)) AS h FROM gl)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY line_id) AS k FROM hd),
  fm AS (SELECT site, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS heads, CAST(NULL AS BIGINT) AS line_id, CAST(NULL AS INTEGER) AS family FROM rk GROUP BY site UNION ALL
    SELECT s.site, rk.k, CASE WHEN len(list_filter(s.heads, lambda h: least(abs(rk.heading - h), 180 - abs(rk.heading - h)) <= 30.0)) > 0 THEN s.heads ELSE list_append(s.heads, rk.heading) END, rk.line_id,
      CAST(coalesce(list_position(list_transform(s.heads, lambda h: least(abs(rk.heading - h), 180 - abs(rk.heading - h)) <= 30.0), true), len(s.heads) + 1) AS INTEGER) FROM fm s JOIN rk ON rk.site = s.site AND rk.k = s.k + 1)"""


def site_lines(spark, sf):
    return L.gps_tracks(V.gps_fixes(spark, sf), 0.025).withColumn("site", C("line_id") % 40)


@query("G02_line_families", f"WITH RECURSIVE {_HEAD} SELECT site, line_id, family FROM fm WHERE line_id IS NOT NULL")
def _(spark, sf):
    return L.line_families(site_lines(spark, sf), "site", "line_id").select("site", "line_id", "family")


@query("W10_line_order_across_site", f"""WITH {_GPS}, l AS (SELECT *, line_id % 40 AS site FROM gl), f AS (SELECT site, arg_min(de, line_id) AS fe, arg_min(dn, line_id) AS fn, avg(lat0) AS sla, avg(lon0) AS slo FROM l GROUP BY site),
  m AS (SELECT site, avg(CASE WHEN de * fe + dn * fn >= 0 THEN de ELSE -de END) AS me, avg(CASE WHEN de * fe + dn * fn >= 0 THEN dn ELSE -dn END) AS mn FROM l JOIN f USING (site) GROUP BY site),
  o AS (SELECT l.site, l.line_id, round(((lat0 - sla) * 110574.0 * me - (lon0 - slo) * 111320.0 * cos(radians(sla)) * mn) / greatest(sqrt(me * me + mn * mn), 1e-9), 9) AS across FROM l JOIN f USING (site) JOIN m USING (site))
  SELECT site, line_id, row_number() OVER (PARTITION BY site ORDER BY across, line_id) AS rank FROM o""")
def _(spark, sf):
    return L.across_order(site_lines(spark, sf), ["site"], "line_id").select("site", "line_id", C("rank").cast("long").alias("rank"))


@query("A18_gps_assessment", None)
def _(spark, sf):
    return L.gps_assessment(V.gps_fixes(spark, sf), 0.025).drop("centre_lat", "centre_lon")


@query("A16_placement_quality", None)
def _(spark, sf):
    return L.placement_quality(V.anchors(spark, sf))


_RAD = "6378137.0 * (1 - 0.00669437999014) / pow(1 - 0.00669437999014 * pow(sin(radians(lat0)), 2), 1.5)"
_VER = "6378137.0 / sqrt(1 - 0.00669437999014 * pow(sin(radians(lat0)), 2))"
_BRACKET = """an AS (SELECT line_id, chainage_m AS c0, lat AS lat0, lon AS lon0 FROM anchors),
  sp AS (SELECT *, lead(c0) OVER w AS c1, lead(lat0) OVER w AS lat1, lead(lon0) OVER w AS lon1 FROM an WINDOW w AS (PARTITION BY line_id ORDER BY c0, lat0, lon0))"""


@query("J26_anchor_bracket", f"""WITH {_BRACKET}, q AS (SELECT o_custkey AS line_id, o_orderkey AS q_id, (o_orderkey * 31 % 2500) * 1.0 AS x FROM orders),
  b AS (SELECT q.line_id, q.q_id, q.x, arg_min((c0, c1, lat0, lon0, lat1, lon1), (c0, c1)) AS s FROM q LEFT JOIN sp ON sp.line_id = q.line_id AND sp.c1 IS NOT NULL AND sp.c0 <= q.x AND q.x <= sp.c1 GROUP BY ALL),
  u AS (SELECT line_id, q_id, x, s[1] AS c0, s[2] AS c1, s[3] AS lat0, s[4] AS lon0, s[5] AS lat1, s[6] AS lon1 FROM b)
  SELECT line_id, q_id, round(lat0 + (lat1 - lat0) * CASE WHEN c1 > c0 THEN (x - c0) / (c1 - c0) ELSE 0.0 END, 7) AS lat, round(lon0 + (lon1 - lon0) * CASE WHEN c1 > c0 THEN (x - c0) / (c1 - c0) ELSE 0.0 END, 7) AS lon FROM u""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    q = o.select(C("o_custkey").alias("line_id"), C("o_orderkey").alias("q_id"), ((C("o_orderkey") * 31) % 2500 * F.lit(1.0)).alias("x"))
    return L.interpolate(q, V.anchors(spark, sf), "x").select("line_id", "q_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("G07_line_track_points", f"""WITH {_BRACKET}, e AS (SELECT line_id, min(c0) AS lo, max(c0) AS hi FROM an GROUP BY line_id HAVING max(c0) > min(c0)),
  q AS (SELECT DISTINCT line_id, lo + (hi - lo) * i / n AS x FROM (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS i FROM (SELECT *, greatest(1, ceil(hi - lo)) AS n FROM e))),
  b AS (SELECT q.line_id, q.x, arg_min((c0, c1, lat0, lat1), (c0, c1)) AS s FROM q LEFT JOIN sp ON sp.line_id = q.line_id AND sp.c1 IS NOT NULL AND sp.c0 <= q.x AND q.x <= sp.c1 GROUP BY ALL)
  SELECT line_id, CAST(floor(x / 100) AS BIGINT) AS stretch, count(*) AS points, CAST(sum(CAST(round(x * 1000) AS BIGINT)) AS BIGINT) AS chainage_mm,
    CAST(sum(CAST(round((s[3] + (s[4] - s[3]) * CASE WHEN s[2] > s[1] THEN (x - s[1]) / (s[2] - s[1]) ELSE 0.0 END) * 1e6) AS BIGINT)) AS BIGINT) AS lat_micro FROM b GROUP BY ALL""")
def _(spark, sf):
    # A point a metre: told by stretch of 100 m, so that millions of points need not be compared one by one.
    t = L.track_points(V.anchors(spark, sf), P.TRACK_STEP_M)
    whole = lambda c, k: F.sum(F.round(C(c) * k).cast("long"))
    return t.groupBy("line_id", F.floor(C("chainage_m") / 100).alias("stretch")).agg(F.count("*").alias("points"), whole("chainage_m", 1000).alias("chainage_mm"), whole("lat", 1e6).alias("lat_micro"))


@query("G06_line_source_choice", None)
def _(spark, sf):
    a = V.anchors(spark, sf).filter(C("accuracy_m") > 0.2).select("line_id").distinct()
    lines = V.table(spark, sf, "customer").select(C("c_custkey").alias("line_id"))
    return L.line_source(lines, a, L.gps_assessment(V.gps_fixes(spark, sf), 0.025))


_MATCH = """pr AS (SELECT h.site, h.line_rank + 1 AS lr, h.target_id AS a, t.target_id AS b, sqrt(pow(h.east - t.east, 2) + pow(h.north - t.north, 2)) AS gap, abs(h.depth_m - t.depth_m) AS dd FROM run_targets h
    JOIN run_targets t ON t.site = h.site AND t.line_rank = h.line_rank + 1 WHERE sqrt(pow(h.east - t.east, 2) + pow(h.north - t.north, 2)) <= 1.5 AND abs(h.depth_m - t.depth_m) <= 0.2),
  pk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site, lr ORDER BY gap + dd, a, b) AS k FROM pr),
  gs AS (SELECT DISTINCT site, lr, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub FROM pk UNION ALL
    SELECT gs.site, gs.lr, pk.k, CASE WHEN list_contains(ua, pk.a) OR list_contains(ub, pk.b) THEN ua ELSE list_append(ua, pk.a) END, CASE WHEN list_contains(ua, pk.a) OR list_contains(ub, pk.b) THEN ub ELSE list_append(ub, pk.b) END
    FROM gs JOIN pk ON pk.site = gs.site AND pk.lr = gs.lr AND pk.k = gs.k + 1),
  fi AS (SELECT site, lr, arg_max(ua, k) AS ua, arg_max(ub, k) AS ub FROM gs GROUP BY site, lr), mt AS MATERIALIZED (SELECT site, unnest(ua) AS a, unnest(ub) AS b FROM fi)"""


@query("J16_neighbour_line_matches", f"WITH RECURSIVE {_MATCH} SELECT site, a, b FROM mt")
def _(spark, sf):
    return S.match_neighbour_lines(V.run_targets(spark, sf), ["site"])


@query("G03_utility_runs", f"""WITH RECURSIVE {_MATCH}, ch AS (SELECT site, a AS run_id, a AS target_id FROM mt WHERE NOT EXISTS (SELECT 1 FROM mt m2 WHERE m2.site = mt.site AND m2.b = mt.a)
    UNION ALL SELECT ch.site, ch.run_id, mt.b FROM ch JOIN mt ON mt.site = ch.site AND mt.a = ch.target_id),
  me AS (SELECT ch.site, ch.run_id, t.* EXCLUDE (site) FROM ch JOIN run_targets t ON t.site = ch.site AND t.target_id = ch.target_id),
  sh AS (SELECT site, run_id, count(*) AS n, max(depth_m) - min(depth_m) AS dz, avg(east) AS ae, avg(north) AS an, 0.5 * atan2(2 * covar_pop(east, north), var_pop(east) - var_pop(north)) AS ang FROM me GROUP BY ALL),
  st AS (SELECT me.site, me.run_id FROM me JOIN sh USING (site, run_id) WHERE n >= 3 AND dz <= 0.4 AND degrees(acos(least(1.0, abs(cos(ang))))) >= 30.0 GROUP BY ALL HAVING max(abs((north - an) * cos(ang) - (east - ae) * sin(ang))) <= 0.3)
  SELECT me.site, me.target_id, me.line_rank, sh.n FROM me JOIN st USING (site, run_id) JOIN sh USING (site, run_id)""")
def _(spark, sf):
    t = V.run_targets(spark, sf)
    axis = t.select("site").distinct().withColumn("axis_east", F.lit(1.0)).withColumn("axis_north", F.lit(0.0))
    return S.utility_runs(t, ["site"], axis).select("site", "target_id", "line_rank", "n")


def _chance(spark, sf, draws):
    t = V.run_targets(spark, sf)
    axis = t.select("site").distinct().withColumn("axis_east", F.lit(1.0)).withColumn("axis_north", F.lit(0.0))
    place = F.struct((C("u") * 10.0).alias("east"), C("north"))
    return t, axis, S.chance_control(t, ["site"], place, axis, draws)


@query("G04_chance_control", None)
def _(spark, sf):
    return _chance(spark, sf, P.CHANCE_DRAWS)[2]


@query("G05_run_readings", None)
def _(spark, sf):
    t, axis, verdicts = _chance(spark, sf, P.CHANCE_DRAWS)
    seen = t.select("site", "target_id", F.when(C("target_id") % 3 == 0, "unreadable").otherwise("denser").alias("contrast"))
    return S.run_readings(S.utility_runs(t, ["site"], axis), seen, verdicts, ["site"])


@query("A19_contrast_vote", """
  SELECT line_id, CASE WHEN count(v) >= 2 AND bool_and(v) THEN 'lighter' WHEN count(v) >= 2 AND bool_and(NOT v) THEN 'denser' ELSE 'unreadable' END AS contrast FROM (
    SELECT line_id, CASE pick_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS v FROM channel_picks) GROUP BY line_id""")
def _(spark, sf):
    v = V.channel_picks(spark, sf).select("line_id", F.when(C("pick_id") % 3 == 0, True).when(C("pick_id") % 3 == 1, False).alias("v"))
    return S.contrast(v, ["line_id"], "v")


@query("J10_traced_across_lines", """
  WITH p AS (SELECT line_id % 400 AS survey_id, channel, line_id, apex_id, position_m AS along, depth_m FROM apexes), s AS (SELECT DISTINCT survey_id, channel, line_id, along, depth_m FROM p)
  SELECT p.survey_id, p.channel, p.line_id, p.apex_id, t.lines FROM p JOIN (SELECT a.survey_id, a.channel, a.line_id, a.along, a.depth_m, count(DISTINCT b.line_id) AS lines FROM s a JOIN s b ON a.survey_id = b.survey_id AND a.channel = b.channel AND abs(a.along - b.along) <= 0.3 AND abs(a.depth_m - b.depth_m) <= 0.15
    GROUP BY ALL HAVING count(DISTINCT b.line_id) >= 3) t USING (survey_id, channel, line_id, along, depth_m)""")
def _(spark, sf):
    p = V.apexes(spark, sf).select((C("line_id") % 400).alias("survey_id"), "channel", "line_id", "apex_id", C("position_m").alias("along"), "depth_m")
    return S.traced_across_lines(p, ["survey_id", "channel"], 3).select("survey_id", "channel", "line_id", "apex_id", "lines")


@query("G01_site_targets", f"""WITH {_GPS}, fx AS (SELECT line_id, trace AS t0, avg(lat) AS lat0, avg(lon) AS lon0 FROM gps_fixes GROUP BY ALL), sp AS (SELECT *, lead(t0) OVER w AS t1, lead(lat0) OVER w AS lat1 FROM fx WINDOW w AS (PARTITION BY line_id ORDER BY t0)),
  en AS (SELECT line_id, min(t0) AS a, max(t0) AS z FROM fx GROUP BY line_id), tg AS (SELECT p.line_id % 1500 AS line_id, pick_id * 10000000 + p.line_id * 100 + sample AS target_id, trace, sample * 0.2 - 1.6 AS time_ns FROM channel_picks p WHERE channel = 'RAD'),
  gp AS (SELECT tg.*, gl.jitter, CAST(least(greatest(trace, a), z) AS DOUBLE) AS q FROM tg JOIN gl USING (line_id) JOIN en USING (line_id) WHERE time_ns > 0 AND trace >= 12.0 AND trace <= 40 - 1 - 0.3 / 0.025),
  jn AS (SELECT gp.*, arg_min(lat0 + (q - t0) / (t1 - t0) * (lat1 - lat0), (t0, t1)) AS lat FROM gp JOIN sp ON sp.line_id = gp.line_id AND t1 IS NOT NULL AND t0 <= q AND q <= t1 GROUP BY ALL)
  SELECT line_id, target_id, round(lat, 9) AS lat, round(0.2998 / 3 * time_ns / 2, 6) AS depth_m, round(0.15 * (0.2998 / 3 * time_ns / 2) + 0.04, 6) AS depth_error_m, round(sqrt(jitter * jitter + 0.0025 + 0.0225), 5) AS horizontal_error_m FROM jn""")
def _(spark, sf):
    p = V.channel_picks(spark, sf).filter(C("channel") == "RAD")
    t = p.select((C("line_id") % 1500).alias("line_id"), (C("pick_id") * 10000000 + C("line_id") * 100 + C("sample")).alias("target_id"), "trace", (C("sample") * 0.2 - 1.6).alias("time_ns"))
    gps = V.gps_fixes(spark, sf)
    lines = L.gps_tracks(gps, 0.025).select("line_id", "jitter_m", F.lit(9.0).alias("dielectric"), F.lit(40).alias("n_traces"), F.lit(0.025).alias("spacing"))
    where = L.interpolate_held(t.select("line_id", "target_id", "trace"), gps).select("line_id", "target_id", "lat", "lon")
    return S.site_targets(t, lines, where).select("line_id", "target_id", F.round("lat", 9).alias("lat"), r("depth_m", "depth_m"), r("depth_error_m", "depth_error_m"), F.round("horizontal_error_m", 5).alias("horizontal_error_m"))


def site_map(spark, sf):
    """Lines of 200 traces; fixes, headers and human picks by rule."""
    vec = C("vec_id")
    t = V.table(spark, sf, "embeddings").select(
        F.floor(vec / 600).alias("line_id"), F.when(vec % 3 == 0, "RAD").when(vec % 3 == 1, "RA1").otherwise("RA2").alias("channel"), F.floor((vec % 600) / 3).cast("int").alias("trace"), F.lit(0.2).alias("dt"), F.lit(0.025).alias("spacing"),
        C("embedding").cast("array<double>").alias("samples"))
    line = t.select("line_id").distinct()
    fixes = line.withColumn("trace", F.explode(F.sequence(F.lit(0), F.lit(200), F.lit(20)))).select("line_id", "trace", (12.9 + C("line_id") * 0.0001 + C("trace") * 2e-7).alias("lat"), (77.5 + C("trace") * 1e-7).alias("lon"))
    headers = t.select("line_id", "channel").distinct().withColumn("dielectric", F.when(C("line_id") % 2 == 0, 9.0).otherwise(0.0))
    human = line.select("line_id", C("line_id").alias("pick_id"), F.lit(50).alias("trace"), F.lit(6.0).alias("time_ns"), F.lit(0.6).alias("depth_m"), F.lit("RAD").alias("channel"))
    return T.targets_from_traces(t, headers, fixes, 0.025, human)


@query("G01_targets_from_traces", None)
def _(spark, sf):
    t = site_map(spark, sf)
    return t.select("line_id", "target_id", "status", r("trace", "trace"), r("time_ns", "time_ns"), F.round("lat", 9).alias("lat"), r("depth_m", "depth_m"), r("depth_error_m", "depth_error_m"), "depth_basis", "channels", "contrast", "near_surface")


@query("U03_new_proposals", """
  WITH p AS (SELECT job, target_id, lower(trim(identity)) AS idn FROM reviews WHERE status <> 'confirmed'), w AS (SELECT job, target_id, lower(trim(identity)) AS idn FROM reviews WHERE status = 'proposed')
  SELECT DISTINCT job, target_id, idn AS identity FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.job = p.job AND w.target_id = p.target_id AND w.idn = p.idn)""")
def _(spark, sf):
    v = V.reviews(spark, sf)
    return D.new_proposals(v.filter(C("status") != "confirmed"), v).select("job", "target_id", F.lower(F.trim("identity")).alias("identity"))


@query("U04_undecided_picks", """
  SELECT job, pick_id FROM (SELECT DISTINCT job, target_id AS pick_id FROM reviews) p WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.job = p.job AND r.target_id = p.pick_id AND r.target_kind = 'pick' AND r.status <> 'proposed')""")
def _(spark, sf):
    v = V.reviews(spark, sf)
    return D.undecided_picks(v.select("job", C("target_id").alias("pick_id")).distinct(), v)


_STAND = """dc AS (SELECT *, row_number() OVER (PARTITION BY job, target_kind, target_id ORDER BY decided_at DESC, review_id DESC) AS rn FROM reviews WHERE status IN ('confirmed', 'rejected')),
  gr AS (SELECT job, target_kind, target_id, max(status) FILTER (WHERE rn = 1) AS latest, count(*) FILTER (WHERE status = 'confirmed') AS n, count(DISTINCT CASE WHEN status = 'confirmed' THEN lower(trim(identity)) END) AS ids,
    arg_max(review_id, (decided_at, review_id)) FILTER (WHERE status = 'confirmed') AS standing, max(review_id) FILTER (WHERE status = 'confirmed') AS last_confirmed FROM dc GROUP BY ALL)"""


@query("W06_standing_confirmations", f"WITH {_STAND} SELECT r.job, r.review_id, r.target_kind, r.target_id, trim(r.identity) AS identity FROM reviews r JOIN gr ON gr.job = r.job AND gr.standing = r.review_id WHERE n > 0 AND latest <> 'rejected' AND ids <= 1")
def _(spark, sf):
    return D.standing_confirmations(V.reviews(spark, sf))[0].select("job", "review_id", "target_kind", "target_id", F.trim("identity").alias("identity"))


_DIG = f"""{_STAND}, sd AS (SELECT r.* FROM reviews r JOIN gr ON gr.job = r.job AND gr.standing = r.review_id WHERE n > 0 AND latest <> 'rejected' AND ids <= 1),
  pk AS (SELECT DISTINCT job, target_id AS pick_id FROM reviews WHERE job % 3 <> 0), bx AS (SELECT DISTINCT job, target_id AS box_id, CASE WHEN job % 4 = 1 THEN 'energy' ELSE 'migration' END AS detector FROM reviews WHERE job % 7 <> 0),
  jn AS (SELECT sd.*, pk.pick_id, bx.box_id, detector, CASE WHEN target_kind = 'pick' THEN (10 + 3 * sd.target_id) * 0.2 - 1.6 ELSE (4 * sd.target_id + 1.0 / 0.2) * 0.2 - 1.6 END AS apex_ns,
     CASE WHEN target_kind = 'pick' THEN CAST(5 + sd.target_id AS DOUBLE) ELSE 20 + sd.target_id + 8.0 / 2 END AS tr, CASE WHEN target_kind = 'pick' THEN 0.1 ELSE 0.2998 / sqrt(9.0) END AS vel
     FROM sd LEFT JOIN pk ON pk.job = sd.job AND pk.pick_id = sd.target_id AND target_kind = 'pick' LEFT JOIN bx ON bx.job = sd.job AND bx.box_id = sd.target_id AND target_kind = 'candidate'),
  rs AS (SELECT *, CASE WHEN target_kind = 'pick' AND pick_id IS NULL THEN 'the pick it confirmed has been deleted' WHEN target_kind <> 'pick' AND box_id IS NULL THEN 'the candidate it confirmed is gone' WHEN target_kind <> 'pick' AND detector <> 'migration' THEN 'its box does not mark a known apex position'
     WHEN job % 11 = 0 THEN 'its channel is no longer in this line' WHEN job % 13 = 0 THEN 'its channel has its own trace grid' WHEN apex_ns <= 0 THEN 'its time is above the direct wave' END AS reason FROM jn)"""


def dig(spark, sf):
    v = V.reviews(spark, sf)
    t = v.select("job", "target_id").distinct()
    picks = t.filter(C("job") % 3 != 0).select("job", C("target_id").alias("pick_id"), F.lit("RAD").alias("channel"), (5 + C("target_id")).alias("trace"), (10 + 3 * C("target_id")).alias("sample"),
                                               F.lit(0.1).alias("velocity"), F.when(C("job") % 2 == 0, "fitted").otherwise("assumed").alias("velocity_source"))
    boxes = t.filter(C("job") % 7 != 0).select("job", C("target_id").alias("box_id"), F.lit("RAD").alias("channel"), (20 + C("target_id")).alias("x"), (4 * C("target_id")).alias("y"), F.lit(8.0).alias("w"),
                                               F.when(C("job") % 4 == 1, "energy").otherwise("migration").alias("detector"))
    channels = v.select("job").distinct().filter(C("job") % 11 != 0).select(
        "job", F.lit("RAD").alias("channel"), F.lit(0.2).alias("dt"), F.lit(0.025).alias("spacing"), F.lit(1.6).alias("zero_ns"), F.lit(40).alias("n_traces"), F.when(C("job") % 13 == 0, 41).otherwise(40).alias("line_traces"), F.lit(None).cast("double").alias("dielectric"))
    reports = v.select("job", C("review_id").alias("item_id"), F.when(C("decided_at") % 2 == 0, "found").otherwise("not_found").alias("outcome"), C("decided_at").alias("reported_at"), C("review_id").alias("report_id"))
    return D.dig_items(v, picks, boxes, channels, reports)


@query("G11_J22_J23_dig_items", f"""WITH {_DIG} SELECT job, review_id AS item_id, trim(identity) AS identity, round(tr * 0.025, 6) AS chainage_m, round(vel * apex_ns / 2, 6) AS depth_m,
   round(CASE WHEN target_kind = 'pick' AND job % 2 = 0 THEN 0.05 ELSE 0.15 END * (vel * apex_ns / 2) + 0.04, 6) AS depth_error_m, apex_ns < 1.5 AS near_surface, CASE WHEN decided_at % 2 = 0 THEN 'found' ELSE 'not_found' END AS field_outcome FROM rs WHERE reason IS NULL""")
def _(spark, sf):
    i = dig(spark, sf)[0]
    return i.select("job", "item_id", "identity", r("chainage_m", "chainage_m"), r("depth_m", "depth_m"), r("depth_error_m", "depth_error_m"), "near_surface", "field_outcome")


@query("G11_attention_list", f"WITH {_DIG} SELECT job, review_id AS ref, reason FROM rs WHERE reason IS NOT NULL UNION ALL SELECT job, last_confirmed, '{D.CONFLICT}' FROM gr WHERE n > 0 AND (latest = 'rejected' OR ids > 1)")
def _(spark, sf):
    return dig(spark, sf)[1]


@query("J17_suggestion_to_box", """
  WITH s AS (SELECT line_id, pick_id AS suggestion_id, strength, trace * 0.025 AS pos, sample * 0.2 AS t FROM channel_picks WHERE channel = 'RAD'), b AS (SELECT line_id, apex_id AS box_id, channel, position_m * 0.5 AS pos, depth_m * 3 AS t FROM apexes)
  SELECT s.line_id, s.suggestion_id, arg_min(box_id, (abs(s.pos - b.pos) + abs(s.t - b.t) / 10, box_id)) AS box_id FROM s JOIN b ON b.line_id = s.line_id AND abs(s.pos - b.pos) <= 0.3 AND abs(s.t - b.t) <= 1.5 AND b.channel IN ('RAD', 'RA1') GROUP BY s.line_id, s.suggestion_id""")
def _(spark, sf):
    s = V.channel_picks(spark, sf).filter(C("channel") == "RAD").select("line_id", C("pick_id").alias("suggestion_id"), (C("trace") * 0.025).alias("position_m"), (C("sample") * 0.2).alias("time_ns"), F.array(F.lit("RAD"), F.lit("RA1")).alias("channels"))
    b = V.apexes(spark, sf).select("line_id", C("apex_id").alias("box_id"), "channel", (C("position_m") * 0.5).alias("position_m"), (C("depth_m") * 3).alias("time_ns"))
    return D.suggestion_boxes(s, b)


@query("J21_model_mentions", """
  SELECT review_id, CASE WHEN NOT EXISTS (SELECT 1 FROM fits WHERE fit_id % 300 = job AND n_inliers > 18) THEN 'unknown target' WHEN reviewer NOT IN ('user', 'assistant') THEN 'unknown material' END AS reason,
    CASE WHEN reviewer = 'user' THEN 'low' ELSE 'high' END AS confidence FROM reviews""")
def _(spark, sf):
    m = V.reviews(spark, sf).select("review_id", C("job").alias("target_id"), C("reviewer").alias("material"), F.lit("high").alias("confidence"))
    t = V.fits(spark, sf).filter(C("n_inliers") > 18).select((C("fit_id") % 300).alias("target_id")).distinct()
    return D.parsed_mentions(m, t, ("user", "assistant"), ("user",)).select("review_id", "reason", "confidence")


_REP = "rp AS (SELECT job, CASE WHEN job % 2 = 0 THEN review_id ELSE target_id END AS source_id, CASE WHEN decided_at % 3 = 0 THEN 'not_found' ELSE 'found' END AS outcome, (decided_at * 5) % 12 AS reported_at, review_id AS report_id FROM reviews)"


@query("G13_training_labels", f"""WITH {_REP}, l0 AS (SELECT job, source_id, arg_max(outcome, (reported_at, report_id)) AS outcome, max(reported_at) AS reported_at FROM rp GROUP BY ALL),
  dp AS (SELECT job, target_id AS pick_id, max(review_id) AS review_id FROM reviews WHERE target_kind = 'pick' AND status <> 'proposed' GROUP BY ALL),
  l1 AS (SELECT * FROM l0 UNION ALL SELECT l0.job, dp.review_id, outcome, reported_at FROM l0 JOIN dp ON dp.job = l0.job AND dp.pick_id = l0.source_id), l2 AS (SELECT job, source_id, max((reported_at, outcome)) AS r FROM l1 GROUP BY ALL),
  d AS (SELECT job, review_id AS source_id, 'review' AS source, decided_at, status = 'confirmed' AS pos, status = 'proposed' AS op FROM reviews UNION ALL
    SELECT job, pick_id, 'pick', 6, true, false FROM (SELECT DISTINCT job, target_id AS pick_id FROM reviews) p WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.job = p.job AND dp.pick_id = p.pick_id))
  SELECT d.job, d.source_id, d.source, CASE WHEN op THEN 'unknown' WHEN (r IS NULL OR r[1] < decided_at) AND pos THEN 'positive' WHEN (r IS NULL OR r[1] < decided_at) THEN 'negative' WHEN r[2] = 'not_found' THEN 'unknown' ELSE 'positive' END AS label FROM d LEFT JOIN l2 ON l2.job = d.job AND l2.source_id = d.source_id""")
def _(spark, sf):
    v = V.reviews(spark, sf)
    picks = v.select("job", C("target_id").alias("pick_id")).distinct().withColumn("decided_at", F.lit(6).cast("long"))
    rep = v.select("job", F.when(C("job") % 2 == 0, C("review_id")).otherwise(C("target_id")).alias("source_id"), F.when(C("decided_at") % 3 == 0, "not_found").otherwise("found").alias("outcome"),
                   ((C("decided_at") * 5) % 12).alias("reported_at"), C("review_id").alias("report_id"))
    return D.training_labels(v, picks, rep).select("job", "source_id", "source", "label")


_TILES = """tl AS (SELECT line_id, pick_id * 100 + sample AS tile_id, CAST(least(greatest(x + w / 2 - 64 / 2, 0.0), 300 - 64) AS INTEGER) AS t0, CAST(least(greatest(y + h / 2 - 64 / 2, 0.0), 256 - 64) AS INTEGER) AS s0, x, y, w, h, channel FROM
   (SELECT *, trace * 7.0 + 0.25 AS x, sample * 6.0 + 0.25 AS y, 20.0 AS w, 14.0 AS h FROM channel_picks))"""


def tiles(spark, sf):
    b = V.channel_picks(spark, sf).select("line_id", "channel", (C("pick_id") * 100 + C("sample")).alias("tile_id"), (C("pick_id") * 100 + C("sample")).alias("box_id"), (C("trace") * 7.0 + 0.25).alias("x"), (C("sample") * 6.0 + 0.25).alias("y"),
                                          F.lit(20.0).alias("w"), F.lit(14.0).alias("h"), F.lit(300).alias("n_traces"), F.lit(256).alias("n_samples"))
    decided, still_open = b.filter(C("channel") != "RA2"), b.filter(C("channel") == "RA2")
    return decided, D.clean_tiles(D.tiles_around(decided), still_open, ["line_id"])


@query("J25_tile_labels", f"""WITH {_TILES.replace('CAST(least', 'CAST(trunc(least').replace(' AS INTEGER)', ') AS INTEGER)')}, cl AS (SELECT * FROM tl WHERE channel <> 'RA2' AND NOT EXISTS (SELECT 1 FROM tl o WHERE o.channel = 'RA2' AND o.line_id = tl.line_id AND o.x < tl.t0 + 64 AND o.x + o.w > tl.t0 AND o.y < tl.s0 + 64 AND o.y + o.h > tl.s0)),
  jn AS (SELECT c.line_id, c.tile_id, p.tile_id AS label_id, greatest(p.x, c.t0) AS x0, greatest(p.y, c.s0) AS y0, least(p.x + p.w, c.t0 + 64) AS x1, least(p.y + p.h, c.s0 + 64) AS y1, c.t0, c.s0, p.w, p.h FROM cl c JOIN tl p ON p.line_id = c.line_id AND p.channel <> 'RA2')
  SELECT line_id, tile_id, label_id, x0 - t0 AS x, y0 - s0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM jn WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) >= 0.5 * w * h""")
def _(spark, sf):
    decided, clean = tiles(spark, sf)
    return D.tile_labels(clean, decided, ["line_id"])


@query("W05_latest_report_outcomes", """SELECT job, arg_max(CASE WHEN decided_at % 3 = 0 THEN 'not_found' ELSE 'found' END, (decided_at, review_id)) AS outcome FROM reviews GROUP BY job""")
def _(spark, sf):
    v = V.reviews(spark, sf).select("job", "review_id", "decided_at", F.when(C("decided_at") % 3 == 0, "not_found").otherwise("found").alias("outcome"))
    return latest_per_key(v, ["job"], ["decided_at", "review_id"]).select("job", "outcome")
