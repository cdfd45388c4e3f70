"""Picks, boxes, fits, polarity and channel fusion over the trace and pick views."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strata import params as P
from strata.operators import corroborate as K
from strata.operators import detect as D
from strata.operators import findings as O
from strata.operators import fit as T
from strata.operators import process as R
from strata.operators import refine
from strata.operators.lines import LINE, largest_line, line_lengths
from strata.plans import views as V
from strata.plans.processing import _HILBERT, DEMEANED, NORMALIZED, TIME_ZERO, _mirror, convolved, kernel_values, migrated_sql
from strata.plans.registry import query

C = F.col


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


def normalized(spark, sf):
    t = V.traces(spark, sf)
    return R.normalized_envelope(t, largest_line(t))


_VEL9 = repr(P.SPEED_OF_LIGHT_M_PER_NS / math.sqrt(9.0))
_VEL12 = repr(P.SPEED_OF_LIGHT_M_PER_NS / math.sqrt(12.0))


def _focus_sql(aperture: int, velocity: str, top: str, bottom: float, tall: int, wide: int, ratio: float) -> str:
    return f"""{DEMEANED}, mig AS (SELECT * FROM ({migrated_sql('dm', aperture, velocity)})), {TIME_ZERO},
  mh AS ({convolved(kernel_values(_HILBERT), 'mig')}),
  env AS (SELECT m.line_id, m.channel, m.trace, m.sample, CASE WHEN m.sample < floor({top}) OR m.sample >= {int((1 - bottom) * 64)} THEN 0.0 ELSE sqrt(m.amp * m.amp + h.v * h.v) * (m.sample + 1) END AS e
    FROM mig m JOIN mh h USING (line_id, channel, trace, sample) JOIN zeros z USING (line_id, channel)),
  med AS (SELECT line_id, channel, quantile_cont(e, 0.5) AS med FROM env WHERE e > 0 GROUP BY ALL),
  up AS (SELECT *, max(e) OVER (PARTITION BY line_id, channel, trace ORDER BY sample ROWS BETWEEN {tall // 2} PRECEDING AND {tall - 1 - tall // 2} FOLLOWING) AS m1 FROM env),
  dil AS (SELECT *, max(m1) OVER (PARTITION BY line_id, channel, sample ORDER BY trace ROWS BETWEEN {wide // 2} PRECEDING AND {wide - 1 - wide // 2} FOLLOWING) AS m2 FROM up),
  peaks AS (SELECT line_id, channel, trace, sample, e / med AS strength FROM dil JOIN med USING (line_id, channel) WHERE e = m2 AND e > {ratio} * med)"""


_PICK_SQL = _focus_sql(40, _VEL9, "greatest(1.0, zero_ns + 0.5) / 0.2", 0.1, 10, 16, 3.0)


def shadow_sql(ranked: str, keys: list[str], reach: float, k: int) -> str:
    """The fold over peaks in strength order, as a recursion with the kept list as state."""
    by, on = ", ".join(keys), " AND ".join(f"p.{c} = st.{c}" for c in keys)
    st = ", ".join(f"st.{c}" for c in keys)
    return f"""st AS (SELECT DISTINCT {by}, CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT("trace" INTEGER, sample INTEGER, strength DOUBLE)[]) AS kept FROM {ranked}
    UNION ALL SELECT {st}, p.rk, CASE WHEN len(kept) >= {k} OR len(list_filter(kept, lambda q: abs(q."trace" - p.trace) <= {reach} AND q.sample < p.sample AND p.strength < 0.3 * q.strength)) > 0
      THEN kept ELSE list_append(kept, CAST({{'trace': p.trace, 'sample': p.sample, 'strength': p.strength}} AS STRUCT("trace" INTEGER, sample INTEGER, strength DOUBLE))) END
    FROM st JOIN {ranked} p ON {on} AND p.rk = st.rk + 1),
  fin AS (SELECT {by}, arg_max(kept, rk) AS kept FROM st GROUP BY {by}), ex AS (SELECT {by}, unnest(kept) AS q FROM fin)"""


@query("W11_D02_focused_peaks", f"WITH {_PICK_SQL} SELECT line_id, channel, trace, sample, round(strength, 5) AS strength FROM peaks")
def _(spark, sf):
    t = V.traces(spark, sf)
    n = largest_line(t)
    marked = D.focused(t, R.time_zero(t, n), F.lit(9.0), P.PICK_APERTURE_M, P.SKIP_TOP_NS, P.SKIP_BOTTOM_FRACTION, P.PEAK_WINDOW_NS, P.PEAK_WINDOW_M, 0.025)
    return D.peaks_over_median(marked, P.PEAK_OVER_MEDIAN, n).withColumn("strength", F.round("strength", 5))


@query("D02_migration_picks", f"""WITH RECURSIVE {_PICK_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY line_id, channel ORDER BY strength DESC, sample, trace) AS rk FROM peaks),
  {shadow_sql('ranked', ['line_id', 'channel'], 20.0, 15)}
  SELECT line_id, channel, q."trace" AS trace, q.sample AS sample, round(q.strength, 5) AS strength FROM ex""")
def _(spark, sf):
    t = V.traces(spark, sf)
    return D.pick_targets(t, 0.025, line_rows=largest_line(t)).select(*LINE, "trace", "sample", r("strength", "strength", 5))


@query("D03_neutral_velocity_peaks", f"WITH {_focus_sql(60, _VEL12, '2.0 / 0.2', 0.15, 20, 20, 5.0)} SELECT line_id, channel, trace, sample, round(strength, 5) AS strength FROM peaks")
def _(spark, sf):
    t = V.traces(spark, sf)
    return D.neutral_peaks(t, 0.025, largest_line(t)).withColumn("strength", F.round("strength", 5))


@query("K02_shadow_suppression", f"""WITH RECURSIVE ranked AS (SELECT line_id, trace, sample, strength, row_number() OVER (PARTITION BY line_id ORDER BY strength DESC, sample, trace) AS rk FROM channel_picks),
  {shadow_sql('ranked', ['line_id'], 20.0, 4)}
  SELECT line_id, q."trace" AS trace, q.sample AS sample, q.strength AS strength FROM ex""")
def _(spark, sf):
    return D.keep_without_shadows(V.channel_picks(spark, sf), 0.025, 4, ["line_id"]).select("line_id", "trace", "sample", "strength")


@query("K04_neighbour_suppression", """
  WITH RECURSIVE p AS (SELECT line_id, channel, pick_id, trace * 0.025 AS pos, sample * 0.2 AS t, strength, row_number() OVER (PARTITION BY line_id, channel ORDER BY strength DESC, pick_id) AS rk FROM channel_picks),
  st AS (SELECT DISTINCT line_id, channel, CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT(pos DOUBLE, t DOUBLE, pick_id BIGINT)[]) AS kept FROM p UNION ALL
    SELECT st.line_id, st.channel, p.rk, CASE WHEN len(list_filter(kept, lambda q: abs(q.pos - p.pos) <= 0.3 AND abs(q.t - p.t) <= 1.5)) > 0 THEN kept
      ELSE list_append(kept, CAST({'pos': p.pos, 't': p.t, 'pick_id': p.pick_id} AS STRUCT(pos DOUBLE, t DOUBLE, pick_id BIGINT))) END FROM st JOIN p ON p.line_id = st.line_id AND p.channel = st.channel AND p.rk = st.rk + 1),
  ex AS (SELECT line_id, channel, unnest(kept) AS q FROM (SELECT line_id, channel, arg_max(kept, rk) AS kept FROM st GROUP BY line_id, channel))
  SELECT line_id, channel, q.pick_id AS pick_id FROM ex""")
def _(spark, sf):
    p = V.channel_picks(spark, sf).select("line_id", "channel", "pick_id", (C("trace") * 0.025).alias("pos"), (C("sample") * 0.2).alias("t"), "strength")
    return D.suppress_neighbours(p, ["line_id", "channel"], [("pos", 0.3), ("t", 1.5)], "strength", "pick_id").select("line_id", "channel", "pick_id")


def detector_fusion(spark, sf):
    p = V.channel_picks(spark, sf)
    axes = p.select(*LINE).distinct().select(
        *LINE, F.when(C("channel") == "RAD", 0.1).when(C("channel") == "RA1", 0.2).otherwise(0.4).alias("dt"),
        F.when(C("channel") == "RAD", 1.6).when(C("channel") == "RA1", 4.2).otherwise(6.4).alias("zero_ns"),
        F.when(C("channel") == "RAD", 0).when(C("channel") == "RA1", 1).otherwise(2).alias("channel_rank"))
    return D.fuse(p.select(*LINE, "trace", "sample", "strength"), axes, 0.025)


@query("D10_channel_fusion", None)
def _(spark, sf):
    return detector_fusion(spark, sf).select("line_id", r("trace", "trace"), r("time_ns", "time_ns"), "channels", r("score", "score"))


@query("K06_ranked_targets", None)
def _(spark, sf):
    return D.rank_targets(detector_fusion(spark, sf), P.TARGETS_PER_LINE).select("line_id", "rank", r("trace", "trace"), r("time_ns", "time_ns"), "channels", r("score", "score"))


@query("D04_candidate_boxes", f"""WITH RECURSIVE {_PICK_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY line_id, channel ORDER BY strength DESC, sample, trace) AS rk FROM peaks),
  {shadow_sql('ranked', ['line_id', 'channel'], 20.0, 15)},
  b AS (SELECT e.line_id, e.channel, q."trace" AS trace, q.sample AS sample, q.strength AS strength, l.n_traces,
    least(greatest(0.5 * {_VEL9} * sqrt((q.sample * 0.2 + 3.0) * (q.sample * 0.2 + 3.0) - (q.sample * 0.2) * (q.sample * 0.2)), 0.2), 1.5) / 0.025 AS half FROM ex e JOIN line_table l USING (line_id, channel)),
  c AS (SELECT *, greatest(0.0, trace - half) AS x, least(n_traces - 1.0, trace + half) AS x1, greatest(0.0, sample - 1.0 / 0.2) AS y, least(63.0, sample + 3.0 / 0.2) AS y1 FROM b)
  SELECT line_id, channel, trace, sample, round(x, 5) AS x, round(y, 5) AS y, round(x1 - x, 5) AS w, round(y1 - y, 5) AS h FROM c WHERE x1 > x AND y1 > y""")
def _(spark, sf):
    t = V.traces(spark, sf)
    n = largest_line(t)
    picks = D.pick_targets(t, 0.025, line_rows=n)
    zeros = R.time_zero(t, n)
    axes = zeros.select(*LINE, "zero_ns", F.lit(0.2).alias("dt"), F.when(C("channel") == "RAD", 0).when(C("channel") == "RA1", 1).otherwise(2).alias("channel_rank"))
    seen = D.corroboration_of(D.fuse(picks.drop("rank"), axes, 0.025))
    lines = V.line_table(spark, sf).select(*LINE, "n_traces", "n_samples", "dt", "spacing", F.lit(float(_VEL9)).alias("velocity"))
    b = D.boxes_of_picks(picks, lines, seen)
    return b.select(*LINE, "trace", "sample", *[r(c, c, 5) for c in ("x", "y", "w", "h")])


_RIDGE = f"""{NORMALIZED},
  ridge AS (SELECT b.line_id, b.channel, b.box_id, n.trace, arg_max(n.sample, (n.amp, -n.sample)) AS sample, max(n.amp) AS peak FROM boxes b
    JOIN norm n ON n.line_id = b.line_id AND n.channel = b.channel AND n.trace >= b.x - 5 AND n.trace < b.x + b.w + 5 AND n.sample >= b.y AND n.sample < b.y + b.h
    GROUP BY ALL HAVING max(n.amp) >= 1.3)"""


@query("D05_ridge_points", f"WITH {_RIDGE} SELECT line_id, channel, box_id, trace, sample, round(peak, 5) AS peak FROM ridge")
def _(spark, sf):
    return D.ridge_points(normalized(spark, sf), V.boxes(spark, sf)).withColumn("peak", F.round("peak", 5))


def _fit_sql(ridge: str, draws: int) -> str:
    return f"""{ridge},
  pts AS (SELECT line_id, channel, box_id, trace - avg(trace) OVER w AS x, CAST(sample AS DOUBLE) AS t, row_number() OVER (PARTITION BY line_id, channel, box_id ORDER BY trace) - 1 AS i, count(*) OVER w AS n, avg(trace) OVER w AS mid
     FROM ridge WINDOW w AS (PARTITION BY line_id, channel, box_id)),
  bx AS (SELECT DISTINCT line_id, channel, box_id, n, mid FROM pts WHERE n >= 3),
  hu AS (SELECT d, s, ((d + 1) * 48271 + s * 1013904223) % 2147483647 AS u FROM range({draws}) AS q(d), range(1, 4) AS slot(s)), hv AS (SELECT d, s, (u * u + 69621 * u + s) % 2147483647 AS v FROM hu),
  hw AS (SELECT d, max((v * v + 40692 * v + d) % 2147483647) FILTER (WHERE s = 1) AS h1, max((v * v + 40692 * v + d) % 2147483647) FILTER (WHERE s = 2) AS h2, max((v * v + 40692 * v + d) % 2147483647) FILTER (WHERE s = 3) AS h3 FROM hv GROUP BY d),
  dr AS (SELECT bx.*, d, h1 % n AS i1, (h1 % n + 1 + h2 % (n - 1)) % n AS i2, (h1 % n + 1 + h3 % (n - 1)) % n AS i3 FROM bx, hw),
  tri AS (SELECT dr.*, a.x AS x1, a.t * a.t AS y1, b.x AS x2, b.t * b.t AS y2, c.x AS x3, c.t * c.t AS y3 FROM dr
     JOIN pts a ON a.line_id = dr.line_id AND a.channel = dr.channel AND a.box_id = dr.box_id AND a.i = i1 JOIN pts b ON b.line_id = dr.line_id AND b.channel = dr.channel AND b.box_id = dr.box_id AND b.i = i2
     JOIN pts c ON c.line_id = dr.line_id AND c.channel = dr.channel AND c.box_id = dr.box_id AND c.i = i3 WHERE i2 <> i3),
  q1 AS (SELECT *, (y2 - y1) / (x2 - x1) AS d1, (y3 - y2) / (x3 - x2) AS d2 FROM tri), q2 AS (SELECT *, (d2 - d1) / (x3 - x1) AS c FROM q1), q3 AS (SELECT *, d1 - c * (x1 + x2) AS b FROM q2),
  q4 AS (SELECT line_id, channel, box_id, n, mid, d, b, c, y1 - x1 * (b + c * x1) AS a FROM q3), q5 AS (SELECT *, -b / (2 * c) AS ap, a - b * b / (4 * c) AS fl FROM q4 WHERE c > 1e-9),
  vote AS (SELECT q5.line_id, q5.channel, q5.box_id, q5.n, q5.mid, d, ap, fl, c, count(*) FILTER (WHERE abs(p.t - sqrt(fl + c * (p.x - ap) * (p.x - ap))) < 4.0) AS votes FROM q5 JOIN pts p USING (line_id, channel, box_id) WHERE fl >= 0 GROUP BY ALL),
  best AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY line_id, channel, box_id ORDER BY votes DESC, d) = 1),
  inl AS (SELECT b.line_id, b.channel, b.box_id, b.n, b.mid, b.votes, p.x, p.t FROM best b JOIN pts p USING (line_id, channel, box_id) WHERE b.votes >= greatest(6, ceil(0.35 * b.n)) AND abs(p.t - sqrt(fl + c * (p.x - ap) * (p.x - ap))) < 4.0),
  sm AS (SELECT line_id, channel, box_id, n, mid, votes, count(*) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(t*t) AS u0, sum(t*t*x) AS u1, sum(t*t*x*x) AS u2, avg(t) AS tm FROM inl GROUP BY ALL),
  dt AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM sm),
  co AS (SELECT *, (u0*(s2*s4-s3*s3) - s1*(u1*s4-s3*u2) + s2*(u1*s3-s2*u2)) / det AS a, (s0*(u1*s4-s3*u2) - u0*(s1*s4-s3*s2) + s2*(s1*u2-u1*s2)) / det AS b, (s0*(s2*u2-u1*s3) - s1*(s1*u2-u1*s2) + u0*(s1*s3-s2*s2)) / det AS c FROM dt),
  ft AS (SELECT *, -b / (2 * c) AS x0, a - b * b / (4 * c) AS fl FROM co WHERE c > 1e-9),
  fits0 AS (SELECT f.line_id, f.channel, f.box_id, f.mid + f.x0 AS x0, sqrt(f.fl) AS t0, 1 / sqrt(f.c) AS k, CASE WHEN sum((i.t - f.tm) * (i.t - f.tm)) > 0 THEN 1 - sum(pow(i.t - sqrt(f.fl + f.c * pow(i.x - f.x0, 2)), 2)) / sum((i.t - f.tm) * (i.t - f.tm)) ELSE 0 END AS r2,
     f.votes AS n_inliers, f.n AS n_total FROM ft f JOIN inl i USING (line_id, channel, box_id) WHERE f.fl >= 0 GROUP BY f.line_id, f.channel, f.box_id, f.mid, f.x0, f.fl, f.c, f.tm, f.votes, f.n)"""


_FITS = _fit_sql(_RIDGE, P.RANSAC_DRAWS)
_ARCH_FITS = _fit_sql("ridge AS (SELECT * FROM arch_points)", P.RANSAC_DRAWS)


@query("D06_robust_hyperbola_fit", f"WITH {_ARCH_FITS} SELECT box_id, round(x0, 3) + 0.0 AS x0, round(t0, 3) AS t0, round(k, 3) AS k, round(r2, 3) + 0.0 AS r2, CAST(n_inliers AS INTEGER) AS n_inliers, CAST(n_total AS INTEGER) AS n_total FROM fits0")
def _(spark, sf):
    f = T.fit_hyperbolas(V.arch_points(spark, sf), ["box_id"]).filter(C("k").isNotNull())
    return f.select("box_id", r("x0", "x0", 3), r("t0", "t0", 3), r("k", "k", 3), r("r2", "r2", 3), "n_inliers", "n_total")


_PHYS = f"""{_ARCH_FITS}, ph AS (SELECT *, 2 * k * 0.025 / 0.4 AS velocity, t0 * 0.4 AS apex_ns FROM fits0),
  rg AS (SELECT *, CASE WHEN velocity <= 0.2998 THEN pow(0.2998 / velocity, 2) ELSE 1.0 END AS eps, CASE WHEN velocity <= 0.2998 THEN velocity * apex_ns / 2 ELSE 0.0 END AS depth FROM ph),
  rj AS (SELECT *, CASE WHEN velocity > 0.2998 THEN 'faster_than_light' WHEN apex_ns < 3.07 THEN 'direct_wave' WHEN t0 > 0.9 * 54 THEN 'record_end' WHEN n_inliers < 8 THEN 'few_inliers' WHEN eps >= 90 THEN 'implausible_permittivity' END AS reason FROM rg)"""


@query("D07_region_fits", f"WITH {_PHYS} SELECT box_id, round(velocity, 3) AS velocity, round(eps, 2) AS dielectric, round(depth, 3) AS depth_m, reason FROM rj")
def _(spark, sf):
    p = V.arch_points(spark, sf)
    lines = p.select(*LINE).distinct().select(*LINE, F.lit(0.4).alias("dt"), F.lit(0.025).alias("spacing"), F.lit(54).alias("n_samples"))
    return T.physical_fits(p, [*LINE, "box_id"], lines).select("box_id", r("velocity", "velocity", 3), r("dielectric", "dielectric", 2), r("depth_m", "depth_m", 3), "reason")


_COH = """coh AS (SELECT b.line_id, b.channel, b.box_id, coalesce(avg(c), 0.0) AS coherence FROM boxes b LEFT JOIN (
    SELECT b.line_id, b.channel, b.box_id, p.trace, CASE WHEN stddev_pop(p.amp) > 1e-9 AND stddev_pop(q.amp) > 1e-9 THEN corr(p.amp, q.amp) END AS c FROM boxes b
      JOIN samples p ON p.line_id = b.line_id AND p.channel = b.channel AND p.trace >= b.x AND p.trace < b.x + b.w - 1 AND p.sample >= b.y AND p.sample < b.y + b.h
      JOIN samples q ON q.line_id = p.line_id AND q.channel = p.channel AND q.trace = p.trace + 1 AND q.sample = p.sample GROUP BY ALL) c USING (line_id, channel, box_id) GROUP BY b.line_id, b.channel, b.box_id)"""


@query("A21_local_coherence", f"WITH {_COH} SELECT line_id, channel, box_id, round(coherence, 6) + 0.0 AS coherence FROM coh")
def _(spark, sf):
    return D.local_coherence(V.traces(spark, sf), V.boxes(spark, sf)).withColumn("coherence", F.round("coherence", 6))


@query("D08_shape_diagnosis", f"""WITH {_FITS}, {_COH}, pk AS (SELECT b.line_id, b.channel, b.box_id, max(n.amp) AS peak FROM boxes b JOIN norm n ON n.line_id = b.line_id AND n.channel = b.channel AND n.trace >= b.x AND n.trace < b.x + b.w AND n.sample >= b.y AND n.sample < b.y + b.h GROUP BY ALL),
  sh AS (SELECT b.line_id, b.channel, b.box_id, peak, CASE WHEN r2 >= 0.85 THEN 'point' WHEN greatest(w, h) / least(w, h) >= 2.0 AND (r2 IS NULL OR r2 < 0.5) THEN 'linear' WHEN coherence < 0.3 THEN 'disturbed' ELSE 'ambiguous' END AS shape
    FROM boxes b LEFT JOIN fits0 f USING (line_id, channel, box_id) JOIN coh USING (line_id, channel, box_id) LEFT JOIN pk USING (line_id, channel, box_id))
  SELECT line_id, channel, box_id, shape, CASE shape WHEN 'point' THEN CASE WHEN peak >= 4 THEN 'clear_point_reflector' ELSE 'low_snr_point_reflector' END WHEN 'linear' THEN 'elongated_linear_target' WHEN 'disturbed' THEN 'disturbed_zone' END AS suggested_class FROM sh""")
def _(spark, sf):
    n, boxes = normalized(spark, sf), V.boxes(spark, sf)
    peaks = D.box_slices(n, boxes).groupBy(*LINE, "box_id").agg(F.max(F.array_max("part")).alias("peak"))
    fits = T.physical_fits(D.ridge_points(n, boxes), [*LINE, "box_id"], V.line_table(spark, sf).select(*LINE, "dt", "spacing", "n_samples"))
    return T.diagnose(boxes, fits, D.local_coherence(V.traces(spark, sf), boxes), peaks).select(*LINE, "box_id", "shape", "suggested_class")


@query("D09_class_refinement", """
  WITH p AS (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM shape_detections WHERE shape = 'point_reflector'),
  g AS (SELECT *, x - lag(x) OVER (PARTITION BY frame_id ORDER BY x, detection_id) AS gap FROM p),
  rr AS (SELECT frame_id, count(*) >= 3 AND coalesce(avg(gap) > 0 AND stddev_pop(gap) / avg(gap) < 0.25 AND (max(y) - min(y)) / 640 < 0.1, false) AS regular FROM g GROUP BY frame_id)
  SELECT d.detection_id, CASE shape WHEN 'linear_reflector' THEN 'elongated_linear_target' WHEN 'disturbed_or_void' THEN CASE WHEN coalesce(same_polarity, false) THEN 'cavities' ELSE 'disturbed_zone' END
    ELSE CASE WHEN EXISTS (SELECT 1 FROM shape_detections l WHERE l.frame_id = d.frame_id AND l.shape = 'linear_reflector' AND d.x1 < l.x2 AND l.x1 < d.x2 AND d.y1 < l.y2 AND l.y1 < d.y2) THEN 'intersecting_linear_and_point_reflector'
      WHEN rr.regular THEN 'multiple_point_reflectors' WHEN (SELECT count(*) - 1 FROM p q WHERE q.frame_id = d.frame_id AND abs(q.x - (d.x1 + d.x2) / 2) <= 96.0) >= 2 THEN 'cluttered_multi_target'
      WHEN peak >= 4.0 THEN 'clear_point_reflector' ELSE 'low_snr_point_reflector' END END AS class_name
  FROM shape_detections d LEFT JOIN rr USING (frame_id) WHERE shape <> 'unknown_shape'""")
def _(spark, sf):
    return refine.refine_classes(V.shape_detections(spark, sf), 640.0, 640.0).select("detection_id", "class_name")


@query("A25_box_amplitude", """
  SELECT b.line_id, b.channel, b.box_id, round(avg(abs(s.amp)), 6) AS amplitude FROM boxes b JOIN samples s ON s.line_id = b.line_id AND s.channel = b.channel AND s.trace >= b.x AND s.trace < b.x + b.w AND s.sample >= b.y AND s.sample < b.y + b.h GROUP BY ALL""")
def _(spark, sf):
    return D.box_amplitude(V.traces(spark, sf), V.boxes(spark, sf)).withColumn("amplitude", F.round("amplitude", 6))


@query("A26_relative_amplitude", """
  WITH a AS (SELECT b.line_id, b.channel, b.box_id, avg(abs(s.amp)) AS amplitude FROM boxes b JOIN samples s ON s.line_id = b.line_id AND s.channel = b.channel AND s.trace >= b.x AND s.trace < b.x + b.w AND s.sample >= b.y AND s.sample < b.y + b.h GROUP BY ALL)
  SELECT line_id, channel, box_id, round(amplitude / quantile_cont(amplitude, 0.5) OVER (PARTITION BY line_id), 6) AS relative FROM a""")
def _(spark, sf):
    a = D.box_amplitude(V.traces(spark, sf), V.boxes(spark, sf))
    return D.relative_amplitude(a, 1000).withColumn("relative", F.round("relative", 6))


def _polarity_sql(coherent: float, noise: bool) -> str:
    extra = "AND strength >= 3.0 * noise" if noise else ""
    return f"""WITH {DEMEANED}, mt AS (SELECT line_id, channel, sample, avg(amp) AS m FROM samples GROUP BY ALL),
  ds AS (SELECT line_id, channel, sign(arg_max(m, (abs(m), -sample))) AS direct FROM mt WHERE sample < 15 GROUP BY ALL),
  nz AS (SELECT line_id, channel, quantile_cont(abs(st), 0.5) / 0.6745 / sqrt(2.0) AS noise FROM (SELECT line_id, channel, amp - lag(amp) OVER (PARTITION BY line_id, channel, sample ORDER BY trace) AS st FROM dm) WHERE st IS NOT NULL GROUP BY ALL),
  sk AS (SELECT b.line_id, b.channel, b.box_id, s.sample, avg(s.amp) AS a, max(abs(s.amp)) AS top FROM boxes b JOIN dm s ON s.line_id = b.line_id AND s.channel = b.channel AND s.trace >= b.x AND s.trace < b.x + b.w AND s.sample >= b.y AND s.sample < b.y + b.h GROUP BY ALL),
  be AS (SELECT line_id, channel, box_id, max(abs(a)) AS strength, max(top) AS top FROM sk GROUP BY ALL),
  fi AS (SELECT line_id, channel, box_id, arg_min(sign(a), sample) AS sg FROM sk JOIN be USING (line_id, channel, box_id) WHERE abs(a) >= 0.5 * strength GROUP BY ALL)
  SELECT b.line_id, b.channel, b.box_id, CASE WHEN strength > 0 AND strength >= {coherent} * be.top AND direct <> 0 {extra} THEN sg = direct END AS keeps_polarity
  FROM boxes b LEFT JOIN be USING (line_id, channel, box_id) LEFT JOIN fi USING (line_id, channel, box_id) LEFT JOIN ds USING (line_id, channel) LEFT JOIN nz USING (line_id, channel)"""


@query("D12_echo_polarity", _polarity_sql(0.25, False))
def _(spark, sf):
    return D.box_polarity(V.traces(spark, sf), V.boxes(spark, sf))


@query("D12b_apex_polarity", _polarity_sql(0.3, True))
def _(spark, sf):
    t = V.traces(spark, sf)
    return D.box_polarity(t, V.boxes(spark, sf), 0.3, D.trace_noise(t, largest_line(t)))


@query("A31_self_subtraction_audit", """
  WITH nt AS (SELECT line_id, channel, max(trace) + 1 AS n FROM samples GROUP BY ALL), mt AS (SELECT line_id, channel, sample, avg(amp) AS m FROM samples GROUP BY ALL),
  i AS (SELECT b.line_id, b.channel, b.box_id, s.sample, sum(s.amp) AS su, count(*) AS c, max(s.amp) AS hi, min(s.amp) AS lo FROM boxes b JOIN samples s ON s.line_id = b.line_id AND s.channel = b.channel AND s.trace >= b.x AND s.trace < b.x + b.w AND s.sample >= b.y AND s.sample < b.y + b.h GROUP BY ALL),
  j AS (SELECT *, (m * n - su) / (n - c) AS mx FROM i JOIN nt USING (line_id, channel) JOIN mt USING (line_id, channel, sample) WHERE n - c >= 10),
  p AS (SELECT line_id, channel, box_id, max(greatest(abs(hi - m), abs(lo - m))) AS f, max(greatest(abs(hi - mx), abs(lo - mx))) AS e FROM j GROUP BY ALL)
  SELECT line_id, channel, box_id, round(100.0 * (e - f) / e, 5) + 0.0 AS loss_percent FROM p WHERE e > 0""")
def _(spark, sf):
    t = V.traces(spark, sf)
    return D.self_subtraction_loss(t, V.boxes(spark, sf), line_lengths(t)).withColumn("loss_percent", F.round("loss_percent", 5))


def _frame(fn: str, col: str, along: str, size: int, src: str) -> str:
    by = "trace" if along == "sample" else "sample"
    return f"SELECT line_id, channel, trace, sample, {fn}({col}) OVER (PARTITION BY line_id, channel, {by} ORDER BY {along} ROWS BETWEEN {size // 2} PRECEDING AND {size - 1 - size // 2} FOLLOWING) AS v FROM {src}"


_MASK = f"""{NORMALIZED}, sc AS (SELECT line_id, channel, quantile_cont(amp, 0.995) AS scale FROM norm WHERE amp > 0 GROUP BY ALL),
  gr AS (SELECT n.line_id, n.channel, n.trace, n.sample, floor(least(n.amp / scale * 255, 255.0)) AS g FROM norm n JOIN sc USING (line_id, channel)),
  ct AS (SELECT line_id, channel, floor(quantile_cont(g, 0.82)) AS cut FROM gr WHERE g > 0 GROUP BY ALL),
  m0 AS (SELECT line_id, channel, trace, sample, CASE WHEN g > cut THEN 1 ELSE 0 END AS v FROM gr JOIN ct USING (line_id, channel)),
  m1 AS ({_frame('max', 'v', 'sample', 9, 'm0')}), m2 AS ({_frame('max', 'v', 'trace', 5, 'm1')}), m3 AS ({_frame('min', 'v', 'sample', 9, 'm2')}), m4 AS ({_frame('min', 'v', 'trace', 5, 'm3')}),
  m5 AS ({_frame('min', 'v', 'sample', 3, 'm4')}), m6 AS ({_frame('min', 'v', 'trace', 3, 'm5')}), m7 AS ({_frame('max', 'v', 'sample', 3, 'm6')}), mask AS ({_frame('max', 'v', 'trace', 3, 'm7')})"""


@query("D01_energy_mask", f"WITH {_MASK} SELECT line_id, channel, trace, CAST(sum(v) AS BIGINT) AS n_set, CAST(sum(v * sample) AS BIGINT) AS sample_sum FROM mask GROUP BY ALL")
def _(spark, sf):
    t = V.traces(spark, sf)
    m = R.samples_of(D.energy_mask(t, largest_line(t)), "v")
    return m.groupBy(*LINE, "trace").agg(F.sum("v").cast("long").alias("n_set"), F.sum(C("v") * C("sample")).cast("long").alias("sample_sum"))


@query("D01_D13_energy_candidates", f"""WITH RECURSIVE {_MASK},
  rn AS (SELECT line_id, channel, trace, min(sample) AS s0, max(sample) AS s1 FROM (SELECT *, sample - row_number() OVER (PARTITION BY line_id, channel, trace ORDER BY sample) AS g FROM mask WHERE v > 0) GROUP BY line_id, channel, trace, g),
  ed AS MATERIALIZED (SELECT a.line_id, a.channel, a.trace * 100 + a.s0 AS u, b.trace * 100 + b.s0 AS v FROM rn a JOIN rn b ON a.line_id = b.line_id AND a.channel = b.channel AND b.trace = a.trace + 1 AND a.s0 <= b.s1 + 1 AND b.s0 <= a.s1 + 1),
  bo AS MATERIALIZED (SELECT * FROM ed UNION ALL SELECT line_id, channel, v, u FROM ed),
  re AS (SELECT line_id, channel, trace * 100 + s0 AS root, trace * 100 + s0 AS node FROM rn UNION SELECT re.line_id, re.channel, re.root, bo.v FROM re JOIN bo ON bo.line_id = re.line_id AND bo.channel = re.channel AND bo.u = re.node),
  lb AS (SELECT line_id, channel, node, min(root) AS comp FROM re GROUP BY ALL),
  bx AS (SELECT line_id, channel, min(trace) AS x, min(s0) AS y, max(trace) - min(trace) + 1 AS w, max(s1) - min(s0) + 1 AS h FROM rn JOIN lb USING (line_id, channel) WHERE lb.node = trace * 100 + s0 GROUP BY line_id, channel, comp)
  SELECT line_id, channel, x, y, w, h FROM bx WHERE w >= 8 AND h >= 5 AND w * h >= 150 AND NOT (greatest(w, h) / least(w, h) > 4.0 AND least(w, h) < 15)""")
def _(spark, sf):
    t = V.traces(spark, sf)
    return D.energy_candidates(t, largest_line(t))


_CLUSTER = """sp AS (SELECT line_id, position_m, depth_m, count(*) AS n FROM apexes GROUP BY ALL),
  nr AS MATERIALIZED (SELECT a.line_id, a.position_m AS p, a.depth_m AS d, b.position_m AS p2, b.depth_m AS d2, b.n AS n2 FROM sp a JOIN sp b ON a.line_id = b.line_id AND abs(a.position_m - b.position_m) <= 0.3 AND abs(a.depth_m - b.depth_m) <= 0.35),
  co AS MATERIALIZED (SELECT line_id, p, d FROM nr GROUP BY ALL HAVING sum(n2) >= 2),
  re AS (SELECT line_id, p AS rp, d AS rd, p, d FROM co UNION SELECT re.line_id, rp, rd, nr.p2, nr.d2 FROM re JOIN nr ON nr.line_id = re.line_id AND nr.p = re.p AND nr.d = re.d JOIN co ON co.line_id = nr.line_id AND co.p = nr.p2 AND co.d = nr.d2),
  lb AS (SELECT line_id, p AS position_m, d AS depth_m, min((rp, rd)) AS cluster FROM re GROUP BY ALL),
  mb AS (SELECT a.*, lb.cluster FROM apexes a JOIN lb ON a.line_id = lb.line_id AND a.position_m = lb.position_m AND a.depth_m = lb.depth_m)"""


@query("D11_D13_corroboration_clusters", f"WITH RECURSIVE {_CLUSTER} SELECT line_id, apex_id, channel, count(*) OVER (PARTITION BY line_id, cluster) AS members FROM mb")
def _(spark, sf):
    c = K.clusters(V.apexes(spark, sf))
    n = c.groupBy("line_id", "cluster").agg(F.count("*").alias("members"))
    return c.join(n, ["line_id", "cluster"]).select("line_id", "apex_id", "channel", "members")


_SUMMARY = f"""{_CLUSTER},
  ch AS (SELECT line_id, cluster, channel, arg_max(dielectric, (n_inliers, -apex_id)) FILTER (WHERE dielectric > 0) AS eps FROM mb GROUP BY ALL),
  ce AS (SELECT line_id, cluster, max(eps) / min(eps) AS ratio, count(*) AS n_channels FROM ch GROUP BY ALL),
  cs AS (SELECT line_id, cluster, count(*) AS members, list_sort(list(DISTINCT channel)) AS channels, avg(position_m) AS pos, avg(depth_m) AS dep, max(position_m) - min(position_m) AS ps, max(depth_m) - min(depth_m) AS ds FROM mb GROUP BY ALL)"""


@query("A20_K07_cluster_summary", f"""WITH RECURSIVE {_SUMMARY} SELECT line_id, channels, members, round(pos, 8) AS position_m, round(dep, 8) AS depth_m, round(ps, 6) AS position_spread_m, round(ds, 6) AS depth_spread_m,
   round(ratio, 6) AS permittivity_ratio, n_channels >= 2 AND coalesce(ratio <= 2.0, true) AS corroborated FROM cs JOIN ce USING (line_id, cluster)""")
def _(spark, sf):
    s = K.summarise(K.clusters(V.apexes(spark, sf)))
    s = s.orderBy(F.desc(F.size("channels")), F.desc("members"), "line_id", "position_m", "depth_m")
    return s.select("line_id", "channels", "members", r("position_m", "position_m", 8), r("depth_m", "depth_m", 8), r("position_spread_m", "position_spread_m"),
                    r("depth_spread_m", "depth_spread_m"), r("permittivity_ratio", "permittivity_ratio"), "corroborated")


@query("D11_run_lines", None)
def _(spark, sf):
    return K.run_lines(K.clusters(V.apexes(spark, sf))).select("line_id", "cluster", r("slope", "slope"), r("residual_m", "residual_m"))


def arch_apexes(spark, sf):
    """Three apexes per channel of each line, spread over it."""
    l = V.line_table(spark, sf).select(*LINE, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return l.select(*LINE, (C("line_id") * 100 + C("k")).alias("apex_id"), (10 + C("k") * 9).cast("int").alias("trace"), (12 + C("k") * 6).cast("int").alias("sample"))


_EPS = ", ".join(f"({i}, CAST({e!r} AS DOUBLE))" for i, e in enumerate(T.SEMBLANCE_EPS))
_SEMB = f"""{DEMEANED}, ap AS (SELECT line_id, channel, line_id * 100 + k AS apex_id, 10 + k * 9 AS t0, 12 + k * 6 AS s0 FROM line_table, range(3) AS q(k)),
  rw AS (SELECT ap.*, e.i, x.trace, CAST(round_even(sqrt(s0 * s0 + pow(2 * (abs(x.trace - t0) * 0.025) / (0.2998 / sqrt(e.eps)) / 0.2, 2)), 0) AS INTEGER) AS row FROM ap
     JOIN (SELECT DISTINCT line_id, channel, trace FROM samples) x ON x.line_id = ap.line_id AND x.channel = ap.channel AND abs(x.trace - t0) <= 30, (VALUES {_EPS}) AS e(i, eps)),
  ok AS (SELECT * FROM rw WHERE row >= 3 AND row + 3 < 64), cn AS (SELECT line_id, channel, apex_id, i, count(*) AS c FROM ok GROUP BY ALL HAVING count(*) >= 10),
  st AS (SELECT ok.line_id, ok.channel, ok.apex_id, ok.i, w.w, sum(s.amp) AS su, sum(s.amp * s.amp) AS sq FROM ok, range(-3, 4) AS w(w), dm s WHERE s.line_id = ok.line_id AND s.channel = ok.channel AND s.trace = ok.trace AND s.sample = ok.row + w.w GROUP BY ALL),
  sv AS (SELECT line_id, channel, apex_id, i, sum(su * su) / (c * sum(sq)) AS s FROM st JOIN cn USING (line_id, channel, apex_id, i) GROUP BY line_id, channel, apex_id, i, c),
  cu AS (SELECT ap.line_id, ap.channel, ap.apex_id, e.i, coalesce(sv.s, 0.0) AS s FROM ap CROSS JOIN (VALUES {_EPS}) AS e(i, eps) LEFT JOIN sv ON sv.line_id = ap.line_id AND sv.channel = ap.channel AND sv.apex_id = ap.apex_id AND sv.i = e.i
     WHERE EXISTS (SELECT 1 FROM rw WHERE rw.line_id = ap.line_id AND rw.channel = ap.channel AND rw.apex_id = ap.apex_id))"""


@query("D15_semblance_curves", f"WITH {_SEMB} SELECT line_id, channel, apex_id, CAST(i AS INTEGER) AS step, round(s, 6) AS semblance FROM cu")
def _(spark, sf):
    t = R.remove_background(V.traces(spark, sf), "mean")
    c = T.semblance_curves(t, arch_apexes(spark, sf))
    return c.select(*LINE, "apex_id", F.posexplode("curve").alias("step", "v")).select(*LINE, "apex_id", "step", r("v", "semblance"))


@query("A27_stacked_permittivity", f"""WITH {_SEMB}, pk AS (SELECT line_id, channel, apex_id, arg_max(i, (s, -i)) AS best, max(s) - least(max(s) FILTER (WHERE i = 0), max(s) FILTER (WHERE i = 40)) AS rise FROM cu GROUP BY ALL),
  gd AS (SELECT * FROM pk WHERE best >= 4 AND best < 37 AND rise >= 0.02),
  sm AS (SELECT cu.channel, cu.i, round(sum(cu.s), 12) AS s FROM cu JOIN gd USING (line_id, channel, apex_id) GROUP BY ALL), bs AS (SELECT channel, arg_max(i, (s, -i)) AS i FROM sm GROUP BY ALL),
  n AS (SELECT pk.channel, count(gd.apex_id) AS arches FROM pk LEFT JOIN gd USING (line_id, channel, apex_id) GROUP BY pk.channel)
  SELECT channel, arches, CASE WHEN arches >= 3 THEN e.eps END AS dielectric, coalesce(CASE WHEN arches >= 3 THEN e.eps > 11.0 END, false) AS wet_ground FROM n LEFT JOIN bs USING (channel) LEFT JOIN (VALUES {_EPS}) AS e(i, eps) ON e.i = bs.i""")
def _(spark, sf):
    t = R.remove_background(V.traces(spark, sf), "mean")
    return T.stacked_permittivity(T.semblance_curves(t, arch_apexes(spark, sf)), ["channel"])


@query("D14_focusing_sweep", None)
def _(spark, sf):
    t = R.remove_background(V.traces(spark, sf), "mean")
    return T.focusing_sweep(t, arch_apexes(spark, sf)).select(*LINE, "apex_id", r("velocity", "velocity"), r("peak_ratio", "peak_ratio"), "well_constrained")


_ARCH = """o AS (SELECT CAST(d AS INTEGER) AS d FROM range(-8, 9, 2) AS q(d)), la AS (SELECT line_id, channel, max(trace) AS last FROM samples GROUP BY ALL),
  cv AS (SELECT s.line_id, s.channel, s.trace, s.sample, quantile_cont(c.amp, 0.3) AS a, quantile_cont(f.amp, 0.3) AS b FROM samples s JOIN la USING (line_id, channel), o,
     samples c, samples f WHERE c.line_id = s.line_id AND c.channel = s.channel AND c.trace = least(greatest(s.trace + d, 0), last) AND c.sample = least(63, CAST(round_even(sqrt(s.sample * 0.05 * (s.sample * 0.05) + d * 0.1 * (d * 0.1)) / 0.05, 0) AS INTEGER))
       AND f.line_id = s.line_id AND f.channel = s.channel AND f.trace = c.trace AND f.sample = s.sample GROUP BY ALL),
  ar AS MATERIALIZED (SELECT line_id, channel, trace, sample, CASE WHEN sample < 5 THEN 0.0 ELSE round(a - b, 6) + 0.0 END AS response FROM cv)"""


def arch_samples(spark, sf):
    return R.samples_of(D.arch_response(V.traces(spark, sf), 0.1, 0.05), "v").select(*LINE, "trace", "sample", r("v", "response"))


@query("D16_hyperbola_response", f"WITH {_ARCH} SELECT line_id, channel, trace, sample, response FROM ar")
def _(spark, sf):
    return arch_samples(spark, sf)


@query("K03_strongest_apart", f"""WITH RECURSIVE {_ARCH},
  pk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY line_id, channel ORDER BY response DESC, sample, trace) AS rk FROM ar WHERE response > 0),
  st AS (SELECT DISTINCT line_id, channel, CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT(c INTEGER, r INTEGER, v DOUBLE)[]) AS kept FROM pk UNION ALL
    SELECT st.line_id, st.channel, p.rk, CASE WHEN len(list_filter(kept, lambda q: pow(q.c - p.trace, 2) + pow(q.r - p.sample, 2) <= 25)) > 0 THEN kept
      ELSE list_append(kept, CAST({{'c': p.trace, 'r': p.sample, 'v': p.response}} AS STRUCT(c INTEGER, r INTEGER, v DOUBLE))) END FROM st JOIN pk p ON p.line_id = st.line_id AND p.channel = st.channel AND p.rk = st.rk + 1 WHERE len(kept) < 10),
  fi AS (SELECT line_id, channel, arg_max(kept, rk) AS kept FROM st GROUP BY line_id, channel), ex AS (SELECT line_id, channel, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept) AS q FROM fi)
  SELECT line_id, channel, CAST(rank AS INTEGER) AS rank, q.c AS col, q.r AS row, q.v AS response FROM ex""")
def _(spark, sf):
    resp = arch_samples(spark, sf).withColumnRenamed("trace", "col").withColumnRenamed("sample", "row")
    return D.strongest_apart(resp, LINE, 5.0, 10).select(*LINE, "rank", "col", "row", r("response", "response"))


@query("D18_image_energy", f"""
  WITH m AS (SELECT line_id, channel, trace, sample, amp - quantile_cont(amp, 0.5) OVER (PARTITION BY line_id, channel, sample) AS x FROM samples), ends AS (SELECT line_id, channel, max(trace) AS last FROM samples GROUP BY ALL),
  tall AS (SELECT a.line_id, a.channel, a.trace, a.sample, sum(b.x * b.x) AS e FROM m a, range(-4, 5) AS o(d), m b WHERE b.line_id = a.line_id AND b.channel = a.channel AND b.trace = a.trace AND b.sample = {_mirror('a.sample + d', '63')} GROUP BY ALL),
  en AS (SELECT a.line_id, a.channel, a.trace, a.sample, sqrt(sum(b.e) / 27) AS e FROM tall a JOIN ends USING (line_id, channel), range(-1, 2) AS o(d), tall b WHERE b.line_id = a.line_id AND b.channel = a.channel AND b.sample = a.sample AND b.trace = {_mirror('a.trace + d', 'ends.last')} GROUP BY a.line_id, a.channel, a.trace, a.sample)
  SELECT line_id, channel, trace, sample, round(e / greatest(quantile_cont(e, 0.5) OVER (PARTITION BY line_id, channel, sample), greatest(quantile_cont(e, 0.5) OVER (PARTITION BY line_id, channel) * 0.15, 1e-6)), 5) AS energy FROM en""")
def _(spark, sf):
    t = V.traces(spark, sf)
    return R.samples_of(T.image_energy(t, largest_line(t)), "v").select(*LINE, "trace", "sample", r("v", "energy", 5))


@query("D17_A30_screenshot_velocity", f"""WITH {_ARCH_FITS}, v AS (SELECT *, 0.02 / (0.05 * k) AS ratio FROM fits0)
  SELECT box_id, round(ratio, 3) AS velocity_ratio, CASE WHEN r2 < 0.95 THEN 'poor fit' WHEN NOT (7.3 * ratio * ratio BETWEEN 1.0 AND 90.0) THEN 'impossible dielectric' END AS rejected FROM v""")
def _(spark, sf):
    f = T.screenshot_velocity(T.fit_hyperbolas(V.arch_points(spark, sf), ["box_id"]), 7.3, F.lit(0.05), F.lit(0.02))
    return f.select("box_id", r("velocity_ratio", "velocity_ratio", 3), "rejected")


@query("J24_empty_stretches", """
  WITH w AS (SELECT line_id, s AS start FROM (SELECT line_id, max(trace) + 160 AS n FROM channel_picks GROUP BY line_id), range(0, 2000, 32) AS q(s) WHERE s <= n - 128)
  SELECT line_id, start FROM w WHERE NOT EXISTS (SELECT 1 FROM channel_picks p WHERE p.line_id = w.line_id AND p.strength >= 60.0 AND p.trace * 4 + 24 >= w.start AND p.trace * 4 - 24 <= w.start + 127)""")
def _(spark, sf):
    p = V.channel_picks(spark, sf)
    lines = p.groupBy("line_id").agg((F.max("trace") + 160).cast("long").alias("n_traces"))
    return D.empty_stretches(lines, p.withColumn("trace", C("trace") * 4), strong=60.0)


@query("J27_circle_hits", """
  SELECT c.finding_id, EXISTS (SELECT 1 FROM findings b WHERE b.frame_id = c.frame_id AND b.class_name <> 'cavities' AND pow((b.x1 + b.x2) / 2 - c.x1, 2) + pow((b.y1 + b.y2) / 2 - c.y1, 2) <= 2500) AS hit FROM findings c WHERE c.class_name = 'cavities'""")
def _(spark, sf):
    from strata.operators.evaluate import circle_hits

    f = V.findings(spark, sf)
    circles = f.filter(C("class_name") == "cavities").select("finding_id", "frame_id", C("x1").alias("cx"), C("y1").alias("cy"), F.lit(50.0).alias("radius"))
    return circle_hits(circles, f.filter(C("class_name") != "cavities"), ["frame_id"])


@query("D19_credible_detections", None)
def _(spark, sf):
    t = V.traces(spark, sf)
    d = T.credible_detections(t, V.line_table(spark, sf).select(*LINE, "dt", "spacing", "n_samples"), largest_line(t))
    return d.select(*LINE, "x", "y", "w", "h", "reason", r("confidence", "confidence"))


_FLAG = f"""WITH bg AS (SELECT line_id, channel, trace, sample, amp - avg(amp) OVER (PARTITION BY line_id, channel, sample) AS x FROM samples),
  e AS (SELECT *, x * x AS p FROM bg), nm AS (SELECT *, p / greatest(quantile_cont(p, 0.5) OVER (PARTITION BY line_id, channel, sample), 1e-12) AS v FROM e),
  pk AS (SELECT *, max(v) OVER (PARTITION BY line_id, channel, trace ORDER BY sample ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m1 FROM nm),
  pe AS (SELECT *, max(m1) OVER (PARTITION BY line_id, channel, sample ORDER BY trace ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) AS m2 FROM pk),
  top AS (SELECT * FROM pe WHERE v = m2 QUALIFY row_number() OVER (PARTITION BY line_id, channel ORDER BY v DESC, sample, trace) <= 5),
  det AS (SELECT line_id, channel, CASE WHEN v >= 30 THEN 'clear_point_reflector' WHEN v >= 20 THEN 'cavities' ELSE 'low_snr_point_reflector' END AS class_name, least(v / 40, 1.0) AS confidence FROM top),
  rk AS (SELECT line_id, channel, avg(CASE class_name WHEN 'clear_point_reflector' THEN 0.7 WHEN 'cavities' THEN 0.9 ELSE 0.4 END * confidence) AS score FROM det GROUP BY ALL)
  SELECT d.line_id, d.class_name, CASE WHEN score < 0.35 THEN 'LOW' WHEN score < 0.65 THEN 'MEDIUM' ELSE 'HIGH' END AS level, count(*) AS n, round(avg(confidence), 5) AS confidence FROM det d JOIN rk USING (line_id, channel) GROUP BY ALL"""


@query("survey_risk_from_traces", _FLAG)
def _(spark, sf):
    import numpy as np

    from strata.operators.lines import map_tiles
    from strata.operators.quantiles import group_quantiles

    t = V.traces(spark, sf)
    e = R.remove_background(t, "mean").withColumn("samples", F.transform("samples", lambda x: x * x))
    med = group_quantiles(R.samples_of(e, "p"), [*LINE, "sample"], "p", {"med": 0.5}, largest_line(t))
    row = med.groupBy(*LINE).agg(F.map_from_entries(F.collect_list(F.struct("sample", "med"))).alias("m"))
    n = e.join(row, LINE).withColumn("samples", F.transform("samples", lambda x, i: x / F.greatest(F.try_element_at("m", i), F.lit(1e-12)))).drop("m")
    peak = lambda block, first, count, row: np.where(block >= D.window_max(D.window_max(block, 10, 0), 16, 1), block, -1.0)
    p = R.samples_of(map_tiles(n, peak, halo=16), "v").filter(C("v") >= 0)
    top = O.top_k(p, LINE, [F.desc("v"), F.asc("sample"), F.asc("trace")], 5)
    det = top.select(*LINE, F.when(C("v") >= 30, "clear_point_reflector").when(C("v") >= 20, "cavities").otherwise("low_snr_point_reflector").alias("class_name"),
                     F.least(C("v") / 40, F.lit(1.0)).alias("confidence"))
    risk = O.risk_by_frame(det, LINE).select(*LINE, "level")
    return det.join(risk, LINE).groupBy("line_id", "class_name", "level").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 5).alias("confidence"))
