"""Queries on vendor drawings held as word tables, and on printed points."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import text
from strata.operators import drawings as D
from strata.plans import views as V
from strata.plans.registry import query

C = F.col


def assign_sql(edges: str, keys: list[str], left: str, right: str, order: str) -> str:
    """The in-order one-to-one assignment as a recursion over the sorted edges of each group."""
    by, on = ", ".join(keys), " AND ".join(f"e.{k} = s.{k}" for k in keys)
    mine = ", ".join(f"s.{k}" for k in keys)
    free = f"NOT list_contains(ul, e.{left}) AND NOT list_contains(ur, e.{right})"
    return f"""ek AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {edges}),
  sg AS (SELECT DISTINCT {by}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ul, CAST([] AS BIGINT[]) AS ur FROM ek UNION ALL
    SELECT {mine}, e.k, CASE WHEN {free} THEN list_append(ul, e.{left}) ELSE ul END, CASE WHEN {free} THEN list_append(ur, e.{right}) ELSE ur END FROM sg s JOIN ek e ON {on} AND e.k = s.k + 1),
  asg AS (SELECT {by}, unnest(ul) AS {left}, unnest(ur) AS {right} FROM (SELECT {by}, arg_max(ul, k) AS ul, arg_max(ur, k) AS ur FROM sg GROUP BY {by}))"""


_LINES = r"""dw AS (SELECT *, TRY_CAST(nullif(regexp_extract(text, '^Depth=(\d+\.\d+)m$', 1), '') AS DOUBLE) AS glued FROM draw_words WHERE regexp_matches(text, '^Depth')),
  nu AS (SELECT drawing, word_id, x0, x1, top, bottom, CAST(regexp_extract(text, '^(\d+\.\d+)m$', 1) AS DOUBLE) AS value FROM draw_words WHERE regexp_matches(text, '^\d+\.\d+m$')),
  nn AS (SELECT d.drawing, d.word_id, arg_min(n.value, n.word_id) AS value, arg_min(n.x1, n.word_id) AS nx1, arg_min(n.bottom, n.word_id) AS nb FROM dw d JOIN nu n ON n.drawing = d.drawing AND abs(n.top - d.top) <= 1.5 AND n.x0 - d.x1 BETWEEN 0 AND 15 WHERE d.glued IS NULL GROUP BY ALL),
  dl AS (SELECT d.drawing, d.word_id AS line_id, d.x0, coalesce(nx1, d.x1) AS x1, d.top, greatest(d.bottom, coalesce(nb, d.bottom)) AS bottom, coalesce(glued, nn.value) AS value FROM dw d LEFT JOIN nn ON nn.drawing = d.drawing AND nn.word_id = d.word_id)"""
_NAMES = """nw AS MATERIALIZED (SELECT drawing, word_id, text, x0, x1, top FROM draw_words WHERE text IN ('STORM', 'ELECTRIC', 'WATER', 'SEWER', 'DRAIN', 'UC', 'OFC', 'METALLIC', 'GAS', 'TELECOM')),
  st AS MATERIALIZED (SELECT * FROM nw WHERE text = 'STORM'), wa AS MATERIALIZED (SELECT * FROM nw WHERE text = 'WATER'),
  fs AS MATERIALIZED (SELECT a.drawing, a.word_id, min(b.word_id) AS second, arg_min(b.x1, b.word_id) AS bx1 FROM st a JOIN wa b ON a.drawing = b.drawing AND abs(b.top - a.top) <= 1.5 AND b.x0 - a.x1 BETWEEN 0 AND 6 GROUP BY ALL),
  un AS (SELECT w.drawing, w.word_id, 'STORM WATER' AS utility, w.x0, bx1 AS x1, w.top FROM st w JOIN fs ON fs.drawing = w.drawing AND fs.word_id = w.word_id
    UNION ALL SELECT drawing, word_id, text, x0, x1, top FROM nw w WHERE text <> 'STORM' AND NOT EXISTS (SELECT 1 FROM fs WHERE fs.drawing = w.drawing AND fs.second = w.word_id))"""


@query("J12_depth_lines", f"WITH {_LINES} SELECT drawing, line_id, x1, value FROM dl")
def _(spark, sf):
    return D.depth_lines(V.draw_words(spark, sf)).select("drawing", "line_id", "x1", "value")


@query("J13_utility_names", f"WITH {_NAMES} SELECT drawing, word_id, utility, x1 FROM un")
def _(spark, sf):
    return D.utility_names(V.draw_words(spark, sf)).select("drawing", "word_id", "utility", "x1")


_CALL = f"""{_LINES}, {_NAMES}, ed AS (SELECT n.drawing, n.word_id, n.top, n.x0, l.line_id, l.top - n.top AS gap FROM un n JOIN dl l ON l.drawing = n.drawing AND l.top - n.top BETWEEN 2.5 AND 8.0 AND l.x0 < n.x1 AND n.x0 < l.x1),
  {assign_sql('ed', ['drawing'], 'word_id', 'line_id', 'top, x0, word_id, gap, line_id')}"""


@query("J11_callouts_from_words", f"WITH RECURSIVE {_CALL} SELECT a.drawing, a.word_id, un.utility, dl.value AS depth_m FROM asg a JOIN un ON un.drawing = a.drawing AND un.word_id = a.word_id JOIN dl ON dl.drawing = a.drawing AND dl.line_id = a.line_id")
def _(spark, sf):
    return D.read_callouts(V.draw_words(spark, sf)).select("drawing", "word_id", "utility", "depth_m")


@query("A12_chainage_fit", """
  SELECT drawing, CASE WHEN count(DISTINCT v) >= 2 AND regr_sxx(v, x) > 0 THEN round(regr_slope(v, x), 6) END AS a, CASE WHEN count(DISTINCT v) >= 2 AND regr_sxx(v, x) > 0 THEN round(regr_intercept(v, x), 6) END AS b
  FROM (SELECT drawing, CAST(text[4:] AS INTEGER) AS v, (x0 + x1) / 2 AS x FROM draw_words WHERE text LIKE 'CH-%') GROUP BY drawing""")
def _(spark, sf):
    return D.chainage_fit(V.draw_words(spark, sf)).select("drawing", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("A33_order_is_chainage", """
  WITH t AS (SELECT o_custkey AS drawing, o_orderkey % 5 + 1 AS page, (o_orderkey % 5) * 60 + o_orderkey % 66 AS v FROM orders), l AS (SELECT drawing, max(page) AS lp, count(DISTINCT page) AS np FROM t GROUP BY drawing)
  SELECT drawing, bool_and((page - 1) * 60 - 5 <= v AND (page = lp OR v <= page * 60 + 5)) AND count(DISTINCT page) >= least(3, max(np)) AS in_order FROM t JOIN l USING (drawing) GROUP BY drawing""")
def _(spark, sf):
    o = C("o_orderkey")
    t = V.table(spark, sf, "orders").select(C("o_custkey").alias("drawing"), (o % 5 + 1).alias("page"), F.concat(F.lit("CH-"), F.lpad(((o % 5) * 60 + o % 66).cast("string"), 3, "0")).alias("text"))
    return D.order_is_chainage(t, t.select("drawing", "page").distinct())


@query("G10_drawing_reader", None)
def _(spark, sf):
    found, safe, _ = D.read_drawings(V.draw_words(spark, sf), V.draw_pages(spark, sf))
    return found.join(safe, D.PAGE, "left").select("drawing", "page", "word_id", "utility", "depth_m", "chainage_m", "chainage_source", "safe_path_m")


@query("J14_printed_positions", None)
def _(spark, sf):
    w = V.draw_words(spark, sf)
    kind = C("word_id") % 8
    t = F.when(kind == 0, F.concat(F.lit("Lat12."), (C("word_id") % 997).cast("string"))).when(kind == 1, F.concat(F.lit("Long77."), (C("word_id") % 991).cast("string"))).otherwise(C("text"))
    return D.printed_positions(w.withColumn("text", t)).select("drawing", "word_id", "lat", "lon")


@query("W13_distinct_anchors", """
  WITH RECURSIVE p AS (SELECT DISTINCT 'Road ' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 2 = 0 THEN ' Rhs' ELSE ' Lhs' END AS drawing, (o_orderkey % 97) * 0.4 AS c FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY drawing ORDER BY c) AS rn FROM p),
  s AS (SELECT drawing, c, rn, true AS keep, c AS last FROM k WHERE rn = 1 UNION ALL SELECT k.drawing, k.c, k.rn, k.c - s.last >= 1.0, CASE WHEN k.c - s.last >= 1.0 THEN k.c ELSE s.last END FROM s JOIN k ON k.drawing = s.drawing AND k.rn = s.rn + 1)
  SELECT drawing, round(c, 4) AS chainage_m FROM s WHERE keep""")
def _(spark, sf):
    p = V.printed_points(spark, sf).withColumn("chainage_m", C("chainage_m") / 20.0 * 0.4)
    p = p.select("drawing", "chainage_m", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return D.distinct_anchors(p).select("drawing", F.round("chainage_m", 4).alias("chainage_m"))


@query("G08_misprints_dropped", None)
def _(spark, sf):
    return D.drop_misprints(D.distinct_anchors(V.printed_points(spark, sf))).select("drawing", "chainage_m", F.round("lat", 7).alias("lat"))


@query("A17_drawing_assessment", None)
def _(spark, sf):
    return D.assess_drawings(D.drop_misprints(D.distinct_anchors(V.printed_points(spark, sf))))


@query("G09_J15_callout_placement", None)
def _(spark, sf):
    anchors = D.drop_misprints(D.distinct_anchors(V.printed_points(spark, sf)))
    c = V.callouts(spark, sf)
    road = F.concat(F.lit("Road "), (C("drawing") % 1500).cast("string"), F.when(C("sheet") % 2 == 0, " Rhs").otherwise(" Lhs"))
    found = c.select(road.alias("drawing"), "sheet", "part", "supp", "utility", "depth_m", F.when(C("part") % 9 != 0, ((C("part") % 95) * 20.0)).alias("chainage_m"))
    placed = D.place_callouts(found, D.assess_drawings(anchors), anchors)
    return placed.select("drawing", "sheet", "part", "supp", "why", "borrowed", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "position_error_m")


@query("J15_opposite_side_fallback", """
  WITH d AS (SELECT DISTINCT 'Road ' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 2 = 0 THEN ' Rhs' ELSE ' Lhs' END AS drawing FROM orders),
  c AS (SELECT 'Road ' || CAST(drawing % 1500 AS VARCHAR) || CASE WHEN sheet % 2 = 0 THEN ' Rhs' ELSE ' Lhs' END AS drawing FROM callouts)
  SELECT c.drawing, count(*) AS n, CASE WHEN max(d.drawing) IS NOT NULL THEN 'own' WHEN max(t.drawing) IS NOT NULL THEN 'borrowed' ELSE 'none' END AS points_from FROM c LEFT JOIN d ON d.drawing = c.drawing
  LEFT JOIN d t ON t.drawing = CASE WHEN c.drawing LIKE '%Rhs' THEN replace(c.drawing, 'Rhs', 'Lhs') ELSE replace(c.drawing, 'Lhs', 'Rhs') END GROUP BY c.drawing""")
def _(spark, sf):
    d = V.printed_points(spark, sf).select("drawing").distinct()
    road = F.concat(F.lit("Road "), (C("drawing") % 1500).cast("string"), F.when(C("sheet") % 2 == 0, " Rhs").otherwise(" Lhs"))
    c = V.callouts(spark, sf).groupBy(road.alias("drawing")).agg(F.count("*").alias("n")).withColumn("twin", text.opposite_side(C("drawing")))
    j = c.join(d.withColumn("own", F.lit(True)), "drawing", "left").join(d.select(C("drawing").alias("twin"), F.lit(True).alias("other")), "twin", "left")
    return j.select("drawing", "n", F.when(C("own"), "own").when(C("other"), "borrowed").otherwise("none").alias("points_from"))
