"""Queries that put evidence together, and the SQL names of the scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import sql
from strata.operators import evidence as E
from strata.operators.refine import refine_classes
from strata.plans import views as V
from strata.plans.findings import _RISK
from strata.plans.registry import query

C = F.col


@query("G12_evidence_assembly", f"WITH {_RISK}, nb AS (SELECT frame_id, count(*) AS n FROM findings GROUP BY frame_id)" + """
  SELECT finding_id AS detection_id, f.class_name, round(CASE WHEN frame_id % 7 = 0 THEN least(greatest((y1 + y2) / 5 / 256.0, 0.0), 1.0) * 2.0 ELSE (y1 + y2) / 5 * 0.1 * (0.2998 / sqrt(9.0)) / 2 END, 8) AS depth_m,
    CASE WHEN frame_id % 7 <> 0 AND frame_id % 3 = 0 THEN 'calibrated' ELSE 'estimated' END AS depth_confidence, CASE WHEN frame_id % 5 <> 0 THEN round(frame_id % 9 + (x1 + x2) / 4 * 0.025, 8) END AS position_m,
    CASE WHEN finding_id % 4 = 0 THEN 'unavailable' WHEN frame_id % 2 = 0 THEN 'calibrated' ELSE 'estimated' END AS amplitude_confidence, x2 - x1 AS hyperbola_width_px, n - 1 AS n_neighbours,
    1 + finding_id % 3 AS corroborating_channels, r.level AS risk_level, CASE WHEN finding_id % 11 = 0 THEN 'QL-A' ELSE 'ungraded' END AS grade
  FROM findings f JOIN risk r USING (frame_id) JOIN nb USING (frame_id)""")
def _(spark, sf):
    f = V.findings(spark, sf).withColumnRenamed("finding_id", "detection_id")
    d = f.select("detection_id", "frame_id", "class_name", "confidence", "x1", "x2", "y1", "y2", ((C("y1") + C("y2")) / 5).alias("sample"), ((C("x1") + C("x2")) / 4).alias("trace"))
    i = C("frame_id")
    frames = f.select("frame_id").distinct().select(
        "frame_id", F.when(i % 7 != 0, 0.1).alias("dt"), F.lit(256.0).alias("n_samples"), F.lit(9.0).alias("dielectric"), F.lit(0.025).alias("spacing"), (i % 9).cast("double").alias("position"),
        F.when(i % 5 == 0, "unknown").otherwise("wheel_encoder").alias("position_source"), (i % 3 == 0).alias("has_calibrated_depth"), (i % 2 == 0).alias("has_real_position"), (i % 2 == 0).alias("has_true_amplitude"))
    k = C("detection_id")
    e = E.assemble(d, frames, d.filter(k % 4 != 0).select(k, C("confidence").alias("amplitude")), d.select(k, (1 + k % 3).alias("corroborating_channels")))
    e = E.graded(e, k % 11 == 0, F.lit(None).cast("boolean"))
    n = F.aggregate(F.map_values("neighbours"), F.lit(0).cast("long"), lambda a, b: a + b)
    return e.select("detection_id", "class_name", F.round("depth_m", 8).alias("depth_m"), "depth_confidence", F.round("position_m", 8).alias("position_m"), "amplitude_confidence",
                    "hyperbola_width_px", n.alias("n_neighbours"), "corroborating_channels", "risk_level", "grade")


@query("Z02_survey_with_own_detector", None)
def _(spark, sf):
    # Any DataFrame to DataFrame function is a detector; this one refines shapes found elsewhere.
    return E.run_survey(V.shape_detections(spark, sf), lambda t: refine_classes(t, 640.0, 640.0)).select("detection_id", "frame_id", "class_name", "risk_level")


@query("Z07_sql_functions", """
  SELECT line_id, fit_id, round(pow(0.2998 / velocity, 2), 6) AS dielectric, round(velocity * apex_time_ns / 2, 6) AS depth_m FROM fits""")
def _(spark, sf):
    sql.register(spark)
    return V.fits(spark, sf).selectExpr("line_id", "fit_id", "round(dielectric_of_velocity(velocity), 6) AS dielectric", "round(depth_of_time(apex_time_ns, velocity), 6) AS depth_m")
