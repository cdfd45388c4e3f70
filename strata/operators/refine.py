"""From detected shapes to taxonomy classes, frame by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import params as P
from strata.operators.bands import band_aggregate, with_next
from strata.operators.findings import box_overlap_flags

C = F.col
STRETCH_PX = 64.0  # a frame's points are ordered per stretch of its width


def _centres(points: DataFrame) -> DataFrame:
    return points.withColumn("__x", (C("x1") + C("x2")) / 2).withColumn("__y", (C("y1") + C("y2")) / 2)


def regular_rows(points: DataFrame, height: float) -> DataFrame:
    """Per frame: three or more points, evenly spaced and at one depth."""
    gap = C("next___x") - C("__x")
    ordered = with_next(_centres(points), ["frame_id"], ["__x", "detection_id"], ["__x"], STRETCH_PX)
    g = ordered.withColumn("__gap", gap).groupBy("frame_id").agg(
        F.count("*").alias("n"), F.avg("__gap").alias("mean"), F.stddev_pop("__gap").alias("spread"),
        ((F.max("__y") - F.min("__y")) / height).alias("depth_range"))
    even = (C("mean") > 0) & (C("spread") / F.when(C("mean") > 0, C("mean")) < P.ROW_SPACING_CV) & (C("depth_range") < P.ROW_DEPTH_FRACTION)
    return g.select("frame_id", ((C("n") >= P.ROW_MIN_POINTS) & F.coalesce(even, F.lit(False))).alias("regular"), C("n").alias("n_points"))


def crowded_points(points: DataFrame, width: float) -> DataFrame:
    """Points with two or more others within 15% of the image width, counted per distinct place."""
    centred = _centres(points)
    near = band_aggregate(centred, ["frame_id"], "__x", P.CROWD_FRACTION * width, {"near": F.count("*")}, {"near": "sum"})
    flag = centred.join(near, ["frame_id", "__x"]).withColumn("crowded", C("near") - 1 >= P.ROW_MIN_POINTS - 1)
    return flag.drop("__x", "__y", "near")


def refine_classes(detections: DataFrame, width: float, height: float) -> DataFrame:
    """Class and rule per detection. Columns: shape, peak (null if unmeasured), same_polarity (null if unread).

    Taxonomy classes pass through; unknown shapes are dropped.
    """
    points = detections.filter(C("shape") == "point_reflector")
    crossing = box_overlap_flags(points, detections.filter(C("shape") == "linear_reflector")).select("detection_id", F.lit(True).alias("crosses"))
    crowd = crowded_points(points, width).select("detection_id", "crowded")
    rows = regular_rows(points, height)
    d = detections.join(crossing, "detection_id", "left").join(crowd, "detection_id", "left").join(rows, "frame_id", "left")
    shape, taxonomy = C("shape"), C("shape").isin(*P.RISK_WEIGHTS)
    point, linear, area = shape == "point_reflector", shape == "linear_reflector", shape == "disturbed_or_void"
    strong = F.coalesce(C("peak") >= P.STRONG_PEAK, F.lit(False))
    cases = [
        (taxonomy, shape, "already a taxonomy class"),
        (point & C("crosses"), F.lit("intersecting_linear_and_point_reflector"), "overlaps a linear reflector"),
        (point & C("regular"), F.lit("multiple_point_reflectors"), "regular spacing"),
        (point & C("crowded"), F.lit("cluttered_multi_target"), "crowded at irregular spacing"),
        (point & strong, F.lit("clear_point_reflector"), "strong peak"),
        (point, F.lit("low_snr_point_reflector"), "weak or unmeasured peak"),
        (linear, F.lit("elongated_linear_target"), "linear reflector"),
        (area & F.coalesce(C("same_polarity"), F.lit(False)), F.lit("cavities"), "keeps the direct wave's polarity"),
        (area & C("same_polarity").isNull(), F.lit("disturbed_zone"), "polarity not readable"),
        (area, F.lit("disturbed_zone"), "polarity reversed"),
    ]
    name = rule = None
    for when, value, text in cases:
        when = F.coalesce(when, F.lit(False))
        name = F.when(when, value) if name is None else name.when(when, value)
        rule = F.when(when, text) if rule is None else rule.when(when, text)
    out = d.withColumn("class_name", name).withColumn("rule", rule)
    return out.filter(C("class_name").isNotNull()).drop("crosses", "crowded", "regular", "n_points")
