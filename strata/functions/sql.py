"""The scalar rules under SQL names, for users who write Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strata import params as P

FUNCTIONS = {
    "dielectric_of_velocity(v DOUBLE)": f"CASE WHEN v > 0 THEN pow({P.SPEED_OF_LIGHT_M_PER_NS}D / v, 2) END",
    "velocity_of_dielectric(eps DOUBLE)": f"CASE WHEN eps > 0 THEN {P.SPEED_OF_LIGHT_M_PER_NS}D / sqrt(eps) END",
    "depth_of_time(t_ns DOUBLE, v DOUBLE)": "CASE WHEN t_ns >= 0 AND v > 0 THEN v * t_ns / 2 END",
    "usable_dielectric(header DOUBLE)": f"CASE WHEN header >= {P.MIN_USABLE_DIELECTRIC}D THEN header END",
    "callout_status(depth_m DOUBLE, safe_path_m DOUBLE)": (
        "CASE WHEN depth_m IS NULL THEN 'depth_unread' WHEN safe_path_m IS NULL THEN 'no_safe_path' "
        f"WHEN depth_m * {1 + P.DRAWING_DEPTH_ERROR}D >= safe_path_m THEN 'reaches_safe_path' ELSE 'clear' END"),
}


def register(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        kind = "STRING" if signature.startswith("callout") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
