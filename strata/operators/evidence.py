"""Evidence for every detection: class, measures with their labels, neighbours, channels, risk and grade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.grading import depth_evidence, evidence_summary, position_evidence, quality_label, quality_level
from strata.operators.findings import risk_by_frame, with_neighbour_classes

C = F.col


def assemble(detections: DataFrame, frames: DataFrame, amplitudes: DataFrame, channels: DataFrame) -> DataFrame:
    """One row of evidence per detection.

    detections: detection_id, frame_id, class_name, confidence, x1..y2, sample, trace. frames: frame_id, dt, n_samples, dielectric,
    spacing, position, position_source and what the source vouches for. amplitudes: detection_id, amplitude.
    channels: detection_id, corroborating_channels.
    """
    risk = risk_by_frame(detections).select("frame_id", C("score").alias("risk_score"), C("level").alias("risk_level"), C("rules").alias("risk_rules_fired"))
    j = with_neighbour_classes(detections).join(frames, "frame_id").join(risk, "frame_id").join(amplitudes, "detection_id", "left").join(channels, "detection_id", "left")
    depth = depth_evidence(C("sample"), C("n_samples"), C("dt"), C("dielectric"), C("has_calibrated_depth"))
    position = position_evidence(C("position"), C("position_source"), C("trace"), C("spacing"), C("has_real_position"))
    j = j.withColumn("d", depth).withColumn("p", position).withColumn("corroborating_channels", F.coalesce("corroborating_channels", F.lit(1)))
    amplitude_label = F.when(C("amplitude").isNull(), "unavailable").when(C("has_true_amplitude"), "calibrated").otherwise("estimated")
    return j.select(
        "detection_id", "frame_id", "class_name", "confidence", C("d.value").alias("depth_m"), C("d.label").alias("depth_confidence"), C("p.value").alias("position_m"),
        C("p.label").alias("position_confidence"), "amplitude", amplitude_label.alias("amplitude_confidence"), (C("x2") - C("x1")).alias("hyperbola_width_px"), "neighbours",
        "corroborating_channels", "risk_score", "risk_level", "risk_rules_fired")


def graded(evidence: DataFrame, excavated: Column, post_processed: Column) -> DataFrame:
    """Evidence with its grade and the reason; without an excavation radar alone stays ungraded."""
    none = F.lit(None).cast("string")
    level = quality_level(excavated, none, none, F.lit(False))
    reason = evidence_summary(C("position_confidence"), C("depth_confidence"), C("corroborating_channels"))
    return evidence.withColumn("grade", quality_label(level, post_processed)).withColumn("grade_basis", reason)


def run_survey(traces: DataFrame, detector: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of a survey with any detector that turns traces into rows of detections."""
    detections = detector(traces)
    risk = risk_by_frame(detections).select("frame_id", C("level").alias("risk_level"), C("score").alias("risk_score"))
    return detections.join(risk, "frame_id")
