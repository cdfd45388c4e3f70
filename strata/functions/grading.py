"""Grades, labels and readings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import params as P

# The grade ladder, weakest first.
QUALITY_LADDER = ("QL-D", "QL-C", "QL-B4", "QL-B3", "QL-B2", "QL-B1", "QL-A")
# What contrast and continuity together suggest.
READINGS = {
    "lighter|true": "lighter than the soil and on a run across lines: an air-filled pipe or duct",
    "lighter|false": "lighter than the soil and isolated: a possible void (check records before calling it one)",
    "denser|true": "denser than the soil and on a run across lines: a metal or water-filled pipe",
    "denser|false": "denser than the soil and isolated: a stone, fitting or short object",
}
NOT_ABOVE_CHANCE = " (the runs on this site are not above chance)"


def callout_status(depth: Column, safe_path: Column) -> Column:
    return (
        F.when(depth.isNull(), "depth_unread")
        .when(safe_path.isNull(), "no_safe_path")
        .when(depth * (1 + P.DRAWING_DEPTH_ERROR) >= safe_path, "reaches_safe_path")
        .otherwise("clear")
    )


def risk_level(score: Column, rules: Column) -> Column:
    return (
        F.when(F.size(rules) > 0, "HIGH")
        .when(score < P.RISK_LOW_MAX, "LOW")
        .when(score < P.RISK_MEDIUM_MAX, "MEDIUM")
        .otherwise("HIGH")
    )


def risk_weight(class_name: Column) -> Column:
    pairs = [F.lit(x) for kv in P.RISK_WEIGHTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), class_name), F.lit(P.RISK_DEFAULT_WEIGHT))


def quality_level(excavated: Column, external_level: Column, external_basis: Column, records_only: Column) -> Column:
    """A grade only a person can supply; radar evidence alone stays ungraded."""
    return (
        F.when(excavated, "QL-A")
        .when(external_level.isin(*QUALITY_LADDER) & (F.trim(external_basis) != ""), external_level)
        .when(records_only, "QL-D")
        .otherwise("ungraded")
    )


def quality_label(level: Column, post_processed: Column) -> Column:
    """Only a recorded true earns the P suffix; unknown provenance does not."""
    return F.when(F.coalesce(post_processed, F.lit(False)) & level.startswith("QL-B"), F.concat(level, F.lit("P"))).otherwise(level)


def evidence_summary(position_confidence: Column, depth_confidence: Column, channels: Column) -> Column:
    depth = (
        F.when(depth_confidence == "calibrated", "depth measured from this target's own hyperbola")
        .when(depth_confidence == "estimated", "depth derived from an assumed velocity, not a measured one")
        .otherwise("no depth could be derived")
    )
    agreement = F.when(
        channels >= 2, F.concat(F.lit(", consistent across "), channels.cast("string"), F.lit(" frequency channels"))
    ).otherwise(", seen on a single frequency channel")
    return F.when(
        position_confidence == "unavailable",
        "no along-line position could be derived, so this cannot be placed even on its own line",
    ).otherwise(F.concat(depth, agreement))


def depth_evidence(sample_index: Column, n_samples: Column, dt: Column, eps: Column, calibrated: Column, assumed_max_m: float = 2.0) -> Column:
    """(value, label): a travel-time depth, or a labelled assumption, or unavailable."""
    fraction = F.least(F.greatest(sample_index / n_samples, F.lit(0.0)), F.lit(1.0))
    timed = dt.isNotNull() & eps.isNotNull()
    value = F.when(sample_index.isNull(), None).when(
        timed, sample_index * dt * (P.SPEED_OF_LIGHT_M_PER_NS / F.sqrt(eps)) / 2
    ).otherwise(fraction * assumed_max_m)
    label = F.when(sample_index.isNull(), "unavailable").when(timed & calibrated, "calibrated").otherwise("estimated")
    return F.struct(value.alias("value"), label.alias("label"))


def position_evidence(position: Column, source: Column, centre_trace: Column, spacing: Column, real_position: Column) -> Column:
    known = position.isNotNull() & ~source.isin("synthetic", "unknown")
    value = F.when(known, position + F.coalesce(centre_trace * spacing, F.lit(0.0)))
    label = F.when(~known | known.isNull(), "unavailable").when(real_position, "calibrated").otherwise("estimated")
    return F.struct(value.alias("value"), label.alias("label"))


def post_processed(chain: dict[str, Column]) -> Column:
    """Did any step of the chain alter the samples?"""
    return (
        (chain["time_zero_sample"] != 0)
        | chain["dewow"]
        | (chain["background_removal"] != "none")
        | chain["bandpass"]
        | (chain["gain"] != "none")
        | (chain["stack_traces"] != 1)
        | chain["migrate"]
    )


def contrast_from_votes(n_readable: Column, any_same: Column, any_reversed: Column) -> Column:
    """Two or more readable channels that all agree name a contrast; anything else is unreadable."""
    return (
        F.when((n_readable >= 2) & any_same & ~any_reversed, "lighter")
        .when((n_readable >= 2) & any_reversed & ~any_same, "denser")
        .otherwise("unreadable")
    )


def reading(contrast: Column, on_run: Column, confirmed: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in READINGS.items() for x in kv])
    text = F.try_element_at(table, F.concat(contrast, F.lit("|"), on_run.cast("string")))
    return F.when(text.isNull(), None).when(on_run & ~confirmed, F.concat(text, F.lit(NOT_ABOVE_CHANCE))).otherwise(text)


def sign_test_p(better: Column, worse: Column) -> Column:
    """Two-sided sign test: twice the lower binomial tail, at most 1, from a running binomial term."""
    n = (better + worse).cast("double")
    k = F.least(better, worse)
    term0 = F.pow(F.lit(2.0), -n)
    start = F.struct(term0.alias("term"), term0.alias("total"))
    # term(i) = term(i-1) * (n - i + 1) / i
    fold = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")),
        start,
        lambda acc, i: F.struct(
            (acc["term"] * (n - i + 1) / i).alias("term"), (acc["total"] + acc["term"] * (n - i + 1) / i).alias("total")
        ),
    )
    return F.least(F.lit(1.0), 2 * fold["total"])
