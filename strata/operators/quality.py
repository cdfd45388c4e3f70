"""Row checks: keep the good rows, set the bad ones aside with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import params as P
from strata.functions.physics import usable_dielectric

C = F.col


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first broken rule; null when all hold. A rule that is null counts as broken."""
    reason = None
    for name, holds in rules:
        broken = ~F.coalesce(holds, F.lit(False))
        reason = F.when(broken, name) if reason is None else reason.when(broken, name)
    return reason


def split_valid(rows: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with `reason`): one bad row never stops the rest."""
    marked = rows.withColumn("reason", first_reason(rules))
    return marked.filter(C("reason").isNull()).drop("reason"), marked.filter(C("reason").isNotNull())


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def sane_detections(detections: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    keep = C("class_name").isin(*classes) & (C("x2") > C("x1")) & (C("y2") > C("y1"))
    for c in ("x1", "y1", "x2", "y2"):
        keep = keep & finite(C(c))
    return detections.filter(keep)


def _paired(value: Column, label: Column) -> Column:
    """A value is null exactly when its label says unavailable."""
    return label.isin("calibrated", "estimated", "unavailable") & (value.isNull() == (label == "unavailable"))


def finding_rules() -> list[tuple[str, Column]]:
    return [
        ("depth value and label disagree", _paired(C("depth_m"), C("depth_confidence"))),
        ("position value and label disagree", _paired(C("position_m"), C("position_confidence"))),
        ("confidence outside 0..1", C("confidence").between(0, 1)),
        ("no corroborating channel", C("corroborating_channels") >= 1),
        ("box without extent", (C("x2") > C("x1")) & (C("y2") > C("y1"))),
    ]


def anchor_rules(line_length_m: Column) -> list[tuple[str, Column]]:
    return [
        ("not finite", finite(C("chainage_m")) & finite(C("lat")) & finite(C("lon")) & finite(C("accuracy_m"))),
        ("latitude or longitude out of range", C("lat").between(-90, 90) & C("lon").between(-180, 180)),
        ("chainage off the line", (C("chainage_m") >= -1.0) & (C("chainage_m") <= line_length_m + 1.0)),
        ("accuracy out of range", (C("accuracy_m") > 0) & (C("accuracy_m") <= 100)),
        ("source missing or too long", F.length(F.trim("source")).between(1, 200)),
    ]


def check_anchor_sets(anchors: DataFrame, line_length_m: Column) -> DataFrame:
    """One verdict per line: the first reason its anchors are refused, or null."""
    marked = anchors.withColumn("row_reason", first_reason(anchor_rules(line_length_m)))
    per_line = marked.groupBy("line_id").agg(
        F.count("*").alias("n_points"), F.min("row_reason").alias("row_reason"), F.countDistinct("chainage_m").alias("n_chainages")
    )
    reason = (
        F.when(C("n_points") < 2, "fewer than two reference points")
        .when(C("row_reason").isNotNull(), C("row_reason"))
        .when(C("n_chainages") < C("n_points"), "two reference points share a chainage")
    )
    return per_line.select("line_id", "n_points", reason.alias("reason"))


def pick_rules() -> list[tuple[str, Column]]:
    return [
        ("unknown velocity source", C("velocity_source").isin("fitted", "manual", "assumed")),
        ("velocity not positive", C("velocity_m_per_ns") > 0),
        ("fit quality only with a fit", C("fit_r2").isNotNull() == (C("velocity_source") == "fitted")),
    ]


def field_report_rules() -> list[tuple[str, Column]]:
    def in_range(name: str, lo: float, hi: float) -> Column:
        return C(name).isNull() | (finite(C(name)) & C(name).between(lo, hi))

    return [
        ("unknown outcome", C("outcome").isin("found", "not_found", "dug")),
        ("item of another job", C("item_id").startswith(F.concat(C("job").cast("string"), F.lit("#")))),
        ("no reporter", F.trim("reporter") != ""),
        ("note too long", F.length(F.coalesce("note", F.lit(""))) <= 500),
        ("latitude out of range", in_range("lat", -90, 90)),
        ("longitude out of range", in_range("lon", -180, 180)),
        ("accuracy out of range", in_range("accuracy_m", 0, 10000)),
        ("depth out of range", in_range("depth_found_m", 0, 50)),
    ]


def line_dielectric(lines: DataFrame, header: str) -> DataFrame:
    """The one usable permittivity all channels of a line record, else null."""
    usable = usable_dielectric(C(header))
    agreed = (F.count(usable) == F.count("*")) & (F.min(usable) == F.max(usable))
    return lines.groupBy("line_id").agg(F.when(agreed, F.min(usable)).alias("dielectric"))


def numeric_cells(words: DataFrame) -> DataFrame:
    """Cells that read as a plain number above 0 and below 5."""
    value = F.col("text").try_cast("double")
    return (
        words.filter(C("text").rlike(r"^[0-9]+([.][0-9]+)?$"))
        .select(*[c for c in words.columns if c != "text"], value.alias("value"))
        .filter((C("value") > 0) & (C("value") < 5))
    )


def refuse_broken_lines(samples: DataFrame) -> DataFrame:
    """Drop whole (line, channel)s with a non-finite sample or traces of unequal length."""
    trace = samples.groupBy("line_id", "channel", "trace").agg(
        F.count("*").alias("n"), F.count_if(~finite(C("amp"))).alias("bad")
    )
    broken = trace.groupBy("line_id", "channel").agg(
        F.sum("bad").alias("bad"), F.min("n").alias("shortest"), F.max("n").alias("longest")
    ).filter((C("bad") > 0) | (C("shortest") < C("longest")))
    return samples.join(broken.select("line_id", "channel"), ["line_id", "channel"], "left_anti")


def held_out(rows: DataFrame, site: Column, sites: tuple[str, ...] = P.TEST_SITES) -> DataFrame:
    """Training view: rows of the evaluation sites never leave it."""
    return rows.filter(~site.isin(*sites))
