"""Stored findings: risk, summaries, history, neighbours, versions and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata import params as P
from strata.functions.grading import risk_level, risk_weight
from strata.operators.bands import band_aggregate, band_join

C = F.col


def exact_mean(value: Column) -> Column:
    """The mean by a sum of decimals, which does not depend on the order of the rows; of values that decimals cannot hold, the plain mean."""
    exact = value.try_cast("decimal(38,18)")
    kept = F.count(value) == F.count(exact)
    return F.when(kept, F.try_divide(F.try_sum(exact).cast("double"), F.count(value))).otherwise(F.avg(value))


def risk_by_frame(detections: DataFrame, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Mean weight x confidence per frame, the escalation rules it fires, and the level."""
    elongated = (C("class_name") == "elongated_linear_target") & (C("confidence") > P.ELONGATED_CONFIDENCE)
    scored = detections.groupBy(*keys).agg(
        exact_mean(risk_weight(C("class_name")) * C("confidence")).alias("score"),
        F.bool_or(C("class_name") == "cavities").alias("has_cavity"),
        F.bool_or(C("class_name").isin(*P.UTILITY_CLASSES)).alias("has_utility"),
        F.count_if(elongated).alias("n_elongated"),
    )
    rules = F.array_compact(F.array(
        F.when(C("has_cavity") & C("has_utility"), "cavities_with_utility"),
        F.when(C("n_elongated") >= P.ELONGATED_MIN_COUNT, "multiple_high_confidence_elongated"),
    ))
    scored = scored.withColumn("rules", rules)
    return scored.select(*keys, "score", risk_level(C("score"), C("rules")).alias("level"), "rules")


def survey_summary(findings: DataFrame) -> DataFrame:
    """Totals, counts by risk and counts by class per survey in one pass over the findings."""
    by = F.grouping_id()
    return (
        findings.groupingSets([["survey_id"], ["survey_id", "risk_level"], ["survey_id", "class_name"]], "survey_id", "risk_level", "class_name")
        .agg(F.count("*").alias("n"), by.alias("__g"))
        .select(
            "survey_id",
            F.when(C("__g") == 3, "total").when(C("__g") == 1, "risk").otherwise("class").alias("kind"),
            F.when(C("__g") == 3, "all").otherwise(F.coalesce("risk_level", "class_name")).alias("value"), "n",
        )
    )


def confidence_breakdown(findings: DataFrame) -> DataFrame:
    """How many depths and positions are calibrated, estimated, unavailable."""
    long = findings.select("survey_id", F.explode(F.array(
        F.struct(F.lit("depth").alias("field"), C("depth_confidence").alias("label")),
        F.struct(F.lit("position").alias("field"), C("position_confidence").alias("label")))).alias("x")).select("survey_id", "x.*")
    labels = ("calibrated", "estimated", "unavailable")
    return long.groupBy("survey_id", "field").agg(*[F.count_if(C("label") == v).alias(v) for v in labels])


def history_by_risk(findings: DataFrame) -> DataFrame:
    return findings.groupBy("line_id").agg(*[F.count_if(C("risk_level") == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW")])


def prior_passes(findings: DataFrame, probes: DataFrame, tolerance_m: float) -> DataFrame:
    """Findings on a probe's line within the tolerance of its position; unknown positions never match."""
    left = probes.filter(C("probe_position_m").isNotNull())
    right = findings.filter(C("position_m").isNotNull())
    return band_join(left, right, ["line_id"], [("probe_position_m", "position_m", tolerance_m)])


def prior_pass_counts(findings: DataFrame, tolerance_m: float) -> DataFrame:
    """For every place on every line: how many findings lie within the tolerance and the surest of them."""
    return band_aggregate(
        findings, ["line_id"], "position_m", tolerance_m,
        {"n_passes": F.count("*"), "best_confidence": F.max("confidence")},
        {"n_passes": "sum", "best_confidence": "max"},
    )


def latest_per_key(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key. A partial aggregate keeps one row per key and task, however hot."""
    rest = [c for c in events.columns if c not in keys]
    newest = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return newest.select(*keys, *[C("__row")[c].alias(c) for c in rest])


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows per key; Spark trims each task to k per key before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(C("rank") <= k)


def with_neighbour_classes(detections: DataFrame) -> DataFrame:
    """The classes of the other detections of each frame, as counts: itself is taken out by identity."""
    per_class = detections.groupBy("frame_id", "class_name").agg(F.count("*").alias("n"))
    bag = per_class.groupBy("frame_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "n")))).alias("bag"))
    others = F.map_filter(
        F.transform_values("bag", lambda k, n: n - F.when(k == C("class_name"), 1).otherwise(0)), lambda k, n: n > 0
    )
    return detections.join(bag, "frame_id").withColumn("neighbours", others).drop("bag")


def same_target(a: str, b: str) -> Column:
    """Two boxes overlap in depth, and along the line by at least half the narrower one."""
    def col(side: str, name: str) -> Column:
        return C(f"{side}{name}")

    overlap = F.least(col(a, "trace_end"), col(b, "trace_end")) - F.greatest(col(a, "trace_start"), col(b, "trace_start"))
    depth = F.least(col(a, "sample_end"), col(b, "sample_end")) - F.greatest(col(a, "sample_start"), col(b, "sample_start"))
    narrower = F.least(col(a, "trace_end") - col(a, "trace_start"), col(b, "trace_end") - col(b, "trace_start"))
    return (depth > 0) & (overlap >= 0.5 * narrower)


BOX = ("trace_start", "trace_end", "sample_start", "sample_end")


def match_boxes(left: DataFrame, right: DataFrame, how: str, cell: int = 32) -> DataFrame:
    """Join boxes of the same line that mark the same target; `right` comes prefixed with r_.

    Boxes meet in the stretch of line where both their overlap begins, so each pair meets once.
    """
    spans = lambda p: F.sequence(F.floor(C(f"{p}trace_start") / cell), F.floor((C(f"{p}trace_end") - 1) / cell))
    right = right.select(C("line_id").alias("r_line_id"), *[C(c).alias(f"r_{c}") for c in right.columns if c != "line_id"])
    right = right.withColumn("r_cell", F.explode(spans("r_")))
    left = left.withColumn("cell", F.explode(spans("")))
    meets = (C("line_id") == C("r_line_id")) & (C("cell") == C("r_cell"))
    if how in ("left_semi", "left_anti"):
        keys = [c for c in left.columns if c != "cell"]
        found = left.join(right, meets & same_target("", "r_"), "left_semi").drop("cell").dropDuplicates(keys)
        return found if how == "left_semi" else left.drop("cell").dropDuplicates(keys).join(found, keys, "left_anti")
    begins = F.greatest(F.floor(C("trace_start") / cell), F.floor(C("r_trace_start") / cell))
    return left.join(right, meets & same_target("", "r_") & (begins == C("cell"))).drop("cell", "r_cell", "r_line_id")


def box_overlap_flags(points: DataFrame, others: DataFrame, cell: float = 64.0) -> DataFrame:
    """Points of a frame that strictly overlap another kind of box of the same frame.

    Boxes meet per stretch of the frame's width, so a crowded frame is many small joins.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    o = others.select(C("frame_id").alias("o_frame"), *[C(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")], cells(C("x1"), C("x2")).alias("o_cell"))
    meets = (
        (C("frame_id") == C("o_frame")) & (C("cell") == C("o_cell")) & (C("x1") < C("o_x2")) & (C("o_x1") < C("x2")) & (C("y1") < C("o_y2")) & (C("o_y1") < C("y2"))
    )
    return points.withColumn("cell", cells(C("x1"), C("x2"))).join(o, meets, "left_semi").drop("cell").dropDuplicates(["frame_id", "detection_id"])


def replace_detector_rows(stored: DataFrame, fresh: DataFrame, runs: DataFrame, detector: str, version: str) -> DataFrame:
    """A run replaces its own detector's rows and unattributed automatic ones in the jobs it covered.

    An empty run still clears. Rows of people and other detectors stay.
    """
    own = (C("detector") == detector) | (C("detector").isNull() & C("note").startswith("auto:"))
    covered = runs.select("job").distinct().withColumn("__ran", F.lit(True))
    kept = stored.join(covered, "job", "left").filter(~(F.coalesce(C("__ran"), F.lit(False)) & F.coalesce(own, F.lit(False)))).drop("__ran")
    return kept.unionByName(fresh.withColumn("detector", F.lit(detector)).withColumn("detector_version", F.lit(version)), allowMissingColumns=True)


def not_yet_run(lines: DataFrame, runs: DataFrame, detector: str, version: str) -> DataFrame:
    """Lines this detector version has not seen, whether or not it found anything there."""
    done = runs.filter((C("detector") == detector) & (C("detector_version") == version)).select("line_id", "channel")
    return lines.join(done, ["line_id", "channel"], "left_anti")


def apply_events(rows: DataFrame, events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Current rows after add and delete events: the last event of a key decides, tombstones vanish."""
    start = rows.withColumn("action", F.lit("add")).withColumn("seq", F.lit(-1).cast("long"))
    return latest_per_key(start.unionByName(events), [key], order).filter(C("action") == "add").drop("action", "seq")


def write_findings(findings: DataFrame, path: str) -> None:
    """Append the findings that the table does not hold yet: ids depend only on what they mark, so a retry adds nothing."""
    append_new(findings.withColumn("finding_id", finding_key(findings)), path)


def append_new(identified: DataFrame, path: str) -> None:
    """Rows whose finding_id is not in the table under `path`, once each, in the surveys' partitions.

    Only the partitions of the rows' own surveys are read. Streams commit through `streaming.ledger`, which reads nothing back.
    """
    fresh = identified.dropDuplicates(["finding_id"])
    try:
        stored = identified.sparkSession.read.schema(identified.schema).parquet(path)
        fresh = fresh.join(stored.select("survey_id", "finding_id"), ["survey_id", "finding_id"], "left_anti")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.select(*identified.columns).write.mode("append").partitionBy("survey_id").parquet(path)


def finding_key(findings: DataFrame) -> Column:
    """What a finding marks: its place, and the channel and class where the rows have them."""
    return F.xxhash64("survey_id", "line_id", "frame_id", "location", *[c for c in ("channel", "class_name") if c in findings.columns])


def append_reasoning(versions: DataFrame, reasoning: DataFrame) -> DataFrame:
    """Late texts arrive as a new version of a finding; readers take the newest version per id."""
    later = versions.drop("what", "version").join(reasoning, "finding_id").withColumn("version", F.lit(2))
    return versions.unionByName(later.select(*versions.columns))
