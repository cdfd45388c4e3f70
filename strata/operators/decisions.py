"""Human decisions on targets: standing confirmations, dig items, training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import params as P
from strata.functions.physics import near_surface
from strata.operators.findings import latest_per_key
from strata.operators.bands import band_join

C = F.col
CONFLICT = "decisions on this target conflict (confirmed and later rejected, or confirmed as different things)"


def new_proposals(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Proposals not already waiting for the same target with the same identity, case ignored."""
    waiting = reviews.filter(C("status") == "proposed").select("job", "target_id", F.lower(F.trim("identity")).alias("__id"))
    p = proposals.withColumn("__id", F.lower(F.trim("identity")))
    return p.join(waiting, ["job", "target_id", "__id"], "left_anti").dropDuplicates(["job", "target_id", "__id"]).drop("__id")


def undecided_picks(picks: DataFrame, reviews: DataFrame) -> DataFrame:
    decided = reviews.filter((C("target_kind") == "pick") & (C("status") != "proposed")).select("job", C("target_id").alias("pick_id"))
    return picks.join(decided, ["job", "pick_id"], "left_anti")


def standing_confirmations(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one confirmed review per target, targets whose decisions disagree).

    The latest decision wins; the order of proposal breaks ties.
    """
    keys = ["job", "target_kind", "target_id"]
    decided = reviews.filter(C("status").isin("confirmed", "rejected"))
    order = F.struct("decided_at", "review_id")
    confirmed = C("status") == "confirmed"
    g = decided.groupBy(*keys).agg(
        F.max_by("status", order).alias("latest"), F.count_if(confirmed).alias("n"),
        F.count_distinct(F.when(confirmed, F.lower(F.trim("identity")))).alias("identities"),
        F.max_by("review_id", F.when(confirmed, order)).alias("review_id"), F.max(F.when(confirmed, C("review_id"))).alias("last_confirmed"))
    g = g.filter(C("n") > 0).withColumn("conflict", (C("latest") == "rejected") | (C("identities") > 1))
    standing = reviews.join(g.filter(~C("conflict")).select("job", "review_id"), ["job", "review_id"], "left_semi")
    attention = g.filter("conflict").select("job", C("last_confirmed").alias("ref"), F.lit(CONFLICT).alias("reason"))
    return standing, attention


def dig_items(reviews: DataFrame, picks: DataFrame, boxes: DataFrame, channels: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items to dig with position and depth, decisions that cannot be placed with the reason).

    picks: job, pick_id, channel, trace, sample, velocity, velocity_source. boxes: job, box_id, channel, x, y, w, detector.
    channels: job, channel, dt, spacing, zero_ns, n_traces, line_traces, dielectric. reports: job, item_id, outcome, reported_at.
    """
    standing, conflicts = standing_confirmations(reviews)
    p = picks.select("job", F.lit("pick").alias("target_kind"), C("pick_id").alias("target_id"), C("channel").alias("p_channel"), "trace", "sample", "velocity", "velocity_source")
    b = boxes.select("job", F.lit("candidate").alias("target_kind"), C("box_id").alias("target_id"), C("channel").alias("b_channel"), (C("x") + C("w") / 2).alias("b_trace"), "y", "detector")
    keys = ["job", "target_kind", "target_id"]
    j = standing.join(p, keys, "left").join(b, keys, "left").withColumn("channel", F.coalesce("p_channel", "b_channel")).join(channels, ["job", "channel"], "left")
    is_pick = C("target_kind") == "pick"
    sample = F.when(is_pick, C("sample").cast("double")).otherwise(C("y") + P.BOX_ABOVE_NS / C("dt"))
    velocity = F.when(is_pick, C("velocity")).otherwise(P.SPEED_OF_LIGHT_M_PER_NS / F.sqrt(F.coalesce("dielectric", F.lit(P.DEFAULT_DIELECTRIC))))
    j = j.withColumn("apex_ns", sample * C("dt") - C("zero_ns"))
    reason = (
        F.when(is_pick & C("p_channel").isNull(), "the pick it confirmed has been deleted")
        .when(~is_pick & C("b_channel").isNull(), "the candidate it confirmed is gone")
        .when(~is_pick & (C("detector") != "migration"), "its box does not mark a known apex position")
        .when(C("dt").isNull(), "its channel is no longer in this line")
        .when(C("n_traces") != C("line_traces"), "its channel has its own trace grid")
        .when(C("apex_ns") <= 0, "its time is above the direct wave"))
    j = j.withColumn("reason", reason)
    attention = conflicts.unionByName(j.filter(C("reason").isNotNull()).select("job", C("review_id").alias("ref"), "reason"))
    depth = velocity * C("apex_ns") / 2
    relative = F.when(is_pick & (C("velocity_source") == "fitted"), P.FITTED_RELATIVE_ERROR).otherwise(P.DEPTH_RELATIVE_ERROR)
    trace = F.when(is_pick, C("trace").cast("double")).otherwise(C("b_trace"))
    items = j.filter(C("reason").isNull()).select(
        "job", C("review_id").alias("item_id"), "channel", F.trim("identity").alias("identity"), (trace * C("spacing")).alias("chainage_m"), depth.alias("depth_m"),
        (relative * depth + P.DEPTH_FLOOR_ERROR_M).alias("depth_error_m"), near_surface(C("apex_ns")).alias("near_surface"))
    latest = latest_per_key(reports.select("job", "item_id", "outcome", "reported_at", "report_id"), ["job", "item_id"], ["reported_at", "report_id"])
    return items.join(latest.select("job", "item_id", C("outcome").alias("field_outcome")), ["job", "item_id"], "left"), attention


def suggestion_boxes(suggestions: DataFrame, boxes: DataFrame) -> DataFrame:
    """The stored box each suggestion came from: same line, a channel that saw it, 0.3 m and 1.5 ns, best dx + dt/10."""
    b = boxes.select("line_id", C("box_id"), C("channel").alias("b_channel"), C("position_m").alias("b_position"), C("time_ns").alias("b_time"))
    near = band_join(suggestions, b, ["line_id"], [("position_m", "b_position", 0.3), ("time_ns", "b_time", 1.5)], extra=F.array_contains("channels", C("b_channel")))
    cost = F.abs(C("position_m") - C("b_position")) + F.abs(C("time_ns") - C("b_time")) / 10
    return near.groupBy("line_id", "suggestion_id").agg(F.min_by("box_id", F.struct(cost, C("box_id"))).alias("box_id"))


def parsed_mentions(mentions: DataFrame, targets: DataFrame, materials: tuple[str, ...], certain: tuple[str, ...]) -> DataFrame:
    """Mentions of measured targets: unknown target or material dropped with a reason, certain claims capped."""
    j = mentions.join(targets.select("target_id", F.lit(True).alias("known")), "target_id", "left")
    reason = F.when(C("known").isNull(), "unknown target").when(~C("material").isin(*materials), "unknown material")
    capped = F.when(C("material").isin(*certain), "low").otherwise(C("confidence"))
    return j.withColumn("reason", reason).withColumn("confidence", capped).drop("known")


def training_labels(reviews: DataFrame, picks: DataFrame, reports: DataFrame) -> DataFrame:
    """Every target as positive, negative or unknown.

    Proposals and 'not found' are unknown; found or dug is positive unless decided again later; a decision
    on a pick replaces the pick, and a report filed against the pick reaches its review.
    """
    latest = latest_per_key(reports, ["job", "source_id"], ["reported_at", "report_id"]).select("job", "source_id", "outcome", "reported_at")
    on_pick = reviews.filter((C("target_kind") == "pick") & (C("status") != "proposed"))
    deciding = on_pick.groupBy("job", C("target_id").alias("pick_id")).agg(F.max("review_id").alias("review_id"))
    via = latest.join(deciding.select("job", C("pick_id").alias("source_id"), "review_id"), ["job", "source_id"]).select("job", C("review_id").alias("source_id"), "outcome", "reported_at")
    latest = latest.unionByName(via).groupBy("job", "source_id").agg(F.max(F.struct("reported_at", "outcome")).alias("r"))
    r = reviews.select("job", C("review_id").alias("source_id"), F.lit("review").alias("source"), "decided_at", (C("status") == "confirmed").alias("positive"), (C("status") == "proposed").alias("open"))
    p = undecided_picks(picks, reviews).select("job", C("pick_id").alias("source_id"), F.lit("pick").alias("source"), "decided_at", F.lit(True).alias("positive"), F.lit(False).alias("open"))
    d = r.unionByName(p).join(latest, ["job", "source_id"], "left")
    stands = C("r").isNull() | (C("r.reported_at") < C("decided_at"))
    label = (
        F.when(C("open"), "unknown").when(stands & C("positive"), "positive").when(stands, "negative")
        .when(C("r.outcome") == "not_found", "unknown").otherwise("positive"))
    return d.select("job", "source_id", "source", label.alias("label"), (~C("open") & ~stands & (C("r.outcome") != "not_found")).alias("field_verified"))


def tiles_around(boxes: DataFrame, min_tile: int = 64) -> DataFrame:
    """A tile twice the box's size around each decided box, kept inside the record."""
    width = F.least(C("n_traces"), F.greatest(F.lit(min_tile), F.floor(2 * C("w")))).cast("int")
    height = F.least(C("n_samples"), F.greatest(F.lit(min_tile), F.floor(2 * C("h")))).cast("int")
    clip = lambda v, hi: F.least(F.greatest(v, F.lit(0.0)), hi.cast("double")).cast("int")
    t = boxes.withColumn("__w", width).withColumn("__h", height)
    t = t.withColumn("t0", clip(C("x") + C("w") / 2 - C("__w") / 2, C("n_traces") - C("__w"))).withColumn("s0", clip(C("y") + C("h") / 2 - C("__h") / 2, C("n_samples") - C("__h")))
    return t.withColumn("t1", C("t0") + C("__w")).withColumn("s1", C("s0") + C("__h")).drop("__w", "__h")


def clean_tiles(tiles: DataFrame, open_boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles that touch no undecided box of their channel. Tiles and boxes meet per stretch of 64 traces."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / 64), F.floor(hi / 64)))
    o = open_boxes.select(*[C(k).alias(f"o_{k}") for k in keys], C("x").alias("ox"), C("y").alias("oy"), C("w").alias("ow"), C("h").alias("oh"), cells(C("x"), C("x") + C("w")).alias("o_cell"))
    meets = (C("cell") == C("o_cell")) & (C("ox") < C("t1")) & (C("ox") + C("ow") > C("t0")) & (C("oy") < C("s1")) & (C("oy") + C("oh") > C("s0"))
    for k in keys:
        meets = meets & (C(k) == C(f"o_{k}"))
    touched = tiles.withColumn("cell", cells(C("t0"), C("t1"))).join(o, meets, "left_semi").select(*keys, "tile_id").distinct()
    return tiles.join(touched, [*keys, "tile_id"], "left_anti")


def tile_labels(tiles: DataFrame, positives: DataFrame, keys: list[str]) -> DataFrame:
    """Positive boxes at least half inside a tile, clipped to it and relative to it."""
    cells = lambda lo, hi: F.sequence(F.floor(lo / 64), F.floor(hi / 64))
    p = positives.select(*[C(k).alias(f"p_{k}") for k in keys], C("x").alias("px"), C("y").alias("py"), C("w").alias("pw"), C("h").alias("ph"), C("box_id").alias("label_id"))
    p = p.withColumn("p_cell", F.explode(cells(C("px"), C("px") + C("pw"))))
    meets = C("cell") == C("p_cell")
    for k in keys:
        meets = meets & (C(k) == C(f"p_{k}"))
    x0, y0 = F.greatest("px", "t0"), F.greatest("py", "s0")
    x1, y1 = F.least(C("px") + C("pw"), C("t1")), F.least(C("py") + C("ph"), C("s1"))
    inside = (x1 > x0) & (y1 > y0) & ((x1 - x0) * (y1 - y0) >= 0.5 * C("pw") * C("ph"))
    j = tiles.withColumn("cell", F.explode(cells(C("t0"), C("t1")))).join(p, meets)
    first = F.greatest(F.floor(C("t0") / 64), F.floor(C("px") / 64)) == C("cell")  # each pair is met once
    return j.filter(inside & first).select(*keys, "tile_id", "label_id", (x0 - C("t0")).alias("x"), (y0 - C("s0")).alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
