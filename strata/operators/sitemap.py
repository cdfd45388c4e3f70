"""The targets of a site from its traces: picked on every channel, fused, placed, measured, and read for contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata import params as P
from strata.functions.physics import away_from_ends, depth_error_m, horizontal_error_m, near_surface
from strata.operators import detect as D
from strata.operators import process as R
from strata.operators.lines import LINE, line_lengths
from strata.operators.placement import gps_tracks, interpolate_held
from strata.operators.quality import line_dielectric
from strata.operators.site import contrast
from strata.session import cut_lineage

C = F.col
TARGET = ["line_id", "target_id"]


def channel_axes(traces: DataFrame, zeros: DataFrame) -> DataFrame:
    """line_id, channel, dt, zero_ns, channel_rank: finest time step first."""
    steps = traces.groupBy(*LINE).agg(F.first("dt").alias("dt")).join(zeros.select(*LINE, "zero_ns"), LINE)
    return steps.withColumn("channel_rank", F.row_number().over(W.partitionBy("line_id").orderBy("dt", "channel")))


def usable_permittivity(headers: DataFrame, site: DataFrame | None = None) -> DataFrame:
    """line_id, dielectric, depth_basis: what the line's header says, else what its site measures (line_id, dielectric), else the default."""
    own = line_dielectric(headers, "dielectric")
    near = own.select("line_id", F.lit(None).cast("double").alias("measured")) if site is None else own.select("line_id").join(site.select("line_id", C("dielectric").alias("measured")), "line_id", "left")
    both = own.join(near, "line_id")
    basis = F.when(C("dielectric").isNotNull(), "header").when(C("measured").isNotNull(), "site").otherwise("assumed")
    return both.select("line_id", F.coalesce("dielectric", "measured", F.lit(P.DEFAULT_DIELECTRIC)).alias("dielectric"), basis.alias("depth_basis"))


def target_contrast(traces: DataFrame, targets: DataFrame, axes: DataFrame) -> DataFrame:
    """TARGET, contrast: each channel votes by the polarity of its echo at the target; what is too early or off the record does not."""
    size = traces.groupBy(*LINE).agg(F.first(F.size("samples")).alias("n_samples"), (F.max("trace") + 1).alias("n_traces"))
    t = targets.select(*TARGET, "trace", "time_ns").join(axes.select(*LINE, "dt", "zero_ns"), "line_id").join(size, LINE)
    apex, centre = F.round((C("time_ns") + C("zero_ns")) / C("dt")).cast("int"), F.round("trace").cast("int")
    t = t.withColumn("apex", apex).withColumn("centre", centre).filter((C("time_ns") >= P.MIN_POLARITY_NS) & (C("apex") > 0) & (C("apex") < C("n_samples")) & C("centre").between(0, C("n_traces") - 1))
    up, down = (F.round(F.lit(ns) / C("dt")).cast("int") for ns in P.POLARITY_WINDOW_NS)
    first, left = F.greatest(F.lit(0), C("apex") - up), F.greatest(F.lit(0), C("centre") - P.POLARITY_HALF_TRACES)
    boxes = t.select(*LINE, C("target_id").alias("box_id"), left.alias("x"), first.alias("y"), (C("centre") + P.POLARITY_HALF_TRACES + 1 - left).alias("w"), (C("apex") + down - first).alias("h"))
    votes = D.box_polarity(traces, cut_lineage(boxes)).select("line_id", C("box_id").alias("target_id"), "keeps_polarity")
    read = contrast(votes, TARGET, "keeps_polarity")
    return targets.select(*TARGET).join(read, TARGET, "left").select(*TARGET, F.coalesce("contrast", F.lit("unreadable")).alias("contrast"))


def targets_from_traces(
    traces: DataFrame, headers: DataFrame, fixes: DataFrame, spacing_m: float, human: DataFrame | None = None, site: DataFrame | None = None,
    antenna_offset_m: float = 0.15, per_line: int = P.TARGETS_PER_LINE, line_rows: int | None = None,
) -> DataFrame:
    """Targets of every line that its GPS log can place, from raw traces of all its channels.

    headers: line_id, channel, dielectric. fixes: line_id, trace, lat, lon. human: line_id, pick_id, trace, time_ns, depth_m,
    channel: picks by people, which keep their depth and stand beside what was detected. Lines that a log cannot place have no
    rows, and targets too close to the ends of a line, or above the direct wave, are left out.
    """
    eps = usable_permittivity(headers, site)
    zeros = cut_lineage(R.time_zero(traces, line_rows))
    axes = channel_axes(traces, zeros)
    focused = traces.join(eps.select("line_id", "dielectric"), "line_id")
    picks = D.pick_targets(focused, spacing_m, C("dielectric"), line_rows=line_rows).select(*LINE, "trace", "sample", "strength")
    best = D.rank_targets(D.fuse(picks, axes, spacing_m), per_line)
    found = best.select("line_id", (C("line_id") * 1000 + C("rank")).alias("target_id"), "trace", "time_ns", "channels", F.lit("detected").alias("status"), F.lit(None).cast("double").alias("own_depth_m"))
    if human is not None:
        found = found.unionByName(human.select(
            "line_id", (-C("pick_id") - 1).alias("target_id"), C("trace").cast("double").alias("trace"), C("time_ns").cast("double").alias("time_ns"), F.array("channel").alias("channels"), F.lit("picked").alias("status"), C("depth_m").alias("own_depth_m")))
    lengths = line_lengths(traces).groupBy("line_id").agg(F.max("n_traces").alias("n_traces"))
    lines = gps_tracks(fixes, spacing_m).filter("jitter_m IS NOT NULL").select("line_id", "jitter_m").join(eps, "line_id").join(lengths, "line_id")
    inside = away_from_ends(C("time_ns"), C("trace"), C("n_traces"), F.lit(spacing_m))
    t = cut_lineage(found.join(lines, "line_id").filter((C("status") == "picked") | inside))
    depth = F.coalesce("own_depth_m", P.SPEED_OF_LIGHT_M_PER_NS / F.sqrt("dielectric") * C("time_ns") / 2)
    where = interpolate_held(t.select(*TARGET, "trace"), fixes).select(*TARGET, "lat", "lon")
    t = t.withColumn("depth_m", depth).join(where, TARGET).join(target_contrast(traces, t, axes), TARGET)
    return t.select(
        *TARGET, "status", "trace", "time_ns", (C("trace") * spacing_m).alias("chainage_m"), "lat", "lon", "depth_m", depth_error_m(C("depth_m"), F.lit(False)).alias("depth_error_m"),
        horizontal_error_m(C("jitter_m"), F.lit(antenna_offset_m)).alias("horizontal_error_m"), F.when(C("status") == "picked", "picked").otherwise(C("depth_basis")).alias("depth_basis"), "dielectric", "channels", F.size("channels").alias("corroboration"), "contrast", near_surface(C("time_ns")).alias("near_surface"))
