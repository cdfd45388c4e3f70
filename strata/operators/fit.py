"""Hyperbola fits, velocity sweeps and semblance, one small numeric job per box or arch on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import params as P
from strata.functions.physics import depth_from_time, dielectric_from_velocity, fit_rejection, velocity_from_curvature
from strata.operators import process as R
from strata.operators.lines import LINE

C = F.col


HASH_PRIME = 2147483647  # keeps every product below 2**63, also in SQL


def _draw_hash(d: np.ndarray, slot: int) -> np.ndarray:
    """An integer hash by two rounds of squaring modulo a prime."""
    u = ((d + 1) * 48271 + slot * 1013904223) % HASH_PRIME
    v = (u * u + 69621 * u + slot) % HASH_PRIME
    return (v * v + 40692 * v + d) % HASH_PRIME


def draw_triples(n: int, draws: int) -> np.ndarray:
    """`draws` triples of point numbers, each slot from its own integer hash of the draw: every retry draws the same.

    Draws that hit one point twice are left out.
    """
    d = np.arange(draws, dtype=np.int64)
    first, second, third = (_draw_hash(d, slot) for slot in (1, 2, 3))
    i = first % n
    j = (i + 1 + second % (n - 1)) % n
    k = (i + 1 + third % (n - 1)) % n
    return np.stack([i, j, k], axis=1)[(j != k)]


def parabolas(x: np.ndarray, y: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowest place, lowest value, curvature) of the parabolas through three points each: (boxes, triples) arrays.

    By divided differences, in the steps of the query's SQL, so that points at the edge of a vote fall on the same side;
    curvature 0 stands for one that opens downward or has its lowest value below 0.
    """
    (p, q, r), (u, v, w) = (tuple(z[:, triples[:, k]] for k in range(3)) for z in (x, y))
    rise = (v - u) / (q - p)
    bend = ((w - v) / (r - q) - rise) / (r - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = rise - bend * (p + q)
        level = u - p * (slope + bend * p)
        at, low = -slope / (2 * bend), level - slope * slope / (4 * bend)
    bowl = (bend > 1e-9) & (low >= 0)
    return np.where(bowl, at, 0.0), np.where(bowl, low, 0.0), np.where(bowl, bend, 0.0)


def curve(x: np.ndarray, at: np.ndarray, low: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """The hyperbola at x, in the same steps as in SQL."""
    away = x - at
    return np.sqrt(low + bend * away * away)


def least_squares(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the parabola of least squares through each row's weighted points, from the rows' moments."""
    n = weight.sum(axis=1)
    centre = (weight * x).sum(axis=1) / n
    width = np.sqrt((weight * (x - centre[:, None]) ** 2).sum(axis=1) / n)
    z = (x - centre[:, None]) / width[:, None]
    powers = weight * z[None] ** np.arange(5)[:, None, None]
    moments = powers.sum(axis=2)
    grid = np.moveaxis(moments[np.add.outer(np.arange(3), np.arange(3))], 2, 0)
    level, slope, bend = np.linalg.solve(grid, (powers[:3] * y).sum(axis=2).T[..., None])[..., 0].T
    with np.errstate(divide="ignore", invalid="ignore"):
        at, low = centre - width * slope / (2 * bend), level - slope**2 / (4 * bend)
    return at, low, bend / width**2


def fit_boxes(x: np.ndarray, t: np.ndarray, draws: int = P.RANSAC_DRAWS) -> np.ndarray:
    """(boxes, 5): x0, t0, k, r2, inliers of t = sqrt(t0^2 + ((x - x0) / k)^2) for boxes of equally many points; nan where there is none.

    Squared times make the hyperbola a parabola. The same triples of points are tried in all boxes at once; the parabola
    that passes closest to the most points is fitted again through those.
    """
    boxes, n = x.shape
    none = np.full((boxes, 5), np.nan)
    needed = max(P.RANSAC_MIN_INLIERS, int(np.ceil(P.RANSAC_MIN_FRACTION * n)))
    if n < P.RANSAC_MIN_INLIERS:
        return none  # too few points to ever reach the smallest consensus
    by = np.argsort(x, axis=1, kind="stable")
    x, t = np.take_along_axis(x, by, 1), np.take_along_axis(t, by, 1)
    middle = x.mean(axis=1)
    x = x - middle[:, None]
    at, low, bend = parabolas(x, t * t, draw_triples(n, draws))
    near = lambda at, low, bend: np.abs(t - curve(x, at, low, bend)) < P.RANSAC_RESIDUAL_SAMPLES
    curves = curve(x[:, None], at[..., None], low[..., None], bend[..., None])
    votes = np.where(bend > 0, (np.abs(t[:, None] - curves) < P.RANSAC_RESIDUAL_SAMPLES).sum(axis=2), -1)
    best = votes.argmax(axis=1)[:, None]
    found = np.take_along_axis(votes, best, 1)[:, 0] >= needed
    if not found.any():
        return none
    weight = near(*(np.take_along_axis(z, best, 1) for z in (at, low, bend)))[found].astype(float)
    x, t, middle, count = x[found], t[found], middle[found], weight.sum(axis=1)
    at, low, bend = least_squares(x, t * t, weight)
    real = (bend > 1e-9) & (low >= 0)
    at, low, bend = (np.where(real, z, 1.0) for z in (at, low, bend))
    left = weight * (t - np.sqrt(low[:, None] + bend[:, None] * (x - at[:, None]) ** 2)) ** 2
    spread = (weight * (t - ((weight * t).sum(axis=1) / count)[:, None]) ** 2).sum(axis=1)
    r2 = np.where(spread > 0, 1 - left.sum(axis=1) / np.where(spread > 0, spread, 1), 0.0)
    none[found] = np.where(real[:, None], np.stack([middle + at, np.sqrt(low), 1 / np.sqrt(bend), r2, count], axis=1), np.nan)
    return none


def fit_points(xs: np.ndarray, ts: np.ndarray, draws: int = P.RANSAC_DRAWS) -> tuple[float, float, float, float, int] | None:
    """`fit_boxes` of one box, or None when no hyperbola is there."""
    *values, inliers = fit_boxes(np.asarray(xs, float)[None], np.asarray(ts, float)[None], draws)[0]
    return None if np.isnan(inliers) else (*map(float, values), int(inliers))


FIT = "struct<x0:double,t0:double,k:double,r2:double,n_inliers:int,n_total:int>"
TOGETHER = 4_000_000  # distances of points to trial curves that are held at once


def _fit_batch(xs: pd.Series, ts: pd.Series) -> pd.DataFrame:
    sizes = xs.map(len).to_numpy()
    out = np.full((len(xs), 5), np.nan)
    for n in np.unique(sizes):
        alike = np.flatnonzero(sizes == n)
        step = max(1, min(64, TOGETHER // (P.RANSAC_DRAWS * max(n, 1))))
        for some in np.split(alike, range(step, len(alike), step)):
            out[some] = fit_boxes(*(np.stack([np.asarray(v, float) for v in z.iloc[some]]) for z in (xs, ts)))
    fits = pd.DataFrame(out, columns=["x0", "t0", "k", "r2", "n_inliers"])
    return fits.assign(n_inliers=fits["n_inliers"].astype("Int32"), n_total=pd.array(sizes, "Int32"))


def fit_hyperbolas(points: DataFrame, keys: list[str]) -> DataFrame:
    """One robust fit per key. A key's points are one per trace of a box, so a group is at most a box wide."""
    g = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(C("trace").cast("double").alias("x"), C("sample").cast("double").alias("t")))).alias("p"))
    fit = F.pandas_udf(_fit_batch, FIT)(F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["t"]))
    return g.withColumn("fit", fit).select(*keys, "fit.*")


def physical_fits(points: DataFrame, keys: list[str], lines: DataFrame, zero_sample: Column | None = None) -> DataFrame:
    """Fits in metres and nanoseconds, with the first reason a fit is not credible.

    `lines`: dt, spacing, n_samples (and what `zero_sample` reads) per line and channel.
    """
    zero = F.lit(0.0) if zero_sample is None else zero_sample
    p = points.join(lines, LINE).withColumn("__zero", zero).filter(C("sample") > C("__zero")).withColumn("sample", C("sample") - C("__zero"))
    f = fit_hyperbolas(p, keys).filter(C("k").isNotNull()).join(lines, LINE).withColumn("__zero", zero)
    v = velocity_from_curvature(C("k"), C("spacing"), C("dt"))
    f = f.withColumn("velocity", v).withColumn("apex_time_ns", C("t0") * C("dt"))
    plausible = (C("velocity") > 0) & (C("velocity") <= P.SPEED_OF_LIGHT_M_PER_NS)
    f = f.withColumn("plausible", plausible).withColumn("dielectric", F.when(plausible, dielectric_from_velocity(C("velocity"))).otherwise(1.0))
    f = f.withColumn("depth_m", F.when(plausible, depth_from_time(C("apex_time_ns"), C("velocity"))).otherwise(0.0)).withColumn("apex_sample", C("t0") + C("__zero"))
    reason = fit_rejection(C("velocity"), C("apex_time_ns"), C("apex_sample"), C("n_inliers"), C("dielectric"), C("n_samples"))
    return f.select(*keys, C("x0").alias("apex_trace"), "apex_sample", "apex_time_ns", "velocity", "dielectric", "depth_m", "r2", "n_inliers", "n_total", "plausible", reason.alias("reason"))


def diagnose(boxes: DataFrame, fits: DataFrame, coherence: DataFrame, peaks: DataFrame) -> DataFrame:
    """Shape and class each box suggests: point, linear, disturbed, or ambiguous for a person to look at."""
    keys = [*LINE, "box_id"]
    d = boxes.join(fits.select(*keys, "r2", "n_inliers", "n_total", "velocity"), keys, "left").join(coherence, keys).join(peaks, keys, "left")
    aspect = F.greatest("w", "h") / F.least("w", "h")
    shape = (
        F.when(C("r2") >= P.POINT_R2, "point")
        .when((aspect >= P.LINEAR_ASPECT) & (C("r2").isNull() | (C("r2") < P.LINEAR_MAX_R2)), "linear")
        .when(C("coherence") < P.DISTURBED_COHERENCE, "disturbed").otherwise("ambiguous"))
    name = (
        F.when((C("shape") == "point") & (C("peak") >= P.STRONG_PEAK), "clear_point_reflector").when(C("shape") == "point", "low_snr_point_reflector")
        .when(C("shape") == "linear", "elongated_linear_target").when(C("shape") == "disturbed", "disturbed_zone"))
    possible = F.when((C("velocity") > 0) & (C("velocity") < P.SPEED_OF_LIGHT_M_PER_NS), C("velocity"))
    return d.withColumn("shape", shape).select(*keys, "shape", name.alias("suggested_class"), "r2", aspect.alias("aspect"), "coherence", "peak", possible.alias("velocity"))


def credible_detections(traces: DataFrame, lines: DataFrame, line_rows: int | None = None) -> DataFrame:
    """Energy boxes with their fit's verdict: a credible one has no `reason` and its r2 as confidence."""
    from strata.operators.detect import energy_candidates, ridge_points
    from strata.session import cut_lineage

    keys = [*LINE, "box_id"]
    normalized = cut_lineage(R.normalized_envelope(traces, line_rows))  # the mask and the ridge points both read it
    boxes = cut_lineage(energy_candidates(traces, line_rows, normalized).withColumn("box_id", F.xxhash64(*LINE, "x", "y", "w", "h")))
    fits = physical_fits(ridge_points(normalized, boxes), keys, lines).select(*keys, "reason", "r2", F.lit(True).alias("fitted"))
    d = boxes.join(fits, keys, "left")
    reason = F.when(C("fitted").isNull(), "no hyperbola fits").otherwise(C("reason"))
    clipped = F.least(F.greatest("r2", F.lit(0.0)), F.lit(1.0))
    return d.withColumn("reason", reason).withColumn("confidence", F.when(C("reason").isNull(), clipped)).drop("fitted")


# ---------------------------------------------------------------- semblance

SEMBLANCE_EPS = [round(float(e), 2) for e in np.geomspace(*P.SEMBLANCE_RANGE, P.SEMBLANCE_STEPS)]


def neighbourhood(traces: DataFrame, apexes: DataFrame, half: int, payload: list[str]) -> DataFrame:
    """Each apex with the traces around it: a bounded stretch of one line, joined trace by trace."""
    want = apexes.select(*LINE, "apex_id", C("trace").alias("apex_trace"), *payload, F.explode(F.sequence(C("trace") - half, C("trace") + half)).alias("trace"))
    got = traces.select(*LINE, "trace", "samples", "dt", "spacing").join(want, [*LINE, "trace"])
    return got.groupBy(*LINE, "apex_id", "apex_trace", "dt", "spacing", *payload).agg(F.array_sort(F.collect_list(F.struct("trace", "samples"))).alias("near"))


def semblance_of(block: np.ndarray, away_m: np.ndarray, apex_sample: int, dt: float) -> np.ndarray:
    """Of every trial permittivity: the energy of the traces' sum along its curve, over the traces' own energy times their number.

    `block` is (samples, traces). All trials are taken at once, as (trial, trace, sample of the window) arrays; a trace whose
    window would leave the record is left out of a trial, and a trial with too few traces is worth nothing.
    """
    speed = P.SPEED_OF_LIGHT_M_PER_NS / np.sqrt(SEMBLANCE_EPS)
    depth = np.rint(np.sqrt(float(apex_sample) ** 2 + (2 * away_m[None] / speed[:, None] / dt) ** 2)).astype(int)
    inside = (depth >= P.SEMBLANCE_WINDOW) & (depth + P.SEMBLANCE_WINDOW < len(block))
    windows = np.lib.stride_tricks.sliding_window_view(block, 2 * P.SEMBLANCE_WINDOW + 1, axis=0)
    held = windows[np.where(inside, depth - P.SEMBLANCE_WINDOW, 0), np.arange(block.shape[1])[None]] * inside[..., None]
    traces = inside.sum(axis=1)
    own = traces * (held**2).sum(axis=(1, 2))
    together = (held.sum(axis=1) ** 2).sum(axis=1)
    return np.divide(together, own, out=np.zeros(len(own)), where=(traces >= P.SEMBLANCE_MIN_TRACES) & (own > 0))


def semblance_curves(traces: DataFrame, apexes: DataFrame) -> DataFrame:
    """Semblance over trial permittivities for each apex. Traces are background-removed, row 0 at time zero."""

    @F.pandas_udf("array<double>")
    def run(near: pd.Series, apex: pd.Series, sample: pd.Series, spacing: pd.Series, dt: pd.Series) -> pd.Series:
        out = []
        for group, a, s, sp, d in zip(near, apex, sample, spacing, dt):
            away = np.abs(np.array([g["trace"] for g in group]) - a) * sp
            out.append(semblance_of(np.stack([g["samples"] for g in group]).T, away, s, d))
        return pd.Series(out)

    n = neighbourhood(traces, apexes, P.SEMBLANCE_HALF_WIDTH, ["sample"])
    return n.select(*LINE, "apex_id", run("near", "apex_trace", "sample", "spacing", "dt").alias("curve"))


def is_peaked(curve: Column) -> Column:
    """One interior best permittivity that rises clear of the range ends."""
    best = F.array_position(curve, F.array_max(curve)) - 1
    rise = F.array_max(curve) - F.least(F.element_at(curve, 1), F.element_at(curve, -1))
    return (best >= P.FLAT_EDGE) & (best < F.size(curve) - P.FLAT_EDGE) & (rise >= P.MIN_PROMINENCE)


def stacked_permittivity(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Peak of the summed peaked curves of a site; null below three clear arches. Curves add up map-side."""
    p = curves.filter(is_peaked(C("curve")))
    arches = curves.groupBy(*keys).agg(F.count_if(is_peaked(C("curve"))).alias("arches"))
    s = p.select(*keys, F.posexplode("curve").alias("i", "s")).groupBy(*keys, "i").agg(F.sum("s").alias("s"))
    best = s.groupBy(*keys).agg(F.max_by("i", F.struct(F.round("s", 12), -C("i"))).alias("i"))
    eps = F.element_at(F.array(*[F.lit(e) for e in SEMBLANCE_EPS]), C("i") + 1)
    j = arches.join(best, keys, "left").select(*keys, "arches", F.when(C("arches") >= P.MIN_ARCHES, eps).alias("dielectric"))
    return j.withColumn("wet_ground", F.coalesce(C("dielectric") > P.WET_SOIL_DIELECTRIC, F.lit(False)))


# ---------------------------------------------------------------- focusing

SWEEP = [float(v) for v in np.linspace(*P.SWEEP_RANGE, P.SWEEP_STEPS)]


def migrated_at(block: np.ndarray, spacing: float, dt: float, velocities: np.ndarray, aperture: int) -> np.ndarray:
    """(velocities, samples, traces): the block migrated at every velocity, by sideways distance, all velocities together.

    What a column's weights add up to depends only on how far the block reaches to its left and right.
    """
    n, width = block.shape
    reach = min(aperture, width - 1)
    t, away = np.arange(n) * dt, np.arange(reach + 1)
    travel = np.sqrt(t**2 + ((2.0 * away[:, None] * spacing / velocities) ** 2)[..., None])
    row = np.rint(travel / dt).astype(int)
    weight = np.divide(t, travel, out=np.zeros_like(travel), where=(travel > 0) & (row < n))
    row = np.minimum(row, n - 1)
    total = block[row[0]] * weight[0][..., None]
    for k in away[1:]:
        echo = block[row[k]] * weight[k][..., None]
        total[..., : width - k] += echo[..., k:]
        total[..., k:] += echo[..., : width - k]
    to_side = np.cumsum(weight, axis=0)
    left = np.minimum(np.arange(width), reach)
    weights = to_side[left] + to_side[left[::-1]] - weight[0]
    return total / np.maximum(np.moveaxis(weights, 0, 2), 1e-12)


def focus_at(block: np.ndarray, column: int, sample: int, spacing: float, dt: float, half_height: int, aperture: int) -> np.ndarray:
    """How far each trial velocity of SWEEP makes the apex stand out: its peak over the mean level around it."""
    images = migrated_at(block, spacing, dt, np.array(SWEEP), aperture)
    band = images[:, max(0, sample - half_height) : sample + half_height + 1]
    level = np.sqrt((band**2).mean(axis=(1, 2)))
    peak = np.abs(images[:, max(0, sample - 3) : sample + 4, max(0, column - 3) : column + 4]).max(axis=(1, 2))
    return np.divide(peak, level, out=np.zeros(len(level)), where=level > 0)


def focusing_sweep(traces: DataFrame, apexes: DataFrame, half_width: int = 60, half_height: int = 40, aperture: int = 60) -> DataFrame:
    """Which trial velocity focuses each apex best, and whether the curve picks one at all."""

    @F.pandas_udf("array<double>")
    def run(near: pd.Series, apex: pd.Series, sample: pd.Series, spacing: pd.Series, dt: pd.Series) -> pd.Series:
        out = []
        for group, a, s, sp, d in zip(near, apex, sample, spacing, dt):
            block = np.stack([g["samples"] for g in group]).T
            out.append(focus_at(block, a - int(group[0]["trace"]), s, sp, d, half_height, aperture))
        return pd.Series(out)

    n = neighbourhood(traces, apexes, half_width, ["sample"])
    n = n.filter((F.size("near") >= 3) & F.exists("near", lambda x: x["trace"] == C("apex_trace")))
    e = n.select(*LINE, "apex_id", run("near", "apex_trace", "sample", "spacing", "dt").alias("energies"))
    best = F.array_position("energies", F.array_max("energies"))
    ordered = F.array_sort("energies")
    middle = F.element_at(ordered, len(SWEEP) // 2 + 1)  # an odd number of trials has one middle value
    v = F.element_at(F.array(*[F.lit(x) for x in SWEEP]), best.cast("int"))
    e = e.withColumn("velocity", v).withColumn("peak_ratio", F.when(middle > 0, F.array_max("energies") / middle).otherwise(0.0))
    return e.select(*LINE, "apex_id", "velocity", dielectric_from_velocity(C("velocity")).alias("dielectric"), "peak_ratio", (C("peak_ratio") >= P.FLAT_PEAK_RATIO).alias("well_constrained"))


# ---------------------------------------------------------------- screenshots with a depth axis

def screenshot_velocity(fits: DataFrame, reported: float, per_x: Column, per_d: Column) -> DataFrame:
    """Compare a fitted curvature in pixels with the velocity the depth axis was drawn with."""
    ratio = per_d / (per_x * C("k"))
    f = fits.filter(C("k").isNotNull()).withColumn("velocity_ratio", ratio).withColumn("implied_dielectric", reported * C("velocity_ratio") ** 2)
    rejected = F.when(C("r2") < 0.95, "poor fit").when(~C("implied_dielectric").between(1.0, P.PERMITTIVITY_IMPLAUSIBLE_ABOVE), "impossible dielectric")
    return f.withColumn("rejected", rejected)


def image_energy(traces: DataFrame, line_rows: int | None = None) -> DataFrame:
    """Row-normalised energy of an image held as columns: median removed, squared, blurred, normalised."""
    from strata.operators.quantiles import group_quantiles

    s = R.samples_of(traces)
    bound = None if line_rows is None else line_rows * 1024
    as_map = lambda q, v: q.groupBy(*LINE).agg(F.map_from_entries(F.collect_list(F.struct("sample", v))).alias("__m"))
    med = as_map(group_quantiles(s, [*LINE, "sample"], "amp", {"med": 0.5}, line_rows), "med")
    squared = traces.join(med, LINE).withColumn("samples", F.transform("samples", lambda x, i: (x - F.try_element_at("__m", i)) * (x - F.try_element_at("__m", i)))).drop("__m")
    e = R.blur(squared, 3, 9).withColumn("samples", F.transform("samples", lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))))
    es = R.samples_of(e)
    floor = group_quantiles(es, LINE, "amp", {"floor": 0.5}, bound)
    row = as_map(group_quantiles(es, [*LINE, "sample"], "amp", {"bg": 0.5}, line_rows), "bg")
    low = F.greatest(C("floor") * P.ROW_BACKGROUND_FLOOR, F.lit(1e-6))
    return e.join(row, LINE).join(floor, LINE).withColumn("samples", F.transform("samples", lambda x, i: x / F.greatest(F.try_element_at("__m", i), low))).drop("__m", "floor")
