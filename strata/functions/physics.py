"""Wave physics as column expressions: velocity, permittivity, depth, widths, errors, readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import params as P


def dielectric_from_velocity(v: Column) -> Column:
    return F.when(v > 0, F.pow(P.SPEED_OF_LIGHT_M_PER_NS / v, F.lit(2.0)))


def velocity_from_dielectric(eps: Column) -> Column:
    return F.when(eps > 0, P.SPEED_OF_LIGHT_M_PER_NS / F.sqrt(eps))


def depth_from_time(t_ns: Column, v: Column) -> Column:
    return F.when((t_ns >= 0) & (v > 0), v * t_ns / 2)


def velocity_from_limb_point(dx_m: Column, t_ns: Column, apex_ns: Column) -> Column:
    """Null when the limb is not below the apex or not to its side."""
    return F.when((t_ns > apex_ns) & (F.abs(dx_m) > 0), 2 * F.abs(dx_m) / F.sqrt(t_ns * t_ns - apex_ns * apex_ns))


def velocity_from_curvature(k: Column, spacing: Column, dt: Column) -> Column:
    return 2 * k * spacing / dt


def hyperbola_sample(offset_traces: Column, apex_ns: Column, v: Column, spacing: Column, dt: Column) -> Column:
    """Where, in samples, the hyperbola of an apex passes `offset_traces` away from it."""
    lateral = 2 * offset_traces * spacing / v
    return F.sqrt(apex_ns * apex_ns + lateral * lateral) / dt


def half_width_m(apex_ns: Column, v: Column, limb_delay_ns: float = P.BOX_BELOW_NS) -> Column:
    late = apex_ns + limb_delay_ns
    half = 0.5 * v * F.sqrt(late * late - apex_ns * apex_ns)
    return F.least(F.greatest(half, F.lit(P.MIN_HALF_WIDTH_M)), F.lit(P.MAX_HALF_WIDTH_M))


def half_aperture_m(depth_m: Column) -> Column:
    return F.greatest(depth_m, F.lit(P.MIN_APERTURE_M))


def direct_wave_skip(n_samples: Column, dt: Column) -> Column:
    return F.least(n_samples, F.rint(P.DIRECT_WAVE_WINDOW_NS / dt).cast("int"))


def permittivity_signal(eps: Column, site_eps: Column) -> Column:
    return (
        F.when(eps >= P.PERMITTIVITY_IMPLAUSIBLE_ABOVE, "implausible")
        .when(eps <= P.PERMITTIVITY_AIR_LIKE_BELOW, "air_like")
        .when(site_eps.isNull(), "soil_like")
        .when(eps < site_eps / 2, "fast")
        .when(eps > site_eps * 2, "wet")
        .otherwise("soil_like")
    )


def fit_rejection(v: Column, apex_ns: Column, apex_sample: Column, n_inliers: Column, eps: Column, n_samples: Column) -> Column:
    """The first rule a fit breaks, or null when it stands."""
    return (
        F.when((v <= 0) | (v > P.SPEED_OF_LIGHT_M_PER_NS), "faster_than_light")
        .when(apex_ns < P.DIRECT_WAVE_WINDOW_NS, "direct_wave")
        .when(apex_sample > P.RECORD_FLOOR_FRACTION * n_samples, "record_end")
        .when(n_inliers < P.MIN_CREDIBLE_INLIERS, "few_inliers")
        .when(eps >= P.PERMITTIVITY_IMPLAUSIBLE_ABOVE, "implausible_permittivity")
    )


def usable_dielectric(header: Column) -> Column:
    return F.when(header >= P.MIN_USABLE_DIELECTRIC, header)


def near_surface(time_from_zero_ns: Column) -> Column:
    return time_from_zero_ns < P.NEAR_SURFACE_NS


def away_from_ends(time_ns: Column, trace: Column, n_traces: Column, spacing: Column) -> Column:
    edge = P.LINE_EDGE_M / spacing
    return (time_ns > 0) & (trace >= edge) & (trace <= n_traces - 1 - edge)


def horizontal_error_m(jitter: Column, antenna_offset_m: Column) -> Column:
    return F.sqrt(jitter * jitter + F.lit(P.PICK_POSITION_ERROR_M**2) + antenna_offset_m * antenna_offset_m)


def depth_error_m(depth: Column, fitted: Column) -> Column:
    relative = F.when(fitted, P.FITTED_RELATIVE_ERROR).otherwise(P.DEPTH_RELATIVE_ERROR)
    return relative * depth + P.DEPTH_FLOOR_ERROR_M


def gain_curve(sample: Column, n_samples: Column, mode: str, exponent: float) -> Column:
    fraction = sample / F.greatest(n_samples - 1, F.lit(1))
    if mode == "linear":
        return 1.0 + fraction * exponent
    if mode == "exponential":
        return F.exp(fraction * exponent)
    raise ValueError(f"unknown gain curve {mode!r}")


def box_in_traces(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float, n_traces: Column, n_samples: Column) -> Column:
    """A pixel box as half-open trace and sample ranges; never empty, never outside the line."""
    t0 = F.greatest(F.lit(0), F.floor(x1 / width * n_traces)).cast("int")
    s0 = F.greatest(F.lit(0), F.floor(y1 / height * n_samples)).cast("int")
    t1 = F.least(n_traces, F.greatest(t0 + 1, F.ceil(x2 / width * n_traces))).cast("int")
    s1 = F.least(n_samples, F.greatest(s0 + 1, F.ceil(y2 / height * n_samples))).cast("int")
    return F.struct(t0.alias("trace_start"), t1.alias("trace_end"), s0.alias("sample_start"), s1.alias("sample_end"))


def clip_range(lo: Column, hi: Column, size: Column) -> Column:
    """[lo, hi) clipped into [0, size); null when nothing overlaps."""
    lo_i = F.greatest(F.lit(0), F.least(lo.cast("int"), size - 1))
    hi_i = F.greatest(lo_i + 1, F.least(F.rint(hi).cast("int"), size))
    return F.when((size > 0) & (hi > 0) & (lo < size), F.struct(lo_i.alias("lo"), hi_i.alias("hi")))


def axis_to_metres(px: Column, px_a: Column, m_a: Column, px_b: Column, m_b: Column) -> Column:
    """Two reference ticks turn a pixel coordinate into metres."""
    return m_a + (px - px_a) * (m_b - m_a) / (px_b - px_a)


def placed_at(start: Column, distance: Column, direction: Column) -> Column:
    return start + distance * direction


def along_axis(east: Column, north: Column, axis_east: Column, axis_north: Column) -> Column:
    return east * axis_east + north * axis_north


def line_length_m(n_traces: Column, spacing: Column) -> Column:
    return (n_traces - 1) * spacing


def max_depth_m(n_samples: Column, dt: Column, eps: Column) -> Column:
    return depth_from_time(n_samples * dt, velocity_from_dielectric(eps))
