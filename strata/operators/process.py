"""Radargram processing: traces in, traces out.

A trace table has one row per trace with its samples as an array. Steps that stay inside a trace run
on Arrow batches with no shuffle; steps that look sideways run on tiles of a line with a halo; whole-line
statistics are aggregated and joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import params as P
from strata.functions.physics import gain_curve
from strata.operators.lines import LINE, line_lengths, map_tiles
from strata.operators.quantiles import group_quantiles
from strata.session import cut_lineage

C = F.col


def on_traces(fn: Callable[..., np.ndarray], *values: str) -> Column:
    """Apply `fn(block, *values)` to the samples of an Arrow batch; traces of one length go together."""

    @F.pandas_udf("array<double>")
    def run(*columns: pd.Series) -> pd.Series:
        samples, rest = columns[0], columns[1:]
        shape = pd.DataFrame({"n": samples.map(len), **{f"v{i}": c for i, c in enumerate(rest)}}).reset_index(drop=True)
        out = [None] * len(samples)
        for key, rows in shape.groupby(list(shape.columns), dropna=False).groups.items():
            block = np.stack([samples.iloc[i] for i in rows]).astype(float)
            for i, row in zip(rows, fn(block, *(key[1:] if rest else ()))):
                out[i] = row
        return pd.Series(out)

    return run("samples", *values)


def running_mean(block: np.ndarray, window: int, axis: int) -> np.ndarray:
    """Centred mean of an odd window with the edge values repeated outwards."""
    half = window // 2
    pad = [(half, half) if a == axis else (0, 0) for a in range(block.ndim)]
    total = np.cumsum(np.pad(block, pad, mode="edge"), axis=axis)
    total = np.insert(total, 0, 0.0, axis=axis)
    take = lambda lo, hi: np.take(total, range(lo, hi), axis=axis)
    n = block.shape[axis]
    return (take(window, window + n) - take(0, n)) / window


def odd_window(window: int) -> int:
    return max(3, int(window) | 1)


def apply_time_zero(traces: DataFrame, first_sample: int) -> DataFrame:
    """Drop the samples before the first break and renumber; nothing is filled in."""
    if first_sample <= 0:
        return traces
    return traces.withColumn("samples", F.slice("samples", first_sample + 1, F.size("samples") - first_sample))


def dewow(traces: DataFrame, window: int) -> DataFrame:
    window = odd_window(window)

    def remove(block: np.ndarray) -> np.ndarray:
        if window >= block.shape[1]:
            return block - block.mean(axis=1, keepdims=True)
        return block - running_mean(block, window, axis=1)

    return traces.withColumn("samples", on_traces(remove))


def line_mean(traces: DataFrame) -> DataFrame:
    """The mean trace of each line and channel; partial sums travel, not traces."""
    per_sample = traces.select(*LINE, F.posexplode("samples").alias("s", "amp")).groupBy(*LINE, "s").agg(F.avg("amp").alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("s", "m"))), lambda x: x["m"])
    return per_sample.groupBy(*LINE).agg(ordered.alias("mean_trace"))


def remove_background(traces: DataFrame, mode: str, window: int = 51) -> DataFrame:
    if mode == "none":
        return traces
    less_mean = lambda t: t.join(line_mean(t), LINE).withColumn(
        "samples", F.zip_with("samples", "mean_trace", lambda a, b: a - b)).drop("mean_trace")
    if mode == "mean":
        return less_mean(traces)
    if mode != "moving":
        raise ValueError(f"unknown background_removal mode: {mode!r}")
    window = odd_window(window)
    lengths = line_lengths(traces)
    short = traces.join(lengths.filter(C("n_traces") <= window).select(*LINE), LINE, "left_semi")
    long = traces.join(lengths.filter(C("n_traces") > window).select(*LINE), LINE, "left_semi")
    moved = map_tiles(long, lambda block, first, n, row: block - running_mean(block, window, axis=1), halo=window // 2)
    return less_mean(short).unionByName(moved)


def bandpass_response(n: int, dt: float, low: float, high: float) -> np.ndarray:
    """Pass band with cosine tapers from half of `low` and to one and a half times `high` (MHz)."""
    f = np.fft.rfftfreq(n, d=dt * 1e-9) / 1e6
    lo, hi = low / 2, high * 1.5
    up = 0.5 - 0.5 * np.cos(np.pi * np.clip((f - lo) / (low - lo), 0, 1))
    down = 0.5 + 0.5 * np.cos(np.pi * np.clip((f - high) / (hi - high), 0, 1))
    return np.where(f < lo, 0.0, up) * np.where(f > hi, 0.0, down)


def bandpass(traces: DataFrame, low: float, high: float) -> DataFrame:
    if low >= high:
        raise ValueError(f"band-pass low ({low}) must be below high ({high}) MHz")

    def filtered(block: np.ndarray, dt: float) -> np.ndarray:
        n = block.shape[1]
        return np.fft.irfft(np.fft.rfft(block, axis=1) * bandpass_response(n, dt, low, high), n=n, axis=1)

    return traces.withColumn("samples", on_traces(filtered, "dt"))


def apply_gain(traces: DataFrame, mode: str, window: int = 40, exponent: float = 2.0) -> DataFrame:
    if mode == "none":
        return traces
    if mode in ("linear", "exponential"):
        n = F.size("samples")
        return traces.withColumn("samples", F.transform("samples", lambda x, i: x * gain_curve(i, n, mode, exponent)))
    if mode != "agc":
        raise ValueError(f"unknown gain mode: {mode!r}")
    window = odd_window(window)
    loud = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    level = traces.groupBy(*LINE).agg((F.sum(loud) / F.sum(F.size("samples"))).alias("level"))
    floor = F.greatest(C("level") * 0.05, F.lit(1e-12))
    local = on_traces(lambda block: running_mean(np.abs(block), window, axis=1))
    levelled = traces.withColumn("__local", local).join(level, LINE)
    return levelled.withColumn("samples", F.zip_with("samples", "__local", lambda x, m: x / F.greatest(m, floor))).drop("__local", "level")


def stack_traces(traces: DataFrame, count: int) -> DataFrame:
    """Average every `count` adjacent traces; what is left over becomes its own trace."""
    if count <= 1:
        return traces
    n = line_lengths(traces)
    group = F.when(C("n_traces") < count, C("trace")).otherwise(F.floor(C("trace") / count).cast("int"))
    kept = [c for c in traces.columns if c not in (*LINE, "trace", "samples")]
    long = traces.join(n, LINE).select(*LINE, *kept, group.alias("trace"), F.posexplode("samples").alias("s", "amp"))
    mean = long.groupBy(*LINE, "trace", "s").agg(F.avg("amp").alias("m"), *[F.first(c).alias(c) for c in kept])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("s", "m"))), lambda x: x["m"])
    return mean.groupBy(*LINE, "trace").agg(ordered.alias("samples"), *[F.first(c).alias(c) for c in kept])


def migrate_block(block: np.ndarray, spacing: float, dt: float, velocity: float, aperture: int) -> np.ndarray:
    """Sum a (samples, traces) block along the diffraction curve of every output point.

    The curve and its obliquity weight depend on the distance only, so both sides share one pass.
    """
    n, width = block.shape
    t = np.arange(n) * dt
    out, weight_sum = np.zeros_like(block), np.zeros_like(block)
    for away in range(min(aperture, width - 1) + 1):
        travel = np.sqrt(t * t + (2.0 * away * spacing / velocity) ** 2)
        rows = np.rint(travel / dt).astype(int)
        k = int(np.searchsorted(rows, n))
        if k == 0:
            break
        weight = np.divide(t[:k], travel[:k], out=np.zeros(k), where=travel[:k] > 0)[:, None]
        echo = block[rows[:k]] * weight
        out[:k, : width - away] += echo[:, away:]
        weight_sum[:k, : width - away] += weight
        if away:
            out[:k, away:] += echo[:, : width - away]
            weight_sum[:k, away:] += weight
    return out / np.maximum(weight_sum, 1e-12)


def migrate(traces: DataFrame, velocity: Column | float, aperture: int) -> DataFrame:
    """Kirchhoff migration. Tiles carry a halo of one aperture, so a long line is many tasks."""
    t = traces.withColumn("__v", velocity if isinstance(velocity, Column) else F.lit(float(velocity)))
    fn = lambda block, first, n, row: migrate_block(block, row["spacing"], row["dt"], row["__v"], aperture)
    return map_tiles(t, fn, halo=aperture, extra=("spacing", "dt", "__v")).drop("__v")


def analytic_envelope(block: np.ndarray, axis: int = 1) -> np.ndarray:
    """Instantaneous amplitude: the one-sided spectrum doubled, transformed back, magnitude taken."""
    n = block.shape[axis]
    gain = np.where(np.arange(n) <= n // 2, 2.0, 0.0)
    gain[0] = 1.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    shape = [-1 if a == axis else 1 for a in range(block.ndim)]
    return np.abs(np.fft.ifft(np.fft.fft(block, axis=axis) * gain.reshape(shape), axis=axis))


def envelope(traces: DataFrame) -> DataFrame:
    return traces.withColumn("samples", on_traces(analytic_envelope))


def box_blur(block: np.ndarray, width: int, height: int, first: int, n_traces: int) -> np.ndarray:
    """Mean over height samples x width traces, borders mirrored without repeating the edge.

    The sideways mirror applies only at the ends of the line; inside it the halo is real data.
    """
    h, w = height // 2, width // 2
    down = np.pad(block, ((h, h), (0, 0)), mode="reflect")
    sums = np.cumsum(np.vstack([np.zeros((1, down.shape[1])), down]), axis=0)
    tall = sums[height:] - sums[:-height]
    left, right = first == 0, first + block.shape[1] == n_traces
    side = np.pad(tall, ((0, 0), (w, w)), mode="reflect" if left or right else "edge")
    return sum(side[:, i : i + block.shape[1]] for i in range(width)) / (width * height)


def blur(traces: DataFrame, width: int, height: int) -> DataFrame:
    return map_tiles(traces, lambda block, first, n, row: box_blur(block, width, height, first, n), halo=width)


def samples_of(traces: DataFrame, value: str = "amp") -> DataFrame:
    return traces.select(*LINE, "trace", F.posexplode("samples").alias("sample", value))


def energy(traces: DataFrame) -> DataFrame:
    """Blurred energy of the background-removed traces, with the direct wave blanked."""
    residual = remove_background(traces, "mean")
    squared = residual.withColumn("samples", F.transform("samples", lambda x: x * x))
    smooth = blur(squared, *P.ENVELOPE_BLUR)
    skip = F.least(F.size("samples"), F.rint(P.DIRECT_WAVE_WINDOW_NS / C("dt")).cast("int"))
    blanked = F.transform("samples", lambda x, i: F.when(i < skip, 0.0).otherwise(F.sqrt(F.greatest(x, F.lit(0.0)))))
    return smooth.withColumn("samples", blanked)


def normalized_envelope(traces: DataFrame, line_rows: int | None = None) -> DataFrame:
    """Energy over its depth's own background. `line_rows`: a checked bound on traces per line, if known."""
    e = cut_lineage(energy(traces))  # read three times below: two statistics and the scaling
    n = 1024
    bound = None if line_rows is None else line_rows * n
    s = samples_of(e).join(e.groupBy(*LINE).agg(F.first("dt").alias("dt")), LINE)
    below = s.filter(C("sample") >= F.rint(P.DIRECT_WAVE_WINDOW_NS / C("dt")))
    row = group_quantiles(below, [*LINE, "sample"], "amp", {"bg": 0.5}, line_rows)
    floor = group_quantiles(below, LINE, "amp", {"floor": 0.5}, bound)
    backgrounds = row.groupBy(*LINE).agg(F.map_from_entries(F.collect_list(F.struct("sample", "bg"))).alias("__bg"))
    joined = e.join(backgrounds, LINE).join(floor, LINE)
    level = lambda i: F.greatest(F.try_element_at("__bg", i), C("floor") * P.ROW_BACKGROUND_FLOOR)
    scaled = F.transform("samples", lambda x, i: F.when(x > 0, x / level(i)).otherwise(0.0))
    return joined.withColumn("samples", scaled).drop("__bg", "floor")


def time_zero(traces: DataFrame, line_rows: int | None = None) -> DataFrame:
    """Per line and channel: the median arrival of the direct wave and whether arrivals spread too far."""
    quarter = F.slice("samples", 1, F.greatest(F.lit(1), F.floor(F.size("samples") / 4).cast("int")))
    arrival = (F.array_position(quarter, F.array_max(quarter)) - 1) * C("dt")
    a = envelope(traces).select(*LINE, "dt", arrival.alias("arrival"))
    q = group_quantiles(a, [*LINE, "dt"], "arrival", {"q1": 0.25, "zero_ns": 0.5, "q3": 0.75}, line_rows)
    wide = C("q3") - C("q1") > F.greatest(F.lit(P.TIME_ZERO_SPREAD_NS), 5 * C("dt"))
    return q.select(*LINE, "zero_ns", wide.alias("uncertain"))


def resample(traces: DataFrame, zeros: DataFrame, rows: int = 256, step: float = 0.2, lead: float = 2.0) -> DataFrame:
    """Every channel on one time grid that starts `lead` before its own time zero; zero outside the record."""
    t = traces.join(zeros, LINE)
    n = F.size("samples")
    # Positions in samples, snapped to a billionth so grid points that fall on samples stay on them.
    where = lambda i: F.round((C("zero_ns") - lead + i * step) / C("dt"), 9)
    value = lambda p: F.element_at("samples", (F.floor(p) + 1).cast("int"))
    upper = lambda p: F.element_at("samples", F.least(F.floor(p) + 2, n).cast("int"))
    at = lambda p: F.when((p >= 0) & (p <= n - 1), value(p) + (upper(p) - value(p)) * (p - F.floor(p))).otherwise(0.0)
    return t.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: at(where(i))))


def stack_channels(traces: DataFrame, zeros: DataFrame, channels: tuple[str, ...], **grid) -> DataFrame:
    """The channels of a line side by side on the common grid, one row per trace."""
    on_grid = resample(traces, zeros, **grid)
    return on_grid.groupBy("line_id", "trace").agg(*[F.max(F.when(C("channel") == c, C("samples"))).alias(c.lower()) for c in channels])


def overlapping_windows(lines: DataFrame, size: int) -> DataFrame:
    """Windows of `size` traces every half window; the last one ends with the line."""
    starts = F.array_distinct(F.concat(
        F.sequence(F.lit(0), F.greatest(C("n_traces") - size, F.lit(0)), F.lit(size // 2)),
        F.array(F.greatest(C("n_traces") - size, F.lit(0)))))
    w = lines.withColumn("start", F.explode(starts))
    return w.withColumn("end", F.least(C("start") + size, C("n_traces")))


def quantise(traces: DataFrame, percentile: float, line_rows: int | None = None) -> DataFrame:
    """Diverging display scale: clip at a percentile of |amplitude| and map to 0..255."""
    s = samples_of(traces).select(*LINE, F.abs("amp").alias("a"))
    limit = group_quantiles(s, LINE, "a", {"lim": percentile / 100}, None if line_rows is None else line_rows * 1024)
    scale = lambda x: F.rint(F.least(F.greatest(x / (2.0 * C("lim")) + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return traces.join(limit, LINE).withColumn("samples", F.transform("samples", scale)).drop("lim")


def robust_quantise(traces: DataFrame, line_rows: int | None = None) -> DataFrame:
    """Median trace removed, each depth scaled by its own robust spread, -4..4 spreads onto 0..255."""
    s = samples_of(traces)
    median = group_quantiles(s, [*LINE, "sample"], "amp", {"med": 0.5}, line_rows)
    x = s.join(median, [*LINE, "sample"]).withColumn("amp", C("amp") - C("med")).drop("med")
    spread = group_quantiles(x.withColumn("a", F.abs("amp")), [*LINE, "sample"], "a", {"mad": 0.5}, line_rows)
    scaled = C("amp") / (1.4826 * C("mad") + 1e-12) / 4.0
    level = F.rint((F.least(F.greatest(scaled, F.lit(-1.0)), F.lit(1.0)) + 1.0) * 127.5).cast("int")
    return x.join(spread, [*LINE, "sample"]).select(*LINE, "trace", "sample", level.alias("level"))


def signal_to_noise(traces: DataFrame) -> DataFrame:
    """Per sample: mean |signal| over mean |neighbour difference| / sqrt 2, smoothed over nine rows."""
    from strata.operators.lines import trace_differences

    r = remove_background(traces, "mean")
    signal = samples_of(r).groupBy(*LINE, "sample").agg(F.avg(F.abs("amp")).alias("signal"))
    noise = samples_of(trace_differences(r)).groupBy(*LINE, "sample").agg((F.avg(F.abs("amp")) / F.sqrt(F.lit(2.0))).alias("noise"))
    ratio = signal.join(noise, [*LINE, "sample"]).select(*LINE, "sample", (C("signal") / F.greatest("noise", F.lit(1e-12))).alias("ratio"))
    # Nine copies of each ratio, one per row it reaches; rows beyond the record fall away.
    spread = ratio.select(*LINE, F.explode(F.sequence(C("sample") - 4, C("sample") + 4)).alias("sample"), C("ratio").alias("part"))
    return ratio.join(spread, [*LINE, "sample"]).groupBy(*LINE, "sample").agg((F.sum("part") / 9).alias("snr"))


def penetration(snr: DataFrame, dt: Column, n_samples: Column) -> DataFrame:
    """First sample from which the record stays at noise level; null when signal reaches the end."""
    skip = F.least(n_samples, F.rint(P.DIRECT_WAVE_WINDOW_NS / dt).cast("int"))
    last = F.greatest(F.max(F.when(C("snr") >= 1.3, C("sample"))), F.first(skip) - 1, F.lit(0))
    return snr.groupBy(*LINE).agg(last.alias("last"), F.first(n_samples).alias("n")).select(
        *LINE, F.when(C("last") < C("n") - 5, C("last") + 1).alias("penetration_sample"))


@dataclass(frozen=True)
class Chain:
    """Which steps run and with what parameters; the order is fixed."""

    time_zero_sample: int = 0
    dewow: bool = False
    dewow_window_samples: int = 25
    background_removal: str = "none"
    background_window_traces: int = 51
    bandpass: bool = False
    bandpass_low_mhz: float = 100.0
    bandpass_high_mhz: float = 1200.0
    gain: str = "none"
    agc_window_samples: int = 40
    gain_exponent: float = 2.0
    stack_traces: int = 1
    migrate: bool = False
    migration_velocity_m_per_ns: float = 0.0999
    migration_aperture_traces: int = 40


def chain_from(values: dict[str, object]) -> Chain:
    """A chain from untrusted values: unknown names and unclear switches are refused."""
    known = {f.name: type(f.default) for f in fields(Chain)}
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ValueError(f"unknown processing parameter(s): {unknown}")
    clean: dict[str, object] = {}
    for name, value in values.items():
        if known[name] is bool:
            text = str(value).lower()
            if text not in ("true", "false"):
                raise ValueError(f"{name} must be true or false, got {value!r}")
            clean[name] = text == "true"
        else:
            clean[name] = known[name](value)
    return replace(Chain(), **clean)


def run_chain(traces: DataFrame, chain: Chain) -> DataFrame:
    t = apply_time_zero(traces, chain.time_zero_sample)
    if chain.dewow:
        t = dewow(t, chain.dewow_window_samples)
    t = remove_background(t, chain.background_removal, chain.background_window_traces)
    if chain.bandpass:
        t = bandpass(t, chain.bandpass_low_mhz, chain.bandpass_high_mhz)
    if chain.migrate:
        t = migrate(t, chain.migration_velocity_m_per_ns, chain.migration_aperture_traces)
    t = apply_gain(t, chain.gain, chain.agc_window_samples, chain.gain_exponent)
    return stack_traces(t, chain.stack_traces)
