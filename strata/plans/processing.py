"""Radargram processing queries over the trace view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strata.operators import process as R
from strata.operators.lines import largest_line
from strata.plans import views as V
from strata.plans.registry import query

C = F.col
KEY = ("line_id", "channel", "trace", "sample")


def long(traces, digits=6):
    s = R.samples_of(traces, "v")
    return s.select(*KEY, F.round("v", digits).alias("amp"))


def kernel_values(kernel) -> str:
    return "(VALUES " + ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(map(float, kernel))) + ") AS k(i, h)"


def convolved(values: str, source: str = "samples") -> str:
    """Circular convolution of every trace with a fixed kernel."""
    return f"""SELECT a.line_id, a.channel, a.trace, CAST((a.sample + k.i) % 64 AS INTEGER) AS sample, sum(a.amp * k.h) AS v
      FROM {source} a, {values} GROUP BY ALL"""


_HILBERT = np.fft.ifft(np.where(np.arange(64) == 0, 0, np.where(np.arange(64) < 32, -1j, np.where(np.arange(64) == 32, 0, 1j)))).real
_BAND = np.fft.irfft(R.bandpass_response(64, 0.2, 100.0, 1200.0), n=64)
DEMEANED = "dm AS (SELECT line_id, channel, trace, sample, dt, amp - avg(amp) OVER (PARTITION BY line_id, channel, sample) AS amp FROM samples)"
# Running means repeat the edge values: a window position outside the record reads the nearest one inside.
_DOWN = """SELECT a.line_id, a.channel, a.trace, a.sample, a.amp, avg(b.amp) AS m FROM {s} a, range(-{h}, {h} + 1) AS o(d), {s} b
   WHERE b.line_id = a.line_id AND b.channel = a.channel AND b.trace = a.trace AND b.sample = least(greatest(a.sample + d, 0), 63) GROUP BY ALL"""


@query("P01_time_zero", "SELECT line_id, channel, trace, sample - 5 AS sample, round(amp, 6) + 0.0 AS amp FROM samples WHERE sample >= 5")
def _(spark, sf):
    return long(R.apply_time_zero(V.traces(spark, sf), 5))


@query("P02_W01_dewow", f"""WITH w AS ({_DOWN.format(s='samples', h=12)}) SELECT line_id, channel, trace, sample, round(amp - m, 6) + 0.0 AS amp FROM w""")
def _(spark, sf):
    return long(R.dewow(V.traces(spark, sf), 25))


@query("P03_W02_background_mean", f"WITH {DEMEANED} SELECT line_id, channel, trace, sample, round(amp, 6) + 0.0 AS amp FROM dm")
def _(spark, sf):
    return long(R.remove_background(V.traces(spark, sf), "mean"))


@query("P03_W01_background_moving", """
  WITH n AS (SELECT line_id, channel, max(trace) AS last FROM samples GROUP BY ALL),
  w AS (SELECT a.line_id, a.channel, a.trace, a.sample, a.amp, avg(b.amp) AS m FROM samples a JOIN n USING (line_id, channel), range(-7, 8) AS o(d), samples b
    WHERE n.last + 1 > 15 AND b.line_id = a.line_id AND b.channel = a.channel AND b.sample = a.sample AND b.trace = least(greatest(a.trace + d, 0), n.last) GROUP BY ALL
    UNION ALL SELECT line_id, channel, trace, sample, amp, avg(amp) OVER (PARTITION BY line_id, channel, sample) FROM samples JOIN n USING (line_id, channel) WHERE n.last + 1 <= 15)
  SELECT line_id, channel, trace, sample, round(amp - m, 6) + 0.0 AS amp FROM w""")
def _(spark, sf):
    return long(R.remove_background(V.traces(spark, sf), "moving", 15))


@query("P04_bandpass", f"SELECT line_id, channel, trace, sample, round(v, 6) + 0.0 AS amp FROM ({convolved(kernel_values(_BAND))})")
def _(spark, sf):
    return long(R.bandpass(V.traces(spark, sf), 100.0, 1200.0))


@query("P05_gain_agc", f"""
  WITH ab AS (SELECT line_id, channel, trace, sample, abs(amp) AS amp FROM samples), w AS ({_DOWN.format(s='ab', h=20)}), g AS (SELECT line_id, channel, avg(amp) AS level FROM ab GROUP BY ALL)
  SELECT s.line_id, s.channel, s.trace, s.sample, round(s.amp / greatest(w.m, greatest(g.level * 0.05, 1e-12)), 6) + 0.0 AS amp
  FROM samples s JOIN w USING (line_id, channel, trace, sample) JOIN g USING (line_id, channel)""")
def _(spark, sf):
    return long(R.apply_gain(V.traces(spark, sf), "agc", 40))


@query("P06_stack_traces", """
  WITH n AS (SELECT line_id, channel, max(trace) + 1 AS n FROM samples GROUP BY ALL)
  SELECT line_id, channel, CAST(CASE WHEN n < 3 THEN trace ELSE trace // 3 END AS INTEGER) AS trace, sample, round(avg(amp), 6) + 0.0 AS amp
  FROM samples JOIN n USING (line_id, channel) GROUP BY ALL""")
def _(spark, sf):
    return long(R.stack_traces(V.traces(spark, sf), 3))


@query("P07_chain", f"""
  WITH cut AS (SELECT line_id, channel, trace, sample - 4 AS sample, amp FROM samples WHERE sample >= 4),
  w AS ({_DOWN.format(s='cut', h=5).replace('63', '59')}), d AS (SELECT line_id, channel, trace, sample, amp - m AS amp FROM w),
  b AS (SELECT line_id, channel, trace, sample, amp - avg(amp) OVER (PARTITION BY line_id, channel, sample) AS amp FROM d),
  g AS (SELECT line_id, channel, trace, sample, amp * (1.0 + sample / 59 * 2.0) AS amp FROM b), n AS (SELECT line_id, channel, max(trace) + 1 AS n FROM g GROUP BY ALL)
  SELECT line_id, channel, CAST(CASE WHEN n < 2 THEN trace ELSE trace // 2 END AS INTEGER) AS trace, sample, round(avg(amp), 6) + 0.0 AS amp FROM g JOIN n USING (line_id, channel) GROUP BY ALL""")
def _(spark, sf):
    chain = R.chain_from({"time_zero_sample": 4, "dewow": "true", "dewow_window_samples": 11, "background_removal": "mean", "gain": "linear", "stack_traces": 2})
    return long(R.run_chain(V.traces(spark, sf), chain))


def migrated_sql(source: str, aperture: int, velocity: float) -> str:
    return f"""SELECT o.line_id, o.channel, o.trace, o.i AS sample, sum(o.w * b.amp) / greatest(sum(o.w), 1e-12) AS amp FROM
      (SELECT t.line_id, t.channel, t.trace, d, i, CAST(round_even(tr / 0.2, 0) AS INTEGER) AS row, CASE WHEN tr > 0 THEN (i * 0.2) / tr ELSE 0.0 END AS w
       FROM (SELECT DISTINCT line_id, channel, trace FROM samples) t, (SELECT CAST(d AS INTEGER) AS d, CAST(i AS INTEGER) AS i,
         sqrt((i * 0.2) * (i * 0.2) + (2.0 * abs(d) * 0.025 / {velocity}) * (2.0 * abs(d) * 0.025 / {velocity})) AS tr FROM range(-{aperture}, {aperture} + 1) AS a(d), range(64) AS s(i))) o
      JOIN {source} b ON b.line_id = o.line_id AND b.channel = o.channel AND b.trace = o.trace + o.d AND b.sample = o.row GROUP BY o.line_id, o.channel, o.trace, o.i"""


@query("P08_migration", f"SELECT line_id, channel, trace, sample, round(amp, 6) + 0.0 AS amp FROM ({migrated_sql('samples', 8, 0.0999)})")
def _(spark, sf):
    return long(R.migrate(V.traces(spark, sf), 0.0999, 8))


@query("P09_envelope", f"""
  SELECT s.line_id, s.channel, s.trace, s.sample, round(sqrt(s.amp * s.amp + c.v * c.v), 6) AS amp FROM samples s JOIN ({convolved(kernel_values(_HILBERT))}) c USING (line_id, channel, trace, sample)""")
def _(spark, sf):
    return long(R.envelope(V.traces(spark, sf)))


def _mirror(e: str, last: str) -> str:
    return f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > {last} THEN 2 * {last} - ({e}) ELSE {e} END"


ENERGY = f"""{DEMEANED},
  ends AS (SELECT line_id, channel, max(trace) AS last FROM samples GROUP BY ALL),
  tall AS (SELECT a.line_id, a.channel, a.trace, a.sample, sum(b.amp * b.amp) AS e FROM dm a, range(-8, 9) AS o(d), dm b
    WHERE b.line_id = a.line_id AND b.channel = a.channel AND b.trace = a.trace AND b.sample = {_mirror('a.sample + d', '63')} GROUP BY ALL),
  energy AS (SELECT line_id, channel, trace, sample, CASE WHEN sample < 15 THEN 0.0 ELSE sqrt(e / 51) END AS amp FROM (SELECT a.line_id, a.channel, a.trace, a.sample, sum(b.e) AS e
    FROM tall a JOIN ends USING (line_id, channel), range(-1, 2) AS o(d), tall b
    WHERE b.line_id = a.line_id AND b.channel = a.channel AND b.sample = a.sample AND b.trace = {_mirror('a.trace + d', 'ends.last')} GROUP BY ALL))"""
NORMALIZED = f"""{ENERGY},
  bg AS (SELECT line_id, channel, sample, quantile_cont(amp, 0.5) AS bg FROM energy WHERE sample >= 15 GROUP BY ALL),
  fl AS (SELECT line_id, channel, quantile_cont(amp, 0.5) * 0.15 AS fl FROM energy WHERE sample >= 15 GROUP BY ALL),
  norm AS (SELECT e.line_id, e.channel, e.trace, e.sample, CASE WHEN e.amp > 0 THEN e.amp / greatest(bg.bg, fl.fl) ELSE 0.0 END AS amp
    FROM energy e LEFT JOIN bg USING (line_id, channel, sample) JOIN fl USING (line_id, channel))"""


@query("W12_blurred_energy", f"WITH {ENERGY} SELECT line_id, channel, trace, sample, round(amp, 6) AS amp FROM energy")
def _(spark, sf):
    return long(R.energy(V.traces(spark, sf)))


@query("P10_W03_normalized_envelope", f"WITH {NORMALIZED} SELECT line_id, channel, trace, sample, round(amp, 5) AS amp FROM norm")
def _(spark, sf):
    t = V.traces(spark, sf)
    return long(R.normalized_envelope(t, largest_line(t)), 5)


TIME_ZERO = f"""hil AS ({convolved(kernel_values(_HILBERT))}),
  ev AS (SELECT s.line_id, s.channel, s.trace, s.sample, sqrt(s.amp * s.amp + c.v * c.v) AS e FROM samples s JOIN hil c USING (line_id, channel, trace, sample)),
  arr AS (SELECT line_id, channel, trace, arg_max(sample, (e, -sample)) * 0.2 AS a FROM ev WHERE sample < 16 GROUP BY ALL),
  zeros AS (SELECT line_id, channel, quantile_cont(a, 0.5) AS zero_ns, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) > greatest(1.0, 5 * 0.2) AS uncertain FROM arr GROUP BY ALL)"""


@query("A24_time_zero", f"WITH {TIME_ZERO} SELECT line_id, channel, round(zero_ns, 6) AS zero_ns, uncertain FROM zeros")
def _(spark, sf):
    t = V.traces(spark, sf)
    return R.time_zero(t, largest_line(t)).withColumn("zero_ns", F.round("zero_ns", 6))


@query("P11_common_time_grid", f"""
  WITH {TIME_ZERO}, g AS (SELECT t.line_id, t.trace, t.channel, CAST(i AS INTEGER) AS row, round((z.zero_ns - 2.0 + i * 0.2) / 0.2, 9) AS p FROM
     (SELECT DISTINCT line_id, channel, trace FROM samples) t JOIN zeros z USING (line_id, channel), range(256) AS r(i)),
  v AS (SELECT g.line_id, g.trace, g.channel, g.row, CASE WHEN p >= 0 AND p <= 63 THEN a.amp + (b.amp - a.amp) * (p - floor(p)) ELSE 0.0 END AS v FROM g
     LEFT JOIN samples a ON a.line_id = g.line_id AND a.channel = g.channel AND a.trace = g.trace AND a.sample = floor(p)
     LEFT JOIN samples b ON b.line_id = g.line_id AND b.channel = g.channel AND b.trace = g.trace AND b.sample = least(floor(p) + 1, 63))
  SELECT line_id, trace, row, round(max(v) FILTER (WHERE channel = 'RAD'), 6) + 0.0 AS rad, round(max(v) FILTER (WHERE channel = 'RA1'), 6) + 0.0 AS ra1, round(max(v) FILTER (WHERE channel = 'RA2'), 6) + 0.0 AS ra2 FROM v GROUP BY ALL""")
def _(spark, sf):
    t = V.traces(spark, sf)
    s = R.stack_channels(t, R.time_zero(t, largest_line(t)), V.CHANNELS, rows=256)
    z = s.select("line_id", "trace", F.posexplode(F.arrays_zip(*[F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in ("rad", "ra1", "ra2")])).alias("row", "v"))
    return z.select("line_id", "trace", "row", *[F.round(f"v.{c}", 6).alias(c) for c in ("rad", "ra1", "ra2")])


@query("P12_overlapping_windows", """
  SELECT line_id, channel, n_traces, CAST(start AS BIGINT) AS start, CAST(least(start + 16, n_traces) AS BIGINT) AS "end" FROM
   (SELECT DISTINCT line_id, channel, n_traces, s AS start FROM line_table, range(0, 100000, 8) AS r(s) WHERE s <= greatest(n_traces - 16, 0) UNION SELECT line_id, channel, n_traces, greatest(n_traces - 16, 0) FROM line_table)""")
def _(spark, sf):
    return R.overlapping_windows(V.line_table(spark, sf), 16).select("line_id", "channel", "n_traces", "start", "end")


@query("X19_display_quantise", """
  WITH l AS (SELECT line_id, channel, quantile_cont(abs(amp), 0.98) AS lim FROM samples GROUP BY ALL)
  SELECT line_id, channel, trace, sample, CAST(round_even(least(greatest(amp / (2.0 * lim) + 0.5, 0.0), 1.0) * 255, 0) AS INTEGER) AS level FROM samples JOIN l USING (line_id, channel)""")
def _(spark, sf):
    t = V.traces(spark, sf)
    return R.samples_of(R.quantise(t, 98.0, largest_line(t)), "level")


@query("X20_robust_quantise", """
  WITH m AS (SELECT *, amp - quantile_cont(amp, 0.5) OVER (PARTITION BY line_id, channel, sample) AS x FROM samples),
  s AS (SELECT *, 1.4826 * quantile_cont(abs(x), 0.5) OVER (PARTITION BY line_id, channel, sample) + 1e-12 AS sp FROM m)
  SELECT line_id, channel, trace, sample, CAST(round_even((least(greatest(x / sp / 4.0, -1.0), 1.0) + 1.0) * 127.5, 0) AS INTEGER) AS level FROM s""")
def _(spark, sf):
    t = V.traces(spark, sf)
    return R.robust_quantise(t, largest_line(t))


_SNR = f"""{DEMEANED}, df AS (SELECT *, amp - lag(amp) OVER (PARTITION BY line_id, channel, sample ORDER BY trace) AS step FROM dm),
  ra AS (SELECT line_id, channel, sample, avg(abs(amp)) / greatest(avg(abs(step)) / sqrt(2.0), 1e-12) AS ratio FROM df GROUP BY ALL),
  snr AS (SELECT line_id, channel, sample, sum(ratio) OVER (PARTITION BY line_id, channel ORDER BY sample ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9 AS snr FROM ra)"""


@query("A22_signal_to_noise", f"WITH {_SNR} SELECT line_id, channel, sample, round(snr, 6) AS snr FROM snr")
def _(spark, sf):
    return R.signal_to_noise(V.traces(spark, sf)).withColumn("snr", F.round("snr", 6))


@query("A23_penetration", f"""WITH {_SNR} SELECT line_id, channel, CASE WHEN last < 59 THEN last + 1 END AS penetration_sample FROM
   (SELECT line_id, channel, greatest(coalesce(max(sample) FILTER (WHERE snr >= 1.3), 0), 14) AS last FROM snr GROUP BY ALL)""")
def _(spark, sf):
    return R.penetration(R.signal_to_noise(V.traces(spark, sf)), F.lit(0.2), F.lit(64))


@query("S10_moving_median_background", """
  SELECT line_id, channel, trace, sample, round(amp - quantile_cont(amp, 0.5) OVER (PARTITION BY line_id, channel, sample ORDER BY trace ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 6) + 0.0 AS amp,
         trace < 15 AS warming_up FROM samples""")
def _(spark, sf):
    from strata.operators.lines import trailing_median

    t = trailing_median(V.traces(spark, sf), 16)
    return t.select("line_id", "channel", "trace", "warming_up", F.posexplode("samples").alias("sample", "v")).select(*KEY, F.round("v", 6).alias("amp"), "warming_up")
