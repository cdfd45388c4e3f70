"""Synthetic lines with known answers: picks at apexes, velocities recovered, noise left alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.physics import velocity_from_dielectric
from strata.operators import detect as D
from strata.operators import fit as T
from strata.operators import process as R
from strata.operators.lines import LINE, map_tiles

DT, DX = 0.2, 0.025


def line(spark, v=None, apex=60, t0=15.0, n=120, samples=256, noise=0.02, seed=0, flat=None, line_id=1, channel="RAD", direct=True):
    rng = np.random.default_rng(seed)
    t = np.arange(samples) * DT
    wavelet = lambda c: (1 - 2 * (np.pi * 0.5 * (t - c)) ** 2) * np.exp(-((np.pi * 0.5 * (t - c)) ** 2))
    rows = []
    for x in range(n):
        a = rng.normal(0, noise, samples)
        if direct:
            a = a + 3.0 * wavelet(2.0)
        if v:
            a = a + wavelet(np.sqrt(t0**2 + (2 * (x - apex) * DX / v) ** 2))
        if flat:
            a = a + wavelet(flat)
        rows.append((line_id, channel, x, DT, DX, [float(s) for s in a]))
    return spark.createDataFrame(rows, "line_id long, channel string, trace int, dt double, spacing double, samples array<double>")


def apex_at(spark, trace, sample):
    return spark.createDataFrame([(1, "RAD", 7, trace, sample)], "line_id long, channel string, apex_id long, trace int, sample int")


def test_migration_focuses_the_apex(spark):
    t = R.remove_background(line(spark, v=0.1), "mean")
    m = R.samples_of(R.migrate(t, 0.1, 40), "v").filter(F.col("sample").between(40, 200))
    best = m.orderBy(F.desc(F.abs("v"))).first()
    assert abs(best["trace"] - 60) <= 2 and abs(best["sample"] - 75) <= 3


def test_tiles_of_a_long_line_equal_the_whole_line(spark):
    t = line(spark, v=0.1, apex=300, n=600, samples=64, t0=6.0)
    fn = lambda block, first, n, row: R.migrate_block(block, row["spacing"], row["dt"], 0.1, 20)
    parts = R.samples_of(map_tiles(t, fn, halo=20, extra=("spacing", "dt"), tile=64), "a")
    whole = R.samples_of(map_tiles(t, fn, halo=20, extra=("spacing", "dt"), tile=4096), "b")
    j = parts.join(whole, [*LINE, "trace", "sample"])
    assert j.count() == 600 * 64
    assert j.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9


@pytest.mark.parametrize("tile", [64, 4096])
def test_moving_background_is_the_same_for_any_tile(spark, tile):
    t = line(spark, v=0.1, n=200, samples=32, t0=3.0)
    block = np.array([r["samples"] for r in t.orderBy("trace").collect()])
    want = block - np.stack([block[np.clip(np.arange(i - 10, i + 11), 0, 199)].mean(axis=0) for i in range(200)])
    got = map_tiles(t, lambda b, f, n, r: b - R.running_mean(b, 21, axis=1), halo=10, tile=tile).orderBy("trace").collect()
    assert np.allclose(np.array([r["samples"] for r in got]), want)


def test_strongest_pick_is_at_the_apex(spark):
    p = D.pick_targets(line(spark, v=0.1, noise=0.01), DX, dielectric=F.lit(9.0)).orderBy("rank").first()
    assert abs(p["trace"] - 60) <= 2 and abs(p["sample"] - 75) <= 3


@pytest.mark.parametrize("v", [0.06, 0.10, 0.12])
def test_fit_recovers_the_velocity(spark, v):
    t = line(spark, v=v, noise=0.01)
    box = spark.createDataFrame([(1, "RAD", 1, 35, 65, 50, 60)], "line_id long, channel string, box_id long, x int, y int, w int, h int")
    points = D.ridge_points(R.normalized_envelope(t), box)
    lines = spark.createDataFrame([(1, "RAD", DT, DX, 256)], "line_id long, channel string, dt double, spacing double, n_samples int")
    f = T.physical_fits(points, [*LINE, "box_id"], lines).first()
    assert f["reason"] is None
    assert f["velocity"] == pytest.approx(v, rel=0.2)


def test_points_at_random_fit_nothing():
    rng = np.random.default_rng(1)
    xs = np.arange(60.0)
    assert T.fit_points(xs, rng.uniform(0, 200, 60)) is None
    assert T.fit_points(xs[:2], xs[:2]) is None


def test_focusing_finds_the_velocity_and_noise_stays_flat(spark):
    t = R.remove_background(line(spark, v=0.1), "mean")
    s = T.focusing_sweep(t, apex_at(spark, 60, 75)).first()
    assert s["well_constrained"] and s["velocity"] == pytest.approx(0.1, abs=0.012)
    noise = T.focusing_sweep(R.remove_background(line(spark, noise=1.0, direct=False), "mean"), apex_at(spark, 60, 75)).first()
    assert not noise["well_constrained"]


def test_semblance_peaks_at_the_true_permittivity(spark):
    t = R.remove_background(line(spark, v=0.0999, direct=False), "mean")
    c = T.semblance_curves(t, apex_at(spark, 60, 75)).withColumn("peaked", T.is_peaked(F.col("curve"))).first()
    assert c["peaked"] and T.SEMBLANCE_EPS[int(np.argmax(c["curve"]))] == pytest.approx(9.0, rel=0.12)
    flat = T.semblance_curves(line(spark, flat=15.0, direct=False, noise=0.05), apex_at(spark, 60, 75)).withColumn("peaked", T.is_peaked(F.col("curve"))).first()
    assert not flat["peaked"]


def test_time_zero_is_the_direct_wave(spark):
    z = R.time_zero(line(spark, v=0.1)).first()
    assert z["zero_ns"] == pytest.approx(2.0, abs=0.41) and not z["uncertain"]


def test_chain_refuses_unknown_and_unclear_values():
    assert R.chain_from({"dewow": "true", "stack_traces": "3"}).stack_traces == 3
    with pytest.raises(ValueError):
        R.chain_from({"dewov": True})
    with pytest.raises(ValueError):
        R.chain_from({"dewow": "yes"})


def test_shadow_fold_goes_on_when_its_first_rows_are_used_up(spark, monkeypatch):
    monkeypatch.setattr(D, "FOLD_ROWS", 4)
    rows = [(1, 50, 5, 100.0)] + [(1, 50, 10 + i, 20.0 - i * 0.01) for i in range(30)] + [(1, 200, 5, 1.0)]
    peaks = spark.createDataFrame(rows, "line_id long, trace int, sample int, strength double")
    kept = D.keep_without_shadows(peaks, DX, 3, ["line_id"]).orderBy("rank").collect()
    assert [(k["trace"], k["strength"]) for k in kept] == [(50, 100.0), (200, 1.0)]


def test_velocity_round_trip(spark):
    df = spark.createDataFrame([(9.0,), (-1.0,)], "e double").select(velocity_from_dielectric(F.col("e")).alias("v"))
    assert [r["v"] for r in df.collect()] == [pytest.approx(0.2998 / 3), None]
