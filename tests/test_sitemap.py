"""From raw traces of three channels to placed targets with depth, error and contrast."""

import numpy as np
import pytest

from strata.operators import sitemap as T

SPACING = 0.025


def channel(dt, zero_ns, targets, seed, n=200, samples=96):
    """(trace, samples) of a direct wave and of echoes of the same (or the opposite) sign at (trace, ns below zero, sign)."""
    rng = np.random.default_rng(seed)
    block = rng.normal(0, 0.01, (samples, n))
    block[round(zero_ns / dt)] += 3.0
    for trace, ns, sign in targets:
        for x in range(max(0, trace - 40), min(n, trace + 41)):
            s = round((np.hypot(ns, 2 * (x - trace) * SPACING / 0.0999333) + zero_ns) / dt)
            if s + 1 < samples:
                block[s, x] += sign
                block[s + 1, x] += 0.4 * sign
    return block


def test_a_buried_target_is_one_row_with_its_place_depth_and_contrast(spark):
    rows = []
    for name, dt, zero, seed in (("RAD", 0.2, 1.6, 1), ("RA1", 0.2, 2.0, 2), ("RA2", 0.25, 2.5, 3)):
        block = channel(dt, zero, [(60, 8.0, 1.0), (140, 11.0, -1.0)], seed)
        rows += [(7, name, t, dt, SPACING, block[:, t].tolist()) for t in range(block.shape[1])]
    traces = spark.createDataFrame(rows, "line_id long, channel string, trace int, dt double, spacing double, samples array<double>").repartition(4)
    headers = spark.createDataFrame([(7, c, 9.0) for c in ("RAD", "RA1", "RA2")], "line_id long, channel string, dielectric double")
    fixes = spark.createDataFrame([(7, 20 * k, 12.9 + 20 * k * 2.2e-7, 77.5) for k in range(11)], "line_id long, trace int, lat double, lon double")
    human = spark.createDataFrame([(7, 3, 100, 6.0, 0.55, "RAD")], "line_id long, pick_id long, trace int, time_ns double, depth_m double, channel string")
    got = T.targets_from_traces(traces, headers, fixes, SPACING, human).collect()
    both = {}
    for trace, ns in ((60, 8.0), (140, 11.0)):
        near = [r for r in got if r["status"] == "detected" and abs(r["trace"] - trace) <= 4 and abs(r["time_ns"] - ns) <= 1.2]
        assert len(near) == 1
        both[trace] = near[0]
        assert sorted(near[0]["channels"]) == ["RA1", "RA2", "RAD"] and near[0]["depth_basis"] == "header"
        assert near[0]["depth_m"] == pytest.approx(0.0999333 * ns / 2, abs=0.07) and near[0]["lat"] == pytest.approx(12.9 + trace * 2.2e-7, abs=2e-6)
    assert both[60]["contrast"] != both[140]["contrast"]
    picked = [r for r in got if r["status"] == "picked"]
    assert [(r["target_id"], r["depth_m"], r["depth_basis"]) for r in picked] == [(-4, 0.55, "picked")]


def test_permittivity_falls_back_from_header_to_site_to_default(spark):
    headers = spark.createDataFrame([(1, "A", 6.0), (1, "B", 6.0), (2, "A", 0.0), (3, "A", 1.0), (3, "B", 5.0)], "line_id long, channel string, dielectric double")
    site = spark.createDataFrame([(2, 12.0)], "line_id long, dielectric double")
    got = {r["line_id"]: (r["dielectric"], r["depth_basis"]) for r in T.usable_permittivity(headers, site).collect()}
    assert got == {1: (6.0, "header"), 2: (12.0, "site"), 3: (9.0, "assumed")}
