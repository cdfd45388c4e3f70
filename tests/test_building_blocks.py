"""Quantiles, components, ordinals and band joins against plain Python, hot keys included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.geo import geodesic_m
from strata.operators.bands import assign_in_order, band_aggregate, band_join, bracket, ordinal, with_next
from strata.operators.detect import suppress_neighbours
from strata.operators.graph import connected_components
from strata.operators.quantiles import group_quantiles


def skewed(n, seed):
    rng = random.Random(seed)
    return [("hot" if i % 3 else f"k{i % 17}", rng.choice([rng.gauss(0, 10), float(rng.randint(0, 4))])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 9000])
def test_quantiles_are_exact_with_a_hot_key(spark, n):
    rows = skewed(n, n)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in group_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.995}).collect()}
    for k in {r[0] for r in rows}:
        values = [v for key, v in rows if key == k]
        for name, p in (("a", 10), ("m", 50), ("z", 99.5)):
            assert got[k][name] == pytest.approx(np.percentile(values, p), abs=1e-9)


def test_quantiles_of_everything(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert group_quantiles(df, [], "v", {"m": 0.25}).first()["m"] == 250.0


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    parent = {i: i for i in range(500)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.range(500).withColumnRenamed("id", "node")
    got = connected_components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: find(i) for i in range(500)}


def test_ordinal_counts_across_stretches(spark):
    rows = [("a" if i % 4 else "b", float((i * 37) % 101), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    got = {(r["k"], r["i"]): r["rank"] for r in ordinal(df, ["k"], ["x", "i"], 7.0).collect()}
    for k in "ab":
        order = sorted((x, i) for key, x, i in rows if key == k)
        assert [got[(k, i)] for _, i in order] == list(range(1, len(order) + 1))


def test_with_next_crosses_empty_stretches(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 950.0), ("b", 3.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["next_x"] for r in with_next(df, ["k"], ["x"], ["x"], 10.0).collect()}
    assert got == {("a", 1.0): 2.0, ("a", 2.0): 950.0, ("a", 950.0): None, ("b", 3.0): None}


def test_bracket_prefers_the_first_of_touching_intervals(spark):
    spans = spark.createDataFrame([("a", 0.0, 5.0, "one"), ("a", 5.0, 9.0, "two")], "k string, c0 double, c1 double, name string")
    points = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("a", 9.5)], "k string, x double")
    got = {r["x"]: r["name"] for r in bracket(points, "x", spans, "c0", "c1", ["k"], 2.0).collect()}
    assert got == {5.0: "one", 7.0: "two", 9.5: None}


def test_band_join_and_aggregate_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), round(rng.uniform(-3, 3), 2), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, x double, i long")
    other = df.select("k", F.col("x").alias("y"), F.col("i").alias("j"))
    want = {(a, b) for ka, x, a in rows for kb, y, b in rows if ka == kb and abs(x - y) <= 0.3}
    assert {(r["i"], r["j"]) for r in band_join(df, other, ["k"], [("x", "y", 0.3)]).collect()} == want
    counts = {(r["k"], r["x"]): r["n"] for r in band_aggregate(df, ["k"], "x", 0.3, {"n": F.count("*")}, {"n": "sum"}, tile=1.1).collect()}
    for k, x, _ in rows:
        assert counts[(k, x)] == sum(abs(y - x) <= 0.3 + 1e-12 for kk, y, _ in rows if kk == k)


def test_in_order_assignment(spark):
    edges = spark.createDataFrame([("p", 1, 10, 0.1), ("p", 1, 11, 0.2), ("p", 2, 10, 0.05), ("p", 2, 11, 0.3), ("p", 3, 11, 0.0)], "k string, l long, r long, c double")
    got = {(r["l"], r["r"]) for r in assign_in_order(edges, ["k"], "l", "r", ["l", "c", "r"]).collect()}
    assert got == {(1, 10), (2, 11)}  # a later, cheaper claim does not displace an earlier one


def test_neighbour_suppression_equals_strongest_first(spark):
    rng = random.Random(3)
    rows = [(1, round(rng.uniform(0, 4), 3), round(rng.uniform(0, 6), 3), rng.random(), i) for i in range(200)]
    kept = []
    for row in sorted(rows, key=lambda r: (-r[3], r[4])):
        if not any(abs(row[1] - k[1]) <= 0.3 and abs(row[2] - k[2]) <= 1.5 for k in kept):
            kept.append(row)
    df = spark.createDataFrame(rows, "k int, x double, t double, s double, i long")
    got = suppress_neighbours(df, ["k"], [("x", 0.3), ("t", 1.5)], "s", "i")
    assert {r["i"] for r in got.collect()} == {k[4] for k in kept}


def test_geodesic_known_distances(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (12.9, 77.5, 12.9, 77.5)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geodesic_m(*[F.col(c) for c in "abcd"])).collect()]
    assert got == pytest.approx([111319.491, 110574.389, 0.0], abs=0.01)


def _clusters(spark, spots, min_samples):
    from strata.operators import corroborate as K

    df = spark.createDataFrame([(1, i, "RAD", p, d) for i, (p, d) in enumerate(spots)], "line_id long, apex_id long, channel string, position_m double, depth_m double")
    got = {}
    for r in K.clusters(df, min_samples).collect():
        got.setdefault(tuple(r["cluster"]), set()).add(r["apex_id"])
    return sorted(map(sorted, got.values()))


def _plain_clusters(spots, min_samples):
    """Core points chained by plain loops; borders are left to whichever cluster they touch first, so only cores are compared when there are any."""
    near = [[j for j, (q, e) in enumerate(spots) if abs(p - q) <= 0.30 and abs(d - e) <= 0.35] for p, d in spots]
    core = {i for i, n in enumerate(near) if len(n) >= min_samples}
    left, out = set(core), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            todo += [j for j in near[i] if j in core and j not in seen and j not in todo]
        left -= seen
        out.append(sorted(seen))
    return sorted(out), core


def test_clusters_on_cells_equal_plain_loops(spark):
    import random

    for seed, step, min_samples in ((1, 0.0125, 2), (2, 0.05, 3), (3, 0.15, 4), (4, 0.1, 1)):
        rng = random.Random(seed)
        spots = [(round(rng.randrange(400) * step, 6), round(rng.randrange(40) * 0.05, 6)) for _ in range(140)]
        want, core = _plain_clusters(spots, min_samples)
        got = [sorted(set(c) & core) for c in _clusters(spark, spots, min_samples)]
        assert sorted(got) == want


def test_a_dense_line_makes_few_links(spark):
    from strata.operators import corroborate as K

    df = spark.range(4000).selectExpr("1L AS line_id", "id AS apex_id", "'RAD' AS channel", "(id % 997) * 0.003 AS position_m", "(id % 89) * 0.01 AS depth_m")
    spots = K._in_cells(K.with_node_ids(K.places(df)))
    core = spots.join(spots.groupBy("line_id", "cp", "cd").agg({"node": "min"}).withColumnRenamed("min(node)", "cell"), ["line_id", "cp", "cd"])
    assert K._cell_links(core).count() < 300  # 4,000 places have over a million pairs within reach
    assert K.clusters(df).select("cluster").distinct().count() == 1


def test_fit_counts_a_point_at_the_edge_of_a_vote_as_sql_does():
    from strata.operators.fit import fit_points

    samples = [53, 54, 56, 51, 56, 49, 48, 52, 49, 58, 47, 48, 46, 49, 50, 46, 49, 46, 47, 46, 48, 52, 47, 49, 63, 47, 54, 50, 49, 53, 48, 47, 51, 48, 48, 48, 54, 49, 50, 61]
    x0, t0, k, r2, inliers = fit_points(range(40), samples)
    assert (round(x0, 3), round(t0, 3), round(k, 3), round(r2, 3), inliers) == (21.504, 47.599, 0.863, 0.387, 36)


def test_lines_at_one_offset_but_for_the_last_bit_keep_their_order(spark):
    from strata.operators.placement import across_order

    lines = [(1, i, 1.0, 0.0, lat, 77.5) for i, lat in ((1, 12.900000000000002), (2, 12.9), (3, 12.8))]
    rows = across_order(spark.createDataFrame(lines, "site int, line_id int, dir_east double, dir_north double, lat0 double, lon0 double"), ["site"], "line_id").collect()
    assert {r.line_id: r["rank"] for r in rows} == {3: 1, 1: 2, 2: 3}


def test_risk_does_not_depend_on_the_order_of_the_rows(spark):
    from strata.operators.findings import risk_by_frame

    rows = [(frame, "elongated_linear_target", c) for frame, order in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1)), (3, (float("nan"), 0.1)), (4, (None,))) for c in order]
    got = {r.frame_id: r.score for r in risk_by_frame(spark.createDataFrame(rows, "frame_id int, class_name string, confidence double")).collect()}
    assert got[1] == got[2] == 0.6 / 3 and np.isnan(got[3]) and got[4] is None


def test_folded_and_cell_clusters_agree(spark):
    import random

    from strata.operators import corroborate as K

    rng = random.Random(5)
    rows = [(line, i, "RAD", rng.randrange(60) * 0.1, rng.randrange(12) * 0.1) for line in range(30) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "line_id long, apex_id long, channel string, position_m double, depth_m double")
    got = [sorted(map(tuple, f(df, 2).select(*df.columns, "cluster").collect())) for f in (K._folded_clusters, K._cell_clusters)]
    assert got[0] == got[1] and got[0]


def test_small_clusters_write_no_pairs_or_trials(spark):
    """Before, a cluster of three places sent 200 trials; now its places travel once."""
    from strata.operators import corroborate as K

    df = spark.range(300).selectExpr("id div 3 AS line_id", "id AS apex_id", "'RAD' AS channel", "(id % 3) * 0.1 AS position_m", "(id % 3) * 0.05 AS depth_m")
    runs = K.run_lines(K.clusters(df))
    assert "sequence" not in runs._jdf.queryExecution().analyzed().toString()
    assert [(round(r["slope"], 9), round(r["residual_m"], 6)) for r in runs.collect()] == [(0.5, 0.0)] * 100


def test_folded_and_drawn_runs_agree(spark):
    import random

    from strata.operators import corroborate as K

    rng = random.Random(6)
    rows = [(c, rng.randrange(20) * 0.1, rng.randrange(20) * 0.05) for c in range(40) for _ in range(rng.randrange(1, 6))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "line_id long, position_m double, depth_m double, cluster int")
    spots = df.groupBy("line_id", "cluster", "position_m", "depth_m").agg(F.count("*").alias("n"))
    keys = ("line_id", "cluster")
    folded, drawn = ({r["line_id"]: (round(r["slope"], 6), round(r["residual_m"], 6)) for r in f.collect()} for f in (K._folded_runs(spots, keys), K._drawn_runs(df, spots, keys)))
    assert folded == drawn


def test_folded_suppression_and_rounds_agree_and_a_fold_travels_once(spark):
    import random

    from strata.operators import detect as D

    rng = random.Random(8)
    rows = [(k, rng.randrange(30) * 0.1, rng.randrange(20) * 0.5, float(rng.randrange(9)), i) for k in range(12) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k int, x double, t double, s double, i long")
    args = (df, ["k"], [("x", 0.3), ("t", 1.5)], "s", "i")
    got = D.suppress_neighbours(*args)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # before, each round joined twice
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D._suppress_in_rounds(*args).collect()))


def test_pages_are_read_where_their_words_meet_as_by_joins(spark, monkeypatch):
    from strata.operators import drawings as D

    rng = random.Random(4)
    kinds = ["STORM", "WATER", "PIPE", "LINE", "GAS", "Depth", "Depth=1.2m", "0.8m", "1.5m", "Lat", "Long", "12.91", "77.52", "x", *["Lat12.90", "Long77.51"] * 4]
    rows = []
    for page in range(1, 13):
        for i in range(40):
            x, y = rng.randrange(0, 60, 3), rng.randrange(0, 40) * 0.5
            rows.append((7, page, i, rng.choice(kinds), float(x), float(x + 6), y, y + 3))
    words = spark.createDataFrame(rows, "drawing long, page long, word_id long, text string, x0 double, x1 double, top double, bottom double")
    steps = (D.depth_lines, D.utility_names, D.printed_positions, D.read_callouts)
    folded = [step(words) for step in steps]
    assert all(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 for df in folded)  # words travel once
    got = [sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for df in folded]
    monkeypatch.setattr(D, "FOLDED", 0)
    want = [sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for df in (step(words) for step in steps)]
    assert got == want and all(want)


def test_queries_are_listed_before_there_is_a_session():
    import subprocess
    import sys
    from pathlib import Path

    listed = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert listed.returncode == 0, listed.stderr
    assert all(int(n) for n in listed.stdout.split())


def test_words_of_a_drawing_travel_once_and_give_what_joins_give(spark, monkeypatch):
    import random

    from strata.operators import drawings as D

    rng = random.Random(12)
    kinds = ["ELECTRIC", "WATER", "storm", "Depth", "Depth=1.2m", "1.5m", "0.9m", "CH-20", "CH-40", "CH-60", "Safe", "LEGEND", "L-SECTION", "word", None]
    weights = [4, 4, 2, 6, 2, 6, 3, 1, 1, 1, 1, 0.2, 0.3, 3, 1]
    words = [(d, p, i, rng.choices(kinds, weights)[0], x := float(rng.randrange(0, 60, 3)), x + 12.0, y := float(rng.randrange(0, 90, 3)), y + 4.0) for d in range(4) for p in (1, 2, 3) for i in range(60 if d else 30)]
    words += words[:30] + [(None, 1, 0, "WATER", 0.0, 9.0, 0.0, 4.0), (1, 1, None, "WATER", 0.0, 9.0, 0.0, 4.0), (9, 1, 0, "WATER", 0.0, 9.0, 0.0, 4.0)]
    words += [(9, 1, None, t, x, x + 2.0, 3.0, 5.0) for t, x in (("CH-20", 4.0), ("CH-40", 24.0))] + [(9, 1, 1, "Depth=1.2m", 0.0, 9.0, 5.0, 8.0)]  # ticks need no id
    words += [(3, 1, 900 + k, t, 0.0 + k, 9.0, 2.0 * k, 4.0) for k, t in enumerate(("Lat12.5", "Long77.5"))]
    w = spark.createDataFrame(words, "drawing long, page int, word_id long, text string, x0 double, x1 double, top double, bottom double")
    pages = spark.createDataFrame([(d, p, 90.0, 90.0) for d in range(4) for p in (1, 2, 3)] + [(5, 1, 90.0, 90.0), (9, 1, 90.0, 90.0)], "drawing long, page int, width double, height double")
    at_once = D.read_drawings(w, pages)
    assert not any("ExistingRDD checkpoint" in df._jdf.queryExecution().executedPlan().toString() for df in at_once)  # no words are written
    got = [sorted(map(repr, df.collect())) for df in at_once]
    assert all(got)
    (ticked,) = (r for r in at_once[0].collect() if r["drawing"] == 9)
    assert (ticked["chainage_m"], ticked["chainage_source"]) == (19.5, "plan_ticks")
    monkeypatch.setattr(D, "FOLDED", 40)  # some pages are folded, others are not
    assert got == [sorted(map(repr, df.collect())) for df in D.read_drawings(w, pages)]
