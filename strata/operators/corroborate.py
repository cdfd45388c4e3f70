"""Apexes that agree in position and depth, grouped into objects and summarised per channel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata import params as P
from strata.functions.text import hash_uniform
from strata.operators.bands import band_join
from strata.operators.graph import connected_components, with_node_ids
from strata.session import cut_lineage

C = F.col
FOLDED = 256  # apexes of a line up to which its clusters are found in one task
ALL_PAIRS = 14  # places of a cluster up to which all pairs are tried: they are at most RUN_TRIALS
CELLS = 1 << 20  # numbers of one array in a fold


def places(apexes: DataFrame) -> DataFrame:
    """One row per distinct (line, position, depth) with how many apexes share it."""
    return apexes.groupBy("line_id", "position_m", "depth_m").agg(F.count("*").alias("n_here"))


def near_places(spots: DataFrame, position_m: float = P.CLUSTER_POSITION_M, depth_m: float = P.CLUSTER_DEPTH_M) -> DataFrame:
    other = spots.select("line_id", C("position_m").alias("o_position"), C("depth_m").alias("o_depth"), C("n_here").alias("o_n"))
    return band_join(spots, other, ["line_id"], [("position_m", "o_position", position_m), ("depth_m", "o_depth", depth_m)])


COUNTED = 256  # places of a line that are counted where they meet


def neighbour_counts(apexes: DataFrame) -> DataFrame:
    """How many apexes (itself included) agree with each apex on both axes, each with its own tolerance."""
    spots = places(apexes)
    many = cut_lineage(spots.groupBy("line_id").agg(F.count("*").alias("places")).filter(C("places") > COUNTED).select("line_id"))
    large = None if many.isEmpty() else many
    few = spots if large is None else spots.join(large, "line_id", "left_anti")
    listed = few.groupBy("line_id").agg(F.collect_list(F.struct("position_m", "depth_m", "n_here")).alias("ps"))
    near = lambda a, b: (F.abs(a["position_m"] - b["position_m"]) <= P.CLUSTER_POSITION_M) & (F.abs(a["depth_m"] - b["depth_m"]) <= P.CLUSTER_DEPTH_M)
    total = lambda a: F.aggregate(F.filter("ps", lambda b: near(a, b)), F.lit(0).cast("long"), lambda n, b: n + b["n_here"])
    n = listed.select("line_id", F.explode(F.transform("ps", lambda a: F.struct(a["position_m"].alias("position_m"), a["depth_m"].alias("depth_m"), total(a).alias("n")))).alias("s"))
    n = n.select("line_id", "s.*").filter("n > 0")
    if large is not None:
        n = n.unionByName(near_places(spots.join(large, "line_id", "left_semi")).groupBy("line_id", "position_m", "depth_m").agg(F.sum("o_n").alias("n")))
    return apexes.join(n, ["line_id", "position_m", "depth_m"])


def _in_cells(spots: DataFrame) -> DataFrame:
    """With the cell of each place: a hair smaller than both tolerances, so that all places of one cell are neighbours."""
    small = 1 - 1e-6
    return spots.withColumn("cp", F.floor(C("position_m") / (P.CLUSTER_POSITION_M * small))).withColumn("cd", F.floor(C("depth_m") / (P.CLUSTER_DEPTH_M * small)))


def _front(side: DataFrame, pair: list[str], p: Column, d: Column) -> DataFrame:
    """Of each pair's places only those that no other passes in both p and d: if any place reaches across, one of these does."""
    ahead = W.partitionBy(*pair).orderBy(p.desc(), d.desc()).rowsBetween(W.unboundedPreceding, -1)
    return side.withColumn("best", F.max(d).over(ahead)).filter(C("best").isNull() | (d > C("best"))).drop("best")


def _cell_links(core: DataFrame) -> DataFrame:
    """(u, v): cells of which a core place of one is near a core place of the other. No pair of places is written.

    Places within reach lie at most two cells apart on an axis. Along one axis the nearest ends of two cells decide; across
    a corner the places that are furthest out on both axes do.
    """
    cells = core.groupBy("line_id", "cp", "cd").agg(
        F.min("cell").alias("cell"), F.min("position_m").alias("p0"), F.max("position_m").alias("p1"), F.min("depth_m").alias("d0"), F.max("depth_m").alias("d1"))
    ways = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(-2, 3) for y in range(3) if y or x > 0])
    near = cells.withColumn("way", F.explode(ways)).withColumn("np", C("cp") + C("way.x")).withColumn("nd", C("cd") + C("way.y"))
    other = cells.select("line_id", C("cp").alias("np"), C("cd").alias("nd"), *[C(c).alias(f"o_{c}") for c in ("cell", "p0", "p1", "d0", "d1")])
    x = C("way.x")
    apart_p = F.when(x > 0, C("o_p0") - C("p1")).when(x < 0, C("p0") - C("o_p1")).otherwise(0.0)
    apart_d = F.when(C("way.y") > 0, C("o_d0") - C("d1")).otherwise(0.0)
    met = near.join(other, ["line_id", "np", "nd"]).filter((apart_p <= P.CLUSTER_POSITION_M) & (apart_d <= P.CLUSTER_DEPTH_M))
    met = cut_lineage(met.select(C("cell").alias("u"), C("o_cell").alias("v"), x.alias("x"), C("way.y").alias("y"), *[c for n in ("p0", "p1", "d1") for c in (C(n), C(f"o_{n}"))], "o_d0"))
    straight = met.filter("x = 0 OR y = 0").select("u", "v")
    corner = met.filter("x <> 0 AND y <> 0")
    # Only places near the corner take part: those that reach the furthest place of the other cell.
    out = lambda p: F.when(C("x") > 0, p).otherwise(-p)
    a = core.select(C("cell").alias("u"), "position_m", "depth_m").join(corner, "u")
    a = a.filter((F.when(C("x") > 0, C("o_p0") - C("position_m")).otherwise(C("position_m") - C("o_p1")) <= P.CLUSTER_POSITION_M) & (C("o_d0") - C("depth_m") <= P.CLUSTER_DEPTH_M))
    b = core.select(C("cell").alias("v"), "position_m", "depth_m").join(corner, "v")
    b = b.filter((F.when(C("x") > 0, C("position_m") - C("p1")).otherwise(C("p0") - C("position_m")) <= P.CLUSTER_POSITION_M) & (C("depth_m") - C("d1") <= P.CLUSTER_DEPTH_M))
    pair = ["u", "v"]
    a = _front(a.select(*pair, "x", "position_m", "depth_m"), pair, out(C("position_m")), C("depth_m"))
    b = _front(b.select(*pair, "x", "position_m", "depth_m"), pair, -out(C("position_m")), -C("depth_m"))
    across = a.join(b.select(*pair, C("position_m").alias("o_p"), C("depth_m").alias("o_d")), pair)
    reach = (F.when(C("x") > 0, C("o_p") - C("position_m")).otherwise(C("position_m") - C("o_p")) <= P.CLUSTER_POSITION_M) & (C("o_d") - C("depth_m") <= P.CLUSTER_DEPTH_M)
    return straight.unionByName(across.filter(reach).select("u", "v").distinct())


def _heads(position: np.ndarray, depth: np.ndarray, min_samples: int) -> np.ndarray:
    """For lines (rows) of equally many apexes: the first place of each apex's cluster as an index into its line, or -1."""
    here = np.arange(len(position))[:, None]
    by = np.lexsort((depth, position), axis=1)
    p, d = position[here, by], depth[here, by]
    near = (np.abs(p[:, :, None] - p[:, None]) <= P.CLUSTER_POSITION_M) & (np.abs(d[:, :, None] - d[:, None]) <= P.CLUSTER_DEPTH_M)
    core = near.sum(axis=2) >= min_samples
    none = p.shape[1]
    label = np.where(core, np.arange(none), none)
    while True:
        least = np.where(near & core[:, None], label[:, None], none).min(axis=2)  # a border takes the lowest cluster
        if (least[core] == label[core]).all():
            break
        label = np.where(core, least, none)
    first = np.where(least[:, None] == np.arange(none)[:, None], np.arange(none), none).min(axis=2)
    head = np.where(least < none, np.take_along_axis(first, np.minimum(least, none - 1), 1), none)
    out = np.full(p.shape, -1, np.int64)
    out[here, by] = np.where(head < none, np.take_along_axis(by, np.minimum(head, none - 1), 1), -1)
    return out


def _by_size(offsets: np.ndarray, cells: Callable[[int], int]) -> Iterator[np.ndarray]:
    """Places (list, entry) in the flat values of an array column: lists of one length together, as many as CELLS allows."""
    sizes = np.diff(offsets)
    for n in np.unique(sizes[sizes > 0]).tolist():
        lists = np.flatnonzero(sizes == n)
        step = max(1, CELLS // cells(n))
        for k in range(0, len(lists), step):
            yield offsets[lists[k : k + step], None] + np.arange(n)


def _folded_clusters(apexes: DataFrame, min_samples: int) -> DataFrame:
    """The clusters of lines of at most FOLDED apexes: a line's apexes travel once."""

    @F.arrow_udf("array<long>")
    def heads(position: pa.Array, depth: pa.Array) -> pa.Array:
        offsets = np.asarray(position.offsets).astype(np.int64) - position.offsets[0].as_py()
        p, d, out = np.asarray(position.flatten()), np.asarray(depth.flatten()), np.empty(offsets[-1], np.int64)
        for at in _by_size(offsets, lambda n: n * n):
            out[at] = _heads(p[at], d[at], min_samples)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))

    rows = C("rows")
    doubles = lambda c: rows[c].cast("array<double>")
    listed = apexes.groupBy("line_id").agg(F.collect_list(F.struct(*[c for c in apexes.columns if c != "line_id"])).alias("rows"))
    listed = listed.withColumn("heads", heads(doubles("position_m"), doubles("depth_m")))
    of = lambda h: F.struct(*[F.get(rows, h.cast("int"))[c].alias(c) for c in ("position_m", "depth_m")])
    each = F.explode(F.zip_with(rows, "heads", lambda r, h: F.struct(r.alias("row"), F.when(h >= 0, of(h)).alias("cluster"))))
    named = listed.select("line_id", each.alias("e")).filter(C("e.cluster").isNotNull())
    return named.select(*[C("e.row")[c].alias(c) if c != "line_id" else C(c) for c in apexes.columns], "e.cluster")


def clusters(apexes: DataFrame, min_samples: int = 2) -> DataFrame:
    """Density clusters per line: apexes with enough neighbours chain together; borders join the lowest cluster.

    A cluster is named by its first place. Lines of at most FOLDED apexes are folded; larger ones are clustered by cells.
    """
    known = apexes.filter(C("line_id").isNotNull() & C("position_m").isNotNull() & C("depth_m").isNotNull())
    many = cut_lineage(known.groupBy("line_id").agg(F.count("*").alias("n")).filter(C("n") > FOLDED).select("line_id"))
    if many.isEmpty():
        return _folded_clusters(known, min_samples)
    small = _folded_clusters(known.join(many, "line_id", "left_anti"), min_samples)
    return small.unionByName(_cell_clusters(known.join(many, "line_id", "left_semi"), min_samples))


def _cell_clusters(apexes: DataFrame, min_samples: int) -> DataFrame:
    """The clusters of lines too large for one task.

    Cells stand for their places, all of which are neighbours: a cell of `min_samples` apexes or more is dense, and only the
    few places of thinner cells are compared with what lies around them. So work grows with the places, however dense.
    """
    spots = _in_cells(with_node_ids(places(apexes)))
    full = spots.groupBy("line_id", "cp", "cd").agg(F.sum("n_here").alias("n_cell"), F.min("node").alias("cell"))
    spots = cut_lineage(spots.join(full, ["line_id", "cp", "cd"]))
    thin = spots.filter(C("n_cell") < min_samples).select("line_id", "position_m", "depth_m", C("node").alias("u"))
    other = spots.select("line_id", C("position_m").alias("o_position"), C("depth_m").alias("o_depth"), C("n_here").alias("o_n"), C("node").alias("v"))
    reach = [("position_m", "o_position", P.CLUSTER_POSITION_M), ("depth_m", "o_depth", P.CLUSTER_DEPTH_M)]
    near = cut_lineage(band_join(thin, other, ["line_id"], reach).select("u", "v", "o_n"))
    enough = near.groupBy(C("u").alias("node")).agg(F.sum("o_n").alias("n")).filter(C("n") >= min_samples).select("node")
    dense = spots.filter(C("n_cell") >= min_samples)
    core = cut_lineage(dense.unionByName(spots.join(enough, "node", "left_semi")))
    labels = connected_components(core.select(C("cell").alias("node")).distinct(), _cell_links(core))
    labelled = core.select("node", "cell").join(labels.withColumnRenamed("node", "cell"), "cell").select("node", "component")
    border = near.join(core.select(C("node").alias("u")), "u", "left_anti").join(labelled.withColumnRenamed("node", "v"), "v")
    border = border.groupBy(C("u").alias("node")).agg(F.min("component").alias("component"))
    members = spots.select("node", "line_id", "position_m", "depth_m").join(labelled.unionByName(border), "node")
    # A cluster is named by its first place, which does not depend on how places were numbered.
    names = members.groupBy("component").agg(F.min(F.struct("position_m", "depth_m")).alias("cluster"))
    named = members.join(names, "component").select("line_id", "position_m", "depth_m", "cluster")
    return apexes.join(named, ["line_id", "position_m", "depth_m"])


def permittivity_agrees(ratio: Column) -> Column:
    """Unknown permittivities count as agreement."""
    return F.coalesce(ratio <= P.MAX_PERMITTIVITY_RATIO, F.lit(True))


def summarise(clustered: DataFrame, keys: tuple[str, ...] = ("line_id", "cluster")) -> DataFrame:
    """Channels, centre, spreads and the permittivity range over each channel's best fit."""
    known = (C("dielectric") > 0)
    inliers = F.coalesce("n_inliers", F.lit(0))
    per_channel = clustered.groupBy(*keys, "channel").agg(
        F.count("*").alias("n"), F.sum("position_m").alias("sp"), F.sum("depth_m").alias("sd"),
        F.min("position_m").alias("p0"), F.max("position_m").alias("p1"), F.min("depth_m").alias("d0"), F.max("depth_m").alias("d1"),
        F.max_by(F.when(known, C("dielectric")), F.when(known, F.struct(inliers, -C("apex_id")))).alias("eps"))
    out = per_channel.groupBy(*keys).agg(
        F.sort_array(F.collect_set("channel")).alias("channels"), F.sum("n").alias("members"),
        (F.sum("sp") / F.sum("n")).alias("position_m"), (F.sum("sd") / F.sum("n")).alias("depth_m"),
        (F.max("p1") - F.min("p0")).alias("position_spread_m"), (F.max("d1") - F.min("d0")).alias("depth_spread_m"),
        (F.max("eps") / F.min("eps")).alias("permittivity_ratio"))
    corroborated = (F.size("channels") >= 2) & permittivity_agrees(C("permittivity_ratio"))
    return out.withColumn("corroborated", corroborated)


def _runs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and residual of clusters (rows) of equally many places, each the home of `n` members: every pair of places is tried."""
    i, j = (k.ravel() for k in np.mgrid[: x.shape[1], : x.shape[1]])
    dx = x[:, j] - x[:, i]
    known = dx != 0
    a = (y[:, j] - y[:, i]) / np.where(known, dx, 1)
    b = y[:, i] - a * x[:, i]
    miss = np.abs(y[:, None] - (a[:, :, None] * x[:, None] + b[:, :, None]))
    near = (miss <= P.RUN_RESIDUAL_M) * n[:, None]
    free = known
    for value in (near.sum(axis=2), -(near * miss).sum(axis=2), -np.abs(a), a):
        value = np.where(free, value, -np.inf)
        free = free & (value == value.max(axis=1, keepdims=True))
    best = miss[np.arange(len(x)), free.argmax(axis=1)]
    w = np.where((best <= P.RUN_RESIDUAL_M) | ~known.any(axis=1)[:, None], n, 0).astype(float)
    first = np.argmax(w > 0, axis=1)[:, None]
    x, y = x - np.take_along_axis(x, first, 1), y - np.take_along_axis(y, first, 1)  # equal places stay exactly equal
    total = w.sum(axis=1)
    x, y = x - ((w * x).sum(axis=1) / total)[:, None], y - ((w * y).sum(axis=1) / total)[:, None]
    sxx, syy, sxy = (w * x * x).sum(axis=1), (w * y * y).sum(axis=1), (w * x * y).sum(axis=1)
    slope = np.where(sxx > 0, sxy / np.where(sxx > 0, sxx, 1), 0.0)
    return slope, np.sqrt(np.maximum(syy - slope * sxy, 0) / total)


def _folded_runs(spots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The runs of clusters of at most ALL_PAIRS places: all pairs of places are fewer than the trials, and none travels."""

    @F.arrow_udf("array<double>")
    def fit(position: pa.Array, depth: pa.Array, members: pa.Array) -> pa.Array:
        offsets = np.asarray(position.offsets).astype(np.int64) - position.offsets[0].as_py()
        x, y, n = (np.asarray(c.flatten()) for c in (position, depth, members))
        out = np.empty((len(offsets) - 1, 2))
        for at in _by_size(offsets, lambda size: size**3):
            out[np.searchsorted(offsets, at[:, 0], "right") - 1] = np.stack(_runs(x[at], y[at], n[at]), axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * 2, pa.int32()), pa.array(out.ravel()))

    s = C("s")
    listed = spots.groupBy(*keys).agg(F.collect_list(F.struct("position_m", "depth_m", "n")).alias("s"))
    line = fit(s["position_m"].cast("array<double>"), s["depth_m"].cast("array<double>"), s["n"])
    return listed.select(*keys, line.alias("r")).select(*keys, C("r")[0].alias("slope"), C("r")[1].alias("residual_m"))


def run_lines(clustered: DataFrame, keys: tuple[str, ...] = ("line_id", "cluster")) -> DataFrame:
    """The straight run of each cluster through its robust members: slope and residual.

    A cluster of at most ALL_PAIRS places tries a line through every pair of them. Of larger ones RUN_TRIALS trial lines go
    through pairs of places that a hash of the cluster and the trial draws from all of them, so the trials grow neither
    with the places nor with their square; the best keeps the most members.
    """
    spots = cut_lineage(clustered.groupBy(*keys, "position_m", "depth_m").agg(F.count("*").alias("n")))
    many = cut_lineage(spots.groupBy(*keys).agg(F.count("*").alias("places")).filter(C("places") > ALL_PAIRS).select(*keys))
    if many.isEmpty():
        return _folded_runs(spots, keys)
    small = _folded_runs(spots.join(many, list(keys), "left_anti"), keys)
    large = [df.join(many, list(keys), "left_semi") for df in (clustered, spots)]
    return small.unionByName(_drawn_runs(*large, keys))


def _drawn_runs(clustered: DataFrame, spots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The runs of clusters of many places, through RUN_TRIALS pairs of them."""
    w = W.partitionBy(*keys).orderBy("position_m", "depth_m")
    numbered = spots.withColumn("place", F.row_number().over(w) - 1)
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("places")).filter("places > 1")
    draws = sizes.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(P.RUN_TRIALS))))
    first = F.floor(hash_uniform(*[C(k) for k in keys], C("trial"), F.lit("first")) * C("places")).cast("int")
    step = F.floor(hash_uniform(*[C(k) for k in keys], C("trial"), F.lit("second")) * (C("places") - 1)).cast("int")
    draws = draws.withColumn("p1", first).withColumn("p2", ((C("p1") + 1 + step) % C("places")).cast("int"))
    ends = numbered.select(*keys, C("place").alias("p2"), F.struct("position_m", "depth_m").alias("o"))
    trials = draws.join(numbered.select(*keys, C("place").alias("p1"), "position_m", "depth_m"), [*keys, "p1"]).join(ends, [*keys, "p2"])
    trials = trials.filter(C("o.position_m") != C("position_m"))
    slope = (C("o.depth_m") - C("depth_m")) / (C("o.position_m") - C("position_m"))
    trials = trials.select(*keys, slope.alias("a"), (C("depth_m") - slope * C("position_m")).alias("b")).distinct()
    miss = F.abs(C("depth_m") - (C("a") * C("position_m") + C("b")))
    near = F.when(miss <= P.RUN_RESIDUAL_M, C("n"))
    scored = trials.join(spots, list(keys)).groupBy(*keys, "a", "b").agg(F.sum(near).alias("votes"), F.sum(near * miss).alias("total"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("a", "b"), F.struct("votes", -C("total"), -F.abs("a"), "a")).alias("best"))
    kept = clustered.join(best, list(keys), "left").filter(C("best").isNull() | (F.abs(C("depth_m") - (C("best.a") * C("position_m") + C("best.b"))) <= P.RUN_RESIDUAL_M))
    f = kept.groupBy(*keys).agg(
        F.regr_slope("depth_m", "position_m").alias("slope"), F.regr_sxx("depth_m", "position_m").alias("sxx"), F.regr_syy("depth_m", "position_m").alias("syy"),
        F.regr_sxy("depth_m", "position_m").alias("sxy"), F.count("*").alias("n"))
    left = F.greatest(F.when(C("sxx") > 0, C("syy") - C("sxy") * C("sxy") / C("sxx")).otherwise(C("syy")), F.lit(0.0))
    return f.select(*keys, F.coalesce("slope", F.lit(0.0)).alias("slope"), F.sqrt(left / C("n")).alias("residual_m"))
