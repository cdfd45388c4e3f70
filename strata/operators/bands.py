"""Joins and windows on nearness, planned as equi-joins on grid cells so no key ends in one task.

A cell is a stretch of an axis as wide as the tolerance, so everything within reach of a row lies in
its own cell or a neighbouring one. Hot keys split into their cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col
_SLACK = 1 + 1e-9  # cells a hair wider than the tolerance, so rounding never hides a neighbour


def cell_of(value: Column, width: float) -> Column:
    return F.floor(value / (width * _SLACK))


def band_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], axes: Sequence[tuple[str, str, float]],
    how: str = "inner", extra: Column | None = None, grid_axes: int = 2,
) -> DataFrame:
    """Rows of both sides with equal `keys` and every axis within its tolerance (inclusive).

    `axes` holds (left column, right column, tolerance). The sides share only the key column names.
    `grid_axes` axes become cells: two keep dense keys apart, one copies the right side less often.
    """
    cells = [f"__cell{i}" for i in range(min(grid_axes, len(axes)))]
    for cell, (lcol, rcol, tol) in zip(cells, axes):
        left = left.withColumn(cell, cell_of(C(lcol), tol))
        around = cell_of(C(rcol), tol)
        right = right.withColumn(cell, F.explode(F.array(around - 1, around, around + 1)))
    condition = None
    for name in [*keys, *cells]:
        right = right.withColumnRenamed(name, f"__r_{name}")
        part = C(name) == C(f"__r_{name}")
        condition = part if condition is None else condition & part
    for lcol, rcol, tol in axes:
        condition = condition & (F.abs(C(lcol) - C(rcol)) <= tol)
    if extra is not None:
        condition = condition & extra
    return left.join(right, condition, how).drop(*cells, *[f"__r_{n}" for n in [*keys, *cells]])


def within(aggregate: str, keys: Sequence[str], order: str, before: float, after: float) -> Column:
    """An aggregate over the rows whose `order` value lies from `before` below to `after` above this row's."""
    by = ", ".join(f"`{k}`" for k in keys)
    return F.expr(
        f"{aggregate} OVER (PARTITION BY {by} ORDER BY `{order}` RANGE BETWEEN {before!r}D PRECEDING AND {after!r}D FOLLOWING)")


def band_aggregate(
    rows: DataFrame, keys: Sequence[str], axis: str, tol: float, partials: dict[str, Column], merge: dict[str, str], tile: float | None = None,
) -> DataFrame:
    """For each distinct (keys, axis value): an aggregate over everything within `tol`, without pairs.

    Rows first collapse to one per distinct position (`partials`), positions go to tiles many
    tolerances wide, each with a copy of its neighbours' edges, and a range window merges them.
    """
    tile = tile or 64 * tol
    points = rows.filter(C(axis).isNotNull()).groupBy(*keys, axis).agg(*[c.alias(n) for n, c in partials.items()])
    lo, hi = F.floor((C(axis) - tol * _SLACK) / tile), F.floor((C(axis) + tol * _SLACK) / tile)
    tiled = points.withColumn("__tile", F.explode(F.array_distinct(F.array(lo, F.floor(C(axis) / tile), hi))))
    reach = tol * _SLACK
    merged = tiled.select(*keys, axis, "__tile", *[
        within(f"{fn}({n})", [*keys, "__tile"], axis, reach, reach).alias(n) for n, fn in merge.items()])
    return merged.filter(F.floor(C(axis) / tile) == C("__tile")).drop("__tile")


def with_next(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], width: float, prefix: str = "next_") -> DataFrame:
    """Each row's successor along `order` within its keys: windows only inside stretches of `width`.

    The last row of a stretch takes the first row of the next stretch that has any.
    """
    names = list(dict.fromkeys([*order, *fields]))
    rows = rows.withColumn("__cell", F.floor(C(order[0]) / width))
    inside = W.partitionBy(*keys, "__cell").orderBy(*order)
    firsts = rows.groupBy(*keys, "__cell").agg(F.min(F.struct(*names)).alias("__first"))
    across = firsts.withColumn("__after", F.lead("__first").over(W.partitionBy(*keys).orderBy("__cell"))).drop("__first")
    out = rows.withColumn("__here", F.lead(F.struct(*names)).over(inside)).join(across, [*keys, "__cell"])
    pick = F.coalesce(C("__here"), C("__after"))
    return out.select(*[c for c in rows.columns if c != "__cell"], *[pick[f].alias(f"{prefix}{f}") for f in fields])


def bracket(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, keys: Sequence[str], width: float, how: str = "left") -> DataFrame:
    """The interval of the same keys that holds a point; where two touch, the first one wins."""
    reach = F.sequence(F.floor(C(lo) / width), F.floor(C(hi) / width))
    spread = intervals.withColumn("__cell", F.explode(reach))
    spread = spread.select(*[C(c).alias(f"__k_{c}") if c in keys or c == "__cell" else C(c) for c in spread.columns])
    condition = F.floor(C(at) / width) == C("__k___cell")
    for k in keys:
        condition = condition & (C(k) == C(f"__k_{k}"))
    joined = points.join(spread, condition & (C(lo) <= C(at)) & (C(at) <= C(hi)), how)
    fields = [c for c in intervals.columns if c not in keys]
    best = joined.groupBy(*points.columns).agg(F.min_by(F.struct(*fields), F.struct(lo, hi)).alias("__b"))
    return best.select(*points.columns, *[C("__b")[f].alias(f) for f in fields])


def tile_with_halo(rows: DataFrame, index: str, size: int, halo: int, length: str) -> DataFrame:
    """Copy each row to every tile whose core or halo it falls in; `__core` marks its own tile.

    `length` names the column with the number of positions, so that no tile lies wholly outside.
    """
    i = C(index)
    first = F.greatest(F.floor((i - halo) / size), F.lit(0))
    last = F.least(F.floor((i + halo) / size), F.floor((C(length) - 1) / size))
    return rows.withColumn("__tile", F.explode(F.sequence(first, last))).withColumn("__core", F.floor(i / size) == C("__tile"))


def ordinal(rows: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, name: str = "rank") -> DataFrame:
    """1-based position of each row along `order` within its keys, counted per stretch of `width`.

    Counts of earlier stretches are added up per key, so a hot key is numbered by many tasks.
    """
    rows = rows.withColumn("__cell", F.floor(C(order[0]) / width))
    counts = rows.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    here = F.row_number().over(W.partitionBy(*keys, "__cell").orderBy(*order))
    return rows.withColumn("__here", here).join(counts, [*keys, "__cell"]).withColumn(name, C("__before") + C("__here")).drop("__cell", "__here", "__before")


def assign_in_order(edges: DataFrame, keys: Sequence[str], left: str, right: str, cost: Sequence[str]) -> DataFrame:
    """Each left row in turn takes its cheapest right row that is still free; one-to-one.

    `cost` starts with the left rows' order. A group holds the edges of one page or one line, and only
    pairs within reach of each other are edges, so the fold runs over a short list.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    pair = F.struct(C(left).alias("l"), C(right).alias("r"))
    listed = edges.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*cost, pair.alias("__p")))), lambda e: e["__p"]).alias("e"))
    start = F.array().cast(f"array<struct<l:{kinds[left]},r:{kinds[right]}>>")
    taken = F.aggregate(
        "e", start, lambda kept, e: F.when(F.exists(kept, lambda k: (k["l"] == e["l"]) | (k["r"] == e["r"])), kept).otherwise(F.concat(kept, F.array(e))))
    return listed.select(*keys, F.explode(taken).alias("m")).select(*keys, C("m.l").alias(left), C("m.r").alias(right))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + count - 1."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
