"""Operators that look along a line: differences, tiles of traces, line statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.bands import tile_with_halo

C = F.col
LINE = ["line_id", "channel"]
TILE = 512  # traces per tile: a few megabytes of samples, whatever the line's length


def trace_differences(traces: DataFrame) -> DataFrame:
    """Each trace minus the one before it; the first trace of a line has no difference."""
    before = traces.select(*LINE, (C("trace") + 1).alias("trace"), C("samples").alias("__before"))
    joined = traces.join(before, [*LINE, "trace"], "left")
    empty = F.transform("samples", lambda x: F.lit(None).cast("double"))
    step = F.when(C("__before").isNull(), empty).otherwise(F.zip_with("samples", "__before", lambda a, b: a - b))
    return joined.withColumn("samples", step).drop("__before")


def line_lengths(traces: DataFrame) -> DataFrame:
    return traces.groupBy(*LINE).agg((F.max("trace") + 1).alias("n_traces"))


def map_tiles(traces: DataFrame, fn: Callable[..., np.ndarray], halo: int, extra: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Apply `fn(block, first, n_traces, row)` to tiles of a line and keep each tile's own traces.

    `block` is (samples, traces) with `halo` traces of context on both sides where the line has them;
    `first` is the trace number of its first column; `row` holds the tile's `extra` values. One long
    line becomes many tasks. `fn` returns an array shaped like `block`.
    """
    tiled = tile_with_halo(traces.join(line_lengths(traces), LINE), "trace", tile, halo, "n_traces")
    kept = [c for c in traces.columns if c not in (*LINE, "trace", "samples")]
    schema = traces.select(*LINE, "trace", "samples", *kept).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trace")
        block = np.stack(pdf["samples"].to_numpy()).T.astype(float)
        row = {name: pdf[name].iloc[0] for name in extra}
        out = fn(block, int(pdf["trace"].iloc[0]), int(pdf["n_traces"].iloc[0]), row)
        core = pdf["__core"].to_numpy()
        kept_rows = pdf.loc[core, [*LINE, "trace", *kept]].copy()
        kept_rows.insert(3, "samples", pd.Series(list(np.ascontiguousarray(out[:, core].T)), index=kept_rows.index, dtype=object))
        return kept_rows

    return tiled.groupBy(*LINE, "__tile").applyInPandas(run, schema)


def largest_line(traces: DataFrame) -> int:
    """Traces of the longest line and channel, from the key columns alone."""
    from strata.operators.quantiles import largest_group

    return largest_group(traces, LINE)


def trailing_median(traces: DataFrame, window: int) -> DataFrame:
    """Background for live data: the median of the last `window` traces; a line's start is marked as warming up."""

    def remove(block: np.ndarray, first: int, n: int, row: dict) -> np.ndarray:
        out = np.empty_like(block)
        for j in range(block.shape[1]):
            out[:, j] = block[:, j] - np.median(block[:, max(0, j - window + 1) : j + 1], axis=1)
        return out

    moved = map_tiles(traces, remove, halo=window - 1)
    return moved.withColumn("warming_up", C("trace") < window - 1)
