"""Live surveys as streams of trace chunks, and the rule that reports each target once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strata import params as P
from strata.operators.findings import append_new, finding_key, risk_by_frame

C = F.col
LINE_KEY = ["survey_id", "line_id", "channel"]

CHUNK_SCHEMA = T.StructType([
    T.StructField("survey_id", T.StringType()), T.StructField("line_id", T.LongType()), T.StructField("channel", T.StringType()),
    T.StructField("trace_offset", T.IntegerType()), T.StructField("chunk_end", T.IntegerType()), T.StructField("line_complete", T.BooleanType()),
    T.StructField("arrived_at", T.TimestampType()), T.StructField("trace", T.IntegerType()), T.StructField("samples", T.ArrayType(T.DoubleType())),
    T.StructField("dt", T.DoubleType()), T.StructField("spacing", T.DoubleType()),
])

WINDOW_BOX_SCHEMA = (
    "survey_id string, line_id long, channel string, chunk_end int, window_end int, line_complete boolean, arrived_at timestamp, "
    "class_name string, confidence double, trace_start int, trace_end int, sample_start int, sample_end int")
REPORT_SCHEMA = "survey_id string, line_id long, channel string, chunk_end int, class_name string, confidence double, trace_start int, trace_end int, sample_start int, sample_end int"


def replay_windows(lines: DataFrame, chunk_traces: int = P.CHUNK_TRACES, window_traces: int = 0) -> DataFrame:
    """Each line as windows ending every `chunk_traces`; a window reaches back `window_traces` (0 = to the start)."""
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(C("n_traces") / chunk_traces).cast("int"))), lambda i: F.least(i * chunk_traces, C("n_traces").cast("int")))
    w = lines.withColumn("chunk_end", F.explode(ends))
    start = F.lit(0) if window_traces == 0 else F.greatest(F.lit(0), C("chunk_end") - window_traces)
    position = start * C("spacing")
    return w.withColumn("trace_offset", start.cast("int")).withColumn("line_complete", C("chunk_end") == C("n_traces")).withColumn("position_m", position)


def read_chunks(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of chunk files, one row per trace."""
    return spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_repeats(chunks: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """Chunks delivered twice count once; the memory of what was seen ends with the watermark."""
    return chunks.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark([*LINE_KEY, "chunk_end", "trace"])


def warmed_up(complete: Column, offset: Column, n: Column) -> Column:
    """Is there enough of a streamed line to look for targets in it?"""
    return complete | (offset + n >= P.WARMUP_TRACES)


# ---------------------------------------------------------------- settle, persist, report once

FEW = 64
BOX_FIELDS = ("trace_start", "trace_end", "sample_start", "sample_end")


def _one_target(a: list[dict], b: list[dict]) -> np.ndarray:
    """Matrix of which boxes of `a` mark the same target as which of `b`: common depth, and half the narrower width."""
    if len(a) * len(b) <= FEW:  # most windows have a few boxes, for which arrays cost more than the comparisons
        x, y = ([tuple(r[f] for f in BOX_FIELDS) for r in rows] for rows in (a, b))
        same = [[min(d, h) > max(c, g) and min(q, t) - max(p, s) >= 0.5 * min(q - p, t - s) for s, t, g, h in y] for p, q, c, d in x]
        return np.array(same, bool).reshape(len(a), len(b))
    x, y = (np.array([[r[f] for f in BOX_FIELDS] for r in rows], float).reshape(-1, 4) for rows in (a, b))
    low, high = np.maximum(x[:, None], y[None]), np.minimum(x[:, None], y[None])
    along, deep = high[..., 1] - low[..., 0], high[..., 3] - low[..., 2]
    narrow = np.minimum((x[:, 1] - x[:, 0])[:, None], (y[:, 1] - y[:, 0])[None])
    return (deep > 0) & (along >= 0.5 * narrow)


def settle_window(boxes: list[dict], end: int, complete: bool, reported: list[dict], waiting: list[dict]) -> tuple[list[dict], list[dict], list[dict]]:
    """One window of one line: (boxes to report, all reported so far, boxes still waiting with their streak)."""
    settled = [r for r in boxes if complete or r["trace_end"] <= end - P.SETTLE_TRACES]
    unseen = [r for r, known in zip(settled, _one_target(settled, reported).any(axis=1)) if not known] if settled and reported else settled
    if not unseen:
        return [], reported, []
    before = np.array([w["streak"] for w in waiting], int)
    streaks = 1 + np.where(_one_target(unseen, waiting), before, 0).max(axis=1, initial=0)
    ripe = streaks >= (1 if complete else P.PERSIST_WINDOWS)
    twins = np.tril(_one_target(unseen, unseen), -1)  # of each box, those before it in the window
    spoken = np.zeros(len(unseen), bool)
    new, still = [], []
    for i, row in enumerate(unseen):
        if (twins[i] & spoken).any():
            continue  # a box before it has just reported this target
        place = {f: row[f] for f in BOX_FIELDS}
        if ripe[i]:
            spoken[i] = True
            new.append(row)
            reported = [*reported, place]
        else:
            still.append({**place, "streak": int(streaks[i])})
    return new, reported, still


class ReportOnce(StatefulProcessor):
    """State of one line: what was reported, what waits with its streak, and windows that came too early.

    Windows are taken in trace order; one that arrives before the window it follows waits until the gap
    closes, and one that says how many boxes it has (n_boxes) waits until all of them have come, in however many
    batches. A window that has been taken is ignored when it comes again. The state of a line ends with its last window.
    """

    BOX = "trace_start int, trace_end int, sample_start int, sample_end int"

    def __init__(self, chunk_traces: int = P.CHUNK_TRACES) -> None:
        self.chunk_traces = chunk_traces

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reported = handle.getListState("reported", self.BOX)
        self.waiting = handle.getListState("waiting", self.BOX + ", streak int")
        self.early = handle.getListState("early", "chunk_end int, window_end int, line_complete boolean, class_name string, confidence double, " + self.BOX + ", n_boxes int")
        self.position = handle.getValueState("position", "chunk_end int, finished boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, finished = self.position.get() if self.position.exists() else (0, False)
        columns = ["chunk_end", "window_end", "line_complete", "class_name", "confidence", *BOX_FIELDS, "n_boxes"]
        pending = [dict(zip(columns, r)) for r in self.early.get()] if self.early.exists() else []
        for pdf in rows:
            pdf = pdf if "n_boxes" in pdf else pdf.assign(n_boxes=None)
            pending += pdf[columns].astype(object).where(pdf[columns].notna(), None).to_dict("records")
        for row in pending:  # integers beside nulls have come as floats, which integer state would hold as null
            row.update({f: int(row[f]) for f in (*BOX_FIELDS, "n_boxes") if row[f] is not None})
        windows: dict[int, list[dict]] = {}
        for row in pending:
            windows.setdefault(int(row["chunk_end"]), []).append(row)
        reported = [dict(zip(BOX_FIELDS, r)) for r in self.reported.get()] if self.reported.exists() else []
        waiting = [dict(zip((*BOX_FIELDS, "streak"), r)) for r in self.waiting.get()] if self.waiting.exists() else []
        out: list[dict] = []
        while windows and not finished:
            end = min(windows)
            if end > last and end > last + self.chunk_traces:
                break  # a window in between has not come yet
            group = windows[end]
            boxes = list({tuple(r[f] for f in BOX_FIELDS): r for r in group if r["trace_start"] is not None}.values())
            if end > last and len(boxes) < max((r["n_boxes"] or 0) for r in group):
                break  # a part of the window has not come yet
            del windows[end]
            if end <= last:
                continue  # delivered again
            complete = bool(group[0]["line_complete"])
            new, reported, waiting = settle_window(boxes, int(group[0]["window_end"]), complete, reported, waiting)
            out += [{"chunk_end": end, **{c: r[c] for c in ("class_name", "confidence", *BOX_FIELDS)}} for r in new]
            last, finished = end, complete
        keep = lambda state, rows: state.put(rows) if rows else state.clear()  # noqa: E731 - an empty list cannot be stored
        keep(self.reported, [] if finished else [tuple(int(r[f]) for f in BOX_FIELDS) for r in reported])
        keep(self.waiting, [] if finished else [tuple(int(w[f]) for f in (*BOX_FIELDS, "streak")) for w in waiting])
        keep(self.early, [] if finished else [tuple(r[c] for c in columns) for g in windows.values() for r in g])
        self.position.update((last, finished))
        if out:
            pdf = pd.DataFrame(out)
            pdf.insert(0, "channel", key[2])
            pdf.insert(0, "line_id", key[1])
            pdf.insert(0, "survey_id", key[0])
            yield pdf

    def close(self) -> None:
        pass


def report_once(window_boxes: DataFrame, chunk_traces: int = P.CHUNK_TRACES) -> DataFrame:
    """Stream of window boxes to stream of findings, each target once. Needs the RocksDB state store.

    A window without boxes must send one row with null box fields, so that streaks break. Where a window's rows may be
    spread over batches, each of them says in n_boxes how many boxes there are; without it a window arrives whole.
    """
    return window_boxes.groupBy(*LINE_KEY).transformWithStateInPandas(
        statefulProcessor=ReportOnce(chunk_traces), outputStructType=REPORT_SCHEMA, outputMode="Append", timeMode="None")


def report_once_batch(window_boxes: DataFrame) -> DataFrame:
    """The same rule over a finished recording: windows of a line in order, many lines per Arrow batch.

    A line's boxes are at most its windows times the boxes of one window.
    """
    kinds = {f.name: f.dataType.simpleString() for f in window_boxes.schema.fields}
    row = F.struct("chunk_end", "trace_start", "sample_start", "window_end", "line_complete", "class_name", "confidence", "trace_end", "sample_end")
    lines = window_boxes.groupBy(*LINE_KEY).agg(F.array_sort(F.collect_set(row)).alias("rows"))
    schema = ", ".join(f"{k} {kinds[k]}" for k in LINE_KEY) + ", chunk_end int, class_name string, confidence double, trace_start int, trace_end int, sample_start int, sample_end int"

    fields = ["chunk_end", "class_name", "confidence", *BOX_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, cuts = batch["rows"].flatten(), batch["rows"].offsets.to_pylist()
            names = [entries.type.field(i).name for i in range(entries.type.num_fields)]
            boxes = [dict(zip(names, values)) for values in zip(*(c.to_pylist() for c in entries.flatten()))]
            lines, out = [], []
            for line, (first, last) in enumerate(zip(cuts, cuts[1:])):
                reported, waiting = [], []
                for end, group in groupby(boxes[first - cuts[0] : last - cuts[0]], lambda r: r["chunk_end"]):
                    window = list(group)
                    there = [r for r in window if r["trace_start"] is not None]
                    new, reported, waiting = settle_window(there, window[0]["window_end"], window[0]["line_complete"], reported, waiting)
                    lines += [line] * len(new)
                    out += new
            keys = [batch[k].take(pa.array(lines, pa.int64())) for k in LINE_KEY]
            kind = entries.type
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array([r[f] for r in out], kind.field(f).type) for f in fields]], names=[*LINE_KEY, *fields])

    return lines.mapInArrow(run, schema)


def window_risk(window_boxes: DataFrame) -> DataFrame:
    """Risk of each window from all its detections, reported or not."""
    return risk_by_frame(window_boxes.filter(C("class_name").isNotNull()), [*LINE_KEY, "chunk_end"])


def write_reported(reported: DataFrame, risk: DataFrame, path: str) -> None:
    """One micro-batch of findings with their window's risk; ids depend on content, so a retry repeats no row."""
    location = F.struct(*BOX_FIELDS)
    f = reported.join(risk, [*LINE_KEY, "chunk_end"], "left").withColumn("location", location).withColumn("frame_id", C("chunk_end"))
    append_new(f.withColumn("finding_id", finding_key(f)).drop("frame_id"), path)


def event_messages(findings: DataFrame, kind: str) -> DataFrame:
    """Findings as keyed JSON messages for a message or file sink."""
    body = F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*findings.columns).alias("data")))
    return findings.select(C("finding_id").cast("string").alias("key"), body.alias("value"))


def merged_messages(created: DataFrame, reasoned: DataFrame) -> DataFrame:
    """What a client shows: the created finding with its reasoning once that arrives, by id."""
    return created.join(reasoned.select("finding_id", "what"), "finding_id", "left")
