"""A live survey as one stream: chunks of traces in, detections, findings and faults out.

The state of a line is the last WINDOW traces, packed, the traces that came before their turn, and the boxes that wait
or were reported within the window's reach. Each chunk that closes the gap runs migration and peaks on the new traces and their halo.
Event-time timers give up on chunks that never come and on lines that never end, and forget a finished line.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strata import params as P
from strata.operators.detect import window_max
from strata.operators.findings import finding_key, risk_by_frame
from strata.operators.process import analytic_envelope, migrate_block
from strata.streaming.chunks import BOX_FIELDS, LINE_KEY, report_once_batch, settle_window

C = F.col
WINDOW = 192  # traces: what settles and persists (48 + 4 * 16) and the reach of migration and peaks before that
MOST_AHEAD = 4096  # traces of one chunk; a larger number in a row is a fault of the row
DELAY, IDLE = "2 minutes", "30 minutes"
BOX = "trace_start int, trace_end int, sample_start int, sample_end int"
#: kind: window (one for each chunk), detection (one for each box of a window), fault.
LIVE_SCHEMA = f"survey_id string, line_id long, channel string, kind string, chunk_end int, at timestamp, n_boxes int, reported boolean, class_name string, confidence double, {BOX}, reason string"
LIVE_COLUMNS = [part.split()[0] for part in LIVE_SCHEMA.split(", ")]
ORDER = ("trace_start", "sample_start", "class_name", "confidence", "trace_end", "sample_end")
Detector = Callable[[np.ndarray, int, float, float], list[dict]]


def peak_boxes(block: np.ndarray, first: int, dt: float, spacing: float) -> list[dict]:
    """Boxes around the focused peaks of a (samples, traces) window that begins at trace `first`, strongest peaks only."""
    n, width = block.shape
    velocity = P.SPEED_OF_LIGHT_M_PER_NS / math.sqrt(P.DEFAULT_DIELECTRIC)
    aperture = max(1, min(int(P.PICK_APERTURE_M / spacing), width - 1))
    migrated = migrate_block(block - block.mean(axis=1, keepdims=True), spacing, dt, velocity, aperture)
    env = analytic_envelope(migrated, axis=0) * np.arange(1, n + 1)[:, None]
    env[: int(P.SKIP_TOP_NS / dt)] = 0
    env[int((1 - P.SKIP_BOTTOM_FRACTION) * n) :] = 0
    if not (env > 0).any():
        return []
    over = env / np.median(env[env > 0])
    tall, across = max(3, int(P.PEAK_WINDOW_NS / dt)), max(3, int(P.PEAK_WINDOW_M / spacing))
    sample, trace = np.nonzero((env >= window_max(window_max(env, tall, 0), across, 1)) & (over > P.PEAK_OVER_MEDIAN))
    strength = over[sample, trace]
    boxes: list[dict] = []
    for i in np.lexsort((trace, sample, -np.round(strength, 9)))[: P.DEFAULT_PICKS]:
        t = sample[i] * dt
        half = 0.5 * velocity * math.sqrt((t + P.BOX_BELOW_NS) ** 2 - t * t)
        half = min(max(half, P.MIN_HALF_WIDTH_M), P.MAX_HALF_WIDTH_M) / spacing
        boxes.append({
            "trace_start": first + max(0, int(trace[i] - half)), "trace_end": first + min(width, int(trace[i] + half) + 1),
            "sample_start": max(0, int(sample[i] - P.BOX_ABOVE_NS / dt)), "sample_end": min(n, int(sample[i] + P.BOX_BELOW_NS / dt) + 1),
            "class_name": "clear_point_reflector" if strength[i] >= P.STRONG_PEAK else "low_snr_point_reflector", "confidence": round(float(1 - 1 / strength[i]), 9),
        })
    return boxes


def window_of(traces: list[np.ndarray], first: int, dt: float, spacing: float, complete: bool, detector: Detector) -> list[dict]:
    """Boxes of a window in the order in which they are settled; a line that is not warm yet has none."""
    if not complete and first + len(traces) < P.WARMUP_TRACES:
        return []
    return sorted(detector(np.stack(traces).T, first, dt, spacing), key=lambda b: [b[f] for f in ORDER])


def _plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers that may be null, and texts as objects also where a batch has none."""
    kinds = {f: "Int32" for f in ("chunk_end", "n_boxes", *BOX_FIELDS)} | {"reported": "boolean"} | dict.fromkeys(("survey_id", "channel", "kind", "class_name", "reason"), object)
    return pdf.astype({c: kind for c, kind in kinds.items() if c in pdf})


class LiveLine(StatefulProcessor):
    """One line and channel. Rows are traces of chunks: any order, repeated, spread over batches, or missing."""

    def __init__(self, detector: Detector, delay_ms: int, idle_ms: int) -> None:
        self.detector, self.delay_ms, self.idle_ms = detector, delay_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "end int, finished boolean, n_samples int, dt double, spacing double, first int, tail binary, heard long, gap long, idle long")
        self.ahead = handle.getMapState("ahead", "trace int", "chunk_end int, line_complete boolean, samples binary")
        self.reported = handle.getListState("reported", BOX)
        self.waiting = handle.getListState("waiting", BOX + ", streak int")

    def _load(self) -> None:
        self.end, self.finished, self.n, self.dt, self.spacing, self.first, tail, self.heard, self.gap, self.idle = (
            self.line.get() if self.line.exists() else (0, False, 0, 0.0, 0.0, 0, b"", 0, 0, 0))
        self.tail = list(np.frombuffer(bytes(tail or b""), float).reshape(-1, self.n)) if self.n else []
        self.early = {k[0]: tuple(v) for k, v in self.ahead.iterator()} if self.ahead.exists() else {}
        self.known = set(self.early)
        self.spoken = [dict(zip(BOX_FIELDS, r)) for r in self.reported.get()] if self.reported.exists() else []
        self.open = [dict(zip((*BOX_FIELDS, "streak"), r)) for r in self.waiting.get()] if self.waiting.exists() else []
        self.rows: list[dict] = []

    def _save(self) -> None:
        for trace in self.known - set(self.early):
            self.ahead.removeKey((trace,))
        for trace in set(self.early) - self.known:
            self.ahead.updateValue((trace,), self.early[trace])
        for state, rows in ((self.reported, [tuple(b[f] for f in BOX_FIELDS) for b in self.spoken]), (self.waiting, [tuple(b[f] for f in (*BOX_FIELDS, "streak")) for b in self.open])):
            state.put(rows) if rows else state.clear()
        tail = np.stack(self.tail).tobytes() if self.tail else b""
        self.line.update((self.end, self.finished, self.n, self.dt, self.spacing, self.first, tail, self.heard, self.gap, self.idle))

    def _forget(self) -> None:
        for state in (self.line, self.ahead, self.reported, self.waiting):
            state.clear()

    def _fault(self, reason: str, chunk_end: int | None = None) -> None:
        self.rows.append({"kind": "fault", "chunk_end": chunk_end, "reason": reason})

    def _take(self, pdf: pd.DataFrame) -> None:
        """Rows of one batch into `early`; what is wrong with a row becomes a fault, and its trace repeats the one before it."""
        bad: dict[tuple, int] = {}
        for r in pdf.itertuples(index=False):
            self.heard = max(self.heard, int(pd.Timestamp(r.arrived_at).value // 1_000_000))
            samples = None if r.samples is None else np.asarray(r.samples, float)
            reason = None
            if pd.isna(r.trace) or pd.isna(r.chunk_end) or not 0 <= r.trace < r.chunk_end or r.chunk_end - r.trace > MOST_AHEAD:
                bad[None, "a trace outside its chunk"] = bad.get((None, "a trace outside its chunk"), 0) + 1
                continue
            trace, chunk_end = int(r.trace), int(r.chunk_end)
            if self.finished or trace < self.end or trace in self.early:
                continue  # delivered again
            if samples is None or not len(samples) or not np.isfinite(samples).all():
                reason = "samples missing or not finite"
            elif pd.isna(r.dt) or pd.isna(r.spacing) or r.dt <= 0 or r.spacing <= 0:
                reason = "no time step or trace spacing"
            elif self.n and len(samples) != self.n:
                reason = "a trace of another length"
            if reason:
                bad[chunk_end, reason] = bad.get((chunk_end, reason), 0) + 1
                samples = np.zeros(0)
            elif not self.n:
                self.n, self.dt, self.spacing = len(samples), float(r.dt), float(r.spacing)
            self.early[trace] = (chunk_end, bool(r.line_complete), samples.tobytes())
        for (chunk_end, reason), n in bad.items():
            self._fault(f"{reason}: {n} trace{'s' * (n > 1)}", chunk_end)

    def _advance(self) -> None:
        """Every chunk whose traces have all come, in order."""
        while not self.finished and self.end in self.early:
            chunk_end = self.early[self.end][0]
            if any(t not in self.early for t in range(self.end, chunk_end)):
                break
            complete = False
            for t in range(self.end, chunk_end):
                _, last, samples = self.early.pop(t)
                complete |= last
                whole = np.frombuffer(bytes(samples), float)
                self.tail.append(whole if len(whole) else self.tail[-1] if self.tail else np.zeros(self.n))
            self.end = chunk_end
            self.tail = self.tail[-WINDOW:]
            self.first = self.end - len(self.tail)
            boxes: list[dict] = []
            if self.n:
                try:
                    boxes = window_of(self.tail, self.first, self.dt, self.spacing, complete, self.detector)
                except Exception as problem:  # noqa: BLE001 - a detector may fail in any way, and the line goes on
                    self._fault(f"detector failed: {type(problem).__name__}", chunk_end)
            new, self.spoken, self.open = settle_window(boxes, chunk_end, complete, self.spoken, self.open)
            self.spoken = [b for b in self.spoken if b["trace_end"] >= self.first]  # no later window reaches the others
            self.rows.append({"kind": "window", "chunk_end": chunk_end, "n_boxes": len(boxes)})
            marked = [id(b) for b in new]
            self.rows += [{"kind": "detection", "chunk_end": chunk_end, "reported": id(b) in marked, **b} for b in boxes]
            self.finished = complete
        if self.finished:
            self.early, self.tail, self.spoken, self.open, self.gap = {}, [], [], [], 0

    def _wait(self) -> None:
        """Timers: for a gap from when it was seen, for silence from the last row heard."""
        waits = bool(self.early) and not self.finished
        if waits and not self.gap:
            self.gap = self.heard + self.delay_ms
            self.handle.registerTimer(self.gap)
        elif not waits:
            self.gap = 0
        if not self.idle:
            self.idle = self.heard + (self.delay_ms if self.finished else self.idle_ms)
            self.handle.registerTimer(self.idle)

    def _told(self, key) -> Iterator[pd.DataFrame]:
        if self.rows:
            out = pd.DataFrame(self.rows).assign(survey_id=key[0], line_id=key[1], channel=key[2], at=pd.Timestamp(self.heard, unit="ms"))
            yield _plain(out.reindex(columns=LIVE_COLUMNS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for pdf in rows:
            self._take(pdf)
        before = self.end
        self._advance()
        if self.end > before:
            self.gap = 0  # what is missing now is another gap
        self._wait()
        self._save()
        yield from self._told(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if not self.line.exists():
            return
        self._load()
        if self.gap and now >= self.gap and self.early:
            if self.end in self.early:  # the chunk in turn lacks traces: they repeat the one before them
                chunk_end = self.early[self.end][0]
                lost = [t for t in range(self.end, chunk_end) if t not in self.early]
                self._fault(f"traces {lost[0]} to {lost[-1]} never came", chunk_end)
                self.early |= {t: (chunk_end, False, b"") for t in lost}
            else:  # all of it does: the line starts again behind the gap
                to = min(self.early)
                self._fault(f"traces {self.end} to {to - 1} never came", self.early[to][0])
                self.end, self.first, self.tail, self.open = to, to, [], []
            self.gap = 0
            self._advance()
        ended = False
        if self.idle and now >= self.idle:
            due = self.heard + (self.delay_ms if self.finished else self.idle_ms)
            ended, self.idle = now >= due, 0
            if ended and not self.finished:
                self._fault("the line fell silent before its end", self.end)
        if ended:
            self._forget()
        else:
            self._wait()
            self._save()
        yield from self._told(key)

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store, which state with timers and maps needs, for streams that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def live_survey(chunks: DataFrame, detector: Detector = peak_boxes, delay: str = DELAY, idle: str = IDLE) -> DataFrame:
    """Stream of chunk rows to one stream of windows, detections and faults. Needs the RocksDB state store.

    `delay` bounds how late a row may come and how long a gap is waited for, `idle` how long a line may be silent.
    """
    lines = chunks.withWatermark("arrived_at", delay).groupBy(*LINE_KEY)
    return lines.transformWithStateInPandas(statefulProcessor=LiveLine(detector, _milliseconds(delay), _milliseconds(idle)), outputStructType=LIVE_SCHEMA, outputMode="Append", timeMode="EventTime")


def findings_of(live: DataFrame) -> DataFrame:
    """Findings of a batch of `live_survey`: reported boxes, each with the risk of all boxes of its window."""
    seen = live.filter("kind = 'detection'")
    risk = risk_by_frame(seen, [*LINE_KEY, "chunk_end"])
    found = seen.filter("reported").join(risk, [*LINE_KEY, "chunk_end"]).withColumn("location", F.struct(*BOX_FIELDS)).withColumn("frame_id", C("chunk_end"))
    return found.select(finding_key(found).alias("finding_id"), *LINE_KEY, "chunk_end", "at", "class_name", "confidence", *BOX_FIELDS, "score", "level", "rules")


def faults_of(live: DataFrame) -> DataFrame:
    return live.filter("kind = 'fault'").select(*LINE_KEY, "chunk_end", "at", "reason")


def window_boxes(chunks: DataFrame, detector: Detector = peak_boxes) -> DataFrame:
    """Boxes of every window of finished lines, each window a group of its own: the batch form of what a line's state does."""
    traces = chunks.dropDuplicates([*LINE_KEY, "trace"])
    windows = traces.groupBy(*LINE_KEY, "chunk_end").agg(F.bool_or("line_complete").alias("line_complete"), F.max("arrived_at").alias("arrived_at"))
    reach = F.sequence(F.greatest(F.lit(0), C("chunk_end") - WINDOW), C("chunk_end") - 1)
    members = windows.withColumn("trace", F.explode(reach)).join(traces.select(*LINE_KEY, "trace", "samples", "dt", "spacing"), [*LINE_KEY, "trace"])
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    keys = ", ".join(f"{k} {kinds[k]}" for k in LINE_KEY)
    schema = f"{keys}, chunk_end int, window_end int, line_complete boolean, arrived_at timestamp, class_name string, confidence double, {BOX}"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trace")
        row = pdf.iloc[0]
        boxes = window_of([np.asarray(s, float) for s in pdf["samples"]], int(row["trace"]), row["dt"], row["spacing"], bool(row["line_complete"]), detector)
        head = {**dict(zip((*LINE_KEY, "chunk_end"), key)), "window_end": key[3], "line_complete": row["line_complete"], "arrived_at": row["arrived_at"]}
        return _plain(pd.DataFrame([{**head, **b} for b in boxes] or [head]).reindex(columns=names))

    return members.groupBy(*LINE_KEY, "chunk_end").applyInPandas(run, schema)


def survey_batch(chunks: DataFrame, detector: Detector = peak_boxes) -> DataFrame:
    """What the stream reports of finished lines without gaps: each target once."""
    return report_once_batch(window_boxes(chunks, detector))
