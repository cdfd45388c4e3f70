"""Radar recordings as a Spark data source that splits files: a partition is a range of traces of one file.

`register(spark)`, then `spark.read.format("radar").load(folder)`: one row for each trace, and one for each file that can't be read, with the
reason. The driver lists the folder and reads no more than sizes; each task reads its file's head and the bytes of its own range. A
layout is a function from the head to a `Plan`, so a user's own format is one function under `layout("extension")`.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strata.sources.ingest import SEGY_FORMATS, SEGY_HEAD, SEGY_TRACE_HEAD, SPR_HEAD, SPR_TAG, SPR_TAG_AT, Unreadable, need

HEAD = 64 << 10  # bytes at the start of a file that its layout may look at
SPLIT = 32 << 20  # bytes of traces in a partition
SCHEMA = "path string, error string, trace long, samples array<float>, dt double, spacing double, dielectric double, x double, y double"


@dataclass(frozen=True)
class Plan:
    """Where a file's traces lie and how a record is read."""

    start: int
    record: np.dtype  # with a field `amp`
    dt: float
    spacing: float | None = None
    dielectric: float | None = None
    zero: float = 0.0  # what is subtracted from unsigned samples
    marks: int = 0  # first samples of a trace that are no signal
    check: Callable[[np.ndarray], str | None] = field(default=lambda rows: None)
    place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray] | None] = field(default=lambda rows: None)


Layout = Callable[[bytes, int, bytes | None], Plan]
LAYOUTS: dict[str, tuple[Layout, tuple[str, ...]]] = {}


def layout(*extensions: str, beside: tuple[str, ...] = ()) -> Callable[[Layout], Layout]:
    """Register a layout (head, file size, head of the file beside it) for file extensions; `beside` are extensions of a header file."""

    def register_(read: Layout) -> Layout:
        for e in extensions:
            LAYOUTS[e] = (read, beside)
        return read

    return register_


def whole(plan: Plan, size: int) -> Plan:
    body = size - plan.start
    need(body > 0 and body % plan.record.itemsize == 0, "the data do not divide into traces")
    return plan


def signal(plan: Plan, rows: np.ndarray, kind: type) -> np.ndarray:
    """(traces, samples) around zero; marks at the start of a trace repeat its first sample of signal."""
    samples = rows["amp"].astype(kind) - kind(plan.zero)
    if plan.marks:
        samples[:, : plan.marks] = samples[:, plan.marks : plan.marks + 1]
    return samples


@layout("sgy", "segy")
def segy_plan(head: bytes, size: int, side: bytes | None) -> Plan:
    need(len(head) >= SEGY_HEAD, "too short for SEG-Y")
    for order in "<>":
        fields = {name: struct.unpack_from(f"{order}h", head, 3200 + at)[0] for name, at in (("interval", 16), ("samples", 20), ("code", 24))}
        kind = SEGY_FORMATS.get(fields["code"])
        if kind and fields["samples"] >= 2 and fields["interval"] >= 1:
            places = {"scalar": (70, "i2"), "sx": (72, "i4"), "sy": (76, "i4"), "rx": (80, "i4"), "north": (170, "f4"), "east": (174, "f4")}
            parts = {"names": [*places, "amp"], "formats": [*(order + k for _, k in places.values()), (order + kind, (fields["samples"],))],
                     "offsets": [*(at for at, _ in places.values()), SEGY_TRACE_HEAD], "itemsize": SEGY_TRACE_HEAD + fields["samples"] * np.dtype(kind).itemsize}
            record = np.dtype(parts)
            if size > SEGY_HEAD and (size - SEGY_HEAD) % record.itemsize == 0:
                break
    else:
        raise Unreadable("not a SEG-Y layout this reader understands")
    first = np.frombuffer(head, record, count=min((len(head) - SEGY_HEAD) // record.itemsize, 64), offset=SEGY_HEAD)
    scalar = int(first["scalar"][0]) if len(first) else 0
    factor = 1 / -scalar if scalar < 0 else float(scalar or 1)
    step = float(np.median(np.diff(first["rx"] * factor))) if len(first) > 1 else 0.0
    mapped = b"RadarMap" in head[:3200]
    place = lambda rows: (rows["east"].astype(float), rows["north"].astype(float)) if mapped else (rows["sx"] * factor, rows["sy"] * factor)
    return Plan(SEGY_HEAD, record, fields["interval"] / 1000.0, step if step > 0 else None, place=place)


#: Fields of a DZT header at their offsets, and how many bytes it has.
DZT_HEAD = np.dtype({
    "names": ["data", "samples", "bits", "per_metre", "span", "channels", "dielectric"], "formats": ["<u2", "<u2", "<u2", "<f4", "<f4", "<u2", "<f4"],
    "offsets": [2, 4, 6, 14, 26, 52, 54], "itemsize": 1024})
#: Sample type of each width, and what stands for zero in it.
DZT_SAMPLES = {8: ("<u1", 2.0**7), 16: ("<u2", 2.0**15), 32: ("<i4", 0.0)}


@layout("dzt")
def dzt_plan(head: bytes, size: int, side: bytes | None) -> Plan:
    need(len(head) >= DZT_HEAD.itemsize, "too short for a DZT header")
    h = {name: v.item() for name, v in zip(DZT_HEAD.names, np.frombuffer(head, DZT_HEAD, 1)[0])}
    kind, zero = DZT_SAMPLES.get(h["bits"], (None, 0.0))
    need(kind is not None and 0 < h["span"] < 10_000 and h["samples"] > 2, "not a DZT layout this reader understands")
    need(h["channels"] < 2, "several channels in one DZT file are not supported")
    blocks = h["data"] if h["data"] < DZT_HEAD.itemsize else max(h["channels"], 1)
    given = h["dielectric"] if 1 <= h["dielectric"] <= 81 else None
    step = 1 / h["per_metre"] if h["per_metre"] > 0 else None
    return whole(Plan(blocks * DZT_HEAD.itemsize, np.dtype([("amp", kind, (h["samples"],))]), h["span"] / h["samples"], step, given, zero, 2), size)


def mala_header(side: bytes) -> dict[str, str]:
    """The header file's lines of `key: value`, keys in capitals."""
    return {k.upper(): v for k, v in re.findall(r"(?m)^[ \t]*([^:\r\n]+?)[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$", side.decode("latin-1"))}


def mala_layout(width: int) -> Layout:
    def plan(head: bytes, size: int, side: bytes | None) -> Plan:
        need(side is not None, "its .rad header is missing")
        given = mala_header(side)
        samples, frequency, step = (number(given.get(k)) for k in ("SAMPLES", "FREQUENCY", "DISTANCE INTERVAL"))
        need(bool(samples) and bool(frequency) and samples >= 1 and frequency > 0, "missing or unreadable SAMPLES/FREQUENCY")
        return whole(Plan(0, np.dtype([("amp", f"<i{width}", (int(samples),))]), 1000.0 / frequency, step if step and step > 0 else None), size)

    return plan


layout("rd3", beside=("rad", "RAD"))(mala_layout(2))
layout("rd7", beside=("rad", "RAD"))(mala_layout(4))


@layout("rad", "ra1", "ra2")
def spr_plan(head: bytes, size: int, side: bytes | None) -> Plan:
    from strata.sources.ingest import SPR_ANCHOR, spr_header

    need(head.find(SPR_ANCHOR) >= 2, "text header not found")
    given = spr_header(head)
    need(given.get("SPR_FILE_VERSION") == "7", f"unsupported file version {given.get('SPR_FILE_VERSION')}")
    samples, interval = number(given.get("SPR_SAMPLES_PER_SCAN")), number(given.get("SPR_SAMPLING_INTERVAL"))
    need(bool(samples) and bool(interval), "no samples per scan or sampling interval")
    first = head.find(SPR_TAG) - SPR_TAG_AT
    need(first >= 0, "no trace records found")
    record = np.dtype({"names": ["size", "tag", "amp"], "formats": ["<u2", f"V{len(SPR_TAG)}", ("<i2", (int(samples),))], "offsets": [2, SPR_TAG_AT, SPR_HEAD], "itemsize": SPR_HEAD + 2 * int(samples)})
    step = number(given.get("SPR_SHAFT_INTERVAL"))

    def check(rows: np.ndarray) -> str | None:
        if (rows["size"] != SPR_HEAD).any():
            return "a record declares another header length"
        return None if (np.frombuffer(rows["tag"].tobytes(), np.uint8).reshape(len(rows), -1) == np.frombuffer(SPR_TAG, np.uint8)).all() else "trace records are not evenly spaced"

    return whole(Plan(first, record, interval / 1000.0, step if step and step > 0 else None, number(given.get("SPR_MEDIUM_DIELECTRIC")), check=check), size)


def number(text: str | None) -> float | None:
    """A decimal number as headers write it, with or without digits before the point or an exponent."""
    return float(text) if text is not None and re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", text.strip()) else None


@dataclass
class Range(InputPartition):
    path: str
    size: int
    first: int  # bytes of the body that the range begins after, rounded to whole traces by the reader
    last: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.first))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: local, hdfs, s3 and what else pyarrow opens by its address."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:/*", "/", path))


def _extension(path: str) -> str:
    return path.rpartition(".")[2].lower()


class RadarReader(DataSourceReader):
    def __init__(self, path: str, split: int, layouts: dict[str, tuple[Layout, tuple[str, ...]]]) -> None:
        self.path, self.split, self.layouts = path, split, layouts

    def partitions(self) -> list[InputPartition]:
        store, inside = _store(self.path)
        info = store.get_file_info(inside)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inside, recursive=True))
        files = {f.path: f for f in found if f.is_file and not re.search(r"(^|/)(\._[^/]*|\.DS_Store)$|(^|/)__MACOSX/", f.path)}
        headers = {p for p in files if _extension(p) == "rad" and any(f"{p[:-4]}.{e}" in files for e in ("rd3", "rd7", "RD3", "RD7")) or re.search(r"(?i)\.rd[37]\.rad$", p)}
        out: list[InputPartition] = []
        for path in sorted(files):
            if _extension(path) in self.layouts and path not in headers:
                size = files[path].size
                out += [Range(path, size, a, min(a + self.split, size)) for a in range(0, max(size, 1), self.split)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        store, _ = _store(self.path)
        schema = pa.schema([("path", pa.string()), ("error", pa.string()), ("trace", pa.int64()), ("samples", pa.list_(pa.float32())), *((n, pa.float64()) for n in ("dt", "spacing", "dielectric", "x", "y"))])
        try:
            yield from self._traces(store, partition, schema)
        except (Unreadable, struct.error, ValueError) as problem:
            if not partition.first:  # one row for a file
                yield pa.RecordBatch.from_pylist([{"path": partition.path, "error": str(problem)}], schema)

    def _traces(self, store: fs.FileSystem, part: Range, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        read, beside = self.layouts[_extension(part.path)]
        with store.open_input_file(part.path) as file:
            plan = read(file.read_at(min(HEAD, part.size), 0), part.size, self._beside(store, part.path, beside))
            one = plan.record.itemsize
            # A range has the traces that begin in its bytes.
            first, last = (max(0, -(-(at - plan.start) // one)) for at in (part.first, part.last))
            step = max(1, (4 << 20) // one)
            for a in range(first, last, step):
                n = min(step, last - a)
                rows = np.frombuffer(file.read_at(n * one, plan.start + a * one), plan.record)
                wrong = plan.check(rows)
                need(wrong is None, wrong or "")
                samples = signal(plan, rows, np.float32)
                place = plan.place(rows)
                width = samples.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(samples.ravel()))
                same = lambda v: pa.array([v] * n, pa.float64())
                columns = [pa.array([part.path] * n), pa.nulls(n, pa.string()), pa.array(np.arange(a, a + n)), lists, same(plan.dt), same(plan.spacing), same(plan.dielectric)]
                columns += [pa.array(p, pa.float64()) for p in place] if place else [pa.nulls(n, pa.float64())] * 2
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    @staticmethod
    def _beside(store: fs.FileSystem, path: str, extensions: tuple[str, ...]) -> bytes | None:
        for candidate in [f"{base}.{e}" for e in extensions for base in (path, path.rpartition(".")[0])]:
            if store.get_file_info(candidate).is_file:
                with store.open_input_file(candidate) as file:
                    return file.read(HEAD)
        return None


class RadarSource(DataSource):
    """Options: path (a file or a folder), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "radar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RadarReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)), LAYOUTS)


def register(spark: SparkSession) -> None:
    """Give the session the format "radar", with the layouts that are known by now; call it again after adding one."""
    layouts = dict(LAYOUTS)

    class SessionRadar(RadarSource):
        """Carries the layouts to the processes that plan and read, which import this module anew."""

        def reader(self, schema) -> DataSourceReader:
            return RadarReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)), layouts)

    spark.dataSource.register(SessionRadar)
