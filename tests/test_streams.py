"""Live rules: settle, persist, report once; the stream equals its batch twin, also after a restart."""

import json
import time

import pytest
from pyspark.sql import functions as F

from strata.streaming import chunks as S
from strata.streaming.lifecycle import SurveyRuns, survey_states
from strata.streaming.signin import failure_windows

BOX = {"trace_start": 10, "trace_end": 30, "sample_start": 5, "sample_end": 20}


def run(windows):
    reported, waiting, out = [], [], []
    for boxes, end, complete in windows:
        new, reported, waiting = S.settle_window(boxes, end, complete, reported, waiting)
        out.append(len(new))
    return out


def test_steady_box_is_reported_once():
    assert run([([BOX], e, False) for e in (96, 112, 128, 144, 160)]) == [0, 0, 0, 1, 0]


def test_one_window_box_never_and_a_miss_restarts_the_streak():
    assert run([([BOX], 96, False), ([], 112, False)]) == [0, 0]
    assert run([([BOX], 96, False), ([BOX], 112, False), ([], 128, False)] + [([BOX], e, False) for e in (144, 160, 176, 192)]) == [0, 0, 0, 0, 0, 0, 1]


def test_leading_edge_is_held_and_the_last_window_needs_no_streak():
    assert run([([BOX], 40, False)] * 5) == [0] * 5
    assert run([([BOX], 40, True)]) == [1]


COLUMNS = ["survey_id", "line_id", "channel", "chunk_end", "window_end", "line_complete", "arrived_at", "class_name", "confidence", "trace_start", "trace_end", "sample_start", "sample_end"]


def windows(line, ends, last, boxes):
    rows = []
    for e in ends:
        seen = [b for b in boxes if b[1] <= e]
        for a, z, s, t in seen or [(None,) * 4]:
            rows.append(("s", line, "RAD", e, e, e == last, "2024-01-01 00:00:00", "cavities" if seen else None, 0.5 if seen else None, a, z, s, t))
    return rows


def as_frame(spark, rows):
    schema = ", ".join(p if not p.startswith("arrived_at") else "arrived_at string" for p in S.WINDOW_BOX_SCHEMA.split(", "))
    return spark.createDataFrame(rows, schema).withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))


def stream(spark, src, out, checkpoint):
    s = spark.readStream.schema(S.WINDOW_BOX_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = S.report_once(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_equals_batch_with_duplicates_disorder_and_restart(spark, tmp_path):
    boxes = [(10, 30, 5, 20), (40, 60, 30, 50), (100, 120, 5, 20)]
    rows = [r for line in (1, 2) for r in windows(line, range(16, 257, 16), 256, boxes)]
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    by_end = lambda *ends: as_frame(spark, [r for r in rows if r[3] in ends])
    order = [(16, 32, 48), (80,), (64,), (64, 80), (112, 96), (128, 144, 160)]
    for ends in order:
        by_end(*ends).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream(spark, src, out, check)
    by_end(*range(176, 257, 16)).coalesce(1).write.mode("append").parquet(src)
    stream(spark, src, out, check)  # a new query from the checkpoint
    key = ["line_id", "chunk_end", "trace_start", "trace_end", "sample_start"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(key).collect())
    want = sorted(tuple(r) for r in S.report_once_batch(as_frame(spark, rows)).select(key).collect())
    assert got == want and len(want) == 6


def test_a_window_in_parts_is_settled_once_it_is_whole(spark, tmp_path):
    boxes = [(10, 30, 5, 20), (40, 60, 30, 50), (100, 120, 5, 20)]
    rows = windows(1, range(16, 257, 16), 256, boxes)
    counted = as_frame(spark, rows).join(as_frame(spark, rows).groupBy("chunk_end").agg(F.count("trace_start").cast("int").alias("n_boxes")), "chunk_end")
    schema = S.WINDOW_BOX_SCHEMA + ", n_boxes int"
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    names = [c.split(" ")[0] for c in schema.split(", ")]
    for part in (F.col("trace_start").isNull() | (F.col("trace_start") != 40), F.col("trace_start") == 40):  # the second box of every window comes later
        counted.filter(part).select(names).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = S.report_once(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    key = ["line_id", "chunk_end", "trace_start", "trace_end", "sample_start"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(key).collect())
    assert got == sorted(tuple(r) for r in S.report_once_batch(as_frame(spark, rows)).select(key).collect()) and len(got) == 3


def test_replayed_windows_grow_and_end_complete(spark):
    lines = spark.createDataFrame([(1, 50, 0.025)], "line_id long, n_traces int, spacing double")
    w = S.replay_windows(lines, 16).orderBy("chunk_end").collect()
    assert [r["chunk_end"] for r in w] == [16, 32, 48, 50] and [r["line_complete"] for r in w] == [False, False, False, True]


def test_repeated_chunks_count_once(spark, tmp_path):
    row = [("s", 1, "RAD", 0, 16, False, "2024-01-01 00:00:00", 3, [1.0])] * 2
    df = spark.createDataFrame(row, "survey_id string, line_id long, channel string, trace_offset int, chunk_end int, line_complete boolean, arrived_at string, trace int, samples array<double>")
    src = str(tmp_path / "c")
    df.withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).write.parquet(src)
    q = S.without_repeats(S.read_chunks(spark, src)).writeStream.format("memory").queryName("seen_chunks").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen_chunks").count() == 1


def test_failure_windows_and_survey_states(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i}:00", "ann", 1, "login_failed", None) for i in range(6)]
    e = spark.createDataFrame(rows, "event_id long, signed_at string, username string, user_id long, event string, ip string")
    src, runs = str(tmp_path / "e"), str(tmp_path / "runs")
    e.withColumn("signed_at", F.col("signed_at").cast("timestamp")).write.parquet(src)
    listener = SurveyRuns(spark, runs)
    spark.streams.addListener(listener)
    try:
        schema = "event_id long, signed_at timestamp, username string, user_id long, event string, ip string"
        q = failure_windows(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("failures").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table("failures").agg(F.max("failures"), F.max("locked")).first()[:2] == (6, True)
        for _ in range(50):
            try:
                states = survey_states(spark.read.parquet(runs)).collect()
                if states and states[0]["state"] == "completed":
                    break
            except Exception:  # noqa: BLE001 - the listener writes in its own time
                pass
            time.sleep(0.2)
        assert states[0]["state"] == "completed" and states[0]["survey_id"] == "failures"
    finally:
        spark.streams.removeListener(listener)


def test_messages_carry_the_finding(spark):
    m = S.event_messages(spark.createDataFrame([(5, "x")], "finding_id long, what string"), "finding.created").first()
    assert m["key"] == "5" and json.loads(m["value"]) == {"type": "finding.created", "data": {"finding_id": 5, "what": "x"}}


@pytest.mark.parametrize("offset, n, complete, ok", [(0, 63, False, False), (0, 64, False, True), (0, 5, True, True)])
def test_warm_up(spark, offset, n, complete, ok):
    assert spark.range(1).select(S.warmed_up(F.lit(complete), F.lit(offset), F.lit(n))).first()[0] is ok


def test_few_boxes_are_compared_without_arrays_and_alike(monkeypatch):
    """Before, each window made three arrays, also where nothing was left to compare."""
    import random

    rng = random.Random(3)
    box = lambda: dict(zip(S.BOX_FIELDS, (a := rng.randrange(40), a + rng.randrange(1, 20), d := rng.randrange(30), d + rng.randrange(1, 12))))
    for _ in range(200):
        a, b = ([box() for _ in range(rng.randrange(0, 6))] for _ in range(2))
        few = S._one_target(a, b)
        with monkeypatch.context() as m:
            m.setattr(S, "FEW", -1)
            assert few.shape == (len(a), len(b)) and (few == S._one_target(a, b)).all()
    with monkeypatch.context() as m:
        m.setattr(S, "_one_target", None)
        assert S.settle_window([], 64, False, [box()], [{**box(), "streak": 2}])[2] == []
