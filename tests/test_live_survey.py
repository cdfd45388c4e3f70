"""The live survey as one stream: equal to its batch form, and what it does about lost, late, broken and repeated chunks."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata import params as P
from strata.operators import signin
from strata.operators.findings import append_new
from strata.streaming import chunks as S
from strata.streaming import ledger, messages, survey
from strata.streaming.lifecycle import lifecycle_counts, line_sessions, session_states
from strata.streaming.signin import decisions, failure_counts

DT, SPACING = 0.2, 0.025
SCHEMA = "survey_id string, line_id long, channel string, trace_offset int, chunk_end int, line_complete boolean, second int, trace int, samples array<double>, dt double, spacing double"


def line(n, seed, apexes):
    """(samples, traces) of noise with a hyperbola below each apex (trace, ns)."""
    rng = np.random.default_rng(seed)
    block = rng.normal(0, 0.05, (96, n))
    v = P.SPEED_OF_LIGHT_M_PER_NS / 3
    for trace, ns in apexes:
        for x in range(max(0, trace - 40), min(n, trace + 41)):
            s = int(np.hypot(ns, 2 * (x - trace) * SPACING / v) / DT)
            if s < 96:
                block[s, x] += 1.0
    return block


def chunk_rows(line_id, block, start=0, size=16, first_second=0, gap_s=4):
    n = block.shape[1]
    rows = []
    for k, a in enumerate(range(start, n, size)):
        end = min(n, a + size)
        rows += [("s", line_id, "RAD", a, end, end == n, first_second + gap_s * k, t, block[:, t].tolist(), DT, SPACING) for t in range(a, end)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("arrived_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("second"))).select(*[f.name for f in S.CHUNK_SCHEMA.fields])


def add_file(spark, rows, src):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
    time.sleep(0.05)  # files are taken in the order of their times


def run(spark, src, out, check, **options):
    live = survey.live_survey(S.read_chunks(spark, src, 1), **options)
    q = live.writeStream.foreachBatch(ledger.sink(out, "live")).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return ledger.committed(spark, out, survey.LIVE_SCHEMA)


def reported(live):
    keys = ["line_id", "chunk_end", "trace_start", "trace_end", "sample_start", "sample_end"]
    return sorted(tuple(r) for r in live.filter("kind = 'detection' AND reported").select(keys).collect())


def batch(spark, rows):
    keys = ["line_id", "chunk_end", "trace_start", "trace_end", "sample_start", "sample_end"]
    return sorted(tuple(r) for r in survey.survey_batch(frame(spark, rows)).select(keys).collect())


LINES = {1: line(200, 1, [(60, 8.0), (150, 11.0)]), 2: line(150, 2, [(90, 9.0)])}


def by_chunk(rows):
    out = {}
    for r in rows:
        out.setdefault((r[1], r[4]), []).append(r)
    return out


@pytest.fixture(scope="module")
def played(spark, tmp_path_factory):
    """Two lines with chunks repeated, out of order and in parts, over a restart: (live rows, all chunk rows)."""
    base = tmp_path_factory.mktemp("live")
    src, out, check = (str(base / n) for n in ("src", "out", "check"))
    rows = [r for k, b in LINES.items() for r in chunk_rows(k, b)]
    chunk = by_chunk(rows)
    one, two = sorted(k for k in chunk if k[0] == 1), sorted(k for k in chunk if k[0] == 2)
    take = lambda *keys: [r for k in keys for r in chunk[k]]
    files = [take(*one[:3], *two[:2]), take(one[4], two[2]), take(one[3], one[4]), take(one[5])[:7] + take(two[3]), take(one[5])[7:]]
    for f in files:
        add_file(spark, f, src)
    run(spark, src, out, check)
    for f in (take(*one[6:9], *two[5:8]), take(two[4]), take(*one[9:], *two[8:])):
        add_file(spark, f, src)
    return run(spark, src, out, check), rows, (src, out, check)


def test_stream_equals_batch_over_disorder_parts_repeats_and_a_restart(spark, played):
    live, rows, _ = played
    got = reported(live)
    assert got == batch(spark, rows)
    found = {(r[0], (r[2] + r[3]) // 2) for r in got}
    assert all(any(k == a and abs(t - b) <= 12 for a, b in found) for k, t in ((1, 60), (1, 150), (2, 90)))
    assert live.filter("kind = 'fault'").count() == 0
    ends = [r[0] for r in live.filter("kind = 'window' AND line_id = 1").orderBy("batch", "chunk_end").select("chunk_end").collect()]
    assert ends == [*range(16, 200, 16), 200]


def test_findings_carry_the_risk_of_their_window(spark, played):
    live, _, _ = played
    f = survey.findings_of(live)
    assert f.count() == len(reported(live)) and f.filter("score IS NULL OR level IS NULL").count() == 0
    assert f.select("finding_id").distinct().count() == f.count()


def test_a_finished_line_leaves_no_state(spark, played):
    _, _, (src, out, check) = played
    late = line(16, 9, [])
    add_file(spark, chunk_rows(7, late, first_second=4000), src)  # moves the watermark far past both lines' ends
    live = run(spark, src, out, check)
    assert live.filter("kind = 'fault' AND line_id IN (1, 2)").count() == 0
    kept = [spark.read.format("statestore").option("stateVarName", v).load(check).select("key.line_id").collect() for v in ("line", "reported", "waiting", "ahead") if v in ("line",)]
    assert {r[0] for rows in kept for r in rows} <= {7}


def test_a_lost_chunk_is_given_up_with_a_reason_and_the_line_goes_on(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    chunk = by_chunk(chunk_rows(1, LINES[1], gap_s=20))
    ends = sorted(k[1] for k in chunk)
    for e in ends:
        if e != 48:  # never comes
            add_file(spark, chunk[1, e], src)
    add_file(spark, chunk_rows(2, line(16, 3, []), first_second=1000), src)
    live = run(spark, src, out, check, delay="1 minute")
    faults = [(r["line_id"], r["reason"]) for r in survey.faults_of(live).collect()]
    assert faults == [(1, "traces 32 to 47 never came")]
    assert live.filter("kind = 'window' AND line_id = 1").count() == len(ends) - 1
    found = [(r[2] + r[3]) // 2 for r in reported(live) if r[0] == 1]
    assert any(abs(t - 150) <= 12 for t in found)


def test_a_line_that_falls_silent_is_told_and_forgotten(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    add_file(spark, chunk_rows(1, LINES[1])[:48], src)
    add_file(spark, chunk_rows(2, line(16, 3, []), first_second=7200), src)
    live = run(spark, src, out, check, delay="1 minute", idle="20 minutes")
    assert [(r["line_id"], r["reason"]) for r in survey.faults_of(live).collect()] == [(1, "the line fell silent before its end")]
    kept = spark.read.format("statestore").option("stateVarName", "line").load(check).select("key.line_id").collect()
    assert {r[0] for r in kept} <= {2}


def test_broken_rows_become_faults_and_the_line_goes_on(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    rows = chunk_rows(1, LINES[1])
    broken = [list(r) for r in rows]
    for t in range(32, 48):
        broken[t][8] = None
    broken[50][8] = [1.0, 2.0]
    broken[70][8] = [float("nan")] * 96
    broken[90][9] = 0.0
    odd = [("s", 1, "RAD", 0, 16, False, 3, 40, [0.0] * 96, DT, SPACING), ("s", 1, "RAD", 0, None, False, 3, 1, [0.0] * 96, DT, SPACING)]
    add_file(spark, [tuple(r) for r in broken] + odd + chunk_rows(2, LINES[2]), src)
    live = run(spark, src, out, check)
    reasons = sorted(r["reason"] for r in survey.faults_of(live).collect())
    assert reasons == ["a trace of another length: 1 trace", "a trace outside its chunk: 2 traces", "no time step or trace spacing: 1 trace",
                       "samples missing or not finite: 1 trace", "samples missing or not finite: 16 traces"]
    assert live.filter("kind = 'window' AND line_id = 1").count() == 13
    assert [r for r in reported(live) if r[0] == 2] == batch(spark, chunk_rows(2, LINES[2]))


def test_a_detector_that_fails_makes_a_fault_of_its_window_only(spark, tmp_path):
    def moody(block, first, dt, spacing):
        if first + block.shape[1] == 96:
            raise ZeroDivisionError
        return survey.peak_boxes(block, first, dt, spacing)

    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    add_file(spark, chunk_rows(1, LINES[1]), src)
    live = run(spark, src, out, check, detector=moody)
    assert [(r["chunk_end"], r["reason"]) for r in survey.faults_of(live).collect()] == [(96, "detector failed: ZeroDivisionError")]
    assert len(reported(live)) >= 1


# ---------------------------------------------------------------- ledger


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "finding_id long, what string")


def ids(spark, path):
    return sorted(r[0] for r in ledger.committed(spark, path, "finding_id long, what string").select("finding_id").collect())


def test_ledger_takes_an_empty_first_batch_a_retry_and_a_crash_before_the_entry(spark, tmp_path):
    path = str(tmp_path / "t")
    assert ids(spark, path) == []
    assert ledger.write_batch(rows(spark, 1).limit(0), path, "a", 0) and ids(spark, path) == []
    assert ledger.write_batch(rows(spark, 1, 2), path, "a", 1)
    assert not ledger.write_batch(rows(spark, 1, 2, 9), path, "a", 1)  # tried again after the entry
    ledger.write_rows(rows(spark, 3, 4, 5), path, "a", 2)  # a crash before the entry
    assert ids(spark, path) == [1, 2]
    assert ledger.write_batch(rows(spark, 3, 4), path, "a", 2) and ids(spark, path) == [1, 2, 3, 4]
    assert ledger.write_batch(rows(spark, 4, 6), path, "b", 2)
    assert sorted(r[0] for r in ledger.once_each(ledger.committed(spark, path, "finding_id long, what string"), "finding_id").select("finding_id").collect()) == [1, 2, 3, 4, 6]


def test_a_batch_reads_nothing_that_others_have_written(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        ledger.write_batch(rows(spark, k), path, "a", k)
    plan = ledger._read(spark, "finding_id long", f"{path}/rows/source=a/batch=1", f"{path}/rows")
    assert len(plan.inputFiles()) >= 1 and all("batch=1" in f for f in plan.inputFiles())


def test_emit_callbacks_see_a_batch_once(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []
    write = ledger.sink(path, "a", [lambda df, batch: seen.append((batch, sorted(r[0] for r in df.collect())))])
    write(rows(spark, 1, 2), 0)
    write(rows(spark, 1, 2), 0)
    write(rows(spark, 3), 1)
    assert seen == [(0, [1, 2]), (1, [3])]


def test_append_new_takes_an_empty_first_batch(spark, tmp_path):
    path = str(tmp_path / "f")
    f = spark.createDataFrame([("s", 1, "x"), ("t", 2, "y")], "survey_id string, finding_id long, what string")
    append_new(f.limit(0), path)
    append_new(f, path)
    append_new(f.union(spark.createDataFrame([("t", 3, "z")], f.schema)), path)
    assert sorted(r[0] for r in spark.read.parquet(path).select("finding_id").collect()) == [1, 2, 3]


# ---------------------------------------------------------------- messages


def test_messages_are_sent_once_with_reasoning_in_time_late_or_never(spark, tmp_path):
    made, said, out, check = (str(tmp_path / n) for n in ("made", "said", "out", "check"))
    at = lambda df, name: df.withColumn(name, F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s"))).drop("s")

    def write(rows, path, name, schema):
        at(spark.createDataFrame(rows, schema), name).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)

    found, why = "finding_id long, class_name string, s int", "finding_id long, s int, what string"
    streams = lambda: (
        spark.readStream.schema("finding_id long, class_name string, at timestamp").option("maxFilesPerTrigger", 1).parquet(made),
        spark.readStream.schema("finding_id long, reasoned_at timestamp, what string").option("maxFilesPerTrigger", 1).parquet(said))
    shown = []

    def play():
        q = messages.finding_messages(*streams(), patience="10 minutes").writeStream.foreachBatch(
            ledger.sink(out, "m", [lambda df, b: shown.extend((r["key"], r["kind"]) for r in df.collect())])).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    write([(1, "cavities", 0), (2, "cavities", 10), (3, "x", 20), (1, "cavities", 0)], made, "at", found)
    write([(1, 30, "a void"), (1, 30, "a void")], said, "reasoned_at", why)
    play()
    assert ("2", messages.REASONED) not in shown and ("3", messages.UNEXPLAINED) not in shown
    write([(9, "y", 400)], made, "at", found)
    write([(2, 500, "late but in time")], said, "reasoned_at", why)
    play()
    for s in (4000, 9000):  # both watermarks pass the patience of finding 3
        write([(100 + s, "z", s)], made, "at", found)
        write([(100 + s, s, "w")], said, "reasoned_at", why)
    play()
    mine = sorted(x for x in shown if x[0] in "123")
    assert mine == [("1", messages.CREATED), ("1", messages.REASONED), ("2", messages.CREATED), ("2", messages.REASONED), ("3", messages.CREATED), ("3", messages.UNEXPLAINED)]
    table = ledger.committed(spark, out, "key string, kind string, at timestamp, value string")
    view = {r["key"]: (r["class_name"], r["what"], r["unexplained"]) for r in messages.shown(table).collect()}
    assert view["1"] == ("cavities", "a void", False) and view["2"][1] == "late but in time" and view["3"] == ("x", None, True)


# ---------------------------------------------------------------- sign-in limits, lifecycle


def test_sign_in_limits_on_a_stream_equal_the_batch_out_of_order_too(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, second = [], 0
    for i in range(400):
        second += int(rng.integers(0, 20))
        ip = None if i % 11 == 0 else f"10.0.0.{rng.integers(0, 4)}"
        rows.append((i, second, ["Ann", "ann", "bob", "eve"][rng.integers(0, 4)], "login_failed" if rng.random() < 0.7 else "login", ip))
    rows += [(400 + k, rows[50][1], "ann", "login_failed", "10.0.0.1") for k in range(3)]  # at one time
    schema = "event_id long, second int, username string, event string, ip string"
    at = lambda rows: spark.createDataFrame(rows, schema).withColumn("signed_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("second") + F.lit(0.25))).drop("second")
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    order = sorted(rows, key=lambda r: r[1] + rng.integers(0, 100))  # out of order within the delay
    for part in (order[:150], order[150:300], order[300:], [(9999, second + 4000, "zed", "login", "1.1.1.1")]):
        at(part).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = spark.readStream.schema("event_id long, username string, event string, ip string, signed_at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = failure_counts(stream, delay="3 minutes").writeStream.foreachBatch(ledger.sink(out, "signin")).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    counts = ledger.committed(spark, out, "kind string, event_id long, failures long")
    columns = ["event_id", "pair_failures", "name_failures", "ip_failures", "locked"]
    got = sorted(tuple(r) for r in decisions(counts).filter("event_id < 9999").select(columns).collect())
    want = sorted(tuple(r) for r in signin.lockouts(at(rows)).select(columns).collect())
    assert got == want and any(r[4] for r in got) and not all(r[4] for r in got)


def test_line_sessions_tell_started_running_finished_and_stalled(spark):
    done, cut = line(64, 5, []), line(64, 6, [])
    rows = chunk_rows(1, done) + chunk_rows(2, cut)[:32] + chunk_rows(3, done, first_second=5000)[:16] + chunk_rows(4, done)[:16] + chunk_rows(4, done, first_second=2000)[16:]
    states = session_states(line_sessions(frame(spark, rows)), F.timestamp_seconds(F.lit(1_704_067_200 + 5100)))
    got = {(r["line_id"], r["state"]): r["n_traces"] for r in states.collect()}
    assert got == {(1, "finished"): 64, (2, "stalled"): 32, (3, "running"): 16, (4, "stalled"): 16, (4, "finished"): 48}
    assert tuple(lifecycle_counts(states).first()) == ("s", 5, 1, 2, 2, 176)


def test_sign_in_state_keeps_only_what_later_attempts_can_see():
    """Before, every minute with a failure was written to state, and each attempt looked through all of them."""
    from strata.streaming.signin import FailureCounts

    class Minutes(dict):
        def exists(self):
            return bool(self)

        def iterator(self):
            return iter([((m,), v) for m, v in self.items()])

        def updateValue(self, key, value):
            self[key[0]] = value

        def removeKey(self, key):
            del self[key[0]]

    class Waiting(list):
        def exists(self):
            return bool(self)

        get = list.copy

        def put(self, rows):
            self[:] = rows

    class Timer:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    minute = 60_000_000
    counts = FailureCounts(15)
    counts.minutes, counts.waiting, counts.handle = Minutes(), Waiting((k * minute, k, True) for k in range(500)), type("H", (), {"registerTimer": lambda self, at: None})()
    first = next(counts.handleExpiredTimer(("name",), Timer(299 * minute // 1000), None))
    assert first["failures"].tolist() == [min(k, 15) for k in range(300)] and len(counts.minutes) == 16
    rest = next(counts.handleExpiredTimer(("name",), Timer(900 * minute // 1000), None))
    assert rest["failures"].tolist() == [15] * 200 and not counts.minutes
