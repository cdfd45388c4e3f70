"""Live-survey queries in their batch form: windows, report-once, risk, lock-outs, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import signin
from strata.plans import views as V
from strata.plans.registry import query
from strata.session import shared_folder
from strata.streaming import chunks as S
from strata.streaming import ledger, lifecycle, survey
from strata.streaming.signin import decisions, failure_counts

C = F.col


@query("C12_S01_replay_windows", """
  SELECT line_id, channel, CAST(least(i * 16, n_traces) AS INTEGER) AS chunk_end, CAST(greatest(0, least(i * 16, n_traces) - 24) AS INTEGER) AS trace_offset, least(i * 16, n_traces) = n_traces AS line_complete,
    round(greatest(0, least(i * 16, n_traces) - 24) * 0.025, 6) AS position_m, CASE WHEN least(i * 16, n_traces) = n_traces OR least(i * 16, n_traces) >= 64 THEN true ELSE false END AS warm
  FROM line_table, range(1, 4) AS r(i) WHERE i <= greatest(1, ceil(n_traces / 16))""")
def _(spark, sf):
    w = S.replay_windows(V.line_table(spark, sf), 16, 24)
    warm = S.warmed_up(C("line_complete"), C("trace_offset"), C("chunk_end") - C("trace_offset"))
    return w.select("line_id", "channel", "chunk_end", "trace_offset", "line_complete", F.round("position_m", 6).alias("position_m"), warm.alias("warm"))


def window_boxes(spark, sf):
    """Boxes as a detector would see them window after window: they flicker with the window number."""
    f = V.findings(spark, sf).select(
        C("survey_id"), C("line_id"), F.lit("RAD").alias("channel"), "class_name", "confidence", "finding_id",
        (C("finding_id") % 160).cast("int").alias("trace_start"), (C("finding_id") % 160 + 10 + C("finding_id") % 7).cast("int").alias("trace_end"),
        (C("finding_id") % 50).cast("int").alias("sample_start"), (C("finding_id") % 50 + 12).cast("int").alias("sample_end"))
    w = f.withColumn("chunk_end", F.explode(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: i * 16)))
    w = w.filter((C("trace_end") <= C("chunk_end")) & ((C("finding_id") + C("chunk_end") / 16) % 7 != 0))
    return w.select("survey_id", "line_id", "channel", "chunk_end", C("chunk_end").alias("window_end"), (C("chunk_end") == 256).alias("line_complete"),
                    "class_name", "confidence", "trace_start", "trace_end", "sample_start", "sample_end")


@query("S03_report_once", None)
def _(spark, sf):
    return S.report_once_batch(window_boxes(spark, sf))


@query("S05_window_risk", """
  WITH b AS (SELECT survey_id, line_id, class_name, confidence, CAST(i * 16 AS INTEGER) AS chunk_end FROM findings, range(1, 17) AS r(i) WHERE finding_id % 160 + 10 + finding_id % 7 <= i * 16 AND (finding_id + i) % 7 <> 0),
  s AS (SELECT survey_id, line_id, chunk_end, avg(CASE class_name WHEN 'elongated_linear_target' THEN 1.0 WHEN 'cavities' THEN 0.9 WHEN 'clear_point_reflector' THEN 0.7 WHEN 'intersecting_linear_and_point_reflector' THEN 0.9 WHEN 'disturbed_zone' THEN 0.3 ELSE 0.2 END * confidence) AS score,
    (bool_or(class_name = 'cavities') AND bool_or(class_name IN ('elongated_linear_target', 'intersecting_linear_and_point_reflector'))) OR count(*) FILTER (WHERE class_name = 'elongated_linear_target' AND confidence > 0.8) >= 2 AS escalated FROM b GROUP BY ALL)
  SELECT survey_id, line_id, chunk_end, round(score, 9) AS score, CASE WHEN escalated THEN 'HIGH' WHEN score < 0.35 THEN 'LOW' WHEN score < 0.65 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM s""")
def _(spark, sf):
    r = S.window_risk(window_boxes(spark, sf))
    return r.select("survey_id", "line_id", "chunk_end", F.round("score", 9).alias("score"), "level")


def _win(keys: str) -> str:
    return f"count(*) FILTER (WHERE event = 'login_failed') OVER (PARTITION BY {keys} ORDER BY signed_at RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW) - CASE WHEN event = 'login_failed' THEN 1 ELSE 0 END"


@query("S09_A08_lockouts", f"""
  WITH c AS (SELECT *, {_win("lower(username), coalesce(ip, '-')")} AS pair_failures, {_win("lower(username)")} AS name_failures, CASE WHEN ip IS NULL THEN 0 ELSE {_win("ip")} END AS ip_failures FROM login_events)
  SELECT event_id, pair_failures, name_failures, ip_failures, pair_failures >= 5 OR name_failures >= 50 OR (ip IS NOT NULL AND ip_failures >= 20) AS locked FROM c""")
def _(spark, sf):
    e = signin.lockouts(V.login_events(spark, sf))
    return e.select("event_id", "pair_failures", "name_failures", "ip_failures", "locked")


@query("S06_S07_S08_finding_messages", """
  SELECT CAST(finding_id AS VARCHAR) AS key, json_object('type', 'finding.created', 'data', json_object('finding_id', finding_id, 'class_name', class_name, 'line_id', line_id)) ->> '$.type' AS kind,
    CASE WHEN finding_id % 5 = 0 THEN 'explained' END AS what FROM findings WHERE NOT (depth_confidence = 'unavailable' AND line_id % 10 = 0)""")
def _(spark, sf):
    from strata.operators.quality import split_valid

    f = V.findings(spark, sf)
    good, _ = split_valid(f, [("unplaceable depth", ~((C("depth_confidence") == "unavailable") & (C("line_id") % 10 == 0)))])
    reasoned = good.filter(C("finding_id") % 5 == 0).select("finding_id", F.lit("explained").alias("what"))
    merged = S.merged_messages(good.select("finding_id", "class_name", "line_id"), reasoned)
    m = S.event_messages(merged, "finding.created")
    return m.select("key", F.get_json_object("value", "$.type").alias("kind"), F.get_json_object("value", "$.data.what").alias("what"))


def live_chunks(spark, sf):
    """Lines of 200 traces and three channels as chunks of 16 traces, one row per trace."""
    vec, size = C("vec_id"), S.P.CHUNK_TRACES
    t = V.table(spark, sf, "embeddings").select(
        F.lit("live").alias("survey_id"), F.floor(vec / 600).alias("line_id"), F.when(vec % 3 == 0, "RAD").when(vec % 3 == 1, "RA1").otherwise("RA2").alias("channel"),
        F.floor((vec % 600) / 3).cast("int").alias("trace"), C("embedding").cast("array<double>").alias("samples"), F.lit(0.2).alias("dt"), F.lit(0.025).alias("spacing"))
    n = t.groupBy("line_id", "channel").agg((F.max("trace") + 1).alias("n"))
    offset = F.floor(C("trace") / size).cast("int") * size
    t = t.join(n, ["line_id", "channel"]).withColumn("trace_offset", offset).withColumn("chunk_end", F.least(offset + size, C("n")))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + C("line_id") * 60 + F.floor(C("trace_offset") / 4))
    return t.select("survey_id", "line_id", "channel", "trace_offset", "chunk_end", (C("chunk_end") == C("n")).alias("line_complete"), at.alias("arrived_at"), "trace", "samples", "dt", "spacing")


REPORTED = ["line_id", "channel", "chunk_end", "class_name", "confidence", "trace_start", "trace_end", "sample_start", "sample_end"]


@query("S02_live_survey", None)
def _(spark, sf):
    return survey.survey_batch(live_chunks(spark, sf)).select(*REPORTED)


def play(stream, schema, folder):
    """Run a stream over all that its source has, into a ledger table, and read that."""
    path = f"{folder}/table"
    run = stream.writeStream.foreachBatch(ledger.sink(path, "live")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return ledger.committed(stream.sparkSession, path, schema)


@query("S01_S05_live_stream", None)
def _(spark, sf):
    folder = shared_folder(spark, "live-survey")
    live_chunks(spark, sf).write.parquet(f"{folder}/chunks")
    with survey.state_store(spark):
        live = play(survey.live_survey(S.read_chunks(spark, f"{folder}/chunks")), survey.LIVE_SCHEMA, folder)
    return survey.findings_of(live).select(*REPORTED, F.round("score", 9).alias("score"), "level")


@query("S09_lockout_stream", f"""
  WITH c AS (SELECT *, {_win("lower(username), coalesce(ip, '-')")} AS pair_failures, {_win("lower(username)")} AS name_failures, CASE WHEN ip IS NULL THEN 0 ELSE {_win("ip")} END AS ip_failures FROM login_events)
  SELECT event_id, CAST(pair_failures AS BIGINT) AS pair_failures, CAST(name_failures AS BIGINT) AS name_failures, CAST(ip_failures AS BIGINT) AS ip_failures,
    pair_failures >= 5 OR name_failures >= 50 OR (ip IS NOT NULL AND ip_failures >= 20) AS locked FROM c""")
def _(spark, sf):
    folder = shared_folder(spark, "sign-ins")
    e = V.login_events(spark, sf).select("event_id", C("signed_at").cast("timestamp").alias("signed_at"), "username", "event", "ip")
    last = e.agg(F.max("signed_at").alias("signed_at")).select(F.lit(-1).cast("long").alias("event_id"), (C("signed_at") + F.expr("INTERVAL 1 DAY")).alias("signed_at"), F.lit("").alias("username"), F.lit("end").alias("event"), F.lit(None).cast("string").alias("ip"))
    e.write.parquet(f"{folder}/events")
    last.write.mode("append").parquet(f"{folder}/events")  # an event a day later lets the watermark pass all others
    with survey.state_store(spark):
        counts = play(failure_counts(spark.readStream.schema(e.schema).parquet(f"{folder}/events")), "kind string, event_id long, failures long", folder)
    return decisions(counts.filter("event_id >= 0"))


_ARRIVALS = """a AS (SELECT 's' || ((vec_id // 60) % 2) AS survey_id, vec_id // 60 AS line_id, vec_id % 3 AS channel, (vec_id % 60) // 12 AS chunk,
    TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (420 * (vec_id // 60) + 60 * ((vec_id % 60) // 12) + CASE WHEN (vec_id // 60) % 3 = 0 AND (vec_id % 60) // 12 >= 3 THEN 1800 ELSE 0 END) AS seen,
    (vec_id % 60) // 12 = 4 AND (vec_id // 60) % 4 <> 1 AS complete FROM embeddings)"""


@query("S11_line_lifecycle", f"""
  WITH {_ARRIVALS}, s AS (SELECT *, sum(fresh) OVER (PARTITION BY line_id, channel ORDER BY seen RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
    FROM (SELECT *, CASE WHEN seen - max(seen) OVER (PARTITION BY line_id, channel ORDER BY seen RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) <= INTERVAL 10 MINUTE THEN 0
      WHEN row_number() OVER (PARTITION BY line_id, channel, seen) > 1 THEN 0 ELSE 1 END AS fresh FROM a)),
  g AS (SELECT survey_id, line_id, channel, k, max(seen) + INTERVAL 10 MINUTE AS ends, count(*) AS n, bool_or(complete) AS complete FROM s GROUP BY ALL),
  now AS (SELECT max(seen) AS now FROM a)
  SELECT survey_id, count(*) AS started, count(*) FILTER (WHERE NOT complete AND ends > now) AS running, count(*) FILTER (WHERE complete) AS finished,
    count(*) FILTER (WHERE NOT complete AND ends <= now) AS stalled, CAST(sum(n) AS BIGINT) AS n_traces FROM g, now GROUP BY survey_id""")
def _(spark, sf):
    vec = C("vec_id")
    line, chunk = F.floor(vec / 60), F.floor((vec % 60) / 12)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + 420 * line + 60 * chunk + F.when((line % 3 == 0) & (chunk >= 3), 1800).otherwise(0))
    rows = V.table(spark, sf, "embeddings").select(
        F.concat(F.lit("s"), (line % 2).cast("string")).alias("survey_id"), line.alias("line_id"), (vec % 3).cast("string").alias("channel"),
        at.alias("arrived_at"), ((chunk == 4) & (line % 4 != 1)).alias("line_complete"))
    now = rows.agg(F.max("arrived_at")).first()[0]
    return lifecycle.lifecycle_counts(lifecycle.session_states(lifecycle.line_sessions(rows), F.lit(now)))
