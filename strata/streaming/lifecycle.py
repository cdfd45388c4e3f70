"""Start, progress and end of streaming surveys as rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

RUN_SCHEMA = "run_id string, survey_id string, event string, at string, input_rows long, error string"


class SurveyRuns(StreamingQueryListener):
    """Appends one row per life event of every query; a query's name is its survey."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.names: dict[str, str] = {}

    def _append(self, run_id: str, event: str, at: str, rows: int = 0, error: str | None = None) -> None:
        row = [(run_id, self.names.get(run_id), event, at, rows, error)]
        self.spark.createDataFrame(row, RUN_SCHEMA).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._append(str(event.runId), "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self._append(str(p.runId), "progress", p.timestamp, p.numInputRows)

    def onQueryTerminated(self, event) -> None:
        self._append(str(event.runId), "failed" if event.exception else "completed", "", 0, event.exception)


def survey_states(runs: DataFrame) -> DataFrame:
    """Latest state, start and rows of each run."""
    first = F.min(F.when(F.col("event") == "started", F.col("at")))
    ended = F.max(F.when(F.col("event").isin("completed", "failed"), F.col("event")))
    return runs.groupBy("run_id", "survey_id").agg(first.alias("started_at"), F.sum("input_rows").alias("input_rows"), F.coalesce(ended, F.lit("running")).alias("state"))


GAP = "10 minutes"


def line_sessions(chunks: DataFrame, gap: str = GAP) -> DataFrame:
    """survey_id, line_id, channel, started_at, last_at, ends_at, n_traces, complete: stretches of a line without a silence of `gap`.

    On a stream with a watermark on arrived_at, sessions come once they are closed; in a batch all of them do.
    """
    keys = ["survey_id", "line_id", "channel"]
    of = chunks.groupBy(F.session_window("arrived_at", gap).alias("w"), *keys)
    sessions = of.agg(F.max("arrived_at").alias("last_at"), F.count("*").alias("n_traces"), F.bool_or("line_complete").alias("complete"))
    return sessions.select(*keys, F.col("w.start").alias("started_at"), "last_at", F.col("w.end").alias("ends_at"), "n_traces", "complete")


def session_states(sessions: DataFrame, now: Column) -> DataFrame:
    """With `state`: finished, or stalled once the silence after it is over, or running."""
    state = F.when(F.col("complete"), "finished").when(F.col("ends_at") <= now, "stalled").otherwise("running")
    return sessions.withColumn("state", state)


def lifecycle_counts(states: DataFrame) -> DataFrame:
    """Started, running, finished and stalled stretches of each survey."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.groupBy("survey_id").agg(F.count("*").alias("started"), n("running"), n("finished"), n("stalled"), F.sum("n_traces").alias("n_traces"))
