"""What a survey tells its clients: a finding when it is made, and its reasoning once that comes, each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
PATIENCE = "10 minutes"
#: Kinds of messages.
CHUNK, CREATED, REASONED, UNEXPLAINED = "frame.chunk", "finding.created", "finding.reasoned", "finding.unexplained"


def envelope(kind: Column | str, key: Column, at: Column, *data: Column | str) -> list[Column]:
    """key, kind, at, value: a message whose value is JSON with its kind and its data."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [key.cast("string").alias("key"), kind.alias("kind"), at.alias("at"), F.to_json(F.struct(kind.alias("type"), F.struct(*data).alias("data"))).alias("value")]


def chunk_messages(live: DataFrame) -> DataFrame:
    """One message for each window of a line."""
    key = F.concat_ws("/", "survey_id", "line_id", "channel", "chunk_end")
    return live.filter("kind = 'window'").select(*envelope(CHUNK, key, C("at"), "survey_id", "line_id", "channel", "chunk_end", "n_boxes"))


def finding_messages(created: DataFrame, reasoned: DataFrame, patience: str = PATIENCE) -> DataFrame:
    """Streams of findings (finding_id, at, ...) and of reasoning (finding_id, reasoned_at, what) to one of messages.

    A finding is told at once. Its reasoning is told when it comes, if that is within `patience` of the finding, and else,
    once the watermarks of both streams are past that, it is told that there is none. Findings and reasoning that are
    delivered twice within `patience` are told once.
    """
    made = created.withWatermark("at", patience).dropDuplicatesWithinWatermark(["finding_id"])
    said = reasoned.select(C("finding_id").alias("said_of"), "reasoned_at", "what").withWatermark("reasoned_at", patience).dropDuplicatesWithinWatermark(["said_of"])
    in_time = (C("finding_id") == C("said_of")) & (C("reasoned_at") >= C("at")) & (C("reasoned_at") <= C("at") + F.expr(f"INTERVAL {patience}"))
    met = made.join(said, in_time, "left_outer")
    kind = F.when(C("said_of").isNotNull(), REASONED).otherwise(UNEXPLAINED)
    first = made.select(*envelope(CREATED, C("finding_id"), C("at"), *created.columns))
    return first.unionByName(met.select(*envelope(kind, C("finding_id"), F.coalesce("reasoned_at", "at"), "finding_id", "what")))


def shown(messages: DataFrame) -> DataFrame:
    """What a client shows of the messages so far: each finding with its reasoning, by id."""
    data = lambda kind, field: F.max(F.when(C("kind") == kind, F.get_json_object("value", f"$.data.{field}")))
    of = messages.filter(C("kind").isin(CREATED, REASONED, UNEXPLAINED)).groupBy("key")
    return of.agg(data(CREATED, "class_name").alias("class_name"), data(REASONED, "what").alias("what"), F.bool_or(C("kind") == UNEXPLAINED).alias("unexplained"))
