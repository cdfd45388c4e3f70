"""Sign-in failures on a stream: counts per minute step over the last fifteen minutes, and lock-outs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strata import params as P
from strata.operators.signin import NO_IP, one_name

C = F.col


def failure_windows(events: DataFrame, minutes: int = P.LOCKOUT_WINDOW_MINUTES, step: str = "1 minute") -> DataFrame:
    """Failures per (name, address) in sliding windows; late events count until the watermark passes."""
    failed = one_name(events).filter(C("event") == "login_failed").withColumn("ip_key", F.coalesce("ip", F.lit(NO_IP)))
    span = f"{minutes} minutes"
    counted = failed.withWatermark("signed_at", span).groupBy(F.window("signed_at", span, step).alias("w"), "username", "ip_key").agg(F.count("*").alias("failures"))
    return counted.select(C("w.start").alias("window_start"), C("w.end").alias("window_end"), "username", "ip_key", "failures", (C("failures") >= P.LOCKOUT_PAIR).alias("locked"))


class FailureCounts(StatefulProcessor):
    """Failures of one name, address or pair of them: a map of minutes, and attempts that wait for the watermark.

    An attempt is counted once no earlier one can come any more, so the order in which they arrive makes no difference.
    """

    def __init__(self, minutes: int) -> None:
        self.span = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", "at array<long>")
        self.waiting = handle.getListState("waiting", "at long, event_id long, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = [(int(a), int(e), bool(f)) for a, e, f in zip(pdf["at"], pdf["event_id"], pdf["failed"])]
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(a for a, _, _ in new) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] <= until], [r for r in waiting if r[0] > until]
        if not due:
            return
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        self.waiting.put(later) if later else self.waiting.clear()
        held = {k[0]: list(v[0]) for k, v in self.minutes.iterator()} if self.minutes.exists() else {}
        at, failed = np.array([a for a, _, _ in due], np.int64), np.array([f for _, _, f in due], bool)
        old = np.array([t for v in held.values() for t in v], np.int64)
        failures = np.sort(np.concatenate((old, at[failed])))
        # Later attempts lie behind the watermark, so only failures that they can still see are kept.
        seen = failures[failures >= until - self.span]
        cuts = np.flatnonzero(np.diff(seen // 60_000_000)) + 1
        keep = {int(part[0]) // 60_000_000: part.tolist() for part in np.split(seen, cuts)} if len(seen) else {}
        for minute in held.keys() - keep.keys():
            self.minutes.removeKey((minute,))
        for minute, times in keep.items():
            if held.get(minute) != times:
                self.minutes.updateValue((minute,), (times,))
        counts = np.searchsorted(failures, at, "right") - np.searchsorted(failures, at - self.span, "left") - failed
        out = [(key[0], event, int(n)) for (_, event, _), n in zip(due, counts)]
        yield pd.DataFrame(out, columns=["kind", "event_id", "failures"])

    def close(self) -> None:
        pass


def failure_counts(events: DataFrame, minutes: int = P.LOCKOUT_WINDOW_MINUTES, delay: str = "1 minute") -> DataFrame:
    """kind (pair, name, ip), event_id, failures: of every attempt of a stream, those already in its window under each limit.

    One stream of events feeds three kinds of keys. Events later than `delay` are left out. Needs the RocksDB state store.
    """
    e = one_name(events).withWatermark("signed_at", delay)
    keys = F.array(
        F.struct(F.lit("pair").alias("kind"), F.concat_ws("\x00", "username", F.coalesce("ip", F.lit(NO_IP))).alias("key")),
        F.struct(F.lit("name").alias("kind"), C("username").alias("key")), F.struct(F.lit("ip").alias("kind"), C("ip").alias("key")))
    each = e.select("signed_at", F.unix_micros("signed_at").alias("at"), "event_id", (C("event") == "login_failed").alias("failed"), F.explode(keys).alias("k"))
    keyed = each.filter("k.key IS NOT NULL").select("signed_at", "at", "event_id", "failed", "k.kind", "k.key")
    return keyed.groupBy("kind", "key").transformWithStateInPandas(
        statefulProcessor=FailureCounts(minutes), outputStructType="kind string, event_id long, failures long", outputMode="Append", timeMode="EventTime")


def decisions(counts: DataFrame, pair: int = P.LOCKOUT_PAIR, name: int = P.LOCKOUT_NAME, address: int = P.LOCKOUT_IP) -> DataFrame:
    """One row for each attempt of `failure_counts`, as the batch operator `lockouts` has it."""
    of = lambda kind: F.coalesce(F.max(F.when(C("kind") == kind, C("failures"))), F.lit(0)).alias(f"{kind}_failures")
    counted = counts.groupBy("event_id").agg(of("pair"), of("name"), of("ip"))
    return counted.withColumn("locked", (C("pair_failures") >= pair) | (C("name_failures") >= name) | (C("ip_failures") >= address))
