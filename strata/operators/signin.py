"""Sign-in analytics: failure counts in a sliding window, lock-outs, last logins, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata import params as P

C = F.col
NO_IP = "\x00none"  # a missing address equals a missing address


def one_name(events: DataFrame) -> DataFrame:
    """User names differ by more than case, so "Ann" and "ann" share one budget of failures."""
    return events.withColumn("username", F.lower("username"))


def failures_since(events: DataFrame, after: Column, until: Column) -> DataFrame:
    """Failed sign-ins per (name, address) and per name in a time span; unknown addresses group together."""
    failed = one_name(events).filter((C("event") == "login_failed") & (C("signed_at") > after) & (C("signed_at") <= until))
    pairs = failed.groupBy("username", "ip").agg(F.count("*").alias("pair_failures"))
    names = pairs.groupBy("username").agg(F.sum("pair_failures").alias("name_failures"))
    return pairs.join(names, "username").select("username", "ip", "pair_failures", "name_failures")


def accounts(events: DataFrame) -> DataFrame:
    return one_name(events).groupBy("username").agg(F.max(F.when(C("event") == "login", C("signed_at"))).alias("last_login"), F.count("*").alias("events"))


def history(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("signed_at"), F.desc("event_id")).limit(n)


def _count_before(events: DataFrame, keys: list[str], name: str, minutes: int) -> DataFrame:
    """Failures of the same keys in the window before each event, by minute tiles so hot keys spread.

    A tile holds one window's length of events plus a copy of the window before it.
    """
    seconds = minutes * 60
    at = F.unix_micros(C("signed_at").cast("timestamp"))
    span = seconds * 1_000_000
    tile = F.floor(at / span)
    both = events.withColumn("__at", at).withColumn("__tile", F.explode(F.array(tile, tile + 1)))
    window = W.partitionBy(*keys, "__tile").orderBy("__at").rangeBetween(-span, 0)
    failed = F.when(C("event") == "login_failed", 1).otherwise(0)
    counted = both.withColumn(name, F.sum(failed).over(window) - failed)
    return counted.filter(F.floor(C("__at") / span) == C("__tile")).drop("__at", "__tile")


def lockouts(events: DataFrame, minutes: int = P.LOCKOUT_WINDOW_MINUTES, pair: int = P.LOCKOUT_PAIR, name: int = P.LOCKOUT_NAME, address: int = P.LOCKOUT_IP) -> DataFrame:
    """For every attempt: the failures already in its window and whether a limit was reached."""
    e = one_name(events).withColumn("ip_key", F.coalesce("ip", F.lit(NO_IP)))
    e = _count_before(e, ["username", "ip_key"], "pair_failures", minutes)
    e = _count_before(e, ["username"], "name_failures", minutes)
    # Attempts without an address have no address to count, and would meet under one key.
    addressed = _count_before(e.filter(C("ip").isNotNull()), ["ip_key"], "ip_failures", minutes)
    e = addressed.unionByName(e.filter(C("ip").isNull()).withColumn("ip_failures", F.lit(0).cast("long")))
    locked = (C("pair_failures") >= pair) | (C("name_failures") >= name) | (C("ip").isNotNull() & (C("ip_failures") >= address))
    return e.withColumn("locked", locked).drop("ip_key")
