"""Exact quantiles per group without gathering a group in one place.

A bounded sketch brackets each wanted rank; only the values inside the bracket are counted
value by value. Groups whose size the caller has checked use the built-in aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col
SKETCH_ACCURACY = 2000  # the sketch's rank error is at most n / accuracy
BOUNDED_GROUP = 1_000_000


def group_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], group_rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles, one row per group. `group_rows`: a checked bound on a group's rows."""
    rows = rows.filter(C(value).isNotNull())
    if group_rows is not None and group_rows <= BOUNDED_GROUP:
        return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])
    if not keys:
        return group_quantiles(rows.withColumn("__all", F.lit(1)), ["__all"], value, probs).drop("__all")
    margin = 4.0 / SKETCH_ACCURACY  # four times the sketch's own error
    small = C("__n") < 2 * SKETCH_ACCURACY  # so few values that all of them are the bracket
    counted = rows.groupBy(*keys, C(value).alias("__v")).agg(F.count("*").alias("__c"))
    ends = [F.lit(max(0.0, min(1.0, p + s * margin))) for p in probs.values() for s in (-1, 1)]
    brackets = rows.groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*ends), F.lit(SKETCH_ACCURACY)).alias("__ends"),
        F.min(value).alias("__min"), F.max(value).alias("__max"), F.count("*").alias("__n"),
    )
    # One row per wanted quantile and group: its two neighbouring ranks and the bracket that holds them.
    wanted = brackets.select(
        *keys, "__n",
        F.explode(F.array(*[
            F.struct(
                F.lit(name).alias("name"), (C("__n") - 1).cast("double").alias("n1"), F.lit(float(p)).alias("p"),
                F.when(small | F.lit(p <= margin), C("__min")).otherwise(C("__ends")[2 * i]).alias("lo"),
                F.when(small | F.lit(p >= 1 - margin), C("__max")).otherwise(C("__ends")[2 * i + 1]).alias("hi"),
            ) for i, (name, p) in enumerate(probs.items())
        ])).alias("__w"),
    ).select(*keys, "__w.*")
    hit = counted.join(wanted, list(keys))
    by = [*keys, "name"]
    # How many values lie below the bracket is a plain sum; only the bracket's values are ranked.
    below = hit.groupBy(*by, "n1", "p").agg(F.sum(F.when(C("__v") < C("lo"), C("__c")).otherwise(0)).alias("__below"))
    inside = hit.filter((C("__v") >= C("lo")) & (C("__v") <= C("hi"))).select(*by, "__v", "__c")
    run = W.partitionBy(*by).orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = inside.withColumn("__upto", F.sum("__c").over(run)).join(below, by)
    rank = C("n1") * C("p")
    first, last = C("__below") + C("__upto") - C("__c"), C("__below") + C("__upto") - 1
    holds = lambda r: (r >= first) & (r <= last)
    picked = ranked.groupBy(*by).agg(
        F.max(F.when(holds(F.floor(rank)), C("__v"))).alias("__a"), F.max(F.when(holds(F.ceil(rank)), C("__v"))).alias("__b"),
        F.first(rank - F.floor(rank)).alias("__f"),
    )
    picked = picked.withColumn("__q", C("__a") + (C("__b") - C("__a")) * C("__f"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(C("name") == n, C("__q"))).alias(n) for n in probs])


def largest_group(rows: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group, from key columns alone: a cheap check before a bounded plan."""
    top = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)
