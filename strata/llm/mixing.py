"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Each source has a target of words: its weight's share of all sizes, at most CAP times its own size, with the excess
reshared by weight. Its documents form a stream in the order of a hash, repeated until the target is met. Each
source also has a schedule: a rate over training time 0 to 1, given at knots and linear between them. The integral of the
schedule is the source's cumulative demand; the place of a document in its source's stream, inverted through it, is its
position in training. The result is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.stage import stage

C = F.col
WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
#: Rates at times 0, 1/2 and 1 by weight: light sources early, heavy ones late.
SCHEDULES = {1.0: (1.5, 1.0, 0.5), 2.0: (1.0, 1.0, 1.0), 3.0: (0.5, 1.0, 1.5)}
BLOCK_ROWS = 20_000  # documents of one source whose offsets are summed together


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target): shares by weight, no source above `cap` times its size.

    Sources go by code point, null last, and take the weights in turn. With t the level where min(cap * size, t * weight)
    sums to all sizes, sources capped at a lower level come first in the order of cap * size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(C("source").asc_nulls_last())  # one row for each source
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    level = (C("source_size") * cap / C("weight")).alias("level")
    before = Window.orderBy("level", C("source").asc_nulls_last())
    all_ = Window.partitionBy()
    ranked = per.withColumn("level", level).select(
        "*", F.sum("source_size").over(all_).alias("total"), F.sum("weight").over(all_).alias("weights"),
        F.coalesce(F.sum(C("source_size") * cap).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("spent"),
    )
    fill = (C("total") - C("capped")) / (C("weights") - C("spent"))
    open_level = F.max(F.when(C("level") >= fill, fill)).over(all_)  # the first in order: later ones are smaller
    return ranked.withColumn("open", open_level).select(
        "source", "source_size", "weight", F.when(C("level") <= C("open"), C("source_size") * float(cap)).otherwise(C("open") * C("weight")).alias("target")
    )


def _segments(schedule: tuple[float, ...]) -> Column:
    """The linear pieces of a schedule with their area before, scaled so that all areas sum to 1."""
    step = 1 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    out, total, before = [], sum(areas), 0.0
    for i, area in enumerate(areas):
        out.append(F.struct(F.lit(i * step).alias("t"), F.lit(step).alias("dt"), F.lit(schedule[i] / total).alias("r0"), F.lit(schedule[i + 1] / total).alias("r1"), F.lit(before / total).alias("area")))
        before += area
    return F.array(*out)


def _invert(u: Column, pieces: Column) -> Column:
    """The time by which the share u of the demand has come: a linear rate makes a quadratic area."""
    piece = F.element_at(F.filter(pieces, lambda p: p["area"] <= u), -1)
    rest = u - piece["area"]
    slope = (piece["r1"] - piece["r0"]) / piece["dt"]
    root = F.sqrt(F.greatest(piece["r0"] * piece["r0"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(piece["t"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (piece["r0"] + root)), F.lit(1.0))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, schedules: dict[float, tuple[float, ...]] | None = None, seed: int = 11) -> DataFrame:
    """The columns of `docs` and size, source_size, target, taken, positions, position, sorted by position.

    size is the number of words of the text (null: 0). A document stands in its source's stream once for each begun pass;
    taken is how many of its words the mix takes over all passes, where the last document of a source may be taken in part, so
    that a source's words sum to its target, rounded down. positions has one time in 0 to 1 for each taken copy, position the
    first, null if none is. Documents without words are never taken. A null source is a source, last in order. The order of a
    source is by hash of the id and text: reruns agree, and repeated rows stand side by side. A column of `docs` with
    a result's name is replaced. Rows without any source or words, or no rows, give the same columns, with target 0.0.
    """
    schedules = SCHEDULES if schedules is None else schedules
    made = ("size", "source_size", "target", "taken", "positions", "position")
    named = docs.select([f"`{c}`" for c in docs.columns if c not in made])
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(C("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    sized = named.select(*[f"`{c}`" for c in named.columns], n_words(C("text")).alias("size"), order.alias("order_"))
    slim = stage(sized.select("source", "size", "order_"))
    targets = stage(source_targets(slim, weights, cap))
    blocks = max(1, -(-slim.count() // BLOCK_ROWS))
    block = F.floor(F.conv(F.substring("order_", 1, 8), 16, 10).cast("double") / 2.0**32 * blocks).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    per_block = slim.groupBy(key.alias("key_"), block.alias("block_")).agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("key_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    offsets = per_block.select("key_", "block_", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead_"))
    inside = Window.partitionBy("key_", "block_").orderBy("order_", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets.select(key.alias("key_"), "source_size", "target", "weight")
    placed = (
        sized.withColumn("key_", key).withColumn("block_", block)
        .withColumn("inside_", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["key_", "block_"]).join(goal, "key_")
    )
    begin = C("ahead_") + C("inside_")
    limit = F.floor("target")
    pieces = F.coalesce(*[F.when(C("weight") == w, _segments(s)) for w, s in schedules.items()], _segments((1.0, 1.0)))
    part = lambda p: F.greatest(F.least(limit - begin - p * C("source_size"), C("size")), F.lit(0))
    taken = sum((part(F.lit(p)) for p in range(cap)), F.lit(0)).cast("long")
    passes = F.filter(F.array(*[F.lit(p) for p in range(cap)]), lambda p: (part(p) > 0))
    times = F.transform(passes, lambda p: _invert((begin + p * C("source_size")) / C("target"), pieces))
    out = placed.withColumn("taken", taken).withColumn("positions", times).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return out.orderBy(C("position").asc_nulls_last(), "order_").select(*[f"`{c}`" for c in named.columns], *made)


def mixing_digest(docs: DataFrame) -> DataFrame:
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
