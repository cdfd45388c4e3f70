"""Hard-negative mining: positives by top-k inner products, negatives by inner products inside bands of the positives'.

Rows are cut into buckets of similar length; a bucket holds, for each coordinate, its rows sorted by the direction's
value there. An ask is an anchor with bands of scores, each with a number of rows wanted. A band and the lengths in a bucket
bound the angle to the anchor, and the angle bounds the values that a row can have at the anchor's largest coordinates,
its focus. The ranges of the sorted lists are intersected, and what is in all of them is scored exactly. A band's lower
end rises to the last of its best rows so far: first those of the anchor's own bucket, which sets a start, then those
of every bucket that the raised ends leave.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.exchange import LAST_ID
from strata.llm.stage import stage

C = F.col
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
BUCKET_VALUES = 500_000  # parts of vectors in a length bucket: 4 MB for each of its arrays
BLOCK_VALUES = 200_000  # parts of anchors that meet a bucket in one call
FOCUS = 3  # coordinates of an anchor whose lists are cut
ROOM = 1e-9  # by which computed angles are widened, so that rounding loses nothing
KEYS = ("bucket", "block", "size")
FOUND = "ask long, band int, score long, order_ long, row long"


def prepared(vectors: DataFrame) -> DataFrame:
    """row, order_, label, anchor, size, parts, length of the rows that take part; parts are whole numbers as doubles."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * SCALE)
    whole = vectors.select("vec_id", C("label").cast("long").alias("label"), scaled.alias("x")).filter(
        C("label").isNotNull() & C("x").isNotNull() & F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    )
    parts = F.transform("x", lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v))
    rows = whole.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(C("vec_id").cast("long"), F.lit(LAST_ID)).alias("order_"),
        F.when(C("vec_id") % 7 == 0, (C("label") + 1) % 10).otherwise(C("label")).alias("label"),
        F.coalesce(C("vec_id") % 50 == 0, F.lit(False)).alias("anchor"), F.size("x").alias("size"), parts.alias("parts"),
    )
    return rows.withColumn("length", F.sqrt(F.aggregate("parts", F.lit(0.0), lambda s, v: s + v * v)))


def bucketed(rows: DataFrame, values: int = BUCKET_VALUES) -> DataFrame:
    """The rows with `bucket`: ranges of (size, length); equal lengths are parted by row, so that none grows."""
    total = rows.agg(F.sum(C("size").cast("long") + 1)).first()[0] or 0
    ranges = rows.repartitionByRange(max(1, math.ceil(total / values)), "size", "length", F.xxhash64("row"))
    return stage(ranges.withColumn("bucket", F.spark_partition_id()))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).astype(np.float64).reshape(rows, -1) if rows and len(flat.flatten()) else np.zeros((rows, 0))


class Bucket:
    """Rows of one bucket and size, with a sorted list of each coordinate."""

    def __init__(self, rows: np.ndarray, order: np.ndarray, label: np.ndarray, parts: np.ndarray):
        self.rows, self.order, self.label, self.parts = rows, order, label, parts
        self.length = np.sqrt((parts * parts).sum(1))
        self.most, self.least = self.length.max(), self.length.min()
        angle = np.arccos(np.clip(parts / np.where(self.length, self.length, 1)[:, None], -1, 1))
        self.by = np.argsort(angle, axis=0, kind="stable")
        self.angle = np.take_along_axis(angle, self.by, axis=0)
        self.place = np.empty_like(self.by)
        np.put_along_axis(self.place, self.by, np.arange(len(rows))[:, None], axis=0)

    def near(self, anchor: np.ndarray, low: float, high: float, focus: int) -> np.ndarray:
        """Rows that may have an inner product with the anchor from low to high: all such are among them."""
        length = math.sqrt(float(anchor @ anchor))
        if not length or not self.least:
            return np.arange(len(self.rows))
        cos_low = min(low / (length * x) for x in (self.least, self.most)) - ROOM
        cos_high = max(high / (length * x) for x in (self.least, self.most)) + ROOM
        if cos_low > 1 or cos_high < -1:
            return np.zeros(0, np.int64)
        widest, least = math.acos(max(cos_low, -1.0)) + 1e-7, math.acos(min(cos_high, 1.0)) - 1e-7
        ranges = []
        for f in np.argsort(-np.abs(anchor), kind="stable")[:focus]:
            own = math.acos(max(-1.0, min(1.0, anchor[f] / length)))
            first, last = max(own - widest, least - own), min(own + widest, 2 * math.pi - least - own)
            ranges.append((f, int(np.searchsorted(self.angle[:, f], first, "left")), int(np.searchsorted(self.angle[:, f], last, "right"))))
        ranges.sort(key=lambda r: r[2] - r[1])
        f, a, b = ranges[0]
        rows = self.by[a:b, f]
        for f, a, b in ranges[1:]:
            place = self.place[rows, f]
            rows = rows[(place >= a) & (place < b)]
        return rows

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; in Python's whole numbers, held to 64 bits, where doubles could round."""
        if self.most * math.sqrt(float(anchor @ anchor)) < 2**52:
            return (self.parts[rows] @ anchor).astype(np.int64)
        whole = [int(v) for v in anchor]
        exact = (sum(int(x) * y for x, y in zip(r, whole)) for r in self.parts[rows].tolist())
        return np.array([max(-(2**63), min(2**63 - 1, s)) for s in exact], np.int64)


def _best(bucket: Bucket, ask: dict, wanted: int, focus: int) -> list[tuple]:
    """(band, score, order, row) of each band's best rows of the bucket."""
    low, high = min(b["low"] for b in ask["bands"]), max(b["high"] for b in ask["bands"])
    anchor = ask["parts"]
    rows = bucket.near(anchor, low, high, focus)
    rows = rows[((bucket.label[rows] == ask["label"]) == ask["same"]) & (bucket.rows[rows] != ask["row"])]
    if not len(rows):
        return []
    scores = bucket.scores(anchor, rows)
    by = np.lexsort((bucket.order[rows], -scores))
    rows, scores = rows[by], scores[by]
    out = []
    for b in ask["bands"]:
        inside = np.flatnonzero((scores >= b["low"]) & (scores <= b["high"]))[:wanted]
        out += [(b["band"], int(scores[i]), int(bucket.order[rows[i]]), int(bucket.rows[rows[i]])) for i in inside]
    return out


def _search(rows: DataFrame, asks: DataFrame, wanted: int, focus: int) -> DataFrame:
    """Best rows of each ask's bands in the bucket that the ask names; a block of asks meets a bucket in one call."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and asked.num_rows:
            mine = Bucket(*(np.asarray(table[c]) for c in ("row", "order_", "label")), _matrix(table["parts"], table.num_rows))
            parts = _matrix(asked["parts"], asked.num_rows)
            names = ("ask", "label", "same", "bands")
            for anchor, (ask, label, same, bands) in zip(parts, zip(*(asked[c].to_pylist() for c in names))):
                found += [(ask, *x) for x in _best(mine, {"row": ask, "label": label, "same": same, "bands": bands, "parts": anchor}, wanted, focus)]
        columns = zip(*found) if found else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["ask", "band", "score", "order_", "row"])

    asks = asks.toDF(*asks.columns)  # columns of its own, also where both sides come from one table
    pairs = asks.select(*KEYS).distinct()
    left = rows.select("bucket", "size", "row", "order_", "label", "parts").join(pairs, ["bucket", "size"])
    return left.toDF(*left.columns).groupBy(*KEYS).cogroup(asks.groupBy(*KEYS)).applyInArrow(run, FOUND)


def _top(found: DataFrame, wanted: int) -> DataFrame:
    """The best of each band, with `rank`."""
    order = Window.partitionBy("ask", "band").orderBy(C("score").desc(), "order_", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(C("rank") <= wanted)


def _answered(rows: DataFrame, asks: DataFrame, wanted: int, focus: int) -> DataFrame:
    """ask, band, rank, score, order_, row: each band's best of all rows for asks (ask, bucket, size, length, label, same, parts, bands)."""
    total = asks.agg(F.sum(C("size").cast("long") + 1)).first()[0] or 0
    asks = asks.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(max(1, math.ceil(total / BLOCK_VALUES)))).cast("int"))
    least = _top(_search(rows, asks, wanted, focus), wanted).filter(C("rank") == wanted).select("ask", "band", C("score").cast("double").alias("least"))
    each = asks.select("ask", F.explode("bands").alias("b")).select("ask", "b.*").join(least, ["ask", "band"], "left")
    bands = each.groupBy("ask").agg(F.collect_list(F.struct("band", F.greatest("low", "least").alias("low"), "high")).alias("bands"))
    asks = stage(asks.drop("bands", "bucket").join(bands, "ask"))
    lowest = F.array_min(F.transform("bands", lambda b: b["low"]))
    reach = asks.groupBy("block", "size").agg(F.min(F.when(C("length") > 0, lowest / C("length")).otherwise(F.lit(float("-inf")))).alias("reach"))
    buckets = rows.groupBy("bucket", "size").agg(F.max("length").alias("most"))
    pairs = buckets.join(reach, "size").filter(C("most") * (1 + ROOM) >= C("reach") * (1 - ROOM)).select(*KEYS)
    return _top(_search(rows, asks.join(pairs, ["block", "size"]), wanted, focus), wanted)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, focus: int = FOCUS, values: int = BUCKET_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from `vectors` (vec_id, embedding, label).

    Rows with a null label, a null vector, or a component that is null, not finite, or not finite times 256 take no part.
    Where 7 divides vec_id the label moves on by one (of ten). Scores are inner products of floor(256 * component), larger
    first, ties by vec_id with null last. Anchors are the rows whose vec_id 50 divides; each has its best `positives` other
    rows of its label, and each positive the best `negatives` rows of other labels that score from `low` to `high` percent
    of it, all if fewer. Vectors meet only vectors of their own length; empty ones score 0. Repeated rows are rows of their
    own, so a repeated anchor comes back as often. Scores beyond 64 bits are held to their ends. Other columns are ignored.
    No rows give no rows.
    """
    rows = bucketed(prepared(vectors.select("vec_id", "embedding", "label")), values)
    anchors = rows.filter("anchor").select(C("row").alias("ask"), "bucket", "size", "length", "label", "parts", C("order_").alias("anchor_id"))
    band = lambda number, low_, high_: F.struct(number.cast("int").alias("band"), low_.cast("double").alias("low"), high_.cast("double").alias("high"))
    all_ = F.array(band(F.lit(0), F.lit(float("-inf")), F.lit(float("inf"))))
    found = stage(_answered(rows, anchors.drop("anchor_id").select("*", F.lit(True).alias("same"), all_.alias("bands")), positives, focus))
    percent = lambda p: C("score").cast("decimal(20,0)") * p / 100
    bands = found.filter("score >= 0").groupBy("ask").agg(F.collect_list(band(C("rank"), F.ceil(percent(low)), F.floor(percent(high)))).alias("bands"))
    asks = anchors.drop("anchor_id").join(bands, "ask").withColumn("same", F.lit(False))
    mined = _answered(rows, asks, negatives, focus).select("ask", "band", "rank", C("order_").alias("negative_id"), C("score").alias("negative_score"))
    chosen = found.select("ask", C("rank").alias("band"), C("order_").alias("positive_id"), C("score").alias("positive_score"))
    id_ = lambda c: F.nullif(c, F.lit(LAST_ID)).alias(c)
    out = mined.join(chosen, ["ask", "band"]).join(anchors.select("ask", "anchor_id"), "ask")
    return out.select("anchor_id", id_("positive_id"), "rank", id_("negative_id"), "positive_score", "negative_score")
