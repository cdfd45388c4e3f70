"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors (hashed to BUCKETS): of its words, of the distances to each word's last
occurrence, and of its byte n-grams, each kind averaged by itself first; a softmax layer on top gives the label. The model is trained by numpy stochastic gradient descent on a sample of labelled rows that
is bounded by SAMPLE; scoring reads every text. As the softmax of an average of vectors only needs the difference of two
scores, each bucket's vector is projected to one number before scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from strata.llm.memory import give_back
from strata.llm.stage import stage
from strata.llm.text import BYTE_VALUES, PLAIN, U64, owners, prefix_sums, slices, spans

BUCKETS = 1 << 15
NGRAMS = (2, 3, 4)
SIZE = 8
SAMPLE = 2000  # labelled rows at most that the model is fitted on: those with the smallest hashes of their ids
EPOCHS = 8
RATE = 0.1
FEATURE_BYTES = 1 << 18  # of text whose features are held at once: some hundred bytes for each of them


def _features(part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of a slice, one kind after the other: words, how far back each word stood last, byte n-grams."""
    sums = prefix_sums(BYTE_VALUES[part.data])
    starts, ends, bounds = part.words(PLAIN)
    words, owner = spans(sums, starts, ends), owners(bounds)
    yield owner, (words >> U64(49)).astype(np.int32)
    by = np.lexsort((words, owner))
    again = (words[by[1:]] == words[by[:-1]]) & (owner[by[1:]] == owner[by[:-1]])
    gap = np.where(again, np.ceil(np.log2(np.maximum(by[1:] - by[:-1], 1))).astype(np.int32) + 1, 0)
    yield owner[by], np.concatenate((np.zeros(min(len(by), 1), np.int32), gap.astype(np.int32)))
    row = np.repeat(np.arange(part.rows), np.diff(part.offsets))
    at = np.arange(len(part.data))
    for n in NGRAMS:
        inside = at[: max(len(at) - n + 1, 0)]
        inside = inside[row[inside] == row[inside + n - 1]]
        yield row[inside], ((spans(sums, inside, inside + n) + U64(n)) >> U64(49)).astype(np.int32)


KINDS = 2 + len(NGRAMS)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(text, label) of rows that may be learned from, at most `sample`, by a hash of their id; of rows with one id that with the least text."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    ids = docs.filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("copies")).join(known, "doc_id")
    chosen = stage(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # `sample` ids at most, so every task can have them
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    once = rows.filter("copies = 1").select("doc_id", "text", "y")
    if chosen.filter("copies > 1").isEmpty():
        return once
    several = rows.filter("copies > 1").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))
    return once.unionByName(several)


def held_out():
    """Rows the model never learns from: crc32 of the id as text leaves 1 by 3; rows without id too."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def bags(rows: DataFrame) -> DataFrame:
    """(doc_id, y, ids, shares): the distinct buckets of each document and their shares of its average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages have left with this worker
        for batch in batches:
            for part in slices(batch["text"], most=FEATURE_BYTES):
                keys, weights = [], []
                for row, bucket in _features(part):
                    keys.append(row.astype(np.int64) * BUCKETS + bucket)
                    weights.append((1 / KINDS / np.maximum(np.bincount(row, minlength=part.rows), 1))[row])
                key, index = np.unique(np.concatenate(keys), return_inverse=True)
                share = np.bincount(index, np.concatenate(weights), len(key)).astype(np.float32)
                cut = np.searchsorted(key // BUCKETS, np.arange(1, part.rows))
                ids = [x.astype(np.int32).tobytes() for x in np.split(key % BUCKETS, cut)]
                n = [x.tobytes() for x in np.split(share, cut)]
                where = slice(part.first, part.first + part.rows)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][where].cast(pa.int64()), batch["y"][where], pa.array(ids, pa.binary()), pa.array(n, pa.binary())], names=["doc_id", "y", "ids", "shares"])

    return rows.mapInArrow(run, "doc_id long, y int, ids binary, shares binary")


class Model:
    """A number for each bucket and a bias: log odds of label 1 are the bias plus the average number of a document."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, part) -> np.ndarray:
        total = np.zeros(part.rows)
        for row, bucket in _features(part):
            total += np.bincount(row, self.weights[bucket], part.rows) / np.maximum(np.bincount(row, minlength=part.rows), 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / KINDS, -40, 40)))


def train(table: pa.Table) -> Model:
    """Stochastic gradient descent on bags of the sample; classes weigh alike. Without both labels, a constant."""
    # In the order of ids and bags, whatever order they came in; the bags stay in Arrow's memory.
    ids, shares = table["ids"].combine_chunks(), table["shares"].combine_chunks()
    by = np.lexsort((np.asarray(table["y"]), np.asarray(table["doc_id"]))) if table.num_rows else np.zeros(0, np.int64)
    y = np.asarray(table["y"])[by].astype(np.int64)
    share = y.mean() if len(y) else 0.5
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS), 40.0 * (2 * share - 1))
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    out, bias = np.zeros((2, SIZE)), np.zeros(2)
    class_weight = 0.5 / np.array([1 - share, share])
    texts = [(np.frombuffer(ids[int(i)].as_buffer(), np.int32), np.frombuffer(shares[int(i)].as_buffer(), np.float32)) for i in by]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(texts)):
            kinds, part = texts[k]
            mean = part @ vectors[kinds]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= rate * class_weight[y[k]]
            back = p @ out
            out -= np.outer(p, mean)
            bias -= p
            # Buckets move by their share of the average, scaled so that the average itself moves by one step.
            vectors[kinds] -= np.outer(part / max(part @ part, 1e-12), back)
    return Model(vectors @ (out[1] - out[0]), bias[1] - bias[0])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The columns of `docs` and held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    The model learns `labels` (doc_id, label 0 or 1) of rows that are not held out, at most `sample` of them, one for each id,
    and sees only text. Labels that are null or neither 0 nor 1 are left out; of several for one id the largest counts. Null and
    empty texts get the score of the bias alone. Without a labelled row of both kinds the score is a constant. Rows without
    id are held out, repeated rows score alike, and a column of `docs` with a result's name is replaced. Texts of any
    length are read whole, about FEATURE_BYTES at a time. No rows give no rows.
    """
    named = docs.select([f"`{c}`" for c in docs.columns if c not in ("held_out", "score", "predicted")])
    model = train(bags(labelled_sample(docs, labels, label, sample)).toArrow())
    give_back()  # what training has held on the driver
    schema = pa.schema([*to_arrow_schema(named.schema), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages have left with this worker
        for batch in batches:
            score = [model.scores(part) for part in slices(batch["text"], most=FEATURE_BYTES)]
            columns = [batch[f.name].cast(f.type) for f in schema if f.name != "score"] + [pa.array(np.concatenate(score) if score else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    scored = named.mapInArrow(run, from_arrow_schema(schema))
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def without_rejects(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject; cases are those of `quality_scores`."""
    return quality_scores(docs, labels).filter("predicted = 1").select([f"`{c}`" for c in docs.columns])
