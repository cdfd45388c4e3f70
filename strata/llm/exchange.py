"""Window hashes of a corpus meet in Spark, and what they say goes back to the documents.

Three shuffles: packed hashes by bucket of the hash, answers by chunk of the document id, and compressed documents by
chunk. Buckets and chunks are so many that each holds a bounded share of the input; equal hashes of one batch travel
once, so a window that every document has is one entry for each batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.text import U64, mix, pack, unpack

LAST_ID = (1 << 63) - 1  # stands for a null id: larger than any other
SHARE_BYTES = 12 << 20  # of text, for each bucket and each chunk
PACKED = "key int, data binary"


def shares(docs: DataFrame, text: str = "text") -> int:
    """How many buckets and chunks: one for each SHARE_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4, math.ceil(total / SHARE_BYTES))


def keyed(docs: DataFrame) -> DataFrame:
    """(order_, text_, row_): the id with null last, the text as bytes, and all columns but the text as they are."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("order_"), F.col("text").cast("binary").alias("text_"), F.struct(*rest).alias("row_"))


def chunk_of(order: np.ndarray, chunks: int) -> np.ndarray:
    """Chunk of a document, by a hash of its id."""
    return (mix(order.astype(U64)) % U64(chunks)).astype(np.int64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Range bucket of a 64-bit hash by its upper half, so that sorted hashes stay sorted."""
    return (((hashes >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def split_by(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of equal keys, in key order, the order inside a run kept."""
    if not len(keys):
        return
    by = np.argsort(keys, kind="stable")
    for rows in np.split(by, np.flatnonzero(np.diff(keys[by])) + 1):
        yield int(keys[rows[0]]), [c[rows] for c in columns]


def packed_batch(keys: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["key", "data"])


def table_of(keys: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.Table.from_batches([packed_batch(keys, blobs)])


def frozen(rows: DataFrame, chunks: int) -> DataFrame:
    """(key, data): keyed rows as compressed Arrow frames, one for each chunk and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        option = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            keys, frames = [], []
            for key, (at,) in split_by(chunk_of(np.asarray(batch["order_"]), chunks), np.arange(batch.num_rows)):
                rows_ = batch.take(pa.array(at))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows_.schema, options=option) as out:
                    out.write_batch(rows_)
                keys.append(key)
                frames.append(sink.getvalue().to_pybytes())
            yield packed_batch(keys, frames)

    return rows.mapInArrow(run, PACKED)


def thawed(frames: pa.Table) -> Iterator[pa.Table]:
    for frame in frames["data"]:
        yield pa.ipc.open_stream(frame.as_buffer()).read_all()


def meet(blobs: DataFrame, reduce: Callable[[pa.Table], pa.Table], schema: str = PACKED) -> DataFrame:
    """Answers of all blobs with the same key."""
    return blobs.groupBy("key").applyInArrow(reduce, schema)


def answer(rows: DataFrame, answers: DataFrame, chunks: int, finish: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Keyed rows of a chunk with the answers for that chunk."""
    return frozen(rows, chunks).groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(finish, schema)


def two(hashes: np.ndarray, order: np.ndarray) -> bytes:
    """Hashes in ascending order with their documents."""
    by = np.argsort(hashes, kind="stable")
    first = pack(hashes[by], ascending=True)
    return len(first).to_bytes(4, "little") + first + pack(order[by].astype(np.int64))


def untwo(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = 4 + int.from_bytes(blob[:4], "little")
    return unpack(blob[4:n], U64, ascending=True), unpack(blob[n:], np.int64)


def untwo_all(blobs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [untwo(b) for b in blobs["data"].to_pylist()]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))


def join_parts(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def pairs(order: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for a document and a hash in it."""
    return mix(order.astype(U64)) ^ hashes


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def post(order: np.ndarray, hashes: np.ndarray, chunks: int) -> tuple[list[int], list[bytes]]:
    """Answers (document, hash) as one blob for each chunk."""
    keys, blobs = [], []
    for key, (o, h) in split_by(chunk_of(order, chunks), order, hashes):
        keys.append(key)
        blobs.append(two(h, o))
    return keys, blobs


def posted(answers: pa.Table) -> np.ndarray:
    """All (document, hash) answers of a chunk as ordered numbers."""
    hashes, order = untwo_all(answers)
    return np.unique(pairs(order, hashes))
