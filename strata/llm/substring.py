"""Substring removal: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is told by its 64-bit hash. Each batch sends a hash once, with its smallest document, and already knows which of
its other documents lose; each bucket of hashes then tells every batch whose smallest document is not the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from strata.llm import exchange
from strata.llm.text import PLAIN, covered, owners, slices, word_windows

WINDOW = 13
SENT_AT_ONCE = 2_000_000  # windows whose hashes are packed together
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", SPANS), ("kept", pa.string())])


def _losers(hashes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places sorted by hash and document, which of them begin a hash, and which have a smaller document before them."""
    by = np.lexsort((order, hashes))
    h, o = hashes[by], order[by]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    least = o[new][np.cumsum(new) - 1] if len(h) else o
    return by, new, o > least


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words covered by a `window`-word sequence that also starts in a document with a smaller doc_id are removed.

    Returns doc_id, n_words, removed (maximal word intervals, end excluded) and kept (remaining words joined by one
    space) for each row of `docs` (doc_id, text; other columns are ignored). Words are runs of anything but ASCII blanks.
    Null and empty texts have no words and keep "". A null doc_id counts as larger than all others. Rows of one doc_id
    are one document's: they are not smaller than each other, so repeated rows get equal answers. A text may be of any
    length; a text shorter than the window loses nothing. No rows give no rows.
    """
    rows = exchange.keyed(docs.select("doc_id", "text"))
    n = exchange.shares(docs)

    def told(hashes: list[np.ndarray], order: list[np.ndarray]) -> pa.RecordBatch:
        h, o = np.concatenate(hashes), np.concatenate(order)
        by, new, loses = _losers(h, o)
        keys, blobs = exchange.post(o[by[loses]], h[by[loses]], n)
        tell = [-1 - k for k in keys]
        h, o = h[by[new]], o[by[new]]
        for key, (some, their) in exchange.split_by(exchange.bucket_of(h, n), h, o):
            tell.append(key)
            blobs.append(exchange.two(some, their))
        return exchange.packed_batch(tell, blobs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order, held = [], [], 0
        for batch in batches:
            ids = np.asarray(batch["order_"])
            for part in slices(batch["text_"]):
                starts, ends, bounds = part.words(PLAIN)
                h, at = word_windows(part.word_hashes(starts, ends), bounds, window)
                hashes.append(h)
                order.append(ids[part.first + owners(bounds)[at]])
                held += len(h)
                if held > SENT_AT_ONCE:
                    yield told(hashes, order)
                    hashes, order, held = [], [], 0
        if held:
            yield told(hashes, order)

    def decide(blobs: pa.Table) -> pa.Table:
        if blobs["key"][0].as_py() < 0:  # an answer that its batch could give
            return exchange.table_of([-1 - k for k in blobs["key"].to_pylist()], blobs["data"].to_pylist())
        hashes, order = exchange.untwo_all(blobs)
        by, _, loses = _losers(hashes, order)
        return exchange.table_of(*exchange.post(order[by[loses]], hashes[by[loses]], n))

    def finish(frames: pa.Table, answers: pa.Table) -> pa.Table:
        lost, out = exchange.posted(answers), []
        for table in exchange.thawed(frames):
            ids, n_words, gone, kept = np.asarray(table["order_"]), [], [], []
            for part in slices(table["text_"]):
                starts, ends, bounds = part.words(PLAIN)
                hashes, at = word_windows(part.word_hashes(starts, ends), bounds, window)
                hit = exchange.among(exchange.pairs(ids[part.first + owners(bounds)[at]], hashes), lost)
                drop = covered(len(starts), at[hit], window)
                for row in range(part.rows):
                    a, b = bounds[row], bounds[row + 1]
                    words = part.text(row).split()
                    flags = drop[a:b]
                    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)) if flags.any() else ()
                    spans = [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])]
                    n_words.append(len(words))
                    gone.append(spans)
                    kept.append(b" ".join(compress(words, ~flags) if spans else words))
            id_ = table["row_"].combine_chunks().field("doc_id").cast(pa.int64())
            out.append(pa.table([id_, pa.array(n_words, pa.int64()), pa.array(gone, SPANS), pa.array(kept, pa.binary()).cast(pa.string())], schema=RESULT))
        return pa.concat_tables(out) if out else RESULT.empty_table()

    answers = exchange.meet(rows.mapInArrow(emit, exchange.PACKED), decide)
    return exchange.answer(rows, answers, n, finish, from_arrow_schema(RESULT))


def removal_digest(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeated_windows(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
