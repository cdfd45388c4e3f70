"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows (WINDOW consecutive words, or all words of a shorter item). A window is held
wholly by a text or not at all, so of its shingles one is necessary: the rarest, counted over the documents. Documents
are met with these prefix shingles; length and position bounds place the window around the shingle; exact containment is
verified word by word. Benchmark windows come in blocks of bounded size, each joined with all documents; the documents are
never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from strata.llm.exchange import among
from strata.llm.stage import stage
from strata.llm.text import ALNUM, U64, covered, owners, prefix_sums, ranges, slices, spans, word_windows

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 200_000  # of at most WINDOW eight-byte hashes: 16 MB for each block and task


def _words(part) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = part.words(ALNUM)
    return part.word_hashes(starts, ends), bounds


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(block, item, words): the distinct windows of each item as packed word hashes, dealt to blocks by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["text"], lower=True):
                hashes, bounds = _words(part)
                keys, at = word_windows(hashes, bounds, window, short=True)
                row = owners(bounds)[at]
                end = np.minimum(at + window, bounds[row + 1])
                words = [hashes[a:b].tobytes() for a, b in zip(at, end)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch["item_id"].take(pa.array(part.first + row)).cast(pa.string()), pa.array(words, pa.binary())], names=["hash", "item", "words"])

    return benchmark.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "hash long, item string, words binary").distinct()


class Block:
    """The windows of one block, ready to be looked up by their rarest shingle."""

    def __init__(self, words: list[bytes], items: list[list[str]]):
        self.items = items
        self.sizes = np.array([len(w) // 8 for w in words], np.int64)
        self.words = np.frombuffer(b"".join(words), U64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        # Every shingle of every window: SHINGLE words, or all words of a shorter window.
        length = np.minimum(self.sizes, SHINGLE)
        counts = self.sizes - length + 1
        self.shingle_window = np.repeat(np.arange(len(words)), counts)
        self.shingle_place = ranges(np.zeros(len(words), np.int64), counts)
        first = self.begin[self.shingle_window] + self.shingle_place
        self.shingle_size = length[self.shingle_window]
        self.shingles = spans(prefix_sums(self.words), first, first + self.shingle_size)
        self.known = np.unique(self.shingles)
        self.lengths = np.unique(length)

    def choose(self, often: np.ndarray) -> None:
        """Keep each window's rarest shingle, the prefix of its set; `often` counts `known` in the documents."""
        rank = often[np.searchsorted(self.known, self.shingles)]
        by = np.lexsort((self.shingle_place, rank, self.shingle_window))
        window = self.shingle_window[by]
        pick = by[np.concatenate(([True], window[1:] != window[:-1]))] if len(by) else by
        pick = pick[np.argsort(self.shingles[pick], kind="stable")]
        self.prefix, self.prefix_window, self.prefix_place = self.shingles[pick], self.shingle_window[pick], self.shingle_place[pick]
        self.prefix_known = np.unique(self.prefix)

    def document_shingles(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for length in self.lengths:
            yield word_windows(hashes, bounds, int(length))

    def found(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        starts, windows = [], []
        for keys, at in self.document_shingles(hashes, bounds):
            hit = np.flatnonzero(among(keys, self.prefix_known))
            low, high = np.searchsorted(self.prefix, keys[hit], "left"), np.searchsorted(self.prefix, keys[hit], "right")
            which = ranges(low, high - low)
            window = self.prefix_window[which]
            place = np.repeat(at[hit], high - low)
            row = np.searchsorted(bounds, place, "right") - 1
            first = place - self.prefix_place[which]
            fits = (first >= bounds[row]) & (first + self.sizes[window] <= bounds[row + 1])
            first, window = first[fits], window[fits]
            same = np.ones(len(first), bool)
            for k in range(int(self.sizes.max(initial=0))):
                live = np.flatnonzero(same & (self.sizes[window] > k))
                same[live] = hashes[first[live] + k] == self.words[self.begin[window[live]] + k]
            starts.append(first[same])
            windows.append(window[same])
        start, window = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, windows))
        return start, window


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Block]:
    windows = stage(benchmark_windows(benchmark, window))
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    grouped = windows.groupBy("hash", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    for b in range(blocks):
        rows = grouped.filter(F.pmod(F.col("hash"), F.lit(blocks)) == b).select("words", "items").toArrow()
        if rows.num_rows:
            yield Block(rows["words"].to_pylist(), rows["items"].to_pylist())


def _shingle_counts(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each of the block's shingles stands in the documents."""
    known, lengths = block.known, block.document_shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in slices(batch["text"], lower=True):
                for keys, _ in lengths(*_words(part)):
                    total += np.bincount(np.searchsorted(known, keys[among(keys, known)]), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["shingle", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(len(known), np.int64)
    often[np.asarray(rows["shingle"])] = np.asarray(rows["n"])
    return often


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of `docs` and n_words, hits (maximal word intervals, end excluded) and items (ids found, sorted as strings).

    Texts are lower-cased (A-Z); words are runs of letters a-z, digits and all beyond ASCII. A window is `window` consecutive
    words of an item (item_id, text), or all words of an item that has fewer, but some; words of a document inside any
    occurrence of a window are hit. Null and empty texts have no words and no windows. An item without id marks words but is
    not listed; repeated items are one, and one id with several texts has the windows of all. A column of `docs` named
    like a result is replaced. An empty benchmark hits nothing; no rows give no rows.
    """
    named = docs.select([f"`{c}`" for c in docs.columns if c not in ("n_words", "hits", "items")])
    spans_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([*to_arrow_schema(named.schema), ("n_words", pa.int64()), ("hits", spans_), ("items", pa.list_(pa.string()))])
    empty = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start: long, end: long>>").alias("hits"), F.array().cast("array<string>").alias("items")]
    now = named.select("*", *empty)
    several = False
    for block in _blocks(benchmark, window):
        if several:
            now = stage(now)  # one block at a time, in memory as in the plan
        block.choose(_shingle_counts(docs, block))
        now = now.mapInArrow(_marker(block, schema), from_arrow_schema(schema))
        several = True
    return now


def _marker(block: Block, schema: pa.Schema):
    """Adds the block's hits and items to those that a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hits, items = [], [], []
            old = list(zip(batch["hits"].to_pylist(), batch["items"].to_pylist()))
            for part in slices(batch["text"], lower=True):
                hashes, bounds = _words(part)
                first, which = block.found(hashes, bounds)
                hit = np.zeros(len(hashes), bool)
                for size in np.unique(block.sizes[which]):
                    hit |= covered(len(hashes), first[block.sizes[which] == size], int(size))
                row = np.searchsorted(bounds, first, "right") - 1
                listed: dict[int, set] = {}
                for r, w in set(zip(row.tolist(), which.tolist())):
                    listed.setdefault(r, set()).update(i for i in block.items[w] if i is not None)
                for r in range(part.rows):
                    before, names = old[part.first + r]
                    flags = hit[bounds[r] : bounds[r + 1]]
                    for s in before:
                        flags[s["start"] : s["end"]] = True
                    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)) if flags.any() else ()
                    hits.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
                    items.append(sorted(listed.get(r, set()).union(names)))
                n_words.extend(np.diff(bounds).tolist())
            new = {"n_words": n_words, "hits": hits, "items": items}
            columns = [pa.array(new[f.name], f.type) if f.name in new else batch[f.name].cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark; cases are those of `contamination`."""
    return contamination(docs, benchmark).filter(F.size("hits") == 0).select([f"`{c}`" for c in docs.columns])
