"""Ranked lexical search over K2-treaps.

Documents are dealt to blocks of bounded text. A block's grid has a row for each term and a column for each document; a
cell holds the impact of the term in the document. The grid is a compressed quadtree: a level has four bits for each
non-empty cell of the level above, in Z-order, and for each non-empty cell the largest impact inside it, kept as the
difference to its parent's. A search starts with one range of documents, all of the block, and for each of the item's
terms the quadtree cell that holds the term's row; ranges are halved best first by the sum of their cells' maxima, weighted
by term, until single documents are left whose sums are scores. Ranges that can't reach the item's best are dropped.

Spark counts documents and terms, builds the blocks, sums document frequencies of the items' terms over the blocks'
dictionaries, joins blocks with parts of the items, and takes each item's best over all blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import exchange
from strata.llm.stage import stage
from strata.llm.text import U64, Slice, owners, pack, slices, unpack

C = F.col
TOP = 50
BLOCK_BYTES = 12 << 20  # of text in a block; a longer document is a block of its own
GROUP_BLOCKS = 3  # on average, that meet a part of the items in one call
PART_TERMS = 50_000  # of items, in such a part
WIDTH = 256  # ranges of documents that are halved together
SCALE, K1 = 1_000_000_000, 1000  # of the impact: SCALE * tf div (K1 * tf + 20 * m)
LETTERS = np.ones(256, bool)  # a term's bytes, of lower-cased text
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    LETTERS[_low : _high + 1] = False
INDEX = "block long, documents long, ids binary, terms binary, often binary, tree binary"


class Treap:
    """A compressed quadtree of maxima over a square grid of 2**height rows and columns."""

    def __init__(self, height: int, bits: list[np.ndarray], maxima: list[np.ndarray]):
        """bits[k], maxima[k]: of level k, of which 0 is the whole grid; bits[k] says which children of its cells are on level k + 1."""
        self.height, self.bits, self.maxima = height, bits, maxima
        self.child = [np.where(b, np.cumsum(b, dtype=np.int32) - np.int32(1), np.int32(-1)) for b in bits]

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> Treap:
        """From its filled cells, each named once."""
        code = _spread(rows.astype(U64)) << U64(1) | _spread(columns.astype(U64))
        by = np.argsort(code)
        code, top = code[by], values[by].astype(np.int32)
        bits, maxima = [], [top]
        for _ in range(height):
            parent = code >> U64(2)
            first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1]))) if len(code) else np.zeros(0, np.int64)
            which = np.zeros(4 * len(first), bool)
            cell = np.zeros(len(code), np.int64)
            cell[first[1:]] = 1
            which[4 * np.cumsum(cell) + (code & U64(3)).astype(np.int64)] = True
            code, top = parent[first], np.maximum.reduceat(top, first) if len(first) else top
            bits.append(which)
            maxima.append(top)
        return cls(height, bits[::-1], maxima[::-1])

    def packed(self) -> bytes:
        parts = [pack(self.maxima[0].astype(np.int32))]
        for k, which in enumerate(self.bits):
            parent = np.repeat(np.arange(len(which) // 4), which.reshape(-1, 4).sum(1))
            parts += [pack(np.packbits(which)), pack(self.maxima[k][parent] - self.maxima[k + 1])]
        return exchange.join_parts([self.height.to_bytes(1, "little"), *parts])

    @classmethod
    def unpacked(cls, blob: bytes) -> Treap:
        height, root, *parts = exchange.split_parts(blob)
        maxima, bits = [unpack(root, np.int32)], []
        for flags, less in zip(parts[::2], parts[1::2]):
            which = np.unpackbits(unpack(flags, np.uint8), count=4 * len(maxima[-1])).astype(bool)
            parent = np.repeat(np.arange(len(which) // 4), which.reshape(-1, 4).sum(1))
            bits.append(which)
            maxima.append(maxima[-1][parent] - unpack(less, np.int32))
        return cls(height[0], bits, maxima)

    def best(self, rows: np.ndarray, weights: np.ndarray, order: np.ndarray, k: int, found: list[tuple[int, int]]) -> None:
        """Put (score, -order) of the columns with the largest sums of weight * cell over the rows into `found`, a heap of the k best; sums of 0 are none."""
        width = max(1, min(WIDTH, 2_000_000 // max(len(rows), 1)))
        least = lambda: max(1, found[0][0]) if len(found) == k else 1
        bound = np.array([int(self.maxima[0][0]) * int(weights.sum()) if len(self.maxima[0]) else 0])
        todo, made = [(-int(bound[0]), 0, 0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64), bound)], 1
        while todo and -todo[0][0] >= least():
            _, _, level, column, at, bound = heapq.heappop(todo)
            keep = bound >= least()
            column, at, bound = column[keep], at[keep], bound[keep]
            if level == self.height:
                for entry in zip(bound.tolist(), (-order[column]).tolist()):
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)
                continue
            low = 2 * ((rows >> (self.height - 1 - level)) & 1)
            child, top = self.child[level], self.maxima[level + 1]
            halves = []
            for right in (0, 1):
                to = np.where(at >= 0, child[np.maximum(4 * at + low + right, 0)], -1)
                halves.append((2 * column + right, to, np.where(to >= 0, top[to], 0).astype(np.int64) @ weights))
            column, at, bound = (np.concatenate(x) for x in zip(*halves))
            by = np.flatnonzero(bound >= least())
            by = by[np.argsort(-bound[by], kind="stable")]
            for i in range(0, len(by), width):
                some = by[i : i + width]
                heapq.heappush(todo, (-int(bound[some[0]]), made, level + 1, column[some], at[some], bound[some]))
                made += 1


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of a number under 2**32 moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << U64(shift))) & U64(mask)
    return x


def _terms(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = part.words(LETTERS)
    return part.word_hashes(starts, ends), bounds


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N, L: documents with at least one term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for part in slices(batch["text"]):
                count = np.diff(part.words(LETTERS)[2])
                n, total = n + int((count > 0).sum()), total + int(count.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    n, total = docs.select(C("text").cast("binary").alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return n or 0, total or 0


def build_index(docs: DataFrame, size: tuple[int, int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of `docs` (doc_id, text): ids of the documents, hashes of the terms with document frequencies, and the treap."""
    n_docs, n_terms = size

    def block(number: int, ids: list, held: list) -> pa.RecordBatch:
        rows, hashes, counts = (np.concatenate(x) for x in zip(*held))
        terms, term = np.unique(hashes, return_inverse=True)
        lengths = np.bincount(rows, counts, len(ids)).astype(np.int64)
        m = 50 + (50 * lengths * n_docs) // max(n_terms, 1)
        impact = (SCALE * counts) // (K1 * counts + 20 * m[rows])
        height = max(int(max(len(terms), len(ids), 1) - 1).bit_length(), 0)
        tree = Treap.of(term, rows, impact, height)
        ids_ = np.array(ids, np.int64)
        return pa.RecordBatch.from_pydict({
            "block": [number], "documents": [len(ids)], "ids": [pack(ids_)], "terms": [pack(terms, ascending=True)],
            "often": [pack(np.bincount(term, minlength=len(terms)).astype(np.int32))], "tree": [tree.packed()],
        }, schema=_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list = []
        size_, first = 0, None
        for batch in batches:
            order, number = np.asarray(batch["order_"]), np.asarray(batch["number"])
            for part in slices(batch["text"], lower=True):
                if size_ and size_ + len(part.data) > block_bytes:
                    yield block(first, ids, held)
                    ids, held, size_ = [], [], 0
                if not size_ and not ids:
                    first = int(number[part.first])
                hashes, bounds = _terms(part)
                row = owners(bounds)
                by = np.lexsort((hashes, row))
                hashes, row = hashes[by], row[by]
                new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))) if len(hashes) else np.zeros(0, np.int64)
                held.append((row[new] + len(ids), hashes[new], np.diff(np.append(new, len(hashes)))))
                ids += order[part.first : part.first + part.rows].tolist()
                size_ += len(part.data)
        if ids:
            yield block(first, ids, held)

    rows = docs.select(F.coalesce(C("doc_id").cast("long"), F.lit(exchange.LAST_ID)).alias("order_"), C("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("number"))
    return rows.mapInArrow(run, INDEX)


_INDEX = pa.schema([("block", pa.int64()), ("documents", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("often", pa.binary()), ("tree", pa.binary())])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each item's distinct terms by hash; rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["text"], lower=True):
                hashes, bounds = _terms(part)
                yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(part.first + owners(bounds))), pa.array(hashes.view(np.int64))], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", C("text").cast("binary").alias("text")).mapInArrow(run, f"item_id {kind}, term long").distinct()


def _met(index: DataFrame, groups: int, asks: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """Groups of blocks with parts of the asks, a pair to a call: the stated items meet all documents, in blocks.

    The index is copied once for each part, and asks once for each group.
    """
    copies = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = index.select("*", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), copies(parts, "part"))
    right = asks.select("*", copies(groups, "group"))
    return left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInArrow(run, schema)


def _parts(*by: str, parts: int):
    return F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int").alias("part")


def _frequencies(index: DataFrame, groups: int, terms: DataFrame, parts: int) -> DataFrame:
    """term, df of the items' terms, from the blocks' dictionaries."""

    def count(blocks: pa.Table, asks: pa.Table) -> pa.Table:
        wanted = np.sort(np.asarray(asks["term"]).view(U64))
        df = np.zeros(len(wanted), np.int64)
        for known, often in zip(blocks["terms"], blocks["often"]):
            _, at, own = np.intersect1d(wanted, unpack(known.as_py(), U64, ascending=True), assume_unique=True, return_indices=True)
            df[at] += unpack(often.as_py(), np.int32)[own]
        return pa.table({"term": pa.array(wanted[df > 0].view(np.int64)), "df": pa.array(df[df > 0])})

    asks = terms.select("term").distinct().select("term", _parts("term", parts=parts))
    return _met(index.select("block", "terms", "often"), groups, asks, parts, count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def search(index: DataFrame, n_docs: int, terms: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best `top` documents of each item of `terms` (item_id, term)."""
    groups = max(1, math.ceil(index.count() / GROUP_BLOCKS))
    parts = max(1, math.ceil(terms.count() / PART_TERMS))
    df = _frequencies(index, groups, terms, parts)
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * C("df") + 1))).cast("long")
    asks = terms.join(df, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("asked"))
    asks = asks.select("item_id", "asked", _parts("item_id", parts=parts))

    def run(blocks: pa.Table, asks: pa.Table) -> pa.Table:
        best: list = [[] for _ in range(asks.num_rows)]
        asked = []
        for terms_ in asks["asked"]:
            by = np.argsort(np.asarray(terms_.values.field("term")).view(U64))
            asked.append((np.asarray(terms_.values.field("term")).view(U64)[by], np.asarray(terms_.values.field("weight"))[by]))
        for ids, known, tree in zip(blocks["ids"], blocks["terms"], blocks["tree"]):
            treap, known, order = Treap.unpacked(tree.as_py()), unpack(known.as_py(), U64, ascending=True), unpack(ids.as_py(), np.int64)
            for (wanted, weights), found in zip(asked, best):
                _, at, rows = np.intersect1d(wanted, known, assume_unique=True, return_indices=True)
                if len(rows):
                    treap.best(rows, weights[at], order, top, found)
        item = np.repeat(np.arange(len(best)), [len(b) for b in best])
        score, order = (np.array([e[k] for b in best for e in b], np.int64) for k in (0, 1))
        return pa.table([asks["item_id"].take(pa.array(item)), pa.array(-order), pa.array(score)], names=["item_id", "order_", "score"])

    kind = terms.schema["item_id"].dataType.simpleString()
    found = _met(index.select("block", "ids", "terms", "tree"), groups, asks, parts, run, f"item_id {kind}, order_ long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(C("score").desc(), "order_"))).filter(C("rank") <= top)
    return ranked.select("item_id", "rank", F.nullif("order_", F.lit(exchange.LAST_ID)).alias("doc_id"), "score")


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the `top` documents with the highest score above 0, all if fewer.

    Terms are runs of letters and digits (bytes beyond ASCII count), A-Z lower-cased. The score sums over an item's distinct
    terms floor(1000 * ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf + 20m)) with m = 50 + 50 n N div L: all in whole
    numbers. Ties go by doc_id, null last; repeated rows are documents of their own. Null and empty texts have no terms.
    Rows with one item_id, null too, are one item; items without terms, or whose terms no document has, give no rows.
    Only doc_id, item_id and text are read. Terms are told apart by 64 bits. Texts of any length are indexed whole. No
    documents or no items give no rows.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    size = corpus_size(docs)
    return search(stage(build_index(docs, size, block_bytes)), size[0], stage(item_terms(items)), top)
