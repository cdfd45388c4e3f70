"""N-gram Jaccard join by vertical partitioning, and the groups that its links make.

The global order of n-grams is (document frequency, hash). A document can only link if at least the threshold's share of its
n-grams also occurs elsewhere, so the first exchange counts frequencies and the answer carries them back; documents
that fail this bound are done. The others keep their set, cut into FRAGMENTS along the hash, and the n-grams of their
prefix (as many as a linked partner can lack, plus one, rarest first). Documents that share a prefix n-gram and pass
the length and position bounds are candidates. For each candidate pair and fragment the overlap is counted apart, and
the counts are summed per pair.

Candidates are tried against one central document of each list first, a few rounds; documents that are connected by then
need no further pair among themselves. What is left of any list is then tried pair by pair, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import exchange
from strata.llm.memory import give_back
from strata.llm.stage import stage
from strata.llm.text import PLAIN, U64, mix, owners, pack, slices, unpack, word_windows
from strata.operators.graph import connected_components

C = F.col
WORDS = 5
SIMILAR = Fraction(3, 4)
FRAGMENT_BITS = 2
FRAGMENTS = 1 << FRAGMENT_BITS
STAR_ROUNDS = 2
HOPS = 4
PRINT_BITS = 40  # of a hash, for frequencies: a clash only makes an n-gram look less rare
SETS = "row long, order_ long, n long, high long, low long, suspect boolean, lonely double, prefix array<struct<gram: long, place: int>>, fragments array<array<long>>"
HELD = 500_000  # n-grams of a task that wait to be told


def distinct_grams(hashes: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, ascending, and the number of them before each document."""
    grams, at = word_windows(hashes, bounds, words, short=True)
    row = owners(bounds)[at]
    by = np.lexsort((grams, row))
    grams, row = grams[by], row[by]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(bounds)))


def allowed_misses(n: np.ndarray, similar: Fraction) -> np.ndarray:
    """How many of n n-grams may be absent from a linked document: |A & B| >= similar * |A | B| >= similar * n."""
    return n - -(-n * similar.numerator // similar.denominator)


def _prints(grams: np.ndarray) -> np.ndarray:
    return grams >> U64(64 - PRINT_BITS)


def _set_key(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a set: two sums over mixed members."""
    def sums(values):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
        return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)

    return sums(mix(grams ^ U64(0x5851F42D4C957F2D))), sums(mix(grams ^ U64(0x14057B7EF767814F)))


def gram_sets(docs: DataFrame, words: int, similar: Fraction) -> DataFrame:
    """One row for each of `docs` (row, doc_id, text): its set's size and key, whether it may link at all, and if so its prefix and fragments."""
    rows = exchange.keyed(docs.select("row", "doc_id", "text"))
    n = exchange.shares(docs)

    def of(part):
        starts, ends, bounds = part.words(PLAIN)
        return distinct_grams(part.word_hashes(starts, ends), bounds, words)

    def told(prints: list[np.ndarray], order: list[np.ndarray]) -> pa.RecordBatch:
        p, o = np.concatenate(prints), np.concatenate(order)
        keys, blobs = [], []
        for key, (some, their) in exchange.split_by(((p * U64(n)) >> U64(PRINT_BITS)).astype(np.int64), p, o):
            keys.append(key)
            blobs.append(exchange.two(some, their))
        return exchange.packed_batch(keys, blobs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, order, held = [], [], 0
        for batch in batches:
            ids = np.asarray(batch["order_"])
            for part in slices(batch["text_"], lower=True):
                grams, bounds = of(part)
                prints.append(_prints(grams))
                order.append(ids[part.first + owners(bounds)])
                held += len(grams)
                if held > HELD:
                    yield told(prints, order)
                    prints, order, held = [], [], 0
        if held:
            yield told(prints, order)
        give_back()

    def count(blobs: pa.Table) -> pa.Table:
        prints, order = exchange.untwo_all(blobs)
        by = np.argsort(prints, kind="stable")
        prints, order = prints[by], order[by]
        first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))) if len(prints) else np.zeros(0, np.int64)
        often = np.diff(np.append(first, len(prints))).astype(np.int32)
        df = np.repeat(often, often)
        keep = df > 1
        prints, order, df = prints[keep], order[keep], df[keep]
        keys, out = [], []
        for key, (p, o, d) in exchange.split_by(exchange.chunk_of(order, n), prints, order, df):
            keys.append(key)
            out.append(exchange.join_parts([pack(p, ascending=True), pack(o), pack(d)]))
        give_back()
        return exchange.table_of(keys, out)

    def frequencies(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of (document, n-gram) in ascending order, with the n-gram's document frequency."""
        number, df = [np.zeros(0, U64)], [np.zeros(0, np.int32)]
        for blob in answers["data"]:
            p, o, d = exchange.split_parts(blob.as_py())
            number.append(exchange.pairs(unpack(o, np.int64), unpack(p, U64, ascending=True)))
            df.append(unpack(d, np.int32))
        number, df = np.concatenate(number), np.concatenate(df)
        by = np.argsort(number, kind="stable")
        return number[by], df[by]

    def finish(frames: pa.Table, answers: pa.Table) -> pa.Table:
        number, df = frequencies(answers)
        out = []
        for table in exchange.thawed(frames):
            ids, rows_ = np.asarray(table["order_"]), np.asarray(table["row_"].combine_chunks().field("row"))
            for part in slices(table["text_"], lower=True):
                grams, bounds = of(part)
                wanted = exchange.pairs(ids[part.first + owners(bounds)], _prints(grams))
                at = np.minimum(np.searchsorted(number, wanted), max(len(number) - 1, 0))
                often = np.where(number[at] == wanted, df[at], 1) if len(number) else np.ones(len(grams), np.int32)
                own = slice(part.first, part.first + part.rows)
                out.append(_set_rows(rows_[own], ids[own], grams, bounds, often, similar))
        give_back()
        return pa.Table.from_batches(out, _SCHEMA)

    answers = exchange.meet(rows.mapInArrow(emit, exchange.PACKED), count)
    return exchange.answer(rows, answers, n, finish, SETS)


_SCHEMA = pa.schema([
    ("row", pa.int64()), ("order_", pa.int64()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("suspect", pa.bool_()), ("lonely", pa.float64()),
    ("prefix", pa.list_(pa.struct([("gram", pa.int64()), ("place", pa.int32())]))), ("fragments", pa.list_(pa.list_(pa.int64()))),
])


def _cut(counts: np.ndarray) -> pa.Array:
    """Offsets of lists of so many items."""
    return pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def _set_rows(rows: np.ndarray, ids: np.ndarray, grams: np.ndarray, bounds: np.ndarray, often: np.ndarray, similar: Fraction) -> pa.RecordBatch:
    n = np.diff(bounds)
    high, low = _set_key(grams, bounds)
    total = np.concatenate(([0], np.cumsum(often == 1)))
    alone = total[bounds[1:]] - total[bounds[:-1]]
    misses = allowed_misses(n, similar)
    suspect = (n > 0) & (alone <= misses)
    # From here on only the n-grams of documents that may link.
    row = owners(bounds)
    keep = suspect[row]
    row, grams, often = row[keep], grams[keep], often[keep]
    by = np.lexsort((grams, often, row))
    place = np.arange(len(by)) - np.concatenate(([0], np.cumsum(np.where(suspect, n, 0))))[row]  # rows keep their order in `by`
    chosen = (place <= misses[row]) & (often[by] > 1)
    pairs = pa.StructArray.from_arrays([pa.array(grams[by][chosen].view(np.int64)), pa.array(place[chosen].astype(np.int32))], fields=list(_SCHEMA.field("prefix").type.value_type))
    prefix = pa.ListArray.from_arrays(_cut(np.bincount(row[chosen], minlength=len(n))), pairs)
    parts = np.bincount(row * FRAGMENTS + (grams >> U64(64 - FRAGMENT_BITS)).astype(np.int64), minlength=len(n) * FRAGMENTS)
    parts = parts.reshape(-1, FRAGMENTS)[suspect].ravel()
    fragments = pa.ListArray.from_arrays(_cut(np.where(suspect, FRAGMENTS, 0)), pa.ListArray.from_arrays(_cut(parts), pa.array(grams.view(np.int64))))
    columns = [rows, ids, n, high, low, suspect, alone / np.maximum(n, 1), prefix, fragments]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _overlaps(pairs: DataFrame, fragments: DataFrame, similar: Fraction) -> DataFrame:
    """Pairs (a, b, na, nb) that link: overlaps are counted for each fragment apart and summed."""
    left = fragments.select(C("node").alias("a"), "fragment", C("grams").alias("x"))
    right = fragments.select(C("node").alias("b"), "fragment", C("grams").alias("y"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    counted = both.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("shared"))
    return counted.filter(C("shared") * similar.denominator >= (C("na") + C("nb") - C("shared")) * similar.numerator)


def _possible(similar: Fraction):
    """Length and position bounds on (na, nb, pa, pb): the shared n-gram at these places must leave enough after it."""
    p, q = similar.numerator, similar.denominator
    need = (C("na") + C("nb")) * p / (p + q)
    rest = F.least(C("na") - C("pa"), C("nb") - C("pb"))
    return (F.least("na", "nb") * q >= F.greatest("na", "nb") * p) & (rest >= need)


def jaccard_groups(docs: DataFrame, words: int = WORDS, similar: Fraction = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text; other columns are ignored).

    Texts are lower-cased (A-Z); words are runs of anything but ASCII blanks. A document's set has its distinct n-grams of
    `words` words; with fewer words, the whole sequence as one. Two documents link when their sets' intersection is at
    least `similar` of their union, and component_id is the smallest doc_id that links reach. Null texts and texts
    without words have an empty set, link with nothing and are their own component. A null doc_id has the component of
    its links, or null if no linked row has an id. Repeated rows and equal sets are linked. Sets are told apart by 128
    bits, n-grams by 64. Any length, no caps. No rows give no rows.
    """
    none = F.lit(exchange.LAST_ID)
    rows = jaccard_rows(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), words, similar)
    return rows.select(F.nullif("order_", none).alias("doc_id"), C("n").alias("n_shingles"), F.nullif("least", none).alias("component_id"))


def jaccard_rows(docs: DataFrame, words: int = WORDS, similar: Fraction = SIMILAR) -> DataFrame:
    """row, order_, n, component, least for each row of `docs` (row, doc_id, text), whose `row` differs from all others.

    Links as in `jaccard_groups`. component is one number for all rows that links connect and the row's own for a row that
    links with nothing; order_ is the doc_id and least the smallest of the component, LAST_ID for a null id.
    """
    sets = stage(gram_sets(docs, words, similar))
    held = sets.filter("suspect")
    # Equal sets are one node, named by one of its rows; only one row for each goes on.
    classes = held.groupBy("high", "low").agg(F.min("row").alias("node"))
    nodes = stage(held.select("row", "n", "lonely").join(classes.select(C("node").alias("row")), "row").select(C("row").alias("node"), "n", "lonely"))
    chosen = held.select("row", "fragments", "prefix").join(nodes.select(C("node").alias("row")), "row", "left_semi")
    fragments = held.select(C("row").alias("node"), F.posexplode("fragments").alias("fragment", "grams")).join(nodes.select("node"), "node", "left_semi")
    lists = stage(
        chosen.select(C("row").alias("node"), F.explode("prefix").alias("p")).join(nodes, "node")
        .select(C("p.gram").alias("gram"), C("p.place").alias("place"), "node", "n", "lonely")
    )
    links, tried = nodes.select(C("node").alias("u"), C("node").alias("v")).limit(0), None
    open_lists = lists.withColumn("component", C("node"))
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            open_lists = stage(_open(lists, _near_labels(nodes, links)))
        if open_lists.isEmpty():
            break
        pairs = _star(open_lists, turn, similar) if turn < STAR_ROUNDS else _rest(open_lists, similar)
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = stage(_overlaps(pairs, fragments, similar).select(C("a").alias("u"), C("b").alias("v")))
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        links = links.union(found) if turn else found
    label = connected_components(nodes.select("node"), links)
    named = classes.join(label, "node").select("high", "low", "component")
    members = sets.filter("n > 0").select("order_", "high", "low", "row").join(named, ["high", "low"], "left").withColumn("component", F.coalesce("component", "row"))
    least = members.groupBy("component").agg(F.min("order_").alias("least"))
    group = members.join(least, "component").select("row", "component", "least")
    return sets.select("order_", "n", "row").join(group, "row", "left").select(
        "row", "order_", "n", F.coalesce("component", "row").alias("component"), F.coalesce("least", "order_").alias("least")
    )


def _near_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node within HOPS links. Equal labels mean connected, which is all that skips a pair.

    Members of two centres that a third one joins are four links apart.
    """
    both = links.select(C("u").alias("node"), C("v").alias("other")).union(links.select(C("v").alias("node"), C("u").alias("other"))).union(nodes.select("node", C("node").alias("other")))
    label = both.groupBy("node").agg(F.min("other").alias("component"))
    for _ in range(HOPS - 1):
        label = both.join(label.select(C("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("component"))
    return label


def _open(lists: DataFrame, label: DataFrame) -> DataFrame:
    """The lists whose members are not yet all connected."""
    now = lists.join(label, "node")
    apart = now.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return now.join(apart.select("gram"), "gram", "left_semi")


def _star(lists: DataFrame, turn: int, similar: Fraction) -> DataFrame:
    """Members of a list against one of them: the one with the least n-grams of its own, then any by hash.

    Each document tries the centre that most of its lists name.
    """
    rank = C("lonely") if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")
    centre = lists.groupBy("gram").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "place", "component")).alias("c"))
    met = lists.join(centre, "gram").filter(C("component") != C("c.component"))
    met = met.select("node", C("c.node").alias("other"), C("n").alias("na"), C("c.n").alias("nb"), C("place").alias("pa"), C("c.place").alias("pb")).filter(_possible(similar))
    votes = met.groupBy("node", "other").agg(F.count("*").alias("votes"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    best = votes.groupBy("node", "na").agg(F.max(F.struct("votes", "other", "nb")).alias("m"))
    return best.select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b"), *_sizes(C("node"), C("m.other"), C("na"), C("m.nb"))).distinct()


def _sizes(node, other, n, m):
    return F.when(node < other, n).otherwise(m).alias("na"), F.when(node < other, m).otherwise(n).alias("nb")


def _rest(lists: DataFrame, similar: Fraction) -> DataFrame:
    """All pairs of the open lists' members that are not connected yet and pass the bounds."""
    left = lists.select("gram", C("node").alias("a"), C("n").alias("na"), C("place").alias("pa"), C("component").alias("ca"))
    right = lists.select("gram", C("node").alias("b"), C("n").alias("nb"), C("place").alias("pb"), C("component").alias("cb"))
    met = left.join(right, "gram").filter((C("a") < C("b")) & (C("ca") != C("cb")))
    return met.filter(_possible(similar)).select("a", "b", "na", "nb").distinct()
