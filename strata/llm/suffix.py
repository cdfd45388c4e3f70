"""Exact removal of repeated byte strings by a suffix array that is sorted deep and shallow.

Sorting the suffixes at every byte would move the text a hundred times over. Every string of `length` bytes holds one
anchor: the place whose hash over GRAM bytes is the smallest in it. Equal strings hold it at the same place, so only
suffixes that begin at anchors are sorted: those of which the GRAM bytes occur at two anchors at least. They meet by the
hash of these bytes, are sorted to the right and, reversed, to the left of the anchor, and two strings are equal where both
common prefixes reach. Sorting is multikey quicksort on eight-byte letters to a shallow depth; groups that still
agree there go through a blind trie each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from strata.llm import exchange
from strata.llm.text import BYTE_VALUES, U64, Slice, mix, owners, pack, prefix_sums, ranges, slices, spans, unpack

LENGTH = 100
GRAM = 32
SHALLOW = 40
LEFT_SHALLOW = 16
SENT_AT_ONCE = 500_000  # anchors whose hashes are packed together


def anchors(part: Slice, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of strings with one anchor: the anchor, the first and last start of the run, the gram's hash, the row."""
    n = len(part.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, U64), none
    sums = prefix_sums(BYTE_VALUES[part.data])
    at = np.arange(n - gram + 1)
    hashes = spans(sums, at, at + gram)
    low = (hashes & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: step - width], low[width - step :])
    place = (low & U64(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(np.diff(part.offsets) - length + 1, 0)
    start = ranges(part.offsets[:-1], counts)
    if not len(start):
        return none, none, none, np.zeros(0, U64), none
    row = np.repeat(np.arange(part.rows), counts)
    place = place[start]
    first = np.ones(len(start), bool)
    first[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(start)) - 1
    # The smallest hashes are small, so they are mixed again before they are dealt to buckets.
    return place[begin], start[begin], start[end], mix(hashes[place[begin]]), row[begin]


def _letters(rows: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each string as one number that sorts like them."""
    part = np.zeros((len(rows), 8), np.uint8)
    have = rows[:, depth : depth + 8]
    part[:, : have.shape[1]] = have
    return part.view(">u8").ravel().astype(U64)


def multikey_quicksort(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings by their first `depth` bytes, and the group (equal so far) at each place.

    All open groups are parted at once around a pivot letter each, in three: less, equal, greater. The equal part goes on
    at the next letter, the others at the same one.
    """
    n = len(rows)
    order = np.arange(n)
    start = np.zeros(n, np.int64)  # where the group of the place begins
    level = np.zeros(n, np.int64)
    deepest = -(-depth // 8)
    letters = [_letters(rows, 8 * d) for d in range(deepest)]
    stacked = np.stack(letters) if letters else np.zeros((0, n), U64)
    while n:
        sizes = np.bincount(start, minlength=n)
        todo = np.flatnonzero((sizes[start] > 1) & (level < deepest))
        if not len(todo):
            break
        group = start[todo]
        key = stacked[level[todo], order[todo]]
        pivot = key[np.searchsorted(group, group, "left") + sizes[group] // 2]
        side = (key > pivot).astype(np.int64) - (key < pivot) + 1
        by = np.argsort(group * 3 + side, kind="stable")
        moved = todo  # groups keep their places: todo is ascending, and by parts each group inside its own places
        order[moved], side, group = order[todo[by]], side[by], group[by]
        new = np.ones(len(todo), bool)
        new[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        start[moved] = moved[new][np.cumsum(new) - 1]
        level[moved] += side == 1
    return order, start


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of equally long strings: each goes down by branching bytes alone, is compared once, and branches off there."""
    root: list = [strings[0], [0]]  # a leaf: string, its numbers; an inner node: depth, children by byte
    size = len(strings[0])
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while type(node[0]) is int:
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        other = node[0]
        if s == other:
            node[1].append(i)
            continue
        common = size - (((int.from_bytes(s) ^ int.from_bytes(other)).bit_length() + 7) >> 3)
        above, node = None, root
        while type(node[0]) is int and node[0] < common:
            above, node = node, node[1][s[node[0]]]
        if type(node[0]) is int and node[0] == common:
            node[1][s[common]] = [s, [i]]
            continue
        branch = [common, {s[common]: [s, [i]], other[common]: node}]
        if above is None:
            root = branch
        else:
            above[1][s[above[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node[0]) is int:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(node[1])
    return out


def common_prefix(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each string in order with the one before it, not beyond either's length."""
    lcp = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        here, before = order[a:b], order[a - 1 : b - 1]
        differ = rows[here] != rows[before]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        lcp[a:b] = np.minimum(same, np.minimum(lengths[here], lengths[before]))
    return lcp


def suffix_array(rows: np.ndarray, lengths: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of strings padded to one length; of equal padded ones the shorter comes first."""
    order, start = multikey_quicksort(rows, shallow)
    sizes = np.bincount(start, minlength=len(order)) if len(order) else np.zeros(0, np.int64)
    for a in np.flatnonzero(sizes > 1):
        ids = order[a : a + sizes[a]]
        ids = ids[np.argsort(lengths[ids], kind="stable")]
        block = rows[ids]
        if len(ids) > 2:
            raw, width = block.tobytes(), rows.shape[1]
            order[a : a + sizes[a]] = ids[blind_trie([raw[k : k + width] for k in range(0, len(raw), width)])]
        else:
            x, y = block.tobytes()[: rows.shape[1]], block.tobytes()[rows.shape[1] :]
            order[a : a + 2] = ids if x <= y else ids[::-1]
    return order, common_prefix(rows, lengths, order)


def _matrix(data: np.ndarray, start: np.ndarray, counts: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Bytes start, start + 1, ... (or start - 1, start - 2, ...) of each string, padded with zeros."""
    out = np.zeros((len(start), width), np.uint8)
    for a in range(0, len(start), 4096):
        some, n = start[a : a + 4096], counts[a : a + 4096]
        row, col = np.repeat(np.arange(len(some)), n), ranges(np.zeros(len(some), np.int64), n)
        out[a + row, col] = data[some[row] - 1 - col if back else some[row] + col]
    return out


def repeated_starts(data: np.ndarray, begin: np.ndarray, high: np.ndarray, low: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For each offset: the contexts with a string that starts there, an order of them by string, which equal the one before.

    Among equal strings the order of the contexts stays. Each lies at `begin` and reaches from `high` bytes before its
    anchor to `length - low` after it.
    """
    anchor = begin + high
    right_size, left_size = length - low, high
    right, right_lcp = suffix_array(_matrix(data, anchor, right_size, length), right_size, SHALLOW)
    left, left_lcp = suffix_array(_matrix(data, anchor, left_size, int(high.max(initial=0)) + 1, back=True), left_size, LEFT_SHALLOW)
    n = len(begin)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        here = np.flatnonzero((low <= offset) & (offset <= high))
        if not len(here):
            continue
        right_class[right] = np.cumsum(right_lcp < length - offset)
        left_class[left] = np.cumsum(left_lcp < offset)
        key = right_class[here] * (n + 1) + left_class[here]
        by = np.argsort(key, kind="stable")
        same = np.zeros(len(by), bool)
        same[1:] = key[by[1:]] == key[by[:-1]]
        yield here, offset, by, same


class Contexts:
    """Anchors with the strings they stand for: document, tag, start in the document, reach to the left, gram, bytes."""

    def __init__(self):
        self.columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        self.bytes: list[np.ndarray] = []

    def add(self, part: Slice, found: tuple[np.ndarray, ...], pick: np.ndarray, order: np.ndarray, tag: np.ndarray, length: int) -> None:
        place, first, last, gram, row = (x[pick] for x in found)
        counts = last - first + length
        whole = spans(prefix_sums(BYTE_VALUES[part.data]), first, first + counts)
        for column, x in zip(self.columns, (order[row], tag[row].view(np.int64), first - part.offsets[row], place - first, place - last, gram, whole)):
            column.append(x)
        self.bytes.append(part.data[ranges(first, counts)])

    def settled(self, length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The columns in order of document and place, where the bytes of each begin, the bytes, which must travel, which are told.

        Of equal contexts only the first travels. The others are wholly repeated, unless they are the first one's place in
        a repeated row.
        """
        columns = [np.concatenate(c) for c in self.columns]
        data = np.concatenate(self.bytes)
        counts = columns[3] - columns[4] + length
        begin = np.cumsum(counts) - counts
        by = np.lexsort((columns[2] + columns[3], columns[1], columns[0]))
        order, tag, first, high, low, gram, whole = columns = [c[by] for c in columns]
        begin, counts = begin[by], counts[by]
        alike = np.lexsort((high, counts, whole))  # stable, so the earliest of equal ones comes first
        new = np.ones(len(alike), bool)
        x, y = alike[1:], alike[:-1]
        new[1:] = (whole[x] != whole[y]) | (counts[x] != counts[y]) | (high[x] != high[y])
        head = np.empty(len(alike), np.int64)
        head[alike] = alike[new][np.cumsum(new) - 1] if len(alike) else alike
        later = np.flatnonzero(head != np.arange(len(head)))
        same = np.zeros(len(head), bool)
        width = int(counts.max(initial=0))
        for a in range(0, len(later), 4096):  # the hash only proposes
            some = later[a : a + 4096]
            same[some] = (_matrix(data, begin[some], counts[some], width) == _matrix(data, begin[head[some]], counts[some], width)).all(axis=1)
        twin = (order == order[head]) & (tag == tag[head]) & (first == first[head])
        return columns, begin, data, ~same, same & ~twin


def _context_blob(columns: list[np.ndarray], begin: np.ndarray, data: np.ndarray, pick: np.ndarray, length: int) -> bytes:
    order, tag, first, high, low = (c[pick].astype(np.int64) for c in columns[:5])
    bytes_ = data[ranges(begin[pick], high - low + length)]
    return exchange.join_parts([pack(c) for c in (order, tag, first, high, low)] + [pack(bytes_)])


def _row_tags(part: Slice) -> np.ndarray:
    """A hash of each whole text, to tell rows of one id apart."""
    return spans(prefix_sums(BYTE_VALUES[part.data]), part.offsets[:-1], part.offsets[1:])


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """Bytes covered by a `length`-byte string that also starts earlier are removed.

    Earlier: in a document with a smaller doc_id, or before it in the same document; matches never cross documents, overlaps
    count, and strings are judged on the input. Returns the columns of `docs` but its text, and n_bytes, n_removed,
    removed (maximal byte intervals, end excluded) and kept (remaining bytes); a column of `docs` with one of these
    names is replaced. With `whole_characters`, kept also has the halves of UTF-8 characters that an interval cuts. Null and empty texts have no bytes, shorter texts lose nothing, and a text may be of any length.
    A null doc_id counts as larger than all others. Rows of one doc_id with different texts come in the order of a hash of
    the text; repeated rows (same id and text) are one document and get equal answers. No rows give no rows.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    named = docs.select([f"`{c}`" for c in docs.columns if c not in ("n_bytes", "n_removed", "removed", "kept")])
    rows = exchange.keyed(named)
    text_only = exchange.keyed(docs.select("doc_id", "text"))
    n = exchange.shares(docs)
    buckets = 2 * n  # a context is longer than its share of the text
    schema = _result_schema(named)

    def told(hashes: list[np.ndarray], order: list[np.ndarray]) -> pa.RecordBatch:
        h, o = np.concatenate(hashes), np.concatenate(order)
        seen, where, index, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        twice = counts[index] > 1
        keys, blobs = exchange.post(o[twice], h[twice], n)  # known here already
        tell = [-1 - k for k in keys]
        some = np.where(counts > 1, -1, o[where])  # -1: told already, but it counts for others
        for key, (x, y) in exchange.split_by(exchange.bucket_of(seen, n), seen, some):
            tell.append(key)
            blobs.append(exchange.two(x, y))
        return exchange.packed_batch(tell, blobs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order, held = [], [], 0
        for batch in batches:
            ids = np.asarray(batch["order_"])
            for part in slices(batch["text_"]):
                _, _, _, h, row = anchors(part, length, GRAM)
                hashes.append(h)
                order.append(ids[part.first + row])
                held += len(h)
                if held > SENT_AT_ONCE:
                    yield told(hashes, order)
                    hashes, order, held = [], [], 0
        if held:
            yield told(hashes, order)

    def decide(blobs: pa.Table) -> pa.Table:
        if blobs["key"][0].as_py() < 0:
            return exchange.table_of([-1 - k for k in blobs["key"].to_pylist()], blobs["data"].to_pylist())
        hashes, order = exchange.untwo_all(blobs)
        _, index, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        tell = (counts[index] > 1) & (order != -1)
        return exchange.table_of(*exchange.post(order[tell], hashes[tell], n))

    def contexts(frames: pa.Table, answers: pa.Table) -> pa.Table:
        wanted, held = exchange.posted(answers), Contexts()
        for table in exchange.thawed(frames):
            ids = np.asarray(table["order_"])
            for part in slices(table["text_"]):
                found = anchors(part, length, GRAM)
                order = ids[part.first : part.first + part.rows]
                pick = np.flatnonzero(exchange.among(exchange.pairs(order[found[4]], found[3]), wanted))
                held.add(part, found, pick, order, _row_tags(part), length)
        if not held.bytes:
            return exchange.table_of([], [])
        columns, begin, data, travel, told = held.settled(length)
        order, tag, first, high, low, gram, _ = columns
        keys, blobs = [], []
        for key, (chosen,) in exchange.split_by(exchange.bucket_of(gram[travel], buckets), np.flatnonzero(travel)):
            keys.append(key)
            blobs.append(_context_blob(columns, begin, data, chosen, length))
        if told.any():
            end = first[told] + high[told] - low[told] + length
            keys.append(-1 - frames["key"][0].as_py())
            blobs.append(exchange.join_parts([pack(order[told]), pack(tag[told]), pack(first[told]), pack(end)]))
        return exchange.table_of(keys, blobs)

    def sort(blobs: pa.Table) -> pa.Table:
        if blobs["key"][0].as_py() < 0:  # told by the chunk itself
            return exchange.table_of([-1 - k for k in blobs["key"].to_pylist()], blobs["data"].to_pylist())
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for blob in blobs["data"].to_pylist():
            for k, raw in enumerate(exchange.split_parts(blob)):
                columns[k].append(unpack(raw, np.int64 if k < 5 else np.uint8))
        order, tag, first, high, low, data = (np.concatenate(c) for c in columns)
        counts = high - low + length
        begin = np.cumsum(counts) - counts
        by = np.lexsort((first + high, tag, order))
        order, tag, first, high, low, begin = (x[by] for x in (order, tag, first, high, low, begin))
        twin = np.zeros(len(by), bool)  # the same place of a repeated row is not earlier than itself
        twin[1:] = (order[1:] == order[:-1]) & (tag[1:] == tag[:-1]) & (first[1:] == first[:-1]) & (high[1:] == high[:-1])
        rank = np.cumsum(~twin)
        told: list[np.ndarray] = []
        for here, offset, same_order, same in repeated_starts(data, begin, high, low, length):
            head = np.flatnonzero(~same)
            least = rank[here[same_order[head]]][np.cumsum(~same) - 1]
            lost = here[same_order[rank[here[same_order]] > least]]
            told.append(np.stack((lost, first[lost] + high[lost] - offset)).astype(np.int32 if first.max() < 1 << 30 else np.int64))
        lost, at = np.concatenate(told, axis=1) if told else np.zeros((2, 0), np.int32)
        del told
        by = np.lexsort((at, lost))
        lost, at = lost[by], at[by]
        new = np.ones(len(lost), bool)
        new[1:] = (lost[1:] != lost[:-1]) | (at[1:] != at[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(lost)) - 1
        keys, out = [], []
        if len(lost):
            for key, (i, j) in exchange.split_by(exchange.chunk_of(order[lost[a]], n), a, b):
                keys.append(key)
                out.append(exchange.join_parts([pack(order[lost[i]]), pack(tag[lost[i]]), pack(at[i].astype(np.int64)), pack(at[j].astype(np.int64) + length)]))
        return exchange.table_of(keys, out)

    def finish(frames: pa.Table, answers: pa.Table) -> pa.Table:
        told = [[unpack(x, np.int64) for x in exchange.split_parts(b)] for b in answers["data"].to_pylist()]
        order, tag, start, end = (np.concatenate(c) for c in zip(*told)) if told else [np.zeros(0, np.int64)] * 4
        number = exchange.pairs(order, tag.view(U64))
        by = np.argsort(number)
        number, start, end = number[by], start[by], end[by]
        out = []
        for table in exchange.thawed(frames):
            ids = np.asarray(table["order_"])
            cuts = [_cut(part, exchange.pairs(ids[part.first : part.first + part.rows], _row_tags(part)), number, start, end, whole_characters) for part in slices(table["text_"])]
            fields = table["row_"].combine_chunks()
            own = {f.name: fields.field(f.name) for f in fields.type}
            own |= {k: pa.concat_arrays([c[k] for c in cuts]) for k in ("n_bytes", "n_removed", "removed", "kept")}
            out.append(pa.table([own[f.name].cast(f.type) for f in schema], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    repeated = exchange.meet(text_only.mapInArrow(emit, exchange.PACKED), decide)
    strings = exchange.answer(text_only, repeated, n, contexts, exchange.PACKED)
    return exchange.answer(rows, exchange.meet(strings, sort), n, finish, from_arrow_schema(schema))


def _result_schema(docs: DataFrame) -> pa.Schema:
    own = to_arrow_schema(docs.drop("text").schema)
    spans_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.schema([*own, ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", spans_), ("kept", pa.binary())])


def _cut(part: Slice, numbers: np.ndarray, told: np.ndarray, start: np.ndarray, end: np.ndarray, whole_characters: bool) -> dict[str, pa.Array]:
    """What stays of each document of a slice, given intervals sorted by the number of their document."""
    a, b = np.searchsorted(told, numbers, "left"), np.searchsorted(told, numbers, "right")
    which = ranges(a, b - a)
    shift = np.repeat(part.offsets[:-1], b - a)
    edge = np.zeros(len(part.data) + 1, np.int64)
    np.add.at(edge, start[which] + shift, 1)
    np.add.at(edge, end[which] + shift, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n = len(gone)
    prev, after = np.zeros(n, bool), np.zeros(n, bool)
    prev[1:], after[:-1] = gone[:-1], gone[1:]
    full = part.offsets[1:] > part.offsets[:-1]
    prev[part.offsets[:-1][full]] = False
    after[part.offsets[1:][full] - 1] = False
    first, last = np.flatnonzero(gone & ~prev), np.flatnonzero(gone & ~after) + 1
    bounds = np.searchsorted(first, part.offsets)
    base = part.offsets[owners(bounds)]
    sizes, stay = np.diff(part.offsets), ~gone
    removed = sizes - np.diff(np.concatenate(([0], np.cumsum(stay)))[part.offsets])
    if whole_characters and n:
        head = (part.data & 0xC0) != 0x80
        head[part.offsets[:-1][full]] = True
        stay = np.maximum.reduceat(stay, np.flatnonzero(head))[np.cumsum(head) - 1]
    total = np.concatenate(([0], np.cumsum(stay)))[part.offsets]
    return {
        "n_bytes": pa.array(sizes, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "removed": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())], ["start", "end"])),
        "kept": pa.Array.from_buffers(pa.binary(), part.rows, [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(part.data[stay])]),
    }


def suffix_digest(docs: DataFrame) -> DataFrame:
    kept = remove_repeated_bytes(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated strings cut out of the text; characters that a cut would halve stay whole.

    Cases are those of `remove_repeated_bytes`; a null text stays null, and all other columns stay as they are.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    held = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("no_text"), F.struct(*rest).alias("own")).alias("held_"))
    cut = remove_repeated_bytes(held, length, whole_characters=True)
    text = F.when(~F.col("held_.no_text"), F.col("kept").cast("string")).alias("text")
    return cut.select(*[text if c == "text" else F.col(f"held_.own.`{c}`") for c in docs.columns])
