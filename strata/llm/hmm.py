"""Hidden Markov language model: Baum-Welch over all learning texts, exact likelihood by the scaled forward recursion.

A word is told by a 64-bit key whose lowest bits are its ending (a hash of its last three bytes). Latent states emit
classes: each of the HEAD most frequent words is a class of its own, the end of a text is one, and the other words fall
into one class for each ending; inside such a class a word has its smoothed share of the class's count. So a text's
probability is that of its classes under the Markov model times that of its rare words in their classes.

The first model comes from what follows what: classes with similar counts of their next class start in one state. Each
round of Baum-Welch then runs forward and backward over all learning texts, in segments of SEGMENT tokens; tasks send
expected counts, Spark sums them, and the driver holds only the model, whose size is fixed by STATES and classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import exchange
from strata.llm.stage import stage
from strata.llm.text import PLAIN, U64, pack, slices, unpack

C = F.col
STATES = 8
ROUNDS = 4
HEAD = 8192  # words that are classes of their own
KNOWN = 1 << 16  # most frequent words whose counts go to every task; all others are met by a shuffle
ENDING_BITS = 9
ENDINGS = 1 << ENDING_BITS
END = HEAD
CLASSES = HEAD + 1 + ENDINGS
CONTEXT = 32
SEGMENT = 256
BATCH_TOKENS = 200_000
LONG = 8192  # tokens; the blocks of a longer text are multiplied out side by side
ALPHA = 0.1
FLOOR = 1e-7  # expected count that every state has of every class
END_KEY = U64(0)


def word_keys(part) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word of a slice, and the number of words before each document."""
    starts, ends, bounds = part.words(PLAIN)
    hashes = part.word_hashes(starts, ends)
    ending = np.zeros(len(starts), U64)
    for back in (1, 2, 3):
        here = ends - back
        ending = ending * U64(37) + np.where(here >= starts, part.data[np.maximum(here, 0)], 0).astype(U64)
    ending = ((ending * U64(0x9E3779B97F4A7C15)) >> U64(64 - ENDING_BITS)).astype(U64)
    keys = (hashes & ~U64(ENDINGS - 1)) | ending
    return np.where(keys == END_KEY, U64(ENDINGS), keys), bounds


def held_out():
    """Rows that are never learned from: crc32 of the id as text is divisible by 10; rows without id too."""
    return F.coalesce(F.pmod(F.crc32(C("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(key, data): for each bucket of keys, all its words of the learning texts and their counts; the end is not among them."""
    n = exchange.shares(docs)

    def told(keys: np.ndarray) -> pa.RecordBatch:
        words, counts = np.unique(keys, return_counts=True)
        tell, blobs = [], []
        for key, (w, c) in exchange.split_by(exchange.bucket_of(words, n), words, counts):
            tell.append(key)
            blobs.append(exchange.two(w, c))
        return exchange.packed_batch(tell, blobs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch["text"], lower=True):
                held.append(word_keys(part)[0])
                if sum(map(len, held)) > 2_000_000:
                    yield told(np.concatenate(held))
                    held = []
        if held:
            yield told(np.concatenate(held))

    def add(blobs: pa.Table) -> pa.Table:
        words, counts = exchange.untwo_all(blobs)
        words, index = np.unique(words, return_inverse=True)
        return exchange.table_of([blobs["key"][0].as_py()], [exchange.two(words, np.bincount(index, counts).astype(np.int64))])

    learn = docs.filter(~held_out()).select(C("text").cast("binary").alias("text"))
    return exchange.meet(learn.mapInArrow(emit, exchange.PACKED), add)


class Counts:
    """What every task needs of the vocabulary: its totals, the most frequent words, and totals by ending of the rest."""

    def __init__(self, vocabulary_: DataFrame, n_texts: int):
        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch["data"].to_pylist():
                    words, counts = exchange.untwo(blob)
                    ending = (words & U64(ENDINGS - 1)).astype(np.int64)
                    top = np.argsort(-counts, kind="stable")[:KNOWN]
                    yield _rows(np.arange(ENDINGS), np.bincount(ending, counts, ENDINGS), np.bincount(ending, minlength=ENDINGS), kind=0)
                    yield _rows(words[top].view(np.int64), counts[top], np.ones(len(top)), kind=1)

        rows = stage(vocabulary_.mapInArrow(totals, "kind int, word long, n long, words long"))
        by_ending = rows.filter("kind = 0").groupBy("word").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()
        top = rows.filter("kind = 1").orderBy(C("n").desc(), "word").limit(KNOWN).select("word", "n").toArrow()
        n, words = np.zeros(ENDINGS), np.zeros(ENDINGS)
        n[np.asarray(by_ending["word"])], words[np.asarray(by_ending["word"])] = np.asarray(by_ending["n"]), np.asarray(by_ending["words"])
        self.texts = n_texts
        self.tokens = int(n.sum()) + n_texts
        self.distinct = int(words.sum()) + (n_texts > 0)
        known, counts = np.asarray(top["word"]).view(U64), np.asarray(top["n"]).astype(np.int64)
        rank = np.lexsort((known, -counts))
        known, counts = known[rank], counts[rank]
        ending = (known & U64(ENDINGS - 1)).astype(np.int64)
        self.rest_n = n - np.bincount(ending[:HEAD], counts[:HEAD], ENDINGS)
        self.rest_words = words - np.bincount(ending[:HEAD], minlength=ENDINGS)
        by = np.argsort(known)
        self.known, self.counts, self.rank = known[by], counts[by], by

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.tokens + ALPHA * (self.distinct + 1)))

    def in_class(self, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share of its class."""
        ending = (keys & U64(ENDINGS - 1)).astype(np.int64)
        return np.log10((counts + ALPHA) / (self.rest_n[ending] + ALPHA * (self.rest_words[ending] + 1)))


def _rows(word: np.ndarray, n: np.ndarray, words: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), kind), pa.int32()), pa.array(word, pa.int64()), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64))], names=["kind", "word", "n", "words"])


def encoded(docs: DataFrame, counts: Counts) -> DataFrame:
    """Each text as class numbers, with the sums over its frequent words, and the keys of its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["text"], lower=True):
                keys, bounds = word_keys(part)
                at = np.minimum(np.searchsorted(counts.known, keys), max(len(counts.known) - 1, 0))
                known = counts.known[at] == keys if len(counts.known) else np.zeros(len(keys), bool)
                n = np.where(known, counts.counts[at], 0) if len(counts.known) else np.zeros(len(keys), np.int64)
                rank = np.where(known, counts.rank[at], HEAD) if len(counts.known) else np.full(len(keys), HEAD)
                classes = np.where(rank < HEAD, rank, HEAD + 1 + (keys & U64(ENDINGS - 1)).astype(np.int64)).astype(np.uint16)
                base = np.where(known, counts.base(n), 0.0)
                inside = np.where(known & (rank >= HEAD), counts.in_class(n, keys), 0.0)
                sums = [np.concatenate(([0.0], np.cumsum(x))) for x in (base, inside, known)]
                size = np.diff(bounds)
                base_, inside_, known_ = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                text, rare = [], []
                end = np.array([END], np.uint16).tobytes()
                for r in range(part.rows):
                    a, b = bounds[r], bounds[r + 1]
                    text.append(classes[a:b].tobytes() + end)
                    rare.append(keys[a:b][~known[a:b]].tobytes())
                where = slice(part.first, part.first + part.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["row"][where], batch["doc_id"][where], batch["held_out"][where], pa.array(size + 1, pa.int64()), pa.array((known_ + (counts.texts > 0)).astype(np.int64)),
                     pa.array(base_ + counts.base(np.array(counts.texts))), pa.array(inside_), pa.array(text, pa.binary()), pa.array(rare, pa.binary())],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "inside", "classes", "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), C("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), C("text").cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inside double, classes binary, rare binary"))


def rare_sums(texts: DataFrame, vocabulary_: DataFrame, counts: Counts, n: int) -> DataFrame:
    """(row, known2, base2, inside2): sums over the words that are not in every task's table, packed by parts of the rows."""
    parts = max(4, n // 8)

    def told(keys: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        k, r = np.concatenate(keys), np.concatenate(rows)
        tell, blobs = [], []
        for key, (some, their) in exchange.split_by(exchange.bucket_of(k, n), k, r):
            tell.append(key)
            blobs.append(exchange.two(some, their))
        return exchange.packed_batch(tell, blobs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, held = [], [], 0
        for batch in batches:
            for row, blob in zip(batch["row"].to_pylist(), batch["rare"]):
                keys.append(np.frombuffer(blob.as_buffer(), U64))
                rows.append(np.full(len(keys[-1]), row))
                held += len(keys[-1])
                if held > 2_000_000:
                    yield told(keys, rows)
                    keys, rows, held = [], [], 0
        if held:
            yield told(keys, rows)

    def look(entries: pa.Table, words: pa.Table) -> pa.Table:
        keys, rows = exchange.untwo_all(entries)
        known, n_ = exchange.untwo_all(words)
        by = np.argsort(known)
        known, n_ = known[by], n_[by]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        c = np.where(known[at] == keys, n_[at], 0) if len(known) else np.zeros(len(keys), np.int64)
        rows, sums = _summed(rows, [(c > 0).astype(float), counts.base(c), counts.in_class(c, keys)])
        tell, blobs = [], []
        for key, (some, *part) in exchange.split_by(exchange.chunk_of(rows, parts), rows, *sums):
            tell.append(key)
            blobs.append(exchange.join_parts([pack(x) for x in (some, *part)]))
        return exchange.table_of(tell, blobs)

    def add(blobs: pa.Table) -> pa.Table:
        columns = [exchange.split_parts(b) for b in blobs["data"].to_pylist()]
        rows = np.concatenate([unpack(c[0], np.int64) for c in columns])
        rows, sums = _summed(rows, [np.concatenate([unpack(c[k], np.float64) for c in columns]) for k in (1, 2, 3)])
        return pa.table([pa.array(rows), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["row", "known2", "base2", "inside2"])

    entries = texts.select("row", "rare").filter(F.octet_length("rare") > 0).mapInArrow(emit, exchange.PACKED)
    met = entries.groupBy("key").cogroup(vocabulary_.groupBy("key")).applyInArrow(look, exchange.PACKED)
    return exchange.meet(met, add, "row long, known2 long, base2 double, inside2 double")


def _summed(rows: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    some, index = np.unique(rows, return_inverse=True)
    return some, [np.bincount(index, c, len(some)).astype(float) for c in columns]


class Model:
    """Start, transition and emission probabilities of the latent states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = (x / x.sum(axis=-1, keepdims=True) for x in (start, move, emit))
        self.by_class = np.ascontiguousarray(self.emit.T)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each sequence of classes, by the scaled forward recursion side by side."""
        out = np.zeros(len(texts))
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        if short:
            out[short] = self._forward([texts[i] for i in short])
        for i, t in enumerate(texts):
            if len(t) > LONG:
                out[i] = self._forward_blocks(t)
        return out

    def _forward(self, texts: list[np.ndarray]) -> np.ndarray:
        tokens, by, live = _side_by_side(texts)
        total = np.zeros(len(texts))
        alpha = np.repeat(self.start[None], len(texts), axis=0)
        for t in range(len(tokens)):
            n = live[t]
            now = (alpha[:n] @ self.move if t else alpha[:n]) * self.by_class[tokens[t]]
            scale = now.sum(axis=1)
            alpha = now / scale[:, None]
            total[:n] += np.log10(scale)
        out = np.empty(len(texts))
        out[by] = total
        return out

    def _forward_blocks(self, text: np.ndarray, block: int = 256) -> float:
        """One long text: the transfer matrices of its blocks are multiplied out side by side, then chained."""
        first = self.start * self.by_class[text[0]]
        total, alpha = np.log10(first.sum()), first / first.sum()
        rest = text[1:]
        whole = len(rest) // block * block
        pieces = rest[:whole].reshape(-1, block)
        for a in range(0, len(pieces), 512):
            some = pieces[a : a + 512]
            matrix, scales = np.repeat(np.eye(len(self.start))[None], len(some), axis=0), np.zeros(len(some))
            for t in range(block):
                matrix = (matrix @ self.move) * self.by_class[some[:, t]][:, None, :]
                scale = matrix.max(axis=(1, 2))
                matrix /= scale[:, None, None]
                scales += np.log10(scale)
            for m, s in zip(matrix, scales):
                alpha = alpha @ m
                total += s + np.log10(alpha.sum())
                alpha /= alpha.sum()
        for c in rest[whole:]:
            alpha = (alpha @ self.move) * self.by_class[c]
            total += np.log10(alpha.sum())
            alpha /= alpha.sum()
        return float(total)

    def expected(self, texts: list[np.ndarray], first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Add the expected counts of these segments; `first` marks those that begin a text."""
        tokens, by, live = _side_by_side(texts)
        k = len(self.start)
        emitted = [self.by_class[tok] for tok in tokens]
        alphas, scales = [], []
        alpha = np.where(first[by][:, None], self.start, np.full(k, 1 / k))
        for t, e in enumerate(emitted):
            n = live[t]
            now = (alpha[:n] @ self.move if t else alpha[:n]) * e
            scale = now.sum(axis=1, keepdims=True)
            alpha = now / scale
            alphas.append(alpha)
            scales.append(scale)
        gammas: list[np.ndarray] = [np.zeros((0, k))] * len(tokens)
        beta = np.ones((len(texts), k))
        for t in range(len(tokens) - 1, -1, -1):
            n = live[t]
            gammas[t] = alphas[t] * beta[:n]
            if t:
                back = emitted[t] * beta[:n] / scales[t]
                move += self.move * (alphas[t - 1][:n].T @ back)
                beta[:n] = back @ self.move.T
        start += gammas[0][first[by]].sum(axis=0)
        seen, weight = np.concatenate(tokens), np.concatenate(gammas)
        for s in range(k):
            emit[s] += np.bincount(seen, weight[:, s], CLASSES)


def _side_by_side(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Tokens at each step of the sequences, the longest first; the order used; how many are left at each step."""
    sizes = np.array([len(t) for t in texts])
    by = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([texts[i] for i in by])
    begin = np.cumsum(sizes[by]) - sizes[by]
    live = np.searchsorted(-sizes[by], -np.arange(sizes.max()), "left")
    return [flat[begin[:n] + t] for t, n in enumerate(live)], by, live


def _first_model(texts: DataFrame) -> Model:
    """Classes with similar next classes begin in one state: k-means over rows of a table of CLASSES by CONTEXT counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * (CONTEXT + 1), np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch["classes"].to_pylist()), np.uint16).astype(np.int64)
            after = np.minimum(np.concatenate((flat[1:], [CONTEXT])), CONTEXT)
            after[flat == END] = CONTEXT
            total += np.bincount(flat * (CONTEXT + 1) + after, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["cell", "n"])

    cells = texts.select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CLASSES * (CONTEXT + 1))
    table[np.asarray(cells["cell"])] = np.asarray(cells["n"])
    table = table.reshape(CLASSES, CONTEXT + 1)
    count = table.sum(axis=1)
    share = table[:, :CONTEXT].sum(axis=0) / max(count.sum(), 1) + 1e-12
    points = np.sqrt((table[:, :CONTEXT] + 20 * share) / (count + 20)[:, None])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = points[[int(count.argmax())]]
    while len(centres) < STATES:  # the next centre is far from all others and frequent
        near = (points @ centres.T).max(axis=1)
        centres = np.concatenate((centres, points[[int(((1 - near) * np.sqrt(count)).argmax())]]))
    for _ in range(25):
        state = (points @ centres.T).argmax(axis=1)
        for k in range(STATES):
            if count[state == k].sum() > 0:
                c = (points[state == k] * count[state == k][:, None]).sum(axis=0)
                centres[k] = c / np.linalg.norm(c)
    emit = (count + 1)[None, :] * np.where(state[None, :] == np.arange(STATES)[:, None], 1.0, 0.15)
    return Model(np.ones(STATES), np.full((STATES, STATES), 0.3) + 2.0 * np.eye(STATES), emit)


def baum_welch(texts: DataFrame, rounds: int = ROUNDS) -> Model:
    """Rounds of Baum-Welch over all learning texts; each task adds up its own expected counts before Spark sums them."""
    learn = texts.filter("not held_out")
    model = _first_model(learn)
    columns = [f"s{k}" for k in range(STATES)]
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
            some, first, held = [], [], 0
            for batch in batches:
                for blob in batch["classes"]:
                    text = np.frombuffer(blob.as_buffer(), np.uint16)
                    for a in range(0, len(text), SEGMENT):
                        some.append(text[a : a + SEGMENT])
                        first.append(a == 0)
                        held += len(some[-1])
                        if held >= BATCH_TOKENS:
                            model.expected(some, np.array(first), start, move, emit)
                            some, first, held = [], [], 0
            if some:
                model.expected(some, np.array(first), start, move, emit)
            rows = np.concatenate((emit.T, move, start[None]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), *(pa.array(rows[:, k].copy()) for k in range(STATES))], names=["place", *columns])

        summed = learn.select("classes").mapInArrow(run, "place long, " + ", ".join(f"{c} double" for c in columns)).groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        total = np.zeros((CLASSES + STATES + 1, STATES))
        if summed.num_rows:
            total[np.asarray(summed["place"])] = np.stack([np.asarray(summed[c]) for c in columns], axis=1)
        model = Model(total[-1] + 1e-3, total[CLASSES:-1] + 1e-3, total[:CLASSES].T + FLOOR + 1e-3 * total[:CLASSES].sum(axis=1) / max(total[:CLASSES].sum(), 1.0))
    return model


def sequence_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id, text).

    Texts are lower-cased (A-Z); tokens are runs of anything but ASCII blanks, and one end. score is log10 of the text's
    probability under the hidden Markov model, base_score under smoothed counts alone; both learn from rows that are not
    held out. Null and empty texts are their end alone. Rows without id are held out; repeated rows each count, and
    score alike. A text may be of any length. If nothing can be learned, all words are unknown. No rows give no rows.
    """
    words = stage(vocabulary(docs))
    counts = Counts(words, docs.filter(~held_out()).count())
    texts = encoded(docs, counts)
    model = baum_welch(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                score = model.log10([np.frombuffer(b.as_buffer(), np.uint16) for b in part["classes"]])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(score)], names=[*kept, "states"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inside"]
    scored = texts.select(*kept, "classes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inside double, states double")
    rare = rare_sums(texts, words, counts, exchange.shares(docs))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (C("known") + zero("known2")).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (C("base") + zero("base2")).alias("base_score"), (C("states") + C("inside") + zero("inside2")).alias("score"),
    )
