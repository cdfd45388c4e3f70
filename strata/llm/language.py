"""Language identification as inference over mixtures of languages.

Each language has a model of byte trigrams over a small alphabet (letters a-z, a blank for anything else in ASCII, classes
of bytes beyond it), counted over all learning rows. A text is a mixture: expectation-maximisation estimates the
proportions of languages from the trigrams' likelihoods. The set of languages is chosen by penalised likelihood: the
languages in the order of their proportions, as many as pay for themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from strata.llm.text import slices

SYMBOLS = 64  # blank, a-z, and 37 classes for the bytes beyond ASCII
TRIGRAMS = SYMBOLS**3
STEPS = 12
SMOOTHING = 0.5
NO_LANGUAGE = "und"


def _alphabet() -> np.ndarray:
    table = np.zeros(256, np.int32)
    for i in range(26):
        table[65 + i] = table[97 + i] = 1 + i
    table[128:] = 27 + np.arange(128) % (SYMBOLS - 27)
    return table


ALPHABET = _alphabet()


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Trigram numbers of one text, with a blank before and after; runs of blanks count as one."""
    s = np.zeros(len(data) + 2, np.int32)
    s[1:-1] = ALPHABET[data]
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, np.int32)


def held_out():
    """Rows that are never learned from: crc32 of the id as text is divisible by 5; rows without id too."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, trigram, n) over all learning rows; each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for part in slices(batch["text"]):
                for r in range(part.rows):
                    found = _trigrams(part.data[part.offsets[r] : part.offsets[r + 1]])
                    lang = langs[part.first + r]
                    if lang not in total:
                        total[lang] = np.zeros(TRIGRAMS, np.int64)
                    np.add.at(total[lang], found, 1) if len(found) < 2000 else np.add(total[lang], np.bincount(found, minlength=TRIGRAMS), out=total[lang])
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "trigram", "n"])

    learn = docs.filter(~held_out() & F.col("lang").isNotNull()).select("lang", F.col("text").cast("binary").alias("text"))
    return learn.mapInArrow(run, "lang string, trigram int, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


class Model:
    """Languages and the likelihood of each trigram in each."""

    def __init__(self, counts: pa.Table):
        langs = np.asarray(counts["lang"].to_pylist(), dtype=object)
        self.langs = sorted(set(langs.tolist()))
        n = np.zeros((len(self.langs), TRIGRAMS))
        if len(langs):
            n[np.searchsorted(np.array(self.langs, dtype=object), langs), np.asarray(counts["trigram"])] = np.asarray(counts["n"])
        seen = n.sum(axis=0) > 0
        n[:, seen] += SMOOTHING
        # Trigrams that no learning row has say nothing about the language: all give them the same likelihood.
        total = n.sum(axis=1, keepdims=True)
        self.likelihood = np.where(seen, n / np.maximum(total, 1), 1e-9).T.astype(np.float32).copy()

    def mixture(self, data: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The chosen languages and their proportions, the largest first."""
        kinds, counts = np.unique(_trigrams(data), return_counts=True)
        p = self.likelihood[kinds].astype(np.float64)
        share = _proportions(p, counts, np.full(len(self.langs), 1 / len(self.langs)))
        rank = np.argsort(-share, kind="stable")
        penalty = 0.5 * np.log(max(counts.sum(), 2))
        best, chosen = -np.inf, (rank[:1].tolist(), np.ones(1))
        for size in range(1, len(rank) + 1):
            some = rank[:size]
            if size > 1 and share[some[-1]] < 1e-4:
                break
            mine = _proportions(p[:, some], counts, np.full(size, 1 / size)) if size > 1 else np.ones(1)
            value = counts @ np.log(p[:, some] @ mine) - penalty * (size - 1)
            if value <= best:
                break
            by = np.argsort(-mine, kind="stable")
            best, chosen = value, (some[by].tolist(), mine[by])
        return chosen


def _proportions(p: np.ndarray, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Expectation-maximisation of the mixture's proportions."""
    total = counts.sum()
    for _ in range(STEPS):
        share = share * (p.T @ (counts / (p @ share))) / total
    return share


def languages(docs: DataFrame) -> DataFrame:
    """The columns of `docs` and held_out, lang_pred, score, mixture (language and proportion, the largest first).

    The model is learned from the text and non-null lang of rows that are not held out; lang and source do not enter a
    prediction. lang_pred is the language of the largest proportion, score that proportion. A text that is null or has no
    letter is `und` with score 0, and so is every text if nothing could be learned. Equal proportions go to the language
    that sorts first. Repeated rows get equal answers; a column of `docs` with a result's name is replaced.
    """
    made = ("held_out", "lang_pred", "score", "mixture")
    named = docs.select([f"`{c}`" for c in docs.columns if c not in made])
    model = Model(trigram_counts(docs).toArrow())
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters_")
    schema = pa.schema([*to_arrow_schema(named.schema), ("letters_", pa.bool_()), ("mixture", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, mixture = batch["letters_"].to_pylist(), []
            for part in slices(batch["text"]):
                for r in range(part.rows):
                    if not model.langs or not has[part.first + r]:
                        mixture.append([])
                        continue
                    some, share = model.mixture(part.data[part.offsets[r] : part.offsets[r + 1]])
                    mixture.append([{"lang": model.langs[k], "share": float(s)} for k, s in zip(some, share)])
            columns = [batch[f.name].cast(f.type) for f in schema if f.name != "mixture"] + [pa.array(mixture, kind)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = named.select("*", letters).mapInArrow(run, from_arrow_schema(schema))
    first = F.try_element_at("mixture", F.lit(1))
    return found.select(
        *[f"`{c}`" for c in named.columns], held_out().alias("held_out"), F.coalesce(first["lang"], F.lit(NO_LANGUAGE)).alias("lang_pred"),
        F.least(F.coalesce(first["share"], F.lit(0.0)), F.lit(1.0)).alias("score"), "mixture",
    )


def language_digest(docs: DataFrame) -> DataFrame:
    return languages(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
