"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import bound_batches, cut, give_back, pick, released, remove

UNDETERMINED = "und"
#: Orders of the n-grams, log2 of the hash table.
ORDERS, BITS = (1, 2, 3), 16
#: Labelled rows that a fit reads, and of each language however rare (or all, if it has fewer): the bounds of its sample.
MOST_ROWS, LANGUAGE_ROWS = 20_000, 20
#: Languages of which a matrix is broadcast (256 KB each); a fit of more raises an error.
MOST_LANGUAGES = 2048
#: Languages whose sums the driver gets at once.
TOGETHER = 32
#: Characters that are scored at once.
CHUNK = 1 << 18
#: Odd multipliers of the n-gram hash, one for each place in an n-gram, then one for each order.
PLACES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
SALTS = (0x27D4EB2F, 0x165667B1, 0x2545F491)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def hashed(points: np.ndarray, order: int) -> np.ndarray:
    """Table slots of the n-grams that start at each place but the last order - 1."""
    n = max(0, len(points) - order + 1)
    h = np.full(n, SALTS[order - 1], np.uint32)
    for k in range(order):
        h ^= points[k : k + n] * np.uint32(PLACES[k])
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return h >> np.uint32(32 - BITS)


@dataclass
class NaiveBayes:
    """languages in order, their log priors and the log-probability matrix (slots x languages)."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """A row a text. Texts, those of over CHUNK places in pieces, are joined into long arrays of slots, a sparse batch; sums are taken by text.

        A piece ends with the first places of the next, which its last n-grams need; no n-gram starts there.
        """
        out = np.zeros((len(texts), len(self.languages)))
        own: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if own:
                points = np.concatenate([p for _, p in own])
                ends = np.cumsum([len(p) for _, p in own])
                starts = np.concatenate([[0], ends[:-1]])
                for order in ORDERS:
                    slots = hashed(points, order)
                    keep = np.ones(len(points), bool)  # no n-gram crosses from one text to the next
                    for k in range(1, order):
                        keep[ends - k] = False
                    for a, b in zip(starts, ends):
                        if b - a > CHUNK:
                            keep[a + CHUNK : b] = False
                    keep = keep[: len(slots)]
                    at = np.concatenate([[0], np.cumsum(keep)])
                    lo, hi = at[np.minimum(starts, len(slots))], at[np.minimum(ends, len(slots))]
                    full = np.flatnonzero(hi > lo)
                    if len(full):
                        sums = np.add.reduceat(self.matrix[slots[keep]], lo[full], axis=0, dtype=np.float64)
                        np.add.at(out, [own[i][0] for i in full], sums)
            own.clear()

        for i, text in enumerate(texts):
            points = code_points(text)
            for a in range(0, len(points), CHUNK):
                own.append((i, points[a : a + CHUNK + max(ORDERS) - 1]))
                size += len(own[-1][1])
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if known:
            logs = self.log_likelihoods([texts[i] for i in known]) + self.prior
            logs -= logs.max(axis=1, keepdims=True)
            best = logs.argmax(axis=1)
            top = 1 / np.exp(logs).sum(axis=1)
            for i, b, s in zip(known, best, top):
                langs[i], scores[i] = self.languages[b], float(s)
        return langs, scores


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS) -> NaiveBayes:
    """Counts n-grams of the whole texts of a sample of labelled rows, those of least xxhash64(id).

    The sample has about most_rows rows at most, dealt to languages by their number of rows, but
    LANGUAGE_ROWS of each language that has so many; priors are those of all rows. Rows whose text
    or language is null teach nothing, null ids count as one id. Counts are summed by task, then by
    language and slot, so the driver gets at most languages x slots sums.
    """
    rows = pick(labelled, id_col, text_col, lang_col).toDF("id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the matrix would not be small enough to broadcast")
    languages, n = sorted(sizes), sum(sizes.values())
    if n > most_rows:
        share = [(lang, min(1.0, max(most_rows / n, LANGUAGE_ROWS / sizes[lang]))) for lang in languages]
        shares = rows.sparkSession.createDataFrame(share, "lang string, share double")
        drawn = F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1)) < (F.col("share") * F.lit(float(1 << 32))).cast("long")
        rows = rows.join(F.broadcast(shares), "lang").where(drawn)
    rows = rows.select(F.make_valid_utf8("text").alias("text"), "lang")

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                points = code_points(text)
                for order in ORDERS:
                    for a in range(0, len(points), CHUNK):
                        own += np.bincount(hashed(points[a : a + CHUNK + order - 1], order), minlength=1 << BITS)
        for lang, own in sums.items():
            slots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(own[slots], pa.int64())], ["lang", "slot", "n"])

    counts = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = cut(counts, "ngrams")
    matrix = np.empty((1 << BITS, len(languages)), np.float32)
    for first in range(0, len(languages), TOGETHER):
        some = languages[first : first + TOGETHER]
        got = table.where(F.col("lang").isin(some)).toArrow()
        which, slots, values = (got.column(c).combine_chunks() for c in ("lang", "slot", "n"))
        own = np.full((1 << BITS, len(some)), 0.5)
        own[slots.to_numpy(), pc.index_in(which, pa.array(some)).to_numpy()] += values.to_numpy()
        matrix[:, first : first + TOGETHER] = np.log(own / own.sum(axis=0))
    remove(table)
    return NaiveBayes(languages, np.log(np.array([sizes[x] for x in languages]) / n) if languages else np.zeros(0), matrix)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether a row is not learned from: crc32 of its id as text, modulo folds, is fold. So is every row without an id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(True))


def predict(docs: DataFrame, model: NaiveBayes, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs and two more columns: the language, `und` where the text is null or has no letter, and its posterior (0 for `und`).

    A model without languages calls every text `und`. Bytes that are no UTF-8 count as U+FFFD, which
    is no letter. The matrix is broadcast: 4 bytes x 65,536 slots x languages.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for batch in batches:
            langs, scores = own.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
        give_back()

    names = docs.columns
    bound_batches(docs.sparkSession)
    own = docs.toDF(*[f"_{i}" for i in range(len(names))])
    guessed = own.withColumn("_guess", guess(F.make_valid_utf8(f"_{names.index(text_col)}")))
    return guessed.select("*", "_guess.lang", "_guess.score").drop("_guess").toDF(*names, *into)
