"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of letters (runs of other characters count as
one boundary symbol) is the element-wise product of its letters' vectors, permuted by two, one and no
places; a profile is the sum of the vectors of a text's trigrams. A language's prototype is the profile of all its training texts; a text gets the language of the
largest cosine. ASCII letters have a symbol each, other letters share ``OTHERS`` symbols by hash, so
that any script is covered by a fixed alphabet.

Training counts trigrams by language over all training rows; only those counts, at most SYMBOLS ** 3 a
language, meet in one task, and only the prototypes reach the driver.

Cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
could be learned. Equal cosines go to the alphabetically first language. Rows with null language or
text teach nothing. Repeated rows count each time. Texts of any length pass whole. Only the named
columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import U, chunks, mix
from verbatia.llm.work import bound_batches, give_back

DIMENSIONS = 1024
SYMBOLS, OTHERS = 64, 37
#: Trigrams that are bound at once; their vectors fit a core's cache.
BLOCK = 512
UNKNOWN = "und"


@functools.lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of every code point: 0 for all but letters, 1 to 26 for ASCII letters in either case."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) - 96 if low.isascii() and len(low) == 1 else 0
            if not out[c]:
                out[c] = 27 + int(mix(np.array([ord(low[0])], U))[0] % U(OTHERS))
    return out


@functools.lru_cache(1)
def _vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), size=(SYMBOLS, DIMENSIONS))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the grams' vectors by their counts."""
    first, second, third = _vectors()
    total = np.zeros(DIMENSIONS)
    for at in range(0, len(grams), BLOCK):
        g = grams[at : at + BLOCK]
        bound = first[g >> 12]
        bound *= second[(g >> 6) & 63]
        bound *= third[g & 63]
        total += counts[at : at + BLOCK].astype(np.float32) @ bound.astype(np.float32)
    return total


def _grams(symbols: np.ndarray) -> np.ndarray:
    """Trigrams of one text, boundary runs collapsed, with a boundary before and after."""
    s = np.concatenate([[0], symbols, [0]]).astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
    return (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) < 8192:
        return np.unique(grams, return_counts=True)
    n = np.bincount(grams, minlength=SYMBOLS**3)
    at = np.flatnonzero(n)
    return at, n[at]


def _texts(column: pa.Array):
    """Symbols of each text of a column."""
    table = _symbols()
    for lo, hi, data, offsets in chunks(column):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        symbols = table[points]
        for d in range(hi - lo):
            yield lo + d, symbols[ends[d] : ends[d + 1]]


def learn_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of unit length from labelled rows."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, s in _texts(batch.column("text")):
                grams, n = _counted(_grams(s)) if s.any() else (np.zeros(0, np.int64),) * 2
                if len(grams):
                    totals.setdefault(langs[i], np.zeros(SYMBOLS**3, np.int64))[grams] += n
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])
        give_back()

    def prototype(rows: pd.DataFrame) -> pd.DataFrame:
        v = bundle(rows.gram.to_numpy(), rows.n.to_numpy())
        return pd.DataFrame({"lang": rows.lang[:1], "vector": [v / (np.linalg.norm(v) or 1)]})

    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return {r.lang: np.array(r.vector) for r in counts.groupBy("lang").applyInPandas(prototype, "lang string, vector array<double>").collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", out: str = "lang_pred") -> DataFrame:
    """All columns, and a struct ``out`` of lang and score."""
    bound_batches(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in names]) if names else np.zeros((0, DIMENSIONS))

    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for i, s in _texts(pa.array(texts, pa.large_string(), from_pandas=True)):
            if not names or not s.any():
                continue
            v = bundle(*_counted(_grams(s)))
            cosines = matrix @ v / (np.linalg.norm(v) or 1)
            best = int(np.argmax(cosines))
            langs[i], scores[i] = names[best], min(1.0, max(0.0, cosines[best]))
        return pd.DataFrame({"lang": langs, "score": scores})

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict(texts)
        give_back()

    # Declared non-deterministic, or a filter on the result would evaluate it a second time below the projection.
    return docs.withColumn(out, F.pandas_udf(each, "lang string, score double").asNondeterministic()(F.col(text_col)))
